"""Parsing of files as one distributed pass: a row a file goes in, a nested row comes out; explode() gives the tables.

Fidelity: Python is read by its own grammar, other languages by patterns over code with comments and strings blanked out. Every
row that an extractor gives refers to symbols of the same file, lies within its lines, and does not depend on partitioning.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.operators.layout import spread
from codelode.parse import artifacts, chunks, imports, symbols
from codelode.parse.languages import CONFIG_NAMES, EXPORTS, JS_LIKE, LANGUAGES, detect
from codelode.parse.source import Source
from codelode.parse.symbols import FLAGS, digest

#: Limits of files and issues.
MAX_FILE, MAX_ISSUES, LONG_FILE, LONG_FUNCTION, DEEP = 10 << 20, 50, 1000, 200, 6
SIDE_EFFECTS = (".css", ".scss", ".less", ".sass", ".styl")

_S, _I, _B = "string", "int", "boolean"


def _struct(**fields: str) -> str:
    return "struct<" + ",".join(f"{k}:{v}" for k, v in fields.items()) + ">"


SYMBOL = _struct(symbol_id=_S, name=_S, qualified_name=_S, kind=_S, signature=_S, start_line=_I, end_line=_I, doc_text=_S, symbol_hash=_S, parent_symbol_id=_S, flags=_struct(**dict.fromkeys(FLAGS, _B)), modifiers="array<string>", return_type=_S, parameter_types="array<string>")
IMPORT = _struct(source_symbol_id=_S, source_file_path=_S, target_file_path=_S, import_name=_S, import_type=_S, package_name=_S, package_version=_S)
CHUNK = _struct(chunk_id=_S, symbol_id=_S, chunk_type=_S, chunk_hash=_S, content=_S, context_before=_S, context_after=_S, start_line=_I, end_line=_I, estimated_tokens=_I, owner_qualified_name=_S, owner_kind=_S, is_exported_context=_B, semantic_role=_S)
ISSUE = _struct(code=_S, message=_S, line=_I, column=_I, severity=_S)
EXPORT = _struct(export_id=_S, file_path=_S, export_kind=_S, exported_name=_S, local_name=_S, symbol_id=_S, source_module=_S, line=_I, column=_I)
REFERENCE = _struct(reference_id=_S, source_file_path=_S, source_symbol_id=_S, reference_kind=_S, raw_text=_S, target_name=_S, qualified_target_hint=_S, start_line=_I, start_column=_I, end_line=_I, end_column=_I, resolution_scope=_S, resolved_target_symbol_id=_S, confidence=_S)
USAGE = _struct(usage_id=_S, source_symbol_id=_S, component_name=_S, is_intrinsic=_B, is_fragment=_B, line=_I, column=_I, resolved_target_symbol_id=_S, confidence=_S)
CALL = _struct(network_call_id=_S, source_symbol_id=_S, client_kind=_S, method=_S, url_literal=_S, url_template=_S, is_relative=_B, start_line=_I, start_column=_I, confidence=_S)
FACTS = _struct(has_jsx=_B, has_default_export=_B, has_named_exports=_B, has_top_level_side_effects=_B, has_react_hook_calls=_B, has_fetch_calls=_B, has_class_declarations=_B, has_tests=_B, has_config_patterns=_B, jsx_runtime=_S)
STATUS = _struct(extractor_name=_S, status=_S, issue_count=_I, message=_S)
TABLES = {"symbols": SYMBOL, "imports": IMPORT, "chunks": CHUNK, "issues": ISSUE, "exports": EXPORT, "references": REFERENCE, "jsx_usages": USAGE, "network_calls": CALL}
RESULT = "file_path string, language string, file_hash string, line_count int, size_bytes long, " + ", ".join(f"`{k}` array<{v}>" for k, v in TABLES.items()) + f", facts {FACTS}, enabled_extractors array<string>, extractor_statuses array<{STATUS}>"


def issue(code: str, message: str, severity: str, line: int = 1, column: int = 1) -> dict:
    return {"code": code, "message": message, "line": line, "column": column, "severity": severity}


def merge_by_line(errors: list[dict]) -> list[dict]:
    """Parse errors with runs on one line made one."""
    out: list[list[dict]] = []
    for e in errors:
        if out and out[-1][0]["line"] == e["line"]:
            out[-1].append(e)
        else:
            out.append([e])
    return [g[0] if len(g) == 1 else issue("PARSE_ERROR", f"Multiple parse errors on line {g[0]['line']}", "error", g[0]["line"], g[0]["column"]) for g in out]


def _syntax(src: Source) -> list[dict]:
    """Errors of syntax: Python's own, elsewhere brackets that do not match."""
    if src.language == "python":
        try:
            ast.parse(src.text)
        except SyntaxError as e:
            return [issue("PARSE_ERROR", f"Syntax error: {e.msg}", "error", e.lineno or 1, e.offset or 1)]
        except (ValueError, RecursionError, MemoryError) as e:
            return [issue("PARSE_ERROR", f"Syntax error: {type(e).__name__}", "error")]
        return []
    if LANGUAGES[src.language].tier == 3 or src.language in ("bash", "ruby", "dockerfile", "sql"):
        return []
    out, stack, pair = [], [], {")": "(", "]": "[", "}": "{"}
    for m in re.finditer(r"[()\[\]{}]", src.code):
        if m[0] in "([{":
            stack.append(m)
        elif stack and stack[-1][0] == pair[m[0]]:
            stack.pop()
        else:
            out.append(issue("PARSE_ERROR", f"Unexpected {m[0]}", "error", src.line(m.start()), src.column(m.start())))
    out += [issue("MISSING_NODE", f"Unclosed {m[0]}", "error", src.line(m.start()), src.column(m.start())) for m in stack]
    return sorted(out, key=lambda i: (i["line"], i["column"]))


def diagnostics(src: Source, path: str, own: list[dict], exported: list[dict]) -> list[dict]:
    """Issues of a file, at most MAX_ISSUES, by place."""
    lang, n = LANGUAGES[src.language], len(src.lines)
    out = merge_by_line(_syntax(src))
    if n > LONG_FILE:
        out.append(issue("LONG_FILE", f"File has {n} lines (threshold: {LONG_FILE})", "warning"))
    for s in own:
        if s["kind"] in ("function", "method") and (size := s["end_line"] - s["start_line"] + 1) > LONG_FUNCTION:
            out.append(issue("LONG_FUNCTION", f"Function has {size} lines (threshold: {LONG_FUNCTION})", "warning", s["start_line"]))
    if lang.tier < 3:
        depths = src.nesting()
        base = 1 if lang.tier == 1 else 0
        for i, (before, now) in enumerate(zip([0, *depths], depths), 1):
            if before <= DEEP + base < now:
                out.append(issue("DEEP_NESTING", f"Nesting deeper than {DEEP} levels", "warning", i))
    if src.language in JS_LIKE and not exported and not chunks.matches(path, lang.test_files):
        out.append(issue("NO_EXPORTS", "File has no exports", "info"))
    return sorted(out[:MAX_ISSUES], key=lambda i: (i["line"], i["column"], i["code"]))


def facts(r: dict) -> dict:
    """What a file has, from its rows and its path."""
    path = r["file_path"]
    base = path.rpartition("/")[2].lower()
    runtime = next((k for i in r["imports"] for k in ("preact", "react") if k in i["import_name"].lower()), "unknown") if r["language"] in ("jsx", "tsx") else ""
    return {
        "has_jsx": bool(r["jsx_usages"]), "has_default_export": any(e["export_kind"] == "DEFAULT" for e in r["exports"]), "has_named_exports": any(e["export_kind"] == "NAMED" for e in r["exports"]),
        "has_top_level_side_effects": any((i["target_file_path"] or i["import_name"]).lower().endswith(SIDE_EFFECTS) for i in r["imports"]), "has_react_hook_calls": any(x["reference_kind"] == "HOOK_USE" for x in r["references"]),
        "has_fetch_calls": bool(r["network_calls"]), "has_class_declarations": any(s["kind"] == "class" for s in r["symbols"]), "has_tests": any(x in base for x in ("_test.", ".test.", ".spec.", "_spec.")) or any(x in path for x in ("/__tests__/", "/test/", "/tests/", "/spec/")),
        "has_config_patterns": any(x in base for x in CONFIG_NAMES), "jsx_runtime": runtime,
    }


def normalize(text: str) -> str:
    return text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")


#: The tables that an extractor's table is made from; chunks and the other tables need symbols.
MADE_FROM = {"symbols": (), "imports": (), "exports": ("symbols", "imports"), "jsx_usages": ("symbols",), "references": ("symbols", "imports", "jsx_usages"), "network_calls": ("symbols",), "chunks": ("symbols",)}


def parse_file(path: str, content: str | None, language: str | None = None, tables: frozenset[str] | None = None) -> dict:
    """The nested result of one file; what goes wrong in one extractor becomes an issue and a FAILED status.

    With tables, only their extractors run and those that these need; the rest of the result says nothing then.
    """
    r: dict = {"file_path": path, "language": "", "file_hash": "", "line_count": 0, "size_bytes": 0, **{t: [] for t in TABLES}, "facts": None, "enabled_extractors": [], "extractor_statuses": []}
    text = normalize(content or "")
    if not text:
        return r
    size = len(text.encode())
    r |= {"file_hash": digest(text), "size_bytes": size, "line_count": text.count("\n") + (not text.endswith("\n"))}
    if size > MAX_FILE:
        r["issues"] = [issue("OVERSIZED_FILE", f"File size {size} bytes exceeds limit of {MAX_FILE} bytes", "warning")]
        return r
    lang = language or detect(path)
    if lang not in LANGUAGES:
        r["issues"] = [issue("UNSUPPORTED_LANGUAGE", f"Unsupported file extension: {path[path.rfind('.') :] if '.' in path.rpartition('/')[2] else ''}", "warning")]
        return r
    r["language"] = lang
    src, tier = Source(text, lang), LANGUAGES[lang].tier

    def run(name: str, table: str, f: Callable[[], list[dict]]) -> None:
        if tables is not None and table not in tables:
            return
        r["enabled_extractors"].append(name)
        try:
            found, message = f(), ""
        except Exception as e:  # one extractor's failure must not lose the file
            found, message = [], f"{type(e).__name__}: {e}"
            r["issues"].append(issue("EXTRACTION_ERROR", f"{name}: {message}", "error"))
        r[table] = r[table] + found
        r["extractor_statuses"].append({"extractor_name": name, "status": "FAILED" if message else "OK", "issue_count": int(bool(message)), "message": message})

    run("symbols", "symbols", lambda: symbols.extract(src, path))
    if tier < 3:
        run("imports", "imports", lambda: imports.extract(src, path))
    if tier == 1:
        run("exports", "exports", lambda: artifacts.exports(src, path, r["symbols"], r["imports"]))
        run("jsx_usages", "jsx_usages", lambda: artifacts.jsx_usages(src, r["symbols"]))
        run("references", "references", lambda: artifacts.references(src, path, r["symbols"], r["imports"], r["jsx_usages"]))
        run("network_calls", "network_calls", lambda: artifacts.network_calls(src, r["symbols"]))
    run("chunks", "chunks", lambda: chunks.extract(src, path, r["symbols"]))
    run("diagnostics", "issues", lambda: diagnostics(src, path, r["symbols"], r["exports"] if EXPORTS.get(lang) else []))
    r["facts"] = facts(r) if tables is None else None
    return r


def _given(files: DataFrame, path: str, content: str, language: str | None) -> DataFrame:
    return spread(files.select(F.col(path).cast("string").alias("p"), F.col(content).cast("string").alias("c"), (F.col(language).cast("string") if language else F.lit(None).cast("string")).alias("l")))


def parse(files: DataFrame, path: str = "file_path", content: str = "content", language: str | None = None) -> DataFrame:
    """A nested row for every file (null content counts as empty), in Arrow batches, without a shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = _given(files, path, content, language)
    target = to_arrow_schema(files.sparkSession.createDataFrame([], RESULT).schema)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200).to_pylist()
                yield pa.RecordBatch.from_pylist([parse_file(x["p"], x["c"], x["l"]) for x in part], schema=target)

    return rows.mapInArrow(f, RESULT)


def extract(files: DataFrame, table: str, path: str = "file_path", content: str = "content", language: str | None = None) -> DataFrame:
    """The rows of explode(parse(files), table), for any table but issues; extractors that it does not need do not run."""
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted, result = frozenset((table, *MADE_FROM[table])), f"file_path string, x array<{TABLES[table]}>"
    target = to_arrow_schema(files.sparkSession.createDataFrame([], result).schema)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200).to_pylist()
                yield pa.RecordBatch.from_pylist([{"file_path": x["p"], "x": parse_file(x["p"], x["c"], x["l"], wanted)[table]} for x in part], schema=target)

    parsed = _given(files, path, content, language).mapInArrow(f, result)
    return parsed.select(F.col("file_path").alias("file"), F.explode("x").alias("x")).select("file", "x.*")


def explode(parsed: DataFrame, table: str) -> DataFrame:
    """Rows of one of the tables in a parse result, with the file's path."""
    return parsed.select("file_path", F.explode(table).alias("x")).select(F.col("file_path").alias("file"), "x.*")


def raw_chunks(files: DataFrame, key: str, content: str) -> DataFrame:
    """key, seq, content, chunk_hash, start_line, end_line: files cut into pieces of at most 7,500 bytes."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part, rows, of = batch.slice(at, 500), [], []
                for i, text in enumerate(part.column("c").to_pylist()):
                    n = text.count("\n") + (text != "" and not text.endswith("\n"))
                    found = chunks.raw_chunks("", text, n)
                    of += [i] * len(found)
                    rows += [(k, c["content"], c["chunk_hash"], c["start_line"], c["end_line"]) for k, c in enumerate(found)]
                cols = list(zip(*rows)) or [()] * 5
                rest = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()))]
                yield pa.record_batch([part.column("key").take(pa.array(of, pa.int64())), *rest], names=["key", "seq", "content", "chunk_hash", "start_line", "end_line"])

    rows = files.select(F.col(key).alias("key"), F.coalesce(F.col(content).cast("string"), F.lit("")).alias("c"))
    return rows.mapInArrow(f, f"key {rows.dtypes[0][1]}, seq int, content string, chunk_hash string, start_line int, end_line int")
