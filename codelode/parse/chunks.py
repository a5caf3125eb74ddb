"""Chunks of files for search and embedding: by symbols, test blocks or raw pieces."""

from __future__ import annotations

import re

from codelode.functions.predicates import any_file_pattern
from codelode.parse.languages import LANGUAGES
from codelode.parse.source import Source
from codelode.parse.symbols import digest

#: Bytes of a raw piece, lines above which a class is summarised, what a comment line starts with.
MAX_BYTES, LARGE_CLASS = 7500, 200
COMMENT_STARTS = ("//", "/*", "*", "#", '"""', "'''", "@")
TYPE_ORDER = {"module_context": 0, "class": 1, "function": 2}


def matches(path: str, patterns: list[str]) -> bool:
    return bool(patterns) and bool(re.search(any_file_pattern(patterns), path))


def tokens(text: str) -> int:
    return (len(text.encode()) + 3) // 4


def chunk(path: str, kind: str, content: str, first: int, last: int, symbol: dict | None = None, role: str = "implementation") -> dict:
    return {
        "chunk_id": f"{path}:{kind}:{first}-{last}", "symbol_id": symbol["symbol_id"] if symbol else "", "chunk_type": kind, "chunk_hash": digest(content), "content": content,
        "context_before": f"File: {path} > {symbol['kind']} {symbol['name']}" if symbol else "", "context_after": "", "start_line": first, "end_line": last, "estimated_tokens": tokens(content),
        "owner_qualified_name": symbol["qualified_name"] if symbol else "", "owner_kind": symbol["kind"] if symbol else "", "is_exported_context": bool(symbol and symbol["flags"]["is_exported"]), "semantic_role": role,
    }


def role_of(symbol: dict, tier: int) -> str:
    f = symbol["flags"]
    return "ui_component" if f["is_react_component_like"] else "hook" if f["is_hook_like"] else "api_surface" if f["is_exported"] and tier == 1 else "implementation"


def pieces(text: str, limit: int = MAX_BYTES) -> list[tuple[str, int, int]]:
    """A text cut into pieces of at most limit bytes, at line ends where there are any: (piece, first line, last line).

    The pieces joined give the text again. A line longer than the limit is cut between characters.
    """
    raw, out, at, line = text.encode(), [], 0, 1
    while at < len(raw):
        end = min(at + limit, len(raw))
        if end < len(raw):
            cut = raw.rfind(b"\n", at, end)
            if cut > at:
                end = cut + 1
            else:
                while raw[end] & 0xC0 == 0x80:
                    end -= 1
        part = raw[at:end]
        ends = part.count(b"\n")
        last = line + ends - (1 if ends and (part.endswith(b"\n") or end < len(raw)) else 0)
        out.append((part.decode(), line, last))
        at, line = end, last + 1
    return out


def raw_chunks(path: str, text: str, n_lines: int) -> list[dict]:
    """Chunks of a file without a parser."""
    if len(text.encode()) <= MAX_BYTES:
        return [{**chunk(path, "raw", text, 1, n_lines), "semantic_role": ""}]
    return [{**chunk(path, "raw", p, a, b), "semantic_role": ""} for p, a, b in pieces(text)]


def split_oversized(chunks: list[dict], limit: int = MAX_BYTES) -> list[dict]:
    """chunks with those over limit bytes cut; pieces keep what the chunk is about, without id and contexts."""
    out = []
    for c in chunks:
        if len(c["content"].encode()) <= limit:
            out.append(c)
            continue
        base = c["start_line"] - 1
        for p, a, b in pieces(c["content"], limit):
            out.append(c | {"chunk_id": "", "context_before": "", "context_after": "", "content": p, "chunk_hash": digest(p), "start_line": base + a, "end_line": base + b, "estimated_tokens": tokens(p)})
    return out


def _test_blocks(src: Source, path: str, patterns: list[str]) -> list[dict]:
    rules = [re.compile(p) for p in patterns]
    starts = [i for i, line in enumerate(src.lines, 1) if any(r.search(line) for r in rules)]
    ends = [*(s - 1 for s in starts[1:]), len(src.lines)]
    return [chunk(path, "test", src.slice(a, b), a, b, role="test") for a, b in zip(starts, ends)]


def _doc_start(src: Source, line: int) -> int:
    """First line of the comment lines right above a line."""
    while line > 1 and src.lines[line - 2].strip().startswith(COMMENT_STARTS):
        line -= 1
    return line


def _summary(src: Source, cls: dict, methods: list[dict]) -> str:
    lines = [src.slice(cls["start_line"], cls["start_line"])]
    lines += ["  " + (m["signature"] or src.slice(m["start_line"], m["start_line"]).strip()) for m in methods]
    return "\n".join([*lines, src.slice(cls["end_line"], cls["end_line"])])


def extract(src: Source, path: str, symbols: list[dict]) -> list[dict]:
    """Chunk rows of a parsed file."""
    lang, n = LANGUAGES[src.language], len(src.lines)
    if matches(path, lang.config_files):
        return [chunk(path, "config", src.text, 1, n, role="config")]
    if lang.tier == 3:
        return [chunk(path, "module_context", src.text, 1, n)]
    if matches(path, lang.test_files):
        return _test_blocks(src, path, lang.test_blocks) or [chunk(path, "test", src.text, 1, n, role="test")]
    classes = [s for s in symbols if not s["parent_symbol_id"] and s["kind"] in ("class", "interface", "enum")]
    outside = lambda s: not any(c["start_line"] <= s["start_line"] and s["end_line"] <= c["end_line"] for c in classes)
    functions = [s for s in symbols if not s["parent_symbol_id"] and s["kind"] == "function" and outside(s)]
    functions += [s for s in symbols if s["parent_symbol_id"] and s["kind"] in ("function", "method") and outside(s)]
    starts = [(s, _doc_start(src, s["start_line"]) if s["doc_text"] else s["start_line"]) for s in functions]
    firsts = [*(c["start_line"] for c in classes), *(a for _, a in starts)]
    out = []
    if not firsts:
        out.append(chunk(path, "module_context", src.text, 1, n))
    elif min(firsts) > 1 and (head := src.slice(1, min(firsts) - 1)).strip():
        out.append(chunk(path, "module_context", head, 1, min(firsts) - 1))
    for c in classes:
        small = c["end_line"] - c["start_line"] < LARGE_CLASS
        content = src.slice(c["start_line"], c["end_line"]) if small else _summary(src, c, [s for s in symbols if s["parent_symbol_id"] == c["symbol_id"]])
        out.append(chunk(path, "class", content, c["start_line"], c["end_line"], c, role_of(c, lang.tier)))
    out += [chunk(path, "function", src.slice(a, s["end_line"]), a, s["end_line"], s, role_of(s, lang.tier)) for s, a in starts]
    return sorted(out, key=lambda c: (TYPE_ORDER.get(c["chunk_type"], 3), c["start_line"]))
