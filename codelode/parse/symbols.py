"""Declarations: Python by its own grammar, other languages by patterns over code without comments and strings."""

from __future__ import annotations

import ast
import hashlib
import re

from codelode.parse.languages import EXPORTS, JS_LIKE
from codelode.parse.source import Source

#: Names of the flags and the words that count as modifiers.
FLAGS = ("is_exported", "is_default_export", "is_async", "is_generator", "is_static", "is_abstract", "is_readonly", "is_optional", "is_arrow_function", "is_react_component_like", "is_hook_like")
MODIFIERS = "public private protected internal static abstract final readonly async export default const override virtual sealed pub unsafe extern open data inline suspend".split()

_JS = [
    ("class", r"^[ \t]*(?P<mod>(?:export\s+|default\s+|declare\s+|abstract\s+)*)class\s+(?P<name>[\w$]+)"),
    ("interface", r"^[ \t]*(?P<mod>(?:export\s+|default\s+|declare\s+)*)interface\s+(?P<name>[\w$]+)"),
    ("enum", r"^[ \t]*(?P<mod>(?:export\s+|declare\s+|const\s+)*)enum\s+(?P<name>[\w$]+)"),
    ("type_alias", r"^[ \t]*(?P<mod>(?:export\s+|declare\s+)*)type\s+(?P<name>[\w$]+)(?:<[^=]*>)?\s*="),
    ("namespace", r"^[ \t]*(?P<mod>(?:export\s+|declare\s+)*)(?:namespace|module)\s+(?P<name>[\w$.]+)\s*\{"),
    ("function", r"^[ \t]*(?P<mod>(?:export\s+|default\s+|declare\s+|async\s+)*)function\s*(?P<gen>\*?)\s*(?P<name>[\w$]+)"),
    ("variable", r"^(?P<mod>(?:export\s+|declare\s+)*)(?:const|let|var)\s+(?P<name>[\w$]+)(?P<init>[^\n]*)"),
    ("method", r"^[ \t]+(?P<mod>(?:public\s+|private\s+|protected\s+|static\s+|abstract\s+|readonly\s+|override\s+|async\s+|get\s+|set\s+)*)(?P<gen>\*?)(?P<name>#?[\w$]+)\s*(?:<[^>\n]*>)?\([^\n;]*\)?[^\n;={]*\{"),
]
_CLIKE = r"(?P<mod>(?:(?:public|private|protected|internal|static|abstract|final|sealed|virtual|override|async|readonly|partial|open|data|inline|suspend|default|synchronized|native|fileprivate|mutating|required|convenience)\s+)*)"
PATTERNS: dict[str, list[tuple[str, str]]] = {
    **{lang: _JS for lang in JS_LIKE},
    "go": [
        ("method", r"^(?P<mod>)func\s*\(\s*(?:\w+\s+)?\*?(?P<owner>\w+)[^)]*\)\s*(?P<name>\w+)"), ("function", r"^(?P<mod>)func\s+(?P<name>\w+)"), ("class", r"^(?P<mod>)type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b"),
        ("interface", r"^(?P<mod>)type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b"), ("type_alias", r"^(?P<mod>)type\s+(?P<name>\w+)\s+(?!struct\b|interface\b)[=\w\[*(]"), ("variable", r"^(?P<mod>)(?:var|const)\s+(?P<name>\w+)"),
    ],
    "rust": [
        ("function", r"^[ \t]*(?P<mod>(?:pub(?:\([^)]*\))?\s+|const\s+|async\s+|unsafe\s+|extern\s+)*)fn\s+(?P<name>\w+)"), ("class", r"^[ \t]*(?P<mod>(?:pub(?:\([^)]*\))?\s+)?)(?:struct|union)\s+(?P<name>\w+)"),
        ("enum", r"^[ \t]*(?P<mod>(?:pub(?:\([^)]*\))?\s+)?)enum\s+(?P<name>\w+)"), ("interface", r"^[ \t]*(?P<mod>(?:pub(?:\([^)]*\))?\s+|unsafe\s+)*)trait\s+(?P<name>\w+)"),
        ("type_alias", r"^[ \t]*(?P<mod>(?:pub(?:\([^)]*\))?\s+)?)type\s+(?P<name>\w+)"), ("variable", r"^(?P<mod>(?:pub(?:\([^)]*\))?\s+)?)(?:const|static)\s+(?:mut\s+)?(?P<name>[A-Z_]\w*)\s*:"),
        ("namespace", r"^[ \t]*(?P<mod>(?:pub(?:\([^)]*\))?\s+)?)mod\s+(?P<name>\w+)"), ("function", r"^[ \t]*(?P<mod>)macro_rules!\s*(?P<name>\w+)"),
    ],
    "java": [
        ("class", rf"^[ \t]*{_CLIKE}(?:class|record)\s+(?P<name>\w+)"), ("interface", rf"^[ \t]*{_CLIKE}@?interface\s+(?P<name>\w+)"), ("enum", rf"^[ \t]*{_CLIKE}enum\s+(?P<name>\w+)"),
        ("method", rf"^[ \t]+{_CLIKE}(?:<[^>\n]+>\s*)?(?:[\w<>\[\],.?]+\s+)?(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|new\b)\w+)\s*\([^;\n]*\)?[^;\n={{]*\{{"),
        ("variable", rf"^[ \t]+{_CLIKE}(?!return\b|package\b|import\b|throw\b|new\b)[\w<>\[\],.?]+\s+(?P<name>\w+)\s*(?:=[^\n]*)?;"),
    ],
    "csharp": [
        ("namespace", r"^[ \t]*(?P<mod>)namespace\s+(?P<name>[\w.]+)"), ("class", rf"^[ \t]*{_CLIKE}(?:class|struct|record)\s+(?P<name>\w+)"), ("interface", rf"^[ \t]*{_CLIKE}interface\s+(?P<name>\w+)"),
        ("enum", rf"^[ \t]*{_CLIKE}enum\s+(?P<name>\w+)"), ("method", rf"^[ \t]+{_CLIKE}(?:[\w<>\[\],.?]+\s+)?(?P<name>(?!if\b|for\b|foreach\b|while\b|switch\b|catch\b|using\b|lock\b|return\b|new\b)\w+)\s*\([^;\n]*\)[^;\n=]*\n?\s*(?:\{{|=>)"),
        ("variable", rf"^[ \t]+{_CLIKE}[\w<>\[\],.?]+\s+(?P<name>\w+)\s*\{{\s*get"),
    ],
    "kotlin": [
        ("class", rf"^[ \t]*{_CLIKE}(?:enum\s+)?(?:class|object)\s+(?P<name>\w+)"), ("interface", rf"^[ \t]*{_CLIKE}interface\s+(?P<name>\w+)"), ("function", rf"^[ \t]*{_CLIKE}fun\s+(?:<[^>]+>\s*)?(?:\w+\.)?(?P<name>\w+)"),
        ("variable", rf"^{_CLIKE}(?:val|var)\s+(?P<name>\w+)"), ("type_alias", r"^(?P<mod>)typealias\s+(?P<name>\w+)"),
    ],
    "swift": [
        ("class", rf"^[ \t]*{_CLIKE}(?:class|struct|actor)\s+(?P<name>\w+)"), ("interface", rf"^[ \t]*{_CLIKE}protocol\s+(?P<name>\w+)"), ("enum", rf"^[ \t]*{_CLIKE}enum\s+(?P<name>\w+)"),
        ("function", rf"^[ \t]*{_CLIKE}func\s+(?P<name>\w+)"), ("method", rf"^[ \t]+{_CLIKE}(?P<name>init)\s*\??\("), ("type_alias", rf"^[ \t]*{_CLIKE}typealias\s+(?P<name>\w+)"), ("variable", rf"^{_CLIKE}(?:let|var)\s+(?P<name>\w+)"),
    ],
    "php": [
        ("namespace", r"^(?P<mod>)namespace\s+(?P<name>[\w\\]+)"), ("class", rf"^[ \t]*{_CLIKE}class\s+(?P<name>\w+)"), ("interface", rf"^[ \t]*{_CLIKE}(?:interface|trait)\s+(?P<name>\w+)"), ("enum", rf"^[ \t]*{_CLIKE}enum\s+(?P<name>\w+)"),
        ("function", r"^(?P<mod>)function\s+&?(?P<name>\w+)"), ("method", rf"^[ \t]+{_CLIKE}function\s+&?(?P<name>\w+)"), ("variable", rf"^[ \t]+{_CLIKE}(?:\??[\w\\]+\s+)?\$(?P<name>\w+)\s*[;=]"),
    ],
    "c": [
        ("class", r"^(?P<mod>(?:typedef\s+)?)(?:struct|union)\s+(?P<name>\w+)\s*\{"), ("enum", r"^(?P<mod>(?:typedef\s+)?)enum\s+(?P<name>\w+)\s*\{"),
        ("function", r"^(?P<mod>(?:static\s+|inline\s+|extern\s+)*)(?!return\b|else\b|typedef\b)[A-Za-z_][\w\s*]*?[\s*](?P<name>[A-Za-z_]\w*)\s*\([^;{]*\)\s*\{"),
    ],
    "ruby": [("class", r"^[ \t]*(?P<mod>)class\s+(?P<name>[A-Z][\w:]*)"), ("namespace", r"^[ \t]*(?P<mod>)module\s+(?P<name>[A-Z][\w:]*)"), ("function", r"^[ \t]*(?P<mod>)def\s+(?:self\.)?(?P<name>[\w?!=]+)"), ("variable", r"^(?P<mod>)(?P<name>[A-Z_][A-Z0-9_]*)\s*=(?!=)")],
    "bash": [("function", r"^[ \t]*(?P<mod>)(?:function\s+)?(?P<name>[\w:-]+)\s*\(\)\s*\{?"), ("function", r"^[ \t]*(?P<mod>)function\s+(?P<name>[\w:-]+)\s*\{"), ("variable", r"^(?P<mod>(?:export\s+|readonly\s+|declare\s+(?:-\w+\s+)?)*)(?P<name>[A-Za-z_]\w*)=")],
    "sql": [
        ("class", r"(?i)^[ \t]*(?P<mod>)create\s+(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"]+)"), ("function", r"(?i)^[ \t]*(?P<mod>)create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+(?P<name>[\w.\"]+)"),
        ("variable", r"(?i)^[ \t]*(?P<mod>)create\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"]+)"), ("variable", r"(?i)^[ \t]*(?P<mod>)create\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"]+)"),
        ("type_alias", r"(?i)^[ \t]*(?P<mod>)create\s+type\s+(?P<name>[\w.\"]+)"),
    ],
    "graphql": [("class", r"^(?P<mod>)(?:type|input)\s+(?P<name>\w+)"), ("interface", r"^(?P<mod>)interface\s+(?P<name>\w+)"), ("enum", r"^(?P<mod>)enum\s+(?P<name>\w+)"), ("type_alias", r"^(?P<mod>)(?:union|scalar)\s+(?P<name>\w+)"), ("function", r"^(?P<mod>)(?:query|mutation|subscription)\s+(?P<name>\w+)")],
    "hcl": [("variable", r"^(?P<mod>)(?P<name>\w+(?:\s+\"[^\"\n]*\")*)\s*\{")],
    "dockerfile": [("variable", r"(?i)^(?P<mod>)from\s+(?P<name>\S+)(?:\s+as\s+\S+)?"), ("variable", r"(?i)^(?P<mod>)(?:arg|env|label)\s+(?P<name>[\w.-]+)")],
    "html": [], "css": [("variable", r"^(?P<mod>)(?P<name>[.#\w][^{}\n]*?)\s*\{")], "scss": [("variable", r"^(?P<mod>)(?P<name>[.#\w][^{}\n]*?)\s*\{")],
    "yaml": [("variable", r"^(?P<mod>)(?P<name>[\w.-]+):")], "toml": [("namespace", r"^(?P<mod>)\[+(?P<name>[\w.\"-]+)\]+")], "json": [], "xml": [], "markdown": [("function", r"^(?P<mod>)#{1,6}\s+(?P<name>[^\n]+)")],
}
PATTERNS["cpp"] = [("namespace", r"^(?P<mod>)namespace\s+(?P<name>[\w:]+)"), ("class", r"^[ \t]*(?P<mod>)(?:class|struct)\s+(?P<name>\w+)[^;\n]*\{"), *PATTERNS["c"][1:], ("type_alias", r"^[ \t]*(?P<mod>)using\s+(?P<name>\w+)\s*=")]
_COMPILED = {lang: [(k, re.compile(p, re.M)) for k, p in rules] for lang, rules in PATTERNS.items()}
_CONTAINERS = ("class", "interface", "enum", "namespace")
_JS_WORDS = frozenset("if for while switch catch function return constructor_ do else with".split()) - {"constructor_"}


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def stable_id(prefix: str, *parts) -> str:
    return f"{prefix}_{digest(':'.join(map(str, parts)))[:16]}"


def cut_signature(text: str) -> str:
    """First line without its body, at most 200 characters."""
    line = text.strip().split("\n", 1)[0]
    if "{" in line:
        line = line[: line.index("{")].rstrip()
    elif "=>" in line:
        line = line[: line.rindex("=>") + 2]
    return line[:200] + "..." if len(line) > 200 else line


def _doc(src: Source, line: int) -> str:
    """The comment block right above a line."""
    out: list[str] = []
    i = line - 2
    while i >= 0 and (s := src.lines[i].strip()) and (s.startswith(("//", "/*", "*", "#", "--")) or s.endswith("*/")):
        if not s.startswith("#!"):
            out.append(src.lines[i].strip())
        i -= 1
    return "\n".join(reversed(out))


def _flags(name: str, kind: str, mods: str, init: str, gen: str, language: str, exported: bool) -> dict[str, bool]:
    words = set(mods.split())
    js = language in JS_LIKE
    arrow = js and bool(re.match(r"\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)?|[\w$]+)\s*(?::[^=]+)?(?:=>|$)", init)) and "=>" in init
    callable_ = kind == "function"
    return dict(zip(FLAGS, (exported, "default" in words, "async" in words or " async" in init[:12], bool(gen), "static" in words, "abstract" in words, "readonly" in words or "const" in words and kind == "variable", False, arrow, language in ("jsx", "tsx") and callable_ and name[:1].isupper(), js and callable_ and bool(re.match("use[A-Z]", name)))))


def exported(name: str, mods: str, language: str) -> bool:
    """Whether a declaration is visible outside its file by its language's rule."""
    rule, words = EXPORTS.get(language, "none"), mods.split()
    if rule == "keyword":
        return any(w == {"rust": "pub"}.get(language, "export" if language in JS_LIKE else "public") or language == "rust" and w.startswith("pub") for w in words)
    return {"prefix": not name.startswith("_"), "convention": name[:1].isupper(), "all_public": "private" not in words and "static" not in words}.get(rule, False)


def _python(src: Source) -> list[dict] | None:
    try:
        tree = ast.parse(src.text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out: list[dict] = []

    def visit(node: ast.AST, owner: dict | None) -> None:
        for n in getattr(node, "body", []):
            name = kind = None
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                name, kind = n.name, "method" if owner and owner["kind"] == "class" else "function"
            elif isinstance(n, ast.ClassDef):
                name, kind = n.name, "class"
            elif isinstance(n, ast.Assign) and owner is None and isinstance(n.targets[0], ast.Name):
                name, kind = n.targets[0].id, "variable"
            elif isinstance(n, ast.AnnAssign) and owner is None and isinstance(n.target, ast.Name):
                name, kind = n.target.id, "variable"
            if name:
                first = min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))])
                own = {"name": name, "kind": kind, "start": n.lineno, "end": n.end_lineno, "first": first, "owner": owner, "mods": "async" if isinstance(n, ast.AsyncFunctionDef) else "", "doc": (ast.get_docstring(n) or "") if kind != "variable" else "", "gen": "*" if kind != "variable" and any(isinstance(x, ast.Yield | ast.YieldFrom) for x in ast.walk(n)) and kind != "class" else "", "init": ""}
                out.append(own)
                if kind == "class":
                    visit(n, own)

    visit(tree, None)
    return out


def _by_pattern(src: Source) -> list[dict]:
    out: list[dict] = []
    taken: set[int] = set()
    indented = src.language in ("ruby", "python", "yaml", "markdown", "toml")
    text = src.text if src.language in ("hcl", "dockerfile", "markdown", "yaml", "toml", "sql") else src.code
    for kind, rule in _COMPILED.get(src.language, []):
        for m in rule.finditer(text):
            at = m.start("name")
            line = src.line(at)
            if line in taken or any(a <= at < b for a, b in src.comments):
                continue
            name = m["name"].strip()
            if kind == "method" and src.language in JS_LIKE and name in _JS_WORDS:
                continue
            group = m.groupdict()
            init, real = group.get("init") or "", kind
            if kind == "variable" and src.language in JS_LIKE and re.match(r"\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:function\b|(?:\([^\n]*|[\w$]+\s*)=>|\([^\n)]*$)", init):
                real = "function"
            end = src.indent_end(line) if indented else line if src.language in ("dockerfile", "bash") and kind == "variable" else src.line(src.block_end(m.start("mod") if m["mod"] is not None else m.start()))
            taken.add(line)
            out.append({"name": name.replace('"', "") if src.language == "sql" else name, "kind": real, "start": line, "end": max(line, min(end, len(src.lines))), "first": line, "owner": None, "mods": m["mod"] or "", "doc": _doc(src, line), "gen": group.get("gen") or "", "init": init, "of": group.get("owner")})
    out.sort(key=lambda s: (s["start"], -s["end"]))
    stack: list[dict] = []
    keep = []
    for s in out:
        while stack and stack[-1]["end"] < s["start"]:
            stack.pop()
        inside = [x for x in stack if x["kind"] in _CONTAINERS]
        if s["kind"] == "method" and not inside and not s.get("of"):
            continue
        if s["kind"] == "variable" and any(x["kind"] in ("function", "method") for x in stack):
            continue
        s["owner"] = inside[-1] if inside else None
        if s["kind"] == "function" and s["owner"] and s["owner"]["kind"] in ("class", "interface") and src.language != "rust":
            s["kind"] = "method"
        keep.append(s)
        stack.append(s)
    for s in keep:
        if s.get("of"):
            s["owner"] = next((x for x in keep if x["name"] == s["of"] and x["kind"] in ("class", "type_alias", "interface")), None)
    return keep


def extract(src: Source, path: str) -> list[dict]:
    """Symbol rows of a file, by line."""
    found = (_python(src) if src.language == "python" else None) or _by_pattern(src)
    for s in found:
        chain, o = [s["name"]], s["owner"]
        while o:
            chain.insert(0, o["name"])
            o = o["owner"]
        s["qualified"] = ".".join(chain)
        s["id"] = stable_id("sym", path, s["kind"], s["qualified"], s["start"])
    rows = []
    for s in found:
        is_out = exported(s["name"], s["mods"], src.language)
        body = src.slice(s["start"], s["end"])
        rows.append({
            "symbol_id": s["id"], "name": s["name"], "qualified_name": s["qualified"], "kind": s["kind"], "signature": cut_signature(body), "start_line": s["start"], "end_line": s["end"], "doc_text": s["doc"], "symbol_hash": digest(body),
            "parent_symbol_id": s["owner"]["id"] if s["owner"] else "", "flags": _flags(s["name"], s["kind"], s["mods"], s["init"], s["gen"], src.language, is_out), "modifiers": [w for w in MODIFIERS if w in s["mods"].split()], "return_type": None, "parameter_types": None,
        })
    return sorted(rows, key=lambda r: (r["start_line"], r["end_line"], r["name"], r["symbol_id"]))
