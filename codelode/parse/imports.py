"""Imports of a file: found by patterns, classified by rules of the language, relative ones resolved to paths."""

from __future__ import annotations

import posixpath
import re

from codelode.parse.languages import JS_LIKE, LANGUAGES
from codelode.parse.source import Source

_Q = r"""["']([^"'\n]+)["']"""
#: Per language: pattern, and whether what it finds is internal in any case.
_RULES: dict[str, list[tuple[str, bool]]] = {
    **{lang: [(rf"^\s*(?:import|export)\b[^;'\"]*?\bfrom\s*{_Q}", False), (rf"^\s*import\s*{_Q}", False), (rf"\b(?:require|import)\s*\(\s*{_Q}\s*\)", False)] for lang in JS_LIKE},
    "python": [(r"^\s*from\s+(\.*[\w.]*)\s+import\b", False)],
    "rust": [(r"^\s*(?:pub\s+)?use\s+([\w:]+)", False), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;", True)],
    "java": [(r"^\s*import\s+(?:static\s+)?([\w.]+)(?:\.\*)?\s*;", False)],
    "kotlin": [(r"^\s*import\s+([\w.]+?)(?:\.\*)?(?:\s+as\s+\w+)?\s*$", False)],
    "c": [(r"^\s*#\s*include\s*<([^>\n]+)>", False), (r'^\s*#\s*include\s*"([^"\n]+)"', True)],
    "csharp": [(r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", False)],
    "swift": [(r"^\s*(?:@\w+\s+)?import\s+(?:class\s+|struct\s+|func\s+|enum\s+|protocol\s+)?([\w.]+)", False)],
    "ruby": [(rf"^\s*require\s*\(?\s*{_Q}", False), (rf"^\s*(?:require_relative|load)\s*\(?\s*{_Q}", True)],
    "php": [(r"^\s*use\s+(?:function\s+|const\s+)?([\w\\]+)", False), (rf"\b(?:include|require)(?:_once)?\s*\(?\s*{_Q}", True)],
    "bash": [(r"^\s*(?:source|\.)\s+[\"']?([^\s\"';]+)", False)],
    "hcl": [(r'^\s*source\s*=\s*"([^"\n$]+)"', False)],
    "dockerfile": [(r"(?i)^\s*from\s+(?:--\S+\s+)?([^\s:@]+)", False)],
    "css": [(r"@import\s+(?:url\()?\s*[\"']?([^\"');\s]+)", False)],
    "scss": [(rf"@(?:import|use|forward)\s+{_Q}", False)],
    "html": [(r"<script\b[^>]*\bsrc\s*=\s*[\"']([^\"']+)", False), (r"<link\b(?=[^>]*\brel\s*=\s*[\"']?stylesheet)[^>]*\bhref\s*=\s*[\"']([^\"']+)", False)],
    "markdown": [(r"(?<!!)\[[^\]\n]*\]\(([^)\s#]+)", False)],
}
_RULES["cpp"] = _RULES["c"]
_COMPILED = {lang: [(re.compile(p, re.M), own) for p, own in rules] for lang, rules in _RULES.items()}


def _specifiers(src: Source) -> list[tuple[int, str, bool]]:
    found = []
    for rule, own in _COMPILED.get(src.language, []):
        for m in rule.finditer(src.text):
            if not any(a <= m.start(1) < b for a, b in src.comments) or src.language in ("markdown", "html"):
                found.append((m.start(1), m[1], own))
    if src.language == "python":
        for m in re.finditer(r"^[ \t]*import\s+([^\n#;(]+)", src.code, re.M):
            at = m.start(1)
            for part in m[1].split(","):
                if name := part.split(" as ")[0].strip():
                    found.append((at, name, False))
                at += len(part) + 1
        relative = [(m.start(), m[1], m[2]) for m in re.finditer(r"^[ \t]*from\s+(\.+)\s+import\s+([\w, ]+)", src.code, re.M)]
        for at, dots, names in relative:  # from . import a: the module is a sibling
            found = [f for f in found if not (f[1] == dots and src.line(f[0]) == src.line(at))] + [(at, dots + n.split(" as ")[0].strip(), False) for n in names.split(",") if n.strip()]
    if src.language == "go":
        for m in re.finditer(r'^\s*import\s+(?:[\w.]+\s+)?"([^"\n]+)"|^\s*import\s*\(([^)]*)\)', src.text, re.M):
            if m[1]:
                found.append((m.start(1), m[1], False))
            else:
                found += [(m.start(2) + x.start(1), x[1], False) for x in re.finditer(r'"([^"\n]+)"', m[2])]
    return sorted(found, key=lambda f: f[0])


def classify(name: str, language: str, forced: bool = False, local_mods: frozenset[str] = frozenset()) -> str:
    """STDLIB, INTERNAL or EXTERNAL."""
    lang = LANGUAGES[language]
    if forced:
        return "INTERNAL"
    if name in lang.stdlib or language == "python" and name[:1] != "." and name.split(".")[0] in lang.stdlib or name.startswith(lang.stdlib_prefixes):
        return "STDLIB"
    if name.startswith(lang.internal_prefixes) or language == "rust" and name.split("::")[0] in local_mods:
        return "INTERNAL"
    return "EXTERNAL"


def rust_module_dir(path: str) -> str:
    """The directory that a Rust file's modules are in."""
    folder, base = posixpath.split(path)
    stem = base.removesuffix(".rs")
    if stem == "mod" or stem in ("lib", "main") and posixpath.basename(folder) == "src":
        return folder or "."
    return posixpath.normpath(posixpath.join(folder, stem))


def relative_target(name: str, path: str, language: str) -> str:
    """The path that an internal import means, without looking whether it is there; empty if it means none."""
    folder = posixpath.dirname(path) or "."
    join = lambda a, b: posixpath.normpath(posixpath.join(a, b))
    if language in JS_LIKE or language in ("ruby", "bash"):
        return join(folder, name) if name.startswith(("./", "../")) else ""
    if language in ("c", "cpp"):
        return join(folder, name)
    if language == "python":
        rest = name.lstrip(".")
        if rest == name:
            return ""
        for _ in range(len(name) - len(rest) - 1):
            folder = posixpath.dirname(folder) or "."
        return join(folder, rest.replace(".", "/")) if rest else folder
    if language == "rust":
        if name.startswith("crate::"):
            return "src/" + name[7:].replace("::", "/")
        at, rest = rust_module_dir(path), name.removeprefix("self::")
        while rest.startswith("super::"):
            at, rest = posixpath.dirname(at) or ".", rest[7:]
        return join(at, rest.replace("::", "/")) if rest else at
    return ""


def extract(src: Source, path: str) -> list[dict]:
    """Import rows, one a specifier, in order."""
    mods = frozenset(re.findall(r"^\s*(?:pub\s+)?mod\s+(\w+)\s*;", src.code, re.M)) if src.language == "rust" else frozenset()
    out, seen = [], set()
    for _, name, forced in _specifiers(src):
        if src.language == "ruby" and forced and not name.startswith("."):
            name = "./" + name
        kind = classify(name, src.language, forced, mods)
        target = relative_target(name, path, src.language) if kind == "INTERNAL" else ""
        if name and (kind, target or name) not in seen:
            seen.add((kind, target or name))
            out.append({"source_symbol_id": "", "source_file_path": path, "target_file_path": target, "import_name": name, "import_type": kind, "package_name": name, "package_version": ""})
    return out
