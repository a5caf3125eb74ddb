"""Search predicates: modes, LIKE escaping, path globs and file patterns, compiled on the driver to column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("insensitive", "sensitive", "regex")
MAX_QUERY, MAX_PATTERNS, MAX_PATTERN = 1000, 10, 500


class BadRequest(ValueError):
    """A parameter that the API rejects."""


def search_mode(name: str | None) -> str:
    """A search mode by its name; none means insensitive."""
    if not name:
        return "insensitive"
    if name not in MODES:
        raise BadRequest(f"invalid search_mode {name!r}: must be one of {', '.join(MODES)}")
    return name


def escape_like(text: str) -> str:
    """Text that LIKE takes literally, with backslash as escape."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def checked_regex(pattern: str) -> str:
    """A pattern within the dialect that Python, Java and RE2 share."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise BadRequest(f"invalid regex: {e}") from None
    if re.search(r"\(\?[=!<]|\\[1-9]|[*+?}]\+", pattern):
        raise BadRequest("invalid regex: look-around, back references and possessive quantifiers are not supported")
    return pattern


def text_matches(column: Column, query: str, mode: str = "insensitive", literal: bool = True) -> Column:
    """Whether a column holds the query. literal=False lets % and _ in it act as LIKE wildcards (names and messages do)."""
    mode = search_mode(mode)
    if mode == "regex":
        return column.rlike(checked_regex(query))
    if literal or not re.search(r"[%_\\]", query):
        return F.contains(F.lower(column), F.lower(F.lit(query))) if mode == "insensitive" else F.contains(column, F.lit(query))
    pattern = "%" + re.sub(r"\\(?![%_\\])", r"\\\\", query) + "%"
    return column.ilike(pattern) if mode == "insensitive" else column.like(pattern)


def match_count(column: Column, query: str, mode: str = "insensitive") -> Column:
    """Non-overlapping occurrences of the query in a column, as a long; 0 for an empty query or a bad pattern."""
    mode = search_mode(mode)
    if not query:
        return F.lit(0).cast("long")
    if mode == "regex":
        try:
            return F.regexp_count(column, F.lit(checked_regex(query))).cast("long")
        except BadRequest:
            return F.lit(0).cast("long")
    text, needle = (F.lower(column), F.lower(F.lit(query))) if mode == "insensitive" else (column, F.lit(query))
    return F.floor((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("long")


_WILD = re.compile(r"(?P<deep>\*\*/?)|(?P<star>\*)|(?P<one>\?)|(?P<text>[^*?]+)")


def quote(text: str) -> str:
    """Text that a regex takes literally."""
    return re.sub(r"([\\.+*?^${}()|\[\]])", r"\\\1", text)


def glob_to_regex(glob: str) -> str:
    """A path glob as a regex to be searched for.

    A glob without wildcards is a directory prefix. ** crosses directories, * stays in one, ? is any one character; a glob that
    starts with a plain character starts at the path's start, and one that does not end in a wildcard of all ends at its end.
    """
    glob = glob.strip()
    if not glob:
        raise BadRequest("empty glob pattern")
    if ".." in glob:
        raise BadRequest("glob must not contain '..'")
    if glob.removesuffix("/") == "**":
        return "."
    if not set(glob) & set("*?[{"):
        return f"^{quote(glob.removesuffix('/'))}/"
    out = "" if glob[0] in "*?[{" else "^"
    for m in _WILD.finditer(glob):
        if m["deep"]:
            out += "(^|/)" if m.start() == 0 else ".*"
        else:
            out += {"star": "[^/]*", "one": "."}.get(m.lastgroup) or quote(m["text"])
    return out if out.endswith((".*", "/")) else out + "$"


def path_patterns(raw: str | None, name: str = "include_dir") -> list[str]:
    """The patterns of a comma-separated filter, checked."""
    parts = raw.split(",") if raw else []
    if len(parts) > MAX_PATTERNS:
        raise BadRequest(f"{name} exceeds maximum of {MAX_PATTERNS} patterns")
    out = [p.strip() for p in parts if p.strip()]
    for p in out:
        if ".." in p:
            raise BadRequest(f"{name} pattern must not contain '..'")
        if p.startswith("/"):
            raise BadRequest(f"{name} pattern must be a relative path")
        if len(p.encode()) > MAX_PATTERN:
            raise BadRequest(f"{name} pattern exceeds maximum length of {MAX_PATTERN}")
    return out


def path_allowed(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Whether a path fits one of the include globs (any, if there are none) and none of the exclude globs."""
    tests = [reduce(or_, [path.rlike(glob_to_regex(g)) for g in include])] if include else []
    tests += [~path.rlike(glob_to_regex(g)) for g in exclude]
    return reduce(and_, tests) if tests else F.lit(True)


def _segment(pattern: str) -> str:
    """A shell pattern for one path segment as a regex."""
    return re.sub(r"\*|\?|[^*?]+", lambda m: {"*": "[^/]*", "?": "[^/]"}.get(m[0]) or quote(m[0]), pattern)


def file_pattern(pattern: str) -> str:
    """A file pattern (name pattern, or **/dir/** with an optional name pattern behind) as a regex for whole paths."""
    if "**/" not in pattern:
        return f"^(?:.*/)?{_segment(pattern)}$"
    folder, _, name = pattern.removeprefix("**/").partition("/**")
    folders = "/".join(_segment(s) for s in folder.split("/"))
    name = name.removeprefix("/")
    return f"^(?:.*/)?{folders}/(?:.*/)?{_segment(name) if name else '[^/]*'}$"


def any_file_pattern(patterns: list[str]) -> str | None:
    """One regex for several file patterns; None if there are none."""
    return "|".join(f"(?:{file_pattern(p)})" for p in patterns) or None


def page(limit: int | None, offset: int | None, default: int, most: int) -> tuple[int, int]:
    """Limit and offset within bounds: a missing or bad limit is the default, a large one the most allowed."""
    limit = default if limit is None or limit < 1 else min(limit, most)
    return limit, max(offset or 0, 0)


def has_bytes(column: Column) -> Column:
    """Whether a binary column (a credential, say) is there and not empty, without reading what it holds into a result."""
    return F.coalesce(F.octet_length(column) > 0, F.lit(False))
