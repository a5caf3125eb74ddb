"""Reading source text: blanking comments and strings, finding block ends, line numbers."""

from __future__ import annotations

import re
from bisect import bisect_right

_HASH = ("python", "ruby", "bash", "hcl", "dockerfile", "yaml", "toml")
_COMMON = r"/\*.*?(?:\*/|\Z)|//[^\n]*"
_STRINGS = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
_RULES = {
    "js": re.compile(rf"(?P<c>{_COMMON})|(?P<s>`(?:\\.|[^`\\])*`|{_STRINGS})", re.S),
    "python": re.compile(rf"(?P<c>#[^\n]*)|(?P<s>\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|{_STRINGS})", re.S),
    "hash": re.compile(rf"(?P<c>#[^\n]*)|(?P<s>{_STRINGS})", re.S),
    "sql": re.compile(rf"(?P<c>/\*.*?(?:\*/|\Z)|--[^\n]*)|(?P<s>{_STRINGS})", re.S),
    "php": re.compile(rf"(?P<c>{_COMMON}|#(?!\[)[^\n]*)|(?P<s>{_STRINGS})", re.S),
    "rust": re.compile(rf"(?P<c>{_COMMON})|(?P<s>\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])')", re.S),
    "go": re.compile(rf"(?P<c>{_COMMON})|(?P<s>`[^`]*`|{_STRINGS})", re.S),
}


class Source:
    """A text with positions as (line, column), both from 1."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        rule = _RULES.get(language) or (_RULES["python"] if language == "python" else _RULES["hash"] if language in _HASH else _RULES["js"])
        self.comments: list[tuple[int, int]] = []

        def blank(m: re.Match) -> str:
            if m["c"] is not None:
                self.comments.append(m.span())
                return re.sub(r"[^\n]", " ", m[0])
            return m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1] if len(m[0]) > 1 else m[0]

        #: The text with comments and the insides of strings as blanks.
        self.code = rule.sub(blank, text)
        self.lines = text.split("\n")
        if self.lines and self.lines[-1] == "":
            self.lines.pop()

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def column(self, at: int) -> int:
        return at - self.starts[self.line(at) - 1] + 1

    def slice(self, first: int, last: int) -> str:
        """Lines first to last, from 1, both included."""
        return "\n".join(self.lines[max(first, 1) - 1 : last])

    def block_end(self, at: int, stop: str = ";") -> int:
        """Where the braces that open at or after a position close; without any before `stop` or a blank line, the statement's end."""
        depth, inside, i, code = 0, 0, at, self.code
        for m in re.compile(rf"[{{}}()\[\]{re.escape(stop)}]|\n[ \t]*\n").finditer(code, at):
            i = m.end()
            if m[0] in "([":
                inside += 1
            elif m[0] in ")]":
                inside = max(inside - 1, 0)
            elif inside:  # braces of parameters, arguments and nested literals
                continue
            elif m[0] == "{":
                depth += 1
            elif m[0] == "}":
                depth -= 1
                if depth <= 0:
                    return m.start() if depth == 0 else max(at, m.start() - 1)
            elif depth == 0:
                return m.start() if m[0] == stop else max(at, m.start() - 1)
        return max(at, min(i, len(code) - 1)) if depth == 0 and i > at else max(at, len(code.rstrip()) - 1)

    def indent_end(self, line: int) -> int:
        """Last line of the block that a line of a language with indentation opens."""
        own = len(self.lines[line - 1]) - len(self.lines[line - 1].lstrip())
        last = line
        for i in range(line, len(self.lines)):
            s = self.lines[i]
            if s.strip():
                if len(s) - len(s.lstrip()) <= own:
                    if s.strip() == "end" or s.strip().startswith(("end ", ")", "]", "}")):
                        last = i + 1
                    break
                last = i + 1
        return last

    def nesting(self) -> list[int]:
        """Depth of braces (or of indentation) at the start of each line."""
        if self.language in ("python", "ruby", "yaml"):
            out, stack = [], [0]
            for s in self.code.split("\n")[: len(self.lines)]:
                if s.strip():
                    own = len(s) - len(s.lstrip())
                    while stack[-1] > own:
                        stack.pop()
                    if own > stack[-1]:
                        stack.append(own)
                out.append(len(stack) - 1)
            return out
        out, depth = [], 0
        for s in self.code.split("\n")[: len(self.lines)]:
            out.append(max(depth, 0))
            depth += s.count("{") - s.count("}")
        return out
