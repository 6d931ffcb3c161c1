"""Script parsing (JavaScript, TypeScript): a scanner that knows strings, comments and regular
expressions, and one walk over its tokens. It runs over Arrow batches of contents.

It is no grammar: calls within template strings, calls with type arguments and members that
are computed are not seen, and markup within scripts is read as if it were code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PARSED = (
    "imports array<struct<module: string, names: array<string>, alias: string, line: int, kind: string>>, "
    "exports array<struct<name: string, line: int, kind: string, confidence: double>>, "
    "symbols array<struct<qualified: string, name: string, kind: string, start_line: int, end_line: int, is_test: boolean, confidence: double>>, "
    "calls array<struct<callee: string, scope: string, line: int>>"
)
_SCAN = re.compile(
    r"(?P<gap>\s++|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?)"
    r"|(?P<text>\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)*+'?|`(?:[^`\\]|\\.)*+`?)"
    r"|(?P<word>[\w$#]++)|(?P<sign>=>|\.\.\.|[^\w\s])",
    re.S,
)
_PATTERN = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_NO_CALL = frozenset("if for while switch catch function return typeof await yield new super import delete void in of do else case throw with async".split())
# Where a search forward gives up: so broken scripts take no more than a look at each token.
_WORDS = frozenset("import export const let var class function".split())
_HEAD_ENDS = _WORDS | {"{", ";", "}"}
_IMPORT_ENDS = _WORDS | {";", "="}
_NAME_ENDS = _WORDS | {"=", ";", ","}
# Calls that open a test block, and what is believed of it and of a symbol.
TEST_CALLS = frozenset(("describe", "it", "test", "expect"))
TEST_BLOCK_CONFIDENCE, SYMBOL_CONFIDENCE = 0.7, 0.9


class _Script:
    """The tokens of a script: kind (text, word, sign), value and line, and which bracket
    closes which."""

    def __init__(self, source: str) -> None:
        self.kind: list[str] = []
        self.value: list[str] = []
        self.line: list[int] = []
        at, line = 0, 1
        while at < len(source):
            m = _SCAN.match(source, at)
            if m["sign"] == "/" and self._operand_may_follow():
                m = _PATTERN.match(source, at) or m
            kind = m.lastgroup or "text"
            if kind != "gap":
                self.kind.append(kind)
                self.value.append(m[0])
                self.line.append(line)
            line += m[0].count("\n")
            at = m.end()
        self.close: dict[int, int] = {}
        self.inside: list[int] = []  # the innermost bracket that is open before each token
        waiting: list[int] = []
        for i, v in enumerate(self.value):
            self.inside.append(waiting[-1] if waiting else -1)
            if self.kind[i] != "sign":
                continue
            if v in _OPEN:
                waiting.append(i)
            elif v in _CLOSE and waiting and _OPEN[self.value[waiting[-1]]] == v:
                self.close[waiting.pop()] = i
        self.n = len(self.value)

    def _operand_may_follow(self) -> bool:
        return not self.kind or (self.kind[-1] == "sign" and self.value[-1] not in (")", "]", "}")) or self.value[-1] in ("return", "typeof", "case")

    def at(self, i: int) -> str:
        """The value of a word or sign; nothing for a string or beyond the ends."""
        return self.value[i] if 0 <= i < self.n and self.kind[i] != "text" else ""

    def word(self, i: int) -> str | None:
        return self.value[i] if 0 <= i < self.n and self.kind[i] == "word" else None

    def string(self, i: int) -> str | None:
        return self.value[i].strip("\"'`") if 0 <= i < self.n and self.kind[i] == "text" and self.value[i][0] != "/" else None

    def listed(self, start: int) -> list[str]:
        """The names in braces, each before its `as`."""
        out, fresh = [], True
        for i in range(start + 1, self.close.get(start, start)):
            if self.at(i) == ",":
                fresh = True
            elif fresh and self.word(i) and not (self.at(i) == "type" and self.word(i + 1) not in (None, "as")):
                out.append(self.value[i])
                fresh = False
        return out

    def body_end(self, i: int) -> int:
        """The line where a body that follows token i ends."""
        i += self.at(i) == "function"
        while i < self.n and self.at(i) not in _HEAD_ENDS:
            i = self.close.get(i, i) + 1
        if self.at(i) == "{":
            i = self.close.get(i, self.n - 1)
        return self.line[min(i, self.n - 1)]


def _arrow(s: _Script, i: int) -> int | None:
    """Where the arrow of a function that begins at token i is."""
    if s.at(i) == "(" and i in s.close:
        i = s.close[i] + 1
        if s.at(i) == ":":  # a result type
            while i < s.n and s.at(i) != "=>" and s.at(i) not in _HEAD_ENDS:
                i = s.close.get(i, i) + 1
        return i if s.at(i) == "=>" else None
    return i + 1 if s.word(i) and s.at(i + 1) == "=>" else None


def parse_script(source: str | None) -> dict:
    """Imports, exports, symbols and calls of a script."""
    out: dict = {"imports": [], "exports": [], "symbols": [], "calls": []}
    s = _Script(source or "")
    seen: set[tuple[str, int]] = set()
    classes: list[tuple[str, int, int]] = []  # name, first and last token of the body

    def symbol(name: str, kind: str, i: int, end: int) -> None:
        qualified = ".".join([*(c[0] for c in classes), name])
        if (qualified, s.line[i]) not in seen:
            seen.add((qualified, s.line[i]))
            is_test = name in TEST_CALLS - {"expect"} or name.startswith("test")
            out["symbols"].append({"qualified": qualified, "name": name, "kind": kind, "start_line": s.line[i], "end_line": end, "is_test": is_test, "confidence": SYMBOL_CONFIDENCE})

    def export(name: str, i: int, kind: str = "export", confidence: float = 1.0) -> None:
        out["exports"].append({"name": name, "line": s.line[i], "kind": kind, "confidence": confidence})

    def begins(i: int) -> bool:
        """Whether a statement begins at token i."""
        before = s.at(i - 1)
        return i == 0 or before in (";", "{", "}", ")", "export", "default", "async") or (s.kind[i - 1] != "sign" and s.line[i - 1] < s.line[i])

    i = 0
    while i < s.n:
        while classes and i > classes[-1][2]:
            classes.pop()
        word = s.word(i)
        if word is None or s.at(i - 1) == ".":
            i += 1
            continue
        if word == "import" and s.at(i + 1) not in ("(", "."):
            j, names, star, default = i + 1, [], None, None
            while j < s.n and s.string(j) is None and s.at(j) not in _IMPORT_ENDS:
                if s.at(j) == "{":
                    if j not in s.close:
                        break
                    names = s.listed(j)
                    j = s.close.get(j, j)
                elif s.at(j) == "*" and s.at(j + 1) == "as":
                    star = s.word(j + 2)
                elif j == i + 1 and s.word(j) and not (s.at(j) == "type" and s.at(j + 1) != "from"):
                    default = s.word(j)
                j += 1
            if s.string(j) is not None:
                alias = default if s.at(i + 2) == "from" else None
                out["imports"].append({"module": s.string(j), "names": names or [x for x in (star or default,) if x], "alias": alias, "line": s.line[i], "kind": "es_import"})
                i = j + 1
                continue
        elif word == "export":
            j = i + 1
            default = s.at(j) == "default"
            j += default
            while s.at(j) in ("async", "abstract", "declare"):
                j += 1
            if s.at(j) in ("function", "class", "const", "let", "var"):
                j += 1 + (s.at(j + 1) == "*")
                name = s.word(j) if s.at(j) != "extends" else None
                if name or default:
                    export(name or "default", i)
            elif s.at(j) == "{" and not default:
                for name in s.listed(j):
                    export(name, i)
            elif default:
                export(s.word(j) if s.word(j) and s.at(j + 1) not in ("(", "=>", ".") else "default", i)
        elif word in ("const", "let", "var") and s.word(i + 1):
            j = i + 2
            while j < s.n and s.at(j) not in _NAME_ENDS and s.line[j] == s.line[i]:
                j = s.close.get(j, j) + 1  # over a type
            if s.at(j) == "=":
                if s.at(j + 1) == "require" and s.string(j + 3) is not None:
                    out["imports"].append({"module": s.string(j + 3), "names": [], "alias": s.word(i + 1), "line": s.line[i], "kind": "require"})
                j += 1 + (s.at(j + 1) == "async" and s.at(j + 2) != "=>")
                arrow = _arrow(s, j)
                if s.at(j) == "function" or arrow is not None:
                    symbol(s.value[i + 1], "function", i, s.body_end(j if arrow is None else arrow))
        elif word == "function" and begins(i):
            j = i + 1 + (s.at(i + 1) == "*")
            if s.word(j):
                symbol(s.value[j], "function", i, s.body_end(j))
                i = j + 1
                continue
        elif word == "class" and begins(i) and s.word(i + 1) not in (None, "extends"):
            j = i + 2
            while j < s.n and s.at(j) not in _HEAD_ENDS:
                j += 1
            symbol(s.value[i + 1], "class", i, s.body_end(j))
            if s.at(j) == "{":
                classes.append((s.value[i + 1], j, s.close.get(j, s.n)))
                i = j + 1
                continue
        elif s.at(i + 1) == "(" and (word not in _NO_CALL or (classes and s.inside[i] == classes[-1][1])):
            end = s.close.get(i + 1, s.n)
            body = end + 1
            if s.at(body) == ":":
                while body < s.n and s.at(body) not in _HEAD_ENDS and s.at(body) != "(":
                    body += 1
            if classes and s.inside[i] == classes[-1][1] and s.at(body) == "{":
                symbol(word, "method", i, s.body_end(body))
            elif s.at(i - 1) not in ("function", "new"):
                _call(out, s, i, i, classes)
                if word in TEST_CALLS:
                    export(word, i, "test_block", TEST_BLOCK_CONFIDENCE)
        if s.at(i + 1) == ".":
            j = i
            while s.at(j + 1) in (".", "?") and s.word(j + 2):
                j += 2
            if s.at(j + 1) == "(" and s.at(i - 1) != "new":
                _call(out, s, i, j, classes)
        i += 1
    return out


def _call(out: dict, s: _Script, first: int, last: int, classes: list) -> None:
    callee = "".join(s.value[first : last + 1])
    out["calls"].append({"callee": callee, "scope": ".".join(c[0] for c in classes) or None, "line": s.line[first]})


def script_parsed(content: Column) -> Column:
    """imports, exports, symbols and calls of a column of scripts."""

    @F.pandas_udf(PARSED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([parse_script(t) for t in texts], columns=["imports", "exports", "symbols", "calls"])

    return run(content)
