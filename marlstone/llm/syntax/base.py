"""What the checkers share: reading tokens, remembering line shapes, recovering from errors."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from functools import wraps
from typing import NamedTuple

#: Line shapes and tokens remembered per language in one process; beyond it the memory starts anew.
REMEMBER = 100_000
#: Blocks and brackets within one another beyond which a text is given up, with the cause "nesting".
DEPTH = 2_000
#: Calls that such a text needs at most; calls between Python functions take no room on the C stack.
CALLS = 200_000


def deep(f: Callable) -> Callable:
    """``f`` with room for deeply nested texts."""

    @wraps(f)
    def call(*args):
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(before, CALLS))
        try:
            return f(*args)
        finally:
            sys.setrecursionlimit(before)

    return call


class Problem(NamedTuple):
    line: int
    cause: str
    message: str


class Wrong(Exception):
    def __init__(self, message: str, cause: str = "unexpected token") -> None:
        self.message, self.cause = message, cause


CONFLICT = r"(?<![^\n])(?:<{7}|={7}|>{7}|\|{7})(?![<=>|])[^\n]*"
#: Numbers of languages without ranges, where a dot belongs to the digits before it.
DOTTED = r"(?:0[xX][\w.]*[pP][+-]?\w+|0[xXbBoO]\w*|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?\w*)"
NUMBER = r"(?:0[xXbBoO][\w]+|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?\d[\d_]*)?\w*|\.\d[\d_]*(?:[eE][+-]?\d+)?\w*)"
NAME = r"[^\W\d][\w$]*"


class Canon(dict):
    """Token to its class, computed once per token."""

    def __init__(self, keywords: frozenset[str], quotes: str, comments: tuple[str, ...], number: str = "") -> None:
        super().__init__()
        self.keywords, self.quotes, self.comments = keywords, quotes, comments
        self.number = re.compile(number) if number else None

    def __missing__(self, tok: str) -> str:
        if len(self) > REMEMBER:
            self.clear()
        v = self[tok] = self.classify(tok)
        return v

    def classify(self, tok: str) -> str:
        ch = tok[0]
        if ch == "\n":
            return "\n"
        if tok.startswith(self.comments):
            return "\n" if "\n" in tok else ""
        if ch.isalpha() or ch == "_" or ch == "$":
            if tok[-1] in self.quotes:
                return "s" if tok[-1] in self.quotes else "E"
            return tok if tok in self.keywords else "a"
        if ch.isdigit() or ch == "." and len(tok) > 1 and tok[1].isdigit():
            return "0" if self.number is None or self.number.fullmatch(tok) else "X"
        if ch in self.quotes:
            return "s" if len(tok) > 1 and tok[-1] == ch else "E"
        if len(tok) >= 7 and ch in "<=>|" and tok[:7] == ch * 7:
            return "C"
        return tok


class Parser:
    """Tokens ``t`` by line; ``nl`` tells whether ``t`` is the first of its line."""

    token: re.Pattern
    canon: Canon
    #: Shapes that are whole statements, by context; shapes that are heads of blocks, with their kind.
    simple: dict[str, set[str]]
    heads: dict[str, dict[str, str]]
    sync: frozenset[str] = frozenset()

    def __init__(self, text: str) -> None:
        self.text = text[1:] if text.startswith("﻿") else text
        found = self.token.findall(self.text)
        self.lines = [x.strip() for x in " ".join(map(self.canon.__getitem__, found)).split("\n")]
        self.n = len(self.lines)
        self.i, self.toks, self.j, self.t, self.nl = -1, [], 0, "", True
        self.found: list[Problem] = []
        self.depth = 0
        for memory in (*self.simple.values(), *self.heads.values()):
            if len(memory) > REMEMBER:
                memory.clear()
        self.seek(0)

    # reading
    def seek(self, i: int) -> None:
        lines, n = self.lines, self.n
        while i < n and not lines[i]:
            i += 1
        self.i, self.j, self.nl = i, 0, True
        if i < n:
            self.toks = lines[i].split()
            self.t = self.toks[0]
        else:
            self.toks, self.t = [], ""

    def adv(self) -> str:
        t = self.t
        self.j += 1
        if self.j < len(self.toks):
            self.t, self.nl = self.toks[self.j], False
        else:
            self.seek(self.i + 1)
        return t

    def peek(self, k: int = 1) -> str:
        """The k-th token from here, over line ends."""
        j = self.j + k
        if j < len(self.toks):
            return self.toks[j]
        j -= len(self.toks)
        i = self.i + 1
        while i < self.n:
            if self.lines[i]:
                more = self.lines[i].split()
                if j < len(more):
                    return more[j]
                j -= len(more)
            i += 1
        return ""

    def mark(self) -> tuple:
        return self.i, self.toks, self.j, self.t, self.nl

    def back(self, m: tuple) -> None:
        self.i, self.toks, self.j, self.t, self.nl = m

    def wrong(self, wanted: str = "") -> Wrong:
        t = self.t
        if t == "":
            return Wrong("end of file" + (f", expected {wanted}" if wanted else ""), "truncated")
        if t == "C":
            return Wrong("conflict marker", "merge conflict")
        if t == "E":
            return Wrong("string without end", "unterminated string")
        if t == "X":
            return Wrong("malformed literal", "bad literal")
        return Wrong(f"unexpected {t!r}" + (f", expected {wanted}" if wanted else ""))

    def need(self, tok: str) -> None:
        if self.t != tok:
            raise self.wrong(repr(tok))
        self.adv()

    def accept(self, tok: str) -> bool:
        if self.t == tok:
            self.adv()
            return True
        return False

    def name(self) -> None:
        if self.t != "a":
            raise self.wrong("a name")
        self.adv()

    # errors
    def problem(self, at: int, w: Wrong) -> None:
        self.found.append(Problem(at, w.cause, w.message))

    def balanced(self) -> None:
        """Skip a bracketed run of any tokens, from its opening bracket on."""
        stack = [{"(": ")", "[": "]", "{": "}"}[self.adv()]]
        while stack:
            t = self.t
            if t in ("", "C", "E"):
                raise self.wrong(repr(stack[-1]))
            self.adv()
            if t in "([{":
                stack.append({"(": ")", "[": "]", "{": "}"}[t])
            elif t in ")]}" and t != stack.pop():
                raise Wrong(f"unexpected {t!r}")

    def panic(self, line: int) -> None:
        """Skip to where a statement can begin: past a semicolon, or a line that begins like one."""
        if self.i == line and self.t not in ("", "}"):
            self.adv()
        while self.t != "":
            if self.t == ";":
                self.adv()
                return
            if self.nl and (self.t in self.sync or self.t == "}"):
                return
            self.adv()

    def statements(self, ctx: str, end: str) -> None:
        """Statements up to ``end``, which isn't consumed."""
        simple, heads, lines, n = self.simple[ctx], self.heads[ctx], self.lines, self.n
        self.depth += 1
        if self.depth > DEPTH:
            raise Wrong("nesting too deep", "nesting")
        while True:
            if self.j == 0:
                i = self.i
                while i < n and (lines[i] in simple or not lines[i]):
                    i += 1
                if i != self.i:
                    self.seek(i)
            if self.t == end or self.t == "":
                break
            at, first, seen = self.i, self.j == 0, len(self.found)
            try:
                if first and (kind := heads.get(lines[at])):
                    self.seek(at + 1)
                    self.body(kind)
                else:
                    self.opened = -1
                    kind = self.statement(ctx)
                    if first and self.j == 0 and self.i > at and kind == "closed" and len(self.found) == seen and not any(lines[at + 1:self.i]):
                        simple.add(lines[at])
            except Wrong as w:
                self.problem(min(self.i, n - 1) if self.t else n - 1, w)
                depth = self.depth
                self.panic(at)
                self.depth = depth
                if self.t == "}" and end != "}":
                    break
        self.depth -= 1

    def statement(self, ctx: str) -> str:
        raise NotImplementedError

    def body(self, kind: str) -> None:
        raise NotImplementedError

    def head(self, ctx: str, at: int, first: bool, kind: str) -> None:
        """Remember the line as a head if its last token is the brace that ``t`` is."""
        if first and self.i == at and self.t == "{" and self.j == len(self.toks) - 1:
            self.heads[ctx][self.lines[at]] = kind

    def program(self) -> None:
        self.statements("top", "")
        while self.t != "":
            self.problem(self.i, self.wrong())
            self.adv()
            self.statements("top", "")

    @deep
    def run(self) -> list[Problem]:
        try:
            self.program()
        except Wrong as w:
            self.problem(min(self.i, self.n - 1), w)
        except RecursionError:
            self.problem(min(self.i, self.n - 1), Wrong("nesting too deep", "nesting"))
        return self.numbered() if self.found else []

    def numbered(self) -> list[Problem]:
        """Problems with the lines of the text in place of those of the shapes."""
        at = [1]
        for m in self.token.finditer(self.text):
            tok = m.group(1)
            if self.canon[tok] == "\n" or "\n" in self.canon[tok]:
                at.append(self.text.count("\n", 0, m.end()) + 1)
        return [Problem(at[min(p.line, len(at) - 1)], p.cause, p.message) for p in self.found]


def tokens(*parts: str) -> re.Pattern:
    return re.compile(r"[ \t\r\f\v ]*(" + "|".join(parts) + r"|\n|[^\s])")
