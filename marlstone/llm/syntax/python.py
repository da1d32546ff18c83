"""Python 3."""

from __future__ import annotations

import re
import unicodedata

from marlstone.llm.syntax.base import CONFLICT, REMEMBER, Canon, Problem, Wrong, deep

# Keywords.
KEYWORDS = frozenset("""False None True and as assert async await break class continue def del elif else except finally for from global if
import in is lambda nonlocal not or pass raise return try while with yield""".split())
SOFT = frozenset(("match", "case", "type", "_"))
NAMES = SOFT | {"a"}
# Limits of the language's own parser.
MOST_BRACKETS, MOST_INDENTS = 200, 100
NUMBER = r"(?:0[xXbBoO]\w*|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?\w*)"
EXACT = re.compile(r"(0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?"
                   r"|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*[jJ]?|\d(?:_?\d)*[jJ]|0(?:_?0)*|[1-9](?:_?\d)*)(and|else|for|if|in|is|not|or)?")
PREFIXES = frozenset(("", "r", "u", "b", "f", "br", "rb", "fr", "rf"))
ESCAPE = re.compile(r"\\(?:(x[0-9a-fA-F]{2})|(u[0-9a-fA-F]{4}|U(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4})|N\{([^{}]*)\}|([xuUN])|[\s\S])")
_STR = r"(?:(?<!\w)[rRbBfFuU]{1,2})?(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*(?:\"\"\"|$(?![\s\S]))|'''(?:[^'\\]|\\[\s\S]|'(?!''))*(?:'''|$(?![\s\S]))|\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?)"
MARKED = r"[^\W\d][\w\u0300-\u036f\u0591-\u05c7\u064b-\u065f\u0900-\u0dff\u0e31-\u0e4e]*"
TOKEN = re.compile(r"[ \t\r\f\v ]*(" + "|".join([
    CONFLICT, r"#[^\n]*", _STR, NUMBER, MARKED, r"\\\r?\n", r"\n[ \t\f]*", r"\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|>>|<<|->|:=|[-+*/%&|^@<>=!]=|[^\s]"]) + ")")
BINARY = {"or": 1, "and": 2, "in": 4, "not": 4, "is": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "==": 4, "!=": 4, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8,
          "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10, "**": 12}
AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
ENDS = frozenset((")", "", ";", "=", "}"))
#: What expressions are as targets: a bare name, an attribute, a subscript, one of them in brackets; a group of targets without
#: and with a star; a target with a star, and another expression with one. All else is "x".
SINGLE, TARGETS = frozenset("naip"), frozenset("naipTS*")


_PLAIN = re.compile(r"#[^\n]*|(?P<f>[rR]?[fFtT][rR]?)(?P<q>\"\"\"|'''|\"|')|[bBuUrR]{0,2}(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')|\w+")


def flat_fstrings(text: str) -> str:
    """``text`` with f-strings, which may hold quotes of their own, made plain strings; line ends in them stay escaped."""
    out, at = [], 0
    while m := _PLAIN.search(text, at):
        out.append(text[at:m.start()])
        if m["f"] is None:
            out.append(m[0])
            at = m.end()
            continue
        at = _fstring_end(text, m.end(), m["q"])
        whole = text.endswith(m["q"], m.end(), at)
        good = whole and fields_parse(text[m.end():at - len(m["q"])], "r" in m["f"].lower())
        out.append(("''" if good else "?") + "\\\n" * text.count("\n", m.start(), at) + " ")
    return "".join([*out, text[at:]])


def _fstring_end(text: str, i: int, quote: str) -> int:
    n = len(text)
    while i < n:
        if text.startswith(quote, i):
            return i + len(quote)
        ch = text[i]
        if ch == "\\":
            i += 2
        elif text.startswith(("{{", "}}"), i):
            i += 2
        elif ch == "{":
            depth, i = 1, i + 1
            while i < n and depth:
                m = _PLAIN.match(text, i)
                if m and m["f"] is not None:
                    i = _fstring_end(text, m.end(), m["q"])
                elif m:
                    i = m.end()
                else:
                    depth += (text[i] in "{[(") - (text[i] in "}])")
                    i += 1
        elif ch == "\n" and len(quote) == 1:
            return i
        else:
            i += 1
    return n


def escapes(body: str, text: bool = True) -> bool:
    """Are all escapes of a literal whole? Bytes know only ``\\x`` of them."""
    for m in ESCAPE.finditer(body):
        if m[3] is not None and text:
            try:
                unicodedata.lookup(m[3])
            except KeyError:
                return False
        elif m[4] == "x" or m[4] and text:
            return False
    return True


_LITERAL = re.compile(r"[^\\{}]+")


def fields_parse(body: str, raw: bool) -> bool:
    """Does an f-string hold whole escapes, paired braces and expressions?"""
    i, n = 0, len(body)
    while i < n:
        ch = body[i]
        if ch == "\\" and not raw:
            m = ESCAPE.match(body, i)
            if m is None or m[0][1] not in "{}" and not escapes(m[0]):
                return False
            i += 1 if m[0][1] in "{}" else len(m[0])
        elif body.startswith(("{{", "}}"), i):
            i += 2
        elif ch == "{":
            i = _field(body, i + 1, raw, 0)
            if i < 0:
                return False
        elif ch == "}":
            return False
        else:
            m = _LITERAL.match(body, i)
            i = m.end() if m else i + 1
    return True


def _field(s: str, i: int, raw: bool, level: int) -> int:
    """Where the replacement field ends whose expression begins at ``i``; -1 if it is none."""
    j, n, stack = i, len(s), []
    while j < n:
        m = _PLAIN.match(s, j)
        if m and m["f"] is not None:
            j = _fstring_end(s, m.end(), m["q"])
            continue
        if m:
            if m[0][0] == "#" and m.end() == n:
                return -1
            j = m.end()
            continue
        c = s[j]
        if c in "([{":
            stack.append(c)
        elif c in ")]}":
            if not stack:
                break
            if "([{"[")]}".index(c)] != stack.pop():
                return -1
        elif not stack and (c == ":" or c == "!" and s[j + 1:j + 2] != "=" or c == "=" and s[j + 1:j + 2] != "=" and s[j - 1] not in "=!<>"):
            break
        j += 1
    if j >= n or not expression_parses(s[i:j]):
        return -1
    if s[j] == "=":
        j += 1
        while j < n and s[j].isspace():
            j += 1
    if s[j:j + 1] == "!":
        if s[j + 1:j + 2] not in ("s", "r", "a") or s[j + 2:j + 3] not in (":", "}"):
            return -1
        j += 2
    if s[j:j + 1] == ":":
        j += 1
        while j < n and s[j] != "}":
            if s[j] == "{":
                j = _field(s, j + 1, raw, level + 1) if level < 2 else -1
                if j < 0:
                    return -1
            else:
                j += 1
    return j + 1 if s[j:j + 1] == "}" else -1


def expression_parses(text: str) -> bool:
    """The expression of a replacement field, which may run over lines."""
    p = PythonParser.__new__(PythonParser)
    shape = " ".join(x for x in map(PythonParser.canon.__getitem__, TOKEN.findall(text)) if x[:1] != "\n")
    p.toks = [*shape.split(), ""]
    p.j, p.t, p.nest = 0, p.toks[0], 0
    try:
        p.rhs()
    except Wrong:
        return False
    return p.t == ""


class PyCanon(Canon):
    def classify(self, tok: str) -> str:
        ch = tok[0]
        if ch == "\n":
            width = alt = 0
            for c in tok[1:]:
                width, alt = (width // 8 * 8 + 8, alt + 1) if c == "\t" else (0, 0) if c == "\f" else (width + 1, alt + 1)
            return f"\n{width}:{alt}"
        if ch == "#" or ch == "\\" and len(tok) > 1:
            return ""
        if ch == "." and len(tok) == 3 and tok == "...":
            return "..."
        if tok[-1] in "\"'" or "\"" in tok[:5] or "'" in tok[:5]:
            body = tok.lstrip("rRbBfFuU")
            if body[:1] and body[0] in "\"'":
                q = body[:3] if body[:3] in ('"""', "'''") else body[0]
                n = len(body)
                slashes = n - len(q) - len(body[:n - len(q)].rstrip("\\")) if n > len(q) else 0
                if not (n >= 2 * len(q) and body.endswith(q) and slashes % 2 == 0):
                    return "E"
                return self.literal(tok[:len(tok) - n].lower(), body[len(q):n - len(q)])
        if ch.isdigit() or ch == "." and len(tok) > 1 and tok[1].isdigit():
            m = EXACT.fullmatch(tok)
            if m is None:
                return "X"
            kind = "0j" if (m[1][-1] in "jJ") else "0"
            return f"{kind} {m[2]}" if m[2] else kind
        if tok in SOFT:
            return tok
        if (ch.isalpha() or ch == "_" or ord(ch) > 127) and not unicodedata.normalize("NFKC", tok).isidentifier():
            return "X"
        return super().classify(tok)

    def literal(self, prefix: str, body: str) -> str:
        if prefix not in PREFIXES:
            return "X"
        if "b" in prefix:
            return "sb" if body.isascii() and ("r" in prefix or escapes(body, False)) else "X"
        if "f" in prefix:
            return "s" if fields_parse(body, "r" in prefix) else "X"
        return "s" if "r" in prefix or "\\" not in body or escapes(body) else "X"


class PythonParser:
    """Logical lines by indentation; each is parsed as simple statements or as the head of a block."""

    canon = PyCanon(KEYWORDS, "\x00", ("\x00",))
    token = TOKEN
    known: dict[str, str] = {}
    depths: dict[str, int] = {}

    def __init__(self, text: str) -> None:
        self.text = text[1:] if text.startswith("﻿") else text
        first = re.match(r"[ \t\f]*", self.text)[0]
        found = TOKEN.findall("\n" + first + self.text[len(first):])
        self.lines = " ".join(map(self.canon.__getitem__, found)).split("\n")[1:]
        self.found: list[Problem] = []
        for memory in (self.known, self.depths):
            if len(memory) > REMEMBER:
                memory.clear()

    def wrong(self, wanted: str = "") -> Wrong:
        t = self.t
        if t == "C":
            return Wrong("conflict marker", "merge conflict")
        if t == "E":
            return Wrong("string without end", "unterminated string")
        if t == "X":
            return Wrong("malformed literal or sign", "bad literal")
        return Wrong(f"unexpected {t or 'end of line'!r}" + (f", expected {wanted}" if wanted else ""))

    @deep
    def run(self) -> list[Problem]:
        found = self.read()
        if found and re.search(r"\b[rR]?[fFtT][rR]?[\"']", self.text) and (flat := flat_fstrings(self.text)) != self.text:
            return type(self)(flat).read()
        return found

    # logical lines
    def read(self) -> list[Problem]:
        lines, n, known = self.lines, len(self.lines), self.known
        indents, alts, want = [0], [0], False
        # kinds of blocks by indent: in the block of a match statement there are cases only
        kinds = [""]
        last: dict[int, str] = {}
        opened = ""
        i = 0
        while i < n:
            raw = lines[i]
            cut = raw.find(" ")
            shape = raw[cut + 1:].strip() if cut > 0 else ""
            if not shape:
                i += 1
                continue
            at = i
            width, alt = map(int, raw[:cut].split(":"))
            i += 1
            depth = self.depth_of(shape)
            if depth:
                bits = [shape]
                while depth > 0 and i < n:
                    nxt = lines[i].partition(" ")[2].strip()
                    i += 1
                    if nxt:
                        if nxt == "C" or nxt.startswith("C "):
                            break
                        bits.append(nxt)
                        depth += self.depth_of(nxt)
                shape = " ".join(bits)
            try:
                if width > indents[-1]:
                    if not want:
                        raise Wrong("unexpected indent", "indentation")
                    if alt <= alts[-1]:
                        raise Wrong("inconsistent tabs and spaces", "indentation")
                    if len(indents) >= MOST_INDENTS:
                        raise Wrong("too many levels of indentation", "nesting")
                    indents.append(width)
                    alts.append(alt)
                    kinds.append(opened)
                else:
                    if want:
                        want = False
                        raise Wrong("expected an indented block", "indentation")
                    while width < indents[-1]:
                        open_ = last.pop(indents.pop(), None)
                        if open_ in ("try", "decorator"):
                            self.found.append(Problem(at, "unexpected token", f"{open_} without its block"))
                        alts.pop()
                        kinds.pop()
                    if width != indents[-1]:
                        indents.append(width)
                        alts.append(alt)
                        kinds.append("")
                        raise Wrong("unindent to no outer level", "indentation")
                    if alt != alts[-1]:
                        raise Wrong("inconsistent tabs and spaces", "indentation")
                want = False
                kind = known.get(shape)
                if kind is None:
                    kind = known[shape] = self.line(shape)
                word = shape.split(" ", 1)[0]
                if (kind[:4] == "case") != (kinds[-1] == "match"):
                    raise Wrong("case outside of match" if kind[:4] == "case" else "only cases stand in a match")
                opened = kind
                if kind in ("case block", "match"):
                    kind = "block"
                elif kind == "case inline":
                    kind = "inline"
                if shape.startswith("except *"):
                    word = "except*"
                prev = last.get(width, "")
                if word in ("elif", "else", "except", "except*", "finally"):
                    ok = {"elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except", "except*"), "except": ("try", "except"), "except*": ("try", "except*"),
                          "finally": ("try", "except", "except*", "else")}[word]
                    if prev not in ok or word == "finally" and last.get(~width) != "try" or prev == "else" and word != "finally":
                        raise Wrong(f"unexpected {word!r}")
                elif prev == "try" or prev == "decorator" and word not in ("def", "class", "async", "@"):
                    raise Wrong(f"{prev} without its block", "unexpected token")
                if word in ("try", "if", "for", "while"):
                    last[~width] = word
                last[width] = "decorator" if word == "@" else shape.split(" ", 2)[1] if word == "async" and kind in ("block", "inline") else word if kind in ("block", "inline") else ""
                want = kind == "block"
            except Wrong as w:
                self.found.append(Problem(at, w.cause, w.message))
                want = shape.endswith(":")
                opened = "match" if want and shape.startswith("match ") else ""
                last[width] = ""
            if depth > 0:
                self.found.append(Problem(at, "truncated" if i >= n else "unclosed bracket", "bracket was never closed"))
        if want:
            self.found.append(Problem(n - 1, "truncated", "end of file, expected an indented block"))
        if any(v in ("try", "decorator") for k, v in last.items() if k >= 0):
            self.found.append(Problem(n - 1, "truncated", "end of file within a statement"))
        return self.numbered() if self.found else []

    def numbered(self) -> list[Problem]:
        at = []
        for m in TOKEN.finditer("\n" + self.text):
            if m.group(1)[0] == "\n":
                at.append(self.text.count("\n", 0, max(0, m.start(1) - 1)) + 1 + (m.start(1) > 0))
        return [Problem(at[min(p.line, len(at) - 1)], p.cause, p.message) for p in self.found]

    def depth_of(self, shape: str) -> int:
        d = self.depths.get(shape)
        if d is None:
            d = 0
            for t in shape.split(" "):
                d += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
            self.depths[shape] = d
        return d

    # one logical line
    def line(self, shape: str) -> str:
        self.toks = [*shape.split(), ""]
        self.j, self.t, self.nest = 0, self.toks[0], 0
        kind = self.compound()
        if self.t:
            raise self.wrong()
        return kind

    def adv(self) -> str:
        t = self.t
        self.j += 1
        self.t = self.toks[self.j] if self.j < len(self.toks) else ""
        return t

    def next(self) -> str:
        return self.toks[self.j + 1] if self.j + 1 < len(self.toks) else ""

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
        if self.t not in NAMES:
            raise self.wrong("a name")
        self.adv()

    def colon(self) -> str:
        self.need(":")
        if self.t == "":
            return "block"
        self.simple()
        return "inline"

    def compound(self) -> str:
        t = self.t
        if t == "async":
            self.adv()
            t = self.t
            if t not in ("def", "for", "with"):
                raise self.wrong()
        if t in ("if", "while", "elif"):
            self.adv()
            self.named()
            return self.colon()
        if t in ("else", "try", "finally"):
            self.adv()
            return self.colon()
        if t == "for":
            self.adv()
            self.targets()
            self.need("in")
            self.star_exprs()
            return self.colon()
        if t == "with":
            self.adv()
            m = self.j
            if self.t == "(":
                try:
                    self.adv()
                    self.with_item()
                    while self.accept(",") and self.t != ")":
                        self.with_item()
                    self.need(")")
                    return self.colon()
                except Wrong:
                    self.j, self.t = m, self.toks[m]
            self.with_item()
            while self.accept(","):
                self.with_item()
            return self.colon()
        if t == "except":
            self.adv()
            if self.accept("*") or self.t != ":":
                self.expr()
                if self.accept("as"):
                    self.name()
            return self.colon()
        if t == "def":
            self.adv()
            self.name()
            self.type_params()
            self.need("(")
            self.params(")", True)
            self.need(")")
            if self.accept("->"):
                self.expr()
            return self.colon()
        if t == "class":
            self.adv()
            self.name()
            self.type_params()
            if self.accept("("):
                self.args()
                self.need(")")
            return self.colon()
        if t == "@":
            self.adv()
            self.named()
            return "simple"
        if t in ("match", "case"):  # names elsewhere
            m = self.j
            try:
                self.adv()
                if t == "match":
                    self.items(("",))
                    self.need(":")
                    if self.t == "":
                        return "match"
                else:
                    self.patterns()
                    if self.accept("if"):
                        self.named()
                    return f"case {self.colon()}"
            except Wrong:
                pass
            self.j, self.t = m, self.toks[m]
        self.simple()
        return "simple"

    def type_params(self) -> None:
        if self.accept("["):
            while True:
                starred = self.accept("*") or self.accept("**")
                self.name()
                if not starred and self.accept(":"):
                    self.expr()
                if self.accept("="):
                    self.accept("*")
                    self.expr()
                if not self.accept(",") or self.t == "]":
                    break
            self.need("]")

    def with_item(self) -> None:
        self.expr()
        if self.accept("as"):
            self.target()

    # patterns
    def patterns(self) -> None:
        """What stands behind case: one pattern, or several as an open sequence."""
        star = self.maybe_star()
        if star and self.t != ",":
            raise self.wrong("','")
        while self.accept(","):
            if self.t in (":", "if"):
                return
            self.maybe_star()

    def maybe_star(self) -> bool:
        if self.accept("*"):
            self.name()
            return True
        self.pattern()
        return False

    def pattern(self) -> None:
        self.deeper()
        self.closed()
        while self.accept("|"):
            self.closed()
        if self.accept("as"):
            if self.t == "_":
                raise self.wrong("a name")
            self.name()
        self.nest -= 1

    def number(self) -> None:
        self.accept("-")
        if self.accept("0j"):
            return
        self.need("0")
        if self.t in ("+", "-"):
            self.adv()
            self.need("0j")

    def key(self) -> bool:
        """A literal or a dotted name; tells whether it was a bare name."""
        if self.t in NAMES:
            self.adv()
            bare = self.t != "."
            while self.accept("."):
                self.name()
            return bare
        if self.t in ("s", "sb"):
            self.strings()
        elif self.t in ("None", "True", "False"):
            self.adv()
        else:
            self.number()
        return False

    def closed(self) -> None:
        if self.t in ("(", "["):
            end = ")" if self.adv() == "(" else "]"
            star = commas = False
            while self.t != end:
                star = self.maybe_star()
                if not self.accept(","):
                    break
                commas = True
            if star and end == ")" and not commas:
                raise self.wrong("','")
            self.need(end)
        elif self.accept("{"):
            while self.t != "}":
                if self.accept("**"):
                    self.name()
                    self.accept(",")
                    break
                if self.key():
                    raise self.wrong("'.'")
                self.need(":")
                self.pattern()
                if not self.accept(","):
                    break
            self.need("}")
        else:
            named = self.t in NAMES
            if self.t == "_" and self.next() == "(":
                raise self.wrong("a class")
            self.key()
            if named and self.accept("("):
                keyed = False
                while self.t != ")":
                    if self.t in NAMES and self.next() == "=":
                        self.adv()
                        self.adv()
                        keyed = True
                    elif keyed:
                        raise self.wrong("a keyword pattern")
                    self.pattern()
                    if not self.accept(","):
                        break
                self.need(")")

    # statements of one line
    def simple(self) -> None:
        self.small()
        while self.accept(";"):
            if self.t == "":
                return
            self.small()

    def dotted(self) -> None:
        self.name()
        while self.accept("."):
            self.name()

    def small(self) -> None:
        t = self.t
        if t in ("pass", "break", "continue"):
            self.adv()
        elif t == "return":
            self.adv()
            if self.t not in ("", ";"):
                self.star_exprs()
        elif t == "raise":
            self.adv()
            if self.t not in ("", ";"):
                self.expr()
                if self.accept("from"):
                    self.expr()
        elif t in ("global", "nonlocal"):
            self.adv()
            self.name()
            while self.accept(","):
                self.name()
        elif t == "del":
            self.adv()
            while True:
                if self.primary() not in "naipT":
                    raise self.wrong("something that can be deleted")
                if not self.accept(",") or self.t in ("", ";"):
                    break
        elif t == "assert":
            self.adv()
            self.expr()
            if self.accept(","):
                self.expr()
        elif t == "import":
            self.adv()
            while True:
                self.dotted()
                if self.accept("as"):
                    self.name()
                if not self.accept(","):
                    return
        elif t == "from":
            self.adv()
            dots = False
            while self.t in (".", "..."):
                self.adv()
                dots = True
            if self.t != "import" or not dots:
                self.dotted()
            self.need("import")
            if self.accept("*"):
                return
            paren = self.accept("(")
            while True:
                self.name()
                if self.accept("as"):
                    self.name()
                if not self.accept(",") or paren and self.t == ")":
                    break
            if paren:
                self.need(")")
        elif t == "type" and self.next() in NAMES:
            self.adv()
            self.name()
            self.type_params()
            self.need("=")
            self.expr()
        elif t == "yield":
            self.rhs()
        else:
            kind = self.star_exprs()
            if self.t == ":":
                if kind not in SINGLE:
                    raise self.wrong()
                self.adv()
                self.expr()
                if self.accept("="):
                    self.rhs()
            elif self.t in AUGMENTED:
                if kind not in SINGLE:
                    raise Wrong("this can't be assigned to", "bad target")
                self.adv()
                self.rhs()
            else:
                while self.t == "=":
                    if kind not in TARGETS:
                        raise Wrong("this can't be assigned to", "bad target")
                    self.adv()
                    kind = self.rhs()

    # expressions; each tells what it is as a target
    def deeper(self) -> None:
        self.nest += 1
        if self.nest > MOST_BRACKETS:
            raise Wrong("nesting too deep", "nesting")

    def targets(self) -> None:
        self.target()
        while self.accept(","):
            if self.t == "in":
                return
            self.target()

    def target(self) -> None:
        self.accept("*")
        if self.primary() not in TARGETS:
            raise Wrong("this can't be assigned to", "bad target")

    def rhs(self) -> str:
        if not self.accept("yield"):
            return self.star_exprs()
        if self.accept("from"):
            self.expr()
        elif self.t not in ENDS:
            self.star_exprs()
        return "x"

    def star(self) -> str:
        """Behind a star: the kind of the starred expression."""
        return "*" if self.binary(5) in TARGETS else "x"

    @staticmethod
    def group(kinds: list[str]) -> str:
        return "x" if any(k not in TARGETS for k in kinds) else "S" if any(k in "S*" for k in kinds) else "T"

    def star_exprs(self) -> str:
        kinds = []
        while True:
            kinds.append(self.star() if self.accept("*") else self.expr())
            if not self.accept(","):
                return kinds[0] if len(kinds) == 1 else self.group(kinds)
            if self.t in ("", ";", "=", ")", "]", "}", ":") or self.t in AUGMENTED:
                return self.group(kinds)

    def named(self) -> str:
        if self.t in NAMES and self.next() == ":=":
            self.adv()
            self.adv()
            self.expr()
            return "x"
        return self.expr()

    def expr(self) -> str:
        if self.accept("lambda"):
            self.deeper()
            self.params(":", False)
            self.need(":")
            self.expr()
            self.nest -= 1
            return "x"
        kind = self.binary(1)
        if self.accept("if"):
            self.binary(1)
            self.need("else")
            self.expr()
            return "x"
        return kind

    def binary(self, least: int) -> str:
        kind = self.unary(least)
        while (p := BINARY.get(self.t, 0)) >= least and p:
            op = self.adv()
            if op == "not":
                self.need("in")
            elif op == "is":
                self.accept("not")
            self.binary(11 if op == "**" else p + 1)
            kind = "x"
        return kind

    def unary(self, least: int) -> str:
        t = self.t
        if t == "not":
            if least > 3:
                raise self.wrong()
            while self.accept("not"):
                pass
            self.binary(4)
        elif t in ("-", "+", "~"):
            while self.t in ("-", "+", "~"):
                self.adv()
            self.binary(12)
        elif t == "await":
            self.adv()
            self.primary()
        else:
            return self.primary()
        return "x"

    def strings(self) -> None:
        first = self.adv()
        while self.t in ("s", "sb"):
            if self.adv() != first:
                raise Wrong("bytes beside text", "bad literal")

    def primary(self) -> str:
        t, kind = self.t, "x"
        if t in NAMES:
            self.adv()
            kind = "n"
        elif t in ("0", "0j", "None", "True", "False", "..."):
            self.adv()
        elif t in ("s", "sb"):
            self.strings()
        elif t in ("(", "[", "{"):
            self.deeper()
            self.adv()
            if t == "(":
                kind = "T" if self.t == ")" else self.rhs() if self.t == "yield" else self.items((")",))
                kind = "p" if kind in SINGLE else kind
                if kind == "*":
                    raise Wrong("a star stands alone")
                self.need(")")
            elif t == "[":
                kind = "T" if self.t == "]" else self.items(("]",))
                self.need("]")
            else:
                if self.t != "}":
                    self.braces()
                self.need("}")
            self.nest -= 1
        else:
            raise self.wrong()
        while True:
            t = self.t
            if t == ".":
                self.adv()
                self.name()
                kind = "a"
            elif t == "(":
                self.deeper()
                self.adv()
                self.args()
                self.need(")")
                self.nest -= 1
                kind = "x"
            elif t == "[":
                self.deeper()
                self.adv()
                self.subscript()
                self.need("]")
                self.nest -= 1
                kind = "i"
            else:
                return kind

    def items(self, end: tuple[str, ...]) -> str:
        """In round or square brackets, or behind match: items with stars, or a comprehension."""
        kinds: list[str] = []
        while True:
            starred = self.accept("*")
            kinds.append(self.star() if starred else self.named())
            if self.t in ("for", "async") and len(kinds) == 1 and not starred and end != ("",):
                self.comprehension()
                return "x"
            if not self.accept(","):
                if len(kinds) == 1 and end != ("]",):
                    if starred:
                        raise Wrong("a star stands alone")
                    return kinds[0]
                return self.group(kinds)
            if self.t in end or self.t == ":":
                return self.group(kinds)

    def braces(self) -> None:
        """A set or a dictionary."""
        pairs: bool | None = None
        first = True
        while True:
            if self.t == "**":
                if pairs is False:
                    raise self.wrong()
                self.adv()
                self.binary(5)
                pairs, plain = True, False
            elif self.t == "*":
                if pairs:
                    raise self.wrong()
                self.adv()
                self.binary(5)
                pairs, plain = False, False
            else:
                plain = True
                walrus = self.next() == ":="
                self.named()
                if self.t == ":" and not walrus:
                    if pairs is False:
                        raise self.wrong()
                    self.adv()
                    self.expr()
                    pairs = True
                elif pairs:
                    raise self.wrong("':'")
                else:
                    pairs = False
            if first and plain and self.t in ("for", "async"):
                self.comprehension()
                return
            first = False
            if not self.accept(",") or self.t == "}":
                return

    def comprehension(self) -> None:
        while self.t in ("for", "async"):
            self.accept("async")
            self.need("for")
            self.targets()
            self.need("in")
            self.binary(1)
            while self.accept("if"):
                self.binary(1)

    def args(self) -> None:
        keyed = spread = False
        count = 0
        while self.t != ")":
            if self.accept("**"):
                self.expr()
                spread = True
            elif self.accept("*"):
                if spread:
                    raise self.wrong("a keyword argument")
                self.expr()
            elif self.t in NAMES and self.next() == "=":
                self.adv()
                self.adv()
                self.expr()
                keyed = True
            else:
                if keyed or spread:
                    raise self.wrong("a keyword argument")
                self.named()
                if self.t in ("for", "async"):
                    if count:
                        raise self.wrong("')'")
                    self.comprehension()
                    return
            count += 1
            if not self.accept(","):
                return

    def subscript(self) -> None:
        while True:
            if self.accept("*"):
                self.binary(5)
            elif self.next() == ":=":
                self.named()
            else:
                if self.t != ":":
                    self.expr()
                for _ in range(2):
                    if self.accept(":") and self.t not in (":", ",", "]"):
                        self.expr()
            if not self.accept(",") or self.t == "]":
                return

    def params(self, end: str, annotated: bool) -> None:
        count, slash, star, bare, default = 0, False, False, False, False
        while self.t != end:
            if self.accept("/"):
                if slash or star or not count:
                    raise self.wrong()
                slash = True
            elif self.accept("**"):
                self.name()
                if annotated and self.accept(":"):
                    self.expr()
                if bare:
                    raise self.wrong("a name after '*'")
                self.accept(",")
                return
            elif self.accept("*"):
                if star:
                    raise self.wrong()
                star = True
                bare = self.t == ","
                if not bare:
                    self.name()
                    if annotated and self.accept(":"):
                        if self.accept("*"):
                            self.binary(5)
                        else:
                            self.expr()
            else:
                self.name()
                bare = False
                if annotated and self.accept(":"):
                    self.expr()
                if self.accept("="):
                    self.expr()
                    default = True
                elif default and not star:
                    raise self.wrong("'='")
            count += 1
            if not self.accept(","):
                break
        if bare:
            raise self.wrong("a name after '*'")
