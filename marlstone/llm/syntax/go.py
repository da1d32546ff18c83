"""Go, with generics."""

from __future__ import annotations

from marlstone.llm.syntax.base import CONFLICT, DEPTH, NAME, DOTTED, Canon, Parser, Wrong, tokens

# Keywords.
KEYWORDS = frozenset("""break case chan const continue default defer else fallthrough for func go goto if import interface map package range return
select struct switch type var""".split())
_OPS = r"&\^=|<<=|>>=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^"
TOKEN = tokens(CONFLICT, r"//[^\n]*", r"/\*(?:[^*]|\*(?!/))*(?:\*/)?", r"`[^`]*`?", r"\"(?:[^\"\\\n]|\\[^\n])*\"?", r"'(?:[^'\\\n]|\\[^\n])+'?", DOTTED, NAME, _OPS)
BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
EXACT = (r"0[bB](?:_?[01])+i?|0[oO](?:_?[0-7])+i?|0[xX](?:_?[0-9a-fA-F])+i?|0[xX](?:(?:_?[0-9a-fA-F])+\.?(?:[0-9a-fA-F](?:_?[0-9a-fA-F])*)?|\.[0-9a-fA-F]+)[pP][+-]?\d(?:_?\d)*i?"
         r"|0(?:_?[0-7])*|[1-9](?:_?\d)*|\d(?:_?\d)*i|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*|\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?)i?")
TYPE_START = frozenset("a * [ ( func map chan struct interface <-".split())


class GoCanon(Canon):
    def classify(self, tok: str) -> str:
        if tok.startswith("/*") and (not tok.endswith("*/") or len(tok) < 4):
            return "E"
        return super().classify(tok)


class GoParser(Parser):
    """A line end after an operand ends the statement, so nothing is read on over it."""

    token = TOKEN
    canon = GoCanon(KEYWORDS, "\"'`", ("//", "/*"), EXACT)
    simple = {"top": set(), "block": set()}
    heads = {"top": {}, "block": {}}
    sync = frozenset("func type var const import if for return switch select defer go".split())
    #: Below 0 in the head of a statement, where a brace begins the block.
    level = 0

    def program(self) -> None:
        if self.t != "package":
            self.problem(self.i, self.wrong("'package'"))
            if self.t:
                self.panic(self.i)
        else:
            self.adv()
            self.name()
            self.end()
        super().program()

    def end(self) -> None:
        if self.t == ";":
            self.adv()
        elif not (self.nl or self.t in (")", "}", "")):
            raise self.wrong("end of statement")

    def body(self, kind: str) -> None:
        level, self.level = self.level, 0
        self.statements("block", "}")
        self.need("}")
        self.level = level
        if kind == "if":
            self.else_tail()
        if kind != "func" or not self.nl:
            self.end()

    def block(self) -> None:
        if self.t != "{" or self.nl:
            raise self.wrong("'{'")
        self.open_block()

    def open_block(self) -> None:
        self.need("{")
        level, self.level = self.level, 0
        self.statements("block", "}")
        self.need("}")
        self.level = level

    def else_tail(self) -> None:
        while self.t == "else" and not self.nl:
            self.adv()
            if self.t == "if" and not self.nl:
                self.adv()
                self.head_part()
                self.block()
            else:
                self.block()
                return

    def head_part(self) -> None:
        """[simple ;] simple, up to the brace."""
        level, self.level = self.level, -1
        if self.t != ";" and self.t != "{":
            self.simple_statement()
        if self.t == ";" or self.nl and self.t != "{":
            self.accept(";")
            if self.t != "{":
                self.simple_statement()
        self.level = level

    def statement(self, ctx: str) -> str:
        at, first, t = self.i, self.j == 0, self.t
        if t == ";":
            self.adv()
            return "closed"
        if t == "func" and (ctx == "top" or self.peek() == "a" and ctx == "top"):
            self.adv()
            if self.t == "(":
                self.params()
            self.name()
            if self.t == "[":
                self.type_params()
            self.signature()
            if self.t == "{" and not self.nl:
                self.head(ctx, at, first, "func")
                self.open_block()
            self.end()
            return "closed"
        if t in ("var", "const", "type", "import"):
            if t == "import" and ctx != "top":
                raise self.wrong("a statement")
            self.adv()
            self.declarations(t)
            self.end()
            return "closed"
        if ctx == "top":
            raise self.wrong("a declaration")
        if t == "{":
            self.open_block()
            self.end()
            return "open"
        if t == "if":
            self.adv()
            self.head_part()
            self.head(ctx, at, first, "if")
            self.block()
            self.else_tail()
            self.end()
            return "open"
        if t == "for":
            self.adv()
            level, self.level = self.level, -1
            if self.t == "range":
                self.adv()
                self.expr()
            elif self.t != "{":
                if self.t != ";":
                    self.simple_statement(True)
                if self.t == ";":
                    self.adv()
                    if self.t not in (";", "{"):
                        self.simple_statement()
                    if self.t == ";":
                        self.adv()
                    if self.t != "{":
                        self.simple_statement()
            self.level = level
            self.head(ctx, at, first, "block")
            self.block()
            self.end()
            return "open"
        if t == "switch" or t == "select":
            self.adv()
            if t == "switch":
                self.head_part()
            if self.t != "{" or self.nl:
                raise self.wrong("'{'")
            self.adv()
            level, self.level = self.level, 0
            while self.t in ("case", "default"):
                if self.adv() == "case":
                    self.case()
                self.need(":")
                while self.t not in ("case", "default", "}", ""):
                    self.statement("block")
            self.need("}")
            self.level = level
            self.end()
            return "open"
        if t == "return":
            self.adv()
            if not self.nl and self.t not in (";", "}"):
                self.exprs()
            self.end()
            return "closed"
        if t in ("break", "continue", "goto"):
            self.adv()
            if self.t == "a" and not self.nl:
                self.adv()
            elif t == "goto":
                raise self.wrong("a label")
            self.end()
            return "closed"
        if t == "fallthrough":
            self.adv()
            self.end()
            return "closed"
        if t in ("go", "defer"):
            self.adv()
            self.expr()
            self.end()
            return "closed"
        if t == "a" and self.peek() == ":":
            self.adv()
            self.adv()
            if self.t != "}":
                self.statement(ctx)
            return "open"
        self.simple_statement()
        self.end()
        return "closed"

    def case(self) -> None:
        """Expressions, types, or a communication."""
        while True:
            self.type_or_expr()
            if not self.accept(","):
                break
        if self.t in ASSIGN:
            self.adv()
            self.expr()
        elif self.t == "<-":
            self.adv()
            self.expr()

    def type_or_expr(self) -> None:
        self.expr()

    def simple_statement(self, loop: bool = False) -> None:
        self.exprs()
        if self.nl:
            return
        t = self.t
        if t in ASSIGN:
            self.adv()
            if self.t == "range" and loop:
                self.adv()
                self.expr()
            else:
                self.exprs()
        elif t in ("++", "--"):
            self.adv()
        elif t == "<-":
            self.adv()
            self.expr()

    def declarations(self, kind: str) -> None:
        if self.t == "(":
            self.adv()
            while self.t != ")":
                self.spec(kind)
                if self.t != ")":
                    self.end()
                elif self.t == "":
                    break
                if self.t == "":
                    raise self.wrong("')'")
            self.need(")")
        else:
            self.spec(kind)

    def spec(self, kind: str) -> None:
        if kind == "import":
            if self.t in ("a", "."):
                self.adv()
            if self.t != "s":
                raise self.wrong("a path")
            self.adv()
        elif kind == "type":
            self.name()
            if self.t == "[" and not self.nl and self.peek() == "a" and self.peek(2) not in ("]",):
                m, depth = self.mark(), self.depth
                try:
                    self.type_params()
                except Wrong:
                    self.back(m)
                    self.depth = depth
            self.accept("=")
            self.type()
        else:
            self.name()
            while self.accept(","):
                self.name()
            if self.t != "=" and not self.nl and self.t not in (")", ";"):
                self.type()
            elif kind == "var" and (self.t != "=" or self.nl):
                raise self.wrong("a type")
            if self.t == "=" and not self.nl:
                self.adv()
                self.exprs()

    def type_params(self) -> None:
        self.need("[")
        while self.t != "]":
            self.name()
            while self.accept(","):
                self.name()
            self.constraint()
            if not self.accept(","):
                break
        self.need("]")

    def constraint(self) -> None:
        while True:
            if self.t == "~":
                self.adv()
            self.type()
            if self.t != "|":
                return
            self.adv()

    def signature(self) -> None:
        self.params()
        if self.nl:
            return
        if self.t == "(":
            self.params()
        elif self.t in TYPE_START:
            self.type()

    def params(self) -> None:
        """Names and types share their form, so a list of "a", "a T" and "T" passes."""
        self.need("(")
        while self.t != ")":
            if self.t == "...":
                self.adv()
                self.type()
            else:
                self.type()
                if not self.nl and self.t not in (",", ")"):
                    self.accept("...")
                    self.type()
            if not self.accept(","):
                break
        if self.t == ")" and self.nl and self.lines[self.i - 1][-1:] not in (",", "(") and not self.prev_blank():
            raise self.wrong("','")
        self.need(")")

    def prev_blank(self) -> bool:
        """Whether the last line with tokens before this one ended in a comma or an opening bracket."""
        i = self.i - 1
        while i > 0 and not self.lines[i]:
            i -= 1
        return self.lines[i][-1:] in (",", "(", "{", "[")

    # types
    def type(self) -> None:
        self.depth += 1
        if self.depth > DEPTH:
            raise Wrong("nesting too deep", "nesting")
        t = self.t
        if t == "a":
            self.adv()
            if self.t == "." and not self.nl:
                self.adv()
                self.name()
            if self.t == "[" and not self.nl and self.peek() != "]":
                m = self.mark()
                try:
                    self.adv()
                    while self.t != "]":
                        self.type()
                        if not self.accept(","):
                            break
                    self.need("]")
                except Wrong:
                    self.back(m)
        elif t == "*":
            self.adv()
            self.type()
        elif t == "(":
            self.adv()
            self.type()
            self.need(")")
        elif t == "[":
            self.adv()
            if self.t != "]":
                if not self.accept("..."):
                    level, self.level = self.level, 0
                    self.expr()
                    self.level = level
            self.need("]")
            self.type()
        elif t == "map":
            self.adv()
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif t == "chan":
            self.adv()
            self.accept("<-")
            self.type()
        elif t == "<-":
            self.adv()
            self.need("chan")
            self.type()
        elif t == "func":
            self.adv()
            self.signature()
        elif t == "struct":
            self.adv()
            self.need("{")
            while self.t != "}":
                if self.t == "*" or self.t == "a" and (self.peek() in (".", "s", ";", "}") or self.ends_line()):
                    self.type()
                else:
                    self.name()
                    while self.accept(","):
                        self.name()
                    self.type()
                if self.t == "s" and not self.nl:
                    self.adv()
                self.end()
                if self.t == "":
                    break
            self.need("}")
        elif t == "interface":
            self.adv()
            self.need("{")
            while self.t != "}":
                if self.t == "a" and self.peek() == "(":
                    self.adv()
                    self.signature()
                else:
                    self.constraint()
                self.end()
                if self.t == "":
                    break
            self.need("}")
        else:
            raise self.wrong("a type")
        self.depth -= 1

    def ends_line(self) -> bool:
        return self.j == len(self.toks) - 1

    # expressions
    def exprs(self) -> None:
        self.expr()
        while self.t == "," and not self.nl:
            self.adv()
            self.expr()

    def expr(self) -> None:
        self.depth += 1
        if self.depth > DEPTH:
            raise Wrong("nesting too deep", "nesting")
        self.binary(1)
        self.depth -= 1

    def binary(self, least: int) -> None:
        self.unary()
        while not self.nl and (p := BINARY.get(self.t, 0)) >= least and p:
            self.adv()
            self.binary(p + 1)

    def unary(self) -> None:
        while self.t in ("+", "-", "!", "^", "*", "&", "<-", "~"):
            if self.t == "<-" and self.peek() == "chan":
                break
            self.adv()
        self.primary()

    def primary(self) -> None:
        t = self.t
        literal = False
        if t == "a":
            self.adv()
            literal = True
        elif t in ("0", "s"):
            self.adv()
        elif t == "(":
            self.adv()
            level, self.level = self.level, 0
            self.expr()
            self.level = level
            self.need(")")
        elif t == "func":
            self.adv()
            self.signature()
            if self.t == "{" and not self.nl:
                self.open_block()
        elif t in ("[", "map", "struct", "chan", "interface", "<-"):
            self.type()
            literal = True
            if self.t == "{" and not self.nl and t in ("[", "map", "struct"):
                self.literal()
                literal = False
        else:
            raise self.wrong("a value")
        while not self.nl:
            t = self.t
            if t == ".":
                self.adv()
                if self.t == "(":
                    self.adv()
                    if not self.accept("type"):
                        self.type()
                    self.need(")")
                    literal = False
                else:
                    self.name()
            elif t == "(":
                self.args()
                literal = False
            elif t == "[":
                self.adv()
                level, self.level = self.level, 0
                if self.t != ":":
                    self.expr()
                while self.t in (":", ","):
                    self.adv()
                    if self.t not in (":", "]"):
                        self.expr()
                self.level = level
                self.need("]")
            elif t == "{" and literal and self.level >= 0:
                self.literal()
                literal = False
            else:
                return

    def closing(self, tok: str) -> None:
        """A closing bracket on a line of its own needs a comma before it."""
        if self.t == tok and self.nl and not self.prev_blank():
            raise self.wrong("','")
        self.need(tok)

    def args(self) -> None:
        self.need("(")
        level, self.level = self.level, 0
        while self.t != ")":
            self.expr()
            self.accept("...")
            if not self.accept(","):
                break
        self.level = level
        self.closing(")")

    def literal(self) -> None:
        self.need("{")
        level, self.level = self.level, 0
        while self.t != "}":
            self.element()
            if self.accept(":"):
                self.element()
            if not self.accept(","):
                break
        self.level = level
        self.closing("}")

    def element(self) -> None:
        if self.t == "{":
            self.literal()
        else:
            self.expr()
