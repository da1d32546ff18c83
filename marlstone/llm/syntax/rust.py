"""Rust 2021."""

from __future__ import annotations

from marlstone.llm.syntax.base import CONFLICT, DEPTH, NAME, NUMBER, Canon, Parser, Wrong, tokens

# Keywords.
KEYWORDS = frozenset("""as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub
ref return self Self static struct super trait true type unsafe use where while""".split())
_OPS = r"<<=|>>=|\.\.\.|\.\.=|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|>>|\.\."
TOKEN = tokens(
    CONFLICT, r"//[^\n]*", r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*(?:\*/)?",
    r"(?:br|cr|r)\"[^\"]*\"?", r"(?:br|cr|r)#\"(?:[^\"]|\"(?!#))*(?:\"#)?", r"(?:br|cr|r)##\"(?:[^\"]|\"(?!##))*(?:\"##)?", r"(?:br|cr|r)###\"(?:[^\"]|\"(?!###))*(?:\"###)?",
    r"[bc]?\"(?:[^\"\\]|\\[\s\S])*\"?", r"b?'(?:\\(?:u\{[^}]*\}|x[0-9a-fA-F]{2}|.)|[^'\\\n])'", r"'[^\W\d]\w*", r"r#\w+", NUMBER.rpartition(r"|\.\d")[0] + ")", NAME, _OPS)
BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, ">": 3, "<=": 3, ">=": 3, "|": 4, "^": 5, "&": 6, "<<": 7, ">>": 7, "+": 8, "-": 8, "*": 9, "/": 9, "%": 9}
ASSIGN = frozenset("= += -= *= /= %= ^= &= |= <<= >>=".split())
BLOCKY = frozenset("if match while loop for unsafe { async const".split())
STARTS = frozenset("a 0 s L ( [ { & && * - ! | || self Self crate super :: < if match while loop for unsafe async move return break continue true false let .. ..=".split())
ITEMS = frozenset("fn struct enum trait impl mod use const static type extern pub unsafe async #".split())


_INT = r"(?:_*(?:[ui](?:8|16|32|64|128|size)))?_*"
EXACT = (rf"0x_*[0-9a-fA-F][0-9a-fA-F_]*?{_INT}|0o_*[0-7][0-7_]*?{_INT}|0b_*[01][01_]*?{_INT}|\d[\d_]*?{_INT}|\d[\d_]*?_*f(?:32|64)|\d[\d_]*\."
         r"|\d[\d_]*\.\d[\d_]*(?:f(?:32|64))?|\d[\d_]*(?:\.\d[\d_]*)?[eE][+-]?_*\d[\d_]*(?:f(?:32|64))?")


class RustCanon(Canon):
    def classify(self, tok: str) -> str:
        ch = tok[0]
        if ch == "'":
            return "s" if len(tok) > 2 and tok[-1] == "'" else "L" if len(tok) > 1 else "E"
        if tok.startswith("/*") and not tok.endswith("*/"):
            return "E"
        if tok.startswith("r#") and len(tok) > 2 and tok[2] != '"' and tok[-1] != '"':
            return "a"
        if '"' in tok[:6] and ch in "brc\"" and tok[1:2] != "'":
            body = tok.rstrip("#")
            return "s" if len(body) > tok.index('"') + 1 and body.endswith('"') and (tok.count("#", 0, tok.index('"')) == len(tok) - len(body)) else "E"
        if ch == "b" and tok[1:2] == "'":
            return "s"
        return super().classify(tok)


class RustParser(Parser):
    token = TOKEN
    canon = RustCanon(KEYWORDS, '"', ("//", "/*"), EXACT)
    simple = {"top": set(), "block": set(), "impl": set(), "trait": set()}
    heads = {"top": {}, "block": {}, "impl": {}, "trait": {}}
    sync = frozenset("fn struct enum trait impl mod use pub let if for while loop match return".split())

    def body(self, kind: str) -> None:
        if kind in ("impl", "trait"):
            self.statements("impl", "}")
            self.need("}")
        elif kind == "mod":
            self.statements("top", "}")
            self.need("}")
        else:
            self.statements("block", "}")
            self.need("}")
            if kind == "if":
                self.else_tail()
                self.after_block()

    def block(self) -> None:
        self.need("{")
        self.statements("block", "}")
        self.need("}")

    def else_tail(self) -> None:
        while self.t == "else":
            self.adv()
            if self.t == "if":
                self.adv()
                self.expr(struct=False)
                self.block()
            else:
                self.block()
                return

    def after_block(self) -> None:
        """A block expression at the start of a statement ends it unless it is read on as a value."""
        if self.t in (".", "?"):
            self.postfix(True)
            self.rest(0, True)
            self.end()

    def end(self) -> None:
        if self.t == ";":
            self.adv()
        elif self.t != "}":
            raise self.wrong("';'")

    def statement(self, ctx: str) -> str:
        at, first, t = self.i, self.j == 0, self.t
        if t == ";":
            self.adv()
            return "closed"
        inner = False
        while self.t == "#":
            inner = self.peek() == "!"
            self.attribute()
        t = self.t
        if t == "" or t == "}":
            if inner or ctx == "block":
                return "open"
            raise self.wrong("an item")
        if self.item(ctx, at, first):
            return "closed"
        if ctx != "block":
            raise self.wrong("an item")
        if t == "let":
            self.adv()
            self.patterns()
            if self.accept(":"):
                self.type()
            if self.accept("="):
                self.expr()
                if self.accept("else"):
                    self.block()
            self.need(";")
            return "closed"
        if t == "L" and self.peek() == ":":
            self.adv()
            self.adv()
            t = self.t
        if t in BLOCKY:
            if t == "if" or t == "while":
                self.adv()
                self.expr(struct=False)
                self.head(ctx, at, first, "if" if t == "if" else "block")
                self.block()
                if t == "if":
                    self.else_tail()
            elif t == "for":
                self.adv()
                self.patterns()
                self.need("in")
                self.expr(struct=False)
                self.head(ctx, at, first, "block")
                self.block()
            else:
                self.primary(True, False)
            self.after_block()
            return "open"
        self.expr()
        if self.t == ";":
            self.adv()
            return "closed"
        if self.t != "}" and self.last_braced:
            return "open"
        self.end()
        return "open"

    last_braced = False

    def attribute(self) -> None:
        self.need("#")
        self.accept("!")
        if self.t != "[":
            raise self.wrong("'['")
        self.balanced()

    def visibility(self) -> None:
        if self.accept("pub") and self.t == "(" and self.peek() in ("crate", "super", "self", "in"):
            self.balanced()

    def item(self, ctx: str, at: int, first: bool) -> bool:
        t = self.t
        if t == "pub":
            self.visibility()
            t = self.t
            must = True
        else:
            must = False
        m = self.mark()
        while self.t in ("const", "async", "unsafe", "extern", "a") and t != "a":
            if self.t == "const" and self.peek() not in ("fn", "async", "unsafe", "extern"):
                break
            if self.t in ("unsafe", "async") and self.peek() not in ("fn", "extern", "impl", "trait", "async", "unsafe"):
                break
            if self.t == "a":
                break
            ext = self.adv() == "extern"
            if ext and self.t == "s":
                self.adv()
            if ext and self.t == "{":
                self.need("{")
                self.statements("impl", "}")
                self.need("}")
                return True
            if ext and self.t == "crate":
                self.adv()
                self.adv()
                if self.accept("as"):
                    self.adv()
                self.need(";")
                return True
        t = self.t
        if t == "fn":
            self.adv()
            self.name()
            self.generics()
            self.need("(")
            self.fn_params()
            self.need(")")
            if self.accept("->"):
                self.type()
            self.where()
            if self.t == ";" and ctx != "block":
                self.adv()
                return True
            self.head(ctx, at, first, "block")
            self.block()
            return True
        if t == "use":
            self.adv()
            self.use_tree()
            self.need(";")
            return True
        if t == "struct" or t == "a" and self.peek() == "a" and self.peek(2) in ("{", "<", "where"):
            self.adv()
            self.name()
            self.generics()
            self.where()
            if self.t == "(":
                self.adv()
                while self.t != ")":
                    while self.t == "#":
                        self.attribute()
                    self.visibility()
                    self.type()
                    if not self.accept(","):
                        break
                self.need(")")
                self.where()
                self.need(";")
            elif not self.accept(";"):
                self.fields()
            return True
        if t == "enum":
            self.adv()
            self.name()
            self.generics()
            self.where()
            self.need("{")
            while self.t != "}":
                while self.t == "#":
                    self.attribute()
                self.visibility()
                self.name()
                if self.t == "(":
                    self.adv()
                    while self.t != ")":
                        while self.t == "#":
                            self.attribute()
                        self.type()
                        if not self.accept(","):
                            break
                    self.need(")")
                elif self.t == "{":
                    self.fields()
                if self.accept("="):
                    self.expr()
                if not self.accept(","):
                    break
            self.need("}")
            return True
        if t == "impl":
            self.adv()
            if self.t == "<":
                self.generics()
            self.accept("const")
            self.accept("!")
            self.type()
            if self.accept("for"):
                self.type()
            self.where()
            self.head(ctx, at, first, "impl")
            self.need("{")
            self.statements("impl", "}")
            self.need("}")
            return True
        if t == "trait":
            self.adv()
            self.name()
            self.generics()
            if self.accept(":"):
                self.bounds()
            self.where()
            self.head(ctx, at, first, "trait")
            self.need("{")
            self.statements("impl", "}")
            self.need("}")
            return True
        if t == "mod":
            self.adv()
            self.name()
            if not self.accept(";"):
                self.head(ctx, at, first, "mod")
                self.need("{")
                self.statements("top", "}")
                self.need("}")
            return True
        if t == "const" and self.peek() != "{" or t == "static":
            self.adv()
            self.accept("mut")
            if self.t == "a":
                self.adv()
            else:
                raise self.wrong("a name")
            if self.accept(":"):
                self.type()
            if self.accept("="):
                self.expr()
            self.need(";")
            return True
        if t == "type":
            self.adv()
            self.name()
            self.generics()
            if self.accept(":"):
                self.bounds()
            self.where()
            if self.accept("="):
                self.type()
                self.where()
            self.need(";")
            return True
        if must:
            raise self.wrong("an item")
        self.back(m)
        if ctx != "block" and t in ("a", "crate", "self", "super", "::") or t == "a" and self.peek() == "!" and self.peek(2) == "a":  # a macro call
            self.path_plain()
            self.need("!")
            if self.t == "a":
                self.adv()
            self.macro_body(True)
            return True
        return False

    def macro_body(self, item: bool) -> None:
        t = self.t
        if t not in ("(", "[", "{"):
            raise self.wrong("'('")
        self.balanced()
        if item and t != "{":
            self.need(";")

    def path_plain(self) -> None:
        self.accept("::")
        self.adv()
        while self.accept("::"):
            self.adv()

    def use_tree(self) -> None:
        if self.accept("::") and self.t not in ("a", "{", "*"):
            raise self.wrong()
        while True:
            if self.accept("*"):
                return
            if self.t == "{":
                self.adv()
                while self.t != "}":
                    self.use_tree()
                    if not self.accept(","):
                        break
                self.need("}")
                return
            if self.t not in ("a", "self", "super", "crate", "Self"):
                raise self.wrong("a path")
            self.adv()
            if self.accept("as"):
                self.name()
                return
            if not self.accept("::"):
                return

    def fields(self) -> None:
        self.need("{")
        while self.t != "}":
            while self.t == "#":
                self.attribute()
            self.visibility()
            self.name()
            self.need(":")
            self.type()
            if self.accept("="):
                self.expr()
            if not self.accept(","):
                break
        self.need("}")

    def fn_params(self) -> None:
        while self.t != ")":
            while self.t == "#":
                self.attribute()
            if self.accept("..."):
                pass
            else:
                m = self.mark()
                if self.t in ("&", "&&"):
                    self.adv()
                    if self.t == "L":
                        self.adv()
                self.accept("mut")
                if self.accept("self"):
                    if self.accept(":"):
                        self.type()
                else:
                    self.back(m)
                    self.patterns()
                    if self.t == ":":
                        self.adv()
                        if not self.accept("..."):
                            self.type()
                    else:
                        raise self.wrong("':'")
            if not self.accept(","):
                return

    # types
    def generics(self) -> None:
        if self.t != "<":
            return
        self.adv()
        while self.t not in (">", ">=", ">>"):
            while self.t == "#":
                self.attribute()
            if self.accept("const"):
                self.name()
                self.need(":")
                self.type()
            elif self.t == "L":
                self.adv()
                if self.accept(":"):
                    self.bounds()
            else:
                self.name()
                if self.accept(":"):
                    self.bounds()
            if self.accept("="):
                self.generic_value()
            if not self.accept(","):
                break
        self.close_angle()

    def generic_value(self) -> None:
        if self.t in ("0", "s", "true", "false", "-"):
            self.accept("-")
            self.adv()
        elif self.t == "{":
            self.block()
        else:
            self.type()

    def close_angle(self) -> None:
        t = self.t
        if t == ">":
            self.adv()
        elif t in (">>", ">=", ">>="):
            self.t = self.toks[self.j] = t[1:]
        else:
            raise self.wrong("'>'")

    def open_angle(self) -> bool:
        """Makes two brackets of "<<" where a type begins."""
        if self.t == "<<":
            self.toks = [*self.toks[:self.j], "<", "<", *self.toks[self.j + 1:]]
            self.t = "<"
        return self.t == "<"

    def angle_args(self) -> None:
        self.open_angle()
        self.need("<")
        while self.t not in (">", ">>", ">=", ">>="):
            if self.t == "L":
                self.adv()
            elif self.t == "a" and self.peek() in ("=", ":"):
                self.adv()
                if self.adv() == "=":
                    self.generic_value()
                else:
                    self.bounds()
            else:
                self.generic_value()
                if self.t == "=":  # Item<X> = T
                    self.adv()
                    self.type()
                elif self.t == ":":
                    self.adv()
                    self.bounds()
            if not self.accept(","):
                break
        self.close_angle()

    def where(self) -> None:
        if not self.accept("where"):
            return
        while self.t not in ("{", ";", "=", ""):
            if self.t == "L":
                self.adv()
            else:
                if self.accept("for"):
                    self.generics()
                self.type()
            self.need(":")
            self.bounds()
            if not self.accept(","):
                return

    def bounds(self) -> None:
        while self.t in ("a", "L", "?", "(", "for", "::", "crate", "self", "super", "Self", "dyn", "~", "fn", "use", "<", "<<"):
            if self.t == "L":
                self.adv()
            elif self.t == "use":
                self.adv()
                self.angle_args()
            elif self.t == "(":
                self.adv()
                self.bounds()
                self.need(")")
            else:
                self.accept("?")
                if self.accept("for"):
                    self.generics()
                self.type_path()
            if not self.accept("+"):
                return

    def type_path(self) -> None:
        if self.open_angle():
            self.qualified()
        else:
            self.accept("::")
            if self.t not in ("a", "crate", "self", "super", "Self"):
                raise self.wrong("a type")
            self.adv()
        while True:
            if self.t == "<" or self.t == "<<":
                self.angle_args()
            elif self.t == "::":
                self.adv()
                if self.open_angle():
                    self.angle_args()
                elif self.t in ("a", "crate", "self", "super", "Self"):
                    self.adv()
                else:
                    raise self.wrong("a name")
            elif self.t == "(":  # Fn(A) -> B
                self.adv()
                while self.t != ")":
                    self.type()
                    if not self.accept(","):
                        break
                self.need(")")
                if self.accept("->"):
                    self.type()
                return
            else:
                return

    def qualified(self) -> None:
        self.need("<")
        self.type()
        if self.accept("as"):
            self.type()
        self.close_angle()
        if self.t != "::":
            raise self.wrong("'::'")

    def type(self, sums: bool = True) -> None:
        self.depth += 1
        if self.depth > DEPTH:
            raise Wrong("nesting too deep", "nesting")
        t = self.t
        if t in ("&", "&&"):
            self.adv()
            if self.t == "L":
                self.adv()
            self.accept("mut")
            self.type()
        elif t == "*":
            self.adv()
            if self.t not in ("const", "mut"):
                raise self.wrong()
            self.adv()
            self.type()
        elif t == "(":
            self.adv()
            while self.t != ")":
                self.type()
                if not self.accept(","):
                    break
            self.need(")")
        elif t == "[":
            self.adv()
            self.type()
            if self.accept(";"):
                self.expr()
            self.need("]")
        elif t == "!":
            self.adv()
        elif t in ("dyn", "impl"):
            self.adv()
            self.bounds()
        elif t in ("fn", "unsafe", "extern", "for"):
            if self.accept("for"):
                self.generics()
            self.accept("unsafe")
            if self.accept("extern") and self.t == "s":
                self.adv()
            if self.accept("fn"):
                self.need("(")
                while self.t != ")":
                    if self.t == "a" and self.peek() == ":":
                        self.adv()
                        self.adv()
                    if not self.accept("..."):
                        self.type()
                    if not self.accept(","):
                        break
                self.need(")")
                if self.accept("->"):
                    self.type()
            else:
                self.type_path()
        else:
            self.type_path()
            if self.t == "!":
                self.adv()
                self.macro_body(False)
        while sums and self.t == "+" and self.peek() in ("a", "L", "?", "::", "for"):
            self.adv()
            self.bounds()
        self.depth -= 1

    # patterns
    def patterns(self) -> None:
        self.accept("|")
        self.pattern()
        while self.accept("|"):
            self.pattern()

    def pattern(self) -> None:
        t = self.t
        if t in ("&", "&&"):
            self.adv()
            self.accept("mut")
            self.pattern()
        elif t in ("ref", "mut"):
            self.adv()
            self.accept("mut")
            self.name()
            if self.accept("@"):
                self.pattern()
        elif t in ("(", "["):
            close = ")" if t == "(" else "]"
            self.adv()
            while self.t != close:
                self.patterns()
                if not self.accept(","):
                    break
            self.need(close)
        elif t in ("0", "s", "true", "false", "-"):
            self.literal_pattern()
            self.range_tail()
        elif t in ("..", "..=", "..."):
            self.adv()
            if self.t in ("0", "s", "-", "a"):
                self.literal_pattern()
        elif t == "const" and self.peek() == "{":
            self.adv()
            self.block()
        else:
            if t == "<":
                self.qualified()
            else:
                self.accept("::")
                if self.t not in ("a", "crate", "self", "super", "Self"):
                    raise self.wrong("a pattern")
                self.adv()
            while self.accept("::"):
                if self.t == "<":
                    self.angle_args()
                else:
                    self.adv()
            if self.t == "(":
                self.pattern()
            elif self.t == "{":
                self.adv()
                while self.t != "}":
                    while self.t == "#":
                        self.attribute()
                    if self.accept(".."):
                        break
                    if self.t in ("a", "0") and self.peek() == ":":
                        self.adv()
                        self.adv()
                        self.patterns()
                    else:
                        self.accept("ref")
                        self.accept("mut")
                        self.name()
                        if self.accept("@"):
                            self.pattern()
                    if not self.accept(","):
                        break
                self.need("}")
            elif self.t == "!":
                self.adv()
                self.macro_body(False)
            elif self.accept("@"):
                self.pattern()
            else:
                self.range_tail()

    def literal_pattern(self) -> None:
        self.accept("-")
        if self.t not in ("0", "s", "true", "false", "a", "crate", "self", "Self", "super"):
            raise self.wrong("a value")
        self.adv()
        while self.accept("::"):
            self.adv()

    def range_tail(self) -> None:
        if self.t in ("..", "..=", "..."):
            self.adv()
            if self.t in ("0", "s", "-", "a", "crate", "Self"):
                self.literal_pattern()

    # expressions
    def expr(self, struct: bool = True) -> None:
        self.depth += 1
        if self.depth > DEPTH:
            raise Wrong("nesting too deep", "nesting")
        self.last_braced = False
        if self.t in ("..", "..="):
            self.adv()
            if self.t in STARTS and not (self.t == "{" and not struct):
                self.binary(1, struct)
        else:
            self.binary(1, struct)
        self.rest(0, struct)
        self.depth -= 1

    def rest(self, least: int, struct: bool) -> None:
        """What may follow an operand: binary operators, a range, an assignment."""
        self.operators(1, struct)
        if self.t in ("..", "..="):
            self.adv()
            if self.t in STARTS and not (self.t == "{" and not struct):
                self.binary(1, struct)
            self.last_braced = False
        if self.t in ASSIGN:
            self.adv()
            self.expr(struct)
            self.last_braced = False

    def binary(self, least: int, struct: bool) -> None:
        self.unary(struct)
        self.operators(least, struct)

    def operators(self, least: int, struct: bool) -> None:
        while True:
            t = self.t
            if t == "as":
                self.adv()
                self.type(False)
                continue
            p = BINARY.get(t, 0)
            if p < least or not p:
                return
            self.adv()
            self.last_braced = False
            self.binary(p + 1, struct)

    def unary(self, struct: bool) -> None:
        while self.t in ("-", "!", "*", "&", "&&"):
            amp = self.adv() in ("&", "&&")
            if amp:
                if self.t == "a" and self.peek() in ("mut", "const"):
                    self.adv()
                    self.adv()
                self.accept("mut")
        self.primary(struct)

    def postfix(self, struct: bool) -> None:
        while True:
            t = self.t
            if t == "?":
                self.adv()
            elif t == ".":
                self.adv()
                if self.t in ("a", "await"):
                    self.adv()
                    if self.t == "::":
                        self.adv()
                        self.angle_args()
                elif self.t == "0":
                    self.adv()
                else:
                    raise self.wrong("a field")
            elif t == "(":
                self.adv()
                self.values(")")
            elif t == "[":
                self.adv()
                self.expr()
                self.need("]")
            else:
                return
            self.last_braced = False

    def values(self, close: str) -> None:
        while self.t != close:
            while self.t == "#":
                self.attribute()
            self.expr()
            if not self.accept(","):
                break
        self.need(close)

    def primary(self, struct: bool, post: bool = True) -> None:
        self.depth += 1
        if self.depth > DEPTH:
            raise Wrong("nesting too deep", "nesting")
        t = self.t
        braced = False
        if t in ("0", "s", "true", "false"):
            self.adv()
        elif t == "(":
            self.adv()
            self.values(")")
        elif t == "[":
            self.adv()
            if self.t != "]":
                self.expr()
                if self.accept(";"):
                    self.expr()
                    self.need("]")
                else:
                    if self.accept(","):
                        self.values("]")
                    else:
                        self.need("]")
            else:
                self.adv()
        elif t == "{":
            self.block()
            braced = True
        elif t in ("a", "self", "Self", "crate", "super", "::", "<", "<<"):
            self.path_expr(struct)
            braced = self.last_braced
        elif t == "if":
            self.adv()
            self.expr(struct=False)
            self.block()
            self.else_tail()
            braced = True
        elif t == "let":
            self.adv()
            self.patterns()
            self.need("=")
            self.unary(False)
            self.operators(3, False)
        elif t == "match":
            self.adv()
            self.expr(struct=False)
            self.need("{")
            while self.t != "}":
                while self.t == "#":
                    self.attribute()
                if self.t == "}":
                    break
                self.patterns()
                if self.accept("if"):
                    self.expr()
                self.need("=>")
                block = self.t in ("{", "if", "match", "loop", "while", "for", "unsafe")
                if block:
                    self.primary(True, False)
                    if self.t in (".", "?"):
                        self.postfix(True)
                        block = False
                    self.rest(0, True) if self.t in ASSIGN or self.t in BINARY and self.t not in ("&", "&&", "*", "-", "|", "||", "<") or self.t in ("as", "..", "..=") else None
                else:
                    self.expr()
                if not self.accept(",") and not (block or self.last_braced) and self.t != "}":
                    raise self.wrong("','")
            self.need("}")
            braced = True
        elif t in ("loop", "unsafe"):
            self.adv()
            self.block()
            braced = True
        elif t == "const" and self.peek() == "{":
            self.adv()
            self.block()
            braced = True
        elif t == "while":
            self.adv()
            self.expr(struct=False)
            self.block()
            braced = True
        elif t == "for":
            self.adv()
            if self.t == "<":
                self.generics()
                self.closure(struct)
            else:
                self.patterns()
                self.need("in")
                self.expr(struct=False)
                self.block()
                braced = True
        elif t == "async":
            self.adv()
            self.accept("move")
            if self.t == "{":
                self.block()
                braced = True
            else:
                self.closure(struct)
        elif t in ("move", "|", "||", "static"):
            self.closure(struct)
        elif t == "L":
            self.adv()
            self.need(":")
            self.primary(struct)
            braced = True
        elif t in ("return", "break", "continue"):
            self.adv()
            if t != "return" and self.t == "L":
                self.adv()
            if self.t in STARTS and t != "continue" and not (self.t == "{" and not struct):
                self.expr(struct)
        elif t == "#":
            self.attribute()
            self.primary(struct)
        else:
            raise self.wrong("a value")
        self.depth -= 1
        at = self.i, self.j
        if post:
            self.postfix(struct)
        self.last_braced = braced and at == (self.i, self.j)

    def closure(self, struct: bool) -> None:
        self.accept("static")
        self.accept("move")
        if not self.accept("||"):
            self.need("|")
            while self.t != "|":
                self.pattern()
                if self.accept(":"):
                    self.type()
                if not self.accept(","):
                    break
            self.need("|")
        if self.accept("->"):
            self.type()
            self.block()
        else:
            self.expr(struct)

    def path_expr(self, struct: bool) -> None:
        self.last_braced = False
        if self.open_angle():
            self.qualified()
        else:
            self.accept("::")
            if self.t not in ("a", "self", "Self", "crate", "super"):
                raise self.wrong("a name")
            self.adv()
        while self.t == "::":
            self.adv()
            if self.open_angle():
                self.angle_args()
            elif self.t in ("a", "self", "Self", "crate", "super"):
                self.adv()
            else:
                raise self.wrong("a name")
        if self.t == "!" and self.peek() in ("(", "[", "{"):
            self.adv()
            braces = self.t == "{"
            self.balanced()
            self.last_braced = braces
        elif self.t == "{" and struct and (self.peek() == "}" or self.peek() in ("a", "0") and self.peek(2) in (":", ",", "}") or self.peek() in ("..", "#")):
            self.adv()
            while self.t != "}":
                while self.t == "#":
                    self.attribute()
                if self.accept(".."):
                    if self.t != "}":
                        self.expr()
                    break
                if self.t not in ("a", "0"):
                    raise self.wrong("a field")
                self.adv()
                if self.accept(":"):
                    self.expr()
                if not self.accept(","):
                    break
            self.need("}")
