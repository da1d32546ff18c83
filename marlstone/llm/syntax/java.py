"""Java, up to records, sealed types, pattern matching and text blocks."""

from __future__ import annotations

from marlstone.llm.syntax.base import CONFLICT, DEPTH, NAME, DOTTED, Canon, Parser, Wrong, tokens

# Reserved words.
KEYWORDS = frozenset("""abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally
float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super
switch synchronized this throw throws transient try void volatile while true false null""".split())
PRIMITIVE = frozenset("boolean byte char short int long float double".split())
MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default".split())
_OPS = r">>>=|<<=|>>=|>>>|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|>>"
TOKEN = tokens(CONFLICT, r"//[^\n]*", r"/\*(?:[^*]|\*(?!/))*(?:\*/)?", r"\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*(?:\"\"\")?", r"\"(?:[^\"\\\n]|\\[^\n])*\"?", r"'(?:[^'\\\n]|\\[^\n])+'?", DOTTED, rf"(?:{NAME}|\$[\w$]*)", _OPS)
BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "<<": 8, ">>": 8, ">>>": 8,
          "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
ASSIGN = frozenset("= += -= *= /= &= |= ^= %= <<= >>= >>>=".split())


EXACT = (r"0[xX][0-9a-fA-F](?:_*[0-9a-fA-F])*[lL]?|0[bB][01](?:_*[01])*[lL]?|0(?:_*[0-7])*[lL]?|[1-9](?:_*\d)*[lL]?|\d(?:_*\d)*[fFdD]"
         r"|(?:\d(?:_*\d)*\.(?:\d(?:_*\d)*)?|\.\d(?:_*\d)*)(?:[eE][+-]?\d(?:_*\d)*)?[fFdD]?|\d(?:_*\d)*[eE][+-]?\d(?:_*\d)*[fFdD]?|0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*[pP][+-]?\d+[fFdD]?")


class JavaCanon(Canon):
    def classify(self, tok: str) -> str:
        if tok.startswith('"""'):
            return "s" if len(tok) >= 6 and tok.endswith('"""') else "E"
        if tok.startswith("/*") and (not tok.endswith("*/") or len(tok) < 4):
            return "E"
        return super().classify(tok)


class JavaParser(Parser):
    token = TOKEN
    canon = JavaCanon(KEYWORDS, "\"'", ("//", "/*"), EXACT)
    simple = {"top": set(), "class": set(), "block": set()}
    heads = {"top": {}, "class": {}, "block": {}}
    sync = frozenset("public private protected static class interface enum if for while return try switch import".split())

    def body(self, kind: str) -> None:
        self.statements("class" if kind == "class" else "block", "}")
        self.need("}")
        if kind == "if":
            self.else_tail()
        elif kind == "try":
            self.catch_tail(False)

    def block(self) -> None:
        self.need("{")
        self.statements("block", "}")
        self.need("}")

    def else_tail(self) -> None:
        if self.accept("else"):
            self.nested()

    def catch_tail(self, optional: bool) -> None:
        some = optional
        while self.accept("catch"):
            some = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.accept("|"):
                self.type()
            self.name()
            self.need(")")
            self.block()
        if self.accept("finally"):
            some = True
            self.block()
        if not some:
            raise self.wrong("'catch'")

    def nested(self) -> None:
        self.statement("block")

    def statement(self, ctx: str) -> str:
        at, first, t = self.i, self.j == 0, self.t
        if t == ";":
            self.adv()
            return "closed"
        if ctx == "top":
            return self.top(at, first)
        if ctx == "class":
            return self.member(at, first)
        if t == "{":
            self.block()
            return "closed"
        if t == "if" or t == "while" or t == "synchronized" and self.peek() == "(":
            self.adv()
            self.need("(")
            self.expr()
            self.need(")")
            self.head(ctx, at, first, "if" if t == "if" else "block")
            if t == "synchronized":
                self.block()
            else:
                self.nested()
            if t == "if":
                self.else_tail()
            return "open"
        if t == "for":
            self.adv()
            self.need("(")
            if self.t != ";":
                if self.local():
                    if self.accept(":"):
                        self.expr()
                        self.need(")")
                        self.head(ctx, at, first, "block")
                        self.nested()
                        return "open"
                else:
                    self.exprs()
            self.need(";")
            if self.t != ";":
                self.expr()
            self.need(";")
            if self.t != ")":
                self.exprs()
            self.need(")")
            self.head(ctx, at, first, "block")
            self.nested()
            return "open"
        if t == "do":
            self.adv()
            self.nested()
            self.need("while")
            self.need("(")
            self.expr()
            self.need(")")
            self.need(";")
            return "closed"
        if t == "try":
            self.adv()
            resources = self.t == "("
            if resources:
                self.adv()
                while self.t != ")":
                    if not self.local():
                        self.expr()
                    if not self.accept(";"):
                        break
                self.need(")")
            else:
                self.head(ctx, at, first, "try")
            self.block()
            self.catch_tail(resources)
            return "open"
        if t == "switch":
            self.switch()
            if self.t == ".":
                self.postfix()
                self.need(";")
            return "open"
        if t in ("return", "throw"):
            self.adv()
            if t == "throw" or self.t != ";":
                self.expr()
            self.need(";")
            return "closed"
        if t in ("break", "continue"):
            self.adv()
            if self.t == "a":
                self.adv()
            self.need(";")
            return "closed"
        if t == "assert":
            self.adv()
            self.expr()
            if self.accept(":"):
                self.expr()
            self.need(";")
            return "closed"
        if t == "a" and self.peek() == ":":
            self.adv()
            self.adv()
            self.nested()
            return "open"
        if t in ("class", "interface", "enum", "abstract", "static", "@") or t == "final" or t == "a" and self.peek() == "a" and self.peek(2) in ("(", "<", "{") and self.declares_type():
            m = self.mark()
            self.modifiers()
            if self.t in ("class", "interface", "enum", "@") or self.t == "a" and self.peek() == "a" and self.peek(2) in ("(", "<", "{"):
                self.type_declaration(ctx, at, first)
                return "closed"
            self.back(m)
        if self.local():
            self.need(";")
            return "closed"
        if t == "a" and self.peek() not in (".", "(", "[", "=", "::", "++", "--", "<") and self.peek() not in ASSIGN and self.peek() not in BINARY and self.peek() != ";":
            # yield: a word before a value
            self.adv()
            self.expr()
            self.need(";")
            return "closed"
        self.kind = ""
        self.expr()
        if self.kind not in ("call", "assign", "step", "new"):
            raise Wrong("not a statement")
        self.need(";")
        return "closed"

    kind = ""

    def declares_type(self) -> bool:
        # record Name(...) {, sealed Name — told from a method call by the second name
        k = 3
        if self.peek(2) == "{":
            return True
        nest = 1
        if self.peek(2) == "<":
            return False
        while nest:
            t = self.peek(k)
            if t == "":
                return False
            nest += (t == "(") - (t == ")")
            k += 1
        return self.peek(k) in ("{", "implements")

    def top(self, at: int, first: bool) -> str:
        m = self.mark()
        self.modifiers()
        t = self.t
        if t == "package" or t == "import":
            self.adv()
            if t == "import":
                self.accept("static")
            self.name()
            while self.accept("."):
                if t == "import" and self.accept("*"):
                    break
                self.name()
            self.need(";")
            return "closed"
        if t == "a" and self.peek() == "a" and self.peek(2) in (".", "{") or t == "a" and self.peek() == "a" and self.peek(2) == "a":
            # a module declaration
            self.adv()
            while self.t == "a" or self.t == ".":
                self.adv()
            if self.t == "{":
                self.balanced()
                return "closed"
            self.back(m)
            self.modifiers()
        self.type_declaration("top", at, first)
        return "closed"

    def annotation(self) -> None:
        self.need("@")
        self.name()
        while self.accept("."):
            self.name()
        if self.accept("("):
            while self.t != ")":
                if self.t == "a" and self.peek() == "=":
                    self.adv()
                    self.adv()
                self.element_value()
                if not self.accept(",") or self.t == ")":
                    break
            self.need(")")

    def modifiers(self) -> None:
        while True:
            if self.t == "@" and self.peek() != "interface":
                self.annotation()
            elif self.t in MODIFIERS:
                if self.t == "default" and self.peek() in (":", "->"):
                    return
                if self.t == "synchronized" and self.peek() == "(":
                    return
                self.adv()
            elif self.t == "a" and self.peek() in ("class", "interface", "abstract") :  # sealed
                self.adv()
            elif self.t == "a" and self.peek() == "-" and self.peek(2) == "a" and self.peek(3) in ("class", "interface", "abstract", "static", "final"):  # non-sealed
                self.adv()
                self.adv()
                self.adv()
            else:
                return

    def type_list(self) -> None:
        while True:
            self.type()
            if not self.accept(","):
                return

    def type_declaration(self, ctx: str, at: int, first: bool) -> None:
        t = self.t
        if t == "@":
            self.adv()
            t = self.t
        if t in ("class", "interface"):
            self.adv()
            self.name()
            self.type_params()
        elif t == "enum":
            self.adv()
            self.name()
            if self.accept("implements"):
                self.type_list()
            self.need("{")
            self.enum_body()
            return
        elif t == "a" and self.peek() == "a":  # record
            self.adv()
            self.name()
            self.type_params()
            if self.t != "(":
                raise self.wrong("a class")
            self.params()
        else:
            raise self.wrong("a class")
        if self.accept("extends"):
            self.type_list()
        if self.accept("implements"):
            self.type_list()
        if self.t == "a":  # permits
            self.adv()
            self.type_list()
        self.head(ctx, at, first, "class")
        self.class_body()

    def class_body(self) -> None:
        self.need("{")
        self.statements("class", "}")
        self.need("}")

    def enum_body(self) -> None:
        while self.t not in (";", "}"):
            while self.t == "@":
                self.annotation()
            self.name()
            if self.t == "(":
                self.args()
            if self.t == "{":
                self.class_body()
            if not self.accept(","):
                break
        if self.accept(";"):
            self.statements("class", "}")
        self.need("}")

    def member(self, at: int, first: bool) -> str:
        if self.t == "{" or self.t == "static" and self.peek() == "{":
            self.accept("static")
            self.block()
            return "closed"
        self.modifiers()
        t = self.t
        if t in ("class", "interface", "enum", "@"):
            self.type_declaration("class", at, first)
            return "closed"
        if t == "<":
            self.type_params()
            while self.t == "@":
                self.annotation()
        if self.t == "a" and self.peek() == "(":
            self.adv()
            self.method_rest(at, first)
            return "closed"
        if self.t == "a" and self.peek() == "{":  # compact constructor of a record
            self.adv()
            self.block()
            return "closed"
        self.returns_name = self.t == "a" and self.peek() == "a"
        if self.t == "void":
            self.adv()
        else:
            self.type()
        self.name()
        if self.t == "(":
            self.method_rest(at, first)
            return "closed"
        self.declarator_rest()
        self.need(";")
        return "closed"

    def method_rest(self, at: int, first: bool) -> None:
        self.params()
        self.dims()
        if self.accept("throws"):
            self.type_list()
        if self.accept("default"):
            self.element_value()
        if self.accept(";"):
            return
        if self.accept("implements"):
            self.type_list()
            self.class_body()
            return
        # the classes alone can't tell a record from a method with such parameters; its body may hold members
        m, depth, found = self.mark(), self.depth, len(self.found)
        self.head("class", at, first, "block")
        self.block()
        if len(self.found) > found and self.returns_name:
            after = self.mark()
            seen, self.found[found:] = self.found[found:], []
            self.back(m)
            self.depth = depth
            self.class_body()
            if len(self.found) > found:
                self.back(after)
                self.found[found:] = seen
            else:
                self.heads["class"].pop(self.lines[at], None)

    #: Whether the member just read began with a plain name, as a record does.
    returns_name = False

    def element_value(self) -> None:
        if self.t == "@":
            self.annotation()
        elif self.accept("{"):
            while self.t != "}":
                self.element_value()
                if not self.accept(","):
                    break
            self.need("}")
        else:
            self.expr()

    def params(self) -> None:
        self.need("(")
        while self.t != ")":
            self.modifiers()
            self.type()
            while self.t == "@":
                self.annotation()
            self.accept("...")
            if self.t == "this":
                self.adv()
            else:
                self.name()
                if self.t == "." and self.peek() == "this":
                    self.adv()
                    self.adv()
            self.dims()
            if not self.accept(","):
                break
            if self.t == ")":
                raise self.wrong("a parameter")
        self.need(")")

    def dims(self) -> None:
        while self.t == "[" and self.peek() == "]":
            self.adv()
            self.adv()

    def type_params(self) -> None:
        if self.t != "<":
            return
        self.adv()
        while True:
            while self.t == "@":
                self.annotation()
            self.name()
            if self.accept("extends"):
                self.type()
                while self.accept("&"):
                    self.type()
            if not self.accept(","):
                break
        self.close_angle()

    def close_angle(self) -> None:
        t = self.t
        if t == ">":
            self.adv()
        elif t in (">>", ">>>", ">=", ">>=", ">>>="):
            self.toks = [*self.toks[:self.j], ">", t[1:], *self.toks[self.j + 1:]]
            self.t = ">"
            self.adv()
        else:
            raise self.wrong("'>'")

    def type_args(self) -> None:
        self.need("<")
        if self.t != ">":
            while True:
                while self.t == "@":
                    self.annotation()
                if self.accept("?"):
                    if self.accept("extends") or self.accept("super"):
                        self.type()
                else:
                    self.type()
                if not self.accept(","):
                    break
        self.close_angle()

    def type(self) -> None:
        while self.t == "@":
            self.annotation()
        if self.t in PRIMITIVE:
            self.adv()
        else:
            self.name()
            if self.t == "<":
                self.type_args()
            while self.t == "." and self.peek() in ("a", "@"):
                self.adv()
                while self.t == "@":
                    self.annotation()
                self.name()
                if self.t == "<":
                    self.type_args()
        while self.t == "@":
            self.annotation()
        self.dims()

    def local(self) -> bool:
        """A local variable declaration without its end, if this is one."""
        t = self.t
        if t in ("final", "@"):
            self.modifiers()
            self.type()
        elif t in PRIMITIVE:
            if self.peek() in (".", "::") or self.peek() == "[" and self.peek(2) == "]" and self.peek(3) in ("::", "."):
                return False
            self.type()
        elif t == "a":
            p = self.peek()
            if p not in ("a", "<", ".", "[", "@"):
                return False
            m = self.mark()
            try:
                self.type()
                if self.t != "a" or self.peek() not in ("=", ";", ":", ",", "[", ")"):
                    raise Wrong("")
            except Wrong:
                self.back(m)
                return False
        else:
            return False
        self.name()
        self.declarator_rest()
        return True

    def declarator_rest(self) -> None:
        while True:
            self.dims()
            if self.accept("="):
                if self.t == "{":
                    self.array()
                else:
                    self.expr()
            if not self.accept(","):
                return
            self.name()

    def array(self) -> None:
        self.need("{")
        while self.t != "}":
            if self.t == "{":
                self.array()
            else:
                self.expr()
            if not self.accept(","):
                break
        self.need("}")

    # expressions
    def exprs(self) -> None:
        self.expr()
        while self.accept(","):
            self.expr()

    def expr(self) -> None:
        self.depth += 1
        if self.depth > DEPTH:
            raise Wrong("nesting too deep", "nesting")
        if (self.t == "a" and self.peek() == "->") or self.t == "(" and self.lambda_here():
            if self.t == "a":
                self.adv()
            else:
                self.lambda_params()
            self.need("->")
            if self.t == "{":
                self.block()
            else:
                self.expr()
            self.kind = "lambda"
        else:
            self.binary(1)
            if self.accept("?"):
                self.expr()
                self.need(":")
                self.expr()
                self.kind = "value"
            elif self.t in ASSIGN:
                if self.kind not in ("name", "field", "index"):
                    raise self.wrong()
                self.adv()
                self.expr()
                self.kind = "assign"
        self.depth -= 1

    def lambda_here(self) -> bool:
        k, nest = 1, 1
        while nest:
            t = self.peek(k)
            if t in ("", ";", "{", "}"):
                return False
            nest += (t == "(") - (t == ")")
            k += 1
        return self.peek(k) == "->"

    def lambda_params(self) -> None:
        m = self.mark()
        try:
            self.params()
        except Wrong:
            self.back(m)
            self.adv()
            while self.t != ")":
                self.name()
                if not self.accept(","):
                    break
            self.need(")")

    def binary(self, least: int) -> None:
        self.unary()
        while (p := BINARY.get(self.t, 0)) >= least and p:
            if self.adv() == "instanceof":
                self.accept("final")
                self.pattern()
            else:
                self.binary(p + 1)
            self.kind = "value"

    def pattern(self) -> None:
        self.modifiers()
        self.type()
        if self.t == "(":
            self.adv()
            while self.t != ")":
                self.pattern()
                if not self.accept(","):
                    break
            self.need(")")
        if self.t == "a" and self.peek() != "->":
            self.adv()
        elif self.t == "a":
            self.adv()

    def unary(self) -> None:
        t = self.t
        if t in ("+", "-", "!", "~", "++", "--"):
            self.adv()
            self.unary()
            self.kind = "step" if t in ("++", "--") else "value"
            return
        if t == "(" and self.cast():
            self.kind = "value"
            return
        self.postfix()

    def cast(self) -> bool:
        p = self.peek()
        if p not in PRIMITIVE and p != "a" and p != "@":
            return False
        m, depth = self.mark(), self.depth
        try:
            self.adv()
            plain = self.t in PRIMITIVE
            self.type()
            while self.accept("&"):
                self.type()
            if self.t != ")":
                raise Wrong("")
            self.adv()
            if not (plain or self.t in ("a", "0", "s", "(", "!", "~", "this", "super", "new", "true", "false", "null", "switch") or self.t in PRIMITIVE):
                raise Wrong("")
        except Wrong:
            self.back(m)
            self.depth = depth
            return False
        if (self.t == "a" and self.peek() == "->") or self.t == "(" and self.lambda_here():
            self.expr()
        else:
            self.unary()
        return True

    def args(self) -> None:
        self.need("(")
        if self.t != ")":
            self.exprs()
        self.need(")")

    def postfix(self) -> None:
        self.primary()
        while True:
            t = self.t
            if t == ".":
                self.adv()
                if self.t == "<":
                    self.type_args()
                if self.t == "new":
                    self.adv()
                    self.creator()
                    self.kind = "new"
                elif self.t in ("a", "this", "super", "class"):
                    self.adv()
                    self.kind = "field"
                else:
                    raise self.wrong("a name")
            elif t == "(":
                if self.kind not in ("name", "field", "self"):
                    raise self.wrong()
                self.args()
                self.kind = "call"
            elif t == "[":
                self.adv()
                if self.t == "]":
                    self.adv()
                    self.dims()
                    if self.t not in (".", "::"):
                        raise self.wrong("'.'")
                else:
                    self.expr()
                    self.need("]")
                self.kind = "index"
            elif t in ("++", "--"):
                self.adv()
                self.kind = "step"
            elif t == "::":
                self.adv()
                if self.t == "<":
                    self.type_args()
                if self.t not in ("a", "new"):
                    raise self.wrong("a name")
                self.adv()
                self.kind = "value"
            elif t == "<" and self.kind in ("name", "field"):
                m, depth, kind = self.mark(), self.depth, self.kind
                try:
                    self.type_args()
                    self.dims()
                    if self.t not in ("::",) and not (self.t == "." and self.peek() in ("a",) and self.peek(2) == "::"):
                        raise Wrong("")
                except Wrong:
                    self.back(m)
                    self.depth, self.kind = depth, kind
                    return
            else:
                return

    def primary(self) -> None:
        t = self.t
        if t == "a":
            self.adv()
            self.kind = "name"
        elif t in ("0", "s", "true", "false", "null"):
            self.adv()
            self.kind = "value"
        elif t in ("this", "super"):
            self.adv()
            self.kind = "self"
        elif t == "(":
            self.adv()
            self.expr()
            self.need(")")
            self.kind = "field" if self.kind in ("name", "field", "index") else "value"
        elif t == "new":
            self.adv()
            self.creator()
            self.kind = "new"
        elif t == "switch":
            self.switch()
            self.kind = "value"
        elif t in PRIMITIVE or t == "void":
            self.adv()
            self.dims()
            if self.t not in (".", "::"):
                raise self.wrong("'.'")
            self.kind = "value"
        elif t == "@":
            self.annotation()
            self.primary()
        else:
            raise self.wrong("a value")

    def creator(self) -> None:
        if self.t == "<":
            self.type_args()
        while self.t == "@":
            self.annotation()
        if self.t in PRIMITIVE:
            self.adv()
        else:
            self.name()
            if self.t == "<":
                self.type_args()
            while self.accept("."):
                self.name()
                if self.t == "<":
                    self.type_args()
        if self.t == "[":
            while self.t == "[":
                self.adv()
                if self.t != "]":
                    self.expr()
                self.need("]")
            if self.t == "{":
                self.array()
            return
        self.args()
        if self.t == "{":
            self.class_body()

    def switch(self) -> None:
        self.need("switch")
        self.need("(")
        self.expr()
        self.need(")")
        self.need("{")
        while self.t in ("case", "default"):
            if self.adv() == "case":
                while True:
                    m, depth = self.mark(), self.depth
                    try:
                        self.pattern()
                        if self.t not in ("->", ":", ",", "a"):
                            raise Wrong("")
                    except Wrong:
                        self.back(m)
                        self.depth = depth
                        if not self.accept("default"):
                            self.binary(1)
                            if self.accept("?"):
                                self.expr()
                                self.need(":")
                                self.expr()
                    else:
                        if self.accept("a"):  # a guard
                            self.expr()
                    if not self.accept(","):
                        break
            if self.accept("->"):
                if self.t == "{":
                    self.block()
                elif self.t == "throw":
                    self.statement("block")
                else:
                    self.expr()
                    self.need(";")
            else:
                self.need(":")
                while self.t not in ("case", "}", "") and not (self.t == "default" and self.peek() in (":", "->")):
                    self.statement("block")
        self.need("}")
