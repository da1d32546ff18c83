"""JavaScript (scripts, modules, CommonJS) and TypeScript."""

from __future__ import annotations

import re

from marlstone.llm.syntax.base import CONFLICT, DEPTH, DOTTED, Canon, Parser, Problem, Wrong, tokens

# Reserved words.
KEYWORDS = frozenset("""await break case catch class const continue debugger default delete do else enum export extends false finally for function
if import in instanceof new null return super switch this throw true try typeof var void while with yield""".split())
#: Words that mean something only where they stand; elsewhere they are names.
SOFT = frozenset("let async of get set static as from type interface namespace module declare abstract readonly keyof infer is asserts satisfies public private protected override unique global accessor out using".split())
_REGEX = r"/(?![/*])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*"
_BEFORE = "".join(f"(?<=[(,=:\\[!&|?{{}};+\\-*%<>~^\\n]{' ' * k})|" for k in range(0, 3)) + r"(?<=return )|(?<=return)|(?<=typeof )|(?<=case )|(?<![^\n]\n)(?<=\n)"
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|\{(?:[^{}`]|\{[^{}`]*\})*\}|`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{[^{}`]*\})*`)*\})*`?"
_OPS = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*"
TOKEN = tokens(CONFLICT, r"//[^\n]*", r"/\*(?:[^*]|\*(?!/))*(?:\*/)?", f"(?:{_BEFORE}){_REGEX}", rf"\n[ \t]*(?!/=){_REGEX}(?=[.,;)\s])", _TEMPLATE, r"\"(?:[^\"\\\n]|\\\r?\n|\\[^\n])*\"?", r"'(?:[^'\\\n]|\\\r?\n|\\[^\n])*'?",
               DOTTED, r"#?(?:[^\W\d]|\$|\\u\{?[0-9a-fA-F]+\}?)(?:[\w$]|\\u\{?[0-9a-fA-F]+\}?)*", _OPS, r"^#![^\n]*")
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8,
          "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 13}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
PREFIX = frozenset("! ~ + - ++ -- typeof void delete".split())
NAMES = SOFT | {"a"}
WORDS = KEYWORDS | NAMES
MODIFIERS = frozenset("public private protected static readonly abstract override declare async accessor".split())


EXACT = (r"0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|0[0-7]+|0\d*[89]\d*(?:\.\d*)?(?:[eE][+-]?\d+)?|(?:0|[1-9](?:_?\d)*)n"
         r"|(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?(?:[eE][+-]?\d(?:_?\d)*)?|\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?")


class ScriptCanon(Canon):
    def classify(self, tok: str) -> str:
        ch = tok[0]
        if ch == "\n" and len(tok) > 1:
            return "\n s"
        if ch == "/" and len(tok) > 1 and (tok[1] not in "/*=" or len(tok) > 2 and tok[1] == "="):
            return "s"
        if ch == "#" and tok[1:2] == "!":
            return ""
        if ch == "#" and len(tok) > 1 or ch == "\\" and len(tok) > 1:
            return "#" if ch == "#" else "a"
        if tok.startswith("/*") and (not tok.endswith("*/") or len(tok) < 4):
            return "E"
        if ch == "`" and len(tok) > 1 and tok[-1] == "`":
            return "s" if "${" not in tok or templates_parse(tok) else "X"
        return super().classify(tok)


_BITS = re.compile(r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|[`{}]")


def flat_templates(text: str) -> str:
    """``text`` with templates of any nesting made plain; the line ends in them stay."""
    out, at = [], 0
    for m in _BITS.finditer(text):
        if m[0] == "`" and m.start() >= at:
            end = _template_end(text, m.start())
            good = text[end - 1] == "`" and end > m.start() + 1 and templates_parse(text[m.start():end])
            out += [text[at:m.start()], "`", "\n" * text.count("\n", m.start(), end), "`" if good else "` \\ "]
            at = end
    return "".join([*out, text[at:]])


def templates_parse(tok: str) -> bool:
    """Do the expressions of a whole template parse?"""
    i, n = 1, len(tok) - 1
    while i < n:
        if tok[i] == "\\":
            i += 2
        elif tok.startswith("${", i):
            end = _hole_end(tok, i + 2)
            if end > n or not expression_parses(tok[i + 2:end - 1]):
                return False
            i = end
        else:
            i += 1
    return True


def expression_parses(text: str) -> bool:
    p = TypeScriptParser(text)
    try:
        p.comma()
    except Wrong:
        return "${" in text and (flat := flat_templates(text)) != text and expression_parses(flat)
    return p.t == ""


def _hole_end(text: str, i: int) -> int:
    """Behind the brace that ends the expression which begins at ``i``; beyond the text if none does."""
    depth, n = 1, len(text)
    while i < n:
        m = _BITS.search(text, i)
        if not m:
            break
        i = m.end()
        if m[0] == "`":
            i = _template_end(text, m.start())
        elif m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return i
    return n + 1


def _template_end(text: str, start: int) -> int:
    i, n = start + 1, len(text)
    while i < n:
        ch = text[i]
        if ch == "\\":
            i += 2
        elif ch == "`":
            return i + 1
        elif text.startswith("${", i):
            i = min(_hole_end(text, i + 2), n)
        else:
            i += 1
    return n


class JavaScriptParser(Parser):
    token = TOKEN
    canon = ScriptCanon(KEYWORDS | SOFT, "\"'`", ("//", "/*"), EXACT)
    simple = {"top": set(), "block": set(), "class": set()}
    heads = {"top": {}, "block": {}, "class": {}}
    sync = frozenset("const let var function class if for while return import export switch try throw".split())
    types = False
    no_in = False

    def run(self) -> list[Problem]:
        found = super().run()
        if found and "${" in self.text and (flat := flat_templates(self.text)) != self.text:
            return super(JavaScriptParser, type(self)(flat)).run()
        return found

    def body(self, kind: str) -> None:
        self.statements("class" if kind == "class" else "block", "}")
        self.need("}")
        if kind == "if":
            self.else_tail()
        elif kind == "try":
            self.catch_tail()

    def block(self) -> None:
        self.need("{")
        self.statements("block", "}")
        self.need("}")

    def else_tail(self) -> None:
        while self.accept("else"):
            if self.accept("if"):
                self.need("(")
                self.comma()
                self.need(")")
                if self.t == "{":
                    self.block()
                    continue
                self.nested()
                continue
            self.nested()
            return

    def catch_tail(self) -> None:
        some = False
        if self.accept("catch"):
            some = True
            if self.accept("("):
                self.binding()
                self.annotation()
                self.need(")")
            self.block()
        if self.accept("finally"):
            some = True
            self.block()
        if not some:
            raise self.wrong("'catch'")

    def nested(self) -> None:
        if self.t == "{":
            self.block()
        else:
            self.statement("block")

    def semicolon(self) -> str:
        if self.accept(";"):
            return "closed"
        if self.t in ("}", "") or self.nl:
            return "open"
        raise self.wrong("';'")

    # statements
    def statement(self, ctx: str) -> str:
        if ctx == "class":
            return self.member()
        at, first, t = self.i, self.j == 0, self.t
        if t == ";":
            self.adv()
            return "closed"
        if t == "{":
            self.block()
            return "closed"
        if t in ("const", "var", "let", "using"):
            p = self.peek()
            if t in ("const", "var") or p in NAMES or p in ("[", "{"):
                if not (t == "const" and p == "enum"):
                    if p == "let" and t != "var":
                        raise Wrong("let is no name here")
                    self.adv()
                    self.declarators(False, t == "const")
                    kind = self.semicolon()
                    # elsewhere the same line may lack its value
                    return "open" if self.ambient else kind
        if t == "await" and self.peek() == "using" and self.peek(2) in NAMES:
            self.adv()
            self.adv()
            self.declarators(False)
            return self.semicolon()
        if t in ("a", "this", "super", "(", "s", "0"):
            if t == "a" and self.peek() == ":":
                self.adv()
                self.adv()
                self.statement(ctx)
                return "open"
            self.comma()
            return self.semicolon()
        if t == "return":
            self.adv()
            if not self.nl and self.t not in (";", "}", ""):
                self.comma()
            return self.semicolon()
        if t == "if":
            self.adv()
            self.need("(")
            self.comma()
            self.need(")")
            self.head(ctx, at, first, "if")
            self.nested()
            self.else_tail()
            return "open"
        if t == "for":
            self.adv()
            self.accept("await")
            self.need("(")
            self.for_head()
            self.need(")")
            self.head(ctx, at, first, "block")
            self.nested()
            return "open"
        if t == "while" or t == "with":
            self.adv()
            self.need("(")
            self.comma()
            self.need(")")
            self.head(ctx, at, first, "block")
            self.nested()
            return "open"
        if t == "do":
            self.adv()
            self.nested()
            self.need("while")
            self.need("(")
            self.comma()
            self.need(")")
            self.accept(";")
            return "open"
        if t == "function" or t == "async" and self.peek() == "function":
            self.accept("async")
            self.adv()
            self.accept("*")
            self.binding_name()
            self.function_rest(ctx, at, first)
            return "closed"
        if t == "class" or t == "@":
            self.decorators()
            if self.t in ("export", "abstract"):
                return self.statement(ctx)
            self.adv()
            if self.t in NAMES and self.t != "extends":
                self.adv()
            self.class_rest(ctx, at, first)
            return "closed"
        if t == "try":
            self.adv()
            self.head(ctx, at, first, "try")
            self.block()
            self.catch_tail()
            return "open"
        if t == "switch":
            self.adv()
            self.need("(")
            self.comma()
            self.need(")")
            self.need("{")
            while self.t in ("case", "default"):
                if self.adv() == "case":
                    self.comma()
                self.need(":")
                while self.t not in ("case", "default", "}", ""):
                    self.statement("block")
            self.need("}")
            return "closed"
        if t == "throw":
            self.adv()
            if self.nl:
                raise self.wrong("a value")
            self.comma()
            return self.semicolon()
        if t in ("break", "continue"):
            self.adv()
            if self.t in NAMES and not self.nl:
                self.adv()
            return self.semicolon()
        if t == "debugger":
            self.adv()
            return self.semicolon()
        if t == "import" and self.peek() not in ("(", "."):
            if ctx != "top":
                raise self.wrong("a statement")
            return self.import_()
        if t == "export":
            if ctx != "top":
                raise self.wrong("a statement")
            return self.export(ctx, at, first)
        if self.types and (kind := self.typed_statement(ctx, at, first)):
            return kind
        if t in SOFT and self.peek() == ":":
            self.adv()
            self.adv()
            self.statement(ctx)
            return "open"
        self.comma()
        return self.semicolon()

    def typed_statement(self, ctx: str, at: int, first: bool) -> str:
        return ""

    def annotation(self) -> None:
        """Nothing in JavaScript; a type after a colon in TypeScript."""

    def type_params(self) -> None:
        pass

    #: In a declaration without values, as behind declare.
    ambient = False

    def declarators(self, loop: bool, const: bool = False) -> None:
        while True:
            pattern = self.t in ("[", "{")
            self.binding()
            if self.types:
                self.accept("!")
                self.annotation()
            if self.accept("="):
                self.assign()
            elif (pattern and not self.types or const and not self.ambient) and not loop:
                raise self.wrong("'='")
            if not self.accept(","):
                return

    def binding_name(self) -> None:
        if self.t not in NAMES and self.t not in ("await", "yield"):
            raise self.wrong("a name")
        self.adv()

    def binding(self) -> None:
        if self.t == "[":
            self.adv()
            while self.t != "]":
                if self.t != ",":
                    self.accept("...")
                    self.binding()
                    if self.accept("="):
                        self.assign()
                if not self.accept(","):
                    break
            self.need("]")
        elif self.t == "{":
            self.adv()
            while self.t != "}":
                if self.accept("..."):
                    self.binding()
                else:
                    short = self.t in NAMES
                    self.property_name()
                    if self.accept(":"):
                        self.binding()
                    elif not short:
                        raise self.wrong("':'")
                    if self.accept("="):
                        self.assign()
                if not self.accept(","):
                    break
            self.need("}")
        else:
            self.binding_name()

    def property_name(self) -> None:
        if self.t == "[":
            self.adv()
            self.assign()
            self.need("]")
        elif self.t in WORDS or self.t in ("s", "0", "#"):
            self.adv()
        else:
            raise self.wrong("a name")

    def for_head(self) -> None:
        self.no_in = True
        try:
            if self.t == ";":
                pass
            elif self.t in ("const", "let", "var", "using") and (self.peek() in NAMES and self.peek() != "of" or self.peek() in ("[", "{")):
                self.adv()
                self.declarators(True)
            else:
                self.comma()
        finally:
            self.no_in = False
        if self.t == "of":
            self.adv()
            self.assign()
        elif self.t == "in":
            self.adv()
            self.comma()
        else:
            self.need(";")
            if self.t != ";":
                self.comma()
            self.need(";")
            if self.t != ")":
                self.comma()

    def params(self) -> None:
        self.need("(")
        while self.t != ")":
            self.decorators()
            if self.types:
                while self.t in MODIFIERS and (self.peek() in NAMES or self.peek() in ("{", "[")):
                    self.adv()
            self.accept("...")
            if self.types and self.t == "this":
                self.adv()
            else:
                self.binding()
            if self.types:
                self.accept("?")
                self.annotation()
            if self.accept("="):
                self.assign()
            if not self.accept(","):
                break
        self.need(")")

    def function_rest(self, ctx: str = "", at: int = -1, first: bool = False) -> None:
        self.type_params()
        no_in, self.no_in = self.no_in, False
        self.params()
        if self.types:
            self.annotation()
            if self.t != "{":
                self.semicolon()
                self.no_in = no_in
                return
        if ctx:
            self.head(ctx, at, first, "block")
        self.block()
        self.no_in = no_in

    def decorators(self) -> None:
        while self.t == "@":
            self.adv()
            self.unary()

    def class_rest(self, ctx: str = "", at: int = -1, first: bool = False) -> None:
        self.type_params()
        if self.accept("extends"):
            self.unary()
            if self.types and self.t == "<":
                self.type_args()
        if self.types and self.t == "a" and self.peek() != "{":  # implements
            self.adv()
            while True:
                self.type()
                if not self.accept(","):
                    break
        if ctx:
            self.head(ctx, at, first, "class")
        self.need("{")
        self.statements("class", "}")
        self.need("}")

    def member(self) -> str:
        at, first = self.i, self.j == 0
        if self.accept(";"):
            return "closed"
        self.decorators()
        if self.t == "static" and self.peek() == "{":
            self.adv()
            self.block()
            return "closed"
        while self.t in ("static", "get", "set", "async") or self.types and self.t in MODIFIERS:
            if self.peek() in ("(", "=", ";", "}", ":", "?", "!", "<", ","):
                break
            if self.t in ("get", "set") and self.peek() == "*":
                break
            self.adv()
        self.accept("*")
        if self.types and self.t == "[" and self.peek() in NAMES and self.peek(2) == ":":
            self.adv()
            self.adv()
            self.annotation()
            self.need("]")
            self.annotation()
            return self.semicolon()
        self.property_name()
        if self.types:
            self.accept("?") or self.accept("!")
        if self.t in ("(", "<"):
            self.function_rest("class", at, first)
            return "closed"
        self.annotation()
        if self.accept("="):
            self.assign()
        return self.semicolon()

    def import_(self) -> str:
        self.adv()
        if self.types and self.t == "type" and self.peek() not in ("from", ","):
            self.adv()
        if self.t == "s":
            self.adv()
        else:
            if self.t in NAMES:
                self.adv()
                if self.types and self.accept("="):
                    self.comma()
                    return self.semicolon()
                if not self.accept(",") and self.t != "from":
                    raise self.wrong("'from'")
            if self.accept("*"):
                self.need("as")
                self.binding_name()
            elif self.t == "{":
                self.specifiers()
            self.need("from")
            if self.t != "s":
                raise self.wrong("a module")
            self.adv()
        if (self.t == "with" or self.t == "a") and self.peek() == "{" and not self.nl:
            self.adv()
            self.need("{")
            while self.t != "}":
                self.property_name()
                self.need(":")
                if self.t != "s":
                    raise self.wrong("a string")
                self.adv()
                if not self.accept(","):
                    break
            self.need("}")
        return self.semicolon()

    def specifiers(self) -> None:
        self.need("{")
        while self.t != "}":
            if self.types and self.t == "type" and self.peek() not in (",", "}", "as"):
                self.adv()
            if self.t not in WORDS and self.t != "s":
                raise self.wrong("a name")
            self.adv()
            if self.accept("as"):
                if self.t not in WORDS and self.t != "s":
                    raise self.wrong("a name")
                self.adv()
            if not self.accept(","):
                break
        self.need("}")

    def export(self, ctx: str, at: int, first: bool) -> str:
        self.adv()
        if self.accept("default"):
            if self.t in ("function", "class", "@", "async", "abstract") or self.types and self.t == "interface":
                if self.t == "async" and self.peek() != "function":
                    self.assign()
                    return self.semicolon()
                if self.accept("abstract"):
                    pass
                if self.t in ("class", "@"):
                    self.decorators()
                    self.adv()
                    if self.t in NAMES and not (self.types and self.t == "a" and self.peek() != "{" and self.peek() not in ("extends", "<", "a")):
                        self.adv()
                    self.class_rest(ctx, at, first)
                    return "closed"
                if self.t == "interface":
                    return self.statement(ctx)
                self.accept("async")
                self.adv()
                self.accept("*")
                if self.t in NAMES:
                    self.adv()
                self.function_rest(ctx, at, first)
                return "closed"
            self.assign()
            return self.semicolon()
        if self.types:
            if self.t == "=":
                self.adv()
                self.comma()
                return self.semicolon()
            if self.t == "as":
                self.adv()
                self.adv()
                self.adv()
                return self.semicolon()
            if self.t == "type" and self.peek() in ("{", "*"):
                self.adv()
            if self.t == "import":
                return self.import_()
        if self.accept("*"):
            if self.accept("as"):
                self.adv()
            self.need("from")
            self.adv()
            return self.semicolon()
        if self.t == "{":
            self.specifiers()
            if self.accept("from"):
                if self.t != "s":
                    raise self.wrong("a module")
                self.adv()
            return self.semicolon()
        if self.t not in ("const", "let", "var", "function", "async", "class", "@") and not (self.types and self.t in ("interface", "type", "enum", "namespace", "module", "declare", "abstract", "global")):
            raise self.wrong("a declaration")
        t = self.t
        if t in ("function", "class") or t == "async":
            self.accept("async")
            word = self.adv()
            if word == "function":
                self.accept("*")
                self.binding_name()
                self.function_rest(ctx, at, first)
            else:
                if self.t in NAMES:
                    self.adv()
                self.class_rest(ctx, at, first)
            return "closed"
        return self.statement(ctx)

    # expressions
    def comma(self) -> None:
        self.assign()
        while self.accept(","):
            self.assign()

    def assign(self) -> None:
        self.depth += 1
        if self.depth > DEPTH:
            raise Wrong("nesting too deep", "nesting")
        t = self.t
        if t == "async" and self.peek() in NAMES and self.peek(2) == "=>":
            self.adv()
            t = self.t
        if t in NAMES and self.peek() == "=>":
            self.adv()
            self.arrow_body()
        elif (t == "(" or t == "async" and (self.peek() == "(" or self.types and self.peek() == "<") or self.types and t == "<") and self.arrow():
            pass
        elif t == "yield":
            self.adv()
            if not self.nl and self.t not in (")", "]", "}", ",", ";", ":", ""):
                self.accept("*")
                self.assign()
        else:
            self.binary(1)
            if self.t == "?":
                self.adv()
                no_in, self.no_in = self.no_in, False
                self.assign()
                self.need(":")
                self.no_in = no_in
                self.assign()
            elif self.t in ASSIGN:
                if not self.target:
                    raise self.wrong()
                self.adv()
                self.assign()
        self.depth -= 1

    #: Whether the operand just read can be assigned to.
    target = True

    def arrow_body(self) -> None:
        self.need("=>")
        if self.t == "{":
            no_in, self.no_in = self.no_in, False
            self.block()
            self.no_in = no_in
        else:
            self.assign()

    def behind_brackets(self, i: int, j: int) -> str | None:
        """The token behind the bracket that closes the one at token ``j`` of line ``i``; None if none does. All brackets within are
        remembered as well, so nested ones are read once."""
        known = self.__dict__.setdefault("closers", {})
        if (i, j) in known:
            return known[i, j]
        start, toks, stack = None, self.lines[i].split(), []
        while True:
            if j >= len(toks):
                i += 1
                while i < self.n and not self.lines[i]:
                    i += 1
                if i >= self.n:
                    known.update(dict.fromkeys(stack))
                    return None
                toks, j = self.lines[i].split(), 0
            t = toks[j]
            start = start or (i, j)
            if t in "([{":
                stack.append((i, j))
            elif t in ")]}":
                known[stack.pop()] = toks[j + 1] if j + 1 < len(toks) else ""
                if not stack:
                    return known[start]
            j += 1

    def arrow(self) -> bool:
        """An arrow function from its parameters on, if this is one."""
        m = self.mark()
        k = 1 if self.t == "async" else 0
        if self.t != "<" and self.peek(k) == "(":
            # what follows the closing bracket decides
            nxt = self.behind_brackets(self.i, self.j + k)
            if nxt != "=>" and not (self.types and nxt == ":"):
                return False
        depth = self.depth
        try:
            self.accept("async")
            self.type_params()
            self.params()
            self.annotation()
            if self.t != "=>" or self.nl:
                raise self.wrong("'=>'")
        except Wrong:
            self.back(m)
            self.depth = depth
            return False
        self.arrow_body()
        return True

    def binary(self, least: int) -> None:
        self.unary()
        while True:
            t = self.t
            p = BINARY.get(t, 0)
            if not p or p < least:
                if self.types and t in ("as", "satisfies") and least <= 8 and not self.nl:
                    self.adv()
                    if not self.accept("const"):
                        self.type()
                    self.target = True
                    continue
                return
            if t == "in" and self.no_in:
                return
            self.adv()
            self.binary(p if t == "**" else p + 1)
            self.target = False

    def unary(self) -> None:
        t = self.t
        if t in PREFIX:
            self.adv()
            self.unary()
            self.target = False
            return
        if t == "await" and self.peek() not in (")", ",", ";", "=", ".", "=>", ""):
            self.adv()
            self.unary()
            self.target = False
            return
        self.postfix()

    def postfix(self) -> None:
        self.primary()
        while True:
            t = self.t
            if t == ".":
                self.adv()
                if self.t not in WORDS and self.t != "#":
                    raise self.wrong("a name")
                self.adv()
                self.target = True
            elif t == "?.":
                self.adv()
                if self.t in WORDS or self.t == "#":
                    self.adv()
                elif self.t not in ("(", "[", "s"):
                    raise self.wrong("a name")
            elif t == "(":
                self.args()
                self.target = False
            elif t == "[":
                self.adv()
                no_in, self.no_in = self.no_in, False
                self.comma()
                self.no_in = no_in
                self.need("]")
                self.target = True
            elif t == "s":
                # a tagged template; two plain strings side by side can't be told apart by class
                if self.nl:
                    return
                self.adv()
            elif t in ("++", "--"):
                if self.nl:
                    return
                self.adv()
                self.target = False
            elif self.types and t == "!" and not self.nl:
                self.adv()
            elif self.types and t == "<":
                m, depth = self.mark(), self.depth
                try:
                    self.type_args()
                    if self.t not in ("(", "s", ")", "]", "}", ",", ";", ":", ".", "?.", "", "=", "===", "!==", "==", "!=", "&&", "||", "??", "?") and not self.nl:
                        raise self.wrong()
                except Wrong:
                    self.back(m)
                    self.depth = depth
                    return
            else:
                return

    def args(self) -> None:
        self.need("(")
        no_in, self.no_in = self.no_in, False
        while self.t != ")":
            self.accept("...")
            self.assign()
            if not self.accept(","):
                break
        self.need(")")
        self.no_in = no_in

    def primary(self) -> None:
        t = self.t
        self.target = False
        if t in NAMES:
            if t == "async" and self.peek() == "function":
                self.adv()
                self.primary()
                return
            self.adv()
            self.target = True
        elif t in ("0", "s", "this", "null", "true", "false", "super"):
            self.adv()
        elif t == "(":
            self.adv()
            no_in, self.no_in = self.no_in, False
            self.comma()
            self.no_in = no_in
            self.need(")")
            self.target = True
        elif t == "[":
            self.adv()
            no_in, self.no_in = self.no_in, False
            while self.t != "]":
                if self.t != ",":
                    self.accept("...")
                    self.assign()
                    if self.t != "]" and self.t != ",":
                        break
                if not self.accept(","):
                    break
            self.need("]")
            self.no_in = no_in
            self.target = True
        elif t == "{":
            no_in, self.no_in = self.no_in, False
            self.object()
            self.no_in = no_in
            self.target = True
        elif t == "function":
            self.adv()
            self.accept("*")
            if self.t in NAMES or self.t in ("await", "yield"):
                self.adv()
            self.function_rest()
            self.target = False
        elif t == "class" or t == "@":
            self.decorators()
            self.need("class")
            if self.t in NAMES and self.t != "extends":
                self.adv()
            self.class_rest()
            self.target = False
        elif t == "new":
            self.adv()
            if self.accept("."):
                self.adv()
            else:
                self.new_callee()
        elif t == "import":
            self.adv()
            if self.accept("."):
                self.adv()
            elif self.t != "(":
                raise self.wrong("'('")
        elif t == "#" and self.peek() == "in":
            self.adv()
        elif t in ("await", "yield"):
            self.adv()
            self.target = True
        elif self.types and t == "<":
            self.type_args()
            self.unary()
        else:
            raise self.wrong("a value")

    def new_callee(self) -> None:
        self.primary()
        while True:
            if self.t == ".":
                self.adv()
                self.adv()
            elif self.t == "[":
                self.adv()
                self.comma()
                self.need("]")
            elif self.types and self.t == "<":
                self.type_args()
            else:
                break
        if self.t == "(":
            self.args()
        self.target = False

    def object(self) -> None:
        self.need("{")
        while self.t != "}":
            if self.accept("..."):
                self.assign()
            else:
                while self.t in ("get", "set", "async") and self.peek() not in (",", ":", "(", "}", "=", "<"):
                    self.adv()
                star = self.accept("*")
                short = self.t in NAMES or self.t in ("await", "yield")
                self.property_name()
                if self.t in ("(", "<"):
                    self.function_rest()
                elif star:
                    raise self.wrong("'('")
                elif self.accept(":"):
                    self.assign()
                elif not short:
                    raise self.wrong("':'")
                elif self.accept("="):
                    self.assign()
            if not self.accept(","):
                break
        self.need("}")


class TypeScriptParser(JavaScriptParser):
    simple = {"top": set(), "block": set(), "class": set()}
    heads = {"top": {}, "block": {}, "class": {}}
    types = True

    def typed_statement(self, ctx: str, at: int, first: bool) -> str:
        t, p = self.t, self.peek()
        if t == "interface" and p in NAMES:
            self.adv()
            self.adv()
            self.type_params()
            if self.accept("extends"):
                while True:
                    self.type()
                    if not self.accept(","):
                        break
            self.object_type()
            return "closed"
        if t == "type" and p in NAMES:
            self.adv()
            self.adv()
            self.type_params()
            self.need("=")
            self.type()
            return self.semicolon()
        if t == "enum" or t == "const" and p == "enum":
            self.accept("const")
            self.adv()
            self.binding_name()
            self.need("{")
            while self.t != "}":
                self.property_name()
                if self.accept("="):
                    self.assign()
                if not self.accept(","):
                    break
            self.need("}")
            return "closed"
        if t == "declare" and p in ("const", "let", "var", "function", "class", "module", "namespace", "global", "abstract", "enum", "interface", "type", "async"):
            self.adv()
            if self.t == "global":
                self.adv()
                self.module_body(ctx, at, first)
                return "closed"
            ambient, self.ambient = self.ambient, True
            try:
                return self.statement(ctx)
            finally:
                self.ambient = ambient
        if t in ("namespace", "module") and (p in NAMES or p == "s"):
            self.adv()
            self.adv()
            while self.accept("."):
                self.adv()
            if self.t != "{":
                return self.semicolon()
            self.module_body(ctx, at, first)
            return "closed"
        if t == "global" and p == "{":
            self.adv()
            self.module_body(ctx, at, first)
            return "closed"
        if t == "abstract" and p == "class":
            self.adv()
            self.adv()
            if self.t in NAMES:
                self.adv()
            self.class_rest(ctx, at, first)
            return "closed"
        return ""

    def module_body(self, ctx: str, at: int, first: bool) -> None:
        self.need("{")
        self.statements("top", "}")
        self.need("}")

    # types
    def annotation(self) -> None:
        if self.accept(":"):
            self.return_type()

    def return_type(self) -> None:
        if self.t == "asserts" and self.peek() in ("a", "this") and self.t != "=>":
            self.adv()
            self.adv()
            if self.accept("is"):
                self.type()
            return
        if (self.t in NAMES or self.t == "this") and self.peek() == "is" and self.j + 1 < len(self.toks):
            self.adv()
            self.adv()
        self.type()

    def type_params(self) -> None:
        if self.t != "<":
            return
        self.adv()
        while self.t not in (">", ">>", ">=", ">>>"):
            while self.t in ("const", "in", "out") and self.peek() in NAMES:
                self.adv()
            self.binding_name()
            if self.accept("extends"):
                self.type()
            if self.accept("="):
                self.type()
            if not self.accept(","):
                break
        self.close_angle()

    def close_angle(self) -> None:
        t = self.t
        if t == ">":
            self.adv()
        elif t in (">>", ">=", ">>>", ">>=", ">>>="):
            self.toks = [*self.toks[:self.j], ">", t[1:], *self.toks[self.j + 1:]]
            self.t = ">"
            self.adv()
        else:
            raise self.wrong("'>'")

    def type_args(self) -> None:
        self.need("<")
        while self.t not in (">", ">>", ">=", ">>>"):
            self.type()
            if not self.accept(","):
                break
        self.close_angle()

    def type(self) -> None:
        self.depth += 1
        if self.depth > DEPTH:
            raise Wrong("nesting too deep", "nesting")
        if self.t == "<" or self.t == "(" and self.function_type() or self.t == "new" or self.t == "abstract" and self.peek() == "new":
            self.accept("abstract")
            self.accept("new")
            self.type_params()
            self.params()
            self.need("=>")
            self.return_type()
            self.depth -= 1
            return
        self.accept("|") or self.accept("&")
        self.type_unary()
        while self.t in ("|", "&"):
            self.adv()
            self.type_unary()
        if self.t == "extends" and not self.nl:
            self.adv()
            self.type()
            if self.t == "?":
                self.need("?")
                self.type()
                self.need(":")
                self.type()
        self.depth -= 1

    def function_type(self) -> bool:
        """Brackets that hold parameters and are followed by an arrow."""
        p, q = self.peek(), self.peek(2)
        if not (p in (")", "...") or (p in NAMES or p == "this") and q in (":", ",", "?", "=", ")") or p in ("{", "[")):
            return False
        i, j, toks, nest = self.i, self.j, self.toks, 0
        while True:
            if j >= len(toks):
                i += 1
                while i < self.n and not self.lines[i]:
                    i += 1
                if i >= self.n:
                    return False
                toks, j = self.lines[i].split(), 0
            t = toks[j]
            if t in "([{":
                nest += 1
            elif t in ")]}":
                nest -= 1
                if not nest:
                    return j + 1 < len(toks) and toks[j + 1] == "=>"
            j += 1

    def type_unary(self) -> None:
        if self.t in ("keyof", "unique", "readonly", "infer") and self.peek() not in (",", ";", ")", ">", "|", "&", "=", "]", "}", ":"):
            infer = self.adv() == "infer"
            if infer:
                self.binding_name()
                return
            self.type_unary()
            return
        self.type_primary()
        while True:
            if self.t == "[" and not self.nl:
                self.adv()
                if self.t != "]":
                    self.type()
                self.need("]")
            else:
                return

    def type_primary(self) -> None:
        t = self.t
        if t in ("s", "0", "null", "true", "false", "this", "void"):
            self.adv()
        elif t == "-":
            self.adv()
            self.need("0")
        elif t == "typeof":
            self.adv()
            self.type_primary()
        elif t == "import":
            self.adv()
            self.need("(")
            self.type()
            self.need(")")
            self.type_tail()
        elif t in NAMES:
            self.adv()
            self.type_tail()
        elif t == "(":
            self.adv()
            self.type()
            self.need(")")
        elif t == "[":
            self.adv()
            while self.t != "]":
                self.accept("...")
                if self.t in NAMES and (self.peek() == ":" or self.peek() == "?" and self.peek(2) == ":"):
                    self.adv()
                    self.accept("?")
                    self.need(":")
                self.type()
                self.accept("?")
                if not self.accept(","):
                    break
            self.need("]")
        elif t == "{":
            self.object_type()
        else:
            raise self.wrong("a type")

    def type_tail(self) -> None:
        while self.accept("."):
            if self.t not in WORDS:
                raise self.wrong("a name")
            self.adv()
        if self.t == "<" and not self.nl:
            self.type_args()

    def object_type(self) -> None:
        self.need("{")
        while self.t != "}":
            if self.t in ("+", "-") and self.peek() == "readonly":
                self.adv()
            if self.t == "readonly" and self.peek() not in (":", "?", "(", ";", ",", "}"):
                self.adv()
            if self.t in ("get", "set") and self.peek() not in (":", "?", "(", "<", ";", ",", "}"):
                self.adv()
            if self.t == "new" and self.peek() in ("(", "<"):
                self.adv()
            if self.t in ("(", "<"):
                self.type_params()
                self.params()
                self.annotation()
            elif self.t == "[":
                if self.peek() in NAMES and self.peek(2) == ":":
                    self.adv()
                    self.adv()
                    self.need(":")
                    self.type()
                    self.need("]")
                elif self.peek() in NAMES and self.peek(2) == "in":
                    self.adv()
                    self.adv()
                    self.adv()
                    self.type()
                    if self.accept("as"):
                        self.type()
                    self.need("]")
                else:
                    self.property_name()
                if self.t in ("+", "-"):
                    self.adv()
                self.accept("?")
                if self.t in ("(", "<"):
                    self.type_params()
                    self.params()
                self.annotation()
            else:
                self.property_name()
                self.accept("?")
                if self.t in ("(", "<"):
                    self.type_params()
                    self.params()
                self.annotation()
            if self.t in (";", ","):
                self.adv()
            elif self.t != "}" and not self.nl:
                raise self.wrong("';'")
        self.need("}")
