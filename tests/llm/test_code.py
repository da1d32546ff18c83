"""Parsing, hand-written files and natural language in code."""

import ast
import glob
import os

import pytest

from marlstone.llm import code_languages as L
from marlstone.llm import handwritten as H
from marlstone.llm import parse_errors as P
from marlstone.llm.syntax import problems

GOOD = {
    "py": ["", "x = 1\n", "def f(a, *b, c: int = 1, **d) -> int:\n    return [y for y in a if y] or {**d}\n", "if a:\n  pass\nelif b: pass\nelse:\n  x = (1,\n 2)\n", "@d\nclass A(B, metaclass=M):\n    '''doc\n  x'''\n    x: int = 1\n",
           "try:\n  f()\nexcept (A, B) as e:\n  raise X from e\nelse:\n  pass\nfinally:\n  pass\n", "match x:\n  case [1, *r] if r:\n    pass\n  case _:\n    pass\n", "async def f():\n  async with a as b, c:\n    await d\n", "f = lambda x, *y: x if y else -x ** 2\n", "﻿x = 1\r\ny = 2\r\n"],
    "rs": ["fn main() { let x: Vec<Vec<u8>> = vec![]; }", "impl<'a, T: Fn(u8) -> u8 + 'a> A<'a, T> where T: Copy { pub fn f(&mut self) -> Option<&'a str> { self.0.as_ref().map(|x| x + 1)?; None } }",
           "fn f(x: u8) -> u8 { match x { 1 | 2 => {} (a, b) if a => 3, _ => if x == 1 { 1 } else { 2 } } }", "#![allow(x)]\nuse a::{b, c::*};\nstruct S { a: u8 }\nenum E { A(u8), B { x: u8 } }\ntrait T { fn f(&self); }\nmacro_rules! m { ($x:expr) => { $x } }"],
    "js": ["const f = async ({ a, b = 1 }, [c], ...d) => ({ a, [b]: c, ...d, get x() { return 1 } })", "for (const x of y) { if (x) continue; else break }\nlabel: while (1) { break label }", "export default class A extends B { #p = 1; static async *g() { yield* x } }",
           "let r = /a[/]b/g.test(s) ? `t${x + `${y}`}` : a?.b?.[1] ?? 2\n(function () {})()", "import a, { b as c } from 'x'\nexport * from \"y\"", "!function(t,e){var a=1;return a/2}(1,2);"],
    "ts": ["interface A<T> extends B { x?: number; f(y: string): void; [k: string]: any }", "export const f = <T,>(x: T, y?: Map<string, Array<T>>): x is T => x as unknown as T", "abstract class A implements B { constructor(private readonly x: number) { super() } abstract f(): void }",
           "type X = { readonly [K in keyof T]?: T[K] } | (typeof y)[number] & `a${string}`", "enum E { A = 1, B }\ndeclare module 'x' { export function f(): void }\nlet z = y!.a satisfies B"],
    "go": ["package a\n\nimport (\n\t\"fmt\"\n)\n\nfunc (t *T) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[\"k\"]; ok {\n\t\treturn v, nil\n\t}\n\tfor i := range x {\n\t}\n\tgo func() {}()\n\treturn\n}\n",
           "package a\ntype S[T any] struct {\n\tA, B int `json:\"a\"`\n\t*T\n}\nvar x = map[string][]int{\"a\": {1, 2},}\nconst (\n\tA = iota\n\tB\n)\n", "package a\nfunc f() {\n\tswitch x := y.(type) {\n\tcase int, *T:\n\t\tbreak\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\t\t_ = v\n\t}\n}"],
    "java": ["package a.b;\nimport static c.D.*;\n@X(y = 1)\npublic final class A<T extends B & C> extends D implements E {\n  private static final int[] x = {1, 2};\n  <U> A(List<? extends U> u) throws X { this.x[0]++; }\n}",
             "class A { int f(Object o) { if (o instanceof String s && s.length() > 1) return switch (o) { case String t -> 1; default -> { yield 2; } }; for (var x : y) { x.g((a, b) -> a + b, C::new); } return (int) 1L; } }",
             "record R(int a, String b) { R { assert a > 0; } }\nenum E { A(1) { void f() {} }, B; E(int... x) {} }\nsealed interface I permits J {}"],
}
BAD = {
    "py": ["def f(:\n", "if x:\ny\n", "  x = 1\n", "x = (1,\n", "print 'a'\n", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "s = 'abc\n", "else:\n  pass\n", "def f():\n", "<!DOCTYPE html>\n<html></html>\n", "try:\n  x\n", "x = 1 2\n"],
    "rs": ["fn main() {", "fn main() { let x = ; }", "}", "use a::b", "struct { }", "fn f() { let s = \"abc; }", "import x\n"],
    "js": ["f(", "const x = ;", "}", "let a b", "if (x {", "use crate::a;", "x = 'abc\n", "const { a };", "1 = 2"],
    "ts": ["interface {", "let x: = 1", "class A { f( { } }", "# heading\n", "type = 1;;;)"],
    "go": ["func f() {}\n", "package a\nfunc f() {\n", "package a\nx := 1\n", "package a\nvar x = []int{1\n}\n", "package a\nfunc f() { x = }\n"],
    "java": ["class A {", "class A { int f( { } }", "int x = 1;", "class A { void f() { 1 + 2; } }", "class A { void f() { int x = ; } }", "}"],
}


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in GOOD.items() for t in ts])
def test_good(ext, text):
    assert problems(ext, text) == []
    assert problems(ext, text) == []  # from memory


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in BAD.items() for t in ts])
def test_bad(ext, text):
    assert problems(ext, text)


def test_causes_lines_and_recovery():
    found = problems("rs", "fn a() {\n    let x = ;\n}\nfn b() {\n    let y = 2;\n    let z = );\n}\n")
    assert [p.line for p in found] == [2, 6]
    assert problems("go", "package a\n<<<<<<< HEAD\nvar x = 1\n=======\n")[0].cause == "merge conflict"
    assert problems("js", "function f() {\n  g('abc\n")[0].cause == "unterminated string"
    assert problems("java", "class A {\n  void f() {\n")[-1].cause == "truncated"
    assert problems("py", "x = '''a\nb'''\ny = (\n1\n")[0].line == 3
    assert problems("py", "(" * 5000) and problems("js", "[" * 5000) and problems("rs", "fn f() {" * 3000)


def test_library_files_parse():
    seen = 0
    for f in sorted(glob.glob(os.path.join(os.path.dirname(ast.__file__), "*.py")))[:80]:
        with open(f, encoding="utf-8") as h:
            text = h.read()
        seen += 1
        assert problems("py", text) == [], f
    assert seen


FILE = "id string, project_id string, file_path string, content string, file_size long, language int, errors string"


def test_parse_table(spark):
    rows = [("a", "p", "x.py", "x = (", 1, 0, ""), ("b", "p", "x.RS", "fn f() {}", 1, 0, ""), ("c", "p", "x.txt", "(", 1, 0, ""), ("d", "q", None, "(", 1, 0, ""), ("e", "q", "e.go", "", 1, 0, ""), ("f", None, "f.js", None, 1, 0, ""),
            (None, "p", "g.js", "(", 1, 0, ""), ("h", None, "h.py", "", None, None, None), ("a", "p", "x.py", "x = (", 1, 0, ""), ("l", "p", "l.py", "x = 1\n" * 100_000, 1, 0, "")]
    out = P.parsed(spark.createDataFrame(rows, FILE))
    assert sorted((r["id"], r["parses"]) for r in out.dropDuplicates(["id"]).collect()) == [("a", False), ("b", True), ("e", False), ("h", True), ("l", True)]
    rates = {(r["project_id"], r["language"]): (r["files"], r["failed"]) for r in P.error_rates(out).collect()}
    assert rates[("p", "python")] == (2, 1) and rates[("p", "rust")] == (1, 0)
    assert P.parsed(spark.createDataFrame([], FILE)).collect() == []


HAND = "import os\n\n# this reads a table of names\ndef read_{0}(path, limit=10):\n    with open(path) as handle_{0}:\n        rows = [line.strip() for line in handle_{0} if line]\n    # the first rows only\n    return rows[:limit * {1}]\n\n\nclass Reader{0}:\n    def run(self, other_{0}):\n        value = other_{0}.load(self.path)\n        if value is None:\n            raise ValueError('no value')\n        return value + {1}\n"
STUB = "\n".join("def get_f{0}(m):\n    return m._slot({0})\n\ndef set_f{0}(m, v):\n    m._put({0}, v)\n".format(i) for i in range(12))
MINI = "!function(t,e){" + "".join(f"var a{i}=function(b){{return b*{i}}};" for i in range(60)) + "}();"


def test_declared():
    d = H.declared
    assert d("a_pb2.py", "x = 1") == (True, False) and d("vendor/x/a.go", "package a") == (False, True) and d("src/vendor_portal/a.go", "package a") == (False, False)
    assert d("a.go", "// Code generated by x. DO NOT EDIT.\npackage a") == (True, False) and d("a.py", "# Taken verbatim from foo at tag 1.0\nx = 1") == (False, True)
    assert d("a.py", "# it writes the words do not edit into generated output\nx = 1") == (False, False) and d("a.py", "x = 1\n# DO NOT EDIT\n") == (False, False)
    assert d("a.py", "T = [\n" + "  0x1f, 23, 9.5,\n" * 60 + "]\n") == (True, False)
    assert H.is_page("<!DOCTYPE html>\n<p>x") and H.is_page("# A\n\n* b\n* c\n* d\n") and not H.is_page(HAND)


def test_forest(spark):
    rows = [(f"h{i}", f"src/h{i}.py", HAND.format(i, i * 7), None) for i in range(120)]
    rows += [(f"s{i}", f"src/s{i}.py", ("# Code generated by gen. DO NOT EDIT.\n" if i % 2 else "") + STUB.replace("f1", f"g{i}"), 10) for i in range(40)]
    rows += [(f"m{i}", f"web/m{i}.min.js" if i % 2 else f"web/m{i}.js", MINI.replace("a1", f"z{i}"), 10) for i in range(40)]
    rows += [("v", "node_modules/x/v.py", HAND.format("v", 1), 1), ("null", "a.py", None, 1), (None, "a.py", "x", 1), ("empty", "a.py", "", 1), ("nopath", None, HAND.format(999, 3), 1), ("page", "a.py", "<html>", 1), ("h0", "src/h0.py", HAND.format(0, 0), 1)]
    got = {r[0] for r in H.not_handwritten(spark.createDataFrame(rows, "id string, file_path string, content string, file_size long")).collect()}
    want = {f"s{i}" for i in range(40)} | {f"m{i}" for i in range(40)} | {"v"}
    assert got >= want and len(got - want) <= 2
    few = spark.createDataFrame(rows[:3] + [rows[-7]], "id string, file_path string, content string, file_size long")
    assert {r[0] for r in H.not_handwritten(few).collect()} == {"v"}
    assert H.not_handwritten(few.limit(0)).collect() == []


def test_held_out_notices_are_voted_without_being_seen(spark):
    rows = [(f"h{i}", f"src/h{i}.py", HAND.format(i, i * 7), len(HAND.format(i, i * 7))) for i in range(120)]
    rows += [(f"m{i}", f"web/m{i}.min.js" if i % 2 else f"web/m{i}.js", ("" if i % 2 else "// Code generated by x. DO NOT EDIT.\n") + MINI.replace("a1", f"z{i}"), 10) for i in range(80)]
    got = {r["declared"]: r for r in H.held_out(spark.createDataFrame(rows, "id string, file_path string, content string, file_size long")).collect()}
    assert got[True]["voted"] / got[True]["files"] > 0.9 and got[False]["voted"] / got[False]["files"] < 0.1


TEXTS = {"en": "This filter keeps the rows of a table before the index reads them again", "de": "Die Datei wird nach dem Lauf gelesen und das Feld bleibt in der Tabelle", "fr": "Le fichier est lu avant la fin et le champ reste dans la table",
         "es": "El archivo se lee antes de la carga y el campo queda en la tabla", "ru": "Файл читается перед загрузкой и поле остаётся в таблице", "zh": "这个过滤器在读取索引之前保留表格的行。", "ja": "この関数は索引を読む前に表の行を保存する。"}


@pytest.fixture(scope="module")
def model():
    return L.train(L.counted([(k, v) for k, v in TEXTS.items() for _ in range(3)]))


@pytest.mark.parametrize("lang", sorted(TEXTS))
def test_languages(model, lang):
    sc = L.Scores(model)
    assert [s[0] for s in L.spans(TEXTS[lang], sc)] == [lang]


def test_segmentation(model):
    sc = L.Scores(model)
    mixed = TEXTS["en"] + " " + TEXTS["de"]
    assert [s[0] for s in L.spans(mixed, sc)] == ["en", "de"]
    assert all(n < 6 for _, n, _ in L.spans("load_x = store.read(index_y, 35) + a.b.c", sc))
    assert L.best_labels([(1.0, 5.0), (5.0, 1.0), (1.0, 5.0)], 9.0) == [0, 0, 0] and L.best_labels([(1.0, 50.0), (50.0, 1.0)], 9.0) == [0, 1]


def test_language_table(spark, model):
    f = spark.createDataFrame([
        ("a", "a.py", f"# {TEXTS['en'][:40]}\n# {TEXTS['en'][40:]}\nx = '{TEXTS['ru']}'\n", 1), ("b", "b.go", f"package a\n/* {TEXTS['de']} */\n// x = y(1)\nvar q = \"SELECT a FROM b WHERE c\"\n", 1),
        ("c", "c.py", f"package a;\n// {TEXTS['fr']}\nclass A {{\n  final int x;\n}}\n", 1), ("d", "d.js", f"'{TEXTS['es']}'; `{TEXTS['ja']}`; // 待办\n", 1), ("e", "e.rs", "// SPDX-License-Identifier: MIT\nfn f<'a>() { g('x', \"short\"); }\n", 1),
        ("n", "n.py", None, 1), (None, "n.py", "# x", 1), ("z", "z.py", "", 1), ("p", None, "# " + TEXTS["en"], 1), ("h", "h.py", "<html>" + TEXTS["en"], 1), ("l", "l.py", ("# " + TEXTS["en"] + "\n") * 5000, 1)], "id string, file_path string, content string, share int")
    got = {tuple(r) for r in L.running_text(L.languages(f, model)).collect()}
    assert got == {("a", "en"), ("a", "ru"), ("b", "de"), ("c", "fr"), ("d", "es"), ("d", "ja"), ("l", "en")}
    assert all(0 < r["share"] <= 1 for r in L.languages(f, model).collect()) and L.languages(f.limit(0), model).collect() == []
    docs = spark.createDataFrame([(1, "EN", (TEXTS["en"] + " ") * 2), (2, "de-DE", (TEXTS["de"] + " ") * 2), (3, None, "x x"), (4, "en", ""), (5, "th", "x x"), (6, "en", None)], "doc_id long, lang string, text string")
    words = L.word_counts(docs)
    assert {k for k, _, _ in words} == {"de", "en"} and ("de", "die", 2) in words and ("de", "tabelle", 2) in words and L.word_counts(docs.limit(0)) == []


def test_bytes_are_those_of_the_segment(model):
    sc = L.Scores(model)
    for lang in ("en", "de", "fr", "es", "ru"):
        assert L.spans(TEXTS[lang] + ".", sc) == [(lang, len(TEXTS[lang].split()), len(TEXTS[lang].encode()))]
    assert L.spans("the rows, of  the\n table", sc) == [("en", 5, len("the rows, of the table"))]
    assert L.spans(TEXTS["zh"], sc) == [("zh", 18, len(TEXTS["zh"].encode()))]
    # code between words is no part of the text
    assert L.spans("the rows load_x() of the table", sc) == [("en", 5, len("the rows") + len("of the table"))]


def test_languages_outside_the_seven(model):
    sc = L.Scores(model)
    assert {s[0] for s in L.spans("Перевіряє, чи є значення користувача дійсним", sc)} == {"other"}
    assert {s[0] for s in L.spans("ตรวจสอบค่า", sc)} == {"other"} and {s[0] for s in L.spans("फ़ाइल पढ़ता है", sc)} == {"other"}


def test_clauses_follow_their_surroundings(model):
    sc = L.Scores(model)
    assert [s[0] for s in L.spans("索引保存。" + TEXTS["ja"] + "索引保存。", sc)] == ["ja"]
    assert [s[0] for s in L.spans(TEXTS["zh"] + TEXTS["ja"], sc)] == ["zh", "ja"]


def test_short_texts_count(spark, model):
    sc = L.Scores(model)
    assert [s[0] for s in L.spans("à revoir", sc)] == ["fr"] and L.spans("index", sc) == [("en", 1, 5)]
    assert L.spans("TODO", sc) == [] and L.spans("return read_x(a) + b_c", sc) == []
    assert list(L.texts_of("py", "x = 'log-level'; y = 'rows'  # 待办\n")) == [("string", "rows"), ("comment", " 待办")]
    f = spark.createDataFrame([("a", "a.py", "x = 1  # 待办\n"), ("b", "b.go", "// see the\nx"), ("c", "c.js", "f('rows'); g('log-level')"), ("d", "d.py", "# проверить"), ("e", "e.py", "s = 'a b c d e f'  # this is the table of the index\n")], "id string, file_path string, content string")
    rows = {(r["id"], r["nat_lang"]): r["bytes"] for r in L.languages(f, model).collect()}
    assert rows[("a", "zh")] == 6 and rows[("b", "en")] == 7 and rows[("c", "en")] == 4 and ("d", "ru") in rows
    assert L.running_text(L.languages(f, model)).filter("id <> 'e'").collect() == []


def test_dependency_folders_count_whatever_they_hold(spark):
    rows = [("null", "node_modules/x/a.js", None, 1), ("empty", "vendor/x/a.go", "", None), ("page", "third_party/x.js", "<!DOCTYPE html>\n<p>x", 1), ("prose", "a/vendor/b.py", "# A\n\n* b\n* c\n* d\n", 1), (None, "vendor/a.go", None, 1),
            ("own", "src/x.js", "<html>", 1), ("none", "src/a.js", None, 1), ("blank", None, "", 1), ("h", "src/h.py", HAND.format(1, 2), 1)]
    got = H.not_handwritten(spark.createDataFrame(rows, "id string, file_path string, content string, file_size long")).collect()
    assert {r[0] for r in got} == {"null", "empty", "page", "prose"}
