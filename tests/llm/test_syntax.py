"""The checkers of six languages against a compiler, where there is one, and against texts checked by hand."""

import ast
import random
import re

import pytest

from marlstone.llm.syntax import problems
from marlstone.llm.syntax.python import PythonParser

BASE='''f(a=1, b=2)
f(*a, **k)
f(x for x in y)
f(a, *b, c=1, **d)
def f(a, /, b=1, *, c, d=2, **k): pass
def f(a: int = 1, *args: *Ts, k: str) -> dict[str, int]: return 1
async def g(): await x; return [i async for i in y if i]
a = b = c, *d = 1, 2
a, b = b, a
(a, b), [c, *d] = x
a.b[c].d += 1
x: int = 5
(x): int
x.y: int = yield z
del a, b[0], (c, d)
for i, (j, *k) in enumerate(x): pass
for x in *a, *b: print(x)
while (n := f()): break
if x := 1: pass
with open(a) as f, g() as (h, i): pass
with (open(a) as f, b): pass
with (a, b): pass
with (yield): pass
lambda x, *y, z=1, **k: x + 1
x = lambda: (yield)
x = yield
x = [i for i in range(10) if i % 2 if i > 3]
x = {k: v for k, v in d.items()}
x = {*a, *b, 1}
x = {**a, 'b': 1, **c}
x = (*a, b)
x = a[1:2, ::3, ..., *b]
x = a[b:=1]
x = a[:, 1:]
x = not a or b and not c
x = a if b else c if d else e
x = -a ** -b
x = a < b <= c != d is not e not in f
x = 0x_ff + 0b1 + 0o17 + 1_000.5e-3j + .5 + 1. + 00
x = b"a" b'b' rb"\\x"
x = "a" f"{b}" 'c'
x = f"{a!r:>{w}} {{}} {b=} {c:%Y-%m-%d} {(lambda: 1)()}"
x = f'{a["b"]} {x if y else z}'
x = f"{a:{b}.{c}}"
x = "\\x41 \\u0041 \\N{DASH}" if 0 else r"\\x"
raise A from b
raise
assert a, b
import a.b as c, d
from . import a
from ..a.b import (c as d, e,)
from a import *
global a, b
nonlocal x
type X[T: int, *U, **V] = list[T]
class A[T](B, metaclass=C): x = 1
@a.b(c)[d]
print(*a, sep="")
return
return *a, b
a @ b; c // d; e >> f | g & h ^ ~i
match = 1; case = 2; type = 3; _ = 4
print(match, case[type])
await x
a = await b ** 2
x = (yield a, b)
x = [(yield)]
f((yield))
f(a)(b)[c].d
x = (i for i in y)
...
pass;
a if b else lambda: c
x = ()
x = []
x, = 1,
*a, = b
[a, b] = c
() = x
[] = x
x = "a" "b"
x = u"a"
x = Rb"a"
'''.split('\n')
BLOCKS=['''if a:
    b
elif c:
    d
else:
    e
''','''try:
    a
except A as e:
    b
except (B, C):
    c
except:
    d
else:
    f
finally:
    g
''','''try:
    a
except* A:
    b
''','''match x:
    case 1 | -2.5 | 1+2j: pass
    case "a" "b" | None | True: pass
    case [a, *b, _]: pass
    case (a, b): pass
    case {"k": v, A.b: 1, **rest}: pass
    case A(x, y=1) if z: pass
    case A.B.C() as d: pass
    case a, *b: pass
    case [] | {} | (): pass
    case _:
        pass
''','''match a, *b:
    case x:
        y
''','''@a
@b(c)
async def f(x):
    """doc"""
    async with a as b, c:
        pass
    async for i in y:
        continue
    else:
        pass
''','''class A:
\tdef f(self):
\t\tif a:
\t\t\treturn 1
\tx = 2
''','''def f():
    x = (1,
  2)
    return [
      a for a in b
    ]
''','''if a: b; c
else: d
''','''while a:
    if b: break
else:
    c
''','''x = """a
 b""" + \\
   c
# comment
  # another
y = 1
''']

TOK=re.compile(r'\s+|[^\W\d]\w*|\d[\w.]*|"[^"\n]*"|\'[^\'\n]*\'|\*\*|:=|->|//|[-+*/<>=!]=|.|\n',re.S)
def mutate(s: str, r: random.Random) -> str:
    ts = TOK.findall(s)
    if not ts:
        return s
    k, i = r.randrange(6), r.randrange(len(ts))
    pool = ["*","**",",",":","=",":=","(",")","[","]","{","}","a","1",'"s"','b"t"',"for x in y","if","else","lambda:","yield","await","not","in","is",".","...","@","->","None","x=1","*a","**k","async","as","del","case","match","from","import","\n"," ","\n    ","f'{a}'","f'{a b}'","0x","1_","-",";","return","and","/","|","_"]
    if k == 0:
        del ts[i]
    elif k == 1:
        ts.insert(i, r.choice(pool) + " ")
    elif k == 2:
        ts[i] = r.choice(pool)
    elif k == 3:
        j = r.randrange(len(ts))
        ts[i], ts[j] = ts[j], ts[i]
    elif k == 4:
        ts.insert(i, " " + ts[i])
    else:
        ts[i] = " " + r.choice(pool) + " " + ts[i]
    return "".join(ts)


def compiles(s: str) -> bool:
    try:
        ast.parse(s)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def parses(s: str) -> bool:
    return not PythonParser(s).run()


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("seed", [1, 2, 3, 5])
def test_python_agrees_with_its_compiler(seed):
    """Thousands of valid and invalid snippets, made by changing tokens of valid ones."""
    r, counts = random.Random(seed), [0, 0]
    seen = set()
    for s in (*BASE, *BLOCKS):
        assert parses(s) == compiles(s), s
    while len(seen) < 6_000:
        s = r.choice([*BASE, *BLOCKS, *BLOCKS])
        for _ in range(r.choice((1, 1, 2))):
            s = mutate(s, r)
        if s in seen or re.search(r"\b[tT][\"']", s):  # template strings came after some compilers
            continue
        seen.add(s)
        valid = compiles(s)
        counts[valid] += 1
        assert parses(s) == valid, s
    assert min(counts) > 300


ERRORS = ["f(a=1, 2)", "def f(a=1, b): pass", "a + 1 = 2", "f() = 1", "None = 1", "a := 1", "del f()", "for 1 in x: pass", "{1:2, 3}", "{**a, b}", "a[1:2:3:4]", "012", "12abc", "0xZZ", "1__0",
          '"a" b"b"', 'b"é"', '"\\x1"', 'f"{}"', 'f"{a b}"', "if a:\n\tb\n        c", "match x:\n    a = 1", "case x: pass", "print x", "except A, B: pass", "1.real", 'f"{a!x}"', 'f"{a:{b:{c:{d}}}}"', "x = \"\\N{NO SUCH SIGN}\"",
          "f(x for x in y, 1)", "f(**a, *b)", "def f(*): pass", "def f(**a, b): pass", "lambda: (yield", "x: int, y = 1", "(a, b) += 1", "with a as f(): pass", "import a as b.c", "from a import b,", "[*a for a in b]", "(*a)", "a = yield = b", 'f"}"']


@pytest.mark.parametrize("text", ERRORS)
def test_python_errors(text):
    assert not compiles(text) and not parses(text)


def test_python_one_line_arms_and_nesting():
    assert parses("match x:\n    case 1: pass\n    case _: y = 2")
    assert parses("(" * 199 + ")" * 199) and not parses("(" * 201 + ")" * 201)
    assert parses('x = f"{a["b"]} {f"{c!r:>{d}}"}"\n') and not parses('x = f"{a["b" c]}"')


@pytest.mark.parametrize("ext, text", [
    ("java", "class A { int x = " + "(" * 1_000 + "1" + ")" * 1_000 + "; }"), ("js", "{" * 1_500 + "}" * 1_500), ("js", "x = " + "[" * 1_500 + "]" * 1_500), ("ts", "x = " + "(" * 400 + "1" + ")" * 400),
    ("go", "package p\nfunc f() " + "{" * 1_500 + "}" * 1_500), ("rs", "fn f() " + "{" * 1_000 + "}" * 1_000)])
def test_deep_nesting_is_no_error(ext, text):
    assert not problems(ext, text)


def test_an_error_within_a_line_is_found_again():
    for _ in range(3):
        assert problems("java", "class A { int x = 09; }")


BAD = {'js':['const x;','let let = 1;','x = 1px;','x = 0x;','x = 1__0;','x = 1_;','x = `${a b}`;','x = `${`;','x = `${}`;','x = `a ${ f( } b`;','x = {a: 1,, b};','f(a,,b);','var 1a = 2;','if (a { b }','for (;;','a ? b;','x = a +;','function f( { }','class A { f( { } }','return x y;','let a b;','import x y;','export;','throw\nx;','try { }','switch (a) { case b c: }','do x while y','x = [1, 2;','a => { ','x = 3n4;','x = 0b12;','x = 08n;','const {a};','new;','x..y','a.1','async function () {}','var if = 1;','x = "a','x = /a','let x = 1 let y = 2','} {','else { }','case 1:','a = b = ;','!','function* (){}','({a:1}','x = y z'],
'go':['package p\nvar y','package p\nvar x = 08','package p\nvar x = 0x','package p\nvar x = 1__0','package p\nvar x = 12ab','package p\nfunc f( {}','package p\nfunc f() { if x }','package p\nfunc f() { for { }','package p\nfunc f() { x := }','package p\nfunc f() { x = 1 y = 2 }','package p\nfunc f()\n{\n}','func f() {}','package','package p\nimport x y','package p\ntype T struct { a int b int }','package p\ntype','package p\nfunc f() { return 1, }','package p\nfunc f() { switch { x } }','package p\nfunc f() { a[1 }','package p\nfunc f() { (a }','package p\nfunc f() { else { } }','package p\nfunc f() { if a { }\nelse { } }','package p\nfunc f() { defer }','package p\nfunc f() { go }','package p\nvar s = "a','package p\nvar s = `a',"package p\nvar s = 'a",'package p\nfunc f(a int b int) {}','package p\nfunc f() int { return 1 2 }','package p\nfunc (f() {}','package p\nx := 1','package p\nvar x int = ','package p\nconst = 1','package p\nfunc f() { for i := range { } }','package p\nfunc f() { var }','package p\nfunc f() { x++ + 1 }','package p\nfunc f() { a ? b : c }','package p\nfunc f() { while true { } }','package p\nfunc f() { a.1 }','package p\nfunc f() { map[string]int{ } ','package p\nfunc f() { [ ] }','package p\nfunc f() { case 1: }','package p\nfunc f() { select { x: } }','package p\nfunc f() {}}','package p\nif x {}','package p\nvar x = 1.e','package p\nvar x = 0b2','package p\nvar x = a +','package p\ntype I interface { f( }','package p\ntype M map[string'],
'java':['class A { int x = 09; }','class A { int x = 1_; }','class A { int x = 0xg; }','class A { int x = 12ab; }','class A { void f() { x = ; } }','class A { void f( { } }','class A { int }','class A { void f() { if x { } } }','class A { void f() { for (;;) } }','class A { void f() { return 1 2; } }','class A { int x = 1 int y; }','class A {','class A { } }','@A(x = ) class B {}','@A(x 1) class B {}','@A(1 2) class B {}','@A({1, 2) class B {}','import ;','package ;','import a.;','class A { void f() { try { } } }','class A { void f() { switch (x) { case : } } }','class A { void f() { int if = 1; } }','class A { String s = "a; }',"class A { char c = 'a; }",'class A { void f() { else { } } }','class A { void f() { do { } } }','class A { void f() { while x { } } }','class A { void f() { new ; } }','class A { void f() { f(a,,b); } }','class A { void f() { f(a b); } }','class A { void f() { x + ; } }','class A { void f() { (int) ; } }','class A { void f() { throw ; } }','class A extends { }','class A implements { }','interface I { void f() { }','enum E { A B }','enum E { A( }','class A<T { }','class A { List<int x; }','class A { void f() { int[ x; } }','class A { void f() { a ? b; } }','class A { void f() { x = y z; } }','class A { void f() { catch (E e) { } } }','int;;x class A { }','class A { void f() { int x = 1.e; } }','class A { void f() { for (int i = 0 i < 1; i++) { } } }'],
'rs':['fn f() { let x = 1abc; }','fn f() { let x = 0b2; }','fn f() { let x = 0xg; }','fn f() { let x = ; }','fn f( { }','fn () { }','fn f() { if { } else }','fn f() { let = 1; }','fn f() { x y }','fn f() { let x = 1 let y = 2; }','fn f() {','fn f() } ','struct S { a b }','struct S { a: }','struct { a: i32 }','enum E { A B }','enum E { A( }','impl S { fn }','trait T { fn f( }','use a::;','use ;','mod ;','fn f() { match x { a b } }','fn f() { match x { a => } }','fn f() { for in x { } }','fn f() { for x { } }','fn f() { while }','fn f() { a[1 }','fn f() { (a }','fn f() { f(a,,b); }','fn f() { f(a b); }','fn f() { x + ; }','fn f() { else { } }','fn f() { let s = "a; }','fn f(a i32) {}','fn f(a: ) {}','fn f() -> { }','fn f<T( ) {}','fn f() { let x: = 1; }','fn f() { return 1 2; }','fn f() { a.; }','fn f() { S { a b } }','fn f() { &; }','const X = ;','const X: i32 = ','static : i32 = 1;','type = i32;','pub pub fn f() {}','let x = 1;','fn f() { x = = 1; }','fn f() { |a b| a }','fn f() { let x = 1.0.0f; }'],
'ts':['let x: = 1;','let x: number string;','const x;','interface I { a b }','interface { a: b }','type T = ;','type T<','enum E { A B }','class A { x: ; }','class A { private private( }','function f(a: ) {}','function f(a b) {}','function f<T(a) {}','x as ;','let x = <T>;','class A<T { }','class A { [key: string: number }','class A { [key: ]: number }','abstract class { ','declare ;x y','namespace { }','import { a b } from "x";','import a from ;','import "x" with { a };','import "x" with { type: json };','export { a b };','let f: (a: number = string) => ;','let t: [number, string;','let u: { a: number;','let v: a | ;','type F = (a: ) => void;','function f(): { }{','x = `${a b}`;','let let = 1;','x = 1px;','x = 0b3;','for (const x y) {}','if (a) { else { }','try { } x','switch (a) { b }','new;','async function () {}','class A { f( { } }','let x!: ;','let x: Array<number;','let y: A.;','let z: typeof ;','type M = { [K in ]: V };','@ class A {}']}
GOOD = {'js':['const x = 1;','for (const x of y) {}','for (const x in y) {}','for (let i = 0, n = 1; i < n; i++) {}','x = 0xff + 0b1 + 0o7 + 1_000 + 1n + .5e3 + 08 + 017;','x = `${a} ${`${b}`} ${c ? `d` : {e: 1}.e}`;','x = `${f({a: "}"})}`;','x = `a\\${b`;','let async = 1;','var let_ = 1;','a = b ? c : d;','x = /a[/]b/g.test(y);','label: for (;;) { break label; }','if (a) b; else c;','class A extends B { static #x = 1; get y() { return 1; } static { } async *f() {} }','export default function () {}','export { a as b } from "c";','import a, { b as c } from "d";','import * as x from "y" with { type: "json" };','const {a, b: [c = 1], ...d} = e;','const f = async ({a}) => { await b; };','new A;','x = a?.b?.[c]?.(d) ?? e;','switch (a) { case 1: default: b }','do x(); while (y)','try { } catch { }','throw new Error();','x ||= y; z **= 2;','(function () { return; })();','x = {get a() { return 1; }, set a(v) {}, [b]: c, async d() {}, "e": f, ...g};','function* g() { yield* h(); }','if (a) return_; ','var x\nvar y','x = a\n++b','x = (1, 2);','void 0;','delete a.b;','x = class { };','a = b => c => d;','x = `a\nb`;','x = "a\\\nb";','import("x").then(y);','import.meta.url;','for await (const x of y) {}','x = y / z / w;','debugger;','x = [, , 1];','f(...a, b,);','x = a ? (b) : c => d;','x = 1..toString();'],
'go':['package p\nvar x int\nvar y, z = 1, 2\nconst (\n\tA = iota\n\tB\n)','package p\nvar x = 0xff + 0b1 + 0o7 + 017 + 1_0 + 1.5e3 + .5 + 1i + 0x1p-2','package p\nfunc f[T any](a, b T) (c T, err error) { return a, nil }','package p\nfunc (s *S) f() { for i := range 10 { _ = i } }','package p\nimport (\n\t"a"\n\tb "c"\n\t. "d"\n)','package p\ntype T struct {\n\ta, b int `tag`\n\tE\n\t*F\n}','package p\nfunc f() { switch x := y.(type) { case int, string: default: } }','package p\nfunc f() { select { case a := <-b: case c <- d: default: } }','package p\nfunc f() { if x := g(); x > 0 { } else if y { } else { } }','package p\nfunc f() { defer func() { recover() }(); go g() }','package p\nfunc f() { a, b = b, a; c++; d <<= 2 }','package p\nvar m = map[string][]int{"a": {1}, "b": {}}','package p\nfunc f(a ...int) { f(a...) }','package p\nfunc f() { L: for { break L; continue L } }','package p\ntype I interface { f(a int) string; ~int | string }','package p\nvar s = `a\nb`','package p\nfunc f() { x := []struct{ a int }{{1}, {2}}; _ = x[1:2:3] }','package p\nfunc f() { goto A; A: return }','package p\nvar f = func(a int) func() int { return nil }','package p\nvar c chan<- int = make(chan int, 1)'],
'java':['class A { int x = 017 + 0xFF + 0b1 + 1_000L; double d = 1.5e3f + .5 + 1d + 0x1p3; }','@A(x = 1, y = {1, 2}, z = @B("c")) class C {}','@A("b") @C class D {}','@A({}) class B {}','@A({B.class, C.class,}) class D {}','@interface I { int f() default 1; String[] g() default {"a"}; }','record R(int a, String b) { R { } }','sealed interface S permits A, B {}','enum E { A(1) { void f() {} }, B; E() {} E(int x) {} }','class A<T extends B & C> extends D<T> implements E<?> { }','class A { void f() { var x = switch (y) { case 1, 2 -> 3; default -> { yield 4; } }; } }','class A { void f() { if (o instanceof String s && s.length() > 0) { } } }','class A { void f() { try (var r = g(); var q = h()) { } catch (A | B e) { } finally { } } }','class A { String s = """\n a "b"\n """; }','class A { Runnable r = () -> {}; F<A> g = A::new; H h = (a, b) -> a + b; }','class A { int[][] x = new int[3][], y = {{1}, {2}}; }','class A { void f() { for (int i = 0, j = 1; i < j; i++, j--) ; for (var x : y) { } } }','class A { void f() { label: while (true) { break label; } } }','class A { static { x = 1; } { y = 2; } }','package a.b; import static c.D.*; import e.F; class G { }','class A { <T> T f(T... a) throws B, C { return null; } }','class A { void f() { int x = a ? b : c; x >>>= 2; synchronized (x) { } assert x > 1 : "m"; } }'],
'rs':['fn f() { let x = 1u8 + 0xffu32 + 0b1 + 1_000i64 + 1.5f64 + 1e3 + 2.; }','fn f<T: A + B, const N: usize>(a: &mut T) -> Result<(), Box<dyn E>> where T: C { Ok(()) }','impl<T> A<T> for B<T> { type C = T; const D: i32 = 1; fn f(&self) {} }','fn f() { match x { Some(y) if y > 1 => y, A { b, .. } | C(b) => { b } 1..=2 => 3, _ => 4, } }','fn f() { let Some(x) = y else { return; }; if let A(b) = c && d { } while let Some(e) = f() { } }','fn f() { let g = |a: i32, b| -> i32 { a + b }; let h = move || 1; }','struct S<\'a> { a: &\'a str, pub(crate) b: [u8; 4] } struct T(i32, pub String); struct U;','enum E { A = 1, B(i32), C { d: u8 } }','use a::{b::{self, c as d}, e::*}; pub mod m { use super::*; }','#[derive(Debug)] pub struct S;','macro_rules! m { ($a:expr) => { $a }; } fn f() { m!(1); vec![1, 2]; println!("{}", x) }','async fn f() { g().await?; unsafe { h() } }','fn f() { \'a: loop { break \'a; } let x = if a { 1 } else { 2 }; }','trait T: A { fn f(&self) -> i32; fn g() { } }','fn f() { let s = r#"a"b"#; let c = \'x\'; let b = b"y"; let t = (1, 2).0; }','const X: [i32; 2] = [1; 2]; static mut Y: u8 = 0; type Z = fn(i32) -> u8;','fn f() { S { a, b: 1, ..Default::default() }; x.y::<T>().z[1]; a..b; ..=c; }','fn f() -> impl Fn(i32) -> i32 + \'static { |x| x }'],
'ts':['const x: number = 1;','declare const y: string;','declare namespace N { const z: number; function f(): void; }','interface I<T> extends J { readonly a?: T; [key: string]: unknown; f(): void; new (x: number): I<T>; (y: string): void }','class A { [key: string]: number; private readonly x = 1; constructor(public a: string, private b?: number) { super(); } }','class A { static [key: string]: number }','type T = A | B & C; type F = (a: number, ...b: string[]) => void; type M = { [K in keyof T]?: T[K] }','type C = A extends infer U ? U : never; type L = `a${string}b`;','enum E { A = 1, B = "b" } const enum F { C }','abstract class A<T> implements I { abstract f(): void; protected get x(): number { return 1; } }','function f<T extends A = B>(this: Window, a?: T): asserts a is T { }','let x = y as const; let z = w!; let v = <T>u; let s = t satisfies U;','import type { A } from "b"; import { type C, D } from "e"; export type { F } from "g";','import x from "y" with { type: "json" };','namespace A.B { export const c = 1; }','@dec() class A { @b c: number; @d() f(@e g: string) {} }','function f(a: string): void; function f(a: any) { }','let f = async <T,>(x: T): Promise<T> => x;','let t: [a: number, b?: string, ...c: boolean[]];','export default interface I { }','for (const [k, v] of Object.entries(x)) { }','x = `${a as string}`;']}


@pytest.mark.parametrize("ext", sorted(BAD))
def test_invalid_texts(ext):
    assert [s for s in BAD[ext] if not problems(ext, s)] == []


@pytest.mark.parametrize("ext", sorted(GOOD))
def test_valid_texts(ext):
    assert [(s, problems(ext, s)[:1]) for s in GOOD[ext] if problems(ext, s)] == []
