import ast
import json

import pytest

from stratoloom.llm.gll import Grammar
from stratoloom.llm.lexers import language
from stratoloom.llm.parse_check import flag_unparsable, parse_rates, refused

GOOD = {
    "python": [
        "", "\n# only a comment\n", "x = 1\r\nif x:\r\n\ty = 2\r\n", "def f(a, /, b: int = 1, *c, d=2, **e) -> int:\n    return (yield)\n",
        "async def g():\n    async with a as b, c: pass\n    return [x async for x in y if x]\n", "match p:\n    case {'a': [1, *_], **r} | C(x=1) as q if q: pass\n    case _: pass\n",
        "f'{a!r:>{w}} {{}} {b[\"x\"]=}'\n", "class A[T](B, metaclass=M):\n  x: int = 3\n\n  @d\n  def f(self): ...\n", "type X[T] = list[T]\nmatch = case = type = 1\nprint(match)\n",
        "try:\n  pass\nexcept* E as e:\n  raise X from e\nelse:\n  pass\nfinally:\n  pass\n", "lambda *a, b=1: (a, b)\nx[1:2, ::3, ...]\n(y := 5)\nwith (open(a) as f, open(b)): pass\n",
        "if a:\n    pass\n  # odd comment\nelse:\n    pass\n", "a = b if c else d\nglobal z\nassert a, b\ndel a, b[0]\nfrom . import (x as y,)\n", "x = 0xFF_FF + 1_000.5e-3j\ns = rb'\\x' b\"y\"\n",
    ],
    "json": ['{"a": [1, -2.5e+3, true, null, "\\u00e9"]}', " 5 ", '""', "[]"],
    "go": [
        "package a\n", "package a\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\ntype T[K comparable, V any] struct {\n\tA, B int `json:\"a\"`\n\t*C\n}\nfunc (t *T[K, V]) F(a, b int, c ...string) (x int, err error) {\n\tfor i := range 10 { _ = i }\n\tif v, ok := m[k]; ok { return }\n\tswitch y := x.(type) {\n\tcase int, []string:\n\tdefault:\n\t}\n\tgo func() { ch <- 1 }()\n\tdefer f()\n\tselect { case v := <-ch: use(v)\n\tdefault: }\n\tL: for { break L }\n\treturn T2{A: 1, B: []int{1, 2}}.X, nil\n}\n",
        "package a\nvar m = map[string][]func(int) error{\"a\": {nil}}\nconst (\n\tA = iota\n\tB\n)\ntype I interface {\n\t~int | ~string\n\tF(x int) bool\n}\n",
    ],
    "java": [
        "", "package a.b;\nimport static x.Y.*;\n@A(b = {1, 2}) public final class C<T extends D & E> extends F<T[]> implements G, H<? super T> {\n int[] a = {1, 2}, b[];\n static { x(); }\n C() { super(); }\n <U> U f(final int... x) throws Ex { for (int i = 0, j = 1; i < j; i++) { continue; } for (var q : list) if (q instanceof String s && s.length() > 2) return (U) q; else throw new RuntimeException(\"x\"); do { } while (true); }\n}\n",
        "sealed interface S permits A, B {}\nrecord A(int x, String... y) implements S { A { if (x < 0) throw new E(); } }\nenum E { P(1) { void f() {} }, Q; int v; }\n",
        "class X { String t = \"\"\"\n  a \"b\" \\\n  \"\"\"; int s(int k) { return switch (k) { case 1, 2 -> 3; default -> { yield 4; } }; } Runnable r = () -> { }; F g = (a, b) -> a >> b >>> 1; Object o = Foo::<T>bar; Supplier s = ArrayList<String>::new; int[][] m = new int[3][]; }\n",
        "module a.b { requires transitive c; exports d to e; }\n",
    ],
    "javascript": [
        "", "import a, { b as c, default as d } from 'x';\nexport default class extends A { #p = 1; static { f(); } get x() { return this.#p } static async *g() {} [k]() {} }\n",
        "const { a, b: { c = 1 }, ...d } = e, [f, , g] = h\nlet x = a?.b?.[c]?.(d) ?? /re[/]x/gi.test(y)\nlabel: for (const k of m) { if (k) continue label\n else break }\n",
        "const f = async ({ a }, ...b) => { await a; for await (const c of d) ; }\nconst t = `a ${`n ${x}`} b`\nvar q = a ? (b, c) : d => e\nx = y\n++z\nreturn_ = 1\n", "switch (a) { case 1: case 2: b(); break; default: }\ntry { } catch { } finally { }\ndo x++; while (x < 5) y()\nif (a) ; else b()\n",
        "export * as n from 'y'\nexport { a as default }\nfunction F() { new.target }\nvar o = { get, set, async, get a() { return 1 }, async *b() {}, 'c': 1, 2: 3, [d]: 4, ...e }\na ||= b\nc **= 2\n", "#!/usr/bin/env node\nif (/x/.test(a) && b / c / d) e()\n",
    ],
    "rust": [
        "", "//! x\nuse a::{b::*, self as c, d};\n#[derive(Debug)]\npub(crate) struct S<'a, T: ?Sized + 'a, const N: usize = 3>(pub &'a [T; N]) where T: Fn(u8) -> Option<Vec<u8>>;\n",
        "impl<T> Trait for S<T> { const X: u8 = 1; type Y = <T as I>::Z; async unsafe fn f<'b>(&'b mut self, (a, _): (i32, u8)) -> impl Iterator<Item = u8> + 'b { let Some(x) = y else { return Err(e)?; }; match x { 1..=5 | 7 if a => { } A::B { c, .. } => d, ref z @ 3 => (), _ => unreachable!(\"{}\", 1), } } }\n",
        "fn main() { 'a: loop { break 'a; } let c = move |x: u8, y| -> u8 { x + y }; let s = r#\"a \"b\" \"#; let v = vec![1; 3]; for (i, x) in v.iter().enumerate() {} if let Some(q) = &w { } else if a < b as usize { } let r = ..=5; let t = (1,); x.0.1; a.b::<Vec<Vec<u8>>>(); S { a, b: 1, ..d }; &mut *p; -1i64 as u8 << 2; /* a /* nested */ b */ }\n",
        "macro_rules! m { ($x:expr) => { $x + 1 }; }\nextern \"C\" { fn g(x: *const u8, ...); }\nunion U { a: u8 }\nstatic mut Z: dyn_ = 1;\ntrait T: A + B { fn f(&self) where Self: Sized; type X: Clone; }\nenum E { A = 1, B(u8), C { x: u8 } }\npub mod m { pub use super::x; }\n",
    ],
}
BAD = {
    "python": ["def f(:\n  pass\n", "x = (1\n", "if a:\npass\n", "  x = 1\n", "a = 'x\n", "<<<<<<< ours\nx = 1\n", "f'{a b}'\n", "package main\n", "x = 1 +\n", "try:\n  pass\n", "class A\n  pass\n", "x = “a”\n", "if a:\n    b\n  c\n", "print(a b)\n", "x = 01\n"],
    "json": ["", "{'a': 1}", "[1,]", '{"a": 1} x', '{"a" 1}', "01", '"a\nb"', "NaN", "// c\n1", '{"a": 1,}'],
    "go": ["func f() {}\n", "package a\nfunc f() {\n", "package a\nfunc f() { x := }\n", "package a\n=======\n", "package a\nvar x = `a\n", "package a\nfunc f(a int b int) {}\n", "package a\nx := 1\n"],
    "java": ["class A {", "class A { int x = 1 }", "class A { void f() { g(); } }}", "public fn x() {}", "class A { String s = \"a; }", "class A { void f() { if (x) } }", "class A { >>>>>>> b\n }", "class A { try { } }"],
    "javascript": ["function f() {", "let a = ;", "const x = {a: 1,, b: 2};", "if (a { b() }", "def f():\n  pass\n", "a b", "x = `a ${b`", "<<<<<<< HEAD\nlet a\n", "import { a from 'b';", "for (;;) {", "var s = 'a\n'", "foo(a b)"],
    "rust": ["fn f( {", "fn f() { let x = ; }", "fn f() { a b }", "struct S { a: u8 b: u8 }", "fn f() { match x { 1 => } }", "fn f() { \"x }", "/* a /* b */", "======= \nfn f() {}", "use a::b", "fn f() -> { }", "x = 1;"],
}


@pytest.mark.parametrize("lang", sorted(GOOD))
def test_valid_texts_are_accepted(lang):
    for text in GOOD[lang]:
        assert not refused(text, lang), text


@pytest.mark.parametrize("lang", sorted(BAD))
def test_broken_texts_are_refused(lang):
    for text in BAD[lang]:
        assert refused(text, lang.upper()), text


def test_python_agrees_with_the_interpreter_on_its_own_library():
    import pathlib

    lang, n = language("python"), 0
    for p in sorted(pathlib.Path(ast.__file__).parent.glob("*.py"))[:60]:
        text = p.read_text(encoding="utf-8", errors="replace")
        try:
            ast.parse(text)
            ok = True
        except (SyntaxError, ValueError):
            ok = False
        assert lang.valid(text) == ok, p
        n += 1
    assert n > 30


def test_json_agrees_with_the_standard_library():
    def plain(text):
        try:
            json.loads(text, parse_constant=lambda x: 1 / 0)
            return True
        except (ValueError, ZeroDivisionError):
            return False

    for text in [*GOOD["json"], *BAD["json"], "[[[]]]", "{}", "[1 2]", '{"a":{"b":[{}]}}', "tru", "-", "1e5", "1.", ".5"]:
        assert (not refused(text, "json")) == plain(text), text


def test_ambiguous_grammars_share_their_stacks():
    g = Grammar("s = 'a' | s s ; t = s 'b' ;")
    assert g.accepts([g.kind["a"]] * 12, ["s"]) and not g.accepts([g.kind["a"], g.kind["b"]], ["s"])
    assert g.run((g.kind["a"], g.kind["b"]), [(0, "s"), (1, "t")]) == 2


def test_flags_and_rates(spark):
    rows = [(1, 7, "Python", "x ="), (2, 7, "python", "x = 1"), (3, 7, "markdown", "("), (4, 7, "json", None), (5, None, None, "("), (2, 7, "python", "x = 1"), (6, 8, "json", "")]
    df = spark.createDataFrame(rows, "file_id long, project_id int, language string, content string")
    out = flag_unparsable(df, keep=("file_id", "project_id", "language"))
    assert sorted((r.file_id, r.checked, r.unparsable) for r in out.collect()) == [(1, True, True), (2, True, False), (2, True, False), (3, False, False), (4, False, False), (5, False, False), (6, True, True)]
    assert {(r.project_id, r.files, r.unparsable_files) for r in parse_rates(out, "project_id").collect()} == {(7, 3, 1), (8, 1, 1)}
    assert flag_unparsable(df.where("false"), keep=("file_id",)).count() == 0


def test_long_and_deep_texts():
    assert not refused("x = 1\n" * 50_000, "python")
    assert not refused("[" * 5000 + "]" * 5000, "json")
    assert refused("[" * 5000 + "]" * 4999, "json")


def test_templates_and_raw_strings_of_any_depth():
    deep = "`${" * 300 + "1" + "}`" * 300
    for text in ["`${xs.map(x => { return `<li>${x}</li>`; })}`", "`${f(() => { if (a) { return {b: 1}; } })}`", "x = `${a}/${b}/c`", "`a ${/[}`]/.test(x) ? `y` : 'z'}`", deep]:
        assert not refused(text, "javascript"), text
        assert "".join(language("javascript").find(f"{text};\n")) == f"{text};\n" and language("javascript").find(f"{text};")[-2].endswith("`")
    for text in ["`${a b}`", "`${}`", "`${`${a}`", "`${f(() => { if (a) { return {b 1}; } })}`", "`a ${b}} `}", deep[:-1]]:
        assert refused(text, "javascript"), text
    for n in (1, 3, 4, 7, 255):
        text = 'fn f() { g(br%s"a "b%s "%s); }' % ("#" * n, "#" * (n - 1), "#" * n)
        assert not refused(text, "rust") and refused(text.replace("#)", ")"), "rust"), n


def test_what_is_no_assignment_target_is_refused():
    for text in ["f(x) = 1\n", "x + 1 = 2\n", "def f(a=1, b): pass\n", "f(a=1, 2)\n", "try:\n  pass\nexcept A, e:\n  pass\n"]:
        assert refused(text, "python"), text
    for text in ["a + b = c", "1 = 2", "a + b += c", "a?.b = c", "f()++", "++1", "[a, 1] = b", "({a: 1} = b)", "let {a: 1} = b", "x = {a = 1}", "for (a + b of c) ;", "a || b => c", "x = `${1 = 2}`"]:
        assert refused(text, "javascript"), text
    for text in [
        "a.b = c[d] += f().e = 1", "(a) = (b.c) = d", "[a, b.c, , ...d[0]] = e", "({ a, b: [c.d = 1], e = 2, ...f } = g)", "for ({ a = 1 } of b) ;", "for (a.b in c) ;", "--a.b; c[0]++; - --d",
        "let [{ a = 1, b: [c] = [] }, ...d] = e", "f = ({ a = 1 }, [b]) => ({ a, b })", "a ? b = 1 : c => d", "a && (b = c); (a?.b).c; new.target.x; new A().b = 1; a = b ||= yield_", "x = await a.b++", "this.#a ??= async b => c", "`a`.b = super.c = import.meta.d = 1",
    ]:
        assert not refused(text, "javascript"), text


REFUSED = {
    "javascript": [
        "1 = 2;", "f() = 1;", "a?.b = 1;", "const x;", "let {a};", "var x = 010;", "-1 ** 2;", "await_ = -a ** b", "a ?? b || c;", "a && b ?? c", "({a=1});", "return 5;", "break;", "continue", "if (a) { return 1 }", "function f() { await x }",
        "async function f() { for await (a in b) ; }", "x = /a/gg", "x = /a/q", "x = /a/uv", "'\\x1'", "'\\u{}'", "x = 1_", "x = 1__0", "function f() { break }", "while (a) { function g() { break } }", "a + #b", "x = 09", "'\\07'", "const f = () => { continue }",
    ],
    "java": ["class A { void f() { 1 + 1; } }", "class A { void f() { a.b; } }", "class A { int x = 09; }", "class A { void f() { f() = 1; } }", "class A { void f() { this = 1; } }", "class A { void f() { x + y = 1; } }", "class A { int x = 1_; }", "class A { int x = a ? b : c = d; }", "class A { void f() { (a)++ ++; } }"],
    "go": ["package a\nvar x = 08\n", "package a\nfunc f() { go x }\n", "package a\nfunc f() { defer 1 }\n", "package a\nfunc f() { 1 := 2 }\n", "package a\nfunc f() { x, y++ }\n", "package a\nfunc f(a int, string) {}\n", "package a\nvar x = \"\\q\"\n", "package a\nfunc f() { a.b, c := 1, 2 }\n", "package a\nvar x = 0x\n", "package a\nfunc f() { for 1 := range x {} }\n", "package a\nvar x = 1\0\n"],
    "rust": ["fn f() { a < b < c; }", "fn f() { a == b == c; }", "fn f() { g(\"\\q\"); }", "fn f() { if S { a: 1 } { } }", "fn f() { for x in S { a: 1 } { } }", "fn f() { a = b < c >= d; }"],
    "python": [
        "f(x) = 1\n", "a + b = c\n", "(a, 1) = b\n", "None = 1\n", "a, b += 1\n", "(a, b): int = c\n", "del f()\n", "del a + b\n", "for f() in x: pass\n", "with a as f(): pass\n", "def f(a=1, b): pass\n", "def f(*): pass\n", "def f(**a, b): pass\n",
        "def f(a, /, b, /): pass\n", "def f(/, a): pass\n", "lambda a=1, b: a\n", "f(a=1, b)\n", "f(**a, b)\n", "f(**a, *b)\n", "try:\n  pass\nexcept A, e:\n  pass\n", "'\\x1'\n", "b'\\x'\n", "'\\u12'\n", "x = 1\0\n", "a = b += c\n", "[x for f() in y]\n", "x = 1 = 2\n", "1: int\n",
    ],
}
ACCEPTED = {
    "javascript": [
        "function f() { return 1 }", "const f = () => { return 1 }", "class A { m() { return 1 } async n() { await x } get p() { return 1 } [q]() { return 2 } }", "while (a) { if (b) break; else continue }", "for (;;) break;", "switch (a) { case 1: break }", "l: { break l }", "await x",
        "a = -(b ** c); d = (-e) ** f; g **= 2 ** -1", "a = (b ?? c) || d; e ?? f ?? g; h && i || j", "let a, b = 1; const {c} = d; for (const e of f) ; for (let g in h) ;", "x = {return: 1, break() { }, await: 2}; x.return(); y.break", "for await (const a of b) ;",
        "'\\u{1F600}\\x41\\0\\n\\\n'", "x = 0b1_0 + 0xF_F + 1_000.5e-1_0 + 10n + .5", "if (#a in b) c()", "do { if (x) continue; } while (a)", "const g = async x => { await x }; h(async () => { await y })", "export function f(a) { for (const x of a) { if (x) { return x } } }", "function f() { return g(async x => await x) }", "if (a) { function g() { return 1 } }",
    ],
    "java": ["class A { void f() { a.b(); x = y; x += 1; i++; --j; new B(); a[0] = 1; this.x = 2; (y) = 3; a.new C(); f().x >>= 2; b >>>= 1; int z = 07; for (i = 0, j = 1; ; i++, f()) ; Runnable r = () -> x = 1; this.<T>g(); super.h(); } A() { this(1); } }", "class A { int x = 0x1_0 + 0_7 + 1_0; float f = 09.5f; Object o = (Runnable & X) () -> { }; int y = a ? b : c; int w = q = 2; }"],
    "go": ["package a\nfunc f(a, b int, c ...string) {}\nfunc g(int, string) {}\nfunc h(a, b, c) {}\nfunc i(x map[string]int, y func(int) error) (z, w int) { go f(); defer func() {}(); x, y := 1, 2; x, y = y, x; for k, v := range m { _ = k }; for range n {}; a.b[0]++; c += 1; go a.b(c)(d); return }\nvar x = 07 + 0x1F + 0b1 + 08.5 + 09i\n"],
    "rust": ["fn f() { a < b && c < d; (a < b) == c; if x == (S { a: 1 }) { } match a { S { b } => S { b: 2 }, }; let x = S { a: 1 } == y; while let Some(x) = a.b(|z| z.c) { } a += b; c = d = e; f(..3); g[1..]; for i in 0..n { } if a as usize < b { } \"\\u{1F600}\\x41\"; a <<= 1; b >>= 2; r\"\\q\"; x >= y; }"],
    "python": [
        "a = b, *c = d\n", "(a) = [b, (c.d, e[0])] = f\n", "a.b += 1\n", "(a): int = 1\n", "a[0]: int\n", "del (a, [b]), c.d,\n", "for a, *b in c: pass\n", "with a as (b, c), d as e[0]: pass\n", "def f(a, b=1, /, c=2, *d, e, f=3, **g): pass\n", "def f(*, a): pass\n", "def f(a, /): pass\n", "def f(a=1, /, b=2, *, c): pass\n",
        "lambda a, b=1, *c, d, **e: a\n", "lambda *, a: a\n", "lambda: 0\n", "f(a, *b, c, d=1, *e, f=2, **g, h=3)\n", "f(x for x in y)\n", "f(*a, **b,)\n", "f().a = g()[0] = 1\n", "[x for x, in y for z[0] in x]\n", "'\\N{EM DASH}\\x41\\u1234'\nb'\\u'\n", "a = yield_ = 1\nx = (yield)\n", "f'{a\n}'\n", "*a, b = c\nprint(*a, sep='')\n", "a = b = yield\n".replace("yield", "c"),
    ],
}


@pytest.mark.parametrize("lang", sorted(REFUSED))
def test_what_parsers_refuse_beyond_structure(lang):
    for text in REFUSED[lang]:
        assert refused(text, lang), text
        if lang == "python":
            with pytest.raises((SyntaxError, ValueError)):
                ast.parse(text)
    for text in ACCEPTED[lang]:
        assert not refused(text, lang), text
        if lang == "python":
            ast.parse(text)


def test_copies_are_parsed_once(monkeypatch):
    lang, calls = language("go"), []
    monkeypatch.setattr(type(lang), "valid", lambda self, text: calls.append(text) or True)
    assert [refused("package only_here\n", "Go ") for _ in range(3)] == [False] * 3 and len(calls) == 1
