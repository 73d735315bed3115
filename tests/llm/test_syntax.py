"""The parsers: what is valid passes, what is broken is found, and Python agrees with Python's own parser."""

import ast
import random

import pytest

from weft.llm.checking import cause_of, check_files, acceptance
from weft.llm.parsing_more import check_syntax

VALID = {
    "javascript": [
        "const re = /[(]+x/g; let a = b / c / d;\nfoo(a, ...b);\n", "import a, { b as c } from './x';\nexport default class extends A { static #p = 1; get x() { return this.#p } async *gen() { yield* [1] } }\n",
        "for (const [k, v] of Object.entries(o)) { if (!k) continue; else break }\nlabel: while (true) { break label }\n", "const f = async ({ a, b = 2 }, ...rest) => ({ a, [b]: `x ${a ? `y` : 'z'}`, ...rest });\nvar x = a\n  ? b\n  : c\n",
        "switch (x) { case 1: case 'a': y(); break; default: z() }\ntry { a() } catch { b() } finally { c() }\nif (a) b; else c\ndo x++; while (x < 3)\n", "!function(e,t){\"use strict\";for(var y=0;y<2;y++)r_(y)}();(()=>{a9=function(w){return{l:w}}})();\n", "new Foo;\nnew a.b.C(1)[0]?.d?.(2);\nx = a ?? b ** -c;\ntypeof x === 'y' && delete a.b\n", "",
    ],
    "typescript": [
        "type A<T extends string = 'x'> = { readonly [K in keyof T]?: T[K] } | (a: number) => void | null;\ninterface B extends C<D[]>, E { (x: number): string; m?(): void; readonly [k: string]: any }\n",
        "export abstract class X<T> extends Y<T> implements Z { private readonly a: Map<string, T[]> = new Map<string, T[]>(); constructor(private x?: number) { super() } abstract m(): void; get v(): T { return this.a as unknown as T } }\n",
        "enum E { A = 1, B = 'b' }\ndeclare module 'm' { export function f(x: number): asserts x is 1 }\nconst g = <T,>(x: T): x is T => true;\nfunction f(this: Window, a!: string, b = 1): [a: string, b?: number] { return foo<string>(a)!.x satisfies Y }\n".replace("a!: string", "a: string"),
        "import type { A } from 'a';\nexport type { B } from './b';\nexport * as ns from 'c';\nlet x: number | undefined = y!;\nabstract class Q { protected abstract z: string }\nfor (let i: number = 0; i < 1; i += 1) {}\nconst a = b ? (c) : (d);\n",
    ],
    "java": [
        "package a.b;\nimport static java.util.List.*;\n@Deprecated public final class A<T extends B & C> extends D<T> implements E, F {\n private static final int[] X = {1, 2,}, Y = new int[3];\n A(int... xs) throws IOException { this(xs[0]); }\n <R> R m(Map<String, List<? super T>> m) { for (var e : m.entrySet()) { if (e instanceof Foo f && f.x > 1) return (R) e; } return switch (x) { case 1, 2 -> \"a\"; default -> { yield \"b\"; } }; }\n}\nenum Q { A(1) { void f() {} }, B; int z; }\nrecord P(int x, String y) {}\n@interface R { String value() default \"x\"; }\n",
        'class A { String t = """\n a "q"\n """; Runnable r = () -> System.out.println((Object) t + \'}\'); Supplier<A> s = A::new; int y = x >> 2 >>> 1; void f() { try (var a = b()) { } catch (X | Y e) { throw e; } synchronized (this) { i++; } List<int[]> l = new ArrayList<>(); } }\n',
    ],
    "c": ["#include <stdio.h>\n#define X(a) \\\n  do { a; } while (0)\ntypedef struct node { int v; struct node *next; unsigned f : 3; } node_t;\nstatic const char *names[] = { [0] = \"a\" \"b\", \"c\" };\nint (*fp)(int, char **);\nint main(int argc, char *argv[]) { for (int i = 0; i < 3; i++) { a->b[i] = (char)*p++; } switch (x) { case 1: return 0; default: goto end; } end: return sizeof(struct node) + sizeof x; }\n", "extern int f(void);\nunion u { float f; };\nenum { A, B = 2 };\nsize_t g(const node_t *n) { return n ? n->v : -1; }\n"],
    "cpp": ["namespace a::b { template <typename T, int N = 3> class V final : public B<T>, private C { public: explicit V(int x) : x_(x), y_{1} {} ~V() override = default; V &operator=(const V &) = delete; auto get() const noexcept -> const T & { return x_; } private: std::map<std::string, std::vector<int>> m_; int x_ = 0; }; }\nusing X = std::pair<int, int>;\nint main() { auto f = [&, x = 1](auto &&... a) mutable -> int { return x; }; for (const auto &[k, v] : m) { std::cout << k << v << std::endl; } if (auto p = g(); p != nullptr) delete[] p; try { throw E{}; } catch (const std::exception &e) { } catch (...) { } int *q = new int[3]; return static_cast<int>(a < b ? c : d); }\n"],
    "csharp": ["using System;\nnamespace A.B;\n[Serializable]\npublic sealed record R(int X, string? Y = null) : Base(X), I { public int P { get; private set; } = 1; public string Q => $\"a{X}b\"; event EventHandler E; public static R operator +(R a, R b) => a; int this[int i] { get => i; } public async Task<List<int?>> M<T>(ref int a, params T[] b) where T : class, new() { await foreach (var x in Y()) { if (x is { Length: > 1 } z and not null) yield return z ?? throw new E(); } using var s = new S { A = 1, [2] = 3 }; var l = (a, b) => a?.b?[0]; lock (this) { } switch (x) { case int n when n > 1: goto default; default: break; } return x switch { 1 => 2, _ => 3 }; } }\n"],
    "go": ["package main\n\nimport (\n\t\"fmt\"\n\tm \"math\"\n)\n\ntype S[T any] struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\n\ntype I interface {\n\tF(x int) (y string, err error)\n\t~int | string\n}\n\nfunc (s *S[T]) M(xs ...int) <-chan int {\n\tif v, ok := m[k]; ok && v > (T{1}).x {\n\t\treturn nil\n\t} else if x := f(); x {\n\t}\n\tfor i, v := range xs {\n\t\tswitch t := v.(type) {\n\t\tcase int, *S:\n\t\t\tcontinue\n\t\tdefault:\n\t\t}\n\t\t_ = i\n\t}\n\tselect {\n\tcase x := <-c:\n\tcase c <- 1:\n\t}\n\tdefer func() { recover() }()\n\tgo f(map[string][]int{\"a\": {1, 2}}, []P{{1, 2}}...)\n\treturn c\n}\n\nvar q = '}'\n"],
    "rust": ["use std::{io, collections::HashMap as M};\n#[derive(Debug)]\npub struct S<'a, T: Clone + 'a> where T: Copy { pub(crate) x: &'a mut T, y: Option<Box<dyn Fn(i32) -> i32>> }\nimpl<'a, T> Tr for S<'a, T> { const N: usize = 1 << 3; fn f(&mut self, (a, b): (u8, [i32; 3])) -> Result<(), E> { let Some(x) = y else { return Err(e)?; }; let v = vec![1, 2]; match x { 0..=9 | 20 => {} E::A { z, .. } if z > 1 => return Ok(()), ref q @ (1 | 2) => f(q), _ => panic!(\"{}\", x), } for i in 0..v.len() { if let Some(n) = v.get(i) && *n > 1 { continue 'o; } } let c = move |a: i32| a as u64 + 1; let s = S { x, ..Default::default() }; unsafe { *p = '\\u{1F600}'; } loop { break; } Ok(()) } }\nmacro_rules! m { ($x:expr) => { $x } }\npub enum E { A, B(i32), C { x: u8 } }\nfn main() { println!(r#\"a\"b\"#); }\n"],
    "python": ["x: int = 1\n", "def f(a, /, b=1, *c, d: int = 2, **e) -> int:\n    '''doc'''\n    return [i for i in a if i if not b] + [*c] if d else (yield)\n", "@deco(1)\nasync def g():\n    async with a as b, c:\n        await d\n    try:\n        pass\n    except* E as e:\n        raise X from e\n    else:\n        del a[1:2, ...]\n    finally:\n        global q\n", "match x:\n    case [1, *_] | {'a': b} if b:\n        pass\n    case P(x=1) as q:\n        pass\nmatch = 1\nprint(match, f'{x!r:>{w}}')\nif (n := 3) > 2: pass\nlambda *a, k=1: a\nx = y = a if b else c,\n", ""],
}
BROKEN = {
    "javascript": ["let x = ;", "function f( { }", "if (a { b }", "const a: number = 1;", "a b", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> z\n", "package main\n", "let s = 'abc", "x = (1 + ;", "class A { f() { }", "import os\nimport re\n"],
    "typescript": ["let x: = 1;", "interface A { x: ; }", "class A { private f( { } }", "package a.b;\nimport java.util.List;\npublic class A { }\n"],
    "java": ["class A { void f() { int x = ; } }", "class A { void f() { }", "import json\n", "class A { void f( { } }", "404: Not Found"],
    "c": ["int f( {", "int main() { return 0 }", "int x = 3", "int f() { a b c; }"],
    "cpp": ["class A { public: void f() { }", "int f() { std::cout << ; }"],
    "csharp": ["class A { int F() { return } }", "class A { var x = 1; }", "package policy\n"],
    "go": ["func f() {}", "package p\nfunc f( {\n}\n", "package p\nfunc f() {\n\tx := \n}\n", "package p;\nclass A {}\n"],
    "rust": ["fn f( -> i32 { }", "fn f() { let x = ; }", "fn f() { if x { }", "package a;", "fn f() -> { 1 }"],
    "python": ["def f(:\n    pass\n", "if x:\n", "x = (1,\n", "  x = 1\n y = 2\n", "print 'a'\n", "for i in range(x:\n    pass\n", "x = 'abc\n", "try:\n    pass\nx = 1\n", "const a = 1;\n", "else:\n    pass\n"],
}


@pytest.mark.parametrize("lang", VALID)
def test_valid(lang):
    for text in VALID[lang]:
        assert check_syntax(text, lang) == [], text
        assert check_syntax(text.replace("\n", "\r\n"), lang) == [], text


@pytest.mark.parametrize("lang", BROKEN)
def test_broken(lang):
    for text in BROKEN[lang]:
        assert check_syntax(text, lang), text


def test_python_agrees_with_its_own_parser():
    random.seed(5)
    base = "\n".join(VALID["python"][:3]).splitlines()
    wrong = 0
    for _ in range(400):
        lines = list(base)
        i = random.randrange(len(lines))
        op = random.randrange(4)
        if op == 0:
            del lines[i]
        elif op == 1:
            lines = lines[:i] + [lines[i][: random.randrange(len(lines[i]) + 1)]]
        elif op == 2 and lines[i]:
            k = random.randrange(len(lines[i]))
            lines[i] = lines[i][:k] + random.choice("()[]{}:,'") + lines[i][k:]
        else:
            lines[i] = "  " + lines[i]
        text = "\n".join(lines) + "\n"
        try:
            ast.parse(text)
            ok = True
        except SyntaxError:
            ok = False
        wrong += ok != (not check_syntax(text, "python"))
    assert wrong <= 12  # 3 %: places the grammar leaves to later passes


def test_all_errors_are_kept_and_placed():
    errors = check_syntax("class A {\n void f() { int x = ; }\n void g() { y = ; }\n void h() { ok(); }\n}\n", "java")
    assert [n for n, _ in errors] == [2, 3]
    assert cause_of(check_syntax("a;\n<<<<<<< x\nb;\n=======\nc;\n>>>>>>> y\n", "javascript")) == "conflict"
    assert cause_of(check_syntax("function f() {\n  a();\n", "javascript")) == "truncated"


def test_shapes_are_remembered():
    from weft.llm.parsing import Parser

    check_syntax("function f() { " + "a = b + 1; " * 50 + "}", "javascript")
    assert Parser.memo


def test_deep_nesting_does_not_crash():
    assert isinstance(check_syntax("x = " + "(" * 5000 + ")" * 5000 + ";", "javascript"), list)
    assert isinstance(check_syntax("x = " + "[" * 3000 + "]" * 3000 + "\n", "python"), list)


CHAINS = {
    "javascript": ("function f(a) {\n%s\n}\n", "if (a == 1) { return 1; }"), "typescript": ("function f(a: number) {\n%s\n}\n", "if (a == 1) { return 1; }"), "java": ("class A { int f(int a) {\n%s\nreturn 0; } }\n", "if (a == 1) { return 1; }"),
    "csharp": ("class A { int f(int a) {\n%s\nreturn 0; } }\n", "if (a == 1) { return 1; }"), "c": ("int f(int a) {\n%s\nreturn 0; }\n", "if (a == 1) { return 1; }"), "cpp": ("int f(int a) {\n%s\nreturn 0; }\n", "if (a == 1) { return 1; }"),
    "go": ("package p\nfunc f(a int) int {\n%s\nreturn 0\n}\n", "if a == 1 { return 1 }"), "rust": ("fn f(a: i32) -> i32 {\n%s\n return 0; }\n", "if a == 1 { return 1; }"),
}


@pytest.mark.parametrize("lang", CHAINS)
def test_long_chains_and_later_errors(lang):
    frame, branch = CHAINS[lang]
    text = frame % "\nelse ".join([branch] * 1500)
    if lang == "go":
        text = frame % " else ".join([branch] * 1500)
    assert check_syntax(text, lang) == []
    assert [n for n, _ in check_syntax(text + frame % "x = ;", lang)][0] > text.count("\n")


def test_deep_brackets_are_valid():
    for lang, end in (("javascript", ";"), ("python", "")):
        assert check_syntax("x = " + "[" * 3000 + "1" + "]" * 3000 + end + "\n", lang) == []


def test_tables(spark):
    rows = [(1, "File:a.py", "r", "x = (\n", 9), (2, "File:a.py", "r", "x = (\n", 9), (3, "File:b.py", None, "x = 1\n", 9), (4, "File:c.py", "r", None, 9), (5, "File:d.txt", "r", "(", 9), (6, None, "r", "x", 9), (7, "File:e.py", "r", "", 9)]
    files = spark.createDataFrame(rows, "seq long, id string, repo string, content string, errors int")
    checked = check_files(files)
    assert sorted((r["id"], r["errors"] > 0) for r in checked.collect()) == [("File:a.py", True), ("File:a.py", True), ("File:b.py", False), ("File:e.py", False)]
    assert sorted((str(r["repo"]), r["files"], r["broken"]) for r in acceptance(checked).collect()) == [("None", 1, 0), ("r", 2, 1)]
    assert check_files(files.limit(0)).count() == 0
