"""Layouts that need more than patterns: literals with code inside, constructors, declarations, nesting, bodies on one line."""

import pytest
from test_scanner import facts

from skein.sources import lexer

#: (language, text, definitions in order, calls left to other files in order)
LAYOUTS = [
    # new makes an object and calls nothing; a chained call is one
    ("java", "class A {\n  void f() { Crate c = new Crate(1); c.lift(new sea.Rope(2)).haul(); }\n}\n", ["A", "f()"], ["lift", "haul"]),
    ("javascript", "function f() { return new Crate(load(1)); }\n", ["f()"], ["load"]),
    ("csharp", "class A { void F() { var c = new Crate(1) { X = G(2) }; } }\n", ["A", "F()"], ["G"]),
    ("dart", "class A {\n  A(this.x);\n  A.named(int y) : x = g(y);\n  void f() { var c = new Crate(1); h(c); }\n}\n", ["A", "f()"], ["g", "h"]),
    ("scala", "class A {\n  def f() = { val c = new Crate(1); g(c) }\n}\n", ["A", "f()"], ["g"]),
    ("php", "<?php\nclass A { function f() { return g(new \\Sea\\Crate(1)); } }\n", ["A", "f()"], ["g"]),
    # constructors: no node in Java and C#, one in C++, JavaScript's is a method
    ("java", "class A {\n  A(int x) { super(x); g(); }\n  <T> T f(T x) throws IOException { return h(x); }\n}\n", ["A", "f()"], ["g", "h"]),
    ("csharp", "class A : B {\n  public A(int x) : base(x) { G(); }\n  int F<T>(T x) => H(x);\n}\n", ["A", "F()"], ["G", "H"]),
    ("cpp", "class A : public B {\n public:\n  A(int x) : b(x), c{g(x)} { h(); }\n  ~A() { gone(); }\n  int f();\n  virtual void k() const = 0;\n};\n", ["A", "A()"], ["g", "h"]),
    ("cpp", "int A::f() { return g(); }\nint A::A() : b(1) { h(); }\nint free_one() { return k(); }\n", ["free_one()"], ["k"]),
    ("javascript", "class A { constructor(x) { super(x); g(); } get size() { return h(); } }\n", ["A", "constructor()", "size()"], ["g", "h"]),
    # declarations aren't calls
    ("c", "int f(void);\nchar *g(int x);\n#define TWICE(x) h(x)\nint main(void) { int (*p)(void) = 0; return f2(g2(1)); }\n", ["main()"], ["f2", "g2"]),
    ("cpp", "template <class T> struct Box { T get() { return make(); } };\nstd::vector<int> all();\nint f() { Box b(1); return b.get(); }\n", ["Box", "get()", "f()"], ["make"]),
    ("java", "interface A { int f(); default int g() { return h(); } }\nenum Kind { RED(1), BLUE(2); int k() { return m(); } }\n", ["A", "f()", "g()", "k()"], ["h", "m"]),
    ("go", 'package a\nimport (\n\t"fmt"\n\t"os"\n)\ntype R interface {\n\tRead(p []byte) (int, error)\n}\nfunc f() interface{} { return init2(values(1)) }\nfunc (r *T) g(x func(int) int) {\n\tif ok(x) { print(x) }\n}\n', ["R", "f()", "T", "g()"], ["init2", "values", "ok", "print"]),
    ("rust", "#[derive(Debug)]\nenum E { A(i32), B { x: u8 } }\nstruct P(i32);\ntrait T { fn sig(&self); }\nimpl P { fn f(&self) -> i32 { if let Some(x) = g() { h(x) } else { match k() { Ok(v) => m(v), Err(_) => 0 } } } }\n", ["P", "f()"], ["g", "h", "k", "m"]),
    # names that are words of other languages
    ("java", "class A { void f() { list.match(x); print(y); array(z); init(1); } }\n", ["A", "f()"], ["match", "print", "array", "init"]),
    ("kotlin", "class A {\n  fun f() {\n    print(list(1))\n    x.init(2)\n  }\n}\n", ["A", "f()"], ["print", "list", "init"]),
    ("swift", "class A {\n  init(x: Int) { super.init(); g() }\n  func f() { print(values(1)) }\n}\nenum E { case a(Int) }\nprotocol P { func sig() -> Int }\n", ["A", "f()"], ["init", "g", "print", "values"]),
    ("javascript", "function f() { p.then(g).catch(h()); if (x) { while (y) { k(); } } }\n", ["f()"], ["then", "catch", "h", "k"]),
    # bodies on one line, without brackets, and nested
    ("kotlin", "class A(val x: Int) : B(x) {\n  fun one() = g(x)\n  fun two(): Int {\n    return h()\n  }\n  class C { fun three() = k() }\n}\n", ["A", "one()", "two()", "C", "three()"], ["g", "h", "k"]),
    ("scala", "class A(x: Int) extends B(x) {\n  def one = g(1)\n  def two(y: Int): Int =\n    h(y)\n  def three() = { y match { case Some(z) => k(z) } }\n}\n", ["A", "one()", "two()", "three()"], ["g", "h", "k"]),
    ("java", "class A { class B { int f() { return g(); } } int h() { return k(); } }\n", ["A", "B", "f()", "h()"], ["g", "k"]),
    ("typescript", "class A<T> { f<U>(x: U): T { return g<T>(x); } }\nexport async function h(): Promise<void> { await k(); }\n", ["A", "f()", "h()"], ["g", "k"]),
    ("tsx", "class A { f() { return <B onClick={() => g(1)}>Don't h</B>; } }\n", ["A", "f()"], ["g"]),
    ("dart", "class A { int f(int x) => g<int>(x); }\nvoid main() { h(); }\n", ["A", "f()", "main()"], ["g", "h"]),
    ("sql", "create function a(x integer) returns integer as $$ select b(x, 'c(1)'); $$ language sql;\nselect d(1);\n", ["a()"], ["b", "d"]),
    ("powershell", "function A { B 'x'; if ($y) { Get-C \"$(Get-D 1)\" } }\n", ["A()"], ["B", "Get-C", "Get-D"]),
    # annotations and attributes
    ("java", "class A { @Size(max = 3) int x; @Test(timeout = 1) void f() { g(); } }\n", ["A", "f()"], ["g"]),
    ("csharp", "class A {\n  [Obsolete(\"x\")]\n  void F() { G(); }\n}\n", ["A", "F()"], ["G"]),
    ("php", "<?php\n#[Route('/x')]\nfunction f() { g(); }\n", ["f()"], ["g"]),
    # literals
    ("java", 'class A { String f() { return """\n   g() "h()" k()\n   """ + m(\'(\'); } }\n', ["A", "f()"], ["m"]),
    ("php", "<?php\nfunction f() { $x = <<<EOT\n g() {$a->h(1)} \"k()\"\nEOT;\n return m('n()'); }\n", ["f()"], ["h", "m"]),
    ("javascript", "function f() { return `a ${g(`b ${h()}`)} k()` + x.replace(/m(\\/[)]/g, n()); }\n", ["f()"], ["g", "h", "replace", "n"]),
    ("cpp", 'void f() { g(R"x(h() " )" k())x"); char c = \'(\'; }\n', ["f()"], ["g"]),
    ("rust", "fn f<'a>(x: &'a str) -> char { g(r#\"h(\"k\")\"#); /* m() /* n() */ o() */ '(' }\n", ["f()"], ["g"]),
    ("csharp", 'class A { string F() { return $"a {G(1)} {{H()}}" + @"b "" K()" + M(); } }\n', ["A", "F()"], ["G", "M"]),
    ("kotlin", 'fun f() = g("a ${h("b")} k()") + """ m() ${n()} """\n', ["f()"], ["g", "h", "n"]),
    ("swift", 'func f() { g("a \\(h(1)) k()"); m(#"n()"#) }\n', ["f()"], ["g", "h", "m"]),
    ("go", "package a\nfunc f() { g(`h()\n k()`, 'x', \"m()\") }\n", ["f()"], ["g"]),
]


@pytest.mark.parametrize("language,text,definitions,calls", LAYOUTS)
def test_layout(language, text, definitions, calls):
    got = facts(f"file.{language}", language, text)
    assert got["labels"][1:] == definitions
    assert got["raw_calls"] == calls


def test_bodies_hold_what_they_hold():
    got = facts("a.kt", "kotlin", LAYOUTS[19 + 1][1])
    ids = got["ids"]
    assert {(ids["A"], ids["one()"]), (ids["A"], ids["two()"]), (ids["A"], ids["C"]), (ids["C"], ids["three()"])} <= got["contains"]
    got = facts("a.rs", "rust", "struct P(i32);\nimpl P { fn f(&self) -> i32 { 1 } fn g(&self) -> i32 { self.f() } }\n")
    assert (got["ids"]["P"], got["ids"]["g()"]) in got["contains"] and (got["ids"]["g()"], got["ids"]["f()"]) in got["calls"]


@pytest.mark.parametrize("language", sorted(lexer.SYNTAXES))
def test_blanks_keep_every_offset(language):
    for text in ("", "'", '"', "`${", "/* a\n", "// x\n\n'a\\'b' \"c\\\"d\"", '"""\n', "a ? /b/ : c / d\n", "$\"{x\n}\"", "<<<A\nb\n  A;\n", "@\"\nx\n\"@\n"):
        blank = lexer.blanked(text, language)
        assert len(blank) == len(text) and [k for k, c in enumerate(blank) if c == "\n"] == [k for k, c in enumerate(text) if c == "\n"]
