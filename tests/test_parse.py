"""Definitions and branches by scopes; counts are those of the grammar's nodes, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from devquarry.functions import code, scopes
from devquarry.operators import parse

RUST = '''pub const MAX: usize = 3;
const B: usize = 2;
pub struct A { x: i32 }
impl<T: Clone> Trait for Foo<T> {
    /// if while for
    fn bar(&self, x: i32) -> impl Fn(i32) { for i in 0..3 { } }
}
trait Q { fn z(&self); }
mod m { enum E { A, B } fn inner() { fn nested() {} } }
'''
BRANCHY = 'fn f(&self) { let x = v.iter().map(|x| x + 1)?; if a { if b {} } else if c { } else { g()?; } while let Some(x) = y { let s = "if { &&"; } } // if for'
SCRIPT = '''class A extends B {
  constructor(x) { this.x = x; }
  async go(a, b) { for (const q of a) if (q) { b(() => 1); } else if (z) { y } switch (a) { case 1: break; case 2: if (x) {} break; default: } try { } catch (e) { } }
}
function f() { const s = `if ${x}`; }
'''
PYTHON = "def f(a, b):\n    if a > b and b > 0:\n        return a\n    elif b:\n        x = 1 if a else 2\n    for x in range(b):\n        pass\n    return b\n\nclass C(A, B, metaclass=M):\n    def m(self, a,\n          b):\n        '''if'''\n        with x:\n            pass\n"
GO = "package x\nfunc f(a int) int {\n\tif a > 0 {\n\t\treturn a\n\t}\n\tswitch a { case 1: b()\n case 2: if c && d {} }\n\treturn 0\n}\ntype T struct { a int }\nfunc (t *T) M(a, b int) {}\n"
JAVA = "class A extends Q {\n  int f(int a) {\n    if (a > 0 && a < 10) { return a; }\n    return 0;\n  }\n  public static void main(String[] a) throws E { for (;;) if (x) y(); else z(); switch (a) { case 1: default: } }\n}\ninterface I { void k(); }\n"
C = "struct S { int a; };\nstatic int f(int a, char *b) {\n  if (a) return 1;\n  do { a--; } while (a);\n  switch (a) { case 1: if (b) {} break; default: ; }\n  return a ? 1 : 0;\n}\nint main() { return f(1, 0); }\n"
#: language, text, and (kind, name, lines, parameters, bases, cyclomatic, cognitive, nesting) of its definitions.
WANTED = [
    ("rust", "fn foo(a: i32, b: i32) -> i32 { if a > b { a } else { b } }", [("function", "foo", (1, 1), 2, [], 2, 1, 1)]),
    ("rust", "fn foo() -> i32 { 42 }", [("function", "foo", (1, 1), 0, [], 1, 0, 0)]),
    ("rust", "fn k(n: i32) -> &'static str {\n match n {\n 0 => \"zero\",\n 1 => \"one\",\n 2 => \"two\",\n _ => \"many\",\n }\n}", [("function", "k", (1, 8), 1, [], 4, 6, 1)]),
    ("rust", "fn f(a: bool, b: bool, c: bool) -> bool { a && b || c }", [("function", "f", (1, 1), 3, [], 3, 2, 0)]),
    ("rust", BRANCHY, [("function", "f", (1, 1), 0, [], 9, 13, 2)]),
    ("rust", RUST, [("constant", "MAX", (1, 1), 0, [], 1, 0, 0), ("class", "A", (3, 3), 0, [], 1, 0, 0), ("impl", "Foo<T>", (4, 7), 0, ["Trait"], 2, 1, 1), ("method", "Foo<T>::bar", (6, 6), 1, [], 2, 1, 1), ("trait", "Q", (8, 8), 0, [], 1, 0, 0), ("method", "z", (8, 8), 0, [], 1, 0, 0), ("module", "m", (9, 9), 0, [], 1, 0, 0), ("enum", "E", (9, 9), 0, [], 1, 0, 0), ("function", "inner", (9, 9), 0, [], 1, 0, 0)]),
    ("typescript", "function foo(a: number, b: number): number { return a > b ? a : b; }", [("function", "foo", (1, 1), 2, [], 2, 1, 0)]),
    ("javascript", SCRIPT, [("class", "A", (1, 4), 0, ["B"], 9, 17, 3), ("method", "constructor", (2, 2), 1, [], 1, 0, 0), ("method", "go", (3, 3), 2, [], 9, 17, 3), ("function", "f", (5, 5), 0, [], 1, 0, 0)]),
    ("python", PYTHON, [("function", "f", (1, 8), 2, [], 6, 9, 3), ("class", "C", (10, 15), 0, ["A", "B"], 2, 1, 1), ("method", "m", (11, 15), 2, [], 2, 1, 1)]),
    ("go", GO, [("function", "f", (2, 9), 1, [], 7, 13, 3), ("class", "T", (10, 10), 0, [], 1, 0, 0), ("method", "M", (11, 11), 2, [], 1, 0, 0)]),
    ("java", JAVA, [("class", "A", (1, 7), 0, ["Q"], 7, 8, 2), ("method", "f", (2, 5), 1, [], 3, 3, 1), ("method", "main", (6, 6), 1, [], 5, 5, 2), ("trait", "I", (8, 8), 0, [], 1, 0, 0), ("method", "k", (8, 8), 0, [], 1, 0, 0)]),
    ("c", C, [("class", "S", (1, 1), 0, [], 1, 0, 0), ("function", "f", (2, 7), 2, [], 7, 7, 2), ("function", "main", (8, 8), 0, [], 1, 0, 0)]),
    ("cpp", "class P : public Q {\n  int n(int a) { return a || b; }\n};\nint P::m() { for (auto x : y) { } }\n", [("class", "P", (1, 3), 0, [], 2, 1, 0), ("function", "n", (2, 2), 1, [], 2, 1, 0), ("function", "m", (4, 4), 0, [], 2, 1, 1)]),
]


@pytest.mark.parametrize("k", range(len(WANTED)))
def test_definitions(k):
    language, text, wanted = WANTED[k]
    found, _ = scopes.definitions(text, language)
    assert [(d["kind"], d["qualified"], (d["start_line"], d["end_line"]), d["parameters"], d["bases"], d["cyclomatic"], d["cognitive"], d["nesting"]) for d in found] == wanted


@pytest.mark.parametrize("language", sorted(scopes.HEADS))
def test_any_text_is_parsed(language):
    for text in ("", "}", "({[", "fn", '"', "'''", "/*", "if else while ; } ) case =>", "def f(", "class", "a ? b : c |x| && ||", "match x { A => 1,", "\n\n", "é fn ü() { if ß {} }"):
        found, size = scopes.definitions(text, language)
        assert size[0] >= 1 and all(d["start_line"] <= d["end_line"] for d in found)


def test_chunks(spark):
    files = spark.createDataFrame([("a.rs", "rust", RUST), ("b.py", "python", PYTHON), ("c.xx", None, "if a && b"), ("d.zz", "klingon", None), ("e.go", "go", None)], "path string, language string, content string")
    rows = {r.id: r for r in parse.definitions(files).collect()}
    assert rows["a.rs::method::Foo<T>::bar::6"].parent == "Foo<T>" and rows["b.py::class::C::10"].content.startswith("class C")
    assert rows["a.rs::method::Foo<T>::bar::6"].signature == "fn bar(&self, x: i32) -> impl Fn(i32) { for i in 0..3 { } }"
    assert {(r.src, r.base) for r in parse.inheritance(parse.definitions(files)).collect()} == {("a.rs::impl::Foo<T>::4", "Trait"), ("b.py::class::C::10", "A"), ("b.py::class::C::10", "B")}
    assert {r.path: (r.cyclomatic, r.way) for r in parse.measures(files).collect()} == {"a.rs": (2, "scopes"), "b.py": (7, "scopes"), "c.xx": (3, "text"), "d.zz": (1, "text"), "e.go": (1, "scopes")}
    signed = spark.createDataFrame([("/// doc\n#[test]\n\n  pub fn x() {\n",), ("# note\n@wrap\ndef f():",), ("#define A 1",), ("// only",), ("x" * 300,)], "s string").select(code.signature(F.col("s")).alias("s")).collect()
    assert [r.s for r in signed] == ["pub fn x() {", "def f():", "#define A 1", None, "x" * 240]
