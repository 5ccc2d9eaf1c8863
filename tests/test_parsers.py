"""Skeletons, outlines, comments, pages and notebooks of all languages, on small programs of our own."""

from __future__ import annotations

import json

import pytest

from lodestone.operators import lexing, parsers, parsing

B = "{ /* ... */ }"
SKELETONS = {
    "typescript": ("export class Cart {\n  total(): number {\n    return 3;\n  }\n}\nconst add = (a: number) => {\n  return a + 1;\n};\nconst one = (a) => a;\n", f"export class Cart {{\n  total(): number {B}\n}}\nconst add = (a: number) => {B};\nconst one = (a) => a;\n", 2),
    "javascript": ("describe('cart', () => {\n  it('adds', () => {\n    expect(1);\n  });\n});\n", f"describe('cart', () => {{\n  it('adds', () => {B});\n}});\n", 1),
    "go": ("package shop\n\ntype Item struct {\n\tName string\n}\n\nfunc (i Item) Label() string {\n\treturn \"{\" + i.Name\n}\n", f"package shop\n\ntype Item struct {{\n\tName string\n}}\n\nfunc (i Item) Label() string {B}\n", 1),
    "rust": ("impl Item {\n    pub fn price(&self) -> f64 {\n        self.price\n    }\n}\nmod deep {\n    fn inner() {}\n}\n", f"impl Item {{\n    pub fn price(&self) -> f64 {B}\n}}\nmod deep {{\n    fn inner() {B}\n}}\n", 2),
    "java": ("class Cart {\n  static { load(); }\n  Cart(int n) { this.n = n; }\n  int n() { return n; }\n}\n", f"class Cart {{\n  static {B}\n  Cart(int n) {B}\n  int n() {B}\n}}\n", 3),
    "csharp": ("class Cart {\n  public int N { get { return n; } }\n  public string S =>\n    Join(\n      n);\n  int Twice() { return 2 * n; }\n}\n", f"class Cart {{\n  public int N {{ get {B} }}\n  public string S => default /* ... */;\n  int Twice() {B}\n}}\n", 3),
    "c": ("struct item { int n; };\nint twice(int n)\n{\n  return 2 * n;\n}\n", f"struct item {{ int n; }};\nint twice(int n)\n{B}\n", 1),
    "cpp": ("class Cart {\npublic:\n  Cart(int n) : n_(n) { check(); }\n  int n() const { return n_; }\n};\n", f"class Cart {{\npublic:\n  Cart(int n) : n_(n) {B}\n  int n() const {B}\n}};\n", 2),
    "objc": ("@implementation Cart\n- (int)count:(int)n {\n  return n;\n}\n@end\n", f"@implementation Cart\n- (int)count:(int)n {B}\n@end\n", 1),
    "php": ("<?php\nclass Cart {\n  function n(): int {\n    return 1;\n  }\n}\n", f"<?php\nclass Cart {{\n  function n(): int {B}\n}}\n", 1),
    "kotlin": ("class Cart {\n    init {\n        check()\n    }\n    fun n(): Int {\n        return 1\n    }\n    fun label() =\n        build {\n            add(1)\n        }\n}\n", f"class Cart {{\n    init {B}\n    fun n(): Int {B}\n    fun label() = TODO() /* ... */\n}}\n", 3),
    "swift": ("struct Cart {\n    var n: Int {\n        return 1\n    }\n    func add(_ x: Int) {\n        n += x\n    }\n}\n", f"struct Cart {{\n    var n: Int {B}\n    func add(_ x: Int) {B}\n}}\n", 2),
    "scala": ("class Cart {\n  def n: Int = {\n    1\n  }\n  def label: String =\n    \"a\" +\n      \"b\"\n}\n", f"class Cart {{\n  def n: Int = {B}\n  def label: String =\n    {B}\n}}\n", 2),
    "dart": ("class Cart {\n  int n() {\n    return 1;\n  }\n  int one() => 1;\n}\n", f"class Cart {{\n  int n() {B}\n  int one() => 1;\n}}\n", 1),
    "zig": ("pub fn twice(n: i32) i32 {\n    return 2 * n;\n}\nfn List(comptime T: type) type {\n    return struct {\n        item: T,\n    };\n}\n", "pub fn twice(n: i32) i32 {\n    // ...\n}\nfn List(comptime T: type) type {\n    return struct {\n        item: T,\n    };\n}\n", 1),
    "solidity": ("contract Cart {\n    function add(uint n) public {\n        total += n;\n    }\n    receive() external payable {}\n}\n", f"contract Cart {{\n    function add(uint n) public {B}\n    receive() external payable {{}}\n}}\n", 1),
    "ruby": ("class Cart\n  def add(n)\n    @n += n if n > 0\n    [1].each do |x|\n      x\n    end\n  end\n\n  def n = @n\nend\n", "class Cart\n  def add(n)\n    # ...\n  end\n\n  def n = @n\nend\n", 1),
    "elixir": ("defmodule Cart do\n  def add(n) do\n    if n > 0 do\n      n\n    end\n  end\n\n  def one, do: 1\nend\n", "defmodule Cart do\n  def add(n) do\n    # ...\n  end\n\n  def one, do: 1\nend\n", 1),
    "bash": ("add() {\n  echo \"${1}\"\n}\nadd 1\n", "add() { : '...'; }\nadd 1\n", 1),
    "lua": ("local function add(n)\n  for i = 1, n do\n    if i > 1 then print(i) end\n  end\nend\n", "local function add(n)\n  --[[ ... ]]\nend\n", 1),
    "julia": ("function add(n)\n    a[end] = [i for i in 1:n if i > 1]\nend\ntwice(n) = 2n\n", "function add(n) #= ... =# end\ntwice(n) = 2n\n", 1),
    "haskell": ("add :: Int -> Int\nadd n =\n  let m = n\n   in m + 1\n\none = 1\n", "add :: Int -> Int\nadd n = undefined {- ... -}\n\none = 1\n", 1),
    "ocaml": ("let add n =\n  let m = n in\n  m + 1\n\nlet one = 1\n", "let add n =\n  assert false (* ... *)\n\nlet one = 1\n", 1),
    "ocaml_interface": ("val add : int -> int\n", "val add : int -> int\n", 0),
    "python": ("class Cart:\n    def add(self, n):\n        '''Adds.'''\n        return n\n\n    def stub(self): ...\n", "class Cart:\n    def add(self, n):\n        '''Adds.'''\n        ...\n\n    def stub(self): ...\n", 1),
}


@pytest.mark.parametrize("language", sorted(SKELETONS))
def test_skeleton(language):
    text, want, n = SKELETONS[language]
    got = parsing.skeleton(text, language)
    assert (got.content, got.bodies, got.errors) == (want, n, False)
    again = parsing.skeleton(got.content, language)
    assert again.content == got.content and again.bodies == 0


def test_every_language_has_a_parser_and_failures_are_told():
    from lodestone.functions.paths import EXTENSIONS

    assert set(EXTENSIONS) <= set(parsers.PARSERS)
    for language in parsers.PARSERS:
        assert parsing.skeleton("", language).content == ""
    broken = parsing.skeleton("int f( {", "c")
    assert broken.errors and broken.content == "int f( {"
    assert parsing.skeleton("x", "cobol").errors and not parsing.skeleton("x", None).errors
    parsers.register("shout", lambda t, c, b: parsers.Result(t.upper()))
    assert parsing.skeleton("abc", "shout").content == "ABC"
    del parsers.PARSERS["shout"]


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("typescript", "export interface A {\n  id: string;\n}\nexport class B extends A {\n  private n = 1;\n  go(x: number): void {\n  }\n}\nexport type T = {\n  a: 1;\n};\nconst f = (x) => x;\n", ["export interface A", "  id: string", "export class B extends A", "  private n = 1", "  go(x: number): void", "export type T", "const f = (x) =>"]),
        ("go", "type S interface {\n\tGet() error\n}\nfunc (s *S) Get() error {\n\treturn nil\n}\n", ["type S interface", "func (s *S) Get() error"]),
        ("rust", "pub struct P { x: i32 }\ntrait T { fn a(&self); fn b(&self) {} }\n", ["pub struct P { x: i32 }", "trait T", "  fn a(&self)", "  fn b(&self)"]),
        ("c", "typedef struct { int a; } pair_t;\nint add(int a, int b);\nstatic int two(void) { return 2; }\n", ["typedef struct pair_t", "int add(int a, int b)", "static int two(void)"]),
        ("ruby", "module M\n  class A\n    def go(x)\n      x\n    end\n  end\nend\n", ["module M", "  class A", "    def go(x)"]),
        ("elixir", "defmodule M do\n  def go(x) do\n    x\n  end\nend\n", ["defmodule M", "  def go(x)"]),
        ("haskell", "class C a where\n  f :: a -> Int\n\ng :: Int\ng = 1\nh x = x\n", ["class C a", "  f :: a -> Int", "g :: Int", "h x"]),
        ("zig", "pub const P = struct {\n    x: i32,\n    pub fn get(s: P) i32 {\n        return s.x;\n    }\n};\n", ["pub const P", "  x: i32", "  pub fn get(s: P) i32"]),
        ("python", "class A(B):\n    async def go(\n        self,\n        x: int,\n    ) -> None:  # why\n        pass\n", ["class A(B)", "  async def go(self, x: int) -> None"]),
    ],
)
def test_outline(language, text, want):
    assert parsing.outline(text, language) == "\n".join(want) + "\n"


def test_comment_policies():
    text = "#!/usr/bin/env node\n// 2024 somebody\n\n/** Adds. */\nfunction add(a) {\n  // inside\n  return a; // there\n}\n\n// Told of the next.\nconst x = 1; /* aside */\n\n// const old = 2;\nconst y = 2;\n// @ts-ignore\nconst z = 3;\n"
    docs, none = (parsing.skeleton(text, "typescript", p, bodies=False) for p in ("docs", "none"))
    assert docs.content == "#!/usr/bin/env node\n\n/** Adds. */\nfunction add(a) {\n  return a;\n}\n\n// Told of the next.\nconst x = 1;\n\nconst y = 2;\n// @ts-ignore\nconst z = 3;\n"
    assert none.content == "#!/usr/bin/env node\n\nfunction add(a) {\n  return a;\n}\n\nconst x = 1;\n\nconst y = 2;\n// @ts-ignore\nconst z = 3;\n" and none.comments == 7
    py = '"""Module."""\n# -*- coding: utf-8 -*-\nimport os  # noqa\n\nclass Empty:\n    """Only this."""\n\nclass C:\n    # the id\n    id: int\n\ndef f():\n    """Doc."""\n    return 1\n'
    assert parsing.skeleton(py, "python", "none").content == "# -*- coding: utf-8 -*-\nimport os  # noqa\n\nclass Empty:\n    ...\n\nclass C:\n    id: int\n\ndef f():\n    ...\n"
    assert parsing.skeleton(py, "python", "docs").content == py.replace("return 1", "...")
    assert parsing.skeleton("def f():\n    '''D.'''\n    return 1\n", "python", "none", bodies=False).content == "def f():\n    return 1\n"
    assert lexing.looks_like_code("// foo();\n// return") and not lexing.looks_like_code("// plain words")


def test_conditional_code_reads_each_branch():
    text = "#ifdef A\nint f(int a) {\n#else\nint f(long a) {\n#endif\n  return 1;\n}\n#if X\nint g(void) { return 1; }\n#else\nint h(void) { return 2; }\n#endif\n"
    got = parsing.skeleton(text, "c")
    assert got.content == f"#ifdef A\nint f(int a) {B}\n#if X\nint g(void) {B}\n#else\nint h(void) {B}\n#endif\n" and not got.errors
    assert parsing.blank_branches("#if A\nx\n#else\ny\n#endif\nz", 1) == "     \n \n     \ny\n      \nz"


def test_pages_and_notebooks():
    vue = '<template><p/></template>\n<script lang="ts">\nfunction inc(): void {\n  n++;\n}\n</script>\n<script type="application/json">{"a": 1}</script>\n'
    got = parsing.transform_text("A.vue", vue)
    assert got.content == vue.replace("{\n  n++;\n}", B) and got.bodies == 1 and got.language == "vue"
    assert parsing.transform_text("A.vue", vue, "outline").content == "function inc(): void\n"
    astro = "\n---\nfunction f() { return 2; }\n---\n<p/>\n"
    assert parsing.transform_text("a.astro", astro).content == f"\n---\nfunction f() {B}\n---\n<p/>\n"
    book = json.dumps({"cells": [{"cell_type": "code", "source": ["%time x\n", "def f():\n", "    return 1\n"], "outputs": ["big"]}, {"cell_type": "markdown", "source": "# T\n\nx"}, {"cell_type": "code", "source": "%%bash\nls"}]})
    got = parsing.transform_text("n.ipynb", book)
    assert got.content == "# %%\n# %time x\ndef f():\n    ...\n\n# %% [markdown]\n# # T\n#\n# x\n\n# %%\n# %%bash\n# ls\n" and (got.language, got.fence) == ("notebook", "python")
    assert parsing.notebook_script("{}") is None and parsing.notebook_script("no") is None


def test_transform_of_other_files():
    long = "line\n" * 300
    assert parsing.transform_text("a.csv", long).strategy == "truncated" and parsing.transform_text("a.csv", long, "full").content == long
    assert parsing.transform_text("a.js", "x" * 5000).content == "[minified: 1 line, 5000 chars omitted]\n"
    assert parsing.transform_text("a.ts", "// Code generated by x. DO NOT EDIT.\nfunction f() {\n}\n").strategy == "outline"
    assert parsing.transform_text("index.ts", "export * from './a';\n", "outline").strategy == "skeleton"
