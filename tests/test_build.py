"""Building the index: grammars of other languages, cross-file calls, parents, decorators, refresh and ids."""

import hashlib

import pytest
from pyspark.sql import functions as F

from weftline.operators import maintain
from weftline.sources.code_grammars import called, declarations, index_rows, parse_sources
from weftline.sources.python_source import build_index, parse, parse_python

SOURCES = {
    "python": ('class A(B):\n  def f(self, a: int=(1,(2,(3,)))) -> dict[str, int]:\n    """Doc f."""\n    x = """\ndef no(): pass\n"""\n  async def g(self): pass\n@deco\ndef k[T: int](x): return 1\n', "class A, method f, method g, function k"),
    "javascript": ('import {a} from "m";\n/** Doc f. */\nexport const f = async (a, b) => {\n  g(`${x} {`); /"/.test(y);\n};\nconst g = x => x+1;\nclass A extends B {\n  async m(x) { return `}`; }\n  h = (e) => { foo(e); }\n}\nexports.q = function (z) { return z }\nif (x) { foo(a) }\n// function no() {}\n"function no2() {}"\n', "import m, function f, function g, class A, method m, method h, function q"),
    "typescript": ("interface I {\n  sum(a: number, b: (x: number) => void): number;\n}\nexport type T = {a: 1};\nexport async function f<T>(a: Map<string, number>): Promise<Map<string, number>> {\n  return a;\n}\n", "interface I, method sum, type T, function f"),
    "java": ('import java.util.List;\npublic interface A<T extends Comparable<T>> extends B {\n    int f(int a);\n  default Map<String, List<T>> g(@X(1) int a) throws E {\n return null; }\n}\nclass C { private static <K> void h(K k) { String s = """\n int no() { }\n"""; call(k); }\n public C(int z) { super(z); } }\n', "import java.util.List, interface A, method f, method g, class C, method h, method C"),
    "go": ('package p\nimport (\n "fmt"\n x "a/b"\n)\ntype T struct {\n a int\n}\nfunc (s *T) F(a interface{}) (int, error) {\n\treturn \'}\'\n}\nfunc G[K comparable](m map[K]int) interface{} {\n fmt.Println(`}`); return nil }\n', "import fmt, import a/b, struct T, method F, function G"),
    "rust": ("use std::io;\npub fn f<'a>(a: &'a str) -> i64 {\n    let s = r#\"{ \" }\"#; g(a)\n}\nstruct U;\ntrait Tr {\n fn need(&self) -> i32;\n}\nimpl<T> Tr for U where T: Copy {\n  fn need(&self) -> i32 { h() }\n}\n", "import std::io, function f, struct U, trait Tr, method need, impl U, method need"),
    "ruby": ('require "json"\nmodule M\n class A < B\n  def f(a)\n    if a\n      g(1)\n    end\n  end\n  def self.q? = true\n end\nend\nx = <<~EOS\n def no\n end\nEOS\n', "import json, module M, class A, method f, method q?"),
    "bash": ('#!/bin/bash\nsource lib.sh\nf() {\n  echo "}" # { {\n}\nfunction g {\n cat <<EOF\nno() {\n}\nEOF\n}\n', "import lib.sh, function f, function g"),
}


@pytest.mark.parametrize("language", SOURCES)
def test_declarations(language):
    text, want = SOURCES[language]
    found = declarations(text, language)
    assert ", ".join(f"{d.kind} {d.name}" for d in found) == want
    assert all(text[d.start : d.stop].count(d.name) and text.split("\n")[d.line - 1].count(d.name) for d in found)


def test_strange_sources():
    assert declarations(None, "go") == declarations("", "go") == declarations("def f(): pass", "cobol") == []
    deep = "function f() " + "{" * 20_000 + "}" * 20_000
    assert [d.stop for d in declarations(deep, "javascript")] == [len(deep)]
    assert declarations("function f() " + "{" * 20_000, "javascript") == []
    assert len(declarations("function f() {" * 3_000 + "}" * 3_000, "javascript")) == 3_000
    assert [d.name for d in declarations("def f(" + "(" * 5_000 + ")" * 5_000 + "): pass\n", "python")] == ["f"]
    for text in ("/* " * 50_000, "// x\n" * 50_000, "`" * 50_001, "'" * 50_001, "a" * 300_000):
        assert declarations(text, "javascript") == []
    assert declarations("<<A\n" * 50_000, "bash") == [] and declarations("=begin\n" * 50_000, "ruby") == []


def test_calls_and_containers():
    text = "class A {\n  m(x) { if (x) { go(1); } return inner.deep(`no()`) }\n}\nfunction outer() { function own() { far() } near() }\n"
    found = declarations(text, "javascript")
    assert called(text, "javascript", found) == [(1, "go"), (1, "deep"), (2, "near"), (3, "far")]
    rows = {(r[0], r[1], r[2], r[6]) for r in index_rows(text, "javascript") if r[0] == "symbol"}
    assert rows == {("symbol", "A", "class", None), ("symbol", "A.m", "method", "A"), ("symbol", "outer", "function", None), ("symbol", "outer.own", "function", "outer")}


def test_signatures():
    text = "@a.b(1)\n@c\nasync def f(x, /, self, y: int = 2, *args: str, k=None, **kw) -> int: pass\nclass K:\n    @staticmethod\n    def m(cls, q): self.x.deep(q)()\n    def deep(self): len(deep(q))\n"
    rows = parse(text)
    assert [r[4] for r in rows if r[0] == "symbol"] == ["@a.b\n@c\nasync (x, y: int = 2, *args: str, k = None, **kw) -> int", None, "@staticmethod\n(q)", "()"]
    assert [(r[1], r[2], r[7]) for r in rows if r[0] == "call"] == [("K.m", "inner", "deep"), ("K.deep", "open", "deep")]


def _disk(spark, texts):
    rows = [(i, p, hashlib.sha256(t.encode()).hexdigest(), t) for i, (p, t) in texts.items()]
    return spark.createDataFrame(rows, "id long, path string, hash string, content string")


ONE = {
    1: ("src/pkg/__init__.py", "def init(): pass\n"),
    2: ("src/pkg/util.py", "def helper(): pass\nclass Tool:\n    def run(self): helper()\n"),
    3: ("src/pkg/main.py", "from .util import helper\nimport pkg\nimport os\ndef main():\n    helper()\n    pkg.init()\n    os.getcwd()\n    x().gone()\n"),
    4: ("other.py", "import pkg.util\ndef o(): Tool()\n"),
}


def _named(symbols, edges):
    names = {r.id: r.name for r in symbols.collect()}
    return [(names[r.src], names.get(r.dst), r.dst_unresolved) for r in edges.collect()]


def test_cross_file_edges_and_parents(spark):
    disk = _disk(spark, ONE)
    parsed = parse_python(disk.select(F.col("id").alias("file_id"), "content"))
    symbols, edges = build_index(parsed, disk.select("id", "path"))
    assert set(_named(symbols, edges)) == {("run", "helper", None), ("main", "helper", None), ("main", "init", None), ("main", None, "getcwd"), ("main", None, "x"), ("o", "Tool", None)}
    by = {r.name: r for r in symbols.collect()}
    assert by["run"].parent_id == by["Tool"].id and by["Tool"].parent_id is None
    assert by["run"].scip_id == "code . .src/pkg/util.py#Tool.run" and by["Tool"].scip_id == "code . #src/pkg/util.py#Tool" and by["o"].scip_id == "code . /other.py#o"
    # Without the other files the calls stay open; a name in another repository isn't found.
    assert ("main", None, "helper") in _named(*build_index(parsed))
    apart = disk.select("id", "path", F.when(F.col("id") == 4, "b").otherwise("a").alias("repo"))
    assert ("o", None, "Tool") in _named(*build_index(parsed, apart))
    assert build_index(parsed.limit(0), disk.select("id", "path"))[1].count() == 0


def test_refresh_of_parsed_rows_equals_build(spark):
    parse_disk = lambda d: parse_python(d.select("file_id", "content"))
    disk = _disk(spark, ONE)
    parsed = parse_python(disk.select(F.col("id").alias("file_id"), "content"))
    two = {7: ("src/pkg/tools.py", ONE[2][1]), 3: ("src/pkg/main.py", ONE[3][1] + "def getcwd(): pass\n"), 4: ONE[4]}
    files2, parsed2 = maintain.refresh_parsed(disk.select("id", "path", "hash"), parsed, _disk(spark, two), parse_disk)
    assert {r.path: r.id for r in files2.collect()} == {"src/pkg/tools.py": 2, "src/pkg/main.py": 3, "other.py": 4}
    built = _disk(spark, {2: two[7], 3: two[3], 4: two[4]})
    want = build_index(parse_python(built.select(F.col("id").alias("file_id"), "content")), built.select("id", "path"))
    rows = lambda df: sorted(map(repr, df.collect()))
    got = build_index(parsed2, files2)
    assert [rows(g.select(*w.columns)) for g, w in zip(got, want, strict=True)] == [rows(w) for w in want]
    # What was known before is open now, and the other way round.
    assert set(_named(*got)) == {("run", "helper", None), ("main", None, "helper"), ("main", None, "init"), ("main", "getcwd", None), ("main", None, "x"), ("o", None, "Tool")}


def test_dangling_ends_become_open(spark):
    disk = _disk(spark, {2: ONE[2], 3: ONE[3]})
    index = lambda d, ids: build_index(parse_python(d.select(F.col(ids).alias("file_id"), "content")), disk.select("id", "path"))
    symbols, edges = index(disk, "id")
    _, symbols2, edges2 = maintain.refresh(disk.select("id", "path", "hash"), symbols, edges, _disk(spark, {3: ONE[3]}), lambda d: index(d, "file_id"))
    assert ("main", None, "helper") in _named(symbols2, edges2) and symbols2.count() == 1


def test_ids_survive_renames(spark):
    texts = ["def f(alpha, beta): g()\ndef g(): pass\n", "def renamed(alpha, beta): g()\ndef g(): pass\n", "def renamed(alpha, beta): g()\ndef g(): pass\ndef f(z): renamed()\n"]
    index = lambda t: build_index(parse_python(spark.createDataFrame([(1, t)], "file_id long, content string")))
    one, _ = index(texts[0])
    two, _ = maintain.keep_ids(one, *index(texts[1]))
    three, edges = maintain.keep_ids(two, *index(texts[2]))
    first, second, third = ({r.name: r.id for r in x.collect()} for x in (one, two, three))
    assert second == {"renamed": first["f"], "g": first["g"]}
    # A new symbol doesn't get an id that another one holds by now.
    assert third["renamed"] == first["f"] and third["g"] == first["g"] and len(set(third.values())) == 3
    assert set(_named(three, edges)) == {("renamed", "g", None), ("f", "renamed", None)}


def test_parse_sources(spark):
    files = spark.createDataFrame([(1, "a.PY"), (2, "b.go"), (2, "b.go"), (3, "c.txt"), (None, "d.go"), (4, "e.sh"), (5, None)], "id long, path string")
    texts = spark.createDataFrame([(1, "def f(): g()\n"), (2, SOURCES["go"][0]), (3, "x"), (4, None), (4, ""), (5, "x"), (None, "x")], "file_id long, content string")
    langs = spark.createDataFrame([("python", ".py"), ("go", ".go"), ("bash", ".sh")], "lang string, ext string")
    rows = parse_sources(files, texts, langs).collect()
    assert {(r.file_id, r.name) for r in rows if r.what == "symbol"} == {(1, "f"), (2, "T"), (2, "T.F"), (2, "G")}
    symbols, edges = build_index(parse_sources(files, texts, langs), files)
    assert {r.name: r.parent_id is not None for r in symbols.collect()} == {"f": False, "T": False, "F": True, "G": False} and edges.count() == 2
    assert parse_sources(files.limit(0), texts, langs).count() == 0 and parse_sources(files, texts.limit(0), langs).count() == 0
