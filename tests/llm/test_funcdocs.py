"""Functions with their documentation: grammars per language, and what counts as saying something."""

import pytest

from weftline.llm.funcdocs import code_description_pairs, documented_functions, informative, source_functions
from weftline.llm.peg import Parse, ahead, alt, cap, lit, many, no, opt, pat, ref, seq

SIG = "(batch: int, size: int) -> int"
SAYS = [
    "Sorted by line.", "UTC only.", "O(n log n) in the worst case.", "Split the batch unless it is empty.", "/** Oldest first. */", "# Raises on empty input.", "/// Never blocks.", "  \n Not thread-safe. \n",
    "@param size upper bound for the queue, counted per record", "@param size rows to start from; zero means all\n@returns false once drained", "See also other_name. Drops duplicates.", "Wartet höchstens 42 Sekunden auf den Eintrag.",
    "Indexes the batch and hands back how many rows were dropped.", "TODO: x\nKeeps at most 5 entries.", "Caches per edge. Call `clear_it` to empty it.",
]
SAYS_NOT = [
    None, "", " \n", "index_batch", "indexBatch()", "Indexes the batch.", "Function to index the batch.", "The index_batch method", "Method.", "TODO", "FIXME: describe", "todo: write docstring", "xxx", "...", "***", "===== helpers =====", "-- batch --",
    "@param batch\n@param size\n@return", ":param batch: batch\n:returns: the return value", "@param batch the batch", "eslint-disable-next-line", "noqa: D103", "type: ignore", "pragma: no cover", "#region internals", "Region: accessors",
    "Copyright 2026 the contributors. All rights reserved. See the licence file for terms.", "SPDX-License-Identifier: MIT", "@author someone.else", "Since 0.6", "Created by template", "This comment was generated from a template and has not been filled in yet.",
    "Auto-generated method stub, created by the scaffold when the file was first written. Replace me.", "Documentation to follow. Ask the owner of this module if you need to know more.", "{@inheritDoc}", "Inherited.", "n/a", "(non-Javadoc)",
    "for (const x of batch) { index(x); }", "batch = index(batch)\nreturn batch", "Signature: index_batch(batch, size)", "def index_batch(batch: int) -> int", "index_batch(batch: int) -> int", "print(batch)", "See also other_name.", "/** TODO(docs) */",
]


@pytest.mark.parametrize("doc", SAYS)
def test_says_something(doc):
    assert informative(doc, "index_batch", SIG)


@pytest.mark.parametrize("doc", SAYS_NOT)
def test_says_nothing(doc):
    assert not informative(doc, "index_batch", SIG)


def test_nulls_and_long_docs():
    assert informative("Sorted by line.", None, None)
    assert not informative("batch " * 50_000, "index_batch", SIG)
    assert informative("word " * 50_000, "index_batch", SIG)


SOURCES = {
    "python": ('class A:\n    def f(self, a: int) -> int:\n        """Doc f."""\n        return 1\n\n    async def g(self):\n        def h():\n            pass\n        return h\n\nx = 1\n', [("f", 2, '"""Doc f."""'), ("g", 6, None), ("h", 7, None)]),
    "javascript": ('/** Doc f. */\nfunction f(a) {\n  if (a) { return "}"; }\n}\n\nclass A {\n  // Doc m.\n  async m(x) {\n    return `}`;\n  }\n}\n', [("f", 2, "/** Doc f. */"), ("m", 8, "  // Doc m.\n")]),
    "typescript": ("export async function f(a: number): Promise<any> {\n  return a;\n}\n", [("f", 1, None)]),
    "java": ("class A {\n    /** Doc f. */\n    @Override\n    static int f(int a) throws E {\n        return a;\n    }\n}\n", [("f", 4, "    /** Doc f. */")]),
    "go": ("package p\n\n// Doc F.\nfunc (s *T) F(a int) int {\n\treturn '}'\n}\n", [("F", 4, "// Doc F.\n")]),
    "rust": ("/// Doc f.\n#[inline]\npub fn f(a: i64) -> i64 {\n    a\n}\n", [("f", 3, "/// Doc f.\n")]),
    "ruby": ("class A\n  # Doc f.\n  def f(a)\n    if a\n      1\n    end\n  end\nend\n", [("f", 3, "  # Doc f.\n")]),
    "bash": ('#!/bin/bash\n\n# Doc f.\nf() {\n  echo "}"\n}\n', [("f", 4, "# Doc f.\n")]),
}


@pytest.mark.parametrize("language", SOURCES)
def test_source_grammars(language):
    text, want = SOURCES[language]
    got = source_functions(text, language)
    assert [(n, line, doc) for n, line, _, doc, _, _ in got] == want
    for name, _, signature, _, start, stop in got:
        assert name in text[start:stop] and signature.split("(")[0].strip() in text[start:stop] and text[start:stop].strip()


def test_nothing_in_strange_sources():
    assert source_functions(None, "python") == [] and source_functions("", "go") == [] and source_functions("def f(): pass", "cobol") == []
    assert source_functions("{" * 300, "javascript") == []


def test_packrat_parses_a_rule_once_per_position():
    calls = []

    def slow(p, i):
        calls.append(i)
        return pat("a+")(p, i)

    rules = {"a": slow, "s": alt(seq(ref("a"), lit("x")), seq(ref("a"), lit("y")))}
    assert Parse(rules, "aay").rule("s", 0) == (3, ()) and calls == [0]
    assert seq(ahead(lit("a")), no(lit("b")), opt(lit("z")), cap("n", many(lit("a"))))(Parse({}, "aab"), 0) == (2, (("n", 0, 2),))


SYM = "id long, file_id long, name string, kind string, line int, signature string, docstring string, path string"


def test_pairs(spark):
    text = 'def index_batch(batch):\n    """Sorted by line."""\n    return batch\n'
    symbols = [
        (1, 1, "index_batch", "Function", 1, "(batch)", "Sorted by line.", "x"), (1, 1, "index_batch", "Function", 1, "(batch)", "Sorted by line.", "x"), (2, 1, "other", "async-method", 9, "()", "# Oldest first.", "x"),
        (3, 1, "K", "class", 1, "()", "Sorted by line.", "x"), (4, 1, "f", "function", 1, " ", "Sorted by line.", "x"), (5, 1, "f", "function", 1, None, "Sorted by line.", "x"), (6, 1, "f", "function", 1, "()", None, "x"),
        (None, 1, "f", "function", 1, "()", "Sorted by line.", "x"), (7, None, None, " METHOD ", None, "()", "Sorted by line.", "x"), (8, 1, "f", None, 1, "()", "Sorted by line.", "x"),
    ]
    df = spark.createDataFrame(symbols, SYM)
    files = spark.createDataFrame([(1, "a.py"), (1, "a.py"), (None, "b.py"), (2, None)], "id long, path string")
    texts = spark.createDataFrame([(1, text), (1, text), (2, None)], "file_id long, content string")
    langs = spark.createDataFrame([("python", ".py")], "lang string, ext string")
    got = {r.id: r for r in code_description_pairs(df, files, texts, langs).collect()}
    assert set(got) == {1, 2, 7}
    assert got[1].code == text and (got[1].start, got[1].stop) == (0, len(text)) and got[2].code == "()" and got[2].description == "Oldest first."
    assert documented_functions(df.limit(0)).count() == 0 and code_description_pairs(df, files.limit(0), texts.limit(0), langs).count() == 3


PROBES = {
    "javascript": ("/** Doc a. */\nconst a = (x) => {\n  return x;\n};\n// Doc b.\nexports.b = function (y) { return y };\n'function no() {}'\n", [("a", "/** Doc a. */"), ("b", "// Doc b.\n")]),
    "java": ("interface A {\n  /** Doc f. */\n  int f(int a);\n}\n", [("f", "  /** Doc f. */")]),
    "python": ('def f(a=((1, (2, 3)),)):\n    """Doc f."""\n    x = """\ndef no(): pass\n"""\n', [("f", '"""Doc f."""')]),
}


@pytest.mark.parametrize("language", PROBES)
def test_more_forms(language):
    text, want = PROBES[language]
    assert [(n, doc) for n, _, _, doc, _, _ in source_functions(text, language)] == want


def test_deep_sources():
    deep = "/** Doc. */\nfunction f() " + "{" * 5_000 + "}" * 5_000
    assert [(n, doc) for n, _, _, doc, _, _ in source_functions(deep, "javascript")] == [("f", "/** Doc. */")]


def test_documentation_of_the_source_counts(spark):
    text = "# Oldest first.\ndef f(x)\nend\n\n# TODO\ndef f(y)\nend\n\n# Never blocks.\ndef g\nend\n\ndef h\nend\n"
    rows = [(1, 1, "f", "method", 3, "f(x)", "TODO"), (2, 1, "f", "method", 6, "f(y)", "Oldest first."), (3, 1, "g", "method", None, "g", "TODO"), (4, 1, "h", "method", 13, "h", "UTC only."), (5, 1, "gone", "method", 1, "gone", "UTC only."), (6, 2, "f", "method", 1, "f", "UTC only.")]
    symbols = spark.createDataFrame(rows, "id long, file_id long, name string, kind string, line int, signature string, docstring string")
    files = spark.createDataFrame([(1, "a.rb"), (2, "b.rb")], "id long, path string")
    texts = spark.createDataFrame([(1, text), (2, None)], "file_id long, content string")
    langs = spark.createDataFrame([("ruby", ".rb")], "lang string, ext string")
    got = {r.id: (r.description, r.origin, r.start is not None) for r in code_description_pairs(symbols, files, texts, langs).collect()}
    assert got == {1: ("Oldest first.", "source", True), 3: ("Never blocks.", "source", True), 4: ("UTC only.", "symbol", True), 5: ("UTC only.", "symbol", False), 6: ("UTC only.", "symbol", False)}


def test_a_function_of_another_symbol_is_not_met(spark):
    text = "# TODO\ndef f(x)\nend\n"
    rows = [(1, 1, "f", "method", 2, "f(x)", None), (2, 1, "f", "method", 90, "f(y)", "Oldest first.")]
    symbols = spark.createDataFrame(rows, "id long, file_id long, name string, kind string, line int, signature string, docstring string")
    files, texts = spark.createDataFrame([(1, "a.rb")], "id long, path string"), spark.createDataFrame([(1, text)], "file_id long, content string")
    langs = spark.createDataFrame([("ruby", ".rb")], "lang string, ext string")
    assert [(r.id, r.description, r.origin) for r in code_description_pairs(symbols, files, texts, langs).collect()] == [(2, "Oldest first.", "symbol")]
