"""Lexers language by language, and the operator's corner cases."""

import ast

import pytest

from weftline.llm.lexers import check
from weftline.llm.syntax import checked_files, fault_rates

VALID = {
    "python": ['"""d"""\nx = {"a": [1, (2)]}  # ((\n\ndef f(a: int) -> int:\n    """( [ {"""\n    if a:\n        return f"{a}"\n    return 2\n', "T = '''\n<<<<<<< HEAD\n=======\n>>>>>>> b\n'''\n", "x = 1 \\\n    + 2\n", "@d\nclass A:\n    x: int = 1\n    async def m(self): ...\n"],
    "javascript": ['import { a } from "./b.js";\nconst r = /[/(]/g, t = `x ${f(`{`)} (`;\nclass A { async m(x) { return x ? 1 : { y: 2 }; } }\nexport default (a) => a / 2 / 1;\n', "/*\n<<<<<<< HEAD\n( {\n*/\n", "#!/usr/bin/env node\nx = a\n  ? b : c\n", "switch (a) { case 1: { break; } default: }\n", "const f = async function* (a) { yield* a; }\n"],
    "typescript": ["import type { A } from 'a';\ninterface B<T> { x?: T }\nexport async function f(a: number, b = '('): Promise<any> { return a as any; }\nabstract class C implements B<string> { private readonly x: string = `}`; }\n"],
    "tsx": ["const a = (x: number): number => x;\n"],
    "go": ['package p\n\nimport "fmt"\n\ntype T struct {\n\tx int\n}\n\n// ( {\nfunc (t *T) F(a, b int) (int, error) {\n\tr := \'(\'\n\ts := `\n<<<<<<< HEAD\n{`\n\t_ = fmt.Sprint(r, s)\n\tfor i := 0; i < 3; i++ {\n\t}\n\treturn 1, nil\n}\n', "package p"],
    "rust": ["//! d\nuse std::collections::HashMap;\n\n#[derive(Debug)]\npub struct S<'a> { x: &'a str }\n\nimpl<'a> S<'a> {\n    pub fn f(&self, c: char) -> i64 {\n        let s = r#\"{ \" (\"#;\n        match c { '(' => 1, '\\'' => 2, _ => 0 }\n    }\n}\n\n/* /* nested */ ( */\nconst X: &str = \"{\";\nmacro_rules! m { () => {} }\n"],
    "java": ['package a.b;\n\nimport java.util.*;\n\n@A("(")\npublic final class C<T> extends D {\n    char c = \'{\';\n    String t = """\n<<<<<<< HEAD\n( {\n""";\n    static int f(int a) throws E { return a; }\n}\n'],
    "ruby": ["# frozen\nrequire \"x\"\n\nclass A < B\n  def m(a) = a + 1\n  def n(x)\n    return 1 if x == 2\n    y = [1].map { |z| z + 1 }\n    while x do x -= 1 end\n    3.times do |i|\n      puts \"#{i} ( {\"\n    end\n    z = if x then 1 else 2 end\n  end\nend\n\nT = <<~TXT\n<<<<<<< HEAD\n( end\nTXT\n", "=begin\ndef (\n=end\nx = %w[a b]\n"],
    "bash": ["#!/usr/bin/env bash\nset -euo pipefail\n\nf() {\n  local a=\"$(printf \"%s\" \"${1:-5}\")\"\n  case \"${1:-}\" in\n    a|b) echo 1 ;;\n    *) return 1 ;;\n  esac\n  if [[ \"$a\" == \"((\" ]]; then\n    return $((1 + (2)))\n  elif true; then :; fi\n  for i in a b; do echo \"$i\" # ( {\n  done\n  while read -r l; do :; done < <(ls)\n  x=(1 2)\n}\n\ncat <<'TXT'\n<<<<<<< HEAD\n( {\nTXT\n", "a=1 && { echo x; } || (exit 1)\n"],
}
INVALID = {
    "python": ["def f(a", "def f():\n", "x = '''abc", "x = 'abc\n", "x = (1]\n", "def f():\n<<<<<<< HEAD\n    x = 1\n=======\n    x = 2\n>>>>>>> b\n", "package a\n", "# Notes\n\nThe thing took long.\n"],
    "javascript": ["function f(a) {", "function f(a)", 'const a = "x', "const a = `x ${", "/* x", "f(]", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b\n", "def f(a):\n    return 1\n", "package p\n\nfunc F() {}\n", "<!DOCTYPE html>\n<html></html>", "function f(a: number): any {\n  return a;\n}\n", "const x = 1 +", "# Notes\n\nThe thing took long.\n"],
    "typescript": ["class A { m() {", "from __future__ import annotations\n", "use std::fmt;\nfn f() {}\n", "function f(a: number): any"],
    "tsx": ["package a.b;\nfinal class J {}\n"],
    "go": ["package a.b;\n", "import x\n", "package p\n\nfunc F(a int) int {", "package p\n\nfunc F(a int) int", "package p\nvar s = `x", "//! d\nuse std::x;\n"],
    "rust": ["fn f(", "fn f() -> i64 {", "/* x", 'const A: &str = "x', "package p\n", "import { a } from 'b';\n", "pub fn f(a: i64) -> i64"],
    "java": ["package a;\nclass A {", "package a\n\nfunc F() {}\n", "import { a } from 'b';\n", "class A { String s = \"x; }", "use a::b;\n"],
    "ruby": ["def f\n  1\n", "class A\n  def m\n  end\n", "x = 'abc", "f(]", "T = <<~X\nabc\n", "<!DOCTYPE html>\n", "from a import b\n\ndef f(x: int) -> int:\n    return 1\n", "end\n"],
    "bash": ["f() {\n  echo 1\n", "f() {", "f(", "if true; then\n  x\n", "echo 'abc", "case $1 in\n  a) x ;;\n", "for i in a; do\n", "def f(a: int) -> int:\n    return 1\n", "cat <<X\nabc\n", "<!DOCTYPE html>\n<html>\n", "The widget took 3 seconds before.\n"],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in VALID.items() for t in ts])
def test_valid(language, text):
    assert check(text, language) is None
    assert check(text.replace("\n", "\r\n"), language) is None


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in INVALID.items() for t in ts])
def test_invalid(language, text):
    assert check(text, language) is not None


@pytest.mark.parametrize("language", [*VALID, "unknown", None])
def test_nothing_to_check(language):
    assert check("", language) is None and check(" \n\n", language) is None


def test_python_agrees_with_its_parser_at_every_cut():
    text = VALID["python"][0]
    for i in range(len(text)):
        try:
            ast.parse(text[:i])
            good = True
        except SyntaxError:
            good = False
        assert (check(text[:i], "python") is None) == good


def test_cut_functions_are_never_valid():
    """Whatever is cut off inside a function's block leaves it open."""
    for language, text in (("javascript", "function f(a) {\n  g(a, { x: 1 }); // {\n  return `}`;\n}\n"), ("go", "package p\n\nfunc F(a int) int {\n\tx := \"}\"\n\treturn a\n}\n"), ("java", "class A {\n  int f() { return '}'; }\n}\n")):
        start = text.index("{") + 1
        assert all(check(text[:i], language) for i in range(start, text.rindex("}")))


def test_very_long_text():
    assert check("x = [\n" + "    1,\n" * 50_000 + "]\n", "python") is None
    assert check("f({" * 20_000, "javascript") is not None


def test_operator(spark):
    files = spark.createDataFrame([(1, "r", "a.py", "go"), (1, "r", "a.py", "go"), (2, "r", "b.PY", None), (3, "r", "c.txt", None), (4, None, "d.sh", None), (5, "r", None, None), (None, "r", "e.py", None), (6, "r", "f.py", None)], "id long, repo string, path string, lang string")
    texts = spark.createDataFrame([(1, "x = (", "n"), (1, "x = (", "n"), (2, "x = 1", "n"), (3, "x = (", "n"), (4, "if", "n"), (5, "(", "n"), (6, None, "n"), (7, "(", "n")], "file_id long, content string, path string")
    langs = spark.createDataFrame([("python", ".py"), ("bash", ".sh"), (None, ".x")], "lang string, ext string")
    got = {r.file_id: (r.language, r.fault) for r in checked_files(files, texts, langs).collect()}
    assert got == {1: ("python", "premature end"), 2: ("python", None), 4: ("bash", "premature end")}
    rates = {(r.repo, r.language): (r.n_files, r.n_invalid, r.rate) for r in fault_rates(checked_files(files, texts, langs)).collect()}
    assert rates == {("r", "python"): (2, 1, 0.5), (None, "bash"): (1, 1, 1.0)}
    assert checked_files(files.limit(0), texts, langs).count() == 0 and checked_files(files, texts.limit(0), langs).count() == 0


# Everyday code that was taken for faulty, and faults inside of statements.
EVERYDAY = [
    ('bash','x=1; echo $x\n'),
    ('bash','IFS=,; read a b\n'),
    ('bash','a=(1 2); b=3\n'),
    ('bash','for ((i=0;i<3;i++)); do echo $i; done\n'),
    ('tsx','const a = <p>Hello there</p>;\n'),
    ('javascript',"function A() { return <p>Don't stop</p>; }\n"),
    ('javascript','const x = <ul>{xs.map((x) => <li key={x}>It\'s {x}</li>)}</ul>;\n'),
    ('javascript','if (a < b) { c() }\nfor (let i = 0; i < n; i++) { x = y >z }\n'),
    ('tsx','const f = <T,>(x: T) => x;\nconst g = <T extends A>(x: T) => x;\nconst m = new Map<string, number>();\n'),
    ('javascript','if (x) /ab c/.test(y)\n'),
    ('ruby','x = "a #{h["k"]} b"\n'),
    ('ruby','x = "a #{h.map { |k| "#{k}" }} b"\n'),
    ('java','void main() { x(); }\n'),
    ('java','class A { String f(int a) { return a > 0 ? "x" : "y"; } List<?> l; }\n'),
    ('typescript','let a: Array<number>;\nlet b = c!;\nx ||= 1; y ??= 2; z **= 3;\ntype M = { -readonly [K in keyof T]-?: T[K] };\n'),
    ('go','package p\nfunc f() { x := *p; y += *q; for {}; return }\n'),
    ('rust','fn f() { let x = *p + *q; for i in 0..=5 {} let c = || 5; g(|a| a, ||{}); }\n'),
    ('bash','if [ $x = 1 ]; then y=2; fi\nx=1 cmd; a=b c=d; f() { x=1; }\n'),
]
INSIDE = [
    ('javascript','let x = ;\n'),
    ('javascript','const x = 5 +* 3\n'),
    ('java','class A { int f() { return 1 +; } }\n'),
    ('go','package p\nfunc f() { x := 5 + ; }\n'),
    ('rust','fn f() { let x 5; }\n'),
    ('ruby','def f\n  5 +\nend\n'),
    ('bash','; echo\n'),
    ('bash','for ((i=0; do\n'),
    ('javascript','const a = <p>Hello</div>;\n'),
    ('ruby','x = "a #{h["k"]} b\n'),
    ('tsx','const a = <p>Hello\n'),
]


@pytest.mark.parametrize(("language", "text"), EVERYDAY)
def test_everyday_code_is_valid(language, text):
    assert check(text, language) is None


@pytest.mark.parametrize(("language", "text"), INSIDE)
def test_faults_inside_statements(language, text):
    assert check(text, language)


def test_deep_texts_end():
    assert check("x = " + "$(" * 20_000, "bash") is None or check("$(" * 50, "bash")
    assert check("const a = " + "<b>" * 20_000 + "</b>" * 20_000 + ";", "javascript") is None
    assert check('x = "' + '#{"' * 5_000 + '"}' * 5_000 + '"', "ruby") is None
