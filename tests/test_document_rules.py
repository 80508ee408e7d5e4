"""Headings in their one form, risky additions, versions in a window, changelogs, audits and footers, case by case."""

import pytest

from weftline.operators import docs, gates
from weftline.sources.git import added_lines


def _docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_heading_lint(spark):
    text = "## Milestone 1: Fine\n## Milestone M2: Prefixed\n## M3 - Dash\n### Sub-step 1.1: Fine\n### Step 1.2: Word\n### Sub-step 1.1.bis: Suffix\n## Summary Counts\n```\n## M4: Quoted\n```\n## Milestone 5 – Dash"
    got = docs.heading_lint(_docs(spark, text, None, "")).orderBy("pos").collect()
    assert [(r.pos, r.line) for r in got] == [(1, "## Milestone M2: Prefixed"), (2, "## M3 - Dash"), (4, "### Step 1.2: Word"), (5, "### Sub-step 1.1.bis: Suffix"), (10, "## Milestone 5 – Dash")]


def test_diff_risks(spark):
    lines = [
        ('API_KEY = "abcdefgh1"', {"secret"}), ('token = "short"', set()), ('password = "your-password"', set()), ('secret = os.environ["abcdefgh"]', set()), ("api_key = '<API_KEY>aaaa'", set()), ("token = '${HOME}aaaaa'", set()),
        ("subprocess.call(x, shell = True)", {"shell_injection"}), ("subprocess.call(x)", set()), ("y = eval (x)", {"dynamic_code"}), ("model.eval()", set()), ("exec(x)", {"dynamic_code"}), ("my_exec(x)", set()),
        ('open("../x")', {"path_traversal"}), ('Path(a, "../b")', {"path_traversal"}), ('open("x")', set()), ("c.execute(f'select')", {"sql_fstring"}), ('c.execute("a" + b)', {"sql_concatenation"}), ('c.execute("a", b)', set()),
        ("pickle.loads(x)", {"unsafe_deserialisation"}), ("cpickle.loads(x)", {"unsafe_deserialisation"}), ("mypickle.loads(x)", set()),
    ]
    diff = "--- a/x.py\n+++ b/x.py\n@@ -3 +10,%d @@\n" % len(lines) + "\n".join("+" + x for x, _ in lines) + "\n@@ -90 +200 @@\n-eval(1)\n--- a/y.md\n+++ b/y.md\n@@ -1 +1 @@\n+eval(1)"
    got = {}
    for r in docs.diff_risks(added_lines(_docs(spark, diff))).collect():
        got.setdefault((r.file, r.line_no), set()).add(r.risk)
    assert got == {("x.py", 10 + i): risks for i, (_, risks) in enumerate(lines) if risks}


@pytest.mark.parametrize("gap", [0, 30, 33, 34, 60])
def test_version_window(spark, gap):
    import re

    # Against the rule itself: every match in order, then the window.
    rx = re.compile(r"\b\d+\.\d+\.\d+(?:[.\-][A-Za-z0-9]+|[A-Za-z]+\d*)?")
    texts = [f"Version{' ' * gap}0.1.0-dev x", f"0.1.0{'.' * gap} version", f"1.2.3 {'x' * gap} version 2.0.0rc1 and 9.9.9", "no word 1.0.0", "version 0.1.0.dev0, 0.1.0.dev0 and 1.1.1"]
    want = {(i, m.group()) for i, t in enumerate(texts) for m in rx.finditer(t) if m.group() != "1.1.1" and "version" in t[max(0, m.start() - 40) : m.end() + 40].lower()}
    assert {(r.doc_id, r.version) for r in docs.version_mentions(_docs(spark, *texts, None), "1.1.1").collect()} == want


def test_changelog_gap(spark):
    commits = spark.createDataFrame([("a", "r", "feat(x): y"), ("a", "r", "feat(x): y"), ("b", "r", "fix: z"), ("c", "r", "docs: z"), ("d", "r", None), ("e", "q", "Feat: z")], "sha string, repo string, message string")
    files = spark.createDataFrame([("a", "src/a"), ("a", "src/b"), ("b", "lib/c"), ("c", "src/a"), ("e", "srcs"), (None, "src/a")], "sha string, path string")
    assert [tuple(r) for r in docs.changelog_gap(commits, files, ("src/",)).collect()] == [("r", 1)]
    assert docs.changelog_gap(commits, files, ("src/",), "## [Unreleased]").count() == 0


def test_audits(spark):
    rows = [("a", "full", None, None), ("b", "DOCS-only", None, None), ("c", "custom", "code-reviewer, odd", None), ("d", "custom", None, "code-reviewer,tdd-sequence"), ("e", None, None, None), ("f", "odd", None, None)]
    got = {}
    for r in gates.audit_dispatch(spark.createDataFrame(rows, "milestone string, profile string, run string, skip string")).collect():
        got.setdefault(r.milestone, {})[r.audit] = r.checks
    assert got == {"a": {x: "" for x in gates.AUDITS}, "b": {"future-proofing": "1"}, "c": {"code-reviewer": ""}, "d": {x: "" for x in ("security-auditor", "context7-evidence", "future-proofing")}}


def test_footer_of_ones_own(spark):
    c = spark.createDataFrame([(1, "ends with [XYZ Plan] and pytest"), (2, "ends with [ABC Plan] and pytest")], "id int, text string")
    assert {r.id: r.ok for r in docs.validate_conditions(c, footer=r"\[ABC Plan\]").collect()} == {1: False, 2: True}


def test_answers_are_ordered(spark):
    from weftline import api

    t = {"files": spark.createDataFrame([(1, "a.py")], "id long, path string"), "ownership": spark.createDataFrame([(1, "z", 1), (1, "b", 1), (1, "c", 5)], "file_id long, author string, line_count long")}
    assert [r["author"] for r in api.answer(t, "owners", "a.py")["rows"]] == ["c", "b", "z"]
    e = {"symbols": spark.createDataFrame([(1, "f"), (2, "g")], "id long, name string"), "edges": spark.createDataFrame([(1, 2, "import")], "src long, dst long, kind string")}
    assert api.answer(e, "dependency_chain", "f", "g")["rows"] == []
