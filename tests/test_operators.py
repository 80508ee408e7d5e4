"""Operators of the index, of rankings, documents, evidence and metrics on small fixtures."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftline.operators import diff, docs, evidence, graph, metrics, ranking, relational

E = "src long, dst long, kind string"
SYM = "id long, file_id long, name string, kind string, line int, signature string"


@pytest.fixture(scope="module")
def chain(spark):
    """a calls b calls c calls d; nobody calls orphan."""
    symbols = spark.createDataFrame([(i, 1, n, "function", i, "()") for i, n in enumerate(["a", "b", "c", "d", "orphan"], 1)] + [(9, 2, "K", "class", 1, None)], SYM)
    files = spark.createDataFrame([(1, "chain.py", "python"), (2, "cls.py", "python")], "id long, path string, lang string")
    edges = spark.createDataFrame([(1, 2, "call"), (2, 3, "call"), (3, 4, "call"), (3, None, "call")], E)
    return symbols, files, edges


def names(df):
    return sorted(r.name for r in df.collect())


def test_reachability(chain):
    s, f, e = chain
    assert names(relational.who_calls(s, f, e, "d")) == ["a", "b", "c"]
    assert names(relational.who_calls(s, f, e, "d", 1)) == names(relational.who_calls(s, f, e, "d", 0)) == ["c"]
    assert names(relational.blast_radius(s, f, e, "a")) == ["b", "c", "d"]
    assert names(relational.who_calls(s, f, e, "nobody")) == []
    assert names(relational.dead_code(s, f, e)) == ["a", "orphan"]


def test_seed_on_a_cycle_is_returned(spark):
    e = spark.createDataFrame([(1, 2, "call"), (2, 1, "call"), (3, 3, "call")], E)
    ids = lambda n, d: sorted((r.id, r.depth) for r in graph.reach(e, spark.createDataFrame([(n,)], "id long"), d).collect())
    assert ids(1, 3) == [(1, 2), (2, 1)] and ids(3, 2) == [(3, 1)] and ids(7, 2) == []


def test_shortest_path(chain, spark):
    s, _, e = chain
    at = lambda n: s.where(F.col("name") == n)
    assert [tuple(r) for r in graph.shortest_path(e, at("a"), at("d"), 5).collect()] == [(3, [1, 2, 3, 4])]
    assert graph.shortest_path(e, at("orphan"), at("d"), 5).count() == 0 and graph.shortest_path(e, at("a"), at("d"), 2).count() == 0
    assert [tuple(r) for r in graph.shortest_path(e, at("a"), at("a"), 5).collect()] == [(0, [1])]
    two = spark.createDataFrame([(1, 3, ""), (1, 2, ""), (2, 4, ""), (3, 4, "")], E)
    assert graph.shortest_path(two, at("a"), at("d"), 5).first().path == [1, 2, 4]


def test_pagerank(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    e = spark.createDataFrame([(i, 6, "call") for i in range(1, 6)] + [(1, 99, "call"), (None, 6, "call")], E)
    ranks = {r.id: r["rank"] for r in graph.pagerank(nodes, e).collect()}
    assert math.isclose(sum(ranks.values()), 1.0) and max(ranks, key=ranks.get) == 6 and math.isclose(ranks[7], ranks[1])
    assert graph.pagerank(nodes.limit(0), e).count() == 0


def test_layers(spark):
    files = spark.createDataFrame([(1, "core", ""), (2, "middle", ""), (3, "edge", "")], "id long, path string, lang string")
    symbols = spark.createDataFrame([(10, 1, "x", "function", 1, ""), (20, 2, "y", "function", 1, ""), (30, 3, "z", "function", 1, ""), (31, 3, "z", "function", 1, "")], SYM)
    edges = spark.createDataFrame([(30, 20, "call"), (20, 10, "call"), (30, 10, "import"), (31, 30, "call")], E)
    assert {r.path: (r.in_degree, r.layer) for r in relational.layers(edges, symbols, files).collect()} == {"core": (2, "core"), "middle": (1, "middle"), "edge": (0, "periphery")}
    assert relational.layers(edges, symbols, files.limit(1)).first().layer == "periphery"


def test_search(chain):
    s, f, _ = chain
    renamed = s.withColumn("name", F.when(F.col("id") == 1, "get_x").when(F.col("id") == 2, "getAx").when(F.col("id") == 3, "GET_X_more").otherwise("forget_x"))
    rank = lambda **k: sorted((r.name, r["rank"]) for r in relational.search_symbols(renamed.where("id < 5"), f, "get_x", **k).collect())
    assert rank() == [("GET_X_more", 1), ("forget_x", 2), ("get_x", 0)]
    assert ("getAx", 1) in rank(like_compat=True)


def test_rank_all_numbers_rows_across_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id").repartition(5)
    got = relational.rank_all(df, [F.desc("k"), F.asc("id")], "pos").orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, 1001))
    assert [(r.k, r.id) for r in got] == sorted(((r.k, r.id) for r in got), key=lambda x: (-x[0], x[1]))


def test_imports(spark):
    imports = spark.createDataFrame([("a.b", "c"), ("a.b", "src_only"), ("a.b", "deep.x"), ("a.b", "nothing"), ("a.b", "a.b"), (None, "c")], "source string, import string")
    modules = spark.createDataFrame([("c",), ("a.c",), ("src.src_only",), ("z.deep.x",), ("y.deep.x",), ("a.b",)], "module string")
    got = {r["import"]: (r.target, r.strategy) for r in relational.resolve_imports(imports.where("source is not null"), modules).collect()}
    assert got == {"c": ("c", 1), "src_only": ("src.src_only", 3), "deep.x": ("y.deep.x", 4), "nothing": (None, None), "a.b": (None, None)}


def test_containers(spark):
    spans = spark.createDataFrame([(1, 1, 0, 100, True), (2, 1, 10, 50, True), (3, 1, 20, 30, False), (4, 1, 60, 200, True), (5, 2, 20, 30, True)], "id long, grp long, start int, stop int, holds boolean")
    assert {r.id: r.container for r in relational.innermost_container(spans).collect()} == {1: None, 2: 1, 3: 2, 4: None, 5: None}


def test_budget_prefix(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([5, 5, None, 9, 1])], "g string, i int, s int")
    got = ranking.prefix_fit(df, ["g"], ["i"], "s", cap=18, base=2, gap=2).orderBy("i").collect()
    assert [(r.i, r.used) for r in got] == [(0, 7), (1, 14), (2, 16)]


def rbo_by_hand(s, t, p=0.9, k=10):
    if not s or not t:
        return 0.0
    d = k
    agree = lambda i: len(set(s[:i]) & set(t[:i])) / i
    return sum((1 - p) * p ** (i - 1) * agree(i) for i in range(1, d + 1)) + agree(d) * p**d


@pytest.mark.parametrize(("s", "t"), [(["a"], ["a"]), (["a", "b", "c"], ["c", "b"]), (list("abcdefghijklmn"), list("bacdxyzhij")), ([], ["a"]), ([], []), (["a"], ["b"])])
def test_similarity(spark, s, t):
    df = spark.createDataFrame([(s, t)], "s array<string>, t array<string>")
    r = df.select(ranking.rbo(F.col("s"), F.col("t")).alias("r"), ranking.jaccard(F.col("s"), F.col("t")).alias("j"), ranking.jaccard(F.col("s"), F.col("t"), 1.0).alias("e")).first()
    assert math.isclose(r.r, rbo_by_hand(s, t), abs_tol=1e-12)
    union = set(s) | set(t)
    assert math.isclose(r.j, len(set(s) & set(t)) / len(union) if union else 0.0) and (r.e == 1.0 or union)


def test_folds(spark):
    df = spark.createDataFrame([("a", "ok", 1), ("a", "error", 2), ("b", "skipped", 7), ("b", None, None), ("c", "strange", None)], "g string, s string, v int")
    assert {r.g: r.status for r in ranking.worst(df, ["g"], "s").collect()} == {"a": "error", "b": "skipped", "c": "ok"}
    assert {r.g: r["median"] for r in ranking.medians(df, ["g"], "v").collect()} == {"a": 1, "b": 7, "c": 0}
    assert ranking.newest(df, ["g"], [F.desc("v")], 1).count() == 3


def test_file_classes(spark):
    s = "path string, hash string"
    old = spark.createDataFrame([("same", "1"), ("dirty", "1"), ("gone", "2"), ("from1", "3"), ("from2", "3"), ("nul", None)], s)
    new = spark.createDataFrame([("same", "1"), ("dirty", "9"), ("fresh", "8"), ("to1", "3"), ("nul", None)], s)
    got = {r.path: (r.change, r.moved_from) for r in diff.classify_files(old, new).collect()}
    assert got == {"same": ("unchanged", None), "dirty": ("dirty", None), "gone": ("deleted", None), "fresh": ("new", None), "to1": ("moved", "from1"), "from2": ("deleted", None), "nul": ("dirty", None)}


def test_symbol_diff(spark):
    s = "file string, kind string, name string, line int, signature string"
    old = spark.createDataFrame([("f", "function", "same", 1, "(a)"), ("f", "function", "changed", 2, "(a)"), ("f", "function", "before", 10, "(x, y, z)"), ("f", "class", "K", 20, "(x, y, z)"), ("f", "function", "gone", 30, "(q)")], s)
    new = spark.createDataFrame([("f", "function", "same", 5, "(a)"), ("f", "function", "changed", 2, "(b)"), ("f", "function", "after", 12, "(x, y, z)"), ("f", "function", "later", 100, "(x, y, z)"), ("f", "function", "fresh", 40, "(m, n)")], s)
    got = {(r.change, r.old_name, r.new_name, r.score) for r in diff.diff_symbols(old, new).collect()}
    assert got == {("unchanged", "same", "same", None), ("modified", "changed", "changed", None), ("renamed", "before", "after", 1.0), ("added", None, "later", None), ("added", None, "fresh", None), ("removed", "K", None, None), ("removed", "gone", None, None)}
    assert diff.diff_symbols(old.limit(0), new.limit(0)).count() == 0


PLAN = """# T

## Milestone 1: One
- **Status:** COMPLETE
### Step 1.1: a
- Status: COMPLETE
### Step 1.2 - b
Status: ACTIVE

```
## Milestone 9: quoted
- Status: BLOCKED
```
<!-- ## Milestone 8: hidden -->
## Milestone M2 – Two
- Status: strange
## Milestone 3-x: not one
#### Step 2.1: too deep
"""


def test_plans(spark):
    df = spark.createDataFrame([(1, PLAN, 0), (2, None, 0), (3, "", 0), (4, PLAN.replace("\n", "\r\n"), 0)], "doc_id long, text string, pos int")
    items = docs.plan_items(df)
    want = [("milestone", "1", "One", "COMPLETE"), ("step", "1.1", "a", "COMPLETE"), ("step", "1.2", "b", "IN_PROGRESS"), ("milestone", "2", "Two", "PENDING")]
    for d in (1, 4):
        assert [tuple(r)[2:6] for r in items.where(F.col("doc_id") == d).orderBy("pos").collect()] == want
    p = docs.progress(items)
    assert tuple(p.where("doc_id = 1").first()) == (1, 1, 2, 1, 2, "IN_PROGRESS") and p.count() == 2
    assert [(r.status, r.tasks) for r in docs.board(p).orderBy("pos").collect()] == [("PENDING", 0), ("IN_PROGRESS", 2), ("BLOCKED", 0), ("COMPLETE", 0)]
    assert tuple(docs.active_item(items).where("doc_id = 1").first()) == (1, "2", "Two", "PENDING", 0)
    assert docs.non_canonical(df).where("doc_id = 1").count() == 3
    assert docs.plan_items(df.limit(0)).count() == 0


def test_scans(spark):
    df = spark.createDataFrame([(1, 'see `a.py` and `f()` and `a.py`\npassword = "hunter2hunter2"\nos.system(x)\nlib 1.2.3 and 1.2.4', 0), (2, None, 0)], "doc_id long, text string, first int")
    assert sorted((r.token, r["first"]) for r in docs.mentions(df).collect()) == [("a.py", 0), ("f", 1)]
    assert sorted((r.pos, r.risk) for r in docs.security_scan(df).collect()) == [(1, "secret"), (2, "shell")]
    assert [(r.pos, r.version) for r in docs.version_drift(df, "1.2.3", "LIB").collect()] == [(3, "1.2.4")]
    assert [tuple(r) for r in docs.term_search(df, "OS.").collect()] == [(1, 1)]
    c = spark.createDataFrame([(1, "pytest exits 0 and tasks.md says so"), (2, "looks good in tasks.md after git tag"), (3, " "), (4, None), (5, "x" * 5000), (6, "see tasks.md, Status: COMPLETE")], "id long, text string")
    few = "observable_artifacts_insufficient"
    assert {r.id: r.reason for r in docs.validate_conditions(c).collect()} == {1: None, 2: "condition_too_vague", 3: few, 4: few, 5: "condition_too_long", 6: few}
    assert docs.validate_conditions(c, 31).where("reason = 'turn_cap_out_of_range'").count() == 6
    a, b = spark.createDataFrame([("x",), ("y",), ("y",)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert sorted(tuple(r) for r in docs.reconcile(a, b, "k").collect()) == [("x", "left_only"), ("z", "right_only")]


def test_evidence(spark):
    text = '{"type": "tool_use", "name": "Read", "input": {"p": 1}}\nnot json\n{"message": {"content": [{"type": "tool_use", "name": "Bash"}, {"type": "text"}]}}\n\n{"role": "user", "content": "hi"}'
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert [(r.pos, r.name) for r in evidence.tool_calls(df).orderBy("pos").collect()] == [(0, "Read"), (1, "Bash")]
    assert [(r.pos, r.role, r.content) for r in evidence.turns(df).collect()] == [(4, "user", "hi")]
    m = spark.createDataFrame([("l", 1, "1", "INIT", None), ("l", 9, "1", "DONE", {"a": "b"}), ("l", 2, "2", "SKIPPED", None), ("l", 3, "3", "SKIPPED", {"reason": "x"})], "log_name string, line_no long, phase_id string, status string, payload map<string,string>")
    phases = spark.createDataFrame([("1", True), ("2", True), ("3", True), ("4", True), ("0", False)], "phase_id string, required boolean")
    calls = spark.createDataFrame([("l", "Skill", "{}"), ("l", "Agent", '{"subagent_type": "Explorer"}')], "log_name string, name string, input string")
    got = {r.phase_id: (r.marker_status, r.warning) for r in evidence.correlate(m, phases, calls).collect()}
    assert got == {"1": ("DONE", "no_evidence"), "2": ("SKIPPED", "skipped_without_reason"), "3": ("SKIPPED", None), "4": ("absent", "no_marker")}


def test_metrics(spark):
    at = lambda d, h, m=0: datetime(2026, 1, d, h, m)
    c = spark.createDataFrame([("1", "r", "a", at(1, 8), "feat: x"), ("2", "r", "a", at(1, 8, 30), "fix(y)!: x"), ("3", "r", "b", at(2, 9), None), ("4", "r", "a", None, "other")], "sha string, repo string, author string, ts timestamp, message string")
    f = spark.createDataFrame([("1", "src/a.py"), ("1", "tests/test_a.py"), ("2", "src/a.py"), ("3", "docs/x.md")], "sha string, path string")
    assert sorted((r.n, r.minutes, r["class"]) for r in metrics.sessions(c, ["repo"]).collect()) == [(1, 0, "micro"), (2, 30, "medium")]
    assert sorted((r.author, r.days) for r in metrics.streaks(c, ["author"]).collect()) == [("a", 1), ("b", 1)]
    assert metrics.hour_histogram(c).count() == 24 and metrics.hour_histogram(c).agg(F.sum("n")).first()[0] == 3
    assert {r.type: r.n for r in metrics.commit_types(c, ["repo"]).collect()} == {"feat": 1, "fix": 1, "other": 2}
    assert {r.author: (r.commits, r.files, r.top_area) for r in metrics.leaderboard(c, f, ["repo"]).collect()} == {"a": (3, 3, "src"), "b": (1, 1, "docs")}
    assert tuple(metrics.focus(c, f, ["repo"]).first()) == ("r", "src", round(2 / 3, 6))
    assert metrics.churn(c, f, ["repo"], 1).first().path == "src/a.py"
    assert {r.author: r.verdict for r in metrics.tdd_sequence(c, f, ["author"]).collect()} == {"a": "PASS", "b": "FAIL"}
    assert [(r.n, r.delta) for r in metrics.weekly_trend(c, ["repo"]).collect()] == [(3, None)]
    nums = spark.createDataFrame([(0,), (4,), (30,), (-1,)], "n int")
    assert [r[0] for r in nums.select(metrics.turn_cap(F.col("n"))).collect()] == [4, 6, 30, None]
    sev = spark.createDataFrame([("x", "critical"), ("x", None), ("y", "low")], "agent string, severity string")
    assert {r.agent: (r.critical, r.high, r.low, r.verdict) for r in metrics.severity_rollup(sev, "agent").collect()} == {"x": (1, 1, 0, "FAIL"), "y": (0, 0, 1, "PASS"), "TOTAL": (1, 1, 1, "FAIL")}


def test_phase_evidence(spark):
    calls = [
        ("a", "Agent", '{"subagent_type": "Explore"}'), ("a", "AskUserQuestion", None), ("a", "AskUserQuestion", "not json"), ("a", "Read", '{"file_path": 7}'), ("a", "Agent", '{"subagent_type": "x-scribe"}'),
        ("b", "AskUserQuestion", "{}"), ("b", "AskUserQuestion", "{}"), ("b", "AskUserQuestion", "{}"), ("b", "Read", '{"file_path": "docs/lessons.md"}'), ("b", "mcp__context7__get", None), ("b", "Agent", '{"subagent_type": "x-scribe"}'), ("b", "Agent", '{"subagent_type": "x-validator"}'),
    ]
    got = {r.log_name: {k for k, v in r.evidence.items() if v} for r in evidence.phase_evidence(spark.createDataFrame(calls, "log_name string, name string, input string")).collect()}
    assert got == {"a": {"1", "3"}, "b": {"1.3", "1.5", "3", "5"}}


def test_fences():
    text = "a\n````md\n```\nb\n```\n````\nc\n~~~ x\nd\n~~~ y\n~~~~\ne\n    ```\nf\n`x` ```y```\n```\ng"
    assert docs.blank_fences(text).split("\n") == ["a", "", "", "", "", "", "c", "", "", "", "", "e", "    ```", "f", "`x` ```y```", "", ""]
