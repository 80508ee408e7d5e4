"""Maintenance of relations, compact views and gates."""

import hashlib
import json

from pyspark.sql import functions as F

from weftline.operators import context, gates, maintain
from weftline.sources.python_source import build_index, parse_python

KV = "k int, v string, n int"


def kv(df):
    return sorted(((r.k, r.v) for r in df.collect()), key=repr)


def test_upserts(spark):
    cur = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "n", 0)], KV)
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1), (None, "m", 1)], KV)
    assert kv(maintain.upsert(cur, new, ["k"], [F.col("n")])) == [(1, "a"), (2, "y"), (3, "z"), (None, "m")]
    assert kv(maintain.insert_new(cur, new.where("n < 2"), ["k"])) == [(1, "a"), (2, "b"), (3, "z"), (None, "n")]
    assert kv(maintain.replace_rows(cur, new, ["k"])) == [(1, "a"), (2, "x"), (2, "y"), (3, "z"), (None, "m")]
    assert kv(maintain.upsert(cur.limit(0), new.limit(0), ["k"])) == []
    assert {r.k: r.n for r in maintain.check_keys(new.select("k"), ["k"]).collect()} == {2: 2, None: 1}


def test_cascade(spark):
    f = spark.createDataFrame([(1, "a"), (2, "b")], "id long, path string")
    s = spark.createDataFrame([(10, 1), (20, 2), (21, 2)], "id long, file_id long")
    e = spark.createDataFrame([(10, 20), (20, 21), (21, None), (20, 10)], "src long, dst long")
    files, symbols, edges = maintain.delete_files(f, s, e, spark.createDataFrame([(1,)], "id long"))
    assert files.count() == 1 and sorted(r.id for r in symbols.collect()) == [20, 21] and sorted((tuple(r) for r in edges.collect()), key=repr) == [(20, 21), (21, None)]


def test_commit_cache(spark):
    c = spark.createDataFrame([("a", "r", 1), ("b", "r", 3), ("c", "r", 3), ("d", "q", None)], "sha string, repo string, author_time long")
    cf = spark.createDataFrame([("a", "x"), ("b", "y")], "commit_sha string, file_path string")
    kept, files = maintain.keep_newest_commits(c, cf, 1)
    assert sorted(r.sha for r in kept.collect()) == ["b", "d"] and files.count() == 1
    assert [r.sha for r in maintain.new_commits(c, spark.createDataFrame([("a",), ("z",), ("z",)], "sha string")).collect()] == ["z"]


def _disk(spark, texts):
    rows = [(i, p, hashlib.sha256(t.encode()).hexdigest(), t) for i, (p, t) in texts.items()]
    return spark.createDataFrame(rows, "id long, path string, hash string, content string")


def test_refresh_equals_build(spark):
    parse = lambda contents: build_index(parse_python(contents))
    one = {1: ("a.py", "def f():\n    g()\n\ndef g(): pass\n"), 2: ("b.py", "def h(): f()\n"), 3: ("c.py", "def k(): pass\n")}
    two = {1: ("a.py", "def f():\n    x()\n"), 9: ("moved.py", one[2][1]), 4: ("d.py", "class K:\n    def m(self): pass\n")}
    disk = _disk(spark, one)
    symbols, edges = parse(disk.select(F.col("id").alias("file_id"), "content"))
    files2, symbols2, edges2 = maintain.refresh(disk.select("id", "path", "hash"), symbols, edges, _disk(spark, two), parse)
    assert {r.path: r.id for r in files2.collect()} == {"a.py": 1, "moved.py": 2, "d.py": 4}
    built = _disk(spark, {1: two[1], 2: two[9], 4: two[4]})
    want_s, want_e = parse(built.select(F.col("id").alias("file_id"), "content"))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(symbols2) == rows(want_s.select(*symbols2.columns)) and rows(edges2) == rows(want_e.select(*edges2.columns))


def test_ranked_views(spark):
    s = spark.createDataFrame([(i, 1, f"f{i}", "function", i, "()") for i in range(1, 6)], "id long, file_id long, name string, kind string, line int, signature string")
    f = spark.createDataFrame([(1, "a.py")], "id long, path string")
    e = spark.createDataFrame([(i, 3, "call") for i in (1, 2, 4)] + [(5, None, "call")], "src long, dst long, kind string")
    ranked = context.ranked_symbols(s, f, e)
    assert [r.name for r in ranked.orderBy("pos").collect()] == ["f3", "f1", "f2", "f4", "f5"]
    text = context.intel(ranked, 64)
    assert len(text) <= 64 * 4 + 1 and json.loads(text)["symbols"][0]["name"] == "f3" and text == context.intel(ranked, 64)
    assert context.fit_per_file(ranked, 12).count() == 2
    docs = spark.createDataFrame([(1, "see `a.py`, `f1()` and `none`"), (2, None)], "doc_id long, text string")
    own = spark.createDataFrame([(1, "x", 3), (1, "y", 1)], "file_id long, author string, line_count long")
    pack = context.context_pack(docs, s, f, e, own)
    assert sorted((r.what, r.name, r.detail) for r in pack.collect()) == [("file", "a.py", "x 75.0%"), ("symbol", "f1", "1")]
    assert context.markdown(pack, 1) == "- file `a.py`: x 75.0%\n- symbol `f1`: 1\n"


def test_gates(spark):
    d = spark.createDataFrame([("t", "critical"), ("u", "note"), ("u", "warning"), ("v", None), ("w", "low")], "task string, severity string")
    assert {r.task: r.verdict for r in gates.verdict(d, "task").collect()} == {"t": "FAIL", "u": "PASS WITH WARNINGS", "v": "PASS WITH WARNINGS", "w": "PASS"}
    assert gates.dispatch(spark.createDataFrame([("t", "LIGHT"), ("u", None)], "task string, profile string")).count() == 3
    p = spark.createDataFrame([("r", "a.py"), ("r", "b.sh"), ("r", "c"), ("r", None)], "repo string, path string")
    assert tuple(gates.scope_counts(p, "repo").first()) == ("r", 3, 1, 1)
    active = spark.createDataFrame([("r", "t1", "plans/t1/"), ("r", "t2", "plans/t2/")], "repo string, task string, prefix string")
    commits = spark.createDataFrame([("1", "r", "Plan: [t1] x"), ("2", "r", "x [skip-drift]"), ("3", "r", None), ("4", "r", "y [no-plan]")], "sha string, repo string, message string")
    cf = spark.createDataFrame([("1", f"plans/t1/{i}") for i in range(3)] + [("2", str(i)) for i in range(3)] + [("3", "a")], "sha string, path string")
    assert [tuple(r) for r in gates.stale_tasks(active, commits, cf, 2).collect()] == [("1", "t2")]
    assert {r.sha: r.ok for r in gates.signed(commits, active).collect()} == {"1": True, "2": False, "3": False, "4": True}
    dirty = spark.createDataFrame([("plans/t1/a/b.md",), ("plans/t10/x",), ("x",), (None,)], "path string")
    assert [tuple(r) for r in gates.dirty_tasks(dirty, active).collect()] == [("t1", "plans/t1/a/b.md")]
    runs = spark.createDataFrame([("x", 1, 10, 2, "ok"), ("x", 1, 20, 4, "skipped"), ("y", 1, None, None, "error")], "tool string, budget int, tokens int, symbols int, status string")
    assert sorted(tuple(r) for r in gates.bench_report(runs).collect()) == [("x", 1, 15, 3, 5.0, "skipped"), ("y", 1, 0, 0, None, "error")]
