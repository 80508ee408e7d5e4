"""Readers, the change stream and the interface."""

import gzip
import json

import pytest

from weftline import api
from weftline.sources import git, jsonl, tool_outputs
from weftline.sources.python_source import build_index, parse_python
from weftline.sources.snapshots import SnapshotStore
from weftline.streaming import filewatch


def test_git_log(spark, tmp_path):
    log = "\x1eaaa\x1fx@y\x1f100\x1fsubject\n\na.py\nb/c.py\n\x1ebbb\x1fx@y\x1fnever\x1fs2\n\x1ebroken\n"
    (tmp_path / "log").write_text(log)
    rows = git.read_log(spark, str(tmp_path / "log"))
    assert [(r.sha, r.author_time, r.message, r.files) for r in rows.orderBy("sha").collect()] == [("aaa", 100, "subject", ["a.py", "b/c.py"]), ("bbb", None, "s2", [])]
    assert git.commit_files(rows).count() == 2


def test_blame(spark):
    a, b = "a" * 40, "b" * 40
    lines = [f"{a} 1 1 2", "author-mail <x@y>", "\tone", f"{a} 2 2", "\ttwo", f"{b} 3 3 1", "author-mail <z@y>", "\tthree"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file_path string, pos int, line string")
    assert {r.author_email: (r.line_count, round(r.percentage, 2)) for r in git.blame_shares(df).collect()} == {"x@y": (2, 66.67), "z@y": (1, 33.33)}


def test_added_lines(spark):
    text = "--- a/x.py\n+++ b/x.py\n@@ -1,3 +10,4 @@\n same\n-old\n+new\n same\n+more\n@@ -9 +20 @@\n+last"
    got = git.added_lines(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    assert [(r.file, r.line_no, r.text) for r in got] == [("x.py", 11, "new"), ("x.py", 13, "more"), ("x.py", 20, "last")]


def test_journal_with_archives(spark, tmp_path):
    live = tmp_path / "wal.jsonl"
    live.write_text(json.dumps({"id": "b", "op": "file_upsert", "args": {"path": "p"}}) + '\n\nnot json\n{"id": "b", "ack": true}\n')
    with gzip.open(f"{live}.1.gz", "wt") as f:
        f.write(json.dumps({"id": "a", "op": "file_delete", "args": {"path": "q"}}) + "\n")
    got = jsonl.read_journal(spark, str(live)).collect()
    assert sorted((r.id, bool(r.ack)) for r in got) == [("a", False), ("b", False), ("b", True)]
    assert jsonl.read_journal(spark, str(tmp_path / "missing")).count() == 0


def test_python_sources(spark):
    text = "import os\nfrom .a import b\n\nclass K(object):\n    def m(self, x: int) -> int:\n        '''First.\n        Second.'''\n        return helper(x) + self.n() + print(1)\n\nasync def helper(y):\n    os.getcwd()\n"
    parsed = parse_python(spark.createDataFrame([(1, text), (2, "def ("), (3, None), (4, "")], "file_id long, content string"))
    rows = parsed.collect()
    assert {(r.name, r.kind, r.signature, r.docstring) for r in rows if r.what == "symbol"} == {("K", "class", None, None), ("K.m", "method", "(x: int) -> int", "First."), ("helper", "async_function", "async (y)", None)}
    assert {r.target for r in rows if r.what == "import"} == {"os", ".a"} and [r.file_id for r in rows if r.what == "error"] == [2]
    symbols, edges = build_index(parsed)
    assert symbols.count() == 3 and {r.dst_unresolved for r in edges.collect()} == {None, "n", "getcwd"}


def test_tool_outputs(spark):
    d = lambda t: spark.createDataFrame([(1, t), (2, None)], "doc_id long, text string")
    assert [(r.file, r.symbol) for r in tool_outputs.prose_map(d("src/a.py:\n⋮\n│def f(x):\n│class K:\nb.py:\n│async def g():\n")).collect()] == [("src/a.py", "f"), ("src/a.py", "K"), ("b.py", "g")]
    assert [(r.file, r.symbol) for r in tool_outputs.legend_csv(d("@a=src/\n@ab=lib/\n@ax.py,f\n@aby.py,g\nz.py,h")).orderBy("pos").collect()] == [("src/x.py", "f"), ("lib/y.py", "g"), ("z.py", "h")]
    assert [r.file for r in tool_outputs.xml_paths(d('<file path="a">x</file><file path="b">')).collect()] == ["a", "b"]
    assert [r.file for r in tool_outputs.json_files(d('[{"filename": "a"}, {"x": 1}]')).collect()] == ["a"]
    ranked = spark.createDataFrame([(1, 0, "b", "x"), (1, 1, "a", "y"), (1, 2, "b", "z")], "doc_id long, pos int, file string, symbol string")
    assert [r.file for r in tool_outputs.file_order(ranked).orderBy("pos").collect()] == ["b", "a"]


def test_change_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [("mod", "/r/t1/t1-tasks.md", "2026-01-01T00:00:00Z"), ("mod", "/r/t1/t1-plan.md", "2026-01-01T00:00:05Z"), ("add", "/r/t2/t2-provenance.log", "2026-01-01T00:00:01Z"), ("mod", "/r/t2/notes.txt", "2026-01-01T00:00:09Z")]
    (folder / "a.json").write_text("\n".join(json.dumps(dict(zip(("kind", "path", "seen"), r, strict=True))) for r in rows))
    seen = []
    q = filewatch.watch(filewatch.changes(spark, str(folder)), lambda df, i: seen.extend((r.task, r.seen.second) for r in df.collect()), str(tmp_path / "ck"), once=True)
    q.awaitTermination(60)
    assert sorted(seen) == [("t1", 5), ("t2", 1)]
    batch = spark.read.schema(filewatch.CHANGE).json(str(folder))
    state = spark.createDataFrame([("t0", rows and None), ("t1", None)], "task string, seen timestamp")
    new, affected = filewatch.reduce_batch(state, batch)
    assert sorted(r.task for r in new.collect()) == ["t0", "t1", "t2"] and sorted(r.task for r in affected.collect()) == ["t1", "t2"]
    assert filewatch.reduce_batch(state, batch.limit(0))[1].count() == 0
    table = filewatch.last_seen(filewatch.changes(spark, str(folder)), "1 hour").writeStream.format("memory").queryName("seen_tasks").outputMode("update").trigger(availableNow=True).start()
    table.awaitTermination(60)
    assert sorted((r.task, r.n) for r in spark.table("seen_tasks").collect()) == [("t1", 2), ("t2", 1)]


BAD = ["../../etc/passwd", "foo/../../bar", "'; DROP TABLE symbols;--", "字" * 10_000, "a|b", "", None, 7, "x\n"]


@pytest.mark.parametrize("value", BAD)
def test_bad_arguments_are_answers(value):
    assert api.answer({}, "who_calls", value)["error"]
    assert api.answer({}, "no such tool")["error"] and api.answer({}, "who_calls")["error"]


def test_interface(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.publish({
        "symbols": spark.createDataFrame([(1, 1, "a", "function", 1, "()"), (2, 1, "b", "function", 2, "()")], "id long, file_id long, name string, kind string, line int, signature string"),
        "files": spark.createDataFrame([(1, "f.py", "python")], "id long, path string, lang string"),
        "edges": spark.createDataFrame([(1, 2, "call")], "src long, dst long, kind string"),
    })
    t = api._Relations(store.read)
    assert [r["name"] for r in api.answer(t, "find_references", "b")["rows"]] == ["a"]
    assert api.answer(t, "file_summary", "f.py", budget=1) == {"rows": [], "truncated": True, "error": None}
    assert api.answer(t, "dependency_chain", "a", "b")["rows"] == [{"depth": 1, "path": [1, 2]}]
    assert api.fit([{"a": 1}] * 3, 6) == ([{"a": 1}, {"a": 1}], True)
