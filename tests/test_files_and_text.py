"""Task folders, source files, journals on disk, text columns and rendered texts."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import docs, render
from weftline.sources import journal_sink, tasks
from weftline.sources.jsonl import read_journal


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "t string").select(*columns).first())


def test_text_columns(spark):
    t = F.col("t")
    assert one(spark, "a/b/__init__.py", text.module_name(t), text.language(t)) == ("a.b", "python")
    assert one(spark, "x.TSX", text.language(t)) == ("tsx",) and one(spark, "x.unknown", text.language(t)) == (None,)
    field = text.enum_field(t, "Profile", ("light", "full"))
    assert one(spark, "x\n- **Profile:** full \n", field)[0] == ("full", True, None)
    assert one(spark, "- Profile: FULL", field)[0] == ("FULL", False, "invalid") and one(spark, None, field)[0] == (None, True, None)
    assert one(spark, "a\x1b[31m\n\n b`<c>" + "x" * 200, F.length(text.display(t)), F.substring(text.display(t), 1, 5)) == (120, "a 31m")
    assert one(spark, "x" * 61, text.preview(t)) == ("x" * 60 + "…",) and one(spark, None, text.preview(t)) == (None,)
    a, b = one(spark, "a  \r\nb\r\n\r\n", text.text_hash(t)), one(spark, "a\nb", text.text_hash(t))
    assert a == b and len(a[0]) == 12
    assert one(spark, "  first \nsecond", text.first_line(t), text.tail_lines(t, 1), text.head_lines(t, 1)) == ("first", ["second"], ["  first "])
    assert one(spark, "a,b,c,d,e", text.names_footer(F.split(t, ","))) == ("a, b, c and 2 more",) and one(spark, "a", text.names_footer(F.split(t, ","))) == ("a",)
    assert one(spark, "feat(x): y", t.rlike(text.NOTABLE)) == (True,) and one(spark, "docs: y", t.rlike(text.NOTABLE)) == (False,)


def test_task_folders(spark, tmp_path):
    for root, state in (("home", "PENDING"), ("project", "COMPLETE")):
        d = tmp_path / root / "alpha"
        d.mkdir(parents=True)
        (d / "alpha-tasks.md").write_text(f"## Milestone 1: One\n- Status: {state}\n")
        (d / "alpha-provenance.log").write_text("\n".join(f"line {i}" for i in range(9)) + "\n\n")
        (d / "notes.md").write_text("x")
    (tmp_path / "home" / "beta-plan.md").write_text("only a plan")
    found = tasks.discover(tasks.task_files(spark, [str(tmp_path / "home"), str(tmp_path / "project")]))
    got = {r.task: r for r in found.collect()}
    assert set(got) == {"alpha", "beta"} and got["beta"].error == "no task list" and got["alpha"].error is None
    assert "COMPLETE" in got["alpha"].text and got["alpha"].tail == [f"line {i}" for i in range(4, 9)]


def test_source_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"x = 1\r\n")
    (tmp_path / "src" / "b.txt").write_text("no")
    r = tasks.source_files(spark, str(tmp_path)).collect()
    assert [(x.path, x.lang, x.size, x.content) for x in r] == [("src/a.py", "python", 7, "x = 1\r\n")]


def test_journal_on_disk(spark, tmp_path):
    path, done = str(tmp_path / "wal.jsonl"), []
    entry = journal_sink.journaled(path, "file_upsert", {"path": "p"}, 1, "x", "2026-01-01T00:00:00+0000", lambda: done.append(1))
    with journal_sink.writer_lock(path) as free:
        assert free and journal_sink.journaled(path, "file_upsert", {"path": "q"}, 2, "y", "t", lambda: done.append(2)) is None
    assert done == [1] and sorted((r.id, bool(r.ack)) for r in read_journal(spark, path).collect()) == [(entry, False), (entry, True)]
    with pytest.raises(RuntimeError):
        journal_sink.journaled(path, "file_delete", {"path": "p"}, 3, None, "t", lambda: (_ for _ in ()).throw(RuntimeError("no")))
    assert read_journal(spark, path).where("ack is null").count() == 2
    for k in range(5):
        assert journal_sink.rotate(path, 1)
        journal_sink.journaled(path, "file_upsert", {"path": f"r{k}"}, k, "z", "t", lambda: None)
    assert not journal_sink.rotate(path, 1 << 20) and read_journal(spark, path, 9).where("args.path like 'r%'").count() == 4


def test_markers_are_checked(tmp_path):
    path = tmp_path / "m.log"
    journal_sink.append_marker(str(path), "2026-01-01T00:00:00+00:00", "4.7", "DONE", {"a": "1"})
    assert path.read_text() == "[2026-01-01T00:00:00+00:00] PHASE_4.7 DONE — a=1\n"
    for bad in (("x", "DONE", {"a": "1"}), ("1", "done", {"a": "1"}), ("1", "DONE", {}), ("1", "DONE", {"a b": "1"}), ("1", "DONE", {"a": "1 2"})):
        with pytest.raises(ValueError):
            journal_sink.append_marker(str(path), "t", *bad)


def test_rendered(spark):
    df = spark.createDataFrame([(1, "## Milestone 1: One\n- Status: COMPLETE\n### Step 1.1: s\n- Status: PENDING\n")], "doc_id long, text string")
    items = docs.plan_items(df)
    p = docs.progress(items)
    assert render.summary(p) == "1 COMPLETE 0/1 steps 1/1 milestones\n"
    assert render.board_text(p).splitlines()[-1] == "COMPLETE (1): 1" and render.tree(items, 1) == "1 One [COMPLETE]\n  1.1 s [PENDING]\n"
    assert json.loads(render.envelope(p))["tasks"][0]["status"] == "COMPLETE"
    layers = spark.createDataFrame([("a.py", 3, "core"), ("b" * 200, 0, "periphery")], "path string, in_degree int, layer string")
    assert render.layers_text(layers).splitlines()[:2] == ["core (1)", "- a.py"] and max(map(len, render.layers_text(layers).splitlines())) <= 80
