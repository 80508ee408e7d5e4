"""Log lines: the grammar line by line, then entries against a plain assembly."""

from datetime import datetime

import pytest

from weftline.functions.earley import Grammar
from weftline.functions.logformats import LineParser, millis
from weftline.operators.loglines import log_entries, markers, parse_lines

S = "log_name string, line_no long, raw string, captured_at timestamp, kind string"
AT = datetime(2026, 5, 1)


def test_earley_prefers_the_weightier_parse():
    g = Grammar("s", [("s", ("a", "a"), 1), ("s", ("b",), 3), ("a", ("X",), 0), ("b", ("X", "X"), 0)])
    seen, spans, end = g.parse([("X",), ("X",), ("X",)])
    assert end == 2 and ("b", 0, 2) in spans and seen == 2
    assert g.parse([("Y",)])[1] is None


def test_earley_left_and_right_recursion():
    g = Grammar("s", [("s", ("s", "X"), 1), ("s", ("X",), 0), ("r", ("X", "r"), 0), ("r", ("X",), 0)])
    assert g.parse([("X",)] * 5)[2] == 5


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2026-05-22 15:28:31,819 INFO    hooks.gate: level=high", ("entry", 1779463711819, "INFO", "hooks.gate")),
        ("22/May/2026:15:29:12 +0530 | a.b | DBG | x", ("entry", 1779443952000, "DEBUG", "a.b")),
        ("1779463699423 CRITICAL (a.b) x", ("entry", 1779463699423, "FATAL", "a.b")),
        ("I0815 22:49:40.127999   5078 catalog.py:704] x", ("entry", 1786834180127, "INFO", "catalog.py")),
        ("Jun  1 18:46:52 node-b runner[5170]: WRN: x", ("entry", 1780339612000, "WARN", "runner")),
        ("INF   2026/06/12 02:47:54 bench.sweep - x\r", ("entry", 1781232474000, "INFO", "bench.sweep")),
        ("[2026-04-08 14:36:29.419] \x1b[35m[ERR]\x1b[0m [hooks.gate] x", ("entry", 1775658989419, "ERROR", "hooks.gate")),
        ('time=1777252767.6649 component=a.b level=error msg="x y"', ("entry", 1777252767664, "ERROR", "a.b")),
        ('{"level":"warn","time":"2026-03-22T01:56:39.852Z","logger":"a.b","message":"m \\" n"}', ("entry", 1774144599852, "WARN", "a.b")),
        ("[2026-05-22T16:28:31+01:00] PHASE_4.7 DONE — a=1", ("entry", 1779463711000, "DONE", "PHASE_4.7")),
        ("| [2026-05-22T16:28:31+01:00] PHASE_1 DONE — a=1", ("rest", None, None, None)),
        ("2026-02-02 was the last buffer", ("rest", None, None, None)),
        ("- ERROR count so far: 4", ("rest", None, None, None)),
        ("2026-13-45 15:28:31,819 INFO a: x", ("rest", None, None, None)),
        ("", ("rest", None, None, None)),
        ("{", ("open", None, None, None)),
        ('  "level": "info",', ("member", None, "INFO", None)),
        ("}", ("close", None, None, None)),
    ],
)
def test_lines(raw, want):
    assert LineParser().parse(raw, 2026)[:4] == want


def test_equal_beginnings_are_parsed_once_and_alike():
    p = LineParser()
    first = p.parse("1779463699423 INFO (a) one", 2026)
    assert p.parse("1779463699424 INFO (b) two three", 2026) == (first[0], first[1] + 1, "INFO", "b", "two three", 10)
    assert p.parse(None, 2026)[0] == "rest"
    assert p.parse("x" * 200_000, 2026)[0] == "rest"


def test_times():
    assert millis("2026-01-01T00:00:00.9999-05:00", 0) == 1767243600999
    assert millis("nonsense", 2026) is None


LOG = [
    "stray", "1779463699423 INFO (a) one", "  more", "", "{", '  "ts": "2026-05-22T15:28:20Z",', '  "level": "warn",', '  "component": "c"', "}", "tail",
    "{", '  "level": "steady"', "}", "[2026-05-22T16:28:31+01:00] PHASE_2 SKIPPED — reason=x reason=y", "| [2026-05-22T16:28:31+01:00] PHASE_3 DONE — q=1",
]
WANT = [(2, 4, "INFO", "a"), (5, 13, "WARN", "c"), (14, 15, "SKIPPED", "PHASE_2")]


@pytest.mark.parametrize("block", [1, 2, 3, 5, 4096])
def test_entries_do_not_depend_on_blocks(spark, block):
    rows = [("l", i, raw, AT, "k") for i, raw in enumerate(LOG, 1)]
    rows = rows[::-1] + rows[3:9] + [("other", 1, "no entry", AT, "k"), (None, 1, LOG[1], AT, "k"), ("l", None, LOG[1], AT, "k"), ("nulls", 1, None, None, None)]
    got = log_entries(spark.createDataFrame(rows, S), block).orderBy("line_no").collect()
    assert [(r.line_no, r.last_line, r.level, r.component) for r in got] == WANT
    m = markers(spark.createDataFrame([tuple(r) for r in got], log_entries(spark.createDataFrame([], S)).schema)).collect()
    assert [(r.phase_id, r.status) for r in m] == [("2", "SKIPPED")] and set(m[0].payload) == {"reason"}


def test_object_that_is_interrupted_starts_no_entry(spark):
    lines = ["{", '  "ts": "2026-05-22T15:28:20Z",', "interrupted", '  "level": "warn"', "}"]
    assert log_entries(spark.createDataFrame([("l", i, x, AT, "") for i, x in enumerate(lines, 1)], S)).count() == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], S)
    assert parse_lines(empty).count() == 0 and log_entries(empty).count() == 0


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2024-01-01T00:00:00Z ERROR [main] com.foo.Bar - it failed", ("entry", 1704067200000, "ERROR", "com.foo.Bar", "it failed")),
        ("2024-01-01 00:00:00,5 [http-nio-8080] WARN com.foo.Bar - slow", ("entry", 1704067200500, "WARN", "com.foo.Bar", "slow")),
        ("2024-01-01 00:00:00,123 - app.core - INFO - started", ("entry", 1704067200123, "INFO", "app.core", "started")),
        ("<34>1 2024-01-01T00:00:00.003Z host.x su 77 ID47 - done", ("entry", 1704067200003, "FATAL", "su", "- done")),
        ('{"ts": 1704067200, "level": "info", "logger": "a", "x": null, "y": 1.5, "z": [1, "b", -2.25]}', ("entry", 1704067200000, "INFO", "a", None)),
        ("ts=1704067200 level=info caller=main.go:12 msg=hi", ("entry", 1704067200000, "INFO", "main.go", "hi")),
        ("\tat com.foo.Bar.baz(Bar.java:12)", ("frame", None, None, None, None)), ("Caused by: x", ("frame", None, None, None, None)),
        ('  File "a.py", line 3, in f', ("frame", None, None, None, None)), ("\t... 12 more", ("frame", None, None, None, None)),
        ("  more text", ("indented", None, None, None, None)), ("plain text", ("rest", None, None, None, None)),
    ],
)
def test_more_layouts(raw, want):
    from weftline.functions.logformats import LineParser

    assert LineParser().parse(raw, 2024)[:5] == want


def test_a_layout_of_ones_own(spark):
    from weftline.operators.loglines import log_entries

    lines = spark.createDataFrame([("l", 1, "2024-01-01T00:00:00Z ; core ; WARN ; slow", None)], "log_name string, line_no long, raw string, captured_at timestamp")
    assert log_entries(lines).count() == 0
    own = (("plain", ("stamp", "WS", "OTHER", "WS", "comp", "WS", "OTHER", "WS", "level", "WS", "OTHER"), 0),)
    assert [(r.level, r.component, r.message) for r in log_entries(lines, rules=own).collect()] == [("WARN", "core", "slow")]
