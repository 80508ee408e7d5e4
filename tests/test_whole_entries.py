"""Messages of entries over several lines, and the spans that no rule explains."""

from datetime import datetime

import pytest

from weftline.operators.loglines import whole_entries

S = "log_name string, line_no long, raw string, captured_at timestamp"
LOG = [
    "stray", "1779463699423 INFO (a) one", "  at \x1b[35mx\x1b[0m.y\r", "", "{", '  "ts": "2026-05-22T15:28:20Z",', '  "level": "warn",', '  "message": "m",', '  "component": "c"', "}", "tail",
    "{", '  "level": "steady"', "}", "[2026-05-22T16:28:31+01:00] PHASE_2 SKIPPED — reason=x", "ts=1779463699 level=info component=d", " z",
]
MESSAGES = {2: "one\n  at x.y\n", 5: 'm\ntail\n{\n  "level": "steady"\n}', 15: "reason=x", 16: "\n z"}
SPANS = {
    2: [(2, 22, 26, " one"), (3, 0, 17, "  at \x1b[35mx\x1b[0m.y")], 5: [(11, 0, 4, "tail"), (12, 0, 1, "{"), (13, 0, 19, '  "level": "steady"'), (14, 0, 1, "}")],
    15: [], 16: [(17, 0, 2, " z")],
}


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_lines_below_an_entry_are_part_of_it(spark, block):
    rows = [("l", i, raw, datetime(2026, 5, 1)) for i, raw in enumerate(LOG, 1)]
    got = whole_entries(spark.createDataFrame(rows[::-1] + rows[2:5], S), block).collect()
    assert {r.line_no: r.message for r in got} == MESSAGES and len(got) == len(MESSAGES)
    assert {r.line_no: [tuple(x) for x in r.unparsed] for r in got} == SPANS


def test_p4_entries_has_traces(spark, data):
    from weftline.plans import catalogue

    got = catalogue.QUERIES["p4_entries"](spark, data)
    assert got.where(r"message like '%\n\tat %'").count() > 0 and got.where("size(unparsed) > 1").count() > 0
    assert got.count() == catalogue.QUERIES["p4_found"](spark, data).count()
