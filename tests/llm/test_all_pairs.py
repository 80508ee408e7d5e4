"""All pairs against DuckDB, those of a single commit included."""

import duckdb

import __spark_entry__ as e


def test_pairs_of_one_commit_come_out(spark, data):
    con = duckdb.connect()
    for name in ("commits", "commit_files"):
        con.execute(f"create view {name} as select * from '{data}/{name}.parquet'")
    columns = ["repo", "file_a", "file_b", "n_ab", "n_a", "n_b", "n", "lift", "pmi"]
    got = sorted(tuple(r) for r in e.queries()["p6_all_pairs"](spark, data).select(*columns).collect())
    want = sorted(con.execute(f"select {', '.join(columns)} from ({e.oracle_sql()['p6_all_pairs']})").fetchall())
    assert [r[:7] for r in got] == [r[:7] for r in want]
    assert all(abs(x - y) < 2e-6 for g, w in zip(got, want, strict=True) for x, y in zip(g[7:], w[7:], strict=True))
    assert sum(r[3] == 1 for r in got) > 0
