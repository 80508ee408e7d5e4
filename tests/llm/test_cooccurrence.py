"""Pair counts against counting by hand, with baskets cut into chunks."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.llm.cooccurrence import co_change, cooccurrence

P, B = "basket string, item string, scope string", "basket string, scope string, item string"


def by_hand(pairs, baskets, min_count, min_lift):
    held = {}
    for b, s in set(baskets):
        for bb, i in set(pairs):
            if bb == b and None not in (b, s, i):
                held.setdefault((s, b), set()).add(i)
    n, single, both = Counter(), Counter(), Counter()
    for (s, _), items in held.items():
        n[s] += 1
        for i in items:
            single[s, i] += 1
        for a, b in itertools.combinations(sorted(items), 2):
            both[s, a, b] += 1
    return {
        k: (c, single[k[0], k[1]], single[k[0], k[2]], n[k[0]])
        for k, c in both.items()
        if c >= min_count and c * n[k[0]] >= min_lift * single[k[0], k[1]] * single[k[0], k[2]]
    }


@pytest.mark.parametrize(("chunk", "min_count", "min_lift"), [(256, 1, 0.0), (3, 1, 0.0), (4, 2, 1.2)])
def test_against_counting(spark, chunk, min_count, min_lift):
    rng = random.Random(chunk)
    pairs = [(f"b{b}", f"i{rng.randrange(14)}") for b in range(40) for _ in range(rng.choice([1, 2, 4, 15]))]
    pairs += pairs[:50] + [(None, "i1"), ("b1", None), ("unknown", "i1"), ("unknown", "i2")]
    baskets = [(f"b{b}", f"s{b % 2}") for b in range(40)] * 2 + [("b1", None), (None, "s1"), ("b3", "s0"), ("empty", "s0")]
    p = spark.createDataFrame([(b, i, "clash") for b, i in pairs], P)
    got = cooccurrence(p, spark.createDataFrame([(b, s, "clash") for b, s in baskets], B), min_count, min_lift, chunk).collect()
    want = by_hand(pairs, baskets, min_count, min_lift)
    assert {(r.scope, r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in got} == want and len(got) == len(want)
    for r in got:
        assert math.isclose(r.lift, r.n_ab * r.n / (r.n_a * r.n_b)) and math.isclose(r.pmi, math.log2(r.lift), abs_tol=1e-9)


def test_one_huge_basket(spark):
    pairs = spark.range(400).select(F.lit("b").alias("basket"), F.format_string("i%04d", "id").alias("item"), F.lit("").alias("scope"))
    out = cooccurrence(pairs, spark.createDataFrame([("b", "s", "")], B), chunk=16)
    assert out.count() == 400 * 399 // 2 and out.where("n_ab <> 1").count() == 0


def test_paths_and_hashes_in_other_spellings(spark):
    files = [("AA01", "./a//b.py"), ("aa01", '"c.py"'), ("bb02", "a\\b.py"), ("bb02", " c.py "), ("bb02", ""), ("zz", "a/b.py"), (None, "c.py")]
    commits = [("aa01", "r"), ("BB02", "r"), ("aa01", "r"), ("cc03", "r")]
    got = co_change(spark.createDataFrame(files, "commit_sha string, file_path string"), spark.createDataFrame(commits, "sha string, repo string")).collect()
    assert [(r.scope, r.item_a, r.item_b, r.n_ab, r.n) for r in got] == [("r", "a/b.py", "c.py", 2, 2)]


def test_empty(spark):
    assert cooccurrence(spark.createDataFrame([], P), spark.createDataFrame([], B)).count() == 0


def test_pairs_of_chunks_are_keys_of_their_own(spark):
    from weftline.llm.cooccurrence import _across

    rows = [("b", "s", k, 40, list(range(k * 10, k * 10 + 10))) for k in range(40)]
    chunks = spark.createDataFrame(rows, "basket string, scope string, chunk int, chunks int, c array<long>")
    pairs = _across(chunks, 16)
    assert pairs.count() == 40 * 39 // 2 * 100 == pairs.distinct().count() and pairs.where("a >= b").isEmpty()
    # One basket, broadcasts off: its pairs are spread over the tasks.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [n for n in _across(chunks, 16).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        assert len(sizes) > 10 and max(sizes) < sum(sizes) / 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold") if adaptive is None else spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", adaptive)


def test_items_of_one_hash_get_other_codes(spark):
    from weftline.llm.cooccurrence import _coder

    df = spark.createDataFrame([("s", "x"), ("s", "y")], "scope string, item string")
    second = {r["item"]: r["h"] for r in df.select("item", F.xxhash64(F.lit(-1), "scope", "item").alias("h")).collect()}
    codes = lambda c: {r["item"]: r["i"] for r in df.select("item", c(F.col("scope"), F.col("item")).alias("i")).collect()}
    plain, other = codes(_coder(1, [])), codes(_coder(1, [second["x"]]))
    assert plain["y"] == other["y"] and plain["x"] != other["x"]
