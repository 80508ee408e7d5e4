"""Hierarchies against a plain walk, and their corner cases."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators.hierarchy import descendants, hierarchy, resolve_parents, symbol_hierarchy, symbol_path

P = "id long, parent long"


def walk(links):
    """Depth, root and smallest id on the cycle of each id, one by one."""
    out = {}
    for i in links:
        path, at = [i], links[i]
        while at is not None and at not in path:
            path.append(at)
            at = links[at]
        if at is None:
            out[i] = (len(path) - 1, path[-1], None)
        else:
            out[i] = (None, None, min(path[path.index(at) :]))
    return out


def rows(df):
    return {r.id: (r.depth, r.root, r.cycle) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    links = {i: rng.choice([None, rng.randrange(120), max(0, i - 1)]) for i in range(120)}
    got = rows(hierarchy(spark.createDataFrame(list(links.items()), P)))
    assert got == walk(links)


def test_deep_chain_with_paths(spark):
    links = {i: i - 1 if i else None for i in range(150)}
    tree = hierarchy(spark.createDataFrame(list(links.items()), P), with_path=True)
    got = {r.id: r.path for r in tree.collect()}
    assert all(got[i] == list(range(i + 1)) for i in links)
    pairs = descendants(tree)
    assert pairs.count() == sum(range(150))
    assert pairs.where("descendant = 7").orderBy("ancestor").select("ancestor", "distance").collect() == [(k, 7 - k) for k in range(7)]


def test_cycles_of_all_lengths_and_tails(spark):
    links, nxt = {}, 0
    for length in (1, 2, 3, 4, 5, 8):
        for k in range(length):
            links[nxt + k] = nxt + (k + 1) % length
        links[nxt + length] = nxt + length - 1
        links[nxt + length + 1] = nxt + length
        nxt += length + 2
    assert rows(hierarchy(spark.createDataFrame(list(links.items()), P))) == walk(links)


def test_empty_and_only_roots(spark):
    assert hierarchy(spark.createDataFrame([], P)).count() == 0
    assert rows(hierarchy(spark.createDataFrame([(5, None)], P), with_path=True).drop("path")) == {5: (0, 5, None)}


def test_hot_parent(spark):
    links = {0: None} | {i: 0 for i in range(1, 3000)} | {3000: 2999}
    got = rows(hierarchy(spark.createDataFrame(list(links.items()), P)))
    assert got[3000] == (2, 0, None) and got[17] == (1, 0, None)


def test_parents_with_nulls_repeats_and_strange_columns(spark):
    df = spark.createDataFrame([(1, None, "x", 1), (2, 1, "y", 1), (2, 1, "y", 1), (3, 99, "z", 1), (None, 1, "w", 1), (4, 4, "v", 1)], "id long, parent_id long, path string, pid long")
    got = {r.id: r.parent for r in resolve_parents(df, "id", "parent_id").collect()}
    assert got == {1: None, 2: 1, 3: None, 4: 4}


def test_symbol_path_with_marker_before_the_file(spark):
    df = spark.createDataFrame([("s lib/a #f.js#A",), ("s lib/a .f.js#A#B.m",), ("broken",), (None,)], "scip_id string")
    assert [r[0] for r in df.select(symbol_path(F.col("scip_id"))).collect()] == ["A", "A#B.m", "", None]


def test_symbols_fall_back_on_their_path(spark):
    rows_in = [
        (1, 7, "s p #f.py#A", None), (2, 7, "s p .f.py#A.m", None), (3, 7, "s p .f.py#A.n", 12345), (4, 8, "s p .g.py#A.m", None),
        (5, 7, "s p .f.py#A.m.k", 1), (6, 7, None, None), (7, None, "s p .f.py#A.q", None),
    ]
    df = spark.createDataFrame(rows_in, "id long, file_id long, scip_id string, parent_id long")
    got = {r.id: (r.parent, r.depth) for r in symbol_hierarchy(df).collect()}
    assert got == {1: (None, 0), 2: (1, 1), 3: (1, 1), 4: (None, 0), 5: (1, 1), 6: (None, 0), 7: (None, 0)}
