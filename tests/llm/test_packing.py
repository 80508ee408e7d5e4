"""Containers keep every limit, hold every item once and are well filled."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm.encode import TOKENIZERS
from weftline.llm.packing import document_sizes, pack, pack_vectors

S = "key long, tokens int, loss int, container int"


def check(rows, got, capacity, segments, loss):
    per = {}
    for r in got:
        c = per.setdefault(r.container, [0, 0, 0])
        c[0] += r.tokens
        c[1] += 1
        c[2] += r.loss
    assert all(a <= capacity and b <= segments and c <= loss for a, b, c in per.values())
    parts = {}
    for r in got:
        parts.setdefault(r.key, []).append(r)
    assert set(parts) == {k for k, *_ in rows}
    for k, n, l, _ in rows:
        mine = sorted(parts[k], key=lambda r: r.part)
        assert sum(r.tokens for r in mine) == (n or 0) and [r.start for r in mine] == list(np.cumsum([0] + [r.tokens for r in mine[:-1]]))
        assert sum(r.loss for r in mine) == min(l or 0, n or 0)
        if (n or 0) <= capacity and (l or 0) <= loss:
            assert len(mine) == 1
    return per


@pytest.mark.parametrize(("segments", "loss", "block"), [(8, 1000, 10_000), (1000, 300, 10_000), (5, 400, 40)])
def test_limits_hold(spark, segments, loss, block):
    rng = random.Random(segments)
    rows = [(i, rng.choice([0, 1, 7, 50, 200, 999, 1000, 1001, 2500]), rng.choice([0, 5, 300, 900]), 0) for i in range(300)] + [(1000, None, None, 0), (1001, 100_000, 90_000, 0)]
    got = pack(spark.createDataFrame(rows, S), 1000, segments, loss, block).collect()
    check(rows, got, 1000, segments, loss)


def test_nearly_full_without_other_limits(spark):
    rng = random.Random(1)
    rows = [(i, max(1, int(rng.lognormvariate(5, 1))), 0, 0) for i in range(4000)]
    per = check(rows, pack(spark.createDataFrame(rows, S), 2048, 4000, 2048).collect(), 2048, 4000, 2048)
    need = sum(r[1] for r in rows) / 2048
    assert len(per) <= need * 1.01 + 1


def test_vectors_by_hand():
    assert len(pack_vectors(np.zeros((0, 3), dtype=np.int64), np.array([5, 5, 5]))) == 0
    got = pack_vectors(np.array([[6, 1], [4, 1], [5, 1], [5, 1]]), np.array([10, 9]))
    assert got[0] == got[1] and got[2] == got[3] and got[0] != got[2]


def test_repeated_rows_and_empty(spark):
    got = pack(spark.createDataFrame([(1, 600, 0, 0)] * 3, S), 1000).collect()
    assert len(got) == 3 and len({r.container for r in got}) == 3
    assert pack(spark.createDataFrame([], S), 1000).count() == 0
    with pytest.raises(ValueError, match="limit"):
        pack(spark.createDataFrame([], S), 0)


@pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabularies here")
def test_loss_bearing_tokens_are_the_assistants(spark):
    talk = '{"role": "user", "content": "a b c"}\n{"role": "assistant", "content": "d"}'
    df = spark.createDataFrame([(1, talk, "transcript"), (2, talk, None), (3, None, "transcript"), (4, "", "notes")], "doc_id long, text string, doc_type string")
    got = {r.key: (r.tokens, r.loss) for r in document_sizes(df).collect()}
    assert 0 < got[1][1] < got[1][0] == got[2][0] == got[2][1] and got[3] == got[4] == (0, 0)
    assert document_sizes(df).agg(F.count("*")).first()[0] == 4


@pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabularies here")
def test_long_texts_are_measured_in_chunks(spark):
    talk = "".join(f'{{"role": "{who}", "text": "{"word " * 40}{i}"}}\n' for i in range(30) for who in ("user", "assistant"))
    rows = [(1, talk, "transcript"), (1, talk, "transcript"), (None, talk, None), (2, "no role " * 400, "transcript"), (3, "short", "notes"), (4, None, "transcript")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc_type string")
    both = [sorted((tuple(r) for r in document_sizes(docs, chunk=chunk).collect()), key=str) for chunk in (500, 65536)]
    assert both[0] == both[1] and len(both[0]) == 6
    assert all(loss < tokens for _, tokens, loss in both[0][:2])


def test_blocks_are_tasks(spark):
    sizes = spark.createDataFrame([(i, 1 + i % 7, 1) for i in range(400)], "key long, tokens int, loss int")
    assert pack(sizes, 20, 10, block_items=20).rdd.getNumPartitions() == 20
