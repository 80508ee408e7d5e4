"""Token ids against the library's own, and the round trip through bytes."""

import os
import random

import pytest

from weftline.llm.encode import TOKENIZERS, decode_corpus, encode_corpus, encoder, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabularies here")
S = "doc_id long, text string, ids int"

TEXTS = [
    None, "", " ", "hello world", "a<|endoftext|>b", "naïve café — “quoted”", "如果快照缺失，就说明阶段被有意跳过。" * 20, "x" * 700, " " * 500 + "a" + " " * 300, "it's we'll 'll 's'",
    "tabs\t\tand\r\nlines\n\n\n  indented", "🙂👩‍👩‍👧‍👧 " * 60, "ab'l" * 200, "1234567890" * 90,
]


def library(text):
    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        return encoder("byte_bpe_50k", f.read()).encode_ordinary(text) if text else []


@pytest.mark.parametrize(("chunk", "overlap"), [(65536, 2048), (100, 30), (16, 8), (9, 5)])
def test_chunks_do_not_show(spark, chunk, overlap):
    rng = random.Random(chunk)
    mixed = ["".join(rng.choice(["word ", "it's", "  ", "\n", "123", "…", "ÄÖ", "x", "'l", "'", "l"]) for _ in range(rng.randrange(200))) for _ in range(40)]
    rows = list(enumerate(TEXTS + mixed))
    got = {r.doc_id: r.ids for r in encode_corpus(spark.createDataFrame([(i, t, 1) for i, t in rows], S), "doc_id", "text", chunk=chunk, overlap=overlap).collect()}
    assert len(got) == len(rows)
    assert all(list(got[i]) == library(t) for i, t in rows)


def test_round_trip(spark):
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)]
    back = {r.doc_id: r.text for r in decode_corpus(encode_corpus(spark.createDataFrame(rows, S), "doc_id", "text", chunk=50, overlap=20), "doc_id").collect()}
    assert all(back[i] == (t or "") for i, t, _ in rows)


def test_repeated_rows_counts_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (None, "c", 0)], S)
    assert sorted(r.tokens for r in token_counts(df, "doc_id", "text").collect()) == [1, 2, 2]
    assert encode_corpus(spark.createDataFrame([], S), "doc_id", "text").count() == 0


def test_bad_chunk_sizes(spark):
    with pytest.raises(ValueError, match="overlap"):
        encode_corpus(spark.createDataFrame([], S), "doc_id", "text", chunk=10, overlap=10)
