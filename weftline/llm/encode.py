"""Encoding a corpus with the vocabulary of a public byte-level tokenizer.

Texts up to ``chunk`` characters are encoded as they are.  Longer ones are cut into overlapping chunks that
are pre-tokenised in parallel.  Two neighbouring chunks meet at the first position of their overlap where both
have a pre-token boundary: the scanner keeps no memory, so from there on both would go on alike.  What lies
between two meeting points is taken from one chunk.  A text without a meeting point in some overlap (one
pre-token longer than the overlap) is encoded in one piece.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import cut

#: Where the vocabularies lie; they are never copied.
TOKENIZERS = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the public pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A vocabulary is broadcast; larger files are refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: The end of a cut text can change its last pre-tokens by so many characters.
TAIL = 4

_encoders: dict[str, object] = {}


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """The rank file of a tokenizer, broadcast after a check of its size."""
    path = os.path.join(folder, f"{name}.tiktoken")
    size = os.path.getsize(path)
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {size} bytes; at most {MAX_VOCABULARY_BYTES} are broadcast")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((name, f.read()))


def encoder(name: str, raw: bytes):
    """One encoder per worker process."""
    if name not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}
        _encoders[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


def _whole(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*shared.value).encode_ordinary
        for batch in batches:
            key, texts = batch.column(0), batch.column(1)
            offsets, flat = [0], []
            for text in texts:
                s = text.as_py()
                if s:
                    flat.extend(encode(s))
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([key, ids], ["key", "ids"])

    return run


def _slices(chunk: int, overlap: int):
    """Cut every text once, from its one copy, into overlapping chunks; a few at a time are given on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for row, text in enumerate(batch.column(1)):
                text = text.as_py()
                n = max(1, -(-(len(text) - overlap) // chunk))
                for first in range(0, n, 64):
                    ks = range(first, min(n, first + 64))
                    parts = pa.array([text[k * chunk : (k + 1) * chunk + overlap] for k in ks], pa.string())
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array([row] * len(ks))), pa.array(ks, pa.int32()), parts], ["key", "k", "text"])

    return run


def _chunks(shared, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        encode, scan, known = encoder(*shared.value).encode_ordinary, regex.compile(PATTERN).finditer, {}
        for batch in batches:
            out = {c: [] for c in ("key", "k", "ids", "head", "head_at", "tail", "tail_at")}
            for key, k, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids, starts, at = [], [], []
                for m in scan(text):
                    starts.append(m.start())
                    at.append(len(ids))
                    piece = m.group()
                    got = known.get(piece)
                    if got is None:
                        got = encode(piece)
                        if len(piece) < 32 and len(known) < 200_000:
                            known[piece] = got
                    ids.extend(got)
                base = k * chunk
                head = [(base + s, a) for s, a in zip(starts, at, strict=True) if s < overlap] if k else []
                tail = [(base + s, a) for s, a in zip(starts, at, strict=True) if chunk <= s <= len(text) - TAIL]
                for name, value in (("key", key), ("k", k), ("ids", ids), ("head", [s for s, _ in head]), ("head_at", [a for _, a in head]), ("tail", [s for s, _ in tail]), ("tail_at", [a for _, a in tail])):
                    out[name].append(value)
            i32 = pa.list_(pa.int32())
            kinds = {"key": batch.schema.field(0).type, "k": pa.int32(), "ids": i32, "head": i32, "head_at": i32, "tail": i32, "tail_at": i32}
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in kinds.items()], list(kinds))

    return run


def encode_corpus(docs: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, chunk: int = 65536, overlap: int = 2048) -> DataFrame:
    """``(key, ids)``: the token ids of every text, without special tokens; their marks in a text are plain text.

    One row per input row, repeated rows included.  Empty and null texts get an empty list.  ``key`` may be
    null or repeated for texts up to ``chunk`` characters; longer texts need distinct keys that aren't null.
    """
    if not TAIL < overlap < chunk:
        raise ValueError("the overlap must be shorter than a chunk and longer than the uncertain tail")
    shared = vocabulary(docs.sparkSession, name, folder)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, ids array<int>"
    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = rows.where(~long).mapInArrow(_whole(shared), schema)
    large = rows.where(long)
    cuts = large.mapInArrow(_slices(chunk, overlap), f"key {kind}, k int, text string")
    arrays = "ids array<int>, head array<int>, head_at array<int>, tail array<int>, tail_at array<int>"
    pieces = cut(cuts.repartition("key", "k").mapInArrow(_chunks(shared, chunk, overlap), f"key {kind}, k int, {arrays}"))
    left = pieces.select("key", (F.col("k") + 1).alias("k"), "tail", "tail_at")
    right = pieces.where("k > 0").select("key", "k", "head", "head_at")
    meet = right.join(left, ["key", "k"]).withColumn("at", F.array_min(F.array_intersect("tail", "head"))).select(
        "key", "k", "at",
        F.expr("element_at(head_at, int(array_position(head, at)))").alias("begin"),
        F.expr("element_at(tail_at, int(array_position(tail, at)))").alias("end"),
    )
    meet = cut(meet)
    apart = meet.where("at is null").select("key").distinct()
    begins = meet.select("key", "k", "begin")
    ends = meet.select("key", (F.col("k") - 1).alias("k"), "end")
    kept = pieces.select("key", "k", "ids").join(begins, ["key", "k"], "left_outer").join(ends, ["key", "k"], "left_outer").join(apart, "key", "left_anti")
    kept = kept.select("key", "k", F.expr("slice(ids, coalesce(begin, 0) + 1, coalesce(end, size(ids)) - coalesce(begin, 0))").alias("ids"))
    stitched = kept.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    whole = large.join(apart, "key", "left_semi").mapInArrow(_whole(shared), schema)
    return short.unionByName(stitched).unionByName(whole).select(F.col("key").alias(key), "ids")


def decode_corpus(encoded: DataFrame, key: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(key, text)``: the concatenated bytes of the tokens, read as UTF-8; a null list gives a null text."""
    shared = vocabulary(encoded.sparkSession, name, folder)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(*shared.value).decode_bytes
        for batch in batches:
            texts = [None if ids is None else decode(ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return encoded.select(F.col(key).alias("key"), "ids").mapInArrow(run, f"key {kind}, text string").select(F.col("key").alias(key), "text")


def token_counts(docs: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, chunk: int = 65536) -> DataFrame:
    """``(key, tokens)`` of every text, 0 for empty and null ones; texts over ``chunk`` characters need distinct keys."""
    return encode_corpus(docs, key, text, name, folder, chunk, min(2048, chunk // 2)).select(key, F.size("ids").alias("tokens"))
