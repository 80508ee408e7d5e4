"""Filling containers of fixed capacity with documents under several limits at once.

Vector bin packing: an item is a vector of tokens, segments and loss-bearing tokens, each as a share of its
limit.  A container is filled with the item that fits and has the largest dot product with the room that is
left, until none fits.  Blocks of bounded size are packed independently; each leaves at most a few containers
open, so with tens of thousands of items per block the loss against packing all at once is small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.encode import TOKENIZERS, encoder, token_counts, vocabulary
from weftline.session import cut

#: Items that a block holds on average.
BLOCK_ITEMS = 20_000

PLACED = "key long, part int, container long, start int, tokens int, loss int"


def pack_vectors(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The container number of every row of ``sizes`` (n, d), none of which exceeds ``limits`` (d).

    Items with equal vectors are interchangeable, so the search runs over the distinct vectors.
    """
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    kinds, which = np.unique(sizes, axis=0, return_inverse=True)
    which = which.reshape(-1)
    left = np.bincount(which, minlength=len(kinds))
    order = np.argsort(which, kind="stable")
    nxt = np.concatenate([[0], np.cumsum(left)[:-1]])
    share = kinds / limits
    out = np.empty(len(sizes), dtype=np.int64)
    room, container, placed = limits.astype(np.int64).copy(), 0, 0
    alive = np.arange(len(kinds))
    while placed < len(sizes):
        fits = alive[(kinds[alive] <= room).all(axis=1)]
        if not len(fits):
            container += 1
            room = limits.astype(np.int64).copy()
            alive = np.flatnonzero(left)
            continue
        best = fits[np.argmax(share[fits] @ (room / limits))]
        out[order[nxt[best]]] = container
        nxt[best] += 1
        left[best] -= 1
        room -= kinds[best]
        placed += 1
        # Room only shrinks within a container, so what doesn't fit now need not be looked at again before the next.
        alive = fits if left[best] else fits[fits != best]
    return out


def _own(text: str) -> str:
    """The lines of a transcript that the assistant wrote."""
    return "".join(line for line in text.splitlines(keepends=True) if '"role": "assistant"' in line)


def _sizes(shared):
    """Tokens of each text and, of transcripts, those in the lines that the assistant wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(*shared.value).encode_ordinary
        for batch in batches:
            tokens, loss = [], []
            for text, talk in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = len(count(text)) if text else 0
                tokens.append(n)
                own = _own(text) if text and talk else ""
                loss.append(min(n, len(count(own))) if own else n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int32()), pa.array(loss, pa.int32())], ["key", "tokens", "loss"])

    return run


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every text the whole, and of transcripts the assistant's lines, each as a text of its own."""
    for batch in batches:
        for row, text, talk in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = _own(text) if talk else ""
            texts = [text, own] if own else [text]
            yield pa.RecordBatch.from_arrays([pa.array([f"{row}{'to'[i]}" for i in range(len(texts))]), pa.array(texts, pa.string())], ["part", "text"])


def document_sizes(docs: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, chunk: int = 65536) -> DataFrame:
    """``(key, tokens, loss)`` of ``docs(doc_id, text, doc_type)``; null and empty texts have 0 tokens.

    Loss-bearing are, in transcripts with lines by an assistant, the tokens of those lines, else all tokens.  Texts
    over ``chunk`` characters are encoded in chunks, so no task encodes a huge one alone.
    """
    shared = vocabulary(docs.sparkSession, name, folder)
    rows = docs.select(F.col("doc_id").alias("key"), "text", F.coalesce(F.col("doc_type") == "transcript", F.lit(False)).alias("talk"))
    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    sizes = rows.where(~long).mapInArrow(_sizes(shared), "key long, tokens int, loss int")
    # Rows are numbered in a written table, as keys may be null or repeated.
    large = cut(rows.where(long).select("key", "text", "talk", F.monotonically_increasing_id().alias("row")))
    if large.isEmpty():
        return sizes
    counted = token_counts(large.select("row", "text", "talk").mapInArrow(_both, "part string, text string"), "part", "text", name, folder, chunk)
    which = F.substring("part", -1, 1)
    per_row = counted.groupBy(F.expr("cast(left(part, length(part) - 1) as bigint)").alias("row")).agg(F.max(F.when(which == "t", F.col("tokens"))).alias("tokens"), F.max(F.when(which == "o", F.col("tokens"))).alias("own"))
    return sizes.unionByName(large.select("row", "key").join(per_row, "row").select("key", "tokens", F.least("tokens", F.coalesce("own", "tokens")).alias("loss")))


def pack(sizes: DataFrame, capacity: int = 2048, max_segments: int = 64, max_loss: int | None = None, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Assign every item of ``sizes(key, tokens, loss)`` to a container: ``(key, part, container, start, tokens, loss)``.

    Within a container tokens, segments and loss-bearing tokens stay within ``capacity``, ``max_segments`` and
    ``max_loss`` (default: the capacity).  An item is split only if it alone exceeds a limit: it gives full
    pieces, numbered by ``part`` from 0 with ``start`` the first token, and one rest.  Its loss-bearing tokens
    are spread evenly.  Null sizes count as 0; items of size 0 take a segment.  Repeated rows are packed each.
    """
    max_loss = capacity if max_loss is None else max_loss
    if min(capacity, max_segments, max_loss) < 1:
        raise ValueError("every limit must be at least 1")
    n = F.coalesce(F.col("tokens").cast("long"), F.lit(0))
    loss = F.least(n, F.coalesce(F.col("loss").cast("long"), F.lit(0)))
    # Tokens of a full piece: as many as fit, so that neither limit is exceeded after even spreading.
    full = F.when((loss == 0) | (loss * capacity <= n * F.lit(max_loss)), F.lit(capacity)).otherwise(F.greatest(F.lit(1), F.floor(n * F.lit(max_loss) / loss).cast("int")))
    items = sizes.select(F.col("key").cast("long").alias("key"), n.alias("n"), loss.alias("l"), full.alias("full"))
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / F.col("full")).cast("int") - 1, F.lit(0)))
    items = items.withColumn("part", F.explode(parts)).withColumn("start", F.col("part") * F.col("full"))
    stop = F.least(F.col("n"), F.col("start") + F.col("full"))
    spread = lambda at: F.when(F.col("n") > 0, F.floor(F.col("l") * at / F.col("n"))).otherwise(F.lit(0)).cast("int")
    items = items.select("key", "part", "start", (stop - F.col("start")).alias("tokens"), F.least(spread(stop) - spread(F.col("start")), F.lit(max_loss)).alias("loss"))
    items = cut(items)
    blocks = max(1, -(-items.count() // block_items))
    limits = np.array([capacity, max_segments, max_loss], dtype=np.int64)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "part", "start"], ignore_index=True)
        vectors = np.column_stack([pdf["tokens"], np.ones(len(pdf)), pdf["loss"]]).astype(np.int64)
        container = pack_vectors(vectors, limits) + (pdf["block"].to_numpy(np.int64) << 32)
        return pdf.assign(container=container)[["key", "part", "container", "start", "tokens", "loss"]]

    block = F.pmod(F.xxhash64("key", "part", "start"), F.lit(blocks)).alias("block")
    # As many tasks as blocks: filling costs far more than its bytes, by which tasks would be put together.
    return items.select("*", block).repartition(blocks, "block").groupBy("block").applyInPandas(fill, PLACED)
