"""Items that appear together: pair counts and how far they exceed chance.

Baskets are held as chunks of bounded size.  An ordinary basket is one chunk; a larger one is cut by a hash
of its items, and the pairs of its chunks are spread over tasks by basket and both chunk numbers, so no task ever
holds a whole huge basket.  Chunk pairs and ordinary pairs are counted together with map-side combination.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.paths import canonical_path
from weftline.session import cut

#: Expected items in a chunk; a pair of chunks yields at most its square.
CHUNK = 256
#: Pairs of chunks of huge baskets in a task.
TASK_PAIRS = 64
#: Items whose codes meet; far more than there can be among 10^12 items.
MAX_ODD = 1_000_000


def cooccurrence(pairs: DataFrame, baskets: DataFrame, min_count: int = 1, min_lift: float = 0.0, chunk: int = CHUNK) -> DataFrame:
    """``(scope, item_a, item_b, n_ab, n_a, n_b, n, lift, pmi)`` for pairs with ``item_a < item_b``.

    ``pairs(basket, item)`` lists what each basket holds and ``baskets(basket, scope)`` to which scope it
    belongs; a basket in several scopes counts in each.  Repeated rows count once; rows with a null basket or
    item, and items of unknown baskets, count nowhere.  ``n`` is the number of baskets of the scope that hold
    anything, ``lift`` is ``n_ab * n / (n_a * n_b)`` and ``pmi`` its binary logarithm.  Returned are the pairs
    with ``n_ab >= min_count`` and ``n_ab * n >= min_lift * n_a * n_b``.

    Items too frequent to reach ``min_lift`` with any partner (``min_lift * n_a > n``) are taken out before
    pairs are made, which changes no result.  A scope has at most ``min_lift`` times its mean basket size of them.
    """
    pairs = pairs.select("basket", "item").where("basket is not null and item is not null")
    baskets = baskets.select("basket", "scope").where("basket is not null and scope is not null").distinct()
    # Row counts bound the basket sizes; only baskets beyond a chunk get an entry.  They are counted by a hash,
    # as a collision could only make a basket seem large, which is harmless.
    code = F.xxhash64("basket").alias("code")
    large = pairs.groupBy(code).agg(F.count("*").alias("rows")).where(F.col("rows") > chunk)
    large = cut(large.select("code", F.ceil(F.col("rows") / chunk).cast("int").alias("chunks")))
    n_chunks = F.coalesce("chunks", F.lit(1))
    left = pairs.withColumn("code", code).join(large, "code", "left_outer").select("basket", "item", F.pmod(F.xxhash64("item"), n_chunks).cast("int").alias("chunk"))
    right = baskets.withColumn("code", code).join(large, "code", "left_outer")
    right = right.select("basket", "scope", n_chunks.alias("chunks"), F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("chunk"))
    held = left.join(right, ["basket", "chunk"]).groupBy("basket", "chunk", "scope", "chunks").agg(F.collect_set("item").alias("items"))
    # Baskets of one chunk aren't needed by name any more.
    held = cut(held.select(F.when(F.col("chunks") > 1, F.col("basket")).alias("basket"), "chunk", "chunks", "scope", "items"))

    sizes = held.groupBy("scope").agg((F.count(F.when(F.col("basket").isNull(), 1)) + F.count_distinct("basket")).alias("n"))
    single = held.select("scope", F.explode("items").alias("item")).groupBy("scope", "item").agg(F.count("*").alias("n_item"))
    items = cut(single.join(sizes, "scope").select("scope", "item", "n_item", "n"))
    # Items are coded by a hash.  The few whose hash another item has are known by a second hash and get another
    # code, until all codes differ.
    odd: list[int] = []
    for seed in range(1, 9):
        code_of = _coder(seed, odd)
        items_coded = items.withColumn("i", code_of(F.col("scope"), F.col("item")))
        if not items_coded.agg((F.count("*") - F.count_distinct("i")).alias("d")).first()["d"]:
            break
        met = items_coded.groupBy("i").agg(F.count("*").alias("m")).where("m > 1")
        known = items_coded.join(met, "i", "left_semi").select(F.xxhash64(F.lit(-1), "scope", "item").alias("h")).distinct().limit(MAX_ODD + 1).collect()
        if len(known) > MAX_ODD:
            raise RuntimeError("more items have one hash than chance allows")
        odd = sorted({*odd, *(r["h"] for r in known)})
    else:
        raise RuntimeError("no hash tells the items apart")
    items = items_coded
    hot = items.where(F.col("n_item") * F.lit(float(min_lift)) > F.col("n")).groupBy("scope").agg(F.collect_list("i").alias("hot"))
    coded = held.select("basket", "chunk", "chunks", "scope", F.transform("items", lambda x: code_of(F.col("scope"), x)).alias("c"))
    coded = coded.where("size(c) > 1 or basket is not null").join(hot, "scope", "left_outer")
    coded = coded.select("basket", "chunk", "chunks", "scope", F.sort_array(F.when(F.col("hot").isNull(), F.col("c")).otherwise(F.array_except("c", "hot"))).alias("c"))
    rest = F.slice("c", F.col("k") + 2, F.size("c"))
    within = coded.where("size(c) > 1").select("c", F.posexplode("c").alias("k", "a")).select("a", F.explode(rest).alias("b"))
    counts = within
    # Pairs of chunks, if any basket is that large.
    n_pairs = large.agg(F.sum((F.col("chunks").cast("long") * (F.col("chunks") - 1) / 2).cast("long"))).first()[0]
    if n_pairs:
        counts = within.unionByName(_across(coded.where("basket is not null"), -(-n_pairs // TASK_PAIRS)))
    counted = counts.groupBy("a", "b").agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= min_count)
    first = items.select(F.col("i").alias("a"), "scope", "n", F.col("item").alias("x"), F.col("n_item").alias("n_x"))
    second = items.select(F.col("i").alias("b"), F.col("item").alias("y"), F.col("n_item").alias("n_y"))
    out = counted.join(first, "a").join(second, "b")
    out = out.where(F.col("n_ab") * F.col("n") >= F.lit(float(min_lift)) * F.col("n_x") * F.col("n_y"))
    turned = F.col("x") > F.col("y")
    lift = F.col("n_ab") * F.col("n") / (F.col("n_x") * F.col("n_y"))
    return out.select(
        "scope", F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), "n_ab",
        F.when(turned, F.col("n_y")).otherwise(F.col("n_x")).alias("n_a"), F.when(turned, F.col("n_x")).otherwise(F.col("n_y")).alias("n_b"),
        "n", lift.alias("lift"), F.log2(lift).alias("pmi"),
    )


def _coder(seed: int, odd: list[int]):
    """The code of an item in its scope: a hash, another one for those whose second hash is in ``odd``."""

    def code(scope, item):
        usual = F.xxhash64(F.lit(0), scope, item)
        return F.when(F.xxhash64(F.lit(-1), scope, item).isin(odd), F.xxhash64(F.lit(seed), scope, item)).otherwise(usual) if odd else usual

    return code


def _across(chunks: DataFrame, tasks: int) -> DataFrame:
    """``(a, b)`` for all items of different chunks of one basket: ``chunks(basket, scope, chunk, chunks, c)``.

    Every pair of chunks is a key of its own, and the number of tasks follows that of pairs, as their product is
    far larger than what is shuffled.
    """
    keys = ["basket", "scope", "i", "j"]
    later, earlier = F.sequence(F.col("chunk") + 1, F.col("chunks") - 1), F.sequence(F.lit(0), F.col("chunk") - 1)
    left = chunks.where("chunk < chunks - 1").select("basket", "scope", F.col("chunk").alias("i"), F.explode(later).alias("j"), "c").repartition(tasks, *keys)
    right = chunks.where("chunk > 0").select("basket", "scope", F.explode(earlier).alias("i"), F.col("chunk").alias("j"), F.col("c").alias("d")).repartition(tasks, *keys)
    pairs = left.join(right, keys).select("d", F.explode("c").alias("x")).select("x", F.explode("d").alias("y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def co_change(commit_files: DataFrame, commits: DataFrame, min_count: int = 1, min_lift: float = 0.0, chunk: int = CHUNK) -> DataFrame:
    """``cooccurrence`` of the files changed by the commits of each repository.

    Hashes of commits are compared in lower case, paths in canonical spelling.
    """
    held = commit_files.select(F.unhex(F.trim("commit_sha")).alias("basket"), canonical_path(F.col("file_path")).alias("item"))
    known = commits.select(F.unhex(F.trim("sha")).alias("basket"), F.col("repo").alias("scope"))
    return cooccurrence(held, known, min_count, min_lift, chunk)
