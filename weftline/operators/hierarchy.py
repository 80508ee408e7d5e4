"""Parent-child rows to full hierarchies: path, depth, root, descendants and cycles.

Level-wise frontier joins run from the roots.  Each round looks ahead several levels: an unreached row
follows its ancestors for up to ``width`` steps inside the set of unreached rows, and the top of that walk
is joined to the frontier, the deepest level reached so far.  A round therefore costs one pass over the rows
that are still unreached, and the set shrinks with every round.  Rows that no round reaches are on a cycle or
lead into one.  Hot parents are spread because the child is the streamed side of every join, where adaptive
execution may split a skewed key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut, drop

#: Levels that the successive rounds look ahead; the last value repeats.
WIDTHS = (1, 2, 6, 24)


def resolve_parents(df: DataFrame, id_col: str, parent_col: str, group_col: str | None = None, key=None, prefix=None) -> DataFrame:
    """One row ``(id, parent)`` per id; ``parent`` is null for roots.

    ``parent_col`` counts if it names an existing id.  Otherwise, if ``group_col``, ``key`` and ``prefix`` are
    given, the parent is the row of the same group whose ``key`` equals this row's ``prefix`` (the smallest id
    if several do).  Rows with a null id are left out, as nothing can name them; of rows that share an id the
    smallest ``(parent, group, key)`` counts, so exact repeats collapse.  Extra columns are ignored.
    """
    named = [F.col(id_col).alias("id"), F.col(parent_col).alias("p")]
    if group_col is not None:
        named += [F.col(group_col).alias("g"), key.alias("k"), prefix.alias("pre")]
    rows = df.select(*named).where("id is not null")
    rest = [c for c in rows.columns if c != "id"]
    rows = rows.groupBy("id").agg(F.min(F.struct(*rest)).alias("s")).select("id", *[F.col(f"s.{c}").alias(c) for c in rest])
    ids = rows.select(F.col("id").alias("pid"))
    linked = rows.where("p is not null").join(ids, F.col("p") == F.col("pid"), "left_outer")
    found = linked.where("pid is not null").select("id", F.col("pid").alias("parent"))
    if group_col is None:
        lost = linked.where("pid is null").select("id", F.lit(None).cast("long").alias("parent"))
        none = rows.where("p is null").select("id", F.lit(None).cast("long").alias("parent"))
        return found.unionByName(lost).unionByName(none)
    open_rows = linked.where("pid is null").select("id", "g", "pre").unionByName(rows.where("p is null").select("id", "g", "pre"))
    # One row per key, so that many rows of one key don't meet many that look for it.
    keys = rows.where("k is not null and g is not null").groupBy(F.col("g").alias("kg"), "k").agg(F.min("id").alias("kid"))
    by_key = (
        open_rows.join(keys, (F.col("g") == F.col("kg")) & (F.col("pre") == F.col("k")), "left_outer")
        .groupBy("id")
        .agg(F.min("kid").alias("parent"))
    )
    return found.unionByName(by_key)


def hierarchy(parents: DataFrame, with_path: bool = False, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Depth, root and cycle of every row of ``parents(id, parent)``, ids unique.

    Returns ``(id, parent, depth, root, cycle)`` and with ``with_path`` also ``path``, the ids from the root
    down to the row.  A root has depth 0 and is its own root.  A row that never reaches a root has null depth,
    root and path, and ``cycle`` is the smallest id on the cycle it is on or leads into; for all others
    ``cycle`` is null.  A row that is its own parent is a cycle of one.  A parent that isn't an id makes its
    children unreachable only if ``resolve_parents`` hasn't been applied; here it counts as no parent.
    """
    spark = parents.sparkSession
    links = cut(parents.select(F.col("id"), F.col("parent")))
    paths = [F.array("id").alias("path")] if with_path else []
    keep = ["id", "parent", "depth", "root"] + (["path"] if with_path else [])
    roots = links.where("parent is null").select("id", "parent", F.lit(0).alias("depth"), F.col("id").alias("root"), *paths)
    levels = [roots]
    frontier, rest, at, turn = roots, links.where("parent is not null"), 0, 0
    while True:
        width = widths[min(turn, len(widths) - 1)]
        step = rest.select("id", F.col("parent").alias("p0"))
        for k in range(1, width):
            hop = rest.select(F.col("id").alias(f"h{k}"), F.col("parent").alias(f"p{k}"))
            step = step.join(hop, F.col(f"p{k - 1}") == F.col(f"h{k}"), "left_outer").drop(f"h{k}")
        chain = F.array_compact(F.array(*[f"p{k}" for k in reversed(range(width))]))
        step = step.select("id", F.col("p0").alias("parent"), chain.alias("chain"))
        reached = frontier.select(F.col("id").alias("fid"), F.col("root").alias("froot"), *([F.col("path").alias("fpath")] if with_path else []))
        step = step.join(reached, F.col("chain")[0] == F.col("fid"), "left_outer").select(
            "id", "parent", F.when(F.col("fid").isNotNull(), F.size("chain") + F.lit(at)).alias("depth"), F.col("froot").alias("root"),
            *([F.concat("fpath", F.expr("slice(chain, 2, size(chain))"), F.array("id")).alias("path")] if with_path else []),
        )
        step = cut(step)
        new = step.where("depth is not null").select(*keep)
        rest = step.where("depth is null").select("id", "parent")
        at += width
        deepest, left = step.agg(F.count(F.when(F.col("depth") == at, 1)), F.count(F.when(F.col("depth").isNull(), 1))).first()
        levels.append(new)
        frontier = new.where(F.col("depth") == at)
        turn += 1
        if not deepest or not left:
            break
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    out = out.withColumn("cycle", F.lit(None).cast("long"))
    if not left:
        return out
    loops = cycles(rest)
    looped = rest.join(loops, "id").select(
        "id", "parent", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("long").alias("root"),
        *([F.lit(None).cast("array<long>").alias("path")] if with_path else []), "cycle",
    )
    return out.unionByName(looped)


def cycles(links: DataFrame) -> DataFrame:
    """``(id, cycle)``: the smallest id on the cycle that each row leads to.

    ``links(id, parent)`` is closed: every parent is an id.  Ids visited again show the cycles: pointers are
    doubled until the set of targets stops shrinking, which leaves exactly the rows on cycles; then the
    smallest id is passed round each cycle by doubling until nothing changes.  Both take a number of rounds
    logarithmic in the longest tail or cycle.
    """
    at = links.select("id", F.col("parent").alias("to"))
    size = -1
    while True:
        now = at.select("to").distinct().count()
        if now == size:
            break
        size = now
        nxt = at.select(F.col("id").alias("to"), F.col("to").alias("far"))
        at, old = cut(at.join(nxt, "to").select("id", F.col("far").alias("to"))), at
        drop(old)
    on = at.select(F.col("to").alias("id")).distinct()
    ring = cut(links.join(on, "id", "left_semi").select("id", F.col("parent").alias("to"), F.least("id", "parent").alias("low")))
    while True:
        nxt = ring.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("low").alias("far_low"))
        low = F.least("low", "far_low")
        ring, old = cut(ring.join(nxt, "to").select("id", F.col("far").alias("to"), low.alias("low"), (low != F.col("low")).alias("new"))), ring
        drop(old)
        if ring.where("new").isEmpty():
            break
    return at.join(ring.select(F.col("id").alias("to"), F.col("low").alias("cycle")), "to").select("id", "cycle")


def descendants(tree: DataFrame) -> DataFrame:
    """``(ancestor, descendant, distance)`` for every pair, from ``hierarchy(with_path=True)``.

    Its size is the sum of all depths.  Rows on or below cycles have no path and give no pairs.
    """
    return tree.where("depth > 0").select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("pos", "ancestor")).where(
        "pos < depth"
    ).select("ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))


def all_descendants(tree: DataFrame) -> DataFrame:
    """``descendants`` and the same for rows on or below cycles, from ``hierarchy(with_path=True)``.

    Above such a row is what a walk over its parents meets until an id repeats, the row itself left out: the
    rows between it and the cycle, and all rows of the cycle.  The distance is that of the first meeting, so
    every pair comes out once.  A row that is its own parent gives no pair with itself.
    """
    # The ancestors nearest to each row, twice as many in each round; a walk is whole once an id repeats.
    at = cut(tree.where("cycle is not null").select("id", F.array("parent").alias("above"), (F.col("id") == F.col("parent")).alias("whole")))
    while not at.where("not whole").isEmpty():
        far = at.select(F.col("id").alias("last"), F.col("above").alias("beyond"), F.col("whole").alias("beyond_whole"))
        step = at.where("not whole").select("id", "above", F.element_at("above", -1).alias("last")).join(far, "last")
        longer = F.concat("above", "beyond")
        seen = F.array_distinct(F.concat(F.array("id"), longer))
        step = step.select("id", F.array_distinct(longer).alias("above"), (F.col("beyond_whole") | (F.size(seen) <= F.size(longer))).alias("whole"))
        at, old = cut(at.where("whole").unionByName(step)), at
        drop(old)
    walked = at.select(F.col("id").alias("descendant"), F.posexplode("above").alias("pos", "ancestor")).where("ancestor <> descendant")
    return descendants(tree).unionByName(walked.select("ancestor", "descendant", (F.col("pos") + F.lit(1)).alias("distance")))


def symbol_path(scip_id):
    """The part of a symbol identifier after its file's ``#``.

    Identifiers read ``scheme package marker-file#path``; the marker before the file may itself be a ``#``.
    """
    return F.regexp_extract(scip_id, r"^\S* [^#]*? .[^#]*#(.*)$", 1)


def symbol_hierarchy(symbols: DataFrame, with_path: bool = False) -> DataFrame:
    """``hierarchy`` of a symbols table: ``parent_id`` first, else the enclosing symbol path of the same file.

    The last name is cut at the last ``#``, ``.`` or ``/``.  A null or malformed ``scip_id`` gives no
    enclosing path, so such a row without a valid ``parent_id`` is a root.
    """
    path = symbol_path(F.col("scip_id"))
    key = F.when(F.length(path) > 0, path)
    prefix = F.regexp_extract(path, r"^(.+)[#./][^#./]*$", 1)
    prefix = F.when(F.length(prefix) > 0, prefix)
    return hierarchy(resolve_parents(symbols, "id", "parent_id", "file_id", key, prefix), with_path)
