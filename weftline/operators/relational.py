"""Queries over files, symbols, edges and commits.

Relations: ``files(id, path, lang)``, ``symbols(id, file_id, name, kind, line, signature)``, ``edges(src, dst,
kind)``, ``commits(sha, author, ts, message)``, ``commit_files(sha, file_id)``, ``ownership(file_id, author,
line_count)``.  Rows with a null key join to nothing.  Results aren't sorted unless a limit is part of the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.graph import file_in_degree, reach

#: Fixed value: the kinds of symbols that can be called.
CALLABLE = ("function", "method", "async_function", "async_method")


def symbol_info(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``(id, name, kind, file, line)`` of every symbol of a known file."""
    return symbols.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file")), "file_id").select("id", "name", "kind", "file", "line")


def who_calls(symbols: DataFrame, files: DataFrame, edges: DataFrame, name: str, max_depth: int = 3) -> DataFrame:
    """All symbols that reach any symbol of that name by at most ``max_depth`` calls."""
    hits = reach(edges.where("kind = 'call'"), symbols.where(F.col("name") == name), max_depth, upstream=True)
    return symbol_info(symbols, files).join(hits.select("id"), "id", "left_semi")


def blast_radius(symbols: DataFrame, files: DataFrame, edges: DataFrame, name: str, max_depth: int = 3) -> DataFrame:
    """All symbols that any symbol of that name reaches by at most ``max_depth`` calls."""
    hits = reach(edges.where("kind = 'call'"), symbols.where(F.col("name") == name), max_depth)
    return symbol_info(symbols, files).join(hits.select("id"), "id", "left_semi")


def dead_code(symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """Callable symbols without an incoming call."""
    called = edges.where("kind = 'call' and dst is not null").select(F.col("dst").alias("id"))
    return symbol_info(symbols.where(F.col("kind").isin(*CALLABLE)), files).join(called, "id", "left_anti")


def search_symbols(symbols: DataFrame, files: DataFrame, query: str, like_compat: bool = False) -> DataFrame:
    """Symbols whose name contains ``query`` without regard to case, with ``rank`` 0 exact, 1 prefix, 2 inside.

    The exact test minds case.  With ``like_compat`` an underscore stands for any character.
    """
    q = query.lower()
    low = F.lower("name")
    inside, prefix = (F.col("name").ilike(f"%{query}%"), F.col("name").ilike(f"{query}%")) if like_compat else (low.contains(q), low.startswith(q))
    return symbol_info(symbols, files).where(inside).withColumn("rank", F.when(F.col("name") == query, 0).when(prefix, 1).otherwise(2))


def file_summary(symbols: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """The symbols of one file with their signatures."""
    return symbols.join(files.where(F.col("path") == path).select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id", "name", "kind", "line", "signature")


def hot_spots(files: DataFrame, symbols: DataFrame, commits: DataFrame, commit_files: DataFrame, now, window_days: int = 90, top_n: int = 10) -> DataFrame:
    """The ``top_n`` files by commits within the window times callable symbols; ties go to the smaller path."""
    recent = commits.where(F.col("ts") >= F.expr(f"timestamp '{now}' - interval {int(window_days)} days"))
    touched = commit_files.join(recent.select("sha"), "sha", "left_semi").groupBy("file_id").agg(F.count_distinct("sha").alias("commits_in_window"))
    sizes = symbols.where(F.col("kind").isin(*CALLABLE)).groupBy("file_id").agg(F.count("*").alias("function_count"))
    scored = touched.join(sizes, "file_id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    scored = scored.select("path", "commits_in_window", "function_count", (F.col("commits_in_window") * F.col("function_count")).alias("score"))
    return scored.orderBy(F.desc("score"), "path").limit(top_n)


def co_changes(files: DataFrame, symbols: DataFrame, edges: DataFrame, commit_files: DataFrame, path: str, threshold: int = 3, exclude: tuple[str, ...] = (), top_n: int = 50) -> DataFrame:
    """Files in at least ``threshold`` commits with ``path`` that no edge links with it in either direction."""
    target = files.where(F.col("path") == path).select(F.col("id").alias("file_id"))
    shared = commit_files.join(target, "file_id", "left_semi").select("sha").distinct()
    counts = commit_files.join(shared, "sha", "left_semi").join(target, "file_id", "left_anti").groupBy("file_id").agg(F.count_distinct("sha").alias("n")).where(F.col("n") >= threshold)
    owner = symbols.select("id", "file_id")
    ends = edges.where("src is not null and dst is not null").join(owner.select(F.col("id").alias("src"), F.col("file_id").alias("f_src")), "src").join(owner.select(F.col("id").alias("dst"), F.col("file_id").alias("f_dst")), "dst")
    links = ends.select("f_src", "f_dst").distinct()
    linked = links.join(target.withColumnRenamed("file_id", "f_src"), "f_src", "left_semi").select(F.col("f_dst").alias("file_id")).union(links.join(target.withColumnRenamed("file_id", "f_dst"), "f_dst", "left_semi").select("f_src"))
    out = counts.join(linked.distinct(), "file_id", "left_anti").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    if exclude:
        out = out.where(~F.col("path").isin(*exclude))
    return out.select("path", F.col("n").alias("shared_commits")).orderBy(F.desc("shared_commits"), "path").limit(top_n)


def owners(ownership: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """``(author, line_count, percentage)`` of a file, or of a directory if ``path`` ends with a slash."""
    chosen = files.where(F.col("path").startswith(path) if path.endswith("/") else F.col("path") == path).select(F.col("id").alias("file_id"))
    sums = ownership.join(chosen, "file_id", "left_semi").groupBy("author").agg(F.sum("line_count").alias("line_count"))
    # The total is a scalar subquery, instead of a window over everything in one task.
    total = sums.agg(F.sum("line_count")).scalar()
    return sums.withColumn("total", total).select("author", "line_count", F.when(F.col("total") > 0, F.col("line_count") / F.col("total") * 100).otherwise(0.0).alias("percentage"))


def symbol_history(symbols: DataFrame, files: DataFrame, commits: DataFrame, commit_files: DataFrame, name: str) -> DataFrame:
    """Per file that holds a symbol of that name: changes, first and last commit and the authors in order."""
    held = symbols.where(F.col("name") == name).select("file_id").distinct()
    rows = commit_files.join(held, "file_id", "left_semi").join(commits, "sha").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return rows.groupBy("path").agg(
        F.count_distinct("sha").alias("changes"), F.min_by("sha", F.struct("ts", "sha")).alias("first_sha"), F.max_by("sha", F.struct("ts", "sha")).alias("last_sha"),
        F.array_join(F.transform(F.array_sort(F.collect_set("author")), lambda a: a.cast("string")), ",").alias("authors"),
    )


def layers(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, in_degree, layer)``: the most used third of the files is core, the least used periphery, the rest middle.

    A third is rounded down but at least one file; a single file is periphery.  Ties go by path.
    """
    degree = file_in_degree(edges, symbols, files)
    n = degree.count()
    third = max(1, n // 3)
    # Ranks over all files: they are few against edges, but sorting them is still spread over tasks.
    ranked = rank_all(degree.select("path", "in_degree"), [F.desc("in_degree"), F.asc("path")], "pos")
    layer = F.when(F.col("pos") > n - third, "periphery").when(F.col("pos") <= third, "core").otherwise("middle")
    return ranked.select("path", "in_degree", layer.alias("layer"))


def rank_all(df: DataFrame, order: list, name: str) -> DataFrame:
    """Number all rows from 1 in the given order without bringing them into one task.

    Rows are range partitioned and numbered within their partition; the sizes of the partitions, one row each,
    give the offsets.
    """
    from weftline.session import cut

    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_part").orderBy(*order)
    return placed.withColumn("_row", F.row_number().over(inner)).join(before, "_part").withColumn(name, F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")


def status_counts(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with the numbers of files, symbols, resolved and unresolved edges."""
    e = edges.agg(F.count("*").alias("edges"), F.count("dst").alias("resolved")).withColumn("unresolved", F.col("edges") - F.col("resolved"))
    n = lambda df: df.agg(F.count("*")).scalar()
    return e.select(n(files).alias("files"), n(symbols).alias("symbols"), "edges", "resolved", "unresolved")


def resolve_imports(imports: DataFrame, modules: DataFrame, prefixes: tuple[str, ...] = ("src.", "scripts.", "lib.", "app.")) -> DataFrame:
    """``(source, import, target, strategy)``: the module that each import names, by the first strategy that hits.

    Strategies: the name itself, relative to the source's package, behind a fixed prefix, as the ending of a
    longer name (then the smallest).  A module doesn't import itself; what isn't found has a null target.
    ``imports(source, import)``, ``modules(module)``; both may have ``scope``, within which names hold, and
    ``file``, as a file with two names doesn't import itself either.  ``scope`` and ``file`` of the import come out too.
    """
    extra = [c for c in ("scope", "file") if c in imports.columns]
    scope = lambda df: df["scope"] if "scope" in df.columns else F.lit("")
    file = lambda df, name: df["file"] if "file" in df.columns else df[name]
    m = modules.select(scope(modules).alias("scope"), F.col("module").alias("target"), file(modules, "module").alias("holder")).distinct()
    rows = imports.select(scope(imports).alias("scope"), file(imports, "source").alias("file"), "source", "import").distinct()
    keys = ["scope", "file", "source", "import"]
    package = F.regexp_extract("source", r"^(.*)\.[^.]*$", 1)
    guess = lambda strategy, target: F.struct(F.lit(strategy).alias("strategy"), target.alias("target"))
    guesses = [guess(1, F.col("import")), guess(2, F.when(package != "", F.concat_ws(".", package, F.col("import")))), *[guess(3, F.concat(F.lit(p), F.col("import"))) for p in prefixes]]
    exact = rows.select(*keys, F.explode(F.array(*guesses)).alias("g")).select(*keys, "g.*").join(m, ["scope", "target"]).select(*keys, "target", "strategy", "holder")
    # Every ending of a module name after a dot, so that the last strategy is an equality join too.  Of the names
    # with one ending only the two smallest of different files are kept: the second where the first is the source.
    ends = m.select("scope", "target", "holder", F.explode(F.expr("transform(sequence(2, greatest(size(split(target, '[.]')), 2)), i -> array_join(slice(split(target, '[.]'), i, size(split(target, '[.]'))), '.'))")).alias("import")).where("import <> ''")
    ends = ends.groupBy("scope", "import", "holder").agg(F.min("target").alias("target"))
    nearest = Window.partitionBy("scope", "import").orderBy("target", "holder")
    ends = ends.withColumn("k", F.row_number().over(nearest)).where("k <= 2").drop("k")
    suffix = rows.join(ends, ["scope", "import"]).select(*keys, "target", F.lit(4).alias("strategy"), "holder")
    best = exact.union(suffix).where("holder <> file").groupBy(*keys).agg(F.min(F.struct("strategy", "target")).alias("b"))
    return rows.join(best, keys, "left_outer").select(*extra, "source", "import", F.col("b.target").alias("target"), F.col("b.strategy").alias("strategy"))


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(src, dst, unresolved)``: one edge per symbol of that name in the target file, else one unresolved row.

    ``calls(src, target_file, callee)``.
    """
    named = symbols.select(F.col("file_id").alias("target_file"), F.col("name").alias("callee"), F.col("id").alias("dst"))
    return calls.join(named, ["target_file", "callee"], "left_outer").select("src", "dst", F.when(F.col("dst").isNull(), F.col("callee")).alias("unresolved"))


def innermost_container(spans: DataFrame, width: int = 256) -> DataFrame:
    """``(id, container)``: of every span the innermost other span of its group that contains it and starts before it.

    ``spans(id, grp, start, stop, holds)``; only spans with ``holds`` contain others.  The one that starts last,
    then ends first, then has the smallest id counts; null where there is none.

    A container covers the start of what it contains, so containers are listed under every stretch of ``width``
    that they touch and the join is on group and stretch; a large group isn't compared as a whole.
    """
    a = spans.select("id", "grp", "start", "stop", F.floor(F.col("start") / width).alias("bin"))
    b = spans.where("holds and start <= stop").select(
        F.col("id").alias("cid"), "grp", F.col("start").alias("cs"), F.col("stop").alias("ce"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))).alias("bin")
    )
    inside = a.join(b, ["grp", "bin"]).where("cs < start and stop <= ce")
    best = inside.groupBy("id").agg(F.min(F.struct(-F.col("cs"), "ce", "cid")).alias("b"))
    return a.select("id").join(best, "id", "left_outer").select("id", F.col("b.cid").alias("container"))
