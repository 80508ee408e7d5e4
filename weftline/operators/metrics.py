"""Metrics of a history of commits, and roll-ups of findings.

``commits(sha, author, ts, message, repo)``; rows with a null time belong to no session, day or window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: conventional kinds of commits.
TYPE_RX = r"^(feat|fix|docs|refactor|test|chore|perf|style|build|ci)(\([^)]*\))?!?:"


def sessions(commits: DataFrame, by: list[str], gap_minutes: int = 45) -> DataFrame:
    """``(by, session, first, last, n, minutes, class)``: commits with gaps of at most ``gap_minutes``.

    Classes: deep from 50 minutes, medium from 20, else micro.  A group may hold a third of all commits, so rows
    are ordered within days only; one row per day carries the last time and the number of sessions onwards.
    """
    rows = commits.where("ts is not null").withColumn("_day", F.to_date("ts"))
    edge = rows.groupBy(*by, "_day").agg(F.max("ts").alias("_last"))
    over = Window.partitionBy(*by).orderBy("_day")
    edge = edge.select(*by, "_day", F.lag("_last").over(over).alias("_carried"))
    keys = [*by, "_day"]
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    rows = rows.join(edge.select(*named, "_carried"), same, "left_outer").select(*rows.columns, "_carried")
    inner = Window.partitionBy(*by, "_day").orderBy("ts", "sha")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.coalesce(F.lag("ts").over(inner), F.col("_carried")))
    rows = rows.withColumn("_new", F.when(gap.isNull() | (gap > gap_minutes * 60), 1).otherwise(0))
    starts = rows.groupBy(*by, "_day").agg(F.sum("_new").alias("_n"))
    starts = starts.select(*by, "_day", F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows = rows.join(starts.select(*named, "_before"), same, "left_outer").select(*rows.columns, "_before")
    number = F.sum("_new").over(inner.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    out = rows.withColumn("session", number).groupBy(*by, "session").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    minutes = ((F.unix_timestamp("last") - F.unix_timestamp("first")) / 60).cast("long")
    return out.withColumn("minutes", minutes).withColumn("class", F.when(F.col("minutes") >= 50, "deep").when(F.col("minutes") >= 20, "medium").otherwise("micro"))


def streaks(commits: DataFrame, by: list[str]) -> DataFrame:
    """``(by, start, days)``: runs of consecutive days with commits."""
    days = commits.where("ts is not null").select(*by, F.to_date("ts").alias("day")).distinct()
    w = Window.partitionBy(*by).orderBy("day")
    return days.withColumn("island", F.date_sub("day", F.row_number().over(w))).groupBy(*by, "island").agg(F.min("day").alias("start"), F.count("*").alias("days")).drop("island")


def hour_histogram(commits: DataFrame, zone: str = "America/Los_Angeles") -> DataFrame:
    """``(hour, n)`` for all 24 hours of a fixed zone."""
    counts = commits.where("ts is not null").groupBy(F.hour(F.from_utc_timestamp("ts", zone)).alias("hour")).agg(F.count("*").alias("n"))
    hours = commits.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(counts, "hour", "left_outer").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def commit_types(commits: DataFrame, by: list[str]) -> DataFrame:
    """``(by, type, n, share)`` by conventional prefix; other messages, null ones too, are ``other``."""
    kind = F.regexp_extract(F.lower(F.coalesce("message", F.lit(""))), TYPE_RX, 1)
    counts = commits.groupBy(*by, F.when(kind != "", kind).otherwise("other").alias("type")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("share", F.round(F.col("n") / total, 6))


def leaderboard(commits: DataFrame, commit_files: DataFrame, by: list[str]) -> DataFrame:
    """``(by, author, commits, files, top_area)``: the area is the first path part touched most, ties by name.

    ``commit_files(sha, path)``.
    """
    touched = commits.select(*by, "author", "sha").join(commit_files.select("sha", "path"), "sha")
    areas = touched.groupBy(*by, "author", F.substring_index("path", "/", 1).alias("area")).agg(F.count("*").alias("n"))
    top = areas.groupBy(*by, "author").agg(F.min_by("area", F.struct(-F.col("n"), F.col("area"))).alias("top_area"), F.sum("n").alias("files"))
    counts = commits.groupBy(*by, "author").agg(F.count_distinct("sha").alias("commits"))
    return counts.join(top, [*by, "author"], "left_outer").select(*by, "author", "commits", F.coalesce("files", F.lit(0)).alias("files"), "top_area")


def focus(commits: DataFrame, commit_files: DataFrame, by: list[str]) -> DataFrame:
    """``(by, area, score)``: the area touched by most commits and its share of the commits that touch anything."""
    touched = commits.select(*by, "sha").join(commit_files.select("sha", F.substring_index("path", "/", 1).alias("area")), "sha")
    areas = touched.groupBy(*by, "area").agg(F.count_distinct("sha").alias("n"))
    total = touched.groupBy(*by).agg(F.count_distinct("sha").alias("total"))
    best = areas.groupBy(*by).agg(F.min(F.struct(-F.col("n"), F.col("area"))).alias("b"))
    return best.join(total, by).select(*by, F.col("b.area").alias("area"), F.round(-F.col("b.col1") / F.col("total"), 6).alias("score"))


def churn(commits: DataFrame, commit_files: DataFrame, by: list[str], top_n: int = 10, flag: int = 5) -> DataFrame:
    """``(by, path, changes, flagged)``: the ``top_n`` most changed paths of each group."""
    counts = commits.select(*by, "sha").join(commit_files, "sha").groupBy(*by, "path").agg(F.count_distinct("sha").alias("changes"))
    w = Window.partitionBy(*by).orderBy(F.desc("changes"), "path")
    return counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_n).drop("_r").withColumn("flagged", F.col("changes") >= flag)


def size_buckets(sizes: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(by, bucket, n)``: small below 100, medium below 500, large below 1,500, else huge; null is small."""
    v = F.coalesce(F.col(value), F.lit(0))
    bucket = F.when(v < 100, "small").when(v < 500, "medium").when(v < 1500, "large").otherwise("huge")
    return sizes.groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def weekly_trend(commits: DataFrame, by: list[str]) -> DataFrame:
    """``(by, week, n, delta)``: commits per week and the change against the week with commits before."""
    weeks = commits.where("ts is not null").groupBy(*by, F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count("*").alias("n"))
    return weeks.withColumn("delta", F.col("n") - F.lag("n").over(Window.partitionBy(*by).orderBy("week")))


def complexity(scope, arch, risk, deps, uncertainty, trigger):
    """Column: the weighted score of five parts from 0 to 100; a trigger lifts it to at least 80."""
    score = 0.25 * scope + 0.25 * arch + 0.2 * risk + 0.15 * deps + 0.15 * uncertainty
    return F.when(trigger, F.greatest(score, F.lit(80.0))).otherwise(score)


def band(score):
    """Column: low below 30, medium below 60, high below 80, else critical."""
    return F.when(score < 30, "low").when(score < 60, "medium").when(score < 80, "high").otherwise("critical")


def impact(callers):
    """Column: the risk of a change by the number of callers."""
    return F.when(callers <= 2, "LOW").when(callers <= 5, "MEDIUM").otherwise("HIGH")


def severity_rollup(findings: DataFrame, by: str, levels: tuple[str, ...] = ("CRITICAL", "HIGH", "MEDIUM", "LOW")) -> DataFrame:
    """``(by, level columns, verdict)`` per group and a row TOTAL; unknown severities count as HIGH.

    FAIL with a critical finding, else WARN with a high one, else PASS.
    """
    known = F.when(F.upper("severity").isin(*levels), F.upper("severity")).otherwise("HIGH")
    sums = [F.count(F.when(known == x, 1)).alias(x.lower()) for x in levels]
    rows = findings.rollup(by).agg(*sums, F.grouping(by).alias("g"))
    verdict = F.when(F.col("critical") > 0, "FAIL").when(F.col("high") > 0, "WARN").otherwise("PASS")
    return rows.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col(by)).alias(by), *[x.lower() for x in levels], verdict.alias("verdict"))


def tdd_sequence(commits: DataFrame, commit_files: DataFrame, by: list[str], is_test: str = r"(^|/)test_") -> DataFrame:
    """``(by, verdict)``: PASS if tests were touched no later than other code, FAIL if later or never, WAIVED without code."""
    touched = commits.select(*by, "sha", "ts").join(commit_files, "sha")
    test = F.col("path").rlike(is_test)
    rows = touched.groupBy(*by).agg(F.min(F.when(test, F.col("ts"))).alias("t"), F.min(F.when(~test, F.col("ts"))).alias("s"))
    return rows.select(*by, F.when(F.col("s").isNull(), "WAIVED").when(F.col("t") <= F.col("s"), "PASS").otherwise("FAIL").alias("verdict"))


def turn_cap(pending):
    """Column: ``max(4, ceil(min(1.5 n, 30)))``; null for a negative number."""
    return F.when(pending >= 0, F.greatest(F.lit(4), F.ceil(F.least(pending * 1.5, F.lit(30.0)))).cast("int"))
