"""Budgets, similarity of ranked lists, retention and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_fit(df: DataFrame, group: list[str], order: list, size: str, cap: int, base: int = 0, gap: int = 0) -> DataFrame:
    """The longest prefix of each group, in order, whose sizes with ``gap`` between items and ``base`` stay within ``cap``.

    A null size counts as 0.  A group is one answer to a request, so it is small; rows beyond the cap are cut
    because that is the feature.
    """
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.coalesce(F.col(size), F.lit(0)) + gap).over(w) - gap + base
    return df.withColumn("used", used).where(F.col("used") <= cap)


def jaccard(a, b, empty: float = 0.0):
    """Column: shared share of two arrays taken as sets; ``empty`` if both are."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(empty))


def rbo(s, t, p: float = 0.9, k: int = 10):
    """Column: rank-biased overlap of two arrays of distinct items to depth ``k``, extrapolated; 0 if either is empty.

    The sum of the agreements at depths 1 to ``k``, weighted with ``(1 - p) * p^(d - 1)``, plus the agreement at
    depth ``k`` times ``p^k``.  Shorter lists are compared to depth ``k`` too, as if they went on without matches.
    """
    agree = lambda d: F.size(F.array_intersect(F.slice(s, 1, d), F.slice(t, 1, d))) / d
    total = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda acc, d: acc + (1 - p) * F.pow(F.lit(p), d - 1) * agree(d))
    return F.when((F.size(s) > 0) & (F.size(t) > 0), total + agree(F.lit(k)) * p**k).otherwise(0.0)


def newest(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """Retention: the first ``n`` rows of each group in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The median of each cell, cut to an integer; 0 for a cell without values."""
    return df.groupBy(*by).agg(F.coalesce(F.percentile(value, 0.5).cast("long"), F.lit(0)).alias("median"))


def worst(df: DataFrame, by: list[str], status: str, order: tuple[str, ...] = ("ok", "skipped", "error")) -> DataFrame:
    """The worst status of each group; unknown ones count as the best."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(status)), F.lit(1))
    return df.groupBy(*by).agg(F.max(F.greatest(rank, F.lit(1))).alias("r")).select(*by, F.element_at(F.array(*map(F.lit, order)), F.col("r").cast("int")).alias("status"))
