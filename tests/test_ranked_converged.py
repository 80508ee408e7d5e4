"""Ranked symbols carry the ranks of PageRank at convergence."""

from collections import Counter

from weftline.plans import catalogue


def test_ranks_are_those_at_convergence(spark, data):
    ranked = Counter(r["rank"] for r in catalogue.QUERIES["ranked_symbols"](spark, data).collect())
    converged = Counter(float(f"{r['rank']:.2e}") for r in catalogue.QUERIES["pagerank"](spark, data).collect())
    assert ranked and not ranked - converged
