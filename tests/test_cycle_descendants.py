"""Descendants of symbols on and below cycles against a plain walk."""

import random

import pytest

from weftline.operators.hierarchy import all_descendants, hierarchy


@pytest.mark.parametrize("seed", range(2))
def test_walks_until_an_id_repeats(spark, seed):
    rng = random.Random(seed)
    links = {i: rng.choice([None, rng.randrange(90), max(0, i - 1), i]) for i in range(90)}
    # A cycle of seven with a tail of five.
    links |= {100 + i: 100 + (i + 1) % 7 for i in range(7)} | {107 + i: 106 + i for i in range(5)}
    want = set()
    for i in links:
        seen, at = [i], links[i]
        while at is not None and at not in seen:
            want.add((at, i, len(seen)))
            seen.append(at)
            at = links[at]
    tree = hierarchy(spark.createDataFrame(list(links.items()), "id long, parent long"), with_path=True)
    got = [tuple(r) for r in all_descendants(tree).collect()]
    assert set(got) == want and len(got) == len(want)
