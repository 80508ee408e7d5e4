"""The change feed against a plain replay, in any order and any number of repetitions."""

import random

import pytest

from weftline.operators.changefeed import apply_changes, publish_changes
from weftline.sources.snapshots import SnapshotStore

S = "repo string, id string, ts string, op string, args struct<path string, content_hash_before string>, prev_user_version int, content_sha string, ack boolean, extra int"


def entry(path, v, sha=None, op="file_upsert", before=None, repo="r", ts="2026-01-01T00:00:00+0000", ack=None):
    return (repo, f"{path}{v}{sha}", ts, op, (path, before), v, sha, ack, 0)


def state(spark, rows):
    return {(r.repo, r.path): r.content_sha for r in apply_changes(spark.createDataFrame(rows, S)).collect()}


def test_last_version_decides_in_any_order(spark):
    rows = [entry("a", 1, "x"), entry("a", 3, "z"), entry("a", 2, "y"), entry("a", 2, "y", op="FILE_UPDATE"), entry("b", 4, "x"), entry("b", 5, None, "DELETE")]
    for seed in range(3):
        shuffled = rows * 3
        random.Random(seed).shuffle(shuffled)
        assert state(spark, shuffled) == {("r", "a"): "z"}


def test_metadata_leaves_content_and_does_not_revive(spark):
    rows = [entry("a", 1, "x"), entry("a", 2, None, "file_update"), entry("b", 1, "x"), entry("b", 2, None, "file_delete"), entry("b", 3, None, "upsert"), entry("c", 1, "", "upsert")]
    assert state(spark, rows) == {("r", "a"): "x"}


def test_inserted_again_after_deletion(spark):
    assert state(spark, [entry("a", 1, "x"), entry("a", 2, None, "delete"), entry("a", 9, "y", "insert")]) == {("r", "a"): "y"}


def test_same_path_in_two_repositories(spark):
    assert state(spark, [entry("a", 1, "x", repo="p"), entry("a", 1, "y", repo="q")]) == {("p", "a"): "x", ("q", "a"): "y"}


def test_unversioned_entries_take_their_place_by_content(spark):
    middle = [entry("a", 1, "x"), entry("a", None, "y", before="x"), entry("a", 3, "z", before="y")]
    assert state(spark, middle) == {("r", "a"): "z"}
    last = [entry("a", 1, "x"), entry("a", None, "y", before="x"), entry("a", None, "w", before="y"), entry("a", None, "v", before="w")]
    assert state(spark, last[::-1]) == {("r", "a"): "v"}


def test_unversioned_entry_after_a_revert(spark):
    # x comes twice; the versioned change left the first x, so the unversioned one belongs to the second.
    rows = [entry("a", 1, "x"), entry("a", 2, "y", before="x"), entry("a", 3, "x", before="y"), entry("a", None, "q", before="x")]
    assert state(spark, rows) == {("r", "a"): "q"}


def test_unversioned_entry_that_a_deletion_passed(spark):
    rows = [entry("a", 1, "x"), entry("a", None, "y", before="x"), entry("a", 4, None, "delete", before="y")]
    assert state(spark, rows) == {}


def test_unplaceable_entries_rank_below_versions(spark):
    rows = [entry("a", None, "n", before="unknown"), entry("a", 0, "x"), entry("b", None, "p", ts="2026-01-01T00:00:02+0000"), entry("b", None, "o", ts="2026-01-01T00:00:01+0000")]
    assert state(spark, rows) == {("r", "a"): "x", ("r", "b"): "p"}


def test_acks_nulls_and_empty_feed(spark):
    assert state(spark, []) == {}
    rows = [("r", "i", None, None, None, None, None, True, 1), ("r", "j", None, None, (None, None), 1, "x", None, 1), (None, "k", None, "upsert", ("p", None), 1, "x", False, 1), entry("a", 1, "x", op=None)]
    assert state(spark, rows) == {("r", "a"): "x"}


def test_tombstones_are_kept_on_request(spark):
    df = spark.createDataFrame([entry("a", 1, "x"), entry("a", 2, None, "delete")], S)
    assert [(r.path, r.deleted, r.version) for r in apply_changes(df, tombstones=True).collect()] == [("a", True, 2)]


@pytest.mark.parametrize("seed", range(2))
def test_random_histories(spark, seed):
    rng, rows, want = random.Random(seed), [], {}
    for p in range(25):
        path, content, v = f"p{p}", None, 0
        for k in range(rng.randrange(1, 12)):
            v += rng.randrange(1, 4)
            if content is not None and rng.random() < 0.2:
                rows.append(entry(path, v, None, "delete", before=content))
                content = None
            else:
                sha = f"{path}-{k}"
                rows.append(entry(path, v if content is None or rng.random() < 0.8 else None, sha, before=content))
                content = sha
        if content is not None:
            want[("r", path)] = content
    rng.shuffle(rows)
    assert state(spark, rows + rng.sample(rows, len(rows) // 2)) == want


def test_snapshots_are_published_at_once(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), keep=2)
    assert store.current() == 0
    with pytest.raises(FileNotFoundError):
        store.read("a")
    assert store.publish({"a": spark.range(3), "b": spark.range(1)}) == 1
    assert store.publish({"a": spark.range(5)}) == 2
    assert store.read("a").count() == 5 and store.read("a", 1).count() == 3 and store.read("b").count() == 1
    store.publish({"a": spark.range(1)})
    assert store.versions() == [2, 3]


def test_changes_are_published_together(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "feed"))
    assert publish_changes(spark.createDataFrame([entry("a", 1, "x"), entry("b", 1, "y")], S), store) == 1
    assert publish_changes(spark.createDataFrame([entry("a", 1, "x"), entry("a", 2, None, "delete")], S), store) == 2
    assert store.read("files").count() == 0 and sorted(r.path for r in store.read("files", 1).collect()) == ["a", "b"]


@pytest.mark.parametrize("width", [3, 65_536])
def test_slots_against_all_pairs(spark, width, monkeypatch):
    from weftline.operators import changefeed

    monkeypatch.setattr(changefeed, "RANGE", width)
    rng, rows = random.Random(width), []
    for v in range(300):
        path = rng.choice(["a", "b", "c"])
        rows.append(("r", path, v // 2, rng.choice(["x", "y", "z", None]), rng.choice(["x", "y", "z"]), rng.random() < 0.2))
    known = spark.createDataFrame(rows, "repo string, path string, v long, before string, sha string, dead boolean")
    want = {}
    for path in "abc":
        for content in "xyz":
            ins = {v for _, p, v, _, sha, dead in rows if p == path and sha == content and not dead}
            outs = {v for _, p, v, before, _, _ in rows if p == path and before == content}
            still = [v for v in ins if not any(w > v and not any(v < u < w for u in ins) for w in outs)]
            if ins:
                want[path, content] = max(still or ins)
    asked = spark.createDataFrame([("r", p, c) for p in "abcd" for c in "xyz"], "repo string, path string, content string")
    assert {(r.path, r.content): r.v for r in changefeed._slots(known, asked).collect()} == want


def test_a_file_that_goes_to_and_fro(spark):
    n = 100_000
    feed = spark.range(n).selectExpr(
        "'r' as repo", "cast(id as string) as id", "'2026-01-01T00:00:00Z' as ts", "'upsert' as op",
        "named_struct('path', 'a', 'content_hash_before', case when id % 2 = 0 then 'y' else 'x' end) as args",
        "cast(id as int) as prev_user_version", "case when id % 2 = 0 then 'x' else 'y' end as content_sha", "false as ack",
    )
    last = spark.createDataFrame([("r", "z", "2026-01-01T00:00:00Z", "upsert", ("a", "y"), None, "end", False)], "repo string, id string, ts string, op string, args struct<path: string, content_hash_before: string>, prev_user_version int, content_sha string, ack boolean")
    assert [(r.path, r.content_sha) for r in apply_changes(feed.unionByName(last)).collect()] == [("a", "end")]


def test_long_chains_without_versions(spark):
    rows = [entry("a", 1, "c0")] + [entry("a", None, f"c{k + 1}", before=f"c{k}") for k in range(12)]
    assert state(spark, rows) == {("r", "a"): "c12"}
