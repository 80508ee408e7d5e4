"""Queries of the training-data problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.cooccurrence import co_change
from weftline.llm.encode import decode_corpus, encode_corpus
from weftline.llm.funcdocs import code_description_pairs
from weftline.llm.packing import document_sizes, pack
from weftline.llm.spam import spam
from weftline.llm.syntax import checked_files, fault_rates
from weftline.session import cut, table


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code and description of every function whose documentation says something."""
    return code_description_pairs(table(spark, d, "symbols"), table(spark, d, "files"), table(spark, d, "file_contents"), table(spark, d, "lang_map"))


def p2_origins(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs have their documentation from source text and how many from the symbol alone."""
    return p2_pairs(spark, d).groupBy("origin").agg(F.count("*").alias("n_pairs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The symbols of those pairs, by the documentation that the grammars found in the source."""
    return p2_pairs(spark, d).select("id")


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return checked_files(table(spark, d, "files"), table(spark, d, "file_contents"), table(spark, d, "lang_map"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Files whose text isn't valid in the language of their extension."""
    return _checked(spark, d).where("fault is not null").select("file_id")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Invalid files per repository and language."""
    return fault_rates(_checked(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of files changed together at least 5 times and at least 3 times as often as expected."""
    pairs = co_change(table(spark, d, "commit_files"), table(spark, d, "commits"), min_count=5, min_lift=3.0)
    return pairs.select(F.col("scope").alias("repo"), F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"))


def _scored(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.col("scope").alias("repo"), F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"), "n_ab", "n_a", "n_b", "n",
        F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"),
    )


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs that occur together at least twice, with counts and association scores."""
    return _scored(co_change(table(spark, d, "commit_files"), table(spark, d, "commits"), min_count=2))


def p6_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs that occur together at all, with counts and association scores."""
    return _scored(co_change(table(spark, d, "commit_files"), table(spark, d, "commits")))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k."""
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of one that exceeds the capacity, with its container of 2,048 tokens and at most 64 segments."""
    placed = pack(document_sizes(table(spark, d, "documents")), capacity=2048, max_segments=64)
    return placed.select(F.col("key").alias("doc_id"), "part", "container", "start", "tokens", "loss")


def p8_loss_limited(spark: SparkSession, d: str) -> DataFrame:
    """The same with a loss limit below the capacity: 2,048 tokens, 64 segments and 2,032 loss-bearing tokens, which 98 of 100 tokens are."""
    placed = pack(document_sizes(table(spark, d, "documents")), capacity=2048, max_segments=64, max_loss=2032)
    return placed.select(F.col("key").alias("doc_id"), "part", "container", "start", "tokens", "loss")


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    """What holds of ``p8_loss_limited``: every document is placed, no limit is exceeded, only what exceeds one is split."""
    placed = cut(p8_loss_limited(spark, d))
    over = placed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.sum("loss").alias("l")).where("t > 2048 or n > 64 or l > 2032")
    docs = placed.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts"), F.sum("tokens").alias("t"), F.sum("loss").alias("l"), F.max(F.col("start") + F.col("tokens")).alias("end"))
    bad = docs.where("n <> parts or t <> end or (n > 1 and t <= 2048 and l <= 2032)")
    n = lambda df: df.agg(F.count("*")).scalar()
    return docs.agg(F.count("*").alias("n_documents")).select("n_documents", n(over).alias("n_over"), n(bad).alias("n_bad"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """What decoding all token ids gives: documents, characters, and texts that differ from the original."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    back = decode_corpus(p7_ids(spark, d), "doc_id").withColumnRenamed("text", "back")
    wrong = F.count(F.when(~F.coalesce("text", F.lit("")).eqNullSafe(F.col("back")), 1))
    return docs.join(back, "doc_id", "full_outer").agg(F.count("*").alias("n_documents"), F.sum(F.length("back")).alias("n_chars"), wrong.alias("n_wrong"))


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    """The number of checked files per repository and language."""
    return fault_rates(_checked(spark, d)).select("repo", "language", "n_files")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of keywords, links or tags."""
    return spam(table(spark, d, "documents")).where("kind is not null").select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_pairs, p2_origins, p5_found, p5_rates, p6_found, p6_pairs, p6_all_pairs, p5_totals, p7_ids, p7_round_trip, p8_containers, p8_loss_limited, p8_limits, p9_found)}
_HELD = r"""with k as (select distinct lower(trim(sha)) as sha, repo from commits where sha is not null and repo is not null),
h as (select distinct k.repo, k.sha, regexp_replace(regexp_replace(replace(trim(regexp_replace(trim(file_path), '^"|"$', '', 'g')), '\', '/'), '/{2,}', '/', 'g'), '^(\./)+', '') as f
  from commit_files join k on lower(trim(commit_sha)) = k.sha where file_path is not null),
n as (select repo, count(distinct sha) as n from h group by 1), s as (select repo, f, count(*) as c from h group by 1, 2),
p as (select x.repo, x.f as file_a, y.f as file_b, count(*) as n_ab from h x join h y on x.repo = y.repo and x.sha = y.sha and x.f < y.f group by 1, 2, 3),
q as (select p.*, a.c as n_a, b.c as n_b, n.n from p join s a on a.repo = p.repo and a.f = file_a join s b on b.repo = p.repo and b.f = file_b join n on n.repo = p.repo)"""
SQL: dict[str, str] = {
    "p5_totals": r"""select f.s.repo as repo, l.language, count(*) as n_files from (select distinct file_id from file_contents where content is not null) c
        join (select id, min(struct_pack(path := path, repo := repo)) as s from files where path is not null group by 1) f on f.id = c.file_id
        join (select lower(ext) as ext, min(lang) as language from lang_map group by 1) l on l.ext = lower(regexp_extract(f.s.path, '(\.[^./\\]+)$', 1)) group by 1, 2""",
    "p7_round_trip": "select count(*) as n_documents, cast(sum(length(coalesce(text, ''))) as bigint) as n_chars, cast(0 as bigint) as n_wrong from documents",
    "p8_limits": "select count(*) as n_documents, cast(0 as bigint) as n_over, cast(0 as bigint) as n_bad from documents",
    "p6_found": _HELD + " select repo, file_a, file_b from q where n_ab >= 5 and n_ab * n >= 3 * n_a * n_b",
    "p6_pairs": _HELD + " select repo, file_a, file_b, n_ab, n_a, n_b, n, round(n_ab * n / (n_a * n_b), 6) as lift, round(log2(n_ab * n / (n_a * n_b)), 6) as pmi from q where n_ab >= 2",
    "p6_all_pairs": _HELD + " select repo, file_a, file_b, n_ab, n_a, n_b, n, round(n_ab * n / (n_a * n_b), 6) as lift, round(log2(n_ab * n / (n_a * n_b)), 6) as pmi from q",
}
