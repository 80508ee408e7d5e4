"""Queries of the core's large-scale problems: hierarchies, change feeds and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.changefeed import current_files
from weftline.operators.hierarchy import all_descendants, descendants, symbol_hierarchy
from weftline.operators.loglines import log_entries, markers, whole_entries
from weftline.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of depth 3 or more with their root, and symbols that never reach one with the smallest id on their cycle."""
    tree = symbol_hierarchy(table(spark, d, "symbols"))
    return tree.where("depth >= 3 or cycle is not null").select("id", F.coalesce("root", "cycle").alias("root_id"))


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol with depth, root, path of ids and the number of symbols below it."""
    tree = symbol_hierarchy(table(spark, d, "symbols"), with_path=True)
    below = descendants(tree).groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("n_below"))
    return tree.join(below, "id", "left_outer").select(
        "id", F.col("depth").cast("long").alias("depth"), F.col("root").alias("root_id"), F.col("cycle").alias("cycle_id"),
        F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), F.coalesce("n_below", F.lit(0)).alias("n_below"),
    )


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of a symbol and one above it, with their distance."""
    return descendants(symbol_hierarchy(table(spark, d, "symbols"), with_path=True)).withColumn("distance", F.col("distance").cast("long"))


def p1_below(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of a symbol and one above it, those on and below cycles included, with their distance."""
    return all_descendants(symbol_hierarchy(table(spark, d, "symbols"), with_path=True)).withColumn("distance", F.col("distance").cast("long"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol with the number of symbols below it, those on and below cycles included."""
    tree = symbol_hierarchy(table(spark, d, "symbols"), with_path=True)
    below = all_descendants(tree).groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("n_below"))
    return tree.join(below, "id", "left_outer").select("id", F.coalesce("n_below", F.lit(0)).alias("n_below"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The files that exist after all changes, with their last content, as published."""
    return current_files(table(spark, d, "wal_entries"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Entries of all logs with their first and last line, time, level and component."""
    return log_entries(table(spark, d, "log_lines")).select("log_name", "line_no", "last_line", "ts_ms", "level", "component")


def p4_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries with their whole message, the lines below the first included, and the spans that no rule explains."""
    return whole_entries(table(spark, d, "log_lines"))


def p4_markers(spark: SparkSession, d: str) -> DataFrame:
    """Phase markers with phase, status and payload."""
    return markers(log_entries(table(spark, d, "log_lines")))


def p4_phases(spark: SparkSession, d: str) -> DataFrame:
    """Phase markers with phase and status."""
    return p4_markers(spark, d).drop("payload")


def p4_payload(spark: SparkSession, d: str) -> DataFrame:
    """The fields of the payloads of phase markers, one a row."""
    return p4_markers(spark, d).select("log_name", "line_no", F.explode("payload").alias("field", "value"))


# SQL of the same problems. A symbol's parent as TESTDATA states it, then a walk down from the roots; symbols that the
# walk misses follow their parents until nothing new appears.
_PARENTS = r"""with recursive s as (select id, min(file_id) as file_id, min(nullif(regexp_extract(scip_id, '^\S* [^#]*? .[^#]*#(.*)$', 1), '')) as k, min(parent_id) as p from symbols where id is not null group by 1),
a as (select s.id, coalesce(q.id, (select min(t.id) from s t where t.file_id = s.file_id and t.k = nullif(regexp_extract(s.k, '^(.+)[#./][^#./]*$', 1), ''))) as parent from s left join s q on q.id = s.p),
down as (select id, 0 as depth, id as root, cast(id as varchar) as path from a where parent is null union all select a.id, d.depth + 1, d.root, d.path || '/' || cast(a.id as varchar) from a join down d on a.parent = d.id),
lost as (select id, parent from a where id not in (select id from down)), up as (select id, parent as cur from lost union select u.id, l.parent from up u join lost l on l.id = u.cur),
ring as (select id from up where cur = id), cyc as (select u.id, min(u.cur) as cycle from up u where u.cur in (select id from ring) group by 1)"""
# The walk over parents of symbols that the roots don't reach ends before an id repeats.
_BELOW = """, w as (select id, [id, parent] as seen from lost where parent <> id union all select w.id, list_append(w.seen, l.parent) from w join lost l on l.id = w.seen[-1] where not list_contains(w.seen, l.parent)),
    x as (select id, depth, unnest(string_split(path, '/')[:-2]) as a, generate_subscripts(string_split(path, '/')[:-2], 1) - 1 as p from down where depth > 0),
    pairs as (select cast(a as bigint) as ancestor, id as descendant, cast(depth - p as bigint) as distance from x union all select seen[-1], id, cast(len(seen) - 1 as bigint) from w)"""
SQL: dict[str, str] = {
    "p1_found": _PARENTS + " select id, root as root_id from down where depth >= 3 union all select id, cycle from cyc",
    "p1_hierarchy": _PARENTS
    + """, n as (select cast(x as bigint) as id, count(*) - 0 as n from (select unnest(string_split(path, '/')[:-2]) as x from down where depth > 0) group by 1), w as (select id, depth, root, path, null::bigint as cycle from down union all select id, null, null, null, cycle from cyc)
    select w.id, cast(w.depth as bigint) as depth, w.root as root_id, w.cycle as cycle_id, w.path, coalesce(n.n, 0) as n_below from w left join n on n.id = w.id""",
    "p1_descendants": _PARENTS
    + """, x as (select id, depth, unnest(string_split(path, '/')[:-2]) as a, generate_subscripts(string_split(path, '/')[:-2], 1) - 1 as p from down where depth > 0)
    select cast(a as bigint) as ancestor, id as descendant, cast(depth - p as bigint) as distance from x""",
    "p1_below": _PARENTS + _BELOW + " select ancestor, descendant, distance from pairs",
    "p1_counts": _PARENTS + _BELOW + " select a.id, count(p.ancestor) as n_below from a left join pairs p on p.ancestor = a.id group by 1",
    # Entries without a version follow the change that left the content they were made on; chains of them in steps, of which there are as many as such entries at most.
    "p3_found": """with recursive e as (select distinct repo, args.path as path, prev_user_version as v, args.content_hash_before as b, case when lower(op) like '%delete%' then null else content_sha end as sha, lower(op) like '%delete%' as dead
      from wal_entries where not coalesce(ack, false) and args.path is not null and (lower(op) like '%delete%' or content_sha is not null)),
    k as (select *, 0 as s from e where v is not null), n as (select * from e where v is null),
    c as (select repo, path, v, s, sha, dead from k union
      select n.repo, n.path, c.v, c.s + 1, n.sha, n.dead from c join n on n.repo = c.repo and n.path = c.path and n.b = c.sha where c.s < (select count(*) from n)),
    o as (select c.*, exists (select 1 from k x where c.s > 0 and x.repo = c.repo and x.path = c.path and x.b = c.sha and x.v > c.v) as passed from c),
    r as (select repo, path, sha, dead, row_number() over (partition by repo, path order by v desc, s desc, dead, sha desc) as i from o)
    select repo, path, sha as content_sha from r where i = 1 and not dead""",
}
QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p1_below, p1_counts, p3_found, p4_found, p4_entries, p4_markers, p4_phases, p4_payload)}
