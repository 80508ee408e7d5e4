"""Queries over the history of commits, the change feed and logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.paths import canonical_path
from weftline.operators import diff, evidence, metrics, ranking
from weftline.session import table

QUERIES, SQL = {}, {}
# The same cleaning in SQL: commits once each, paths in canonical spelling.
PATH_SQL = r"""regexp_replace(regexp_replace(replace(trim(regexp_replace(trim(file_path), '^"|"$', '', 'g')), '\', '/'), '/{2,}', '/', 'g'), '^(\./)+', '')"""
H = f"""with h as (select lower(trim(sha)) as sha, min(repo) as repo, min(lower(author_email)) as author, min(epoch_ms(author_time * 1000)) as ts, min(message) as message from commits where sha is not null group by 1),
hf as (select distinct lower(trim(commit_sha)) as sha, {PATH_SQL} as path from commit_files)"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def history(spark: SparkSession, d: str) -> DataFrame:
    """``(sha, repo, author, ts, message)``, one row per commit; of conflicting repeats the smallest values count."""
    c = table(spark, d, "commits").where("sha is not null")
    return c.groupBy(F.lower(F.trim("sha")).alias("sha")).agg(
        F.min("repo").alias("repo"), F.min(F.lower("author_email")).alias("author"), F.min(F.timestamp_seconds("author_time")).alias("ts"), F.min("message").alias("message")
    )


def history_files(spark: SparkSession, d: str) -> DataFrame:
    """``(sha, path)``, once each, in canonical spelling."""
    return table(spark, d, "commit_files").select(F.lower(F.trim("commit_sha")).alias("sha"), canonical_path(F.col("file_path")).alias("path")).distinct()


@query(
    H
    + """, g as (select *, case when date_diff('second', lag(ts) over w, ts) <= 2700 then 0 else 1 end n from h where ts is not null window w as (partition by repo order by ts, sha)),
    z as (select *, sum(n) over (partition by repo order by ts, sha rows unbounded preceding) s from g)
    select repo, cast(s as bigint) as session, count(*) as n, date_diff('second', min(ts), max(ts)) // 60 as minutes,
    case when date_diff('second', min(ts), max(ts)) // 60 >= 50 then 'deep' when date_diff('second', min(ts), max(ts)) // 60 >= 20 then 'medium' else 'micro' end as class from z group by 1, 2"""
)
def sessions(spark, d) -> DataFrame:
    """Working sessions of each repository."""
    return metrics.sessions(history(spark, d), ["repo"]).select("repo", "session", "n", "minutes", "class")


@query(
    H
    + """, x as (select distinct author, cast(ts as date) d from h where ts is not null), y as (select *, d - cast(row_number() over (partition by author order by d) as integer) i from x)
    select author, min(d) as start, count(*) as days from y group by author, i"""
)
def streaks(spark, d) -> DataFrame:
    """Runs of consecutive days with commits of each author."""
    return metrics.streaks(history(spark, d), ["author"])


@query(
    H
    + """, c as (select cast(hour(timezone('America/Los_Angeles', timezone('UTC', ts))) as integer) as "hour", count(*) n from h where ts is not null group by 1)
    select cast(r as integer) as "hour", coalesce(n, 0) as n from range(24) t(r) left join c on c."hour" = r"""
)
def hour_hist(spark, d) -> DataFrame:
    """Commits by hour of the day in a fixed zone."""
    return metrics.hour_histogram(history(spark, d))


@query(
    H
    + r""", k as (select repo, coalesce(nullif(regexp_extract(lower(coalesce(message, '')), '^(feat|fix|docs|refactor|test|chore|perf|style|build|ci)(\([^)]*\))?!?:', 1), ''), 'other') as type, count(*) n from h group by 1, 2)
    select repo, type, n, round(n / sum(n) over (partition by repo), 6) as share from k"""
)
def type_mix(spark, d) -> DataFrame:
    """Kinds of commits of each repository."""
    return metrics.commit_types(history(spark, d), ["repo"])


@query(
    H
    + """, a as (select repo, author, split_part(path, '/', 1) area, count(*) n from h join hf using (sha) where path is not null or path is null group by 1, 2, 3),
    t as (select repo, author, arg_min(area, (-n, area)) top_area, cast(sum(n) as bigint) files from a group by 1, 2), c as (select repo, author, count(distinct sha) commits from h group by 1, 2)
    select c.repo, c.author, c.commits, coalesce(t.files, 0) as files, t.top_area from c left join t on t.repo = c.repo and t.author = c.author"""
)
def leaderboard(spark, d) -> DataFrame:
    """Authors of each repository with commits, files and the area they touch most."""
    return metrics.leaderboard(history(spark, d), history_files(spark, d), ["repo"])


@query(
    H
    + """, a as (select repo, split_part(path, '/', 1) area, count(distinct sha) n from h join hf using (sha) group by 1, 2), t as (select repo, count(distinct sha) total from h join hf using (sha) group by 1),
    b as (select repo, arg_min(area, (-n, area)) area, max(n) n from a group by 1) select repo, area, round(n / total, 6) as score from b join t using (repo)"""
)
def focus_score(spark, d) -> DataFrame:
    """The area that most commits of a repository touch, with its share."""
    return metrics.focus(history(spark, d), history_files(spark, d), ["repo"])


@query(
    H
    + """, c as (select repo, path, count(distinct sha) changes from h join hf using (sha) group by 1, 2), r as (select *, row_number() over (partition by repo order by changes desc, path) p from c)
    select repo, path, changes, changes >= 5 as flagged from r where p <= 10"""
)
def churn(spark, d) -> DataFrame:
    """The ten most changed files of each repository."""
    return metrics.churn(history(spark, d), history_files(spark, d), ["repo"])


@query(
    "with s as (select id, min(repo) repo, min(size) size from files where id is not null group by 1) select repo, case when coalesce(size, 0) < 100 then 'small' when size < 500 then 'medium' when size < 1500 then 'large' else 'huge' end as bucket, count(*) as n from s group by 1, 2"
)
def size_buckets(spark, d) -> DataFrame:
    """Files of each repository by size."""
    once = table(spark, d, "files").where("id is not null").groupBy("id").agg(F.min("repo").alias("repo"), F.min("size").alias("size"))
    return metrics.size_buckets(once, ["repo"], "size")


@query(
    H
    + """, w as (select repo, cast(date_trunc('week', ts) as date) as week, count(*) n from h where ts is not null group by 1, 2)
    select repo, week, n, n - lag(n) over (partition by repo order by week) as delta from w"""
)
def trend(spark, d) -> DataFrame:
    """Commits per week with the change against the week before."""
    return metrics.weekly_trend(history(spark, d), ["repo"])


@query(
    H
    + r""", t as (select repo, author, min(case when regexp_matches(path, '(^|/)test_') then ts end) t, min(case when not regexp_matches(path, '(^|/)test_') then ts end) s from h join hf using (sha) group by 1, 2)
    select repo, author, case when s is null then 'WAIVED' when t <= s then 'PASS' else 'FAIL' end as verdict from t"""
)
def tdd_sequence(spark, d) -> DataFrame:
    """Whether each author touched tests no later than other code."""
    return metrics.tdd_sequence(history(spark, d), history_files(spark, d), ["repo", "author"])


@query(
    H
    + """, s as (select sha, 5.0 * least(count(*), 20) scope, 10.0 * least(count(distinct split_part(path, '/', 1)), 10) arch, max(case when path = 'VERSION' then 1 else 0 end) trig from hf group by 1),
    z as (select sha, 0.25 * scope + 0.25 * arch + 0.2 * scope + 0.15 * arch + 0.15 * scope as s0, trig from s), y as (select sha, case when trig = 1 then greatest(s0, 80.0) else s0 end as score from z)
    select sha, round(score, 6) as score, case when score < 30 then 'low' when score < 60 then 'medium' when score < 80 then 'high' else 'critical' end as band from y"""
)
def complexity(spark, d) -> DataFrame:
    """A score of every commit by its breadth."""
    rows = history_files(spark, d).groupBy("sha").agg(
        (5.0 * F.least(F.count("*"), F.lit(20))).alias("scope"), (10.0 * F.least(F.count_distinct(F.substring_index("path", "/", 1)), F.lit(10))).alias("arch"), F.max((F.col("path") == "VERSION").cast("int")).alias("trig")
    )
    score = metrics.complexity(F.col("scope"), F.col("arch"), F.col("scope"), F.col("arch"), F.col("scope"), F.col("trig") == 1)
    return rows.withColumn("score", score).select("sha", F.round("score", 6).alias("score"), metrics.band(F.col("score")).alias("band"))


@query(
    "with i as (select id, count(*) n from wal_entries where not coalesce(ack, false) and id is not null group by 1), a as (select distinct id from wal_entries where ack and id is not null) "
    "select count(*) as intents, count(a.id) as acked, count(*) - count(a.id) as unacked, cast(coalesce(sum(n - 1), 0) as bigint) as repeated from i left join a using (id)"
)
def wal_replay(spark, d) -> DataFrame:
    """How far the journal was acknowledged and repeated."""
    return diff.replay_stats(table(spark, d, "wal_entries"))


_NEW = "select concat(repo, '/', args.path) as path, {pick} as hash from {wal} where not coalesce(ack, false) and prev_user_version is not null and content_sha is not null group by 1"


@query(
    """with o as (select concat(repo, '/', path) as path, min(content_hash) as hash from files where path is not null group by 1),
    n as (select concat(repo, '/', args.path) as path, arg_max(content_sha, prev_user_version) as hash from wal_entries where not coalesce(ack, false) and prev_user_version is not null and content_sha is not null group by 1),
    g as (select o.path, o.hash, row_number() over (partition by o.hash order by o.path) k from o anti join n on n.path = o.path), c as (select n.path, n.hash, row_number() over (partition by n.hash order by n.path) k from n anti join o on n.path = o.path)
    select o.path, case when o.hash = n.hash then 'unchanged' else 'dirty' end as change, null::varchar as moved_from from o join n using (path) union all
    select coalesce(c.path, g.path), case when c.path is null then 'deleted' when g.path is null then 'new' else 'moved' end, case when c.path is not null then g.path end from c full join g on c.hash = g.hash and c.k = g.k"""
)
def dirty_classify(spark, d) -> DataFrame:
    """Files of the index against those of the feed, by hash."""
    old = table(spark, d, "files").where("path is not null").groupBy(F.concat("repo", F.lit("/"), "path").alias("path")).agg(F.min("content_hash").alias("hash"))
    new = spark.sql(_NEW.replace("{pick}", "max_by(content_sha, prev_user_version)"), wal=table(spark, d, "wal_entries"))
    return diff.classify_files(old, new)


@query(
    H
    + """, r as (select repo, path, count(distinct sha) n from h join hf using (sha) group by 1, 2), p as (select repo, path, row_number() over (partition by repo order by n desc, path) k from r)
    select repo, path from p where k <= 20"""
)
def retention_top_n(spark, d) -> DataFrame:
    """The twenty most changed files of each repository."""
    counts = history(spark, d).select("sha", "repo").join(history_files(spark, d), "sha").groupBy("repo", "path").agg(F.count_distinct("sha").alias("n"))
    return ranking.newest(counts, ["repo"], [F.desc("n"), F.asc("path")], 20).select("repo", "path")


_LISTS = (
    H
    + """, q as (select repo, regexp_extract(coalesce(path, ''), '[^/]*$') as leaf, count(distinct sha) n from h join hf using (sha) group by 1, 2), p as (select repo, leaf, row_number() over (partition by repo order by n desc, leaf) k from q),
    l as (select repo, list(leaf order by k) x from p where k <= 10 group by 1), pairs as (select a.repo as repo_a, b.repo as repo_b, a.x as s, b.x as t from l a join l b on a.repo < b.repo)"""
)


def _ranked(spark, d) -> DataFrame:
    """Per repository its ten most changed file names, and every pair of repositories; repositories are few."""
    leaf = F.regexp_extract(F.coalesce("path", F.lit("")), r"[^/]*$", 0).alias("leaf")
    counts = history(spark, d).select("sha", "repo").join(history_files(spark, d), "sha").groupBy("repo", leaf).agg(F.count_distinct("sha").alias("n"))
    # Ten rows per repository are chosen before they are put together.
    first = Window.partitionBy("repo").orderBy(F.desc("n"), "leaf")
    counts = counts.withColumn("k", F.row_number().over(first)).where("k <= 10")
    top = counts.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("k", "leaf"))).alias("x"))
    lists = top.select("repo", F.transform("x", lambda v: v["leaf"]).alias("x"))
    other = lists.select(F.col("repo").alias("repo_b"), F.col("x").alias("t"))
    return lists.select(F.col("repo").alias("repo_a"), F.col("x").alias("s")).join(other, F.col("repo_a") < F.col("repo_b"))


@query(_LISTS + " select repo_a, repo_b, round(len(list_intersect(s, t)) / len(list_distinct(list_concat(s, t))), 6) as jaccard from pairs")
def jaccard_pairs(spark, d) -> DataFrame:
    """Similarity of repositories by their most changed file names."""
    return _ranked(spark, d).select("repo_a", "repo_b", F.round(ranking.jaccard(F.col("s"), F.col("t")), 6).alias("jaccard"))


@query(
    _LISTS
    + " select repo_a, repo_b, round(list_sum(list_transform(range(1, 11), lambda i: 0.1 * pow(0.9, i - 1) * len(list_intersect(s[1:i], t[1:i])) / i)) + len(list_intersect(s[1:10], t[1:10])) / 10 * pow(0.9, 10), 6) as rbo from pairs"
)
def rbo_pairs(spark, d) -> DataFrame:
    """Overlap of the same lists, weighted towards the top."""
    return _ranked(spark, d).select("repo_a", "repo_b", F.round(ranking.rbo(F.col("s"), F.col("t")), 6).alias("rbo"))


@query("select repo, coalesce(cast(trunc(median(files_indexed)) as bigint), 0) as median from build_stats group by 1")
def bench_median(spark, d) -> DataFrame:
    """The median number of files indexed per repository."""
    return ranking.medians(table(spark, d, "build_stats"), ["repo"], "files_indexed")


@query("select log_name, case when max(case status when 'SKIPPED' then 2 else 1 end) = 2 then 'SKIPPED' else 'DONE' end as status from markers group by 1")
def status_fold(spark, d) -> DataFrame:
    """The worst status of each log's markers."""
    return ranking.worst(table(spark, d, "markers"), ["log_name"], "status", ("DONE", "SKIPPED"))


@query(
    """with l as (select log_name, phase_id, arg_max(status, (ts, status)) s, coalesce(arg_max(coalesce(payload['reason'], ''), (ts, status)), '') r from markers group by 1, 2),
    x as (select a.log_name, p.phase_id, coalesce(l.s, 'absent') as marker_status, l.r from (select distinct log_name from markers) a cross join (select phase_id from phase_ids where required) p left join l on l.log_name = a.log_name and l.phase_id = p.phase_id)
    select log_name, phase_id, marker_status, case when marker_status = 'absent' then 'no_marker' when marker_status = 'SKIPPED' and coalesce(r, '') = '' then 'skipped_without_reason' end as warning from x"""
)
def correlate(spark, d) -> DataFrame:
    """Required phases of each log, with what is missing."""
    m = table(spark, d, "markers").select("log_name", F.struct("ts", "status").alias("line_no"), "phase_id", "status", "payload")
    return evidence.correlate(m, table(spark, d, "phase_ids"))


@query(
    """with f as (select s_nationkey as agent, case when l_quantity >= 45 then 'critical' when l_quantity >= 30 then 'HIGH' when l_quantity >= 15 then 'medium' when l_quantity >= 5 then 'low' else '?' end as sev from lineitem join supplier on s_suppkey = l_suppkey),
    g as (select cast(agent as varchar) as agent, upper(case when sev = '?' then 'HIGH' else sev end) as s from f), r as (select coalesce(agent, 'TOTAL') as agent, count(*) filter (s = 'CRITICAL') as critical, count(*) filter (s = 'HIGH') as high, count(*) filter (s = 'MEDIUM') as medium, count(*) filter (s = 'LOW') as low from g group by rollup (agent))
    select *, case when critical > 0 then 'FAIL' when high > 0 then 'WARN' else 'PASS' end as verdict from r"""
)
def severity_rollup(spark, d) -> DataFrame:
    """Findings by agent and severity with a total."""
    q = F.col("l_quantity")
    sev = F.when(q >= 45, "critical").when(q >= 30, "HIGH").when(q >= 15, "medium").when(q >= 5, "low").otherwise("?")
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").cast("string").alias("agent"), sev.alias("severity"))
    return metrics.severity_rollup(rows, "agent")


@query(
    """with o as (select o_custkey, o_orderdate as ts, max(o_totalprice) as price from orders group by 1, 2), e as (select distinct user_id, ts from events)
    select e.user_id, e.ts, o.price from e asof left join o on o.o_custkey = e.user_id and o.ts <= e.ts"""
)
def ext_asof(spark, d) -> DataFrame:
    """Every event with the price of the user's last order before it (an extension: an as-of join by a merged window)."""
    from pyspark.sql import Window

    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts")).agg(F.max("o_totalprice").alias("price"))
    e = table(spark, d, "events").select("user_id", "ts").distinct()
    both = o.select("user_id", "ts", F.lit(0).alias("side"), "price").unionByName(e.select("user_id", "ts", F.lit(1).alias("side"), F.lit(None).cast("double").alias("price")))
    w = Window.partitionBy("user_id").orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("price", F.last(F.when(F.col("side") == 0, F.col("price")), ignorenulls=True).over(w)).where("side = 1").select("user_id", "ts", "price")


@query(
    "select l_returnflag, l_linestatus, cast(grouping(l_returnflag) + 2 * grouping(l_linestatus) as bigint) as g, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem group by cube (l_returnflag, l_linestatus)"
)
def ext_rollup(spark, d) -> DataFrame:
    """Line items by both flags with all subtotals (an extension)."""
    rows = table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg((F.grouping("l_returnflag") + 2 * F.grouping("l_linestatus")).cast("long").alias("g"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    return rows


@query("select event_type, time_bucket(interval 1 hour, ts) as start, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def ext_windows(spark, d) -> DataFrame:
    """Events per hour (an extension: tumbling windows)."""
    rows = table(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select("event_type", F.col("w.start").alias("start"), "n", "total")


@query(
    """with g as (select user_id, ts, case when ts < lag(ts) over w + interval 30 minute then 0 else 1 end n from events window w as (partition by user_id order by ts)), s as (select *, sum(n) over (partition by user_id order by ts rows unbounded preceding) k from g)
    select user_id, min(ts) as start, count(*) as n from s group by user_id, k"""
)
def ext_session_window(spark, d) -> DataFrame:
    """Sessions of users by gaps of half an hour (an extension)."""
    rows = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")


@query(
    H
    + """, r as (select sha, row_number() over (partition by repo order by author_time desc nulls last, sha) k from (select sha, repo, max(epoch(ts)) as author_time from h group by 1, 2)) select sha from r where k <= 500"""
)
def newest_commits(spark, d) -> DataFrame:
    """The five hundred newest commits of each repository, as a cache keeps them."""
    from weftline.operators.maintain import keep_newest_commits

    c = history(spark, d).withColumn("author_time", F.unix_timestamp("ts"))
    return keep_newest_commits(c, table(spark, d, "commit_files"), 500)[0].select("sha")


@query(H + " select repo, count(path) as total, count(*) filter (ends_with(path, '.py')) as py, count(*) filter (ends_with(path, '.sh')) as sh from h join hf using (sha) group by 1")
def commit_scope(spark, d) -> DataFrame:
    """Changed files of each repository by ending."""
    from weftline.operators.gates import scope_counts

    return scope_counts(history(spark, d).select("sha", "repo").join(history_files(spark, d), "sha"), "repo")


@query("select id, count(*) as n from symbols group by 1 having count(*) > 1 or id is null")
def repeated_ids(spark, d) -> DataFrame:
    """Symbol ids that occur more than once."""
    from weftline.operators.maintain import check_keys

    return check_keys(table(spark, d, "symbols").select("id"), ["id"])


@query(
    "with r as (select repo, elapsed_seconds as e, files_indexed as f, python_parse_errors as p from build_stats) select repo as tool, 0 as budget, coalesce(cast(trunc(median(f)) as bigint), 0) as tokens, coalesce(cast(trunc(median(p)) as bigint), 0) as symbols, "
    "case when trunc(median(p)) > 0 then round(trunc(median(f)) / trunc(median(p)), 1) end as per_symbol, case when count(*) filter (e is null) > 0 then 'skipped' else 'ok' end as status from r group by 1"
)
def bench_report(spark, d) -> DataFrame:
    """Medians of runs per repository, with the worst status."""
    from weftline.operators.gates import bench_report as report

    runs = table(spark, d, "build_stats").select(
        F.col("repo").alias("tool"), F.lit(0).alias("budget"), F.col("files_indexed").alias("tokens"), F.col("python_parse_errors").alias("symbols"), F.when(F.col("elapsed_seconds").isNull(), "skipped").otherwise("ok").alias("status")
    )
    return report(runs)


@query()
def python_symbols(spark, d) -> DataFrame:
    """Symbols, calls and imports of all Python sources."""
    from weftline.sources.python_source import parse_python

    files = table(spark, d, "files").where("lower(path) like '%.py'").select(F.col("id").alias("file_id")).distinct()
    texts = table(spark, d, "file_contents").groupBy("file_id").agg(F.min("content").alias("content"))
    return parse_python(texts.join(files, "file_id", "left_semi"))
