"""Queries that build, keep and check an index, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import docs, gates, maintain
from weftline.plans.documents import HEAD, L
from weftline.plans.views import view, with_views
from weftline.session import cut, table
from weftline.sources.git import added_lines

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    from weftline.sources.code_grammars import parse_sources

    return parse_sources(table(spark, d, "files"), table(spark, d, "file_contents"), table(spark, d, "lang_map"))


@query()
def built_symbols(spark, d) -> DataFrame:
    """Symbols of all source texts, with parents and identifiers."""
    from weftline.sources.python_source import build_index

    return build_index(_parsed(spark, d), table(spark, d, "files"))[0]


@query()
def built_edges(spark, d) -> DataFrame:
    """Calls of all source texts, resolved in their file and in those it imports."""
    from weftline.sources.python_source import build_index

    return build_index(_parsed(spark, d), table(spark, d, "files"))[1]


@query("select * from (values ('edges', cast(0 as bigint), cast(0 as bigint)), ('symbols', 0, 0)) t(relation, missing, extra)")
def refresh_equals_build(spark, d) -> DataFrame:
    """How a refresh after changing every seventh text and moving every eleventh file differs from a build: not at all."""
    from weftline.sources.code_grammars import parse_sources
    from weftline.sources.python_source import build_index

    langs = table(spark, d, "lang_map")
    texts = table(spark, d, "file_contents").where("content is not null").groupBy(F.col("file_id").alias("id")).agg(F.min("content").alias("content"))
    files = table(spark, d, "files").where("path is not null").groupBy("id").agg(F.min("path").alias("path"), F.min("repo").alias("repo"))
    # One path in two repositories is two files.
    disk = cut(files.withColumn("path", F.concat_ws("/", "repo", "path")).join(texts, "id").select("id", "path", F.sha2(F.concat_ws("|", "id", "content"), 256).alias("hash"), "content"))
    changed = F.concat(F.regexp_replace("content", r"def (\w)", "def x_$1"), F.lit("\n"))
    turned = F.when(F.col("id") % 7 == 0, changed).otherwise(F.col("content"))
    now = disk.withColumn("content", turned).withColumn("hash", F.when(F.col("id") % 7 == 0, F.sha2("content", 256)).otherwise(F.col("hash")))
    now = cut(now.withColumn("path", F.when((F.col("id") % 11 == 0) & (F.col("id") % 7 != 0), F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))).where("id % 13 <> 0"))
    parse = lambda rows: parse_sources(rows.select(F.col("file_id").alias("id"), "path"), rows.select("file_id", "content"), langs)
    files2, parsed2 = maintain.refresh_parsed(disk.select("id", "path", "hash"), cut(parse(disk.withColumnRenamed("id", "file_id"))), now, parse)
    got, want = build_index(parsed2, files2), build_index(parse(now.withColumnRenamed("id", "file_id")), now)
    out = None
    for name, g, w in zip(("symbols", "edges"), got, want, strict=True):
        g, w = cut(g), cut(w.select(*g.columns))
        row = spark.range(1).select(F.lit(name).alias("relation"), w.exceptAll(g).agg(F.count("*")).scalar().alias("missing"), g.exceptAll(w).agg(F.count("*")).scalar().alias("extra"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    with_views(
        "+n as (select id, file_id, concat(name, '_2') as name, kind, line, signature from v_symbols where line % 3 = 0 union all select id + 10000000, file_id, name, kind, line, signature from v_symbols where line % 7 = 0) "
        "select id, name, line from n union all select id, name, line from v_symbols where id not in (select id from n)",
        "v_symbols",
    )
)
def upsert_symbols(spark, d) -> DataFrame:
    """Symbols with a third of them put in place of themselves and some new ones."""
    s = view(spark, d, "v_symbols")
    new = s.where("line % 3 = 0").withColumn("name", F.concat("name", F.lit("_2"))).unionByName(s.where("line % 7 = 0").withColumn("id", F.col("id") + 10_000_000))
    return maintain.upsert(s, new, ["id"], [F.col("name")]).select("id", "name", "line")


@query(with_views("+k as (select id from v_symbols where file_id % 5 <> 0) select e.src, e.dst from v_edges e where e.src in (select id from k) and e.dst in (select id from k)", "v_symbols", "v_edges"))
def cascade_edges(spark, d) -> DataFrame:
    """The edges that are left when every fifth file is deleted."""
    f, s, e = (view(spark, d, f"v_{n}") for n in ("files", "symbols", "edges"))
    gone = s.where("file_id % 5 = 0").select(F.col("file_id").alias("id")).distinct()
    return maintain.delete_files(f, s, e, gone)[2].select("src", "dst")


@query(L + f" select doc_id, cast(pos as integer) as pos, trim(line) as line from l where regexp_matches(line, {HEAD}) and not regexp_matches(line, '^(?:## Milestone \\d+: \\S.*|### Sub-step \\d+\\.\\d+: \\S.*)$')")
def heading_lint(spark, d) -> DataFrame:
    """Milestone and step headings that aren't in the one form."""
    return docs.heading_lint(table(spark, d, "documents").select("doc_id", F.replace(F.col("text"), F.lit("\r"), F.lit("")).alias("text")))


#: What the planted changes add, by the remainder of the part; ``{n}`` is its name.
_PLANTED = (
    'api_key = "{n}"', 'password = "your-{n}"', 'subprocess.run(cmd, shell=True)  # {n}', "x = eval({n})", "model.eval()  # {n}", 'open(base + "../{n}")', 'cur.execute(f"select {n}")', 'cur.execute("select " + {n})', "pickle.loads({n})",
    'token = os.environ["{n}"]', "# {n}",
)
_CASES = lambda f: "case p_partkey % 11 " + " ".join(f"when {i} then {f(x)}" for i, x in enumerate(_PLANTED)) + " end"
_TEXT = _CASES(lambda x: "concat('" + x.replace("'", "''").replace("{n}", "', p_name, '") + "')")
_RISK = "case p_partkey % 11 when 0 then case when length(p_name) >= 8 then 'secret' end when 2 then 'shell_injection' when 3 then 'dynamic_code' when 5 then 'path_traversal' when 6 then 'sql_fstring' when 7 then 'sql_concatenation' when 8 then 'unsafe_deserialisation' end"


@query(f"select concat('p', cast(p_partkey as string), '.py') as file, cast(p_size + 1 as integer) as line_no, {_RISK} as risk from part where {_RISK} is not null and p_partkey % 13 <> 0")
def diff_risks(spark, d) -> DataFrame:
    """Risky lines that changes add, in their place in the new file; one change for each part, some not of Python files."""
    ending = "case when p_partkey % 13 = 0 then '.md' else '.py' end"
    diff = table(spark, d, "part").selectExpr(
        "p_partkey as doc_id",
        f"concat_ws('\\n', concat('--- a/p', p_partkey, {ending}), concat('+++ b/p', p_partkey, {ending}), concat('@@ -1,2 +', p_size, ',3 @@'), ' eval(1)', '-exec(1)', concat('+', {_TEXT}), ' same') as text",
    )
    return docs.diff_risks(added_lines(diff))


@query(
    "with m as (select p_partkey as milestone, p_size % 7 as r from part), a(p, audit, checks) as (select p, a, '' from (values (0), (1)) x(p), (values ('code-reviewer'), ('security-auditor'), ('tdd-sequence'), ('context7-evidence'), ('future-proofing')) y(a) "
    "union all values (2, 'future-proofing', '1'), (3, 'code-reviewer', ''), (3, 'security-auditor', ''), (3, 'future-proofing', '1,3'), (4, 'code-reviewer', ''), (4, 'tdd-sequence', '')) select milestone, audit, checks from m join a on p = r"
)
def audit_dispatch(spark, d) -> DataFrame:
    """Which audits the profiles of milestones run."""
    profiles = F.array(*map(F.lit, ("full", "Code-Only", "docs-only", "infra ", "custom", "odd")))
    milestones = table(spark, d, "part").select(
        F.col("p_partkey").alias("milestone"), F.try_element_at(profiles, (F.col("p_size") % 7 + 1).cast("int")).alias("profile"),
        F.lit("code-reviewer, tdd-sequence,security-auditor").alias("run"), F.lit("security-auditor").alias("skip"),
    )
    return gates.audit_dispatch(milestones)


@query(
    r"""select repo, count(distinct sha) as n_commits from (select lower(trim(sha)) as sha, repo, message from commits where sha is not null and repo is not null) c
    where regexp_matches(message, '(?i)^(feat|fix)(\([^)]*\))?:|^BREAKING CHANGE') and sha in (select lower(trim(commit_sha)) from commit_files where starts_with(file_path, 'src/') or starts_with(file_path, 'lib/')) group by 1"""
)
def changelog_gap(spark, d) -> DataFrame:
    """Features and fixes under two folders that a changelog without a section for them lacks."""
    commits = table(spark, d, "commits").where("sha is not null and repo is not null").select(F.lower(F.trim("sha")).alias("sha"), "repo", "message")
    files = table(spark, d, "commit_files").select(F.lower(F.trim("commit_sha")).alias("sha"), F.col("file_path").alias("path"))
    return docs.changelog_gap(commits, files, ("src/", "lib/"), "# Changelog")


@query()
def version_mentions(spark, d) -> DataFrame:
    """Versions that stand near a bracket or the word for them and aren't the current one."""
    return docs.version_mentions(table(spark, d, "documents").select("doc_id", "text"), "0.40.1", ("version", "["))
