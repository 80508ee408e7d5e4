"""Queries over the projected code index, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import graph, ranking, relational
from weftline.plans.views import view, with_views
from weftline.session import table

NOW, NAME, FILE, DIR = "2001-08-01 00:00:00", "red_widget", "mod15/Supplier#000000079.py", "mod15/"
CALLABLE = "('function', 'method', 'async_function', 'async_method')"
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _v(spark: SparkSession, d: str, *names: str):
    return [view(spark, d, f"v_{n}") for n in names]


@query(
    with_views(
        f"""+t as (select cf.file_id, count(distinct cf.sha) c from v_commit_files cf join v_commits k on k.sha = cf.sha where k.ts >= timestamp '{NOW}' - interval 90 day group by 1),
        s as (select file_id, count(*) f from v_symbols where kind in {CALLABLE} group by 1)
        select path, c as commits_in_window, f as function_count, c * f as score from t join s using (file_id) join v_files on v_files.id = file_id order by score desc, path limit 10""",
        "v_files", "v_symbols", "v_commits", "v_commit_files",
    )
)
def hot_spots(spark, d) -> DataFrame:
    """Files by recent commits times callable symbols, the ten highest."""
    return relational.hot_spots(*_v(spark, d, "files", "symbols", "commits", "commit_files"), now=NOW)


@query(
    with_views(
        f"""select s.id, s.name, s.kind, f.path as file, s.line from v_symbols s join v_files f on f.id = s.file_id
        where kind in {CALLABLE} and not exists (select 1 from v_edges e where e.dst = s.id and e.kind = 'call')""",
        "v_files", "v_symbols", "v_edges",
    )
)
def dead_code(spark, d) -> DataFrame:
    """Callable symbols nobody calls."""
    s, f, e = _v(spark, d, "symbols", "files", "edges")
    return relational.dead_code(s, f, e)


@query(
    with_views(
        """select s.id, s.name, s.kind, f.path as file, s.line, case when name = 'red' then 0 when lower(name) like 'red%' then 1 else 2 end as rank
        from v_symbols s join v_files f on f.id = s.file_id where contains(lower(name), 'red')""",
        "v_files", "v_symbols",
    )
)
def search_symbols(spark, d) -> DataFrame:
    """Symbols whose name contains ``red``."""
    return relational.search_symbols(*_v(spark, d, "symbols", "files"), query="red")


@query(with_views(f"select s.id, s.name, s.kind, s.line, s.signature from v_symbols s join v_files f on f.id = s.file_id where f.path = '{FILE}'", "v_files", "v_symbols"))
def file_summary(spark, d) -> DataFrame:
    """The symbols of one file."""
    return relational.file_summary(*_v(spark, d, "symbols", "files"), path=FILE)


def _reach_sql(near: str, far: str) -> str:
    return with_views(
        f"""+r as (select distinct e.{far} as id, 1 as depth from v_edges e join v_symbols s on s.id = e.{near} where s.name = '{NAME}'
        union select e.{far}, r.depth + 1 from r join v_edges e on e.{near} = r.id where r.depth < 3)
        select s.id, s.name, s.kind, f.path as file, s.line from v_symbols s join v_files f on f.id = s.file_id where s.id in (select id from r)""",
        "v_files", "v_symbols", "v_edges", recursive=True,
    )


@query(_reach_sql("dst", "src"))
def who_calls(spark, d) -> DataFrame:
    """Callers of a name, up to three calls away."""
    return relational.who_calls(*_v(spark, d, "symbols", "files", "edges"), name=NAME)


@query(_reach_sql("src", "dst"))
def blast_radius(spark, d) -> DataFrame:
    """What a name calls, up to three calls away."""
    return relational.blast_radius(*_v(spark, d, "symbols", "files", "edges"), name=NAME)


@query(
    with_views(
        f"""+r as (select id, 0 as depth from v_symbols where name = '{NAME}' union select e.dst, r.depth + 1 from r join v_edges e on e.src = r.id where r.depth < 5)
        select cast(min(depth) as integer) as depth from r join v_symbols s on s.id = r.id where s.name = 'blue_bolt' having min(depth) is not null""",
        "v_symbols", "v_edges", recursive=True,
    )
)
def dependency_chain(spark, d) -> DataFrame:
    """Length of the shortest call chain between two names."""
    s, e = _v(spark, d, "symbols", "edges")
    return graph.shortest_path(e, s.where(F.col("name") == NAME), s.where("name = 'blue_bolt'"), 5).select("depth")


@query(
    with_views(
        f"""+t as (select id from v_files where path = '{FILE}'),
        c as (select a.file_id, count(distinct a.sha) n from v_commit_files a where a.sha in (select sha from v_commit_files where file_id in (select id from t)) and a.file_id not in (select id from t) group by 1 having count(distinct a.sha) >= 3),
        l as (select x.file_id a, y.file_id b from v_edges e join v_symbols x on x.id = e.src join v_symbols y on y.id = e.dst),
        k as (select b as id from l where a in (select id from t) union select a from l where b in (select id from t))
        select f.path, c.n as shared_commits from c join v_files f on f.id = c.file_id where c.file_id not in (select id from k) order by 2 desc, 1 limit 50""",
        "v_files", "v_symbols", "v_edges", "v_commit_files",
    )
)
def co_changes(spark, d) -> DataFrame:
    """Files that change with one file without being linked to it."""
    f, s, e, c = _v(spark, d, "files", "symbols", "edges", "commit_files")
    return relational.co_changes(f, s, e, c, FILE)


def _owners_sql(where: str) -> str:
    return with_views(
        f"""+c as (select author, cast(sum(line_count) as bigint) n from v_ownership where file_id in (select id from v_files where {where}) group by 1)
        select author, n as line_count, n / (select sum(n) from c) * 100 as percentage from c""",
        "v_files", "v_ownership",
    )


@query(_owners_sql(f"path = '{FILE}'"))
def owners_file(spark, d) -> DataFrame:
    """Shares of a file's authors."""
    return relational.owners(*_v(spark, d, "ownership", "files"), path=FILE)


@query(_owners_sql(f"starts_with(path, '{DIR}')"))
def owners_dir(spark, d) -> DataFrame:
    """Shares of a directory's authors."""
    return relational.owners(*_v(spark, d, "ownership", "files"), path=DIR)


@query(
    with_views(
        f"""select f.path, count(distinct c.sha) as changes, arg_min(c.sha, (c.ts, c.sha)) as first_sha, arg_max(c.sha, (c.ts, c.sha)) as last_sha,
        array_to_string(list_sort(list(distinct c.author)), ',') as authors from v_commit_files x join v_commits c on c.sha = x.sha join v_files f on f.id = x.file_id
        where x.file_id in (select file_id from v_symbols where name = '{NAME}') group by 1""",
        "v_files", "v_symbols", "v_commits", "v_commit_files",
    )
)
def symbol_history(spark, d) -> DataFrame:
    """Changes of the files that hold a name."""
    return relational.symbol_history(*_v(spark, d, "symbols", "files", "commits", "commit_files"), name=NAME)


@query(
    with_views(
        """+o as (select s.id sid, s.file_id from v_symbols s), g as (select y.file_id, count(*) n from v_edges e join o x on x.sid = e.src join o y on y.sid = e.dst where x.file_id <> y.file_id group by 1),
        r as (select f.path, coalesce(g.n, 0) as in_degree, row_number() over (order by coalesce(g.n, 0) desc, f.path) p, count(*) over () c from v_files f left join g on g.file_id = f.id)
        select path, in_degree, case when p > c - greatest(1, c // 3) then 'periphery' when p <= greatest(1, c // 3) then 'core' else 'middle' end as layer from r""",
        "v_files", "v_symbols", "v_edges",
    )
)
def layers(spark, d) -> DataFrame:
    """Files by how much others use them, in three layers."""
    return relational.layers(*_v(spark, d, "edges", "symbols", "files"))


def _pagerank_sql(k: int) -> str:
    steps = ["n as (select count(*) n from v_symbols)", "o as (select src, count(*) d from v_edges group by 1)", "r0 as (select id, 1.0::double / n as r from v_symbols, n)"]
    for i in range(k):
        steps.append(
            f"r{i + 1} as (select v.id, 0.15 / n.n + 0.85 * (select coalesce(sum(r), 0) from r{i} where id not in (select src from o)) / n.n + 0.85 * coalesce(g.s, 0) as r from v_symbols v cross join n "
            f"left join (select e.dst, sum(x.r / o.d) s from v_edges e join r{i} x on x.id = e.src join o on o.src = e.src group by 1) g on g.dst = v.id)"
        )
    return with_views("+" + ", ".join(steps) + f" select id, round(r / (select sum(r) from r{k}), 8) as rank from r{k}", "v_symbols", "v_edges")


@query(_pagerank_sql(5))
def pagerank_5(spark, d) -> DataFrame:
    """Ranks after five iterations."""
    s, e = _v(spark, d, "symbols", "edges")
    return graph.pagerank(s, e, max_iterations=5, eps=0.0).withColumn("rank", F.round("rank", 8))


@query()
def pagerank(spark, d) -> DataFrame:
    """Ranks at convergence."""
    s, e = _v(spark, d, "symbols", "edges")
    return graph.pagerank(s, e)


@query(
    with_views(
        """+x as (select f.path, s.name, length(s.name) + length(s.signature) as size, row_number() over (partition by f.path order by s.line, s.name, s.id) p from v_symbols s join v_files f on f.id = s.file_id),
        y as (select *, sum(size + 2) over (partition by path order by p) - 2 + 40 as used from x) select path, name, cast(used as bigint) as used from y where used <= 400""",
        "v_files", "v_symbols",
    )
)
def intel_prefix(spark, d) -> DataFrame:
    """Per file the longest prefix of its symbols that fits a budget of characters."""
    s, f = _v(spark, d, "symbols", "files")
    rows = s.join(f.select(F.col("id").alias("file_id"), "path"), "file_id").withColumn("size", F.length("name") + F.length("signature"))
    return ranking.prefix_fit(rows, ["path"], ["line", "name", "id"], "size", cap=400, base=40, gap=2).select("path", "name", "used")


@query(with_views("select (select count(*) from v_files) as files, (select count(*) from v_symbols) as symbols, count(*) as edges, count(dst) as resolved, count(*) - count(dst) as unresolved from v_edges", "v_files", "v_symbols", "v_edges"))
def status_counts(spark, d) -> DataFrame:
    """Sizes of the index."""
    return relational.status_counts(*_v(spark, d, "files", "symbols", "edges"))


_IMPORTS = "select concat('pkg.m', cast(n_nationkey as string), '.', lower(replace(n_name, ' ', '_'))) as module from {nation} union select concat('src.r', cast(r_regionkey as string)) from {region}"


@query(
    """with m as (select concat('pkg.m', cast(n_nationkey as string), '.', lower(replace(n_name, ' ', '_'))) as module from nation union select concat('src.r', cast(r_regionkey as string)) from region),
    i as (select distinct a.module as source, b.n as "import" from m a, (select lower(replace(n_name, ' ', '_')) n from nation union select concat('r', cast(r_regionkey as string)) from region union select module from m union select 'os') b),
    c as (select source, "import", 1 s, "import" t from i union all select source, "import", 2, regexp_replace(source, '[.][^.]*$', '') || '.' || "import" from i union all
    select source, "import", 3, p || "import" from i, (values ('src.'), ('scripts.'), ('lib.'), ('app.')) x(p) union all select i.source, i."import", 4, m.module from i join m on ends_with(m.module, '.' || i."import")),
    b as (select source, "import", min((s, t)) z from c where t in (select module from m) and t <> source group by 1, 2)
    select i.source, i."import", struct_extract_at(b.z, 2) as target, struct_extract_at(b.z, 1) as strategy from i left join b using (source, "import")"""
)
def import_resolve(spark, d) -> DataFrame:
    """Modules that imports name, by the first strategy that hits."""
    mods = spark.sql(_IMPORTS, nation=table(spark, d, "nation"), region=table(spark, d, "region"))
    short = table(spark, d, "nation").select(F.lower(F.replace(F.col("n_name"), F.lit(" "), F.lit("_"))).alias("import")).union(
        table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")))
    ).union(mods.select("module")).union(spark.sql("select 'os'"))
    imports = mods.select(F.col("module").alias("source")).withColumn("import", F.explode(short.agg(F.collect_set("import")).scalar()))
    return relational.resolve_imports(imports, mods)


@query(
    with_views(
        """+c as (select e.src, y.file_id as target_file, case when e.dst % 10 = 0 then 'unknown' else y.name end as callee from v_edges e join v_symbols y on y.id = e.dst)
        select c.src, s.id as dst, case when s.id is null then c.callee end as unresolved from c left join v_symbols s on s.file_id = c.target_file and s.name = c.callee""",
        "v_symbols", "v_edges",
    )
)
def edge_resolve(spark, d) -> DataFrame:
    """Calls by name to the symbols of the target file."""
    s, e = _v(spark, d, "symbols", "edges")
    calls = e.join(s.select(F.col("id").alias("dst"), "file_id", "name"), "dst").select("src", F.col("file_id").alias("target_file"), F.when(F.col("dst") % 10 == 0, "unknown").otherwise(F.col("name")).alias("callee"))
    return relational.resolve_calls(calls, s)


@query(
    with_views(
        """+s as (select id, file_id as grp, line as start, line + length(signature) as stop, kind = 'class' as holds from v_symbols),
        b as (select a.id, min((-c.start, c.stop, c.id)) z from s a join s c on c.grp = a.grp and c.holds and c.start < a.start and a.stop <= c.stop group by 1)
        select s.id, struct_extract_at(b.z, 3) as container from s left join b on b.id = s.id""",
        "v_symbols",
    )
)
def parent_containment(spark, d) -> DataFrame:
    """The innermost class whose lines contain a symbol."""
    (s,) = _v(spark, d, "symbols")
    spans = s.select("id", F.col("file_id").alias("grp"), F.col("line").alias("start"), (F.col("line") + F.length("signature")).alias("stop"), (F.col("kind") == "class").alias("holds"))
    return relational.innermost_container(spans)


@query(
    with_views(
        """select s.name, count(distinct e.src) as callers, case when count(distinct e.src) <= 2 then 'LOW' when count(distinct e.src) <= 5 then 'MEDIUM' else 'HIGH' end as risk
        from v_symbols s left join v_edges e on e.dst = s.id group by 1""",
        "v_symbols", "v_edges",
    )
)
def risk(spark, d) -> DataFrame:
    """Risk of changing a name, by its direct callers."""
    from weftline.operators.metrics import impact

    s, e = _v(spark, d, "symbols", "edges")
    rows = s.join(e.select("src", F.col("dst").alias("id")), "id", "left_outer").groupBy("name").agg(F.count_distinct("src").alias("callers"))
    return rows.withColumn("risk", impact(F.col("callers")))


@query()
def symbol_diff(spark, d) -> DataFrame:
    """Symbols of two states of the index, the second with some renamed, changed and dropped."""
    from weftline.operators.diff import diff_symbols

    s, f = _v(spark, d, "symbols", "files")
    old = s.join(f.select(F.col("id").alias("file_id"), F.col("path").alias("file")), "file_id").select("file", "kind", "name", "line", "signature")
    new = old.where("line % 11 <> 0").withColumn("name", F.when(F.col("line") % 7 == 0, F.concat("name", F.lit("_x"))).otherwise(F.col("name")))
    return diff_symbols(old, new.withColumn("signature", F.when(F.col("line") % 5 == 1, F.concat("signature", F.lit(" -> int"))).otherwise(F.col("signature"))))


@query()
def ranked_symbols(spark, d) -> DataFrame:
    """All symbols in the order of their rank."""
    from weftline.operators.context import ranked_symbols as ranked

    return ranked(*_v(spark, d, "symbols", "files", "edges"))


@query()
def context_pack(spark, d) -> DataFrame:
    """Files and symbols that documents mention, with their owners and reach."""
    from weftline.operators.context import context_pack as pack

    docs = table(spark, d, "documents").select("doc_id", "text")
    return pack(docs, *_v(spark, d, "symbols", "files", "edges", "ownership"))
