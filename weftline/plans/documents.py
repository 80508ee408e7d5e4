"""Queries over plan documents and transcripts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import docs, evidence
from weftline.session import table

QUERIES, SQL = {}, {}
# Lines of all documents, numbered from 0, with fenced blocks and comments blanked as the operators do.
RAW = r"""with raw as (select doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) as line, generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) - 1 as pos from documents where text is not null)"""
L = r"""with q as (select doc_id, regexp_replace(replace(text, chr(13), ''), '<!--.*?-->', '', 'gs') as t from documents where text is not null),
u as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) - 1 as pos from q),
k as (select *, regexp_matches(line, '^\s*(```|~~~)') as f from u), o as (select *, sum(cast(f as integer)) over (partition by doc_id order by pos rows unbounded preceding) as c from k),
l as (select doc_id, pos, case when f or c % 2 = 1 then '' else line end as line from o)"""
HEAD = r"'^(?:##[ \t]+(?:Milestone[ \t]+M?|M)(\d+[a-z]?(?:\.\d+)*)|###[ \t]+(?:Sub-step|Step|Task)[ \t]+(M?\d+[a-z]?(?:\.\d+)*(?:\.[a-z]{2,}|[a-z])?))(?::|[ \t]+[–—-][ \t]+)[ \t]*(.+?)[ \t]*$'"
KIND = f"case when regexp_extract(line, {HEAD}, 1) <> '' then 'milestone' else 'step' end"
NUMBER = f"coalesce(nullif(regexp_extract(line, {HEAD}, 1), ''), regexp_extract(line, {HEAD}, 2))"
FIELD = r"'^[ \t]*-?[ \t]*\*{0,2}(%s)\*{0,2}:\*{0,2}[ \t]*(\S.*?)\s*$'"
ITEMS = (
    L
    + f""", m as (select doc_id, pos, {KIND} kind, {NUMBER} number, regexp_extract(line, {HEAD}, 3) title, null as status from l where regexp_matches(line, {HEAD})
    union all select doc_id, pos, null, null, null, regexp_extract(line, {FIELD % 'Status'}, 2) from l where regexp_matches(line, {FIELD % 'Status'})),
    b as (select *, last_value(case when kind is not null then pos end ignore nulls) over (partition by doc_id order by pos rows unbounded preceding) as blk from m),
    i as (select doc_id, blk as pos, min(kind) kind, min(number) number, min(title) title, arg_min(status, pos) filter (status is not null) raw from b where blk is not null group by 1, 2),
    items as (select doc_id, pos, kind, number, title, coalesce(case when kind = 'milestone' then case when raw in ('PENDING', 'ACTIVE', 'IN_PROGRESS', 'BLOCKED', 'COMPLETE') then raw end
      when raw = 'ACTIVE' then 'IN_PROGRESS' when raw in ('PENDING', 'IN_PROGRESS', 'BLOCKED', 'COMPLETE') then raw end, 'PENDING') as status,
      last_value(case when kind = 'milestone' then pos end ignore nulls) over (partition by doc_id order by pos rows unbounded preceding) as milestone from i)"""
)
PROGRESS = (
    ITEMS
    + """, c as (select doc_id, count(*) filter (kind <> 'milestone' and status = 'COMPLETE') as steps_done, count(*) filter (kind <> 'milestone') as steps, count(*) filter (kind = 'milestone' and status = 'COMPLETE') as milestones_done,
    count(*) filter (kind = 'milestone') as milestones, count(*) filter (status = 'BLOCKED') as bl, count(*) filter (kind = 'milestone' and status in ('ACTIVE', 'IN_PROGRESS') or kind <> 'milestone' and status in ('IN_PROGRESS', 'COMPLETE')) as mv from items where kind = 'milestone' or milestone is not null group by 1),
    p as (select doc_id, steps_done, steps, milestones_done, milestones, case when bl > 0 then 'BLOCKED' when milestones > 0 and milestones_done = milestones then 'COMPLETE' when mv > 0 then 'IN_PROGRESS' else 'PENDING' end as status from c)"""
)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


@query(L + f" select doc_id, cast(pos as integer) as pos, {KIND} as kind, {NUMBER} as number, regexp_extract(line, {HEAD}, 3) as title from l where regexp_matches(line, {HEAD})")
def headings(spark, d) -> DataFrame:
    """Milestone and step headings."""
    return docs.headings(_docs(spark, d))


_F4 = FIELD % "Status|Gate|Mode|Complexity"


@query(L + f" select doc_id, cast(pos as integer) as pos, regexp_extract(line, {_F4}, 1) as field, regexp_extract(line, {_F4}, 2) as value from l where regexp_matches(line, {_F4})")
def field_values(spark, d) -> DataFrame:
    """Values of status, gate, mode and complexity lines."""
    return docs.field_values(_docs(spark, d))


@query(L + r" select doc_id, cast(pos as integer) as pos, line from l where regexp_matches(line, '^[ \t]*-?[ \t]*\*{0,2}Status\*{0,2}:\*{0,2}[ \t]*\S') and not regexp_matches(line, '^- Status: [A-Z_]+$')")
def non_canonical(spark, d) -> DataFrame:
    """Status lines in another than the canonical form."""
    return docs.non_canonical(_docs(spark, d))


@query(ITEMS + " select doc_id, cast(pos as integer) as pos, kind, number, title, status, cast(milestone as integer) as milestone from items")
def task_items(spark, d) -> DataFrame:
    """Milestones and steps with their status."""
    return docs.plan_items(_docs(spark, d))


@query(PROGRESS + " select * from p")
def task_progress(spark, d) -> DataFrame:
    """Progress and derived status of every plan."""
    return docs.progress(docs.plan_items(_docs(spark, d)))


@query(PROGRESS + ", cols(pos, status) as (values (0, 'PENDING'), (1, 'IN_PROGRESS'), (2, 'BLOCKED'), (3, 'COMPLETE')) select cols.pos, cols.status, count(p.doc_id) as tasks from cols left join p using (status) group by 1, 2")
def task_board(spark, d) -> DataFrame:
    """Plans per column of the board."""
    return docs.board(docs.progress(docs.plan_items(_docs(spark, d))))


@query(
    ITEMS
    + """, r as (select *, case status when 'ACTIVE' then 0 when 'PENDING' then 1 end as o from items where kind = 'milestone'), n as (select doc_id, count(*) filter (status = 'ACTIVE') as n_active from r group by 1),
    f as (select doc_id, number, title, status, row_number() over (partition by doc_id order by o, pos) k from r where o is not null) select doc_id, number, title, status, n_active from f join n using (doc_id) where k = 1"""
)
def active_step(spark, d) -> DataFrame:
    """The milestone at work in every plan."""
    return docs.active_item(docs.plan_items(_docs(spark, d)))


@query(
    r"""with x as (select doc_id, regexp_extract_all(text, '`([A-Za-z_][A-Za-z0-9_./-]*)(?:\(\))?`', 1) as a from documents where text is not null), y as (select doc_id, unnest(a) as token, generate_subscripts(a, 1) - 1 as p from x)
    select doc_id, token, cast(min(p) as integer) as "first" from y group by 1, 2"""
)
def mentions(spark, d) -> DataFrame:
    """Backticked names by document."""
    return docs.mentions(_docs(spark, d))


@query(RAW + " select doc_id, count(*) as matches from raw where contains(lower(line), 'milestone') group by 1")
def term_search(spark, d) -> DataFrame:
    """Lines that hold a word, per document."""
    return docs.term_search(_docs(spark, d), "milestone")


@query(
    RAW
    + r""", x as (select doc_id, pos, unnest(list_distinct(regexp_extract_all(line, '\b\d+\.\d+\.\d+(?:[.\-][A-Za-z0-9]+|[A-Za-z]+\d*)?'))) as version from raw where contains(lower(line), '[')) select doc_id, cast(pos as integer) as pos, version from x where version <> '0.40.1'"""
)
def doc_drift_versions(spark, d) -> DataFrame:
    """Versions in brackets that aren't the canonical one."""
    return docs.version_drift(_docs(spark, d), "0.40.1", "[")


@query(
    r"""with t as (select doc_id as id, coalesce(text, '') as t from documents), a as (select id, t, list_filter([case when regexp_matches(t, '(?i)provenance\.log') then 'provenance_log' end,
    case when regexp_matches(t, '(?i)tasks\.md') or regexp_matches(t, '\bStatus:\s*(COMPLETE|PENDING|ACTIVE)\b') then 'tasks_md_status' end, case when regexp_matches(t, '(?i)\bgit\s+tag\b') then 'git_tag' end,
    case when regexp_matches(t, '(?i)\bmake\s+ci\b|\bpytest\b|\bexit(?:s|ed)?\s+0\b') then 'test_exit_code' end, case when regexp_matches(t, '\[[A-Z-]+ Plan\]') or regexp_matches(t, '(?i)\bcommit\s+footer') then 'commit_footer' end,
    case when regexp_matches(t, '(?i)verification\.md') then 'verification_md' end], lambda x: x is not null) as f from t),
    r as (select id, f, case when length(t) > 4000 then 'condition_too_long' when regexp_matches(t, '(?i)\b(correct|done|good|ready|working)\b') then 'condition_too_vague' when len(f) < 2 then 'observable_artifacts_insufficient' end as reason from a)
    select id, reason is null as ok, reason, coalesce(array_to_string(f, ','), '') as artifacts from r"""
)
def goal_validate(spark, d) -> DataFrame:
    """Documents as conditions, with the first stage they fail."""
    return docs.validate_conditions(_docs(spark, d).withColumnRenamed("doc_id", "id"))


@query(
    RAW
    + r""", c(risk, rx) as (values ('secret', '(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*[''"][^''"]{8,}'), ('private_key', '-----BEGIN [A-Z ]*PRIVATE KEY-----'), ('eval', '\b(eval|exec)\s*\('), ('shell', 'shell\s*=\s*True|os\.system\s*\('), ('weak_hash', '(?i)\b(md5|sha1)\s*\('))
    select doc_id, cast(pos as integer) as pos, risk from raw join c on regexp_matches(line, rx)"""
)
def security_scan(spark, d) -> DataFrame:
    """Lines of documents that belong to a class of risky text."""
    return docs.security_scan(_docs(spark, d))


@query(
    "with a as (select distinct file_id as k from symbols where file_id is not null), b as (select distinct file_id as k from file_contents where file_id is not null) "
    "select k as file_id, 'left_only' as side from a where k not in (select k from b) union all select k, 'right_only' from b where k not in (select k from a)"
)
def reconcile(spark, d) -> DataFrame:
    """Files with symbols but no text, and the reverse."""
    return docs.reconcile(table(spark, d, "symbols").where("file_id is not null"), table(spark, d, "file_contents").where("file_id is not null"), "file_id")


@query(
    "with a as (select distinct lower(commit_sha) as sha from commit_files where commit_sha is not null), b as (select distinct lower(sha) as sha from commits where sha is not null) "
    "select sha, 'left_only' as side from a where sha not in (select sha from b) union all select sha, 'right_only' from b where sha not in (select sha from a)"
)
def commit_drift(spark, d) -> DataFrame:
    """Commits named by files that never arrived, and commits without files."""
    a = table(spark, d, "commit_files").select(F.lower("commit_sha").alias("sha")).where("sha is not null")
    return docs.reconcile(a, table(spark, d, "commits").select(F.lower("sha").alias("sha")).where("sha is not null"), "sha")


@query(
    RAW.replace("replace(text, chr(13), '')", r"regexp_replace(text, '\r\n', chr(10), 'g')")
    + """, j as (select doc_id, pos, try_cast(line as json) as j from raw where line like '{%') select doc_id, cast(pos as integer) as pos, j ->> 'role' as role, j ->> 'content' as content from j where j is not null and j ->> 'role' is not null"""
)
def transcript_turns(spark, d) -> DataFrame:
    """Turns of transcripts."""
    return evidence.turns(_docs(spark, d))


@query()
def tool_calls(spark, d) -> DataFrame:
    """Tool calls anywhere in the JSON lines of documents."""
    return evidence.tool_calls(_docs(spark, d))
