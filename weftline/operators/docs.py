"""Plan documents: lines, headings, fields, derived status, boards, mentions and scans.

Documents come as ``(doc_id, text)``.  Null texts have no lines.  Fenced blocks are blanked before headings and
fields are read, so that quoted examples don't count.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Statuses and the words that a condition must not hold.
MILESTONE_STATUS = ("PENDING", "ACTIVE", "IN_PROGRESS", "BLOCKED", "COMPLETE")
STEP_STATUS = ("PENDING", "IN_PROGRESS", "BLOCKED", "COMPLETE")
BOARD = ("PENDING", "IN_PROGRESS", "BLOCKED", "COMPLETE")
VAGUE = ("correct", "done", "good", "ready", "working")


def blank_fences(text: str) -> str:
    """``text`` with the lines of fenced blocks emptied, fences included.

    A fence is closed by one of the same sign, at least as long and without a word behind it; so fences of another
    kind inside are content.  An open fence runs to the end.
    """
    sign, length, out = "", 0, []
    for line in text.split("\n"):
        bare = line.lstrip(" \t")
        mark = bare[:1]
        run = len(bare) - len(bare.lstrip(mark)) if mark in ("`", "~") and len(line) - len(bare) <= 3 else 0
        if sign:
            if mark == sign and run >= length and not bare[run:].strip():
                sign = ""
            out.append("")
        elif run >= 3 and not (mark == "`" and "`" in bare[run:]):
            sign, length = mark, run
            out.append("")
        else:
            out.append(line)
    return "\n".join(out)


def _blank(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([blank_fences(t) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])


def lines(docs: DataFrame, fences: bool = False) -> DataFrame:
    """``(doc_id, pos, line)`` with ``pos`` from 0; carriage returns are cut.

    Unless ``fences`` are to stay, comments are cut and the lines of fenced blocks become empty.  Only texts with
    a fence go through Python for that.
    """
    rows = docs.where("text is not null").select("doc_id", F.regexp_replace("text", "\r", "").alias("text"))
    if not fences:
        rows = rows.withColumn("text", F.regexp_replace("text", r"(?s)<!--.*?-->", ""))
        fenced = F.col("text").contains("```") | F.col("text").contains("~~~")
        kind = docs.schema["doc_id"].dataType.simpleString()
        rows = rows.where(~fenced).unionByName(rows.where(fenced).mapInArrow(_blank, f"doc_id {kind}, text string"))
    return rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


#: Fixed value: headings of milestones (``## Milestone M1: T``, ``## M2a - T``) and steps (``### Step M2a.1.bis: T``).
HEADING = (
    r"^(?:##[ \t]+(?:Milestone[ \t]+M?|M)(\d+[a-z]?(?:\.\d+)*)|###[ \t]+(?:Sub-step|Step|Task)[ \t]+(M?\d+[a-z]?(?:\.\d+)*(?:\.[a-z]{2,}|[a-z])?))"
    r"(?::|[ \t]+[–—-][ \t]+)[ \t]*(.+?)[ \t]*$"
)


def headings(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, kind, number, title)`` of milestone and step headings.

    The separator is a colon or a dash between blanks; a milestone's leading ``M`` isn't part of its number.
    """
    part = lambda i: F.regexp_extract("line", HEADING, i)
    kind = F.when(part(1) != "", "milestone").otherwise("step")
    return lines(docs).where(F.col("line").rlike(HEADING)).select(
        "doc_id", "pos", kind.alias("kind"), F.coalesce(F.nullif(part(1), F.lit("")), part(2)).alias("number"), part(3).alias("title")
    )


def field_values(docs: DataFrame, names: tuple[str, ...] = ("Status", "Gate", "Mode", "Complexity")) -> DataFrame:
    """``(doc_id, pos, field, value)`` of field lines, with or without bullet and bold marks."""
    rx = r"^[ \t]*-?[ \t]*\*{0,2}(" + "|".join(names) + r")\*{0,2}:\*{0,2}[ \t]*(\S.*?)\s*$"
    return lines(docs).where(F.col("line").rlike(rx)).select("doc_id", "pos", F.regexp_extract("line", rx, 1).alias("field"), F.regexp_extract("line", rx, 2).alias("value"))


def non_canonical(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, line)`` of status lines that the tolerant reader takes but that aren't ``- Status: VALUE``."""
    tolerant, strict = r"^[ \t]*-?[ \t]*\*{0,2}Status\*{0,2}:\*{0,2}[ \t]*\S", r"^- Status: [A-Z_]+$"
    return lines(docs).where(F.col("line").rlike(tolerant) & ~F.col("line").rlike(strict))


#: The one form in which milestone and step headings are to be written.
CANONICAL_HEADING = r"^(?:## Milestone \d+: \S.*|### Sub-step \d+\.\d+: \S.*)$"


def heading_lint(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, line)`` of headings that the tolerant reader takes for a milestone or step but that aren't in the one form.

    Other headings are none of its business.
    """
    return lines(docs).where(F.col("line").rlike(HEADING) & ~F.col("line").rlike(CANONICAL_HEADING)).select("doc_id", "pos", F.trim("line").alias("line"))


def plan_items(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, kind, number, title, status, milestone)``: headings with the status of their block.

    The block of a heading ends at the next one.  A missing or unknown status is PENDING; ACTIVE on a step
    means IN_PROGRESS.  ``milestone`` is the position of the milestone above, null for a step before any.
    """
    marks = headings(docs).select("doc_id", "pos", "kind", "number", "title", F.lit(None).cast("string").alias("status"))
    fields = field_values(docs, ("Status",)).select("doc_id", "pos", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("title"), F.col("value").alias("status"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    block = F.last(F.when(F.col("kind").isNotNull(), F.col("pos")), ignorenulls=True).over(w)
    rows = marks.unionByName(fields).withColumn("block", block).where("block is not null")
    items = rows.groupBy("doc_id", "block").agg(*[F.min(c).alias(c) for c in ("kind", "number", "title")], F.min_by("status", F.when(F.col("status").isNotNull(), F.col("pos"))).alias("raw"))
    known = F.when(F.col("kind") == "milestone", F.when(F.col("raw").isin(*MILESTONE_STATUS), F.col("raw"))).otherwise(
        F.when(F.col("raw") == "ACTIVE", "IN_PROGRESS").when(F.col("raw").isin(*STEP_STATUS), F.col("raw"))
    )
    inner = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    above = F.last(F.when(F.col("kind") == "milestone", F.col("block")), ignorenulls=True).over(inner)
    return items.select("doc_id", F.col("block").alias("pos"), "kind", "number", "title", F.coalesce(known, F.lit("PENDING")).alias("status"), above.alias("milestone"))


def progress(items: DataFrame) -> DataFrame:
    """``(doc_id, steps_done, steps, milestones_done, milestones, status)`` per document.

    The status is BLOCKED if any milestone or step is, COMPLETE if all milestones are, IN_PROGRESS if any
    milestone is ACTIVE or IN_PROGRESS or any step IN_PROGRESS or COMPLETE, else PENDING.  Steps before the
    first milestone belong to none and don't count.
    """
    m, done = F.col("kind") == "milestone", F.col("status") == "COMPLETE"
    count = lambda c: F.count(F.when(c, 1))
    items = items.where(m | F.col("milestone").isNotNull())
    moving = m & F.col("status").isin("ACTIVE", "IN_PROGRESS") | ~m & F.col("status").isin("IN_PROGRESS", "COMPLETE")
    rows = items.groupBy("doc_id").agg(
        count(~m & done).alias("steps_done"), count(~m).alias("steps"), count(m & done).alias("milestones_done"), count(m).alias("milestones"),
        count(F.col("status") == "BLOCKED").alias("blocked"), count(moving).alias("moving"),
    )
    status = F.when(F.col("blocked") > 0, "BLOCKED").when((F.col("milestones") > 0) & (F.col("milestones_done") == F.col("milestones")), "COMPLETE").when(F.col("moving") > 0, "IN_PROGRESS").otherwise("PENDING")
    return rows.select("doc_id", "steps_done", "steps", "milestones_done", "milestones", status.alias("status"))


def board(progress_rows: DataFrame) -> DataFrame:
    """``(status, tasks)`` for every column of the board, empty ones included."""
    columns = progress_rows.sparkSession.createDataFrame([(i, s) for i, s in enumerate(BOARD)], "pos int, status string")
    counts = progress_rows.groupBy("status").agg(F.count("*").alias("tasks"))
    return columns.join(counts, "status", "left_outer").select("pos", "status", F.coalesce("tasks", F.lit(0)).alias("tasks"))


def active_item(items: DataFrame) -> DataFrame:
    """``(doc_id, number, title, status, n_active)``: the first ACTIVE milestone, else the first PENDING one.

    ``n_active`` lets a strict caller insist on exactly one.
    """
    m = items.where("kind = 'milestone'")
    rank = F.when(F.col("status") == "ACTIVE", 0).when(F.col("status") == "PENDING", 1)
    first = F.min_by(F.struct("number", "title", "status"), F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.col("pos")))).alias("f")
    return m.groupBy("doc_id").agg(first, F.count(F.when(F.col("status") == "ACTIVE", 1)).alias("n_active")).where("f is not null").select("doc_id", "f.*", "n_active")


def mentions(docs: DataFrame) -> DataFrame:
    """``(doc_id, token, first)``: every backticked token with the place of its first mention, counted from 0."""
    found = F.regexp_extract_all("text", F.lit(r"`([A-Za-z_][A-Za-z0-9_./-]*)(?:\(\))?`"), F.lit(1))
    return docs.where("text is not null").select("doc_id", F.posexplode(found).alias("pos", "token")).groupBy("doc_id", "token").agg(F.min("pos").alias("first"))


def term_search(docs: DataFrame, term: str) -> DataFrame:
    """``(doc_id, matches)``: lines that contain the term, without regard to case."""
    hit = lines(docs, fences=True).where(F.lower("line").contains(term.lower()))
    return hit.groupBy("doc_id").agg(F.count("*").alias("matches"))


#: Observable things by class, and limits of a condition.
OBSERVABLE = {
    "provenance_log": [r"(?i)provenance\.log"],
    "tasks_md_status": [r"(?i)tasks\.md", r"\bStatus:\s*(COMPLETE|PENDING|ACTIVE)\b"],
    "git_tag": [r"(?i)\bgit\s+tag\b"],
    "test_exit_code": [r"(?i)\bmake\s+ci\b", r"(?i)\bpytest\b", r"(?i)\bexit(?:s|ed)?\s+0\b"],
    "commit_footer": [r"\[[A-Z-]+ Plan\]", r"(?i)\bcommit\s+footer"],
    "verification_md": [r"(?i)verification\.md"],
}
CONDITION_LIMIT, LEAST_OBSERVABLE, TURN_CEILING = 4000, 2, 30


def validate_conditions(conditions: DataFrame, turn_cap: int = TURN_CEILING, footer: str = OBSERVABLE["commit_footer"][0]) -> DataFrame:
    """``(id, ok, reason, artifacts)`` of ``conditions(id, text)``; the first failing stage names the reason.

    Stages: the turn cap is from 1 to 30, the text is short enough, holds no vague word, and names things of at
    least two observable classes.  A null text is an empty one.  ``footer`` is the pattern of the footer of commits;
    a project gives its own, as the default takes any that ends in ``Plan``.
    """
    t = F.coalesce("text", F.lit(""))
    one = lambda rxs: F.greatest(*[t.rlike(r) for r in rxs], F.lit(False))
    artifacts = F.array_compact(F.array(*[F.when(one(rxs), F.lit(name)) for name, rxs in ({**OBSERVABLE, "commit_footer": [footer, *OBSERVABLE["commit_footer"][1:]]}).items()]))
    reason = (
        F.when(F.lit(not 1 <= turn_cap <= TURN_CEILING), "turn_cap_out_of_range").when(F.length(t) > CONDITION_LIMIT, "condition_too_long")
        .when(t.rlike(r"(?i)\b(" + "|".join(VAGUE) + r")\b"), "condition_too_vague").when(F.size(artifacts) < LEAST_OBSERVABLE, "observable_artifacts_insufficient")
    )
    return conditions.select("id", reason.isNull().alias("ok"), reason.alias("reason"), F.array_join(artifacts, ",").alias("artifacts"))


def version_drift(docs: DataFrame, canonical: str, keyword: str) -> DataFrame:
    """``(doc_id, pos, version)``: versions other than the canonical one on lines that name the keyword."""
    rx = r"\b\d+\.\d+\.\d+(?:[.\-][A-Za-z0-9]+|[A-Za-z]+\d*)?"
    hit = lines(docs, fences=True).where(F.lower("line").contains(keyword.lower()))
    return hit.select("doc_id", "pos", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(rx), F.lit(0)))).alias("version")).where(F.col("version") != canonical)


def version_mentions(docs: DataFrame, canonical: str, keywords: tuple[str, ...] = ("version",), width: int = 40) -> DataFrame:
    """``(doc_id, pos, version)``: other versions than the canonical one with a keyword within ``width`` characters before or behind.

    ``pos`` is the line; the window ends with the line.  Repeated mentions on a line come out once.
    """
    rx = r"(?<![\d.])\b\d++\.\d++\.\d++(?:[.\-][A-Za-z0-9]++|[A-Za-z]++\d*+)?+"
    near = [p for k in keywords for p in (rf"(?<=(?i:{re.escape(k)}).{{0,{width - len(k)}}}){rx}", rf"{rx}(?=.{{0,{width - len(k)}}}(?i:{re.escape(k)}))")]
    found = F.regexp_extract_all("line", F.lit("|".join(near)), F.lit(0))
    return lines(docs, fences=True).select("doc_id", "pos", F.explode(F.array_distinct(found)).alias("version")).where(F.col("version") != canonical)


def changelog_gap(commits: DataFrame, commit_files: DataFrame, prefixes: tuple[str, ...], changelog: str | None = None) -> DataFrame:
    """``(repo, n_commits)``: per repository the features and fixes that touch a path under one of the prefixes.

    ``commits(sha, repo, message)`` are those since the last release.  None come out if ``changelog`` has a section for
    what isn't released, as then they are taken for noted.
    """
    noted = bool(changelog) and any(w in changelog.lower() for w in ("unreleased", "upcoming"))
    under = F.lit(False)
    for p in prefixes:
        under = under | F.col("path").startswith(p)
    touched = commit_files.where(under).select("sha").distinct()
    rows = commits.where(F.col("message").rlike(r"(?i)^(?:feat|fix)(?:\([^)]*\))?:|^BREAKING CHANGE") & F.lit(not noted)).select("sha", "repo").distinct()
    return rows.join(touched, "sha", "left_semi").groupBy("repo").agg(F.count("*").alias("n_commits"))


#: What added lines must not hold, and what shows that a secret is none.
ADDED_RISKS = {
    "secret": r"(?i)(api[_-]?key|apikey|token|password|secret)\s*=\s*[\"'][^\"']{8,}[\"']",
    "shell_injection": r"subprocess\.[a-zA-Z_]+\([^)]*shell\s*=\s*True",
    "dynamic_code": r"(^|[^a-zA-Z_.])(eval|exec)\s*\(",
    "path_traversal": r"(open|Path)\s*\([^)]*\.\./",
    "sql_fstring": r"\.execute\s*\(\s*f[\"']",
    "sql_concatenation": r"\.execute\s*\(\s*[\"'][^\"']*[\"']\s*\+",
    "unsafe_deserialisation": r"(^|[^a-zA-Z_])c?pickle\.loads\s*\(",
}
NO_SECRET = r"your-|<[A-Z_]+>|xxxx|os\.environ|os\.getenv|\$\{[A-Z_]+\}|\$[A-Z_]+"


def diff_risks(added: DataFrame) -> DataFrame:
    """``(file, line_no, risk)`` of added lines ``(file, line_no, text)``, as ``sources.git.added_lines`` gives them, of Python files.

    A line may belong to several classes; a secret that is read from the environment or holds a place is none.
    """
    hits = [F.when(F.col("text").rlike(rx) & (~F.col("text").rlike(NO_SECRET) if name == "secret" else F.lit(True)), F.lit(name)) for name, rx in ADDED_RISKS.items()]
    return added.where("file like '%.py'").select("file", "line_no", F.explode(F.array_compact(F.array(*hits))).alias("risk"))


#: Classes of risky text on added lines.
RISKS = {
    "secret": r"(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*['\"][^'\"]{8,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "eval": r"\b(eval|exec)\s*\(",
    "shell": r"shell\s*=\s*True|os\.system\s*\(",
    "unsafe_yaml": r"yaml\.load\s*\((?!.*Loader)",
    "sql_format": r"(?i)(execute|query)\s*\(\s*f?['\"].*(%s|\{).*(select|insert|update|delete)",
    "weak_hash": r"(?i)\b(md5|sha1)\s*\(",
}


def security_scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, risk)`` of every line that belongs to a class of risky text."""
    classes = F.array_compact(F.array(*[F.when(F.col("line").rlike(rx), F.lit(name)) for name, rx in RISKS.items()]))
    return lines(docs, fences=True).select("doc_id", "pos", F.explode(classes).alias("risk"))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``(key, side)`` of keys that only one side has: ``left_only`` or ``right_only``."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right_only")))
