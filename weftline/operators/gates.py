"""Checks around commits and audits: drift, signatures, dirty paths, severities and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Severities of two scanners in four levels, and which checks a profile runs.
LEVELS = {"error": "HIGH", "warning": "MEDIUM", "info": "LOW", "note": "LOW", "critical": "CRITICAL", "high": "HIGH", "medium": "MEDIUM", "moderate": "MEDIUM", "low": "LOW", "blocker": "CRITICAL", "minor": "LOW", "style": "LOW"}
PROFILES = {"light": ("lint",), "standard": ("lint", "tests"), "full": ("lint", "tests", "security", "docs")}


def severity(column):
    """Column: a scanner's word as one of four levels; what can't be read is HIGH."""
    table = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(column))), F.lit("HIGH"))


def verdict(findings: DataFrame, by: str) -> DataFrame:
    """``(by, verdict)``: FAIL with any CRITICAL, PASS WITH WARNINGS with any other above LOW, else PASS."""
    level = severity(F.col("severity"))
    rows = findings.groupBy(by).agg(F.max((level == "CRITICAL").cast("int")).alias("c"), F.max(level.isin("HIGH", "MEDIUM").cast("int")).alias("w"))
    return rows.select(by, F.when(F.col("c") == 1, "FAIL").when(F.col("w") == 1, "PASS WITH WARNINGS").otherwise("PASS").alias("verdict"))


def dispatch(tasks: DataFrame) -> DataFrame:
    """``(task, agent)`` for ``tasks(task, profile)``; an unknown or null profile is standard."""
    table = F.create_map(*[x for name, agents in PROFILES.items() for x in (F.lit(name), F.array(*map(F.lit, agents)))])
    return tasks.select("task", F.explode(F.coalesce(F.try_element_at(table, F.lower("profile")), F.array(*map(F.lit, PROFILES["standard"])))).alias("agent"))


#: Which audits a profile runs (of some only the numbered checks), and the reasons that waive tests first.
AUDITS = ("code-reviewer", "security-auditor", "tdd-sequence", "context7-evidence", "future-proofing")
AUDIT_PROFILES = {
    "full": {a: "" for a in AUDITS},
    "code-only": {a: "" for a in AUDITS},
    "docs-only": {"future-proofing": "1"},
    "infra": {"code-reviewer": "", "security-auditor": "", "future-proofing": "1,3"},
}
TDD_WAIVERS = ("refactor", "docs-only", "prototype", "hotfix-emergency", "tooling-config")


def audit_dispatch(milestones: DataFrame) -> DataFrame:
    """``(milestone, audit, checks)`` of ``milestones(milestone, profile, run, skip)``; ``checks`` is empty where all are made.

    The profile ``custom`` runs the audits listed in ``run`` less those in ``skip``, lists with commas; without ``run`` all
    but those in ``skip``.  A null profile, or one that isn't known, gives no rows: it is for ``enum_field`` to report.
    """
    plans = [F.when(F.lower(F.trim("profile")) == name, F.array(*[F.struct(F.lit(a).alias("audit"), F.lit(c).alias("checks")) for a, c in audits.items()])) for name, audits in AUDIT_PROFILES.items()]
    words = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x))
    every = F.array(*map(F.lit, AUDITS))
    named = F.when(F.trim(F.coalesce("run", F.lit(""))) == "", every).otherwise(F.array_intersect(every, words("run")))
    own = F.transform(F.array_except(named, words("skip")), lambda a: F.struct(a.alias("audit"), F.lit("").alias("checks")))
    chosen = F.coalesce(*plans, F.when(F.lower(F.trim("profile")) == "custom", own))
    return milestones.select("milestone", F.explode(chosen).alias("a")).select("milestone", "a.audit", "a.checks")


def scope_counts(paths: DataFrame, by: str) -> DataFrame:
    """``(by, total, py, sh)``: changed files by ending."""
    count = lambda e: F.count(F.when(F.col("path").endswith(e), 1))
    return paths.groupBy(by).agg(F.count("path").alias("total"), count(".py").alias("py"), count(".sh").alias("sh"))


def stale_tasks(active: DataFrame, commits: DataFrame, commit_files: DataFrame, threshold: int = 3, bypass: str = "[skip-drift]") -> DataFrame:
    """``(sha, task)``: active tasks none of whose files a commit touches, for commits beyond ``threshold`` files without the bypass mark.

    ``active(repo, task, prefix)``, ``commits(sha, repo, message)``, ``commit_files(sha, path)``.
    """
    large = commit_files.groupBy("sha").agg(F.count("*").alias("n")).where(F.col("n") > threshold)
    due = commits.where(~F.coalesce("message", F.lit("")).contains(bypass)).join(large, "sha").select("sha", "repo").join(active, "repo")
    touched = commit_files.join(due.select("sha", "task", "prefix"), "sha").where(F.col("path").startswith(F.col("prefix"))).select("sha", "task").distinct()
    return due.select("sha", "task").distinct().join(touched, ["sha", "task"], "left_anti")


def signed(commits: DataFrame, active: DataFrame, bypass: str = "[no-plan]") -> DataFrame:
    """``(sha, ok)``: whether a message names an active task in brackets after ``Plan:``, or bears the bypass mark."""
    names = F.regexp_extract_all(F.coalesce("message", F.lit("")), F.lit(r"Plan:\s*\[?([\w-]+)\]?"), F.lit(1))
    rows = commits.select("sha", "repo", F.coalesce("message", F.lit("")).contains(bypass).alias("free"), names.alias("names"))
    named = rows.select("sha", "repo", F.explode("names").alias("task")).join(active.select("repo", "task"), ["repo", "task"], "left_semi").select("sha").distinct().withColumn("hit", F.lit(True))
    return rows.join(named, "sha", "left_outer").select("sha", (F.col("free") | F.coalesce("hit", F.lit(False))).alias("ok"))


def dirty_tasks(dirty: DataFrame, tasks: DataFrame) -> DataFrame:
    """``(task, path)`` of dirty paths below a task's folder; equal folders meet by every leading part of the path, not by comparing all pairs."""
    depth = F.size(F.split("path", "/")) - 1
    parts = dirty.where("path is not null").withColumn("folder", F.explode(F.expr("transform(sequence(1, greatest(size(split(path, '/')) - 1, 1)), i -> array_join(slice(split(path, '/'), 1, i), '/'))"))).where(depth > 0)
    return parts.join(tasks.select("task", F.rtrim(F.col("prefix"), F.lit("/")).alias("folder")), "folder").select("task", "path")


def bench_report(runs: DataFrame) -> DataFrame:
    """``(tool, budget, tokens, symbols, per_symbol, status)``: medians of trials cut to integers, and the worst status.

    ``runs(tool, budget, tokens, symbols, status)``.
    """
    rank = F.when(F.col("status") == "error", 3).when(F.col("status") == "skipped", 2).otherwise(1)
    out = runs.groupBy("tool", "budget").agg(
        F.coalesce(F.percentile("tokens", 0.5).cast("long"), F.lit(0)).alias("tokens"), F.coalesce(F.percentile("symbols", 0.5).cast("long"), F.lit(0)).alias("symbols"), F.max(rank).alias("r")
    )
    per = F.when(F.col("symbols") > 0, F.round(F.col("tokens") / F.col("symbols"), 1))
    return out.select("tool", "budget", "tokens", "symbols", per.alias("per_symbol"), F.element_at(F.array(F.lit("ok"), F.lit("skipped"), F.lit("error")), F.col("r")).alias("status"))
