"""Transcripts and phase markers: tool calls, and whether each required phase left evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Per phase the alternatives that are evidence of it. An alternative is a list of rules that must all
# hold; a rule is a name (a pattern if it starts with ^), patterns of input fields, and how many calls are needed.
EVIDENCE = {
    "1": [[("Agent", {"subagent_type": r"^(Explore|general-purpose)$"}, 1)], [("Read", {"file_path": r"^src/"}, 1)]],
    "1.3": [[("AskUserQuestion", {}, 3)], [("Skill", {"skill": r"grill-(me|with-docs)"}, 1)]],
    "1.5": [[("Read", {"file_path": r"lessons\.md$"}, 1)], [("Bash", {"command": r"git log .*--grep"}, 1)]],
    "2": [[("Skill", {"skill": r"brainstorming"}, 1)]],
    "3": [[("WebFetch", {}, 1)], [("WebSearch", {}, 1)], [("^mcp__.*context7.*", {}, 1)], [("Agent", {"subagent_type": r"^Explore$"}, 1)]],
    "4": [[("Skill", {"skill": r"complexity-router"}, 1)]],
    "4.2": [[("Skill", {"skill": r"plan-(ceo|eng|design)-review"}, 1)]],
    "4.5": [[("Skill", {"skill": r"plan-verification"}, 1)], [("Agent", {"prompt": r"verification|adversarial|6 angles"}, 1)]],
    "5": [[("Agent", {"subagent_type": r"-scribe$"}, 1), ("Agent", {"subagent_type": r"-validator$"}, 1)]],
}


def _field(name: str):
    """Column: a field of the call's input; empty if it is missing, null if it isn't text."""
    value = F.try_variant_get("v", f"$.{name}", "variant")
    return F.when(value.isNull(), F.lit("")).when(F.schema_of_variant(value) == "STRING", F.try_variant_get("v", f"$.{name}", "string"))


def phase_evidence(calls: DataFrame) -> DataFrame:
    """``(log_name, evidence)``: per log a map of each phase to whether its calls ``(log_name, name, input)`` show it.

    ``input`` is JSON; what isn't counts as an input without fields.  All rules are counted in one aggregation.
    """
    def holds(rule) -> object:
        name, fields, need = rule
        hit = F.col("name").rlike(name) if name.startswith("^") else F.col("name") == name
        for field, pattern in fields.items():
            hit = hit & F.coalesce(_field(field).rlike(pattern), F.lit(False))
        return F.count(F.when(hit, 1)) >= need

    def shown(alternatives) -> object:
        out = F.lit(False)
        for rules in alternatives:
            every = F.lit(True)
            for rule in rules:
                every = every & holds(rule)
            out = out | every
        return out

    rows = calls.withColumn("v", F.coalesce(F.try_parse_json("input"), F.parse_json(F.lit("{}"))))
    return rows.groupBy("log_name").agg(F.create_map(*[x for phase, alternatives in EVIDENCE.items() for x in (F.lit(phase), shown(alternatives))]).alias("evidence"))


def tool_calls(transcripts: DataFrame) -> DataFrame:
    """``(doc_id, pos, name, input)`` of every ``tool_use`` object anywhere in the JSON lines of ``(doc_id, text)``.

    Lines that aren't JSON are skipped.  The walk through nested values is recursive, so it runs in Python, in
    Arrow batches.
    """

    def run(batches):
        import json

        import pyarrow as pa

        def walk(x):
            if isinstance(x, dict):
                if x.get("type") == "tool_use" and isinstance(x.get("name"), str):
                    yield x["name"], json.dumps(x.get("input") or {}, sort_keys=True)
                for v in x.values():
                    yield from walk(v)
            elif isinstance(x, list):
                for v in x:
                    yield from walk(v)

        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pos = 0
                for line in (text or "").splitlines():
                    try:
                        found = list(walk(json.loads(line))) if line.lstrip()[:1] in ("{", "[") else []
                    except (ValueError, RecursionError):
                        continue
                    for name, given in found:
                        rows.append((doc, pos, name, given))
                        pos += 1
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "pos", "name", "input"])

    return transcripts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, pos int, name string, input string")


def turns(transcripts: DataFrame) -> DataFrame:
    """``(doc_id, pos, role, content)`` of the JSON lines with a role; other lines are skipped."""
    rows = transcripts.where("text is not null").select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    j = F.from_json("line", "role string, content string", {"mode": "PERMISSIVE"})
    return rows.withColumn("j", j).where("j.role is not null").select("doc_id", "pos", "j.role", "j.content")


def correlate(markers: DataFrame, phases: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """``(log_name, phase_id, marker_status, warning)`` for every log and required phase.

    ``markers(log_name, line_no, phase_id, status, payload)``; the last marker of a phase counts.  Without one
    the status is ``absent``.  ``warning`` is ``no_marker``, ``skipped_without_reason`` or, if ``calls(log_name,
    name, input)`` are given and don't show a done phase, ``no_evidence``.
    """
    # The phases are a fixed short list; every log gets each of them.
    required = phases.where("required").agg(F.collect_set("phase_id")).scalar()
    logs = markers.select("log_name").distinct().withColumn("phase_id", F.explode(required))
    last = markers.groupBy("log_name", "phase_id").agg(F.max_by(F.struct("status", "payload"), "line_no").alias("m"))
    out = logs.join(last, ["log_name", "phase_id"], "left_outer")
    status = F.coalesce("m.status", F.lit("absent"))
    bare = (status == "SKIPPED") & F.coalesce(F.element_at("m.payload", "reason"), F.lit("")).isin("")
    warning = F.when(status == "absent", "no_marker").when(bare, "skipped_without_reason")
    if calls is not None:
        out = out.join(phase_evidence(calls), "log_name", "left_outer")
        seen = F.coalesce(F.try_element_at("evidence", F.col("phase_id")), F.lit(False))
        warning = F.coalesce(warning, F.when((status == "DONE") & ~seen, "no_evidence"))
    return out.select("log_name", "phase_id", status.alias("marker_status"), warning.alias("warning"))
