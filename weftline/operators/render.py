"""Short texts for people, from rows that are few by their nature."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from weftline.operators.docs import BOARD

#: The version of the JSON envelope.
SCHEMA_VERSION = 1


def summary(progress: DataFrame) -> str:
    """One line per plan: name, status, steps and milestones."""
    rows = progress.orderBy("doc_id").toLocalIterator()
    return "".join(f"{r.doc_id} {r.status} {r.steps_done}/{r.steps} steps {r.milestones_done}/{r.milestones} milestones\n" for r in rows)


def board_text(progress: DataFrame) -> str:
    """Plans under the columns of the board."""
    held: dict[str, list[str]] = {s: [] for s in BOARD}
    for r in progress.orderBy("doc_id").toLocalIterator():
        held.setdefault(r.status, []).append(str(r.doc_id))
    return "".join(f"{s} ({len(held[s])}): {', '.join(held[s])}\n" for s in BOARD)


def tree(items: DataFrame, doc_id: int) -> str:
    """Milestones and steps of one plan, indented."""
    rows = items.where(items["doc_id"] == doc_id).orderBy("pos").collect()
    return "".join(f"{'' if r.kind == 'milestone' else '  '}{r.number} {r.title} [{r.status}]\n" for r in rows)


def envelope(progress: DataFrame) -> str:
    """All plans as JSON with sorted keys."""
    rows = [r.asDict() for r in progress.orderBy("doc_id").toLocalIterator()]
    return json.dumps({"schema_version": SCHEMA_VERSION, "tasks": rows}, sort_keys=True, separators=(",", ":"), default=str) + "\n"


def layers_text(layers: DataFrame, width: int = 80, limit: int = 2000) -> str:
    """The layers of an index as nested lines, each at most ``width`` wide, all at most ``limit`` characters."""
    out = []
    for depth, name in enumerate(("core", "middle", "periphery")):
        rows = layers.where(layers["layer"] == name)
        n = rows.count()
        some = [r.path for r in rows.orderBy(rows["in_degree"].desc(), "path").limit(5).collect()]
        out.append(f"{'  ' * depth}{name} ({n})"[:width])
        out += [f"{'  ' * depth}- {p}"[:width] for p in some]
    return "\n".join(out)[:limit] + "\n"
