"""Names, aliases and guards of the index queries, and a small command line.

``python -m weftline.api SNAPSHOT TOOL ARGUMENT...`` prints JSON and ends with 1 if the answer is an error.
"""

from __future__ import annotations

import inspect
import json
import re
import sys
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import relational
from weftline.operators.context import ranked_symbols
from weftline.operators.graph import shortest_path
from weftline.sources.snapshots import SnapshotStore

#: Fixed value: what a symbol argument may hold.
ARGUMENT = re.compile(r"[A-Za-z0-9_./\\-]{1,256}")
#: Characters of an answer: tokens of the budget times four.
CHARS_PER_TOKEN = 4


class BadArgument(ValueError):
    """An argument that no query takes."""


def symbol_argument(value: object) -> str:
    """A symbol name, or ``BadArgument``."""
    if not isinstance(value, str) or not ARGUMENT.fullmatch(value) or ".." in value:
        raise BadArgument(f"not a symbol name: {str(value)[:60]!r}")
    return value


def path_argument(value: object) -> str:
    """A path that stays below its root, or ``BadArgument``."""
    if not isinstance(value, str) or not value or "\0" in value or len(value) > 4096:
        raise BadArgument("not a path")
    path = PurePosixPath(value)
    if path.is_absolute() or ".." in path.parts:
        raise BadArgument(f"outside of the root: {value[:60]!r}")
    return value


def fit(rows: list[dict], budget: int) -> tuple[list[dict], bool]:
    """The longest prefix of the rows whose JSON text stays within the budget, and whether something was cut."""
    cap, used = max(budget, 1) * CHARS_PER_TOKEN, 2
    for i, row in enumerate(rows):
        used += len(json.dumps(row, default=str)) + (2 if i else 0)
        if used > cap:
            return rows[:i], True
    return rows, False


def _chain(t: dict[str, DataFrame], source: str, target: str, max_depth: int = 5) -> DataFrame:
    ends = lambda n: t["symbols"].where(t["symbols"]["name"] == n)
    return shortest_path(t["edges"].where("kind = 'call'"), ends(source), ends(target), max_depth)


TOOLS: dict[str, Callable[..., DataFrame]] = {
    "who_calls": lambda t, name, max_depth=3: relational.who_calls(t["symbols"], t["files"], t["edges"], name, max_depth).orderBy("file", "line", "name"),
    "blast_radius": lambda t, name, max_depth=3: relational.blast_radius(t["symbols"], t["files"], t["edges"], name, max_depth).orderBy("file", "line", "name"),
    "dead_code": lambda t: relational.dead_code(t["symbols"], t["files"], t["edges"]).orderBy("file", "line"),
    "dependency_chain": _chain,
    "search_symbols": lambda t, query: relational.search_symbols(t["symbols"], t["files"], query).orderBy("rank", "name", "file", "line"),
    "file_summary": lambda t, path: relational.file_summary(t["symbols"], t["files"], path).orderBy("line", "id"),
    "co_changes": lambda t, path: relational.co_changes(t["files"], t["symbols"], t["edges"], t["commit_files"], path, exclude=("CHANGELOG.md", "README.md")),
    "owners": lambda t, path: relational.owners(t["ownership"], t["files"], path).orderBy(F.desc("percentage"), "author"),
    "symbol_history": lambda t, name: relational.symbol_history(t["symbols"], t["files"], t["commits"], t["commit_files"], name).orderBy("path"),
    "layers": lambda t: relational.layers(t["edges"], t["symbols"], t["files"]).orderBy(F.desc("in_degree"), "path"),
    "hot_spots": lambda t, window_days=90, top_n=10: relational.hot_spots(t["files"], t["symbols"], t["commits"], t["commit_files"], datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S"), int(window_days), int(top_n)),
    "intel": lambda t: ranked_symbols(t["symbols"], t["files"], t["edges"]).orderBy("pos"),
    "status": lambda t: relational.status_counts(t["files"], t["symbols"], t["edges"]),
}
#: How each parameter is checked before any relation is read.
GUARDS = {"name": symbol_argument, "query": symbol_argument, "source": symbol_argument, "target": symbol_argument, "path": path_argument}
ALIASES = {"find_references": "who_calls", "find_dead_code": "dead_code"}
RELATIONS = ("files", "symbols", "edges", "commits", "commit_files", "ownership")


class _Relations(dict):
    def __init__(self, read: Callable[[str], DataFrame]):
        super().__init__()
        self._read = read

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self._read(name)
        return self[name]


def answer(relations: dict[str, DataFrame], tool: str, *args, budget: int = 8000, **named) -> dict:
    """``{rows, truncated, error}``: a query by name or alias, cut to the budget. Bad arguments give an error, not an exception.

    Only as many rows come to the driver as the budget can hold: a row takes 40 characters at least.
    """
    name = ALIASES.get(tool, tool)
    if name not in TOOLS:
        return {"rows": [], "truncated": False, "error": f"unknown tool: {tool[:60]}"}
    try:
        bound = inspect.signature(TOOLS[name]).bind(relations, *args, **named)
        for parameter, value in bound.arguments.items():
            GUARDS.get(parameter, lambda v: v)(value)
    except (BadArgument, TypeError) as e:
        return {"rows": [], "truncated": False, "error": str(e)}
    found = TOOLS[name](*bound.args, **bound.kwargs)
    most = max(budget, 1) * CHARS_PER_TOKEN // 40 + 1
    rows = [r.asDict(recursive=True) for r in found.limit(most + 1).collect()]
    kept, cut = fit(rows, budget)
    return {"rows": kept, "truncated": cut, "error": None}


def main(argv: list[str]) -> int:
    if len(argv) < 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.getOrCreate()
    store = SnapshotStore(spark, argv[0])
    out = answer(_Relations(store.read), argv[1], *argv[2:])
    print(json.dumps(out, default=str, sort_keys=True))
    return int(out["error"] is not None)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
