"""Python sources into symbols, calls and imports, with the language's own parser, in Arrow batches."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut

SCHEMA = "file_id long, what string, name string, kind string, line int, signature string, docstring string, parent string, target string"

# Built-in callees that never make an edge when called bare.
BUILTINS = frozenset("print len str int float bool list dict set tuple type isinstance issubclass super range enumerate zip map filter sorted reversed open input eval".split())


def _parameter(arg: ast.arg, default: ast.expr | None, stars: str = "") -> str:
    text = stars + arg.arg + (f": {ast.unparse(arg.annotation)}" if arg.annotation else "")
    return text + (f" = {ast.unparse(default)}" if default is not None else "")


def _decorator(node: ast.expr) -> str:
    """What a decorator is called, without its arguments."""
    return ast.unparse(node.func if isinstance(node, ast.Call) and isinstance(node.func, ast.Name | ast.Attribute) else node)


def _signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """Decorators, one a line, then parameters and result; ``self`` and ``cls`` and the bare star are left out."""
    a = node.args
    plain = [*a.posonlyargs, *a.args]
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    parts = [_parameter(x, d) for x, d in zip(plain, defaults, strict=True) if x.arg not in ("self", "cls")]
    parts += [_parameter(a.vararg, None, "*")] if a.vararg else []
    parts += [_parameter(x, d) for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
    parts += [_parameter(a.kwarg, None, "**")] if a.kwarg else []
    head = ("async " if isinstance(node, ast.AsyncFunctionDef) else "") + f"({', '.join(parts)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
    return "\n".join([*(f"@{_decorator(d)}" for d in node.decorator_list), head])


def _calls(node: ast.FunctionDef | ast.AsyncFunctionDef) -> dict[str, str]:
    """What a body calls by name, nested definitions included: ``open`` if it may lie in another file, else ``inner``.

    A bare name that isn't built in, or an attribute of a plain name, may; an attribute of anything else has an
    unknown receiver and only counts if its file has a function of that name.
    """
    found: dict[str, str] = {}
    for x in (y for statement in node.body for y in ast.walk(statement)):
        if not isinstance(x, ast.Call):
            continue
        if isinstance(x.func, ast.Name):
            if x.func.id not in BUILTINS:
                found[x.func.id] = "open"
        elif isinstance(x.func, ast.Attribute):
            if isinstance(x.func.value, ast.Name):
                found[x.func.attr] = "open"
            else:
                found.setdefault(x.func.attr, "inner")
    return found


def parse(text: str) -> list[tuple]:
    """``(what, name, kind, line, signature, docstring, parent, target)`` rows: symbols, calls and imports; none if it doesn't parse.

    Symbols are the functions and classes of the outermost level and the members of classes; imports those of the
    outermost level.  The ``kind`` of a call is ``open`` or ``inner``.
    """
    try:
        tree = ast.parse(text.removeprefix("\ufeff"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [("error", None, None, None, None, None, None, None)]
    out: list[tuple] = []
    summary = lambda x: (ast.get_docstring(x) or "").strip().split("\n")[0].strip() or None
    # Members are taken from a stack, so classes may be nested to any depth.
    todo: list[tuple[ast.AST, str | None]] = [(x, None) for x in reversed(tree.body)]
    while todo:
        x, parent = todo.pop()
        if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
            path = x.name if parent is None else f"{parent}.{x.name}"
            kind = ("async_" if isinstance(x, ast.AsyncFunctionDef) else "") + ("function" if parent is None else "method")
            out.append(("symbol", path, kind, x.lineno, _signature(x), summary(x), parent, None))
            out.extend(("call", path, how, None, None, None, None, c) for c, how in sorted(_calls(x).items()))
        elif isinstance(x, ast.ClassDef):
            path = x.name if parent is None else f"{parent}#{x.name}"
            out.append(("symbol", path, "class", x.lineno, None, summary(x), parent, None))
            todo.extend((y, path) for y in reversed(x.body))
        elif parent is None and isinstance(x, ast.Import):
            out.extend(("import", None, None, x.lineno, None, None, None, a.name) for a in x.names)
        elif parent is None and isinstance(x, ast.ImportFrom):
            out.append(("import", None, None, x.lineno, None, None, None, "." * x.level + (x.module or "")))
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"file_id": pa.int64(), "what": pa.string(), "name": pa.string(), "kind": pa.string(), "line": pa.int32(), "signature": pa.string(), "docstring": pa.string(), "parent": pa.string(), "target": pa.string()}
    for batch in batches:
        rows = [(i, *r) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for r in parse(text)]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))


def parse_python(contents: DataFrame) -> DataFrame:
    """Symbols, calls, imports and errors of ``contents(file_id, content)``; null and empty texts give nothing."""
    return contents.select(F.col("file_id").cast("long").alias("file_id"), "content").mapInArrow(_run, SCHEMA)


def modules(files: DataFrame) -> DataFrame:
    """``(scope, module, file)``: the dotted names of Python files ``(id, path)``; a package's own file has the package's too.

    With a column ``repo`` names hold within one repository.
    """
    dotted = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".")
    package = F.regexp_extract(dotted, r"^(.+)\.__init__$", 1)
    names = F.when(package != "", F.array(dotted, package)).otherwise(F.array(dotted))
    scope = F.col("repo") if "repo" in files.columns else F.lit("")
    return files.where("path like '%.py' and id is not null").select(scope.alias("scope"), F.explode(names).alias("module"), F.col("id").alias("file")).distinct()


def build_index(parsed: DataFrame, files: DataFrame | None = None, scheme: str = "code") -> tuple[DataFrame, DataFrame]:
    """``symbols(id, file_id, name, kind, line, signature, docstring, parent_id)`` and ``edges(src, dst, dst_unresolved, kind)`` of a parse.

    A call leads to every callable of that name in its file; else, if ``files(id, path)`` is given, to every
    symbol of that name in the files that its file imports; else it stays unresolved, unless its receiver is unknown.
    Of symbols with one path in a file the last counts.  With ``files`` symbols also have a ``scip_id`` that holds
    ``scheme`` and the path of the file.  Ids are hashes of file and path in the file, so they don't depend on the order of files.
    """
    key = lambda name: F.xxhash64("file_id", name)
    # Texts are parsed once: symbols, calls and imports are read from a written table.
    parsed = cut(parsed)
    named = parsed.where("what = 'symbol'").groupBy("file_id", F.col("name").alias("at")).agg(F.max_by(F.struct("kind", "line", "signature", "docstring", "parent"), "line").alias("s"))
    parent = F.when(F.col("s.parent").isNotNull(), key(F.col("s.parent")))
    symbols = named.select(key("at").alias("id"), "file_id", F.regexp_extract("at", r"([^.#]*)$", 1).alias("name"), "s.kind", "s.line", "s.signature", "s.docstring", parent.alias("parent_id"), "at")
    # A type that another file declares, such as a receiver's, is no parent here.
    known = symbols.select(F.col("id").alias("parent_id"), F.lit(True).alias("there"))
    symbols = cut(symbols.join(known, "parent_id", "left_outer").withColumn("parent_id", F.when(F.col("there"), F.col("parent_id"))).drop("there"))
    calls = parsed.where("what = 'call'").select(key("name").alias("src"), "file_id", F.col("target").alias("callee"), F.coalesce(F.col("kind") == "open", F.lit(True)).alias("open")).distinct()
    callables = symbols.where("kind <> 'class'").select("file_id", F.col("name").alias("callee"), F.col("id").alias("dst"))
    edges = calls.join(callables, ["file_id", "callee"], "left_outer")
    if files is None:
        edges = edges.where("dst is not null or open")
    else:
        edges = cut(edges)
        inside, beyond = edges.where("dst is not null").select("src", "callee", "dst"), edges.where("dst is null and open").drop("dst")
        targets = imported_files(parsed, files)
        # Only names that an imported file has are joined with the imports; so a file that imports much costs what it uses.
        elsewhere = symbols.select(F.col("file_id").alias("target"), F.col("name").alias("callee"), F.col("id").alias("dst"))
        hits = beyond.join(targets, "file_id").join(elsewhere, ["target", "callee"]).select("src", "callee", "dst")
        hits = cut(hits)
        found = inside.unionByName(hits)
        open_calls = beyond.join(hits.select("src", "callee").distinct(), ["src", "callee"], "left_anti").select("src", "callee", F.lit(None).cast("long").alias("dst"))
        edges = found.unionByName(open_calls)
        marker = F.when(F.col("kind") == "class", "#").when(F.col("kind").endswith("method"), ".").otherwise("/")
        where = files.groupBy(F.col("id").alias("file_id")).agg(F.min("path").alias("path"))
        symbols = symbols.join(where, "file_id", "left_outer").withColumn("scip_id", F.concat(F.lit(f"{scheme} . "), marker, "path", F.lit("#"), "at")).drop("path")
    edges = edges.select("src", "dst", F.when(F.col("dst").isNull(), F.col("callee")).alias("dst_unresolved"), F.lit("call").alias("kind"))
    return symbols.drop("at"), edges.distinct()


def imported_files(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """``(file_id, target)``: the files that the imports of each Python file name, once each."""
    from weftline.operators.relational import resolve_imports

    names = cut(modules(files))
    # One name for each file as the source: the one of its path.
    own = names.groupBy("file", "scope").agg(F.max_by("module", F.length("module")).alias("source"))
    wanted = parsed.where("what = 'import'").select(F.col("file_id").alias("file"), F.regexp_replace("target", r"^\.+", "").alias("import")).where(F.col("import") != "")
    found = resolve_imports(cut(wanted.join(own, "file").distinct()), names)
    ends = names.select("scope", F.col("module").alias("target"), F.col("file").alias("target_file"))
    return found.where("target is not null").join(ends, ["scope", "target"]).select(F.col("file").alias("file_id"), F.col("target_file").alias("target")).distinct()
