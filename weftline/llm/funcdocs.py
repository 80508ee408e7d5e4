"""Functions paired with their documentation.

Two kinds of packrat grammars do the work.  One per language (``sources.code_grammars``, which the code index uses
too) finds functions in source text with the comment or string that documents them, keeping offsets.  One for
documentation itself splits it into sentences, described and bare tags, notes, directives, code and rulers.  A pair
is kept if a sentence or a tag's description holds a word that name, signature and filler don't account for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.peg import Expression, Parse, alt, many, pat, ref, seq
from weftline.sources.code_grammars import declarations, with_language

KINDS = ("function", "method", "async_function", "async_method")

def source_functions(text: str | None, language: str | None) -> list[tuple[str, int, str, str | None, int, int]]:
    """``(name, line, signature, documentation, start, end)`` of every function, in source order; offsets span header and body."""
    return [(d.name, d.line, d.signature, d.doc, d.start, d.stop) for d in declarations(text, language) if d.what == "function"]


# ---------------------------------------------------------------------------------------------------------
# Grammar of documentation
# ---------------------------------------------------------------------------------------------------------

_MARGIN = r"[ \t]*(?:/\*\*?!?|\*/|\*(?!\*)|//[/!]?|\#+(?![a-z])!?|\"{3}|'{3})*[ \t]*"
_END = r"[ \t]*(?:\*/|\"{3}|'{3})?[ \t]*(?=\n|$)"
# Words that mark notes, directives to tools, and statements about authorship, licence or version.
_NOTE = r"(?:TODO|FIXME|XXX|xxx|HACK|NOTE TO SELF|TBD|WIP|todo|fixme|ToDo|Todo)\b"
_DIRECTIVE = (
    r"(?:(?:eslint|tslint|jshint|jscs|prettier|biome|istanbul|c8|v8|webpack|rubocop|pylint|pyright|mypy|flake8|ruff|isort|black|yapf|noinspection|checkstyle|spotless|clang-format|shellcheck|nolint|lint|golangci|gosec|"
    r"coverage|pragma|go:|\+build|fmt|swagger|region|endregion|sourcery|bandit|nosec|noqa|type|ts)(?=[\s:=-]|$)|\#?(?:end)?region\b|@ts-|@formatter|@SuppressWarnings|\{@inheritDoc\}|@inheritdoc|@inheritDoc|@override|@Override|@hidden|@internal|@ignore|@private|@public|@api\b|@nodoc)"
)
_LEGAL = (
    r"(?:\(c\)|©|copyright\b|licen[cs]ed?\b|spdx|all rights reserved|@?authors?\b\s*:?|@?maintainers?\b\s*:?|@?since\b\s*:?\s*v?\d|@?version\b\s*:?\s*v?\d|@copyright|@licen[cs]e|@date|(?:written|created|contributed|added|modified|changed|maintained|authored) (?:by|on|in)\b|"
    r"last (?:modified|updated|changed)|introduced in\b|added in\b|deprecated since\b|@deprecated\s*$|v?\d+\.\d+(?:\.\d+)?\s*$)"
)
_TAG = r"(?:@(?:param|arg|argument|return|returns|throws|throw|exception|raises|raise|yields?|type|rtype|see|link|typeparam|template|property|prop)|:(?:param|arg|type|return|returns|rtype|raises|raise|yields?|keyword|var|ivar))"

DOC_RULES: dict[str, Expression] = {
    "text": many(seq(pat(_MARGIN), alt(ref("blank"), ref("ruler"), ref("legal"), ref("directive"), ref("tag"), ref("code"), ref("prose")))),
    "blank": pat(_END + r"(?:\n|$)"),
    "ruler": seq(pat(r"(?:[^\w\n]{3,}[ \t]*[\w ]{0,40}[ \t]*[^\w\n]{3,}|[^\w\n]+)" + _END), pat(r"\n|$")),
    "legal": seq(pat(_LEGAL + r"[^\n]*", re.I), pat(r"\n|$")),
    "directive": seq(pat(_DIRECTIVE + r"[^\n]*"), pat(r"\n|$")),
    "tag": seq(pat(_TAG), pat(r"[ \t]*"), alt(pat(r"\{[^}\n]*\}[ \t]*"), pat("")), pat(r"(?P<tag>[^\n]*)"), pat(r"\n|$")),
    "code": seq(
        pat(
            r"(?:(?:signature|usage|example|prototype)\s*:?\s+)?(?:(?:(?:pub|async|export|static|public|private|protected|final|abstract)\s+)*(?:function|def|func|fn|class|interface|struct)\s+[\w(*][^\n]*|return\s+[\w.]+|(?:if|for|while|switch)\s*\([^\n]*|(?:return|const|let|var|import|from|raise|throw)\b[^\n]*[;()={}][^\n]*|"
            r"[\w.$]+\s*\([^()\n]*\)(?:\s*(?:->|:)\s*[\w\[\], .|<>]+)?\s*[;{]?|[\w.$\[\]]+\s*(?:=|:=|\+=|==)\s*[^\n]+|[^\n]*[;{}]|<[^>\n]+>[^\n]*|>>>[^\n]*|\$ [^\n]*)"
            + _END, re.I,
        ),
        pat(r"\n|$"),
    ),
    "prose": seq(many(alt(seq(pat(_NOTE), pat(r"[^\n]*")), pat(r"(?P<sentence>(?:(?!" + _NOTE + r")[^\n.!?…。]|[.!?](?=\w))+)[.!?…。]*[ \t]*"), pat(r"[.!?…。]+[ \t]*"))), pat(r"\n|$")),
}

# Function words and words that say nothing about a function in particular.
FILLER = frozenset(
    """a an the this that these those it its of to in on at by for from with without as and or nor not no is are be been being was were will shall should would can could may might must do does did has have had
    here there where when which who whom whose what how if then than so such just only also very each all any some one into out up down over under about above below
    function functions method methods func fn def procedure routine helper helpers utility util utilities class object instance constructor getter setter accessor accessors member callback handler wrapper implementation
    return returns returned returning result results value values output outputs input inputs argument arguments arg args param params parameter parameters type types name names given passed specified provided corresponding
    get gets set sets getter handle handles perform performs execute executes run runs do process processes implement implements call calls called used use uses using make makes
    description describe describes summary docstring docstrings doc docs documentation document documented undocumented comment comments missing add please some before next release available none null undefined nil void empty placeholder
    write written generated generate generates auto automatically template filled fill yet been stub default todo tbd fixme wip see also parent above same internal main current new simple basic following
    signature usage example none n/a na string int integer number boolean bool float list dict map array self cls error exception errors exceptions n javadoc non
    section region internals internal inherited inherit public private helper boilerplate ditto idem etc thing things stuff something
    der die das ein eine einen und oder zu für von mit methode funktion gibt zurück ergebnis""".split()
)
_PLACEHOLDER = re.compile(
    r"(?:missing|no|without|needs?|lacks?) (?:doc|description|comment)|(?:doc\w*|description|comment)s? (?:is |are |of this \w+ (?:is )?)?(?:missing|pending|needed|to follow|goes? here|here|todo|tbd)|auto[- ]?generated|generated (?:from|by) |not (?:yet )?(?:been )?(?:documented|filled|written)|"
    r"(?:add|insert|write|enter|your) (?:a |the )?(?:\w+ )?(?:doc|description|comment)|lorem ipsum|to be (?:documented|written|done|added)|coming soon|self[- ]explanatory|what it says",
    re.I,
)
#: A bare reference says nothing, but what follows it may.
_SEE = re.compile(r"^see (?:also |the )*(?:parent|super|base|above|interface)?(?: \w+)?$|^see (?:also )?[`\w.(){}]+$", re.I)
#: What closes a comment or string, where it stands behind text.
_CLOSING = re.compile(r"[ \t]*(?:\*/|\"{3}|'{3})[ \t]*(?=\n|$)")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|(?<!\w)\d+(?:\.\d+)?")
_SPLIT = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """A word without its ending of number or tense, crude but equal for the forms of one word."""
    w = word.lower()
    for end, put in (("ies", "y"), ("sses", "ss"), ("shes", "sh"), ("ches", "ch"), ("xes", "x"), ("zzes", "z"), ("izes", "ize")):
        if w.endswith(end) and len(w) > len(end) + 1:
            return w[: -len(end)] + put
    if w.endswith("s") and not w.endswith(("ss", "us", "is")) and len(w) > 3:
        w = w[:-1]
    for end in ("ing", "ed"):
        if w.endswith(end) and len(w) > len(end) + 2:
            w = w[: -len(end)]
            if len(w) > 2 and w[-1] == w[-2] and w[-1] not in "ls":
                w = w[:-1]
            break
    return w[:-1] if w.endswith("e") and len(w) > 3 else w


def informative(doc: str | None, name: str | None, signature: str | None) -> bool:
    """Whether the documentation says something about the function that its name and signature don't say already."""
    if not doc or not doc.strip():
        return False
    own = {stem(w) for w in _SPLIT.findall(f"{name or ''} {signature or ''}")}
    whole = {(name or "").lower().replace("_", "")}
    text = _CLOSING.sub("", doc.replace("\r\n", "\n").replace("\r", "\n"))
    got = Parse(DOC_RULES, text).rule("text", 0)
    hollow = -1
    for kind, a, b in got[1] if got else ():
        part = text[a:b].strip().strip("*/ \t").rstrip(":")
        if not part or a < hollow or _SEE.match(part):
            continue
        if _PLACEHOLDER.search(part):
            # What follows on the line is about the missing documentation too.
            hollow = text.find("\n", a) if "\n" in text[a:] else len(text)
            continue
        named: set[str] = set()
        if kind == "tag":
            # The first word of most tags is the parameter's name; it can't be told from a description otherwise.
            first, _, part = part.partition(" ")
            named = {stem(w) for w in _SPLIT.findall(first)} | {w for w in _WORDS.findall(first) if w.isdigit()}
        bare = part.strip("`'\"“”.,:;()[]{}<> ")
        if not bare or (" " not in bare and (bare.lower().replace("_", "") in whole or re.fullmatch(r"\w*[_.]\w*|\w+\(.*\)|[a-z]+[A-Z]\w*", bare))):
            continue
        words = _WORDS.findall(re.sub(r"`[^`]*`|\b\w+\([^()]*\)", lambda m: m.group() if m.group().strip("`") != (name or "") else " ", part))
        fresh = 0
        for w in words:
            low = w.lower()
            if low in FILLER or stem(low) in named or low in named or (own and all(stem(x) in own for x in _SPLIT.findall(w)) and _SPLIT.findall(w)):
                continue
            if low.replace("_", "") in whole:
                continue
            fresh += 1
        if fresh:
            if kind == "tag" and fresh < 2:
                continue
            return True
    return False


# ---------------------------------------------------------------------------------------------------------
# Operators
# ---------------------------------------------------------------------------------------------------------


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"file_id": pa.int64(), "name": pa.string(), "line": pa.int32(), "signature": pa.string(), "doc": pa.string(), "start": pa.int32(), "stop": pa.int32(), "code": pa.string()}
    for batch in batches:
        rows = []
        for file_id, language, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            text = text and text.replace("\r\n", "\n")
            rows.extend((file_id, n, line, s, _unquoted(d) if language == "python" else d, a, b, text[a:b]) for n, line, s, d, a, b in source_functions(text, language))
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))


def _unquoted(literal: str | None) -> str | None:
    """A string without its quotes."""
    if literal is None:
        return None
    width = 3 if literal[:3] in ('"""', "'''") and len(literal) >= 6 else 1
    return literal[width:-width]


def functions_in_source(files: DataFrame, contents: DataFrame, lang_map: DataFrame) -> DataFrame:
    """``(file_id, name, line, signature, doc, start, stop, code)`` of every function in the source texts.

    Offsets count characters of the text with ``\\r\\n`` read as ``\\n``.  Files of unknown extension and null
    texts give nothing; of different texts of one file the smallest counts.
    """
    texts = contents.where("content is not null and file_id is not null").groupBy("file_id").agg(F.min("content").alias("content"))
    rows = texts.join(with_language(files, lang_map), "file_id").select("file_id", "language", "content")
    return rows.mapInArrow(_extract, "file_id long, name string, line int, signature string, doc string, start int, stop int, code string")


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, names, signatures = (batch.column(i).to_pylist() for i in (1, 2, 3))
        keep = pa.array([informative(d, n, s) for d, n, s in zip(docs, names, signatures, strict=True)], pa.bool_())
        yield batch.filter(keep)


def _functions(symbols: DataFrame) -> DataFrame:
    """Functions and methods with a signature, once each."""
    kind = F.translate(F.lower(F.trim("kind")), "- ", "__")
    rows = symbols.where(kind.isin(*KINDS) & F.col("id").isNotNull() & (F.trim("signature") != ""))
    # An id without documentation in its smallest row may have it in another.
    some = F.when(F.trim("docstring") != "", F.col("docstring")).alias("docstring")
    once = rows.groupBy("id").agg(F.coalesce(F.min(F.when(some.isNotNull(), F.struct(some, "name", "signature", "file_id", "line"))), F.min(F.struct(some, "name", "signature", "file_id", "line"))).alias("s"))
    return once.select("id", "s.docstring", "s.name", "s.signature", F.col("s.file_id").cast("long").alias("file_id"), F.col("s.line").cast("int").alias("line"))


def documented_functions(symbols: DataFrame) -> DataFrame:
    """``(id, docstring, name, signature, file_id, line)`` of functions and methods whose documentation says something.

    Kinds are compared without case, blanks and the kind of dash.  Symbols without id, signature or
    documentation don't count; of rows with one id the smallest counts.
    """
    return _functions(symbols).where("docstring is not null").mapInArrow(_judge, "id long, docstring string, name string, signature string, file_id long, line int")


_CLEAN = r"(?m)^[ \t]*(?:/\*\*?|\*/|\*|//[/!]?|#+)[ \t]?|[ \t]*\*/[ \t]*$"


def emitted_pairs(symbols: DataFrame, files: DataFrame, contents: DataFrame, lang_map: DataFrame) -> DataFrame:
    """``(id, doc, name, signature, code, start, stop, origin)``: every candidate with the documentation to be judged.

    A symbol meets the function of its name and line in its file's text, else the nearest one by line that no other
    symbol has for its own, the earlier one in a tie; one without a line meets the first of these.  If that function
    has a comment or string of its own that isn't blank, that is the documentation and ``origin`` is ``source``.
    Where there is no text, the text has no such function (it is cut off or in another language) or none documented,
    it is the symbol's ``docstring`` and ``origin`` is ``symbol``; without the function ``code`` is the signature and
    the offsets are null.  Symbols without documentation are no candidates, but have functions for their own.
    """
    found = functions_in_source(files, contents, lang_map)
    asked = _functions(symbols)
    f = F.struct("line", "doc", "start", "stop", "code")
    kind = found.select(f.alias("f")).schema["f"].dataType
    # What has no name or file meets nothing, and would be one huge group.
    placed = F.col("name").isNotNull() & F.col("file_id").isNotNull()
    alone = asked.where(~placed).withColumn("f", F.lit(None).cast(kind))
    # Symbols and functions of one name in one file, in the order of their lines, instead of all their pairs.
    both = asked.where(placed).withColumn("f", F.lit(None).cast(kind)).unionByName(found.select("name", "file_id", "line", f.alias("f")), allowMissingColumns=True)
    # One shuffle serves both kinds of windows.
    both = both.repartition("file_id", "name")
    order = Window.partitionBy("file_id", "name").orderBy(F.col("line").asc_nulls_first(), F.col("f.start").asc_nulls_first())
    same = Window.partitionBy("file_id", "name", "line")
    own, free = F.first("f", ignorenulls=True).over(same), F.when(F.max("id").over(same).isNull(), F.col("f"))
    met = both.withColumn("own", own).withColumn("free", free)
    before = F.last("free", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("free", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    met = met.withColumn("before", before).withColumn("after", after).where("docstring is not null")
    nearer = F.coalesce(F.col("after.line") - F.col("line") < F.col("line") - F.col("before.line"), F.col("before").isNull())
    met = met.withColumn("f", F.coalesce("own", F.when(nearer, F.col("after")).otherwise(F.col("before")))).drop("own", "free", "before", "after")
    met = met.unionByName(alone.where("docstring is not null"))
    doc = F.when(F.trim(F.regexp_replace("f.doc", r"\s+", " ")) != "", F.col("f.doc"))
    return met.select(
        "id", F.coalesce(doc, "docstring").alias("doc"), "name", "signature", F.coalesce("f.code", "signature").alias("code"), F.col("f.start").alias("start"), F.col("f.stop").alias("stop"),
        F.when(doc.isNotNull(), "source").otherwise("symbol").alias("origin"),
    )


def code_description_pairs(symbols: DataFrame, files: DataFrame, contents: DataFrame, lang_map: DataFrame) -> DataFrame:
    """``(id, name, code, description, start, stop, origin)``: the emitted pairs whose documentation says something."""
    pairs = emitted_pairs(symbols, files, contents, lang_map)
    kept = pairs.mapInArrow(_judge, "id long, doc string, name string, signature string, code string, start int, stop int, origin string")
    return kept.select("id", "name", "code", F.regexp_replace(F.regexp_replace("doc", _CLEAN, ""), r"^\s+|\s+$", "").alias("description"), "start", "stop", "origin")
