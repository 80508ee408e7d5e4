"""Columns over text: enumerated fields, display, hashes and names."""

from __future__ import annotations

from pyspark.sql import functions as F

#: Fixed value: which ending belongs to which language.
ENDINGS = {"py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go", "rs": "rust", "java": "java", "rb": "ruby", "sh": "bash", "bash": "bash"}
#: Fixed value: messages that announce a feature, a fix or a break.
NOTABLE = r"(?i)^(feat|fix)(\([^)]*\))?!?:|BREAKING CHANGE"


def language(path):
    """Column: the language of a path by its ending, without regard to case; null for others."""
    table = F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.(\w+)$", 1)))


def enum_field(text, name: str, allowed: tuple[str, ...]):
    """Column ``struct(value, ok, error)``: the first value of a field line and whether it is one of ``allowed``, with case.

    A field that is absent is in order and has a null value.
    """
    value = F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?m)^[ \t]*-?[ \t]*\*{{0,2}}{name}\*{{0,2}}:\*{{0,2}}[ \t]*(\S.*?)[ \t\r]*$", 1)
    found = F.when(value != "", value)
    error = F.when(found.isNotNull() & ~found.isin(*allowed), F.lit("invalid"))
    return F.struct(found.alias("value"), error.isNull().alias("ok"), error.alias("error"))


def display(text, width: int = 120):
    """Column: text fit to be shown: no control characters, brackets or repeated blanks, at most ``width`` characters."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1f\x7f]+", " "), r"[\[\]<>`]+", "")
    return F.substring(F.trim(F.regexp_replace(plain, r" {2,}", " ")), 1, width)


def preview(text, width: int = 60):
    """Column: the first ``width`` characters, with an ellipsis if that cuts something."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("…"))).otherwise(text)


def normal_text(text):
    """Column: line ends as ``\\n``, no blanks at line ends, no blank lines at the end."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+(?=\n|$)", "")
    return F.regexp_replace(lines, r"\n+$", "")


def text_hash(text, digits: int = 12):
    """Column: the first digits of the SHA-256 of the normalised text."""
    return F.substring(F.sha2(normal_text(text), 256), 1, digits)


def module_name(path):
    """Column: the dotted module of a Python path; a package's ``__init__`` stands for the package."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", "")
    return F.translate(bare, "/", ".")


def first_line(text):
    """Column: the first line, trimmed; null if it is empty."""
    line = F.trim(F.substring_index(F.trim(text), "\n", 1))
    return F.when(line != "", line)


def tail_lines(text, n: int = 5):
    """Column: the last ``n`` lines that aren't blank."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x) != "")
    return F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n)


def head_lines(text, n: int = 30):
    """Column: the first ``n`` lines."""
    return F.slice(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), 1, n)


def names_footer(names, n: int = 3):
    """Column: the first ``n`` names and how many more there are."""
    more = F.size(names) - n
    return F.concat(F.array_join(F.slice(names, 1, n), ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))
