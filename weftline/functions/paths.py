"""Spelling of paths."""

from __future__ import annotations

from pyspark.sql import functions as F


def canonical_path(path):
    """Column: a path in the spelling of an index, without quotes, outer blanks, backslashes, doubled slashes or ``.`` steps.

    An empty or null path is null.
    """
    p = F.translate(F.trim(F.regexp_replace(F.trim(path), r'^"|"$', "")), "\\", "/")
    p = F.regexp_replace(p, r"/{2,}", "/")
    p = F.regexp_replace(p, r"(?<=^|/)(\./)+", "")
    # Most paths need none of this; plain searches for what does are cheaper than the expressions.
    odd = path.contains('"') | path.contains("\\") | path.contains("//") | path.contains("./") | path.contains(" ")
    p = F.when(odd, p).otherwise(path)
    return F.when(F.length(p) > 0, p)
