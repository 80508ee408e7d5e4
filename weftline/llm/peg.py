"""Packrat parsing; the parser itself serves the code index too and lies in the core."""

from weftline.functions.peg import Expression, Parse, ahead, alt, balanced, cap, lit, many, no, opt, pat, ref, seq

__all__ = ["Expression", "Parse", "ahead", "alt", "balanced", "cap", "lit", "many", "no", "opt", "pat", "ref", "seq"]
