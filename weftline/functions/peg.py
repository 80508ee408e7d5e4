"""Packrat parsing of parsing-expression grammars.

Expressions are built from ``lit``, ``pat``, ``balanced``, ``seq``, ``alt``, ``many``, ``opt``, ``ahead``, ``no``,
``cap`` and ``ref``; a named rule is parsed at most once per position.  A parse gives a list of captures ``(name, start, end)`` in
source order, with offsets into the source.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: A parser takes (parse, position) and returns (end, captures) or None.
Result = tuple[int, tuple]
Expression = Callable[["Parse", int], Result | None]


class Parse:
    """One source with its memo table."""

    __slots__ = ("rules", "text", "memo")

    def __init__(self, rules: dict[str, Expression], text: str):
        self.rules, self.text = rules, text
        self.memo: dict[tuple[str, int], Result | None] = {}

    def rule(self, name: str, at: int) -> Result | None:
        key = (name, at)
        if key not in self.memo:
            self.memo[key] = self.rules[name](self, at)
        return self.memo[key]


def lit(text: str) -> Expression:
    return lambda p, i: (i + len(text), ()) if p.text.startswith(text, i) else None


def pat(pattern: str, flags: int = 0, name: str | None = None) -> Expression:
    """A terminal given by a regular expression; with ``name`` or named groups it captures."""
    rx = re.compile(pattern, flags)
    groups = tuple(rx.groupindex)

    def run(p: Parse, i: int) -> Result | None:
        m = rx.match(p.text, i)
        if not m:
            return None
        found = ((name, i, m.end()),) if name else ()
        return m.end(), found + tuple((g, m.start(g), m.end(g)) for g in groups if m.start(g) >= 0)

    return run


def balanced(pairs: str, literals: str) -> Expression:
    """A terminal: the delimiter at this position up to its partner, both included; ``pairs`` reads ``()[]{}``.

    Matches of ``literals`` are passed over.  Nesting is kept on a stack of its own, so it may be of any depth, and
    the ends of nested delimiters go into the memo table, so that no text is read once per level.
    """
    opening = dict(zip(pairs[1::2], pairs[0::2], strict=True))
    opens = frozenset(pairs[0::2])
    rx = re.compile(f"{literals}|[{re.escape(pairs)}]")
    rule = f"balanced {pairs} {literals}"

    def run(p: Parse, i: int) -> Result | None:
        if p.text[i : i + 1] not in opens:
            return None
        if (rule, i) in p.memo:
            return p.memo[rule, i]
        stack = [i]
        for m in rx.finditer(p.text, i + 1):
            piece = m.group()
            if piece in opens:
                stack.append(m.start())
            elif piece in opening:
                if p.text[stack[-1]] != opening[piece]:
                    break
                p.memo[rule, stack.pop()] = m.end(), ()
                if not stack:
                    return m.end(), ()
        p.memo.update(((rule, at), None) for at in stack)
        return None

    return run


def seq(*parts: Expression) -> Expression:
    def run(p: Parse, i: int) -> Result | None:
        found: tuple = ()
        for part in parts:
            got = part(p, i)
            if got is None:
                return None
            i, more = got
            found += more
        return i, found

    return run


def alt(*parts: Expression) -> Expression:
    def run(p: Parse, i: int) -> Result | None:
        for part in parts:
            if (got := part(p, i)) is not None:
                return got
        return None

    return run


def many(part: Expression) -> Expression:
    """Zero or more; a part that consumes nothing ends the repetition."""

    def run(p: Parse, i: int) -> Result:
        found: list = []
        while (got := part(p, i)) is not None and got[0] > i:
            i = got[0]
            found.extend(got[1])
        return i, tuple(found)

    return run


def opt(part: Expression) -> Expression:
    return lambda p, i: part(p, i) or (i, ())


def ahead(part: Expression) -> Expression:
    """Succeeds without consuming where ``part`` does, and keeps its captures."""
    return lambda p, i: (i, got[1]) if (got := part(p, i)) is not None else None


def no(part: Expression) -> Expression:
    return lambda p, i: (i, ()) if part(p, i) is None else None


def ref(name: str) -> Expression:
    return lambda p, i: p.rule(name, i)


def cap(name: str, part: Expression) -> Expression:
    """Capture what ``part`` covers, before its own captures."""

    def run(p: Parse, i: int) -> Result | None:
        got = part(p, i)
        return None if got is None else (got[0], ((name, i, got[0]), *got[1]))

    return run
