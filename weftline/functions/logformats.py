"""Lexer and weighted grammar of log lines, and the reading of their fields."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime, timedelta, timezone

from weftline.functions.earley import Grammar, Rule

# Spellings of levels, of keys in structured lines, and of months.
LEVELS = {
    "debug": "DEBUG", "dbg": "DEBUG", "trace": "DEBUG", "info": "INFO", "inf": "INFO", "notice": "INFO", "warn": "WARN", "warning": "WARN", "wrn": "WARN",
    "error": "ERROR", "err": "ERROR", "fatal": "FATAL", "ftl": "FATAL", "critical": "FATAL", "crit": "FATAL", "panic": "FATAL",
}
LETTERS = {"D": "DEBUG", "I": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL", "C": "FATAL"}
KEYS = {
    "ts": "TIMEKEY", "time": "TIMEKEY", "timestamp": "TIMEKEY", "@timestamp": "TIMEKEY", "level": "LEVELKEY", "lvl": "LEVELKEY", "severity": "LEVELKEY",
    "component": "COMPKEY", "logger": "COMPKEY", "caller": "COMPKEY", "msg": "MSGKEY", "message": "MSGKEY",
}
#: Words by which lines below an entry are known.
BELOW = {"at": "AT", "caused": "CAUSED", "by": "BY", "traceback": "TRACEBACK", "file": "FILE", "line": "LINE", "more": "MORE"}
#: Fixed value: the levels of the eight severities of a syslog priority.
SEVERITIES = ("FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG")
MONTHS = {m: i for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}

_TOKEN = re.compile(
    r"""(?P<ESC>\x1b\[[0-9;]*[A-Za-z])
    |(?P<CLF>\d\d/[A-Z][a-z]{2}/\d{4}:\d\d:\d\d:\d\d)
    |(?P<DATE>\d{4}[-/]\d\d[-/]\d\d)
    |(?P<TIME>\d\d:\d\d:\d\d(?:[.,]\d+)?)
    |(?P<ZONE>[+-]\d\d:?\d\d(?!\d)|Z(?!\w))
    |(?P<SHORT>[DIWEFC]\d{4}(?=\s))
    |(?P<MILLIS>\d{13}(?![\d.]))
    |(?P<SECONDS>\d{10}(?:\.\d+)?(?![\d.]))
    |(?P<PHASE>PHASE_\d[\w.]*)
    |(?P<INT>\d+)
    |(?P<STRING>"(?:[^"\\]|\\.)*")
    |(?P<T>T(?=\d\d:))
    |(?P<NAME>[A-Za-z_](?:[\w.-]*\w)?)
    |(?P<WS>[ \t]+)
    |(?P<MARK>[][(){}|:=,—–-])
    |(?P<OTHER>.)""",
    re.X | re.S,
)
_STAMP = re.compile(r"\d{4}[-/]\d\d[-/]\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?\s?(?:Z|[+-]\d\d:?\d\d)?|\d{13}|\d{10}(?:\.\d+)?")
_CLASSES: dict[str, tuple[str, ...]] = {}


def _classes(kind: str, text: str) -> tuple[str, ...]:
    """The terminals that a token can stand for."""
    if kind == "MARK":
        return ("DASH",) if text in "—–" else (text, "DASH") if text == "-" else (text,)
    if kind == "NAME":
        out = ["NAME"]
        if text.lower() in LEVELS:
            out.append("LEVEL")
        if text.lower() in KEYS:
            out.append(KEYS[text.lower()])
        if text.lower() in BELOW:
            out.append(BELOW[text.lower()])
        if text in MONTHS:
            out.append("MONTH")
        if text.isupper():
            out.append("UPPER")
        return tuple(out)
    if kind == "STRING":
        inner, out = text[1:-1], ["STRING"]
        if inner.lower() in KEYS:
            out.append("Q" + KEYS[inner.lower()])
        if inner.lower() in LEVELS:
            out.append("QLEVEL")
        if _STAMP.fullmatch(inner):
            out.append("QSTAMP")
        return tuple(out)
    return (kind,)


RULES: list[Rule] = [
    # Weights are scores of the layouts: the more fields a rule explains, the higher.
    ("line", ("marker",), 9),
    ("line", ("plain",), 8),
    ("line", ("pairs",), 2),
    ("line", ("object",), 4),
    ("line", ("{",), 1),
    ("line", ("member_line",), 1),
    ("line", ("}",), 1),
    ("marker", ("[", "stamp", "]", "WS", "phase", "WS", "status"), 0),
    ("phase", ("PHASE",), 0),
    ("status", ("UPPER",), 0),
    ("plain", ("stamp", "WS", "level", "WS", "comp", ":"), 0),
    ("plain", ("stamp", "WS", "|", "WS", "comp", "WS", "|", "WS", "level", "WS", "|"), 0),
    ("plain", ("stamp", "WS", "level", "WS", "(", "comp", ")"), 0),
    ("plain", ("[", "stamp", "]", "WS", "[", "level", "]", "WS", "[", "comp", "]"), 0),
    ("plain", ("short", "WS", "TIME", "WS", "INT", "WS", "comp", ":", "INT", "]"), 0),
    ("plain", ("dated", "WS", "NAME", "WS", "comp", "[", "INT", "]", ":", "WS", "level", ":"), 0),
    ("plain", ("dated", "WS", "NAME", "WS", "comp", ":", "WS", "level", ":"), 0),
    ("plain", ("level", "WS", "stamp", "WS", "comp", "WS", "-"), 0),
    ("plain", ("stamp", "WS", "level", "WS", "[", "NAME", "]", "WS", "comp", "WS", "-"), 0),
    ("plain", ("stamp", "WS", "[", "NAME", "]", "WS", "level", "WS", "comp", "WS", "-"), 0),
    ("plain", ("stamp", "WS", "-", "WS", "comp", "WS", "-", "WS", "level", "WS", "-"), 0),
    ("plain", ("OTHER", "priority", "OTHER", "INT", "WS", "stamp", "WS", "label", "WS", "comp", "WS", "label", "WS", "label"), 0),
    ("priority", ("INT",), 0),
    ("label", ("NAME",), 0),
    ("label", ("INT",), 0),
    ("label", ("-",), 0),
    # Lines below an entry: what traces consist of, and anything indented.
    ("line", ("frame",), 0.5),
    ("line", ("indented",), 0),
    ("frame", ("WS", "AT", "WS", "NAME"), 0),
    ("frame", ("CAUSED", "WS", "BY", ":"), 0),
    ("frame", ("TRACEBACK", "WS", "("), 0),
    ("frame", ("WS", "FILE", "WS", "STRING", ",", "WS", "LINE", "WS", "INT"), 0),
    ("frame", ("WS", "OTHER", "OTHER", "OTHER", "WS", "INT", "WS", "MORE"), 0),
    ("indented", ("WS",), 0),
    ("short", ("SHORT",), 0),
    ("dated", ("stamp",), 0),
    ("dated", ("MONTH", "WS", "INT", "WS", "TIME"), 0),
    ("stamp", ("DATE", "T", "TIME"), 0),
    ("stamp", ("DATE", "T", "TIME", "ZONE"), 0.5),
    ("stamp", ("DATE", "WS", "TIME"), 0),
    ("stamp", ("DATE", "WS", "TIME", "ZONE"), 0.5),
    ("stamp", ("DATE", "WS", "TIME", "WS", "ZONE"), 0.5),
    ("stamp", ("CLF", "WS", "ZONE"), 0.5),
    ("stamp", ("CLF",), 0),
    ("stamp", ("MILLIS",), 0),
    ("stamp", ("SECONDS",), 0),
    ("level", ("LEVEL",), 0),
    ("comp", ("NAME",), 0),
    ("pairs", ("pair",), 0),
    ("pairs", ("pair", "WS", "pairs"), 0),
    ("pair", ("TIMEKEY", "=", "stamp"), 2),
    ("pair", ("TIMEKEY", "=", "qstamp"), 2),
    ("pair", ("LEVELKEY", "=", "level"), 2),
    ("pair", ("LEVELKEY", "=", "qlevel"), 2),
    ("pair", ("COMPKEY", "=", "comp"), 2),
    ("pair", ("COMPKEY", "=", "qcomp"), 2),
    ("pair", ("COMPKEY", "=", "comp", ":", "INT"), 2),
    ("pair", ("MSGKEY", "=", "qmsg"), 2),
    ("pair", ("MSGKEY", "=", "msg"), 1),
    ("pair", ("NAME", "=", "value"), 0.5),
    ("msg", ("NAME",), 0),
    ("value", ("NAME",), 0),
    ("value", ("INT",), 0),
    ("value", ("STRING",), 0),
    ("value", ("SECONDS",), 0),
    ("value", ("MILLIS",), 0),
    ("object", ("{", "members", "}"), 2),
    ("object", ("{", "WS", "members", "}"), 2),
    ("members", ("member",), 0),
    ("members", ("member", "comma", "members"), 0),
    ("comma", (",",), 0),
    ("comma", (",", "WS"), 0),
    ("member_line", ("WS", "member"), 0),
    ("colon", (":",), 0),
    ("colon", (":", "WS"), 0),
    ("member", ("QTIMEKEY", "colon", "qstamp"), 2),
    ("member", ("QTIMEKEY", "colon", "stamp"), 2),
    ("member", ("QLEVELKEY", "colon", "qlevel"), 2),
    ("member", ("QCOMPKEY", "colon", "qcomp"), 2),
    ("member", ("QMSGKEY", "colon", "qmsg"), 2),
    ("member", ("STRING", "colon", "json"), 0.5),
    ("json", ("STRING",), 0),
    ("json", ("NAME",), 0),
    ("json", ("number",), 0),
    ("number", ("INT",), 0),
    ("number", ("-", "INT"), 0),
    ("number", ("INT", "OTHER", "INT"), 0),
    ("number", ("-", "INT", "OTHER", "INT"), 0),
    ("number", ("SECONDS",), 0),
    ("number", ("MILLIS",), 0),
    ("json", ("object",), 0),
    ("json", ("{", "}"), 0),
    ("json", ("[", "]"), 0),
    ("json", ("[", "values", "]"), 0),
    ("values", ("json",), 0),
    ("values", ("json", "comma", "values"), 0),
    ("qstamp", ("QSTAMP",), 0),
    ("qlevel", ("QLEVEL",), 0),
    ("qcomp", ("STRING",), 0),
    ("qmsg", ("STRING",), 0),
]
GRAMMAR = Grammar("line", RULES)
_FIELDS = {"stamp", "dated", "short", "level", "comp", "phase", "status", "msg", "qstamp", "qlevel", "qcomp", "qmsg", "priority"}
_LAYOUTS = ("marker", "plain", "pairs", "object", "member_line", "frame", "indented")


def millis(text: str, year: int) -> int | None:
    """Milliseconds since 1970 UTC, cut; ``year`` counts where the text has none. None if there is no such time."""
    text = text.strip()
    if text.isdigit() and len(text) == 13:
        return int(text)
    whole, _, part = text.partition(".")
    if whole.isdigit() and len(whole) == 10 and (not part or part.isdigit()):
        return int(whole) * 1000 + int((part + "000")[:3])
    m = re.fullmatch(r"(\d{4})[-/](\d\d)[-/](\d\d)[T ](\d\d):(\d\d):(\d\d)(?:[.,](\d+))?\s*(Z|[+-]\d\d:?\d\d)?", text)
    if m:
        y, mo, d, h, mi, s, frac, zone = m.groups()
    elif m := re.fullmatch(r"(\d\d)/([A-Z][a-z]{2})/(\d{4}):(\d\d):(\d\d):(\d\d)\s*(Z|[+-]\d\d:?\d\d)?", text):
        d, mo, y, h, mi, s, zone = m.groups()
        frac, mo = None, MONTHS.get(mo, 0)
    elif m := re.fullmatch(r"([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d\d):(\d\d):(\d\d)(?:[.,](\d+))?", text):
        mo, d, h, mi, s, frac = m.groups()
        y, zone, mo = year, None, MONTHS.get(mo, 0)
    elif m := re.fullmatch(r"[A-Z](\d\d)(\d\d)\s+(\d\d):(\d\d):(\d\d)(?:[.,](\d+))?", text):
        mo, d, h, mi, s, frac = m.groups()
        y, zone = year, None
    else:
        return None
    shift = timedelta()
    if zone and zone != "Z":
        shift = timedelta(hours=int(zone[1:3]), minutes=int(zone[-2:])) * (-1 if zone[0] == "-" else 1)
    try:
        at = datetime(int(y), int(mo), int(d), int(h), int(mi), int(s), tzinfo=timezone(timedelta())) - shift
    except (ValueError, OverflowError):
        return None
    return int((at - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(seconds=1)) * 1000 + int(((frac or "") + "000")[:3])


def _unquote(text: str) -> str:
    try:
        return json.loads(text)
    except ValueError:
        return text[1:-1]


class LineParser:
    """Parses lines one by one; equal beginnings of token classes are parsed once.

    ``parse`` gives ``(kind, ts_ms, level, component, message, unparsed)``.  ``kind`` is ``entry`` for a line
    that starts one, ``open``, ``member`` and ``close`` for lines of an object spread over several; of
    lines that start no entry those of traces are ``frame``, others with a blank before them ``indented``, else
    ``rest``.  ``rules`` are further layouts, in the form of ``RULES``.  ``unparsed`` is the number of characters that no rule explains: the message of a plain header
    line, all of a line that
    starts no entry.  A member has only the fields that its key names.
    """

    def __init__(self, limit: int = 200_000, rules: tuple[Rule, ...] = ()):
        self._grammar = Grammar("line", [*RULES, *rules]) if rules else GRAMMAR
        self._known: dict[int, dict[tuple, tuple]] = {}
        self._count, self._limit = 0, limit

    def parse(self, raw: str | None, year: int) -> tuple:
        if not raw:
            return ("rest", None, None, None, None, 0)
        raw = raw.rstrip("\r\n")
        tokens, names = [], []
        scan = _TOKEN.finditer(raw)

        def more() -> bool:
            for m in scan:
                kind = m.lastgroup
                if kind == "ESC":
                    continue
                text = m.group()
                key = f"{kind}{text}" if kind in ("NAME", "MARK") else kind
                if kind == "STRING":
                    cls = _classes(kind, text)
                elif (cls := _CLASSES.get(key)) is None:
                    cls = _classes(kind, text)
                    if len(_CLASSES) < 100_000:
                        _CLASSES[key] = cls
                tokens.append(m)
                names.append(cls)
                return True
            names.append(None)
            return False

        found = None
        for n in sorted(self._known):
            while len(names) < n and more():
                pass
            if len(names) < n:
                break
            if (found := self._known[n].get(tuple(names[:n]))) is not None:
                break
        if found is None:

            def feed():
                i = 0
                while True:
                    if i >= len(names) and not more():
                        return
                    if names[i] is None:
                        return
                    yield names[i]
                    i += 1

            seen, spans, end = self._grammar.parse(feed())
            spans = [s for s in spans or () if s[0] in _FIELDS or s[0] in _LAYOUTS]
            found = (spans, end)
            if self._count < self._limit:
                self._known.setdefault(seen, {})[tuple(names[:seen])] = found
                self._count += 1
        return self._read(raw, tokens, names, found, year)

    def _read(self, raw: str, tokens: list, names: list, found: tuple, year: int) -> tuple:
        spans, end = found
        rest = ("rest", None, None, None, None, len(raw))
        if not end:
            return rest
        text = lambda a, b: "".join(t.group() for t in tokens[a:b])
        stop = tokens[end - 1].end()
        layout = next((s[0] for s in spans if s[0] in _LAYOUTS), None)
        if layout in ("frame", "indented"):
            return (layout, *rest[1:])
        if layout is None or layout == "member_line":
            tail = raw[stop:].strip()
            if tail not in ("", ","):
                return rest
            if layout is None:
                kind = {"{": "open", "}": "close"}[tokens[0].group()]
                return (kind, None, None, None, None, 0) if tokens[0].start() == 0 else rest
        ts = level = comp = msg = None
        outer = [s for s in spans if s[0] in _FIELDS]
        for name, a, b in outer:
            piece = text(a, b)
            if name in ("stamp", "dated") and ts is None:
                ts = millis(piece, year)
            elif name == "qstamp" and ts is None:
                ts = millis(_unquote(piece), year)
            elif name == "short":
                level, ts = LETTERS[piece[0]], millis(text(a, a + 3), year)
            elif name == "level" and level is None:
                level = LEVELS[piece.lower()]
            elif name == "qlevel" and level is None:
                level = LEVELS[piece[1:-1].lower()]
            elif name in ("comp", "phase") and comp is None:
                comp = piece
            elif name == "qcomp" and comp is None:
                comp = _unquote(piece)
            elif name == "priority":
                level = SEVERITIES[int(piece) % 8]
            elif name == "status":
                level = piece
            elif name in ("msg", "qmsg") and msg is None:
                msg = _unquote(piece) if piece.startswith('"') else piece
        if layout == "member_line":
            return ("member", ts, level, comp, msg, 0)
        if ts is None or level is None or (comp is None and layout in ("marker", "plain")):
            return rest
        if layout == "marker":
            after = raw[stop:].strip()
            if after and after[0] not in "—–-":
                return rest
            return ("entry", ts, level, comp, after.lstrip("—–- "), 0)
        if layout == "plain":
            msg = re.sub(r"\x1b\[[0-9;]*[A-Za-z]", "", raw[stop:]).strip()
            return ("entry", ts, level, comp, msg, len(raw) - stop)
        return ("entry", ts, level, comp, msg, len(raw) - stop)
