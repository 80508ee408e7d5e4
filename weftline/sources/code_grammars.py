"""Declarations in source text: packrat grammars of nine languages.

Functions, types and imports are found at the starts of lines and behind opening braces, outside of strings and
comments, with the comment or string that documents them and with their offsets.  Bodies are balanced by an
explicit stack, so nesting may be of any depth.  What a type or function encloses is found by offsets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.peg import Expression, Parse, ahead, alt, balanced, cap, many, opt, pat, ref, seq


class Declaration(NamedTuple):
    """``what`` is function, type or import; ``parent`` the position of the enclosing declaration in the list, or None.

    Offsets span header and body.  ``owner`` is a type named by the header itself, such as a receiver.
    """

    what: str
    kind: str
    name: str
    line: int
    signature: str | None
    doc: str | None
    start: int
    stop: int
    parent: int | None
    owner: str | None


_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*+"', r"'(?:[^'\\\n]|\\[\s\S])*+'"
# What isn't closed runs to the end of the text, as it does for the languages' own scanners.
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\}|\$)*+(?:`|\Z)"
_C_COMMENT = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z)"
_JS_REGEX = r"(?:(?<=[=(,:\[!&|?{};])|(?<=[=(,:\[!&|?{};] ))/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/"
_LONG = r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*+(?:"""|\Z)'
_HEREDOC_END = r"[^\n]{0,2000}\n(?:(?![ \t]*\2[ \t]*(?:\n|$))[^\n]*\n)*+(?:[ \t]*\2(?=[ \t]*(?:\n|$))|[^\n]*\Z)"
#: Strings and comments by language; none of them holds a delimiter or a declaration.
LITERALS = {
    "javascript": f"{_C_COMMENT}|{_JS_REGEX}|{_DQ}|{_SQ}|{_TEMPLATE}",
    "java": f"{_C_COMMENT}|{_LONG}|{_DQ}|{_SQ}",
    "go": rf"{_C_COMMENT}|{_DQ}|`[^`]*(?:`|\Z)|'(?:[^'\\\n]|\\.)[^'\n]*'",
    "rust": rf"""{_C_COMMENT}|(?<=r##)"[\s\S]*?(?:"##|\Z)|(?<=r#)"[\s\S]*?(?:"#|\Z)|(?<=\br)"[^"]*(?:"|\Z)|"(?:[^"\\]|\\[\s\S])*+(?:"|\Z)|'(?:[^'\\\n]|\\[^'\n]+|\\')'""",
    "bash": rf"""<<-?[ \t]*(['"]?)([A-Za-z_]\w*)\1{_HEREDOC_END}""" + r"""|(?:(?<=[\s;])|(?<![\s\S]))#[^\n]*|\\.|"(?:[^"\\]|\\[\s\S])*+(?:"|\Z)|'[^']*(?:'|\Z)|\$\{[^{}\n]*\}""",
    "python": rf"""#[^\n]*|{_LONG}|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+(?:'''|\Z)|{_DQ}|{_SQ}""",
    "ruby": rf"""(?<![^\n])=begin\b[\s\S]*?(?:\n=end\b[^\n]*|\Z)|<<[-~]?(['"]?)([A-Z_]\w*)\1{_HEREDOC_END}|#(?!\{{)[^\n]*|{_DQ}|{_SQ}""",
}
_BLANK = pat(r"[ \t]*")
_SLASH_DOC = r"[ \t]*/\*\*?(?:[^*]|\*(?!/))*+\*/|(?:[ \t]*//[^\n]*\n)++"
_HASH_DOC = r"(?:[ \t]*#[^\n]*\n)++"
_ANNOTATIONS = r"[ \t]*\n?(?:[ \t]*@[\w.]+[^\n]*\n|[ \t]*#!?\[[^\n]*\]\n)*"
_NO_NAME = r"(?!(?:if|for|while|switch|catch|return|function|with|else|do|new|synchronized|match|loop|select|throw|super|assert|await|yield|case|typeof|in|of)\b)"


def _skip(literals: str, inner: bool = True) -> Expression:
    """To the end of the line, or just behind an opening brace with text behind it; literals may go on over lines."""
    stop = r"\n|\{(?=[ \t]*[^\s}])|$" if inner else r"\n|$"
    return pat(rf"(?=[\s\S])(?:{literals}|[^\n{{}}\"'`/#<$\\=]++|(?!{stop})[^\n])*+(?:{stop})")


def _rules(language: str, units: dict[str, Expression], doc: str | None, inner: bool = True) -> dict[str, Expression]:
    literals = LITERALS[language]
    unit = alt(*(ref(name) for name in units))
    documented = seq(opt(seq(cap("doc", pat(doc)), pat(_ANNOTATIONS))), _BLANK, unit) if doc else seq(_BLANK, unit)
    # Comments that document nothing are passed over as one.
    beside = [pat(doc)] if doc else []
    return {"file": many(alt(ref("unit"), *beside, ref("skip"))), "unit": documented, "skip": _skip(literals, inner), **units}


def _body(language: str) -> Expression:
    return ahead(cap("body", balanced("{}", LITERALS[language])))


def _parens(language: str) -> Expression:
    return balanced("()", LITERALS[language])


def _function(*header: Expression, body: Expression) -> Expression:
    return cap("function", seq(cap("signature", seq(*header)), pat(r"\s*"), body))


def _type(header: str, body: Expression) -> Expression:
    return cap("type", seq(pat(header), body))


def _import(*patterns: str) -> Expression:
    return cap("import", alt(*(pat(p) for p in patterns)))


_JS_MODIFIERS = r"(?:(?:export|default|public|private|protected|static|readonly|abstract|override|async|get|set|declare)\s+)*+"
_JS_TYPE = r"(?:\s*:\s*(?:[\w$.<>\[\]|&,?\"' ]|=>|\{[^{}\n]*\}(?=\s*[\[\]>|&{]))+?)?"
_JS_BODY = alt(_body("javascript"), ahead(cap("body", many(alt(balanced("()[]{}", LITERALS["javascript"]), pat(LITERALS["javascript"]), pat(r"[^\s;,()\[\]{}\"'`/]+|/|[ \t]+"))))))
_JS_UNITS = {
    "function": _function(
        pat(_JS_MODIFIERS + r"(?:function\s*\*?\s*|\*\s*)?" + _NO_NAME + r"(?P<name>[#\w$]+)\s*(?:<[^<>()\n]*>)?\s*"), _parens("javascript"), pat(_JS_TYPE + r"(?=\s*\{)"), body=_body("javascript")
    ),
    "assigned": _function(
        pat(_JS_MODIFIERS + r"(?:(?:const|let|var)\s+|(?:[\w$]+\.)+)?" + _NO_NAME + r"(?P<name>[#\w$]+)\s*(?::\s*(?:[^=;{}\n]|=>)+=(?!>)|[:=])\s*(?:async\s*)?(?=function\b|\(|[\w$]+\s*=>)"),
        alt(seq(pat(r"function\b\s*\*?\s*[\w$]*\s*"), _parens("javascript"), pat(_JS_TYPE + r"(?=\s*\{)")), seq(alt(_parens("javascript"), pat(r"[\w$]+")), pat(r"(?:\s*:\s*[^=\n{]+?)?\s*=>"))),
        body=_JS_BODY,
    ),
    "declared": _function(pat(_JS_MODIFIERS + _NO_NAME + r"(?P<name>[#\w$]+)\??\s*(?:<[^<>()\n]*>)?\s*"), _parens("javascript"), pat(r"\s*:\s*[^;{}()\n]+(?=;)"), body=ahead(cap("body", pat(";")))),
    "type": _type(r"(?:(?:export|default|abstract|declare)\s+)*+(?P<kind>class|interface|enum)\s+(?P<name>[\w$]+)(?:[^{};\"'`(]|\([^()\n]*\))*+(?=\{)", _body("javascript")),
    "alias": _type(r"(?:(?:export|declare)\s+)*+(?P<kind>type)\s+(?P<name>[\w$]+)\s*(?:<[^=]*>\s*)?=(?=[^=])", ahead(cap("body", pat(r"[^;\n]*")))),
    "import": _import(r"import\s+(?:[\w$*{}\s,]+?\s+from\s+)?[\"'](?P<target>[^\"'\n]+)[\"']", r"export\s+[\w$*{}\s,]+?\s+from\s+[\"'](?P<target>[^\"'\n]+)[\"']", r"(?:const|let|var)\s+[\w${}\s,]+?=\s*require\(\s*[\"'](?P<target>[^\"'\n]+)[\"']"),
}

_JAVA_MODIFIERS = r"(?:@[\w.]+(?:\([^()\n]*\))?\s+)*+(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp|sealed|non-sealed)\s+)*+"
_GO_RESULT = many(alt(_parens("go"), pat(r"(?:interface|struct)\s*\{[^{}]*\}|[^\n{(]")))
_END = ahead(cap("body", pat(";")))
GRAMMARS: dict[str, dict[str, Expression]] = {
    "javascript": _rules("javascript", _JS_UNITS, _SLASH_DOC),
    "java": _rules("java", {
        "function": _function(
            pat(_JAVA_MODIFIERS + r"(?:<[^{}();\n]*?>\s*)?(?!(?:new|return|else|throw|class|package|import|assert|yield|case|record|enum|interface)\b)[\w.]+(?:<[^{}();\n]*>)?(?:\[\])*+\s+" + _NO_NAME + r"(?P<name>\w+)\s*(?=\()"),
            _parens("java"), pat(r"(?:\s*\[\])*"), body=seq(pat(r"(?:throws\s+[\w.,\s]+?)?\s*(?=[{;])"), alt(_body("java"), _END)),
        ),
        "constructor": _function(pat(r"(?:public|private|protected)\s+(?P<name>[A-Z]\w*)\s*(?=\()"), _parens("java"), body=seq(pat(r"(?:throws\s+[\w.,\s]+?)?\s*(?=\{)"), _body("java"))),
        "type": _type(_JAVA_MODIFIERS + r"@?(?P<kind>class|interface|enum|record)\s+(?P<name>\w+)[^{};\"']*+(?=\{)", _body("java")),
        "import": _import(r"import\s+(?:static\s+)?(?P<target>[\w.*]+)\s*;"),
    }, _SLASH_DOC),
    "go": _rules("go", {
        "function": _function(pat(r"func\s*(?:\(\s*(?:\w+\s+)?\*?\s*(?P<owner>\w+)[^()\n]*\)\s*)?(?P<name>\w+)(?:\[[^\n]*?\](?=\())?\s*(?=\()"), _parens("go"), _GO_RESULT, body=_body("go")),
        "type": _type(r"(?:type\s+)?(?P<name>\w+)(?:\[[^\]\n]*\])?\s+(?P<kind>struct|interface)\s*(?=\{)", _body("go")),
        "import": _import(r"import\s+(?:[\w.]+\s+)?\"(?P<target>[^\"\n]+)\""),
        "imports": cap("import", seq(pat(r"import\s*\("), many(alt(pat(r"\s*(?:[\w.]+\s+)?\"(?P<target>[^\"\n]*)\""), pat(r"\s*//[^\n]*|\s*;"))), pat(r"\s*\)"))),
    }, _SLASH_DOC),
    "rust": _rules("rust", {
        "function": _function(
            pat(r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|default|extern(?:\s+\"[^\"]*\")?)\s+)*+fn\s+(?P<name>\w+)\s*(?:<[^()\n{}]*>)?\s*(?=\()"), _parens("rust"), pat(r"(?:\s*->\s*[^{;\n]+?)?(?:\s*where\b[^{;]*?)?(?=\s*[{;])"),
            body=alt(_body("rust"), _END),
        ),
        "type": _type(r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?P<kind>struct|enum|trait|union|mod)\s+(?P<name>\w+)[^{};]*+(?=\{)", _body("rust")),
        "unit_type": _type(r"(?:pub(?:\([^)]*\))?\s+)?(?P<kind>struct)\s+(?P<name>\w+)[^{};]*+(?=;)", _END),
        "impl": _type(r"(?:unsafe\s+)?(?P<kind>impl)\b(?:[^{};]*?\bfor\s+|\s*<[^{}]*?>\s+|\s+)(?:\w+::)*(?P<name>\w+)[^{};]*+(?=\{)", _body("rust")),
        "import": _import(r"(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<target>[^;]+?)\s*;"),
    }, r"(?:[ \t]*//[/!]?[^\n]*\n)++|[ \t]*/\*\*?(?:[^*]|\*(?!/))*+\*/"),
    "bash": _rules("bash", {
        "function": _function(pat(r"(?:function\s+(?P<name>[\w:.-]+)(?:\s*\(\s*\))?)(?=\s*\{)|(?P<bare>[\w:.-]+)\s*\(\s*\)(?=\s*\{)"), body=_body("bash")),
        "import": _import(r"(?:source|\.)[ \t]+(?P<target>[^\s;&|\"'$]+)"),
    }, _HASH_DOC),
    "python": _rules("python", {
        "function": cap("function", seq(
            pat(r"(?P<indent>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*"), opt(balanced("[]", LITERALS["python"])),
            cap("signature", seq(_parens("python"), opt(seq(pat(r"[ \t]*->[ \t]*"), many(alt(balanced("[]()", LITERALS["python"]), pat(LITERALS["python"]), pat(r"[^\n:\[\]()\"'#]+"))))))),
            pat(r"[ \t]*:[ \t]*(?:#[^\n]*)?\n?"), ahead(opt(ref("string"))), ahead(ref("suite")),
        )),
        "type": cap("type", seq(pat(r"(?P<indent>[ \t]*)(?P<kind>class)[ \t]+(?P<name>\w+)"), opt(balanced("[]", LITERALS["python"])), opt(_parens("python")), pat(r"[ \t]*:[ \t]*(?:#[^\n]*)?\n?"), ahead(opt(ref("string"))), ahead(ref("suite")))),
        "import": _import(r"[ \t]*import[ \t]+(?P<target>[\w.]+)", r"[ \t]*from[ \t]+(?P<target>[\w.]+)[ \t]+import\b"),
    }, None, False) | {
        "unit": alt(ref("function"), ref("type"), ref("import")),
        "string": seq(pat(r"\s*[rRuU]?"), cap("doc", pat(r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*+"""|\'\'\'(?:[^\'\\]|\\[\s\S]|\'(?!\'\'))*+\'\'\'|' + _DQ + "|" + _SQ))),
        "suite": cap("body", pat(r"[^\n]*\n?")),
    },
    "ruby": _rules("ruby", {
        "function": cap("function", seq(pat(r"(?P<indent>[ \t]*)(?P<signature>def[ \t]+(?:\w+\.)?(?P<name>\w+[?!=]?|[-+*/<>=!%\[\]~^&|]+)(?:[ \t]*\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\))?)[^\n]*\n?"), ahead(ref("suite")))),
        "type": cap("type", seq(pat(r"(?P<indent>[ \t]*)(?P<kind>class|module)[ \t]+(?:\w+::)*(?P<name>[A-Z]\w*)[^\n;]*\n?"), ahead(ref("suite")))),
        "import": _import(r"[ \t]*require(?:_relative)?[ \t(]+[\"'](?P<target>[^\"'\n]+)[\"']"),
    }, _HASH_DOC, False) | {
        "unit": seq(opt(cap("doc", pat(_HASH_DOC))), alt(ref("function"), ref("type"), ref("import"))),
        "suite": cap("body", pat(r"[^\n]*\n?")),
    },
}
GRAMMARS["typescript"] = GRAMMARS["tsx"] = GRAMMARS["javascript"]

_ROW = re.compile(r"([ \t]*)([^\n]*)(?:\n|$)")


def _indented_end(text: str, at: int, indent: str, closing: str | None) -> int:
    """Where a body ends that is marked by indentation (``closing`` None) or by a closing word at the header's indentation."""
    if closing is not None:
        m = re.compile(rf"^{re.escape(indent)}{closing}\b[^\n]*", re.M).search(text, at)
        return m.end() if m else len(text)
    width = len(indent.expandtabs())
    end = at
    for m in _ROW.finditer(text, at):
        if m.start() == len(text):
            break
        if m.group(2).strip():
            if len(m.group(1).expandtabs()) <= width and m.start() > at - 1 and not m.group(2).startswith("#"):
                break
            end = m.end()
    return end


def _shadow(text: str, language: str) -> str:
    """The text with the line ends inside of literals taken out, so that only lines of code count; offsets stay."""
    return re.sub(LITERALS[language], lambda m: m.group().replace("\n", "\0"), text)


def declarations(text: str | None, language: str | None) -> list[Declaration]:
    """All functions, types and imports of a text, in source order; none for unknown languages, null and empty texts.

    A function directly in a type is a ``method``, and so is one whose header names a receiver.  Bodies that don't
    end (a text cut off) give no declaration, but what they hold and does end is found.
    """
    rules = GRAMMARS.get(language or "")
    if not text or not rules:
        return []
    got = Parse(rules, text).rule("file", 0)
    found: list[tuple] = []
    doc, line, counted, shadow = None, 1, 0, ""
    caps = list(got[1]) if got else []
    i = 0
    while i < len(caps):
        what, a, b = caps[i]
        i += 1
        if what == "doc":
            doc = text[a:b]
            continue
        if what not in ("function", "type", "import"):
            continue
        part: dict[str, tuple[int, int]] = {}
        targets = []
        while i < len(caps) and caps[i][0] not in ("function", "type", "import") and not (caps[i][0] == "doc" and language != "python"):
            if caps[i][0] == "target":
                targets.append(caps[i][1:])
            part.setdefault(caps[i][0], caps[i][1:])
            i += 1
        named = part.get("name") or part.get("bare")
        if language == "python":
            doc = text[slice(*part["doc"])] if "doc" in part else None
        if "indent" in part and language == "ruby" and what == "function" and text[part["signature"][1] : b].lstrip().startswith("="):
            end = b
        elif "indent" in part:
            shadow = shadow or _shadow(text, language)
            end = _indented_end(shadow, b, text[slice(*part["indent"])], None if language == "python" else "end")
        else:
            end = part["body"][1] if "body" in part else b
        for name in [named] if what != "import" else targets:
            line += text.count("\n", counted, name[0])
            counted = name[0]
            kind = text[slice(*part["kind"])] if "kind" in part else what
            signature = text[slice(*part["signature"])] if "signature" in part else None
            found.append((what, kind, text[slice(*name)], line, signature, doc, a, end, text[slice(*part["owner"])] if "owner" in part else None))
        doc = None
    out: list[Declaration] = []
    around: list[int] = []
    for what, kind, name, line, signature, doc, start, stop, owner in found:
        while around and out[around[-1]].stop <= start:
            around.pop()
        parent = around[-1] if around else None
        if what == "function" and (owner or (parent is not None and out[parent].what == "type")):
            kind = "method"
        out.append(Declaration(what, kind, name, line, signature, doc, start, stop, parent, owner))
        if what != "import":
            around.append(len(out) - 1)
    return out


#: Words before a parenthesis that call nothing.
_NO_CALL = frozenset("if for while switch catch return function with else do new synchronized match loop select throw super typeof in of and or not await yield case def fn func elif except assert lambda import from class print sizeof".split())
_CALL = re.compile(r"(?<![\w$])([^\W\d][\w$]*)[?!]?\s*\(")


def called(text: str, language: str, found: list[Declaration]) -> list[tuple[int, str]]:
    """``(position of the function in ``found``, name)`` of what each function's own body calls by name, once each."""
    literals = LITERALS["javascript" if language in ("typescript", "tsx") else language]
    plain = re.sub(literals, lambda m: " " * len(m.group()), text)
    own = [[d.start, d.stop] for d in found]
    inner: dict[int, list[int]] = {}
    for i, d in enumerate(found):
        if d.what != "import" and d.parent is not None:
            inner.setdefault(d.parent, []).append(i)
    out = []
    for i, d in enumerate(found):
        if d.what != "function":
            continue
        at = d.start + len(d.signature or "")
        names: dict[str, None] = {}
        for j in [*inner.get(i, ()), None]:
            upto = own[j][0] if j is not None else d.stop
            names.update(dict.fromkeys(m.group(1) for m in _CALL.finditer(plain, at, max(at, upto))))
            at = own[j][1] if j is not None else at
        out.extend((i, n) for n in names if n not in _NO_CALL)
    return out


#: Kinds of an index; types of every sort are containers and count as classes, blocks that only add to a type don't count.
_INDEX_KIND = {"function": "function", "method": "method", "impl": None, "mod": "class"}


def index_rows(text: str, language: str) -> list[tuple]:
    """The rows of ``python_source.SCHEMA`` without the file for one text: symbols, calls and imports."""
    found = declarations(text, language)
    paths: list[str | None] = []
    out: list[tuple] = []
    for d in found:
        up = d.parent
        # A receiver or a block that adds to a type names the owner; else the innermost type or function around.
        parent = d.owner or (paths[up] if up is not None else None)
        path = d.name if d.kind == "impl" or parent is None else f"{parent}{'#' if d.what == 'type' else '.'}{d.name}"
        paths.append(path if d.what != "import" else None)
        if d.what == "import":
            out.append(("import", None, None, d.line, None, None, None, d.name))
        elif kind := _INDEX_KIND.get(d.kind, "class"):
            out.append(("symbol", path, kind, d.line, d.signature if d.what == "function" else None, d.doc, parent, None))
    out.extend(("call", paths[i], None, None, None, None, None, name) for i, name in called(text, language, found))
    return out


_ROWS = {"file_id": pa.int64(), "what": pa.string(), "name": pa.string(), "kind": pa.string(), "line": pa.int32(), "signature": pa.string(), "docstring": pa.string(), "parent": pa.string(), "target": pa.string()}


def _run(batches: Iterator[pa.RecordBatch], python) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file_id, language, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if text:
                text = text.replace("\r\n", "\n")
                rows.extend((file_id, *r) for r in (python(text) if language == "python" else index_rows(text, language)))
        columns = list(zip(*rows, strict=True)) or [()] * len(_ROWS)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ROWS.values(), strict=True)], list(_ROWS))


def with_language(files: DataFrame, lang_map: DataFrame) -> DataFrame:
    """``(file_id, path, language)`` by the extension of the path, compared without case; other extensions are left out."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1)).alias("ext")
    # One row per extension of the languages that an index knows: it doesn't grow with the data.
    langs = lang_map.where("ext is not null and lang is not null").groupBy(F.lower("ext").alias("ext")).agg(F.min("lang").alias("language"))
    known = files.where("id is not null and path is not null").groupBy(F.col("id").alias("file_id")).agg(F.min("path").alias("path"))
    return known.select("file_id", "path", ext).join(langs, "ext").select("file_id", "path", "language")


def parse_sources(files: DataFrame, contents: DataFrame, lang_map: DataFrame) -> DataFrame:
    """Symbols, calls and imports of every source text, in the columns of ``python_source.SCHEMA``.

    Python is read by its own parser, the other languages by their grammars.  Null texts give nothing; of different
    texts of one file the smallest counts.
    """
    from weftline.sources.python_source import SCHEMA, parse

    texts = contents.where("content is not null and file_id is not null").groupBy("file_id").agg(F.min("content").alias("content"))
    rows = texts.join(with_language(files, lang_map), "file_id").select("file_id", "language", "content")
    return rows.mapInArrow(partial(_run, python=parse), SCHEMA)
