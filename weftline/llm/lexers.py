"""Lexers with a pushdown stack for the languages of an index.

``check(text, language)`` gives the first fault of a text, or None: an unterminated literal or comment, an
unbalanced delimiter or block, a merge-conflict marker outside literals and comments, a premature end, or words
that can't follow each other in the language, as when the text belongs to another one.
"""

from __future__ import annotations

import ast
import re
import warnings

#: A fault is a short reason and the offset where it shows.
Fault = tuple[str, int]

_CONFLICT = re.compile(r"^(?:<{7}(?: .*)?|={7}|>{7}(?: .*)?|\|{7}(?: .*)?)\r?$", re.M)
_PAIRS = {")": "(", "]": "[", "}": "{"}

_NUM = r"(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)[a-zA-Z_]?[a-zA-Z\d_]*"
_C_COMMENT = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/"
_DQ, _SQ = r'"(?:[^"\\\n]|\\(?:\r\n|.|\n))*"', r"'(?:[^'\\\n]|\\(?:\r\n|.|\n))*'"
_WORD = r"[^\W\d][\w]*"


def _lexer(**kinds: str) -> re.Pattern:
    return re.compile("|".join(f"(?P<{k}>{v})" for k, v in kinds.items()), re.S)


_TAIL = {"bad": r'/\*|"|`|\'', "num": _NUM, "open": r"[(\[{]", "close": r"[)\]}]", "nl": r"\n", "ws": r"[^\S\n]+", "op": r"=>|->|::|:=|<-|\.\.\.?|[-+*/%&|^<>=!]=?|&&|\|\||\+\+|--|[;,.:?@#~\\$]", "odd": r"."}
LEXERS = {
    "go": _lexer(com=_C_COMMENT, str=_DQ + r"|`[^`]*`|'(?:[^'\\\n]|\\.[^']*)'", word=_WORD, **_TAIL),
    "java": _lexer(com=_C_COMMENT, str=r'"""(?:[^\\"]|\\.|"(?!""))*"""|' + _DQ + r"|'(?:[^'\\\n]|\\[^'\n]+|\\')'", word=r"[^\W\d][\w$]*", **_TAIL),
    "rust": _lexer(com=r"//[^\n]*", cbeg=r"/\*", str=r'[bc]?r(?P<h>#*)".*?"(?P=h)|[bc]?"(?:[^"\\]|\\.)*"|b?\'(?:[^\'\\\n]|\\[^\'\n]+|\\\')\'', life=r"'[^\W\d]\w*", word=r"(?:r#)?" + _WORD, **_TAIL),
    "javascript": _lexer(com=_C_COMMENT + r"|(?<![^\n])#![^\n]*", str=_DQ + "|" + _SQ, tmpl=r"`", word=r"[#@]?(?:[^\W\d]|\$)[\w$]*", **_TAIL),
}

_JS_OPERATORS = frozenset("in of instanceof as is extends implements satisfies from keyof infer asserts".split())
_JS_LEADERS = frozenset(
    "return typeof void delete new throw case do else yield await async function class const let var import export default static get set public private protected readonly abstract declare "
    "interface type enum namespace module override if for while switch try finally catch with break continue accessor keyof unique infer asserts is in of instanceof as extends implements satisfies from global".split()
)
_JAVA_TOP = frozenset("package import public final abstract class interface enum record sealed non strictfp static private protected module open @ ;".split())
_RUST_TOP = frozenset("use pub fn struct impl mod enum trait const static type extern unsafe async macro_rules union #".split())
_GO_TOP = frozenset("import func type var const".split())


def _starts(text: str) -> set[int]:
    return {m.start() for m in _CONFLICT.finditer(text)}


def _template(text: str, at: int) -> int:
    """The offset after a JavaScript template that starts at ``at``, or -1."""
    i, n = at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif c == "$" and text.startswith("${", i):
            depth, i = 1, i + 2
            while i < n and depth:
                c = text[i]
                if c == "`":
                    i = _template(text, i)
                    if i < 0:
                        return -1
                    continue
                if c in "\"'":
                    m = re.compile(_DQ if c == '"' else _SQ).match(text, i)
                    if not m:
                        return -1
                    i = m.end()
                    continue
                depth += (c == "{") - (c == "}")
                i += 1
        else:
            i += 1
    return -1


_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")


#: What may start an element: a tag or fragment, but no type parameter of an arrow function.
_JSX_START = re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*(?=[\s/>])(?!\s+extends\b)(?!\s*>\s*\())")
_JSX_TAG = re.compile(r"</?\s*(?P<name>[A-Za-z_$][\w$.:-]*)?")


def _value(tokens: list[tuple[str, str, int]]) -> bool:
    """Whether a value ends here, so that ``<`` compares."""
    last = next((t for t in reversed(tokens) if t[0] != "nl"), ("nl", "", 0))
    return last[0] in ("num", "str") or last[1] in (")", "]", "}") or (last[0] == "word" and last[1] not in _JS_LEADERS)


def _jsx(text: str, at: int) -> int:
    """The offset after the element that starts at ``at``, or -1 if its tags don't match or it doesn't end.

    A stack holds what is open: names of elements, ``<`` inside of a tag, ``{`` inside of code.
    """
    stack: list[tuple[str, str]] = []
    i, n = at, len(text)
    while i < n:
        c = text[i]
        top = stack[-1][0] if stack else ""
        if top == "<":
            if c in "\"'":
                i = text.find(c, i + 1)
                if i < 0:
                    return -1
            elif c == "{":
                stack.append(("{", ""))
            elif text.startswith("/>", i):
                stack.pop()
                i += 1
                if not stack:
                    return i + 1
            elif c == ">":
                stack[-1] = ("element", stack[-1][1])
        elif top == "{":
            if c in "\"'" and (m := re.compile(_DQ if c == '"' else _SQ).match(text, i)):
                i = m.end() - 1
            elif c == "`":
                i = _template(text, i) - 1
                if i < 0:
                    return -1
            elif text.startswith("//", i) or text.startswith("/*", i):
                m = re.compile(_C_COMMENT).match(text, i)
                if not m:
                    return -1
                i = m.end() - 1
            elif c == "{":
                stack.append(("{", ""))
            elif c == "}":
                stack.pop()
            elif c == "<" and (m := _JSX_START.match(text, i)) and re.search(r"(?:[=(,:?&|>{\[]|\breturn)\s*$", text[max(0, i - 200) : i]):
                stack.append(("<", _JSX_TAG.match(text, i).group("name") or ""))
                i = _JSX_TAG.match(text, i).end() - 1
        elif c == "{":
            stack.append(("{", ""))
        elif text.startswith("</", i):
            m = re.compile(r"</\s*([\w$.:-]*)\s*>").match(text, i)
            if not m or not stack or stack[-1][1] != m.group(1):
                return -1
            stack.pop()
            i = m.end() - 1
            if not stack:
                return i + 1
        elif c == "<":
            m = _JSX_TAG.match(text, i)
            if not m.group("name") and not text.startswith("<>", i):
                return -1
            stack.append(("<", m.group("name") or ""))
            i = m.end() - 1
        i += 1
    return -1


def _braced(text: str, language: str) -> tuple[list[tuple[str, str, int]], Fault | None]:
    """Tokens of a brace language without blanks and comments, and the first fault of the lexer and its stack."""
    pattern, conflicts = LEXERS["javascript" if language in ("typescript", "tsx") else language], _starts(text)
    script = language in ("javascript", "typescript", "tsx")
    tokens: list[tuple[str, str, int]] = []
    marked = language in ("javascript", "tsx")
    stack: list[tuple[str, int, bool]] = []
    condition = False
    i, n = 0, len(text)
    while i < n:
        if i in conflicts and text[i] in "<=>|":
            return tokens, ("conflict", i)
        m = pattern.match(text, i)
        kind, piece = m.lastgroup, m.group()
        if kind == "h":
            kind = "str"
        end = m.end()
        if kind == "bad" or kind == "cbeg":
            if language == "rust" and piece == "/*":
                depth, j = 1, i + 2
                while depth:
                    nxt = re.compile(r"/\*|\*/").search(text, j)
                    if not nxt:
                        return tokens, ("unterminated comment", i)
                    depth += 1 if nxt.group() == "/*" else -1
                    j = nxt.end()
                i = j
                continue
            return tokens, ("unterminated literal", i)
        if kind == "tmpl":
            end = _template(text, i)
            if end < 0:
                return tokens, ("unterminated literal", i)
            kind, piece = "str", "`"
        elif kind == "op" and script and piece[0] == "/":
            last = tokens[-1] if tokens else ("nl", "\n", 0)
            value = last[0] in ("num", "str") or (last[1] == ")" and not condition) or last[1] in ("]", "}") or (last[0] == "word" and last[1] not in _JS_LEADERS)
            if not value and (r := _REGEX.match(text, i)):
                kind, piece, end = "str", "/", r.end()
        elif kind == "op" and marked and piece[0] == "<" and _JSX_START.match(text, i) and not _value(tokens):
            end = _jsx(text, i)
            if end < 0:
                return tokens, ("unbalanced", i)
            kind, piece = "str", "<"
        elif kind == "open":
            stack.append((piece, i, piece == "(" and bool(tokens) and tokens[-1][1] in ("if", "while", "for", "with") and (len(tokens) < 2 or tokens[-2][1] != ".")))
        elif kind == "close":
            if not stack or stack[-1][0] != _PAIRS[piece]:
                return tokens, ("unbalanced", i)
            condition = stack.pop()[2]
        elif kind == "odd" and not (piece == "﻿" and i == 0):
            return tokens, ("stray character", i)
        if kind not in ("ws", "com", "odd"):
            tokens.append((kind, piece, i))
        i = end
    if stack:
        return tokens, ("premature end", stack[-1][1])
    return tokens, None


_VALUE = ("word", "num", "str", "life")


def _follow(tokens: list[tuple[str, str, int]], may_lead: frozenset[str], may_follow: frozenset[str]) -> Fault | None:
    """The first place on a line where an operand follows an operand."""
    for (k1, t1, _), (k2, t2, at) in zip(tokens, tokens[1:]):
        if k2 not in _VALUE or k1 not in _VALUE:
            continue
        if (k1 == "word" and (t1 in may_lead or t1[0] == "@")) or (k2 == "word" and t2 in may_follow):
            continue
        return ("misplaced word", at)
    return None


# Operators that need an operand behind them in each brace language.
_NEEDY = frozenset("= := += -= *= /= %= == != <= >= / % ^ + -".split())
_SHUT = frozenset("; ) ] } ,".split())


def _operands(solid: list[tuple[str, str, int]], plain_star: bool) -> Fault | None:
    """The first operator without an operand: before a closing sign, or with ``plain_star`` (no pointers) before ``*``, ``/`` or ``%``."""
    before = ("", -1)
    for (k1, t1, at), (k2, t2, _) in zip(solid, solid[1:]):
        double, before = (t1 in "+-" and before == (t1, at - 1)), (t1, at)
        if k1 != "op" or t1 not in _NEEDY or double:
            continue
        if t2 in _SHUT and k2 in ("op", "close"):
            return ("misplaced operator", at)
        if plain_star and k2 == "op" and t2 in ("*", "/", "%") and t1 in ("+", "-", "/", "%", "="):
            return ("misplaced operator", at)
    return None


def _script(text: str, language: str) -> Fault | None:
    tokens, fault = _braced(text, language)
    if fault:
        return fault
    fault = _follow(tokens, _JS_LEADERS, _JS_OPERATORS)
    if fault:
        return fault
    solid = [t for t in tokens if t[0] != "nl"]
    if not solid:
        return None
    if fault := _operands(solid, True):
        return fault
    if solid[0][1] == "<" and (len(solid) < 2 or solid[1][1] in ("!", "/", "?") or language not in ("javascript", "tsx")):
        return ("misplaced operator", 0)
    for i, (_, t, at) in enumerate(solid):
        if t == "#":
            return ("stray character", at)
        if t == "<" and i + 1 < len(solid) and solid[i + 1][1] == "!" and (i + 2 < len(solid) and solid[i + 2][1].upper() == "DOCTYPE"):
            return ("misplaced operator", at)
    # A header needs its body, and an operator its operand.
    depth, header = 0, None
    for i, (kind, t, at) in enumerate(solid):
        if t in ("(", "[", "{"):
            depth += 1
            if t == "{" and header is not None and depth == header + 1:
                header = None
        elif t in (")", "]", "}"):
            depth -= 1
        elif kind == "word" and t in ("function", "class") and not (i and solid[i - 1][1] == "."):
            header = depth
    if header is not None:
        return ("premature end", solid[-1][2])
    if solid[-1][0] == "op" and solid[-1][1] not in (";", "++", "--", ","):
        return ("premature end", solid[-1][2])
    if solid[-1][0] == "word" and solid[-1][1] in _JS_LEADERS - {"return", "break", "continue", "type", "get", "set", "async", "from", "of", "is", "as", "global", "module", "static", "readonly", "declare", "abstract"}:
        return ("premature end", solid[-1][2])
    if language == "javascript":
        return _typed(solid)
    return None


def _typed(solid: list[tuple[str, str, int]]) -> Fault | None:
    """Type annotations, which plain JavaScript doesn't have: ``(x: T`` of a function or method, and ``): T {``."""
    for i, (_, t, at) in enumerate(solid):
        if t == ")" and i + 2 < len(solid) and solid[i + 1][1] == ":" and solid[i + 2][0] == "word":
            j = i + 2
            while j < len(solid) and (solid[j][0] == "word" or solid[j][1] in (".", "<", ">", "[", "]", "|", ",")):
                j += 1
            # A conditional expression or a case label can look alike, but no block follows it.
            if j < len(solid) and solid[j][1] == "{" and solid[i - 1][1] != "?":
                return ("misplaced type", at)
        if t == "(" and i >= 2 and solid[i - 2][1] == "function" and i + 2 < len(solid) and solid[i + 1][0] == "word" and solid[i + 2][1] in (":", "?"):
            return ("misplaced type", at)
        if t in ("interface", "enum", "namespace") and i + 2 < len(solid) and solid[i + 1][0] == "word" and solid[i + 2][1] == "{":
            return ("misplaced type", at)
    return None


def _top(tokens: list[tuple[str, str, int]], allowed: frozenset[str], breaks: bool) -> Fault | None:
    """The first item at the outermost level that doesn't start as one; items end with a block, ``;`` or, with ``breaks``, a line."""
    depth, start = 0, True
    for k, t, at in tokens:
        if k == "nl":
            start = start or (breaks and depth == 0)
            continue
        if start and depth == 0 and t not in allowed:
            return ("misplaced word", at)
        start = False
        if k == "open":
            depth += 1
        elif k == "close":
            depth -= 1
            start = depth == 0 and t == "}"
        elif t == ";" and depth == 0:
            start = True
    return None


def _go(text: str) -> Fault | None:
    tokens, fault = _braced(text, "go")
    if fault:
        return fault
    solid = [t for t in tokens if t[0] != "nl"]
    if not solid:
        return None
    if solid[0][1] != "package":
        return ("misplaced word", solid[0][2])
    if len(solid) < 2 or solid[1][0] != "word":
        return ("premature end", solid[-1][2])
    rest = tokens[tokens.index(solid[1]) + 1 :]
    if rest and rest[0][0] != "nl" and rest[0][1] != ";":
        return ("misplaced operator", rest[0][2])
    depth, start, header = 0, True, False
    for k, t, at in rest:
        if k == "nl":
            if depth == 0 and not header:
                start = True
            continue
        if t == ";":
            start = depth == 0
            continue
        if start and depth == 0 and t not in _GO_TOP:
            return ("misplaced word", at)
        if start and depth == 0:
            header = t == "func"
        start = False
        if k == "open":
            depth += 1
        elif k == "close":
            depth -= 1
            if depth == 0 and t == "}":
                header = False
    last = solid[-1]
    if header or (last[0] == "op" and last[1] not in ("++", "--", ";")) or last[1] in _GO_TOP:
        return ("premature end", last[2])
    lead = frozenset("package import func type var const return go defer case if for switch select range else chan map struct interface goto break continue default".split())
    if fault := _operands(solid, False):
        return fault
    # Names are followed by types, so only other pairs are out of place.
    for (k1, t1, _), (k2, t2, at) in zip(tokens, tokens[1:]):
        if k1 in ("num", "str") and k2 in ("num", "str", "word"):
            return ("misplaced word", at)
        if k1 == "word" and t1 not in lead and k2 == "num":
            return ("misplaced word", at)
    return None


def _java_methods(solid: list[tuple[str, str, int]]) -> frozenset[str]:
    """Types with which methods of an unnamed class begin: ``void`` and its like, or a name in capitals, before a name and ``(``."""
    found = set()
    for (k1, t1, _), (k2, _, _), (_, t3, _) in zip(solid, solid[1:], solid[2:]):
        if k1 == k2 == "word" and t3 == "(" and (t1 in ("void", "int", "long", "boolean", "double", "char", "byte", "short", "float") or t1[0].isupper()):
            found.add(t1)
    return frozenset(found)


def _java(text: str) -> Fault | None:
    tokens, fault = _braced(text, "java")
    if fault:
        return fault
    solid = [t for t in tokens if t[0] != "nl"]
    if not solid:
        return None
    fault = _top(tokens, _JAVA_TOP | _java_methods(solid), False)
    if fault:
        return fault
    if solid[-1][1] not in ("}", ";"):
        return ("premature end", solid[-1][2])
    if fault := _operands(solid, True):
        return fault
    for i, (_, t, at) in enumerate(solid):
        if t in ("package", "import") and (i == 0 or solid[i - 1][1] in (";", "}")):
            j = i + 1
            while j < len(solid) and (solid[j][0] == "word" or solid[j][1] in (".", "*")):
                if j > i + 1 and solid[j][0] == solid[j - 1][0] == "word" and solid[j - 1][1] != "static":
                    return ("misplaced word", solid[j][2])
                j += 1
            if j == i + 1 or j >= len(solid) or solid[j][1] != ";":
                return ("misplaced word", at)
    return None


def _rust(text: str) -> Fault | None:
    tokens, fault = _braced(text, "rust")
    if fault:
        return fault
    solid = [t for t in tokens if t[0] != "nl"]
    if not solid:
        return None
    depth, start = 0, True
    for i, (k, t, at) in enumerate(solid):
        if start and depth == 0 and t not in _RUST_TOP and t != ";":
            macro = k == "word" and i + 1 < len(solid) and solid[i + 1][1] in ("!", "::")
            if not macro:
                return ("misplaced word", at)
        start = False
        if k == "open":
            depth += 1
        elif k == "close":
            depth -= 1
            start = depth == 0 and (t == "}" or (t == "]" and _attribute(solid, i)))
        elif t == ";" and depth == 0:
            start = True
    if solid[-1][1] not in ("}", ";", "]", ")"):
        return ("premature end", solid[-1][2])
    if fault := _operands(solid, False):
        return fault
    lead = frozenset("return in if match while break else yield loop move unsafe await dyn where and or".split())
    for (k1, t1, _), (k2, _, at) in zip(solid, solid[1:]):
        if k1 == "word" and k2 == "num" and t1 not in lead:
            return ("misplaced word", at)
    if solid[-1][1] in (")", "]") and not _attribute(solid, len(solid) - 1):
        return ("premature end", solid[-1][2])
    return None


def _attribute(solid: list[tuple[str, str, int]], close: int) -> bool:
    depth = 0
    for i in range(close, -1, -1):
        depth += (solid[i][0] == "close") - (solid[i][0] == "open")
        if depth == 0:
            return i > 0 and (solid[i - 1][1] == "#" or (solid[i - 1][1] == "!" and i > 1 and solid[i - 2][1] == "#"))
    return False


_PY = re.compile(
    r"""(?P<com>\#[^\n]*)|(?P<long>[rRbBuUfFtT]{0,2}(?P<q>\"{3}|'{3}))|(?P<str>[rRbBuUfFtT]{0,2}(?:"(?:[^"\\\n]|\\(?:\r\n|.|\n))*"|'(?:[^'\\\n]|\\(?:\r\n|.|\n))*'))
    |(?P<bad>["'])|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<nl>\n)|(?P<word>[^\W\d]\w*)|(?P<num>\d[\w.]*)|(?P<join>\\\r?\n)|(?P<ws>[^\S\n]+)|(?P<op>.)""",
    re.X | re.S,
)


def _python(text: str) -> Fault | None:
    """Literals, brackets, indentation and block headers; then, for what passes, the language's own parser."""
    text = text.removeprefix("﻿")
    conflicts, stack, i, n = _starts(text), [], 0, len(text)
    header, last = False, ""
    first, indents = True, [0]
    while i < n:
        if i in conflicts:
            return ("conflict", i)
        m = _PY.match(text, i)
        kind, piece, at = m.lastgroup, m.group(), i
        i = m.end()
        if kind == "q":
            kind = "long"
        if kind in ("ws", "com", "join"):
            continue
        if kind == "nl":
            if not stack:
                header, first, last = (last == ":") if last else header, True, ""
            continue
        if first and not stack:
            width = at - (text.rfind("\n", 0, at) + 1)
            if header and width <= indents[-1]:
                return ("premature end", at)
            if header:
                indents.append(width)
            while width < indents[-1]:
                indents.pop()
            first = header = False
        if kind == "long":
            quote = m.group("q")
            while True:
                end = text.find(quote, i)
                if end < 0:
                    return ("unterminated literal", at)
                back = end
                while back > i and text[back - 1] == "\\":
                    back -= 1
                i = end + 3
                if (end - back) % 2 == 0:
                    break
                i = end + 1
        elif kind == "bad":
            return ("unterminated literal", at)
        elif kind == "open":
            stack.append(piece)
        elif kind == "close":
            if not stack or stack.pop() != _PAIRS[piece]:
                return ("unbalanced", at)
        last = piece if kind in ("op", "close", "open") else "x"
    if stack or header or last == ":":
        return ("premature end", n)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except (SyntaxError, ValueError) as e:
            return ("no parse", getattr(e, "offset", 0) or 0)
        except (RecursionError, MemoryError):
            return None
    return None


_RB = re.compile(
    r"""(?P<doc>^=begin\b.*?^=end[^\n]*)|(?P<com>\#[^\n]*)|(?P<here><<[-~]?(?P<hq>['"`]?)(?P<tag>[A-Z_a-z]\w*)(?P=hq)(?!\w))
    |(?P<str>%[wWiIqQrxs]?(?:\([^)]*\)|\[[^\]]*\]|\{[^}]*\}|![^!]*!|\|[^|]*\|)|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|\?[^\s\w](?!\w)|\?\w(?!\w))
    |(?P<bad>["'`])|(?P<sym>:(?:[^\W\d]\w*[?!=]?|"(?:[^"\\]|\\.)*")(?!:))|(?P<word>(?:@{1,2}|\$)?[^\W\d]\w*[?!]?)|(?P<num>\d[\w.]*?\d*(?=\.\w|\W|$))|(?P<open>[(\[{])|(?P<close>[)\]}])
    |(?P<nl>[\n;])|(?P<join>\\\r?\n)|(?P<ws>[^\S\n]+)|(?P<op>->|=>|::|&\.|\.\.\.?|[-+*/%&|^<>=!~]+|[,.:?])|(?P<odd>.)""",
    re.X | re.S | re.M,
)
_RB_VALUE_WORDS = frozenset("if unless while until and or not then do else elsif when case return in yield raise puts require print end rescue ensure begin".split())
_RB_REGEX = re.compile(r"/(?:[^/\\\n]|\\.)+/[a-z]*")


def _interpolated(text: str, at: int) -> int:
    """The offset after a string that starts at ``at`` and may hold code in ``#{}``, or -1; a stack holds what is open."""
    open_, i, n = [text[at]], at + 1, len(text)
    while i < n:
        c, inner = text[i], open_[-1]
        if inner in "\"`":
            if c == "\\":
                i += 1
            elif c == inner:
                open_.pop()
                if not open_:
                    return i + 1
            elif text.startswith("#{", i):
                open_.append("{")
                i += 1
        elif c in "\"`{":
            open_.append(c)
        elif c == "}":
            open_.pop()
        elif c == "'" and (m := re.compile(_SQ).match(text, i)):
            i = m.end() - 1
        i += 1
    return -1


def _ruby(text: str) -> Fault | None:
    """``def``, ``do`` and their like are opened on the stack and closed by ``end``."""
    conflicts, i, n = _starts(text), 0, len(text)
    stack: list[tuple[str, int]] = []
    heredocs: list[str] = []
    prev, loop = ("nl", "\n"), False
    while i < n:
        if i in conflicts:
            return ("conflict", i)
        m = _RB.match(text, i)
        kind, piece, at = m.lastgroup, m.group(), i
        i = m.end()
        if kind in ("hq", "tag"):
            kind = "here"
        start = prev[0] == "nl" or prev[1] in ("(", "[", "{", "then", "else", "do", "begin", "|", "=", "ensure") or (prev[0] == "op" and prev[1] not in (".", "&.", "::"))
        if kind in ("ws", "com", "join", "doc"):
            continue
        if kind == "here":
            # ``a << b`` appends; a document starts where no value precedes or its name is in capitals.
            if prev[0] in ("word", "close", "num") and not m.group("tag").isupper() and text[at + 2] not in "-~":
                prev = ("op", "<<")
                i = at + 2
                continue
            heredocs.append(m.group("tag"))
            prev = ("str", piece)
            continue
        if kind == "op" and piece[0] == "/" and (start or (prev[0] == "word" and prev[1] in _RB_VALUE_WORDS)) and (r := _RB_REGEX.match(text, at)):
            kind, i = "str", r.end()
        if kind == "nl":
            loop = False
            if piece == "\n" and heredocs:
                for tag in heredocs:
                    end = re.compile(rf"^[ \t]*{tag}\r?$", re.M).search(text, i)
                    if not end:
                        return ("unterminated literal", at)
                    i = min(n, end.end() + 1)
                heredocs = []
            if not (prev[0] == "op" and prev[1] in (",", ".", "&&", "||", "+", "=")):
                prev = ("nl", piece)
            continue
        if kind == "bad" or (kind == "str" and piece[0] in '"`'):
            end = _interpolated(text, at)
            if end < 0:
                return ("unterminated literal", at)
            kind, i = "str", end
        if kind == "odd" and piece != "﻿":
            return ("stray character", at)
        operand = kind in ("word", "num", "str", "sym")
        if operand and prev[0] == "close" and prev[1] != "|" and not (kind == "word" and (piece in _RB_VALUE_WORDS)) and not (kind == "str" and piece[0] in "%?"):
            return ("misplaced word", at)
        if operand and prev[0] in ("num", "str") and not (kind == "str" and prev[0] == "str") and not (kind == "word" and piece in _RB_VALUE_WORDS):
            return ("misplaced word", at)
        if piece == "->" and prev[0] == "close":
            return ("misplaced operator", at)
        if kind == "op" and prev[0] == "nl" and piece[0] in "<>=|" :
            return ("misplaced operator", at)
        if kind == "open":
            stack.append((piece, at))
        elif kind == "close":
            if not stack or stack[-1][0] != _PAIRS[piece]:
                return ("unbalanced", at)
            stack.pop()
        elif kind == "word" and prev[1] not in (".", "&.", "def") and not text.startswith(":", i) or (kind == "word" and text.startswith("::", i)):
            if piece in ("def", "class", "module", "begin", "case") or (piece in ("if", "unless", "while", "until", "for") and start):
                stack.append((piece, at))
                loop = piece in ("while", "until", "for")
            elif piece == "do":
                if loop:
                    loop = False
                else:
                    stack.append((piece, at))
            elif piece == "end":
                if not stack or stack[-1][0] in "([{":
                    return ("unbalanced", at)
                if prev[0] == "op" and prev[1] in ("+", "-", "*", "/", "=", "==", "&&", "||", "<<"):
                    return ("misplaced operator", at)
                stack.pop()
        # ``def name = value`` has no end.
        if kind == "op" and piece == "=" and stack and stack[-1][0] == "def" and re.match(r"def\s+[\w.]+[?!]?\s*(\([^)]*\))?\s*$", text[stack[-1][1] : at]):
            stack.pop()
        prev = (kind, piece)
    if heredocs:
        return ("unterminated literal", n)
    if stack:
        return ("premature end", stack[-1][1])
    if prev[0] == "op" and prev[1] in (",", "=", "+", "&&", "||", "."):
        return ("premature end", n)
    return None


_SH_WORD = re.compile(r"[^\s;&|()<>\"'`$\\#{}]+|#")
_SH_OPENERS = {"if": "fi", "case": "esac", "do": "done"}


class _Shell:
    """A scanner of shell text; nested substitutions are scanned by recursion."""

    def __init__(self, text: str):
        self.text, self.n, self.conflicts = text, len(text), _starts(text)
        self.heredocs: list[tuple[str, bool]] = []

    def double(self, i: int) -> int:
        t = self.text
        start = i
        i += 1
        while i < self.n:
            c = t[i]
            if c == "\\":
                i += 2
            elif c == '"':
                return i + 1
            elif c == "`":
                i = self.back(i)
            elif c == "$":
                i = self.dollar(i)
            else:
                i += 1
        raise _Stop("unterminated literal", start)

    def back(self, i: int) -> int:
        end = i + 1
        while end < self.n and self.text[end] != "`":
            end += 2 if self.text[end] == "\\" else 1
        if end >= self.n:
            raise _Stop("unterminated literal", i)
        return end + 1

    def dollar(self, i: int) -> int:
        t = self.text
        if t.startswith("$((", i):
            depth, j = 0, i + 1
            while j < self.n:
                depth += (t[j] == "(") - (t[j] == ")")
                j += 1
                if not depth:
                    return j
            raise _Stop("premature end", i)
        if t.startswith("$(", i):
            return self.block(i + 2, ")", i)
        if t.startswith("${", i):
            j = i + 2
            while j < self.n:
                c = t[j]
                if c == "}":
                    return j + 1
                if c == "\\":
                    j += 2
                elif c == '"':
                    j = self.double(j)
                elif c == "$":
                    j = self.dollar(j)
                elif c == "'" and '"' not in t[i:j]:
                    k = t.find("'", j + 1)
                    j = k + 1 if k > 0 else j + 1
                else:
                    j += 1
            raise _Stop("premature end", i)
        return i + 2 if i + 1 < self.n and t[i + 1] in "@*#?$!-0123456789" else i + 1

    def block(self, i: int, until: str, opened: int) -> int:
        """Scan commands up to ``until`` (``)`` or the end of the text); returns the offset after it."""
        t, stack, command, case_pattern, words, glued = self.text, [], True, False, 0, False
        loop_words = False
        while True:
            if i >= self.n:
                if until or stack:
                    raise _Stop("premature end", stack[-1][1] if stack else opened)
                return i
            if i in self.conflicts:
                raise _Stop("conflict", i)
            c = t[i]
            if c == "\n":
                if glued == "redirect":
                    raise _Stop("misplaced operator", i)
                i += 1
                if self.heredocs:
                    for tag, strip in self.heredocs:
                        end = re.compile(rf"^{chr(9) + '*' if strip else ''}{re.escape(tag)}\r?$", re.M).search(t, i)
                        if not end:
                            raise _Stop("unterminated literal", i)
                        i = min(self.n, end.end() + 1)
                    self.heredocs = []
                command, words, glued = True, 0, False
                if stack and stack[-1][0] == "esac" and stack[-1][2]:
                    case_pattern = True
                continue
            if c in " \t\r":
                i, glued = i + 1, glued if glued == "redirect" else False
                continue
            if c == "#" and not glued or (c == "#" and glued == "redirect"):
                end = t.find("\n", i)
                i = self.n if end < 0 else end
                continue
            if c == "\\":
                i, glued, command = i + 2, "word", False
                continue
            if c in "\"'`$":
                if c == "'":
                    end = t.find("'", i + 1)
                    if end < 0:
                        raise _Stop("unterminated literal", i)
                    i = end + 1
                elif c == "$" and t.startswith("$'", i):
                    m = re.compile(r"\$'(?:[^'\\]|\\.)*'", re.S).match(t, i)
                    if not m:
                        raise _Stop("unterminated literal", i)
                    i = m.end()
                else:
                    i = self.double(i) if c == '"' else self.back(i) if c == "`" else self.dollar(i)
                glued, command = "quoted", False
                words += 1
                continue
            if c in ";&|":
                two = t[i : i + 2]
                if two in (";;", ";&"):
                    if not stack or stack[-1][0] != "esac":
                        raise _Stop("misplaced operator", i)
                    case_pattern = True
                    i += 2
                else:
                    if command and words == 0 and c in "|;" and not case_pattern and not loop_words:
                        raise _Stop("misplaced operator", i)
                    i += 2 if two in ("&&", "||", "|&", "&>") else 1
                    loop_words = False
                command, words, glued = True, 0, "redirect" if two == "&>" else False
                continue
            if c in "<>":
                if t.startswith("<<<", i):
                    i += 3
                    glued = "redirect"
                    continue
                m = re.compile(r"<<(-?)\s*(['\"]?)([\w.-]+)\2").match(t, i)
                if m:
                    self.heredocs.append((m.group(3), bool(m.group(1))))
                    i, glued = m.end(), "word"
                    continue
                if t[i + 1 : i + 2] == "(":
                    i, glued, command = self.block(i + 2, ")", i), "word", False
                    continue
                if glued == "redirect":
                    raise _Stop("misplaced operator", i)
                i += 2 if t[i : i + 2] in (">>", "<>", ">&", "<&", ">|") else 1
                glued, command = "redirect", False
                continue
            if c == "(":
                if case_pattern:
                    i += 1
                    continue
                if t.startswith("((", i) and command:
                    depth, j = 0, i
                    while j < self.n:
                        depth += (t[j] == "(") - (t[j] == ")")
                        j += 1
                        if not depth:
                            break
                    if depth:
                        raise _Stop("premature end", i)
                    i, command, glued = j, False, False
                    continue
                if glued == "word" and t[i - 1] == "=":
                    i, glued = self.block(i + 1, ")", i), "word"
                    continue
                if glued == "word" or not command:
                    m = re.compile(r"\(\s*\)").match(t, i)
                    if not m or words > 1 + (self.before == "function"):
                        raise _Stop("misplaced operator", i)
                    i, command, words, glued = m.end(), True, 0, False
                    nxt = re.compile(r"\s*(?:#[^\n]*\s*)*").match(t, i).end()
                    if nxt >= self.n:
                        raise _Stop("premature end", i)
                    continue
                i, command, glued = self.block(i + 1, ")", i), False, "close"
                continue
            if c == ")":
                if case_pattern:
                    case_pattern, command, words, i, glued = False, True, 0, i + 1, False
                    continue
                if until == ")" and not stack:
                    return i + 1
                raise _Stop("unbalanced", i)
            if c in "{}":
                if c == "{" and command and t[i + 1 : i + 2] in ("", " ", "\n", "\t", "\r"):
                    stack.append(("}", i, False))
                    i, command, words, glued = i + 1, True, 0, False
                elif c == "}" and command and words == 0:
                    if not stack or stack[-1][0] != "}":
                        raise _Stop("unbalanced", i)
                    stack.pop()
                    i, command, glued = i + 1, False, "close"
                else:
                    i, glued, command = i + 1, "word", False
                continue
            m = _SH_WORD.match(t, i)
            word, at = m.group(), i
            i = m.end()
            if glued in ("word", "quoted"):
                glued = "word"
                continue
            whole = i >= self.n or t[i] in " \t\r\n;&|()<>"
            glued_before, glued = glued, "word"
            if glued_before == "redirect":
                continue
            if case_pattern:
                if word == "esac" and whole and stack and stack[-1][0] == "esac":
                    stack.pop()
                    case_pattern, command = False, False
                continue
            if command and whole:
                if word == "[[":
                    end = re.compile(r"(?:[^\"'\\\]]|\\.|\"(?:[^\"\\]|\\.)*\"|'[^']*'|\](?!\]))*\]\]", re.S).match(t, i)
                    if not end:
                        raise _Stop("premature end", at)
                    i, command, words = end.end(), False, 1
                    continue
                if word in _SH_OPENERS:
                    if word == "do" and not (stack and stack[-1][0] == "do"):
                        raise _Stop("unbalanced", at)
                    if word == "do":
                        stack.pop()
                    stack.append((_SH_OPENERS[word], at, word != "case"))
                    command, words = word != "case", 0
                    if word == "case":
                        loop_words = True
                    continue
                if word in ("for", "while", "until", "select"):
                    stack.append(("do", at, False))
                    command, words, loop_words = word in ("while", "until"), 0, True
                    if word == "for" and (m := re.compile(r"\s*\(\(").match(t, i)):
                        depth, i = 0, m.end() - 2
                        while i < self.n:
                            depth += (t[i] == "(") - (t[i] == ")")
                            i += 1
                            if not depth:
                                break
                        if depth:
                            raise _Stop("premature end", at)
                    continue
                if word in ("then", "else", "elif"):
                    if not stack or stack[-1][0] != "fi":
                        raise _Stop("unbalanced", at)
                    command, words = True, 0
                    continue
                if word in ("fi", "done", "esac"):
                    if not stack or stack[-1][0] != word:
                        raise _Stop("unbalanced", at)
                    stack.pop()
                    command, glued = False, "close"
                    continue
                if word in ("!", "time"):
                    continue
            if word == "in" and whole and loop_words:
                loop_words = False
                if stack and stack[-1][0] == "esac" and not stack[-1][2]:
                    stack[-1] = ("esac", stack[-1][1], True)
                    case_pattern = True
                continue
            self.before = word if command else ""
            assignment = command and "=" in word
            command = command and assignment
            # An assignment is no command's name, but not nothing either.
            words += 0.5 if assignment else 1

    before = ""


class _Stop(Exception):
    pass


def _shell(text: str) -> Fault | None:
    try:
        scanner = _Shell(text)
        scanner.block(0, "", 0)
        if scanner.heredocs:
            return ("unterminated literal", len(text))
    except _Stop as e:
        return (e.args[0], e.args[1])
    except RecursionError:
        # Deeper than can be followed: nothing shows that it is faulty.
        return None
    return None


_PROSE = re.compile(r"^[A-Z`\"'][^\n{};=$|&<>]*\s[^\n{};=$|&<>]*\s[^\n{};=$|&<>]*[.?!]\s*$", re.M)
_SHEBANG = re.compile(r"^﻿?#![^\n]*\b(python|ruby|node|bash|sh|zsh|dash|ksh)[\d.]*\b")
_RUNS = {"python": {"python"}, "ruby": {"ruby"}, "node": {"javascript", "typescript", "tsx"}, **{s: {"bash"} for s in ("bash", "sh", "zsh", "dash", "ksh")}}


def _prose(text: str) -> bool:
    """Whether the lines that aren't comments read like sentences, which a tolerant grammar would take for commands."""
    lines = [x for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    return bool(lines) and sum(bool(_PROSE.match(x)) for x in lines) * 2 > len(lines)


def check(text: str, language: str) -> Fault | None:
    """The first fault of ``text`` in ``language``, or None. Blank and comment-only texts and unknown languages have none."""
    if not text.strip():
        return None
    text = text.replace("\r\n", "\n")
    if (m := _SHEBANG.match(text)) and language in ("python", "ruby", "bash", "javascript", "typescript", "tsx") and language not in _RUNS[m.group(1)]:
        return ("other language", 0)
    if language in ("javascript", "typescript", "tsx"):
        return _script(text, language)
    if language == "python":
        return _python(text)
    if language == "go":
        return _go(text)
    if language == "java":
        return _java(text)
    if language == "rust":
        return _rust(text)
    if language == "ruby":
        return _ruby(text) or (("other language", 0) if _prose(text) else None)
    if language == "bash":
        return _shell(text) or (("other language", 0) if _prose(text) else None)
    return None
