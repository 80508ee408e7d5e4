"""Keyword-stuffed pages, link lists and tag lists.

Every text gets measures: shares of the commonest words, of repeated words, of repeated word triples and of repeated
phrases, share of duplicate lines, ratio of link text, density of separators, share of function words, share of
words that stand in sentences (once with each sentence counted once, once with all), and share of lines that are matter in another form (code,
logs, listings, tables, fields).  The language is found by its function words, not taken from the metadata.
Thresholds on function words and repetition are calibrated per language and class of length over all documents of prose,
texts of a language without a list of function words among themselves.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut

# Common function words of the languages that are told apart.
FUNCTION_WORDS = {
    "en": "the a an of to in is and that it for on with as be are was by or not this no so if but who has when which into before after until every each must only "
    "we were have had would nobody somebody than at from its they there what how does do did can may should been being while because other one two all any both "
    "their your our his her my you he she them him me us also then there's isn't don't will just over under between through out up down off again more most some such nor too very",
    "de": "der die das den dem des ein eine einen einem einer und oder nicht ist sind war wird werden wir er sie es ich du ihr bis für noch mal weil wenn nach erst auf aus bei mit von vor zu zum zur im in an am als auch nur dass kein keine keinen sich etwa seit um durch über unter gibt",
    "es": "el la los las un una unos unas de del que en y o a al no se por para con sin cuando como pero más ya hay su sus lo le les es son fue está sigue hasta ni si porque quién qué esta este otra vez ningún ninguna sobre entre después",
    "fr": "le la les un une des de du et ou à au aux en que qui ne pas plus pour par dans sur avec sans est sont a été il elle on nous vous ils elles ce cette ces se sa son ses leur quand comme mais si où donc avant après jusqu aucun aucune lorsque chaque encore",
    "zh": "的 了 在 是 和 就 都 被 把 这 那 个 有 没 不 会 要 也 很 之 仍 如果 之后 之前 因为 所以 但是 一直 已经 谁 将 为 与 或 从 到 对 里 后 前 时",
}
_WORDS = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
_LATIN = {lang: words for lang, words in _WORDS.items() if lang != "zh"}
_HAN_FUNCTION = re.compile("|".join(sorted(_WORDS["zh"], key=len, reverse=True)))

_LINK = re.compile(r"<a\s[^>]*>.*?</a\s*>|!?\[[^\]\n]*\]\((?:https?://|www\.)[^)\s]*\)|\bhttps?://[^\s<>\"')]+|\bwww\.[^\s<>\"')]+", re.S | re.I)
_TAGS = re.compile(r"</?[a-zA-Z][^<>\n]*>")
_HASH = re.compile(r"(?<!\S)#\w+")
#: Words, ends of sentences and ends of lines.
_PARTS = re.compile(r"[^\W\d_]+|[.!?。？！]+(?=[\s\"'”’)\]*]|$)|\n")
_STOP = re.compile(r"[.!?。？！]+(?=[\s\"'”’)\]*]|$)|\n")
_LETTERS = re.compile(r"[^\W\d_]+")
_HAN = re.compile(r"[㐀-鿿]")
_SEGMENT = re.compile(r"[\n\r\t,;|/•·>→»«›–—\[\](){}#:、，；|]+|\s[-*]\s|\s{2,}")
_SEPARATOR = re.compile(r"[,;|/•·>→»›–—#、，；]")
_SENTENCE = re.compile(r"[^.!?。？！\n]+[.!?。？！]+(?=[\s\"'”’)\]*]|$|[^\x00-\x7f])")
#: Lines that carry matter in another form than sentences.
_MATTER = re.compile(
    r"""^\s*(?:
      \[?\d{4}-\d\d-\d\d                       # logs
      |[│├└|+`\s]*[├└│]                        # trees
      |\|.*\|\s*$                              # tables
      |[-*]?\s*\**[A-Z][\w ]{0,24}:\**(?:\s+\S+){0,3}\s*$   # fields
      |[-*]\s+`[^`\n]+`                        # listings of names
      |\#{1,6}\s+(?:Milestone|Step|\[)         # numbered headings
      |\#{2,6}\s+[\w.]+\s*$
      |[{}\])]+[;,)]*\s*$                      # code
      |.*[;{]\s*$
      |.*\b(?:def|func|fn|function|class|return|import|package|raise|throw|const|let|local|static|public|end|elif|else|fi|done|esac|if|for|while|try|use|from|var)\b.*[:;({})=]\s*.*$
      |.*\w\([^()\s]*(?:,\s*[^()]*)?\)\s*.*$
      |\{"[^"]+":
      |["/]{2,}|/\*|\*/|\*\s@
    )""",
    re.X,
)

#: Below this share of function words a text isn't known to be in the language.
WEAK = 0.06
#: Texts of prose that a class needs to be calibrated by itself.
ENOUGH = 20
MEASURES = (
    "key long, language string, n_words int, n_links int, link_ratio double, tag_ratio double, function_share double, top_share double, round_share double, gram_share double, "
    "repeat_share double, duplicate_lines double, separator_density double, sentence_share double, copied_share double, matter_share double, code_density double"
)


def measure(text: str | None) -> tuple:
    """The measures of one text, in the order of ``MEASURES`` without the key. Null and empty texts have zeros.

    ``top_share`` is the share of words that are one of the five commonest, if these occur three times or more;
    ``round_share`` that of words that occurred before; ``gram_share`` that of triples of words that occur elsewhere too.
    Where half of the words or more stand in sentences no kind of spam is possible; then the measures that only tell
    its kinds and other matter apart (tags, phrases, matter, code) are null.
    """
    if not text or not text.strip():
        return ("", 0, 0, *[0.0] * 13)
    solid = len(text) - sum(map(text.count, " \n\r\t"))
    n_links = link_chars = 0
    rest = text
    if "<a" in text or "://" in text or "www." in text or "<A" in text:
        found = _LINK.findall(text)
        n_links, link_chars = len(found), sum(map(len, found))
        rest = _LINK.sub(" ", text)
    if "<" in rest:
        bare = _TAGS.sub(" ", rest)
        if n_links:
            link_chars += len(rest) - len(bare)
        rest = bare if n_links else rest
    lower = rest.lower()
    parts = _PARTS.findall(lower)
    counts = Counter(parts)
    ends = frozenset(w for w in counts if not w[0].isalpha())
    n = len(parts) - sum(counts.pop(w) for w in ends)
    han = len(_HAN.findall(lower)) if not text.isascii() else 0
    hits = {lang: sum(counts[w] for w in counts.keys() & fw) for lang, fw in _LATIN.items()}
    language = max(hits, key=lambda k: (hits[k], k == "en"))
    words = None
    if han * 4 > solid - link_chars and han:
        language = "zh"
        if n * 3 < han:
            words = _HAN.findall(lower)
            counts = Counter(words)
            n = han
        function = sum(len(m) for m in _HAN_FUNCTION.findall(lower)) / max(1, han)
    else:
        function = hits[language] / max(1, n)
        if function < WEAK:
            # No language with a list: what is written in one script is judged by itself.
            first = next((w[0] for w in parts if w[0].isalpha()), "a")
            language = "und-latin" if first < "\u0250" else f"und-{ord(first) >> 8:x}"
    link_ratio = min(1.0, link_chars / solid)
    if not n:
        return (language, 0, n_links, link_ratio, *[0.0] * 12)
    words = words or ([w for w in parts if w not in ends] if ends else parts)
    sentences, copied = (min(1.0, x / (han if language == "zh" else n)) for x in _spoken(rest, parts, ends, language))
    # Next to 1 only where a small vocabulary goes round.
    rounds = 1 - len(counts) / n
    top = sum(c for _, c in counts.most_common(5) if c >= 3) / n
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    gram = sum(c for c in grams.values() if c > 1) / max(1, n - 2)
    lines = [x for x in (y.strip() for y in rest.splitlines()) if x]
    duplicate = 1 - len(set(lines)) / len(lines) if lines else 0.0
    separators = len(_SEPARATOR.findall(rest)) / n
    if sentences >= 0.5:
        return (language, n, n_links, link_ratio, None, function, top, rounds, gram, None, duplicate, separators, sentences, copied, None, None)
    tags = sum(len(t) for t in _HASH.findall(rest)) if "#" in rest else 0
    segments = [s for s in (x.strip(" \"'`*.!?") for x in _SEGMENT.split(lower)) if s]
    known = Counter(segments)
    repeated = sum(c for c in known.values() if c > 1) / max(1, len(segments))
    matter = sum(len(x) for x in lines if _MATTER.match(x)) / max(1, sum(map(len, lines)))
    code = sum(map(rest.count, "(){}=;$\"")) / max(1, solid - link_chars)
    return (language, n, n_links, link_ratio, min(1.0, tags / max(1, solid - link_chars)), function, top, rounds, gram, repeated, duplicate, separators, sentences, copied, matter, code)


def _spoken(text: str, parts: list[str], ends: frozenset[str], language: str) -> tuple[int, int]:
    """How many words stand in sentences, first a repeated sentence once, then each time.

    A sentence has five words or more up to its stop, one in eight a function word.  Where the language has no list,
    it has few commas or the like, hardly any word twice and a good part of words that the text didn't have before.
    """
    spoken, all_spoken, had = 0, 0, set()
    if language == "zh":
        for m in _SENTENCE.finditer(text):
            piece = m.group().strip()
            h = len(_HAN.findall(piece))
            if h >= 6 and _HAN_FUNCTION.search(piece):
                all_spoken += h
                spoken += 0 if piece in had else h
                had.add(piece)
        return spoken, all_spoken
    fw = _WORDS.get(language)
    if fw is not None:
        start = 0
        for stop in [i for i, w in enumerate(parts) if w in ends]:
            run = parts[start:stop]
            start = stop + 1
            if len(run) >= 5 and parts[stop] != "\n" and sum(map(fw.__contains__, run)) * 8 >= len(run):
                piece = " ".join(run)
                all_spoken += len(run)
                spoken += 0 if piece in had else len(run)
                had.add(piece)
        return spoken, all_spoken
    start = 0
    for m in _STOP.finditer(text):
        piece = text[start : m.start()]
        start = m.end()
        run = _LETTERS.findall(piece.lower())
        if len(run) < 5 or m.group() == "\n":
            had.update(run)
            continue
        kinds = set(run)
        if len(kinds) * 10 >= len(run) * 7 and len(kinds - had) * 10 >= len(run) * 3 and len(_SEPARATOR.findall(piece)) * 4 <= len(run):
            spoken += len(run)
            all_spoken += len(run)
        had |= kinds
    return spoken, all_spoken


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 13]
    names = [part.split()[0] for part in MEASURES.split(", ")]
    for batch in batches:
        columns = list(zip(*map(measure, batch.column(1).to_pylist()), strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)


def spam_measures(docs: DataFrame) -> DataFrame:
    """The measures of every document of ``docs(doc_id, text)``, over its whole text."""
    return docs.select(F.col("doc_id").cast("long").alias("key"), "text").mapInArrow(_measure, MEASURES)


def _length_class():
    """Texts of about one length: the power of two up to the number of words, from 16 on."""
    return F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(16)))).cast("int").alias("size")


def calibrate(measures: DataFrame) -> DataFrame:
    """Per language and class of length, over all documents of prose: usual function words and repetition.

    ``(language, size, n, usual_function, usual_round, usual_top, usual_gram, usual_lines)``; a row with ``size`` null
    is for all lengths, one with null ``language`` and ``size`` for everything.  Repetition is that which one text of prose
    in ten exceeds, for ``round`` one in four.  At most as many rows as there are languages and scripts times some twenty.
    """
    prose = measures.where("n_words >= 16 and sentence_share >= 0.5").withColumn("size", _length_class())
    high = lambda c, p: F.percentile_approx(c, p, 1000)
    return prose.rollup("language", "size").agg(
        F.count("*").alias("n"), high("function_share", 0.5).alias("usual_function"), high("round_share", 0.75).alias("usual_round"),
        high("top_share", 0.9).alias("usual_top"), high("gram_share", 0.9).alias("usual_gram"), high("duplicate_lines", 0.9).alias("usual_lines"),
    )


def classify(measures: DataFrame, usual: DataFrame) -> DataFrame:
    """``(key, kind)``: ``links``, ``tags``, ``keywords`` or null for texts that aren't spam.

    A text with a quarter or more of its words in sentences is never spam, unless a handful of words goes round, and one
    with noticeable matter in another form or under eight words never stuffed with keywords.  A class of under
    ``ENOUGH`` texts of prose goes by its language, such a language by all texts, and where there is no prose at all the
    lower bounds hold.  Function words count where the language has a list.
    """
    names = ["usual_function", "usual_round", "usual_top", "usual_gram", "usual_lines"]
    usual = usual.where(F.col("language").isNull() | (F.col("n") >= ENOUGH))
    classes = usual.where("size is not null").select(F.col("language").alias("l1"), F.col("size").alias("s1"), *[F.col(c).alias(f"{c}_1") for c in names])
    languages = usual.where("size is null and language is not null").select(F.col("language").alias("l2"), *[F.col(c).alias(f"{c}_2") for c in names])
    everything = usual.where("language is null")
    m = measures.withColumn("size", _length_class())
    # At most some hundred rows: languages and scripts times classes of length.
    m = m.join(F.broadcast(classes), (F.col("language") == F.col("l1")) & (F.col("size") == F.col("s1")), "left_outer").join(F.broadcast(languages), F.col("language") == F.col("l2"), "left_outer")
    for c in names:
        # How common function words are says nothing about another language.
        m = m.withColumn(c, F.coalesce(f"{c}_1", f"{c}_2", F.lit(0.4) if c == "usual_function" else everything.agg(F.max(c)).scalar()))
    listed = F.col("language").isin(*FUNCTION_WORDS)
    function = F.when(listed, F.col("function_share") / F.greatest(F.lit(0.2), "usual_function")).otherwise(F.lit(0.0))
    above = lambda c, low, high: F.col(f"{c}_share" if c != "lines" else "duplicate_lines") >= F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(f"usual_{c}", F.lit(low))))
    # Where a handful of words goes round, cries that end like sentences count for less.
    silent = (F.col("sentence_share") < 0.25) | ((F.col("sentence_share") < 0.5) & (F.col("round_share") >= 0.75))
    other = (F.col("matter_share") >= 0.3) | (F.col("code_density") >= 0.012)
    links = (F.col("n_links") >= 3) & (F.col("link_ratio") >= 0.5) & silent
    tags = (F.col("tag_ratio") >= 0.5) & (F.col("n_words") >= 5) & silent
    crumbs = (F.col("separator_density") >= 0.15) & (F.col("repeat_share") >= 0.4) & (F.col("round_share") >= 0.25)
    again = above("round", 0.4, 0.8) | above("gram", 0.5, 0.9) | above("lines", 0.5, 0.9) | crumbs
    strong = above("round", 0.65, 0.9) | above("top", 0.5, 0.8)
    # Prose that was copied over and over has no new sentences, but as many function words as prose.
    prose_again = (F.col("copied_share") >= 0.9) & (F.col("function_share") >= 0.2) & (function >= 0.65)
    stuffed = (again & (function <= 0.75) | strong & (function <= 0.95)) & ~prose_again
    keywords = stuffed & silent & ~other & (F.col("n_words") >= 8)
    return m.select("key", F.when(links, "links").when(tags, "tags").when(keywords, "keywords").alias("kind"))


def spam(docs: DataFrame) -> DataFrame:
    """``(doc_id, kind)`` of every document of ``docs(doc_id, text)``; ``kind`` is null where it isn't spam."""
    measures = cut(spam_measures(docs))
    return classify(measures, cut(calibrate(measures))).select(F.col("key").alias("doc_id"), "kind")
