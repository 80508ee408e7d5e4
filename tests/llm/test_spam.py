"""Pages of keywords, links and tags against documents in other forms."""

import random

import pytest

from weftline.llm.spam import measure, spam

WORDS = ["symbol search", "repo map", "call graph", "best planner", "task board"]
rng = random.Random(4)
pick = lambda n: [rng.choice(WORDS) for _ in range(n)]
PROSE = "The relay is kept until every tenant below it has been closed. We moved the marker because it was read by nobody else. "
SPAM = {
    "links": ["\n".join(f"- [{w}](https://a.example/{i})" for i, w in enumerate(pick(12))), "<ul>\n" + "\n".join(f'<li><a href="https://a.example/{i}">{w}</a></li>' for i, w in enumerate(pick(9))) + "\n</ul>", "best planner\n" + "\n".join(f"{i}. {w} https://a.example/{i}" for i, w in enumerate(pick(8))), "\n".join(f"https://a.example/{i}" for i in range(9))],
    "tags": [" ".join("#" + w.replace(" ", "_") for w in pick(15))],
    "keywords": [", ".join(pick(30)), " / ".join(pick(14)), " ".join(pick(30)), "\n".join(f"{w} | SKU {i} | tags: {x}, {y}" for i, (w, x, y) in enumerate(zip(pick(12), pick(12), pick(12)))), PROSE.split(". ")[0] + ".\n\n" + ", ".join(pick(80)), "Best repo map! Buy repo map now. Cheap call graph. " * 6],
}
FINE = [
    None, "", "  ", "Frozen seed replica", "answer", PROSE, PROSE * 40, "1234567890" * 20, "# Index\n\n" + "\n".join(f"- [{w}](https://a.example/{i}): the {w} is kept until it has been closed by hand." for i, w in enumerate(pick(9))),
    "## core.x\n\n" + "\n".join(f"- `f_{i}(a)` function, line {i}" for i in range(30)), "root/\n" + "\n".join(f"│   ├── mod_{i}.py" for i in range(30)), "\n".join(f"2026-01-01 10:00:{i:02d} INFO a.b: done" for i in range(30)),
    "def f(a):\n    return a\n\n" * 20, "| a | b |\n|---|---|\n" + "| x | y |\n" * 20, "# Plan\n\n" + "\n".join(f"## Milestone {i}: X\n- Status: PENDING\n- Gate: SOFT\n- Mode: AFK\n" for i in range(9)), "这个模块在阶段关闭之前一直保持冻结。如果符号缺失，就说明快照被有意跳过。" * 9,
    '{"role": "user", "content": "the plan was read by all of us before it was closed"}\n' * 5,
]


@pytest.fixture(scope="module")
def judged(spark):
    texts = [t for ts in SPAM.values() for t in ts] + FINE + [PROSE + f"It is the {i}th note that we have." for i in range(30)]
    df = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, language string")
    got = {r.doc_id: r.kind for r in spam(df).collect()}
    assert len(got) == len(texts)
    return {t: got[i] for i, t in enumerate(texts)}


@pytest.mark.parametrize("kind", SPAM)
def test_spam(judged, kind):
    assert [judged[t] for t in SPAM[kind]] == [kind] * len(SPAM[kind])


def test_other_matter(judged):
    assert {t: judged[t] for t in FINE if judged[t]} == {}


def test_copies_and_empty_table(spark):
    schema = "doc_id long, text string"
    text = SPAM["keywords"][0]
    assert [r.kind for r in spam(spark.createDataFrame([(1, text), (2, text), (2, text)], schema)).collect()] == ["keywords"] * 3
    assert spam(spark.createDataFrame([], schema)).count() == 0


def test_measures_of_nothing_and_of_much():
    assert measure(None) == measure("") == measure(" \n")
    assert measure("a" * 300_000)[1] == 1 and measure("word " * 200_000)[6] > 0.99


#: Prose in languages without a list of function words, and stuffing that is shaped like sentences.
POLISH = "Rano poszedłem do sklepu, bo w domu zabrakło już chleba. Sprzedawczyni opowiadała właśnie sąsiadce długą historię o swoim psie. Nikt się nie spieszył, więc usiadłem przy oknie i czytałem gazetę. Po godzinie zaczął padać deszcz, a ulica szybko opustoszała. Wieczorem wróciłem pieszo przez park, choć było zimno. "
RUSSIAN = "Утром мы вышли из дома и долго шли вдоль реки. Лодочник сидел у причала и чинил старую сеть. Он рассказал нам, что весной вода поднялась почти до крыльца. Никто тогда не знал, сколько продлится разлив. К вечеру мы вернулись усталые, но довольные прогулкой. "
ITALIAN = "Questa mattina il treno è arrivato con mezz'ora di ritardo alla stazione. Molti viaggiatori aspettavano sotto la pioggia senza ombrello. Una signora anziana raccontava storie della sua giovinezza ai nipoti. Finalmente le porte si aprirono e tutti trovarono posto. Durante il viaggio guardai le colline oltre il finestrino. "


def test_prose_of_other_languages_and_sentences_of_keywords(spark):
    fine = [POLISH, RUSSIAN, ITALIAN, POLISH + RUSSIAN + ITALIAN]
    stuffed = ["Buy the best cheap shoes online. " * 30, "Buy the best cheap shoes online today. " * 100, "Лучшие кроссовки купить дешево онлайн сегодня. " * 40, "tanie buty, buty online, tanie buty sklep, buty sklep, " * 12]
    df = spark.createDataFrame(list(enumerate(fine + stuffed)), "doc_id long, text string")
    got = {r.doc_id: r.kind for r in spam(df).collect()}
    assert [got[i] for i in range(8)] == [None] * 4 + ["keywords"] * 4


def test_thresholds_come_from_all_lengths(spark):
    from weftline.llm.spam import calibrate, spam_measures

    texts = [PROSE * k + f"It is the {i}th note that we have kept since {i} was new to us all. " for i in range(25) for k in (1, 2)] + [f"We have seen that {w} was moved to the shelf because nobody knew where it should be kept. " * 1 for w in WORDS]
    usual = calibrate(spam_measures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    rows = {(r.language, r.size): r for r in usual.collect()}
    assert rows[None, None].n == rows["en", None].n == 55 and len([1 for lang, size in rows if lang == "en" and size is not None]) >= 2
