import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, doc string, score double, shard int, leaks string, key string"
WORDS = {
    "en": "the of and to in is that for it with as was on be by are this river stone window garden morning letter engine harbour".split(),
    "de": "der die und das ist nicht mit ein zu von auf für dem fluss stein fenster garten morgen brief maschine hafen straße".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "ing", "en", "ly"]) for _ in range(n))


def corpus(n=60, seed=5):
    """Texts in two languages with copies, near copies, nulls, blanks, a long text and columns of clashing names."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        rows.append([i, prose(rng, lang, rng.randint(3, 90)) + ".", lang, f"s{i % 4}" if i % 7 else None])
    rows[10][1] = rows[11][1] = rows[12][1] = rows[1][1]
    rows[13][1] = rows[1][1] + " tail"
    rows[14][1] = None
    rows[15][1] = ""
    rows[16][1] = " \t\n"
    rows[17][1] = "!!! 123 ???"
    rows[18][1] = prose(rng, "en", 30_000)
    rows[19][2] = None
    rows.append(list(rows[20]))
    rows.append([None, prose(rng, "en", 40), "en", "s1"])
    rows.append([n + 5, None, None, None])
    return [(*r, None if r[1] is None else len(r[1]), 7, "other", 0.25, 3, "x", None) for r in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
