import random

import pytest

from fieldtrace.llm import phrases as P


def brute(docs, words=20):
    """By every window of every row: (doc_id, number of words, merged spans, kept words)."""
    order = lambda d: 2**63 - 1 if d is None else d
    split = [(d, (t or "").encode().split()) for d, t in docs]
    first = {}
    for d, own in split:
        for i in range(len(own) - words + 1):
            k, at = tuple(own[i : i + words]), (order(d), i)
            first[k] = min(first.get(k, at), at)
    out = []
    for d, own in split:
        gone = set()
        for i in range(len(own) - words + 1):
            if first[tuple(own[i : i + words])] < (order(d), i):
                gone.update(range(i, i + words))
        out.append((d, len(own), len(gone), b" ".join(w for i, w in enumerate(own) if i not in gone).decode()))
    return sorted(out, key=str)


def run(spark, docs, partitions=4):
    frame = spark.createDataFrame([(*d, "x", 3, b"y") for d in docs], "doc_id long, text string, spans string, did int, tid binary").repartition(partitions)
    got = P.without_repeats(frame).collect()
    return sorted(((r["doc"]["doc_id"], r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), r["kept"]) for r in got), key=str)


def planted(seed):
    rng = random.Random(seed)
    word = lambda: f"wö{rng.randrange(4000)}"
    passages = [[word() for _ in range(n)] for n in (20, 21, 45, 300)]
    docs = []
    for i in range(80):
        own = [word() for _ in range(rng.randint(0, 120))]
        if i % 2:
            p = rng.choice(passages)
            a = rng.randrange(len(p) - 19)
            at = rng.randrange(len(own) + 1)
            own[at:at] = p[a : rng.randint(a + 20, len(p))]
        if i % 9 == 0:
            own += own[:50]
        docs.append((i * 3, rng.choice([" ", "\n", "\t ", "\x0b"]).join(own)))
    line = " ".join(f"l{i}" for i in range(7))
    docs += [(500, docs[41][1]), (1, docs[41][1]), (501, docs[41][1] + " tail"), (502, None), (503, ""), (504, " \n"), (505, "few words")]
    docs += [(506, " ".join([line] * 300)), (507, "before " + " ".join([line] * 9) + " behind"), (508, "   x " * 30)]
    docs += [(9, "a b " + passages[3][0] + " " + docs[41][1]), (9, "c " + docs[41][1] + " " + docs[41][1]), (9, docs[45][1] + " " + docs[41][1])]
    docs += [(7, docs[3][1]), (7, docs[3][1]), (7, docs[5][1]), (None, docs[41][1]), (None, passages[3][0] + " " + " ".join(passages[2]))]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = planted(seed)
    assert run(spark, docs) == brute(docs)


def test_many_shards_parts_and_salts(spark, monkeypatch):
    # The tasks' own limits travel with the functions' arguments or the plan, so small ones can be set here.
    docs = planted(3)
    monkeypatch.setattr(P, "PHRASES", 40)
    monkeypatch.setattr(P, "LOAD", 60)
    assert run(spark, docs, 7) == brute(docs)
    monkeypatch.setattr(P, "PHRASES", 1)
    assert run(spark, docs, 2) == brute(docs)


def test_a_very_long_text(spark):
    rng = random.Random(4)
    own = [f"v{rng.randrange(20_000)}" for _ in range(60_000)]
    docs = [(1, " ".join(own)), (2, " ".join(own[5:59_000])), (3, " ".join(own[30_000:30_025] + ["x"] * 40 + own[:19]))]
    assert run(spark, docs) == brute(docs)


def test_empty_table_and_odd_rows(spark, docs, no_docs):
    assert P.without_repeats(no_docs).count() == 0
    got = sorted(((r["doc"]["doc_id"], r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), r["kept"]) for r in P.without_repeats(docs).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    with pytest.raises(ValueError):
        P.without_repeats(docs, words=8)


def test_automaton_tells_words_apart():
    phrase = [f"p{i}".encode() for i in range(30)]
    found = P.Automaton([(phrase[:25], 6, 4, 100)], 20)
    text = [b"x", *phrase[2:24], b"y", *phrase[:19]]
    assert list(found.occurrences(text)) == [(1, (4, 102)), (2, (4, 103)), (3, (4, 104))]


def test_least_places():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, top in ((0, 9), (12, 9), (13, 9), (200, 5), (300, 1 << 60)):
        keys = rng.integers(1, top, n).astype(np.uint64)
        want = {i for a in range(n - 12) for i in range(a, a + 13) if keys[i] == keys[a : a + 13].min()}
        assert P.least_places(keys, 13).tolist() == sorted(want)
