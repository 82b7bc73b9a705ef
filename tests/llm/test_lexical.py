import math
import random
import re

from fieldtrace.llm import lexical as L


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(L.TERMS, lower)


def brute(docs, items, k):
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    asked = {}
    for i, t in set(items):
        asked[i] = asked.get(i, []) + terms(t)
    out = set()
    for i, own in asked.items():
        scores = []
        for d, t in held:
            m = 25 + (75 * len(t) * n_docs) // n_terms
            s = 0
            for x in own:
                if tf := t.count(x):
                    df = sum(x in y for _, y in held)
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if s > 0:
                scores.append((-s, d is None, d))
        out |= {(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])}
    return out


def test_ranked_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: rng.choice(["Ähre", "the", "The", "a1", "fluß", "x", "stone", "zz9", "日本"])
    docs = [(i, rng.choice([" ", "-", "!\n"]).join(word() + str(rng.randrange(4)) for _ in range(rng.randint(1, 40)))) for i in range(90)]
    docs += [(7, "the stone0 again"), (3, docs[3][1]), (3, docs[3][1]), (None, docs[5][1]), (200, None), (201, ""), (202, "?! --"), (1 << 60, docs[6][1])]
    docs += [(203, "the0 " * 30_000)]
    items = [(i, " ".join(word() + str(rng.randrange(4)) for _ in range(12))) for i in range(6)]
    items += [(1, "stone1 Stone1"), (1, "stone1 Stone1"), (None, "fluß2"), (50, None), (51, ""), (52, "absent")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, scores string, slice int").repartition(3)
    asked = spark.createDataFrame([(*i, 0.5) for i in items], "item_id long, text string, score double")
    want = brute(docs, [i for i in items if i[1] is not None], 5)
    assert {tuple(r) for r in L.ranked(frame, asked, k=5).collect()} == want
    # Slices of few documents, blocks of few items and more owners than terms change nothing.
    monkeypatch.setattr(L, "ITEMS", 3)
    monkeypatch.setattr(L, "SLICE_TERMS", 500)
    assert {tuple(r) for r in L.ranked(frame, asked, k=5, owners=2).collect()} == want


def test_empty_tables(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "the river")], "item_id long, text string")
    assert L.ranked(no_docs, items).count() == 0
    assert L.ranked(docs, items.where("false")).count() == 0
    got = L.ranked(docs, items).collect()
    assert 0 < len(got) <= 10 and all(r["score"] > 0 for r in got)


def test_scores_survive_packing():
    import numpy as np

    scores = np.zeros((3, 5), dtype=np.int64)
    scores[1, 2], scores[2, 4] = 1 << 50, 7
    assert (L.unpacked(L.packed(scores), 3, 5) == scores).all()
    assert not L.unpacked(None, 3, 5).any()
