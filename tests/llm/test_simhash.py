import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldtrace.llm import simhash as S


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return S.signed(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB ç\t\n ", max_size=60))
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == plain_print(text)


def test_long_texts_in_blocks(monkeypatch):
    text = " ".join(random.Random(1).choices("alpha beta gamma delta".split(), k=500))
    monkeypatch.setattr(S, "BLOCK", 7)
    assert S.fingerprint(text.encode()) == plain_print(text)


def brute(prints, radius):
    u = np.array(sorted(set(prints)), dtype=np.int64).view(np.uint64)
    return {(int(a), int(b)) for i, a in enumerate(u.view(np.int64)) for b in u.view(np.int64)[i + 1 :] if int(np.bitwise_count(np.uint64(np.int64(a) ^ np.int64(b)))) <= radius}


def heap(seed, n=60):
    rng = random.Random(seed)
    out = []
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(n // 6):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            out.append(S.signed(x))
    return [*out, 0, S.signed(3)]


def test_pairs_of_every_plan(spark):
    prints = heap(3)
    frame = spark.createDataFrame([(x,) for x in sorted(set(prints))], "fp long")
    want = brute(prints, 4)
    bits = list(range(64))
    random.Random(2).shuffle(bits)
    plans = [
        S.make_plan(frame, 4),
        [(bits[i * 13 : i * 13 + 13] if i < 4 else bits[52:], 0) for i in range(5)],
        [(bits[:21], 1), (bits[21:42], 1), (bits[42:], 0)],
        [(bits[:10], -1), (bits[10:40], 1), (bits[40:], 2)],
    ]
    for plan in plans:
        found = [(min(r), max(r)) for r in S.near_pairs(frame, plan, 4).collect()]
        assert len(found) == len(set(found)) and set(found) == {(min(p), max(p)) for p in want}


def test_allocation_is_least():
    costs = [[0, 5, 9, 30], [0, 1, 2, 3], [0, 4, 4, 4]]
    best = min(
        (costs[0][a + 1] + costs[1][b + 1] + costs[2][c + 1], [a, b, c])
        for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == 2
    )
    assert S.allocate([list(map(float, c)) for c in costs], 2)[0] == best[0]


def test_groups_of_odd_rows(docs, no_docs):
    rows = S.near_duplicates(docs).collect()
    plain = {r["doc_id"]: plain_print(r["text"]) for r in docs.collect()}
    assert len(rows) == docs.count()
    assert all(r["fp"] == plain[r["doc_id"]] for r in rows)
    links = brute(list(plain.values()), 4)
    label = {p: p for p in plain.values()}
    for _ in range(len(links) + 1):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    smallest = {}
    for d, p in plain.items():
        if d is not None:
            smallest[label[p]] = min(smallest.get(label[p], d), d)
    assert all(r["component_id"] == smallest.get(label[r["fp"]]) for r in rows)
    kept = S.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(label.values()))
    assert S.near_duplicates(no_docs).count() == 0 and S.without_near_duplicates(no_docs).count() == 0
