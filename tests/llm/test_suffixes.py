import random

import numpy as np

from fieldtrace.llm import suffixes as S


def shared_words(docs, words):
    """Per document, which words lie in a window of ``words`` words that another document holds."""
    seen = {}
    split = {d: (t or "").encode().split() for d, t in docs}
    for d, w in split.items():
        for i in range(len(w) - words + 1):
            seen.setdefault(tuple(w[i : i + words]), set()).add(d)
    out = {}
    for d, w in split.items():
        cover = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - words + 1):
            if len(seen[tuple(w[i : i + words])]) > 1:
                cover[i : i + words] = True
        out[d] = cover
    return out


def test_spans(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(90)]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(20, 150))]
        if i % 3 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passage
        if i % 10 == 1:
            w += w[:60]
        docs.append((i, " ".join(w)))
    docs += [(100, docs[4][1]), (101, None), (102, ""), (103, "few words"), (104, docs[5][1] + " end")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = shared_words(docs, S.WORDS)
    got = {d: np.zeros(len(w), dtype=bool) for d, w in want.items()}
    for r in S.repeated_spans(frame).collect():
        got[r["doc_id"]][r["start"] : r["stop"]] = True
    assert all((got[d] == want[d]).all() for d in want)


def test_odd_rows(docs, no_docs):
    spans = S.repeated_spans(docs).collect()
    assert all(0 <= r["start"] < r["stop"] for r in spans)
    assert S.repeated_spans(no_docs).count() == 0


def test_minimisers_depend_on_content_alone():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    full = set(S.minimisers(keys))
    part = {p + 100 for p in S.minimisers(keys[100:300])}
    assert part & full and all(p in full for p in part if 100 + S.WINDOW <= p < 300 - S.WINDOW)
    assert len(S.minimisers(keys[:0])) == 0


def test_a_line_repeated_beyond_every_batch(spark):
    line = [f"w{i}" for i in range(10)]
    docs = [(1, " ".join(line * 25_000)), (2, "before it " + " ".join(line * 8) + " behind it"), (3, "other words")]
    spans = {r["doc_id"]: (r["start"], r["stop"]) for r in S.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert spans == {1: (0, 250_000), 2: (2, 82)}


def test_runs_across_batches_and_partitions(spark):
    rng = np.random.default_rng(4)
    contexts = np.ones((300, S.AFTER + S.BEFORE), dtype=">u4")
    for c in contexts:
        c[rng.integers(20, S.AFTER) :] = rng.integers(1, 1 << 31)
        c[S.AFTER + rng.integers(0, S.BEFORE) :] = 0
        c[S.AFTER :][c[S.AFTER :] > 0] = 1
    rows = sorted({c.tobytes(): (c.tobytes(), i) for i, c in enumerate(contexts)}.values())
    # Long runs of one text, some of which fill partitions, and short ones.
    ids = np.repeat([1, 2, 1, 3, 2, 4, 5], [70, 1, 60, 2, 90, 1, 400])[: len(rows)]
    c = np.frombuffer(b"".join(r[0] for r in rows), dtype=">u4").reshape(len(rows), -1)
    want = set()
    for i in range(len(rows)):
        near = [next((j for j in js if ids[j] != ids[i]), None) for js in (range(i - 1, -1, -1), range(i + 1, len(rows)))]
        for j in near:
            if j is not None:
                right, left = (int(x[0]) for x in S.extents(c[i : i + 1], c[j : j + 1]))
                if right + left >= S.WORDS:
                    want |= {(int(ids[i]), at - left, at + right) for at in (1000 * i, 1000 * i + 500)}
    frame = spark.createDataFrame([(int(d), [1000 * i, 1000 * i + 500], r[0]) for i, (d, r) in enumerate(zip(ids, rows))], "row_id long, places array<int>, context binary")
    assert want
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for partitions in (1, 12):
            ordered = frame.repartitionByRange(partitions, "context").sortWithinPartitions("context")
            compared = S.settled(S.matched(ordered, S.WORDS))
            got = compared.where("place = 0").select("row_id", "start", "stop").union(S.across(compared.where("place > 0"), S.WORDS))
            assert {tuple(r) for r in got.collect()} == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
