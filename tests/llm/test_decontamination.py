import random

import pytest

from fieldtrace.llm import decontamination as D

from .conftest import prose


def length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = (rng.choices("abcdef", k=rng.randint(1, 80)) for _ in range(2))
        assert D.common_subsequence(D.masks_of(a), len(a), b) == length(a, b)


@pytest.mark.parametrize("at_a_time", [5_000, 9])
def test_leaks_are_found_and_clean_documents_kept(spark, docs, no_docs, monkeypatch, at_a_time):
    monkeypatch.setattr(D, "UNITS_AT_A_TIME", at_a_time)
    rng = random.Random(12)
    names = [f"{a}{b}" for a in "ba ke lo mi nu po ra si to vu".split() for b in "den gal hur jin lok mas ner pik".split()]
    items = [(i, " ".join(rng.choices(names, k=rng.randint(15, 40))) + ". The answer is " + " ".join(rng.choices(names, k=4)) + ".") for i in range(20)]
    items += [(50, " ".join(rng.choices(names, k=150)) + "."), (51, None), (52, ""), (None, "lost item"), (0, items[0][1])]
    exact = " ".join([prose(rng, "en", 80), items[3][1], prose(rng, "en", 30)])
    words = items[4][1].split()
    for i in range(2, len(words) - 8, 6):
        words[i] = "changed"
    reworded = " ".join([prose(rng, "en", 50), " ".join(words).upper(), prose(rng, "en", 50)])
    long = " ".join([prose(rng, "en", 200), items[20][1], prose(rng, "en", 10)])
    planted = [(1001, exact), (1002, reworded), (1003, long), (1004, prose(rng, "en", 300)), (1005, None)]
    extra = spark.createDataFrame([(i, t, "en", "s", 0, 0, "", 0.0, 0, "", "") for i, t in planted], docs.schema)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in D.with_leaks(docs.unionByName(extra), benchmark).collect() if r["leaks"]}
    assert found == {1001: [3], 1002: [4], 1003: [50]}
    assert D.without_leaks(docs, benchmark).count() == docs.count() and D.without_leaks(docs, benchmark).columns == docs.columns
    assert D.with_leaks(no_docs, benchmark).count() == 0
    assert D.without_leaks(docs, benchmark.limit(0)).count() == docs.count()


def test_units_cover_an_item():
    words = [f"w{i}" for i in range(200)]
    units = D.units_of(" ".join(words))
    assert {w for u, _ in units for w in u} == set(words) and all(len(u) == D.PASSAGE for u, _ in units)
    assert D.units_of("") == [] and D.units_of("... !") == []


def hard_leaks(seed=31):
    """Items as documents may hold them: of the greatest length off the grid, reworded, and short ones amid prose."""
    rng = random.Random(seed)
    names = [f"{a}{b}" for a in "ba ke lo mi nu po ra si to vu".split() for b in "den gal hur jin lok mas ner pik".split()]
    items, docs = [], []
    for i in range(36):
        words = rng.choices(names, k=(64, 40, 10)[i % 3])
        items.append((i, " ".join(words) + "."))
        if i % 3 == 1:
            for k in range(1, 40, 4):
                words[k] = "changed"
        docs.append((2000 + i, " ".join([prose(rng, "en", 100 + i), *words, prose(rng, "en", 150)])))
    return items, docs


def test_every_leak_of_a_brute_force_search_is_found(spark, docs):
    items, planted = hard_leaks()
    want = set()
    for i, text in items:
        unit = text.rstrip(".").split()
        for d, doc in planted:
            share = length(unit, [w.decode() for w in D.words_of(doc)]) / len(unit)
            if share >= D.SHARED:
                want.add((d, i))
    assert {(2000 + i, i) for i, _ in items} <= want
    extra = spark.createDataFrame([(i, t, "en", "s", 0, 0, "", 0.0, 0, "", "") for i, t in planted], docs.schema)
    found = D.with_leaks(docs.unionByName(extra), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], x["item_id"]) for r in found.collect() for x in r["leaks"]} == want


def test_latent_rows_span_the_leading_singular_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    names = [f"w{i:02d}" for i in range(60)]
    # Passages about five topics, so that few directions hold most of the matrix.
    topics = rng.dirichlet(np.full(60, 0.1), 5)
    passages = [[names[j] for j in rng.choice(60, 40, p=topics[i % 5])] for i in range(120)]
    frame = D.settled(spark.createDataFrame([(p,) for p in passages], "words array<string>").repartition(3))
    vocabulary = D.Places((w.encode(), i) for i, w in enumerate(names))
    idf = rng.uniform(0.5, 2.0, 60)
    a = np.zeros((120, 60))
    for row, p in zip(a, passages):
        at, value = D.weighted([w.encode() for w in p], vocabulary, idf)
        row[at] = value
    q = D.latent_rows(frame, vocabulary, idf, rank=5) / idf[:, None]
    assert np.allclose(q.T @ q, np.eye(5), atol=1e-5)
    best = np.sqrt((np.linalg.svd(a, compute_uv=False)[:5] ** 2).sum())
    assert np.linalg.norm(a @ q) > 0.999 * best


def test_all_passages_of_all_documents_join_the_fit(spark, monkeypatch):
    """Of 300 documents the last ones count as the first do: words, document frequencies and the matrix."""
    import numpy as np

    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k} common" for k in range(40 + i % 50))) for i in range(300)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "common w299x1 w0x1 neither")], "item_id long, text string")
    seen = []
    multiply = D.multiply

    def spy(passages, shared, basis, size, width):
        seen.append((passages, shared.value, size))
        return multiply(passages, shared, basis, size, width)

    monkeypatch.setattr(D, "multiply", spy)
    (index,) = D.build_index(docs, benchmark)
    passages, idf, size = seen[0]
    counts = np.zeros(size)
    for r in passages.collect():
        for i in np.frombuffer(r["ids"], dtype=np.int32):
            counts[i] += 1
    words = [f"w{i}x{k}".encode() for i in range(300) for k in range(40 + i % 50)] + [b"common"] * sum(40 + i % 50 for i in range(300))
    want = np.zeros(size)
    for w in words + [b"common", b"w299x1", b"w0x1", b"neither"]:
        want[index.vocabulary[w]] += 1
    assert (counts == want).all()
    # common is in all documents, the two others in one each, the last in none.
    df = {b"common": 300, b"w299x1": 1, b"w0x1": 1, b"neither": 0}
    assert all(np.isclose(idf[index.vocabulary[w]], np.log(301 / (1 + k)) + 0.1) for w, k in df.items())
    parts = list(D.groups(iter([passages.toPandas()])))
    # A passage of 48 words each, and the unit.
    assert sum(n for _, _, n in parts) == 1 + sum(-(-2 * (40 + i % 50) // 48) for i in range(300))
    assert all(len(ids) == len(passage) and passage.max() == n - 1 for ids, passage, n in parts)


@pytest.mark.parametrize("lengths", [[1, 2, 3, 5, 48, 300], [7] * 40, []])
def test_runs_of_entries_are_summed_like_a_dense_product(monkeypatch, lengths):
    import numpy as np

    monkeypatch.setattr(D, "ENTRIES", 16)
    rng = np.random.default_rng(3)
    matrix, n = rng.standard_normal((50, 9)), sum(lengths)
    at, value, run = rng.integers(0, 50, n), rng.standard_normal(n), np.repeat(np.arange(len(lengths)), lengths)
    dense = np.zeros((len(lengths), 50))
    np.add.at(dense, (run, at), value)
    assert np.allclose(D.summed(D.starts_of(run), at, value, matrix), dense @ matrix)


def test_the_last_pass_of_the_fit_meets_no_vocabulary(spark, monkeypatch):
    """Two rounds sum over the vocabulary; what then remains is the square of the passages' products."""
    calls = []
    multiply = D.multiply
    monkeypatch.setattr(D, "multiply", lambda *a: calls.append(a) or multiply(*a))
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 7}x{k}" for k in range(60 + i))) for i in range(20)], "doc_id long, text string")
    (index,) = D.build_index(docs, spark.createDataFrame([(1, "w1x1 w2x2 w3x3 none")], "item_id long, text string"))
    assert len(calls) == D.ROUNDS and index.rows.shape == (index.vocabulary.own + D.OTHERS, D.RANK)


def test_holders_count_each_document_once_beyond_a_byte():
    import numpy as np

    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 40, rng.integers(0, 60)).astype(np.int32) for _ in range(3 * D.COUNTED + 7)]
    texts += [np.full(500, 41, dtype=np.int32)] * (2 * D.COUNTED)
    want = [sum(i in set(x.tolist()) for x in texts) for i in range(43)]
    assert D.holders((x.tobytes() for x in texts), 43).tolist() == want
    assert D.holders(iter([]), 3).tolist() == [0, 0, 0]


def test_the_driver_passes_the_basis_on_in_single_precision_and_in_order(spark):
    """The tasks compute with single precision: the driver holds no more than they take."""
    import numpy as np

    slices = [(i * D.SLICE, np.random.default_rng(i).standard_normal((9 - i, 7))) for i in range(5)]
    frame = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in slices[::-1]], D.SLICES).repartition(4)
    found = D.in_order(frame)
    assert [len(x) for x in found] == [4 * (9 - i) * 7 for i in range(5)]
    assert (D.stacked(found, 7) == np.concatenate([x for _, x in slices]).astype(np.float32)).all()
