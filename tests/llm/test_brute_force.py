"""Operators that SQL cannot say, each against a plain version of its own."""

import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from fieldtrace.llm import language, quality, sharding, toxicity

from .conftest import prose


def quality_score(weights, text):
    """The dot product of square roots of hashed n-gram shares, then the logistic function."""
    hashes = [zlib.crc32(t.encode()) for t in re.findall(r"\w+|[^\w\s]+", text or "")]
    mask, seen = (1 << quality.BITS) - 1, Counter()
    for h in hashes:
        seen[(h ^ (h >> 15)) & mask] += 1
    for a, b in zip(hashes, hashes[1:]):
        seen[((a * 0x9E3779B1 + b * 0x85EBCA77) % 2**64 >> 7) & mask] += 1
        if a == b:
            seen[quality.AGAIN & mask] += 1
    total = sum(seen.values())
    z = weights[-1] + sum(weights[i] * math.sqrt(n / total) for i, n in seen.items())
    return 1 / (1 + math.exp(-z))


def test_quality_scores_are_the_formula(spark, docs):
    rng = random.Random(2)
    rows = [(i, prose(rng, "en", 30) + (" ###" if i % 2 else ""), i % 2) for i in range(200)]
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    for r in quality.scored(docs, model).collect():
        assert r["score"] == pytest.approx(quality_score(model.weights, r["doc"]["text"]), abs=1e-9)


def test_ftrl_steps_are_those_of_the_definition():
    """Weight by weight in dictionaries, as follow-the-regularised-leader defines them."""
    rng = random.Random(5)
    leader, z, n = quality.Leader(), {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        shrunk = z[i] - math.copysign(quality.L1, z[i])
        return -shrunk / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(60):
        index = np.array(sorted(rng.sample(range(12), 4)))
        value, label = np.array([rng.random() for _ in index]), rng.randint(0, 1)
        leader.learn(index, value, label)
        pairs = [*zip(index.tolist(), value.tolist()), (1 << quality.BITS, 1.0)]
        before = {i: weight(i) for i, _ in pairs}
        p = 1 / (1 + math.exp(-sum(before[i] * x for i, x in pairs)))
        for i, x in pairs:
            g, old = (p - label) * x, n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / quality.ALPHA * before[i]
            n[i] = old + g * g
    assert [float(leader.weights(i)) for i in range(12)] == pytest.approx([weight(i) for i in range(12)], abs=1e-12)


def smallest_encoding(learned, text):
    """The language whose dictionary encodes a text in the fewest bytes, and the share of bytes it saves over the next."""
    data, sizes = text.lower().encode(), []
    for lang, content in learned.content:
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own = zstandard.ZstdCompressor(dict_data=raw, level=language.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append((sum(len(own.compress(data[i : i + language.PIECE])) for i in range(0, len(data), language.PIECE)), lang))
    (best, lang), (second, _) = sorted(sizes)[:2]
    return lang, (second - best) / second


def test_language_is_the_smallest_encoding(docs):
    learned = language.train(docs)
    for r in language.identified(docs, learned).collect():
        if r["lang_pred"] == language.UNKNOWN:
            continue
        lang, margin = smallest_encoding(learned, r["doc"]["text"])
        assert r["lang_pred"] == lang
        assert r["score"] == pytest.approx(margin / (margin + language.MARGIN)) and r["rejected"] == (margin < language.MARGIN)


def dense(text, lexicon):
    words = [w for w in re.findall(r"[^\W\d_]+", text.lower())]
    bad = [i for i, w in enumerate(words) if w in lexicon or any(w[:n] + "*" in lexicon for n in (4, 5))]
    you = [i for i, w in enumerate(words) if w in toxicity.YOU]
    kinds = [unicodedata.category(c) for c in text]
    capitals, letters = sum(k in ("Lu", "Lt") for k in kinds), sum(k[0] == "L" for k in kinds)
    return {
        "lexicon_hits": len(bad),
        "hits_near_you": sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i in bad),
        "you_density": 100 * len(you) / max(1, len(words)),
        "capitals": capitals / max(1, letters),
        "punctuation": sum(k[0] in "PS" for k in kinds) / max(1, len(text)),
        "exclamations": text.count("!") / max(1, len(text)),
        "length": math.log1p(len(words)),
    }


def test_toxicity_features_are_plain_counts():
    rng = random.Random(9)
    lexicon = frozenset({"river", "ston*", "lette*"})
    words = "river stones You lettering your HARBOUR ihr fluß Ölung! a1b x,y § Ça !! -- 日本".split()
    for _ in range(60):
        text = " ".join(rng.choices(words, k=rng.randint(0, 40)))
        got = dict(zip(toxicity.FEATURES, toxicity.features(text, lexicon)))
        for name, value in dense(text, lexicon).items():
            assert got[name] == pytest.approx(value), (name, text)


def pooled(points):
    """Pool adjacent violators over (x, y, weight): x -> the fitted value; equal x count as one point."""
    merged = {}
    for x, y, w in points:
        a = merged.setdefault(x, [0.0, 0.0])
        a[0] += y * w
        a[1] += w
    blocks = []
    for x in sorted(merged):
        blocks.append([[x], *merged[x]])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            xs, y, w = blocks.pop()
            blocks[-1] = [blocks[-1][0] + xs, blocks[-1][1] + y, blocks[-1][2] + w]
    return {x: y / w for xs, y, w in blocks for x in xs}


def test_toxicity_is_calibrated_by_pooled_neighbours(spark):
    rng = random.Random(3)
    rows = []
    for i in range(500):
        words = prose(rng, "en", rng.randint(8, 60)).split()
        toxic = i % 4 == 0
        # Some toxic texts without a mark and clean ones with one, so that the raw scores are not already sorted.
        for _ in range(rng.randint(1, 4) if toxic and i % 5 or i % 13 == 1 else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["blorgh", "snarfle"]))
        rows.append((i, " ".join(words), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.train(frame, {0: 3000, 1: 125})
    raw = {r["doc_id"]: r["score"] for r in toxicity.scored(frame, toxicity.Model(model.lexicon, model.trees, None, 0.0)).collect()}
    part = {i: int(hashlib.md5(f"{i}|part".encode()).hexdigest()[:4], 16) / 65536 for i, _, _ in rows}
    held = [(i, y) for i, _, y in rows if part[i] >= toxicity.FIT_SHARE]
    share = {y: n / sum(x == y for _, x in held) for y, n in ((0, 3000), (1, 125))}
    want = pooled([(raw[i], y, share[y]) for i, y in held])
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(frame, model).collect()}
    assert len(set(want.values())) > 1
    assert all(got[i] == pytest.approx(want[raw[i]], abs=1e-9) for i, _ in held)


def tree(rows, node, parts, dims):
    """(row, shard) by cutting at the weighted median of the widest dimension, again and again; rows: (coordinates, size, id)."""
    if parts == 1 or not rows:
        return [(r, node) for r in rows]
    shift = sharding.TEXT_BITS + sharding.ID_BITS
    widths = [(max(r[0][d] for r in rows) >> shift) - (min(r[0][d] for r in rows) >> shift) for d in range(dims)]
    real = widths[:-1] if dims > 1 and max(widths[:-1]) > 0 else widths
    d = widths.index(max(real))
    goal = sum(r[1] for r in rows) * (parts // 2) / parts
    at, cut = 0, None
    for value, same in itertools.groupby(sorted(rows, key=lambda r: r[0][d]), key=lambda r: r[0][d]):
        size = sum(r[1] for r in same)
        if cut is None and at + size > goal:
            cut = value if goal - at <= at + size - goal else value + 1
        at += size
    left = [r for r in rows if r[0][d] < cut]
    right = [r for r in rows if r[0][d] >= cut]
    return tree(left, node, parts // 2, dims) + tree(right, node + parts // 2, parts - parts // 2, dims)


def coordinates(ids, texts, values):
    """Of each row: the dimensions scaled to 20 bits over their spans, then bits of the text's hash and of the id's."""
    top, out = (1 << sharding.DIM_BITS) - 1, []
    for k, (i, text) in enumerate(zip(ids, texts)):
        key = hashlib.md5(f"{i}|shard".encode()).hexdigest()
        low = (zlib.crc32(text.encode()) % (1 << sharding.TEXT_BITS) << sharding.ID_BITS) + int(key[24:32], 16) % (1 << sharding.ID_BITS)
        own = [(math.floor((v[k] - min(v)) * (top / ((max(v) - min(v)) or 1.0))) << (sharding.TEXT_BITS + sharding.ID_BITS)) + low for v in values]
        out.append((own, len(text.encode()) + 16, (key, i)))
    return out


def numbered(found):
    """(row, shard) -> sorted (id, shard, slot): slots follow the ids' hashes."""
    shards = {}
    for (_, _, (key, i)), shard in found:
        shards.setdefault(shard, []).append((key, i))
    return sorted((i, shard, slot) for shard, own in shards.items() for slot, (_, i) in enumerate(sorted(own)))


@pytest.mark.parametrize("shards", [2, 5, 8])
def test_shards_are_those_of_the_plain_tree(spark, shards):
    rng = random.Random(shards)
    rows = [(i, "x" * rng.randint(0, 90) + str(i), float(rng.randint(0, 500)), rng.random()) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, x double, y double").repartition(4)
    out = sharding.kd_shards(frame, shards=shards, dims=[F.col("x"), F.col("y"), F.crc32(F.col("text").cast("binary")).cast("double")])
    got = sorted((r["doc_id"], r["shard"], r["slot"]) for r in out.collect())
    values = [[r[2] for r in rows], [r[3] for r in rows], [float(zlib.crc32(r[1].encode())) for r in rows]]
    placed = coordinates([r[0] for r in rows], [r[1] for r in rows], values)
    assert got == numbered(tree(placed, 0, shards, 3))
