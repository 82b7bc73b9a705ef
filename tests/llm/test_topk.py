import math
import random

import pytest
from pyspark.sql import functions as F

from fieldtrace.llm import topk


def brute(rows, k):
    v = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = {}
    for q, a in v:
        if q % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in v if i != q)
            out[q] = [(n + 1, i, -t) for n, (t, i) in enumerate(s[:k])]
    return out


@pytest.mark.parametrize("block", [4, 1024])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SUMMARIES", 3)
    rng = random.Random(7)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.3, 1.0]) for _ in range(6)]) for i in range(130)]
    rows += [(130, None), (131, [1.0, None, 0.0]), (132, [float("nan")] * 6), (133, [float("inf")] * 6), (None, [1.0] * 6), (140, [1.0, 2.0]), (7, [1.0] * 6), (141, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    vectors = frame.select("vec_id", topk.quantized(F.col("embedding")).alias("v"))
    got = {}
    for r in topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=9).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got == brute([(i, None if e is None else [None if x is None else float(__import__("numpy").float32(x)) for x in e]) for i, e in rows], 9)


def test_few_and_no_candidates(spark):
    few = spark.createDataFrame([(0, [1]), (1, [2])], "vec_id long, v array<long>")
    assert [tuple(r) for r in topk.top_k(few, few.where("vec_id = 0")).collect()] == [(0, 1, 1, 2)]
    assert topk.top_k(few.limit(0), few.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1 << 40]), (1, [1 << 20]), (2, [-(1 << 21)])], "vec_id long, v array<long>")
    assert [r["score"] for r in topk.top_k(huge, huge.where("vec_id = 0")).orderBy("rank").collect()] == [1 << 60, -(1 << 61)]
