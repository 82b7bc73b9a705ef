"""Exact top-k search by inner product with block-at-a-time pruning.

A vector's components are its terms. Candidates are sorted so that like vectors stand together and packed into blocks;
a block's forward index is the matrix of its vectors, its summary the largest and smallest value of every term. For a
query, the sum over terms of the larger of q * max and q * min bounds every score in the block. Each query first scores
the block with its highest bound, which gives a score that its k-th best cannot fall below; then only blocks whose bound
reaches that score are met, in the order of bounds, and scored through their forward indexes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.sources.writers import settled

#: Vectors of a candidate block and of a query block; a joined row holds one of each.
BLOCK, QUERIES = 1024, 256
#: Summaries met by a query block at a time.
SUMMARIES = 1024

BLOCK_SCHEMA = "block string, size int, ids binary, values binary, top binary, low binary"
PAIR_SCHEMA = "query_id long, vec_id long, score long"


def quantized(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as a double; null where the vector or a component is null or not finite."""
    values = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.when(fine, values)


def score_matrix(queries: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Exact integer products: as doubles while every partial sum is below 2^53, else as 64-bit integers."""
    most = max(1, queries.shape[1]) * float(np.abs(queries).max(initial=0)) * float(np.abs(values).max(initial=0))
    if most < 2**53:
        return (queries.astype(np.float64) @ values.astype(np.float64).T).astype(np.int64)
    return queries @ values.T


def bounds(queries: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of every query in every block; a relative margin covers rounding."""
    positive, negative = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    exact = positive @ top.astype(np.float64).T + negative @ low.astype(np.float64).T
    return exact + 1 + np.abs(exact) * 1e-9


def pack(vectors: DataFrame, width: int, size: int) -> DataFrame:
    """(vec_id, v) rows of each partition, in their order, as blocks of at most ``size`` vectors of ``width`` terms."""

    def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        rows: list[np.ndarray] = []

        def block() -> pd.DataFrame:
            rows_ = np.stack(rows)
            return pd.DataFrame([{
                "block": f"{task}-{made}", "size": len(ids), "ids": np.array(ids, dtype=np.int64).tobytes(), "values": packed(rows_), "top": rows_.max(axis=0).tobytes(), "low": rows_.min(axis=0).tobytes(),
            }])

        for part in parts:
            for vec_id, v in zip(part["vec_id"], part["v"]):
                padded = np.zeros(width, dtype=np.int64)
                padded[: len(v)] = v
                ids.append(vec_id)
                rows.append(padded)
                if len(ids) == size:
                    yield block()
                    made, ids, rows = made + 1, [], []
        if ids:
            yield block()

    return vectors.mapInPandas(blocks, BLOCK_SCHEMA)


def packed(rows: np.ndarray) -> bytes:
    """A byte that names the item size, then the rows in the smallest of 2, 4 and 8 bytes that holds them all."""
    for size in (2, 4):
        if rows.size == 0 or np.abs(rows).max() < 1 << (8 * size - 1):
            return bytes([size]) + rows.astype(f"<i{size}").tobytes()
    return bytes([8]) + rows.astype("<i8").tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{data[0]}", offset=1).reshape(-1, width).astype(np.int64)


def summary(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query: highest score, then smallest id."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.nonzero(scores >= kth)[0]
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k best candidates of each query: query_id, rank (from 1), vec_id, score.

    Both tables hold (vec_id long, v array<long>); rows with a null in either take no part. A candidate with the
    query's own vec_id is not its partner; ties go to the smaller vec_id; repeated candidates are ranked one by one,
    repeated queries (by vec_id) are answered once, by their smallest vector. Vectors of unequal length are compared
    over the terms they share. Fewer than k candidates give fewer rows; an empty table gives none.
    """
    vectors = vectors.where("vec_id is not null and v is not null")
    queries = queries.where("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v"))
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 1
    width = max(width, queries.agg(F.max(F.size("v"))).first()[0] or 1)
    # Like vectors together: by the term of the largest magnitude and its sign, then by the value.
    sizes = F.transform("v", lambda x: F.abs(x))
    lead = F.array_position(sizes, F.array_max(sizes))
    value = F.element_at(F.col("v"), F.greatest(lead, F.lit(1)).cast("int"))
    placed = vectors.withColumn("_lead", F.when(F.size("v") > 0, F.signum(value.cast("double")) * lead)).withColumn("_value", F.when(F.size("v") > 0, value))
    ordered = placed.repartitionByRange("_lead", "_value", "vec_id").sortWithinPartitions("_lead", "_value", "vec_id")
    blocks = settled(pack(ordered.select("vec_id", "v"), width, BLOCK))
    asked = settled(pack(queries.repartitionByRange("vec_id").sortWithinPartitions("vec_id"), width, QUERIES))

    # Every query block meets every block's summary (two vectors), many summaries to a row.
    chunks = max(1, -(-blocks.count() // SUMMARIES))
    chunk = F.pmod(F.xxhash64("block"), F.lit(chunks).cast("long"))
    summaries = blocks.groupBy(chunk.alias("chunk")).agg(F.collect_list(F.struct("block", "top", "low")).alias("s"))
    summaries = settled(summaries.select("chunk", F.transform("s", lambda x: x["block"]).alias("names"), F.transform("s", lambda x: x["top"]).alias("tops"), F.transform("s", lambda x: x["low"]).alias("lows")))
    met = asked.select(F.col("block").alias("asked"), "values", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
    faced = met.join(summaries, "chunk")

    def bound(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for asked_block, values, names, tops, lows in zip(part["asked"], part["values"], part["names"], part["tops"], part["lows"]):
                limits = bounds(unpacked(values, width), np.stack([summary(x) for x in tops]), np.stack([summary(x) for x in lows]))
                yield pd.DataFrame({"asked": asked_block, "block": list(names), "bounds": [row.tobytes() for row in limits.T]})

    limits = settled(faced.select("asked", "values", "names", "tops", "lows").mapInPandas(bound, "asked string, block string, bounds binary"))

    def first_best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for asked_block, block, data in zip(part["asked"], part["block"], part["bounds"]):
                row = np.frombuffer(data, dtype=np.float64)
                yield pd.DataFrame({"asked": asked_block, "place": np.arange(len(row)), "bound": row, "block": block})

    # Each query's block of the highest bound, scored to seed its threshold.
    peaks = limits.mapInPandas(first_best, "asked string, place int, bound double, block string")
    peaks = peaks.groupBy("asked", "place").agg(F.max(F.struct("bound", "block")).alias("m"))
    seeds = peaks.groupBy("asked", F.col("m.block").alias("block")).agg(F.collect_list("place").alias("places"))

    query_side = asked.select(F.col("block").alias("asked"), F.col("ids").alias("asked_ids"), F.col("values").alias("asked_values"))
    block_side = blocks.select("block", "ids", "values")

    def seed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for asked_block, places, asked_ids, asked_values, ids, values in zip(part["asked"], part["places"], part["asked_ids"], part["asked_values"], part["ids"], part["values"]):
                places = np.array(places)
                own, there = np.frombuffer(asked_ids, dtype=np.int64)[places], np.frombuffer(ids, dtype=np.int64)
                scores = score_matrix(unpacked(asked_values, width)[places], unpacked(values, width))
                floors = []
                for q, row in zip(own, scores):
                    other = row[there != q]
                    floors.append(float(np.partition(other, len(other) - k)[len(other) - k]) if len(other) >= k else -np.inf)
                yield pd.DataFrame({"asked": asked_block, "place": places, "floor": floors})

    paired = seeds.join(query_side, "asked").join(block_side, "block").select("asked", "places", "asked_ids", "asked_values", "ids", "values")
    floors = paired.mapInPandas(seed, "asked string, place int, floor double").groupBy("asked").agg(F.collect_list(F.struct("place", "floor")).alias("floors"))
    armed = settled(query_side.join(floors, "asked").select("asked", "asked_ids", "asked_values", F.transform("floors", lambda x: x["place"]).alias("places"), F.transform("floors", lambda x: x["floor"]).alias("floors")))

    def wanted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for asked_block, block, data, places, floors_ in zip(part["asked"], part["block"], part["bounds"], part["places"], part["floors"]):
                row = np.frombuffer(data, dtype=np.float64)
                floor = np.full(len(row), -np.inf)
                floor[np.array(places)] = floors_
                if (live := row >= floor).any():
                    yield pd.DataFrame({"asked": [asked_block], "block": [block], "live": [np.nonzero(live)[0].astype(np.int32).tobytes()]})

    live = limits.join(armed.select("asked", "places", "floors"), "asked").mapInPandas(wanted, "asked string, block string, live binary")

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for live_, places, floors_, asked_ids, asked_values, ids, values in zip(part["live"], part["places"], part["floors"], part["asked_ids"], part["asked_values"], part["ids"], part["values"]):
                rows = np.frombuffer(live_, dtype=np.int32)
                own, there = np.frombuffer(asked_ids, dtype=np.int64), np.frombuffer(ids, dtype=np.int64)
                floor = np.full(len(own), -np.inf)
                floor[np.array(places)] = floors_
                scores = score_matrix(unpacked(asked_values, width)[rows], unpacked(values, width))
                out_q, out_v, out_s = [], [], []
                for q, row in zip(rows, scores):
                    fit = np.nonzero((row >= floor[q]) & (there != own[q]))[0]
                    fit = fit[best(row[fit], there[fit], k)]
                    out_q.append(np.full(len(fit), own[q]))
                    out_v.append(there[fit])
                    out_s.append(row[fit])
                yield pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    scored = live.join(armed, "asked").join(block_side, "block")
    scored = scored.select("live", "places", "floors", "asked_ids", "asked_values", "ids", "values").mapInPandas(score, PAIR_SCHEMA)
    return ranked(scored, k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; each block gave k at most."""
    from pyspark.sql.window import Window as W

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
