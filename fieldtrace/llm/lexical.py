"""Ranked lexical search by pipelined term partitioning.

The items' terms are dealt to owners, rare terms first. Documents lie in slices; a bundle holds, for all items of a block,
the sparse scores of one slice's documents. Bundles pass from owner to owner: at each stage a cogroup brings a slice's bundle
to the postings that this owner has for the slice, whose integer contributions are added; the last owner also selects. So
only scores from rarer terms travel, and no group is larger than a slice whatever the number of documents that hold a term.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldtrace.sources.writers import settled

#: Documents of a slice, terms after which a slice is closed early, items searched at a time, owners of terms.
SLICE, SLICE_TERMS, ITEMS, OWNERS = 2048, 1 << 22, 1024, 3
#: Weight of length, in hundredths, and saturation, in eighths.
LENGTH, SATURATION = 75, 8
TERMS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Terms hold no other ASCII characters than digits and letters: as bytes, all separators become blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

SLICES = "slice string, ids binary, known binary, lengths binary"
POSTINGS = "slice string, term int, docs binary, tfs binary, ids binary, known binary, lengths binary"
FOUND = "item int, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, text as binary) -> slices of documents with their lengths (term is null) and, for each term, its postings there."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        place, task = shared.value, TaskContext.get().partitionId()
        made = n_terms = 0
        ids: list[int | None] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []

        def closed() -> pd.DataFrame:
            known = np.array([i is not None for i in ids])
            head = {
                "slice": f"{task}-{made}", "term": None, "ids": np.array([i or 0 for i in ids], dtype=np.int64).tobytes(),
                "known": known.tobytes(), "lengths": np.array(lengths, dtype=np.int64).tobytes(),
            }
            codes, tfs = np.unique(np.concatenate(held), return_counts=True)
            terms, docs_ = codes // SLICE, (codes % SLICE).astype(np.int16)
            cuts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(codes) else np.zeros(0, dtype=np.int64)
            ends = np.append(cuts[1:], len(codes))
            rows = [{"slice": head["slice"], "term": int(terms[a]), "docs": docs_[a:b].tobytes(), "tfs": tfs[a:b].astype(np.int32).tobytes()} for a, b in zip(cuts, ends)]
            return pd.DataFrame([head, *rows], columns=[c.split()[0] for c in POSTINGS.split(", ")]).astype({"term": "Int32"})

        for part in parts:
            for doc_id, text in zip(part["doc_id"], part["text"]):
                found = terms_of(text)
                if not found:
                    continue
                places = np.fromiter((place.get(t, -1) for t in found), dtype=np.int64, count=len(found))
                held.append(places[places >= 0] * SLICE + len(ids))
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                lengths.append(len(found))
                n_terms += len(found)
                if len(ids) == SLICE or n_terms >= SLICE_TERMS:
                    yield closed()
                    made, n_terms, ids, lengths, held = made + 1, 0, [], [], []
        if ids:
            yield closed()

    # Ids as Int64: beside a null, 64-bit ids must not pass through doubles.
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(emit, POSTINGS)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def block_search(docs: DataFrame, items: list[dict[bytes, int]], k: int, owners: int) -> DataFrame:
    """(item, doc_id, score): at least the k best documents of each of a bounded list of items, k or fewer of each slice."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*items)))}
    found = settled(postings(docs, vocabulary))
    slices = found.where("term is null").select("slice", "ids", "known", "lengths")
    held = found.where("term is not null").select("slice", "term", "docs", "tfs")
    # Totals are summed where the slices are, df where the postings are: at most one row of each term meets the driver.
    totals = slices.select(F.explode(F.array(F.octet_length("known").cast("long"))).alias("docs"), "lengths").mapInPandas(total_lengths, "docs long, terms long")
    n_docs, n_terms = totals.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for r in held.groupBy("term").agg(F.sum(F.octet_length("docs") / 2).cast("long").alias("df")).collect():
        df[r["term"]] = r["df"]
    weights = np.array([weight(n_docs, int(x)) for x in df], dtype=np.int64)
    # Owners, from rare terms to frequent ones, of about equal numbers of postings.
    order = np.argsort(df, kind="stable")
    owner = np.zeros(len(df), dtype=np.int32)
    owner[order] = np.minimum(np.cumsum(df[order]) * owners // max(1, int(df.sum()) + 1), owners - 1)
    # Per term: the items that hold it, with their weights (repeats counted).
    wanted: dict[int, list[tuple[int, int]]] = {}
    for i, item in enumerate(items):
        for t, times in item.items():
            wanted.setdefault(vocabulary[t], []).append((i, times))
    shared = spark.sparkContext.broadcast({
        t: (np.array([i for i, _ in pairs]), np.array([times * int(weights[t]) for _, times in pairs], dtype=np.int64)) for t, pairs in wanted.items()
    })
    n_items = len(items)

    def stage(last: bool):
        def add(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            bundle = left.iloc[0]
            lengths = np.frombuffer(bundle["lengths"], dtype=np.int64)
            scores = unpacked(bundle["scores"], n_items, len(lengths))
            # Lengths times documents may pass 64 bits before the division: Python's integers do not.
            m = np.array([100 - LENGTH + (LENGTH * int(x) * n_docs) // n_terms for x in lengths], dtype=np.int64)
            for term, where, tfs in zip(right["term"], right["docs"], right["tfs"]):
                at, tf = np.frombuffer(where, dtype=np.int16), np.frombuffer(tfs, dtype=np.int32).astype(np.int64)
                part = (1_000_000_000 * tf) // (1000 * tf + SATURATION * m[at])
                rows, factors = shared.value[int(term)]
                scores[np.ix_(rows, at)] += factors[:, None] * part
            if not last:
                return left.assign(scores=[packed(scores)])
            return best(scores, np.frombuffer(bundle["ids"], dtype=np.int64), np.frombuffer(bundle["known"], dtype=bool), k)

        return add

    # Which owner a term has, as a table: postings meet their stage by a join on bounded rows.
    owned = held.join(F.broadcast(spark.createDataFrame([(i, int(o)) for i, o in enumerate(owner)], "term int, owner int")), "term")
    bundles = slices.withColumn("scores", F.lit(None).cast("binary"))
    for p in range(owners):
        mine = owned.where(F.col("owner") == p).select(F.col("slice").alias("of"), "term", "docs", "tfs")
        last = p == owners - 1
        schema = FOUND if last else f"{SLICES}, scores binary"
        bundles = bundles.groupBy("slice").cogroup(mine.groupBy("of")).applyInPandas(stage(last), schema)
    return bundles


def total_lengths(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield pd.DataFrame({"docs": part["docs"], "terms": [int(np.frombuffer(x, dtype=np.int64).sum()) for x in part["lengths"]]})


def packed(scores: np.ndarray) -> bytes:
    """The scores above 0 of a bundle: their places, as differences, and values."""
    flat = np.flatnonzero(scores)
    return np.int64(len(flat)).tobytes() + np.diff(flat, prepend=0).astype(np.int32).tobytes() + scores.ravel()[flat].tobytes()


def unpacked(data: bytes | None, n_items: int, n_docs: int) -> np.ndarray:
    scores = np.zeros((n_items, n_docs), dtype=np.int64)
    if data is not None:
        n = int(np.frombuffer(data, dtype=np.int64, count=1)[0])
        places = np.cumsum(np.frombuffer(data, dtype=np.int32, offset=8, count=n), dtype=np.int64)
        scores.ravel()[places] = np.frombuffer(data, dtype=np.int64, offset=8 + 4 * n, count=n)
    return scores


def best(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> pd.DataFrame:
    """The k best documents of each item in a slice, scores above 0 only; ties to smaller ids, null ids last."""
    out: list[tuple[int, int | None, int]] = []
    for i, row in enumerate(scores):
        fit = np.flatnonzero(row > 0)
        if len(fit) > 4 * k:
            fit = fit[row[fit] >= np.partition(row[fit], len(fit) - k)[len(fit) - k]]
        fit = fit[np.lexsort((ids[fit], ~known[fit], -row[fit]))][:k]
        out += [(i, int(ids[j]) if known[j] else None, int(row[j])) for j in fit]
    frame = pd.DataFrame(out, columns=["item", "doc_id", "score"])
    return frame.astype({"item": "int32", "doc_id": "Int64", "score": "int64"})


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, owners: int = OWNERS) -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score, all of them integers.

    ``docs`` holds (doc_id long, text), ``items`` (item_id long, text); other columns are not looked at. Terms, weights and
    scores are exact as the module and TERMS say; a document's length counts all its terms. Documents with a null text or
    without terms take no part and count nowhere; texts of any length are read whole. Repeated rows, and different texts of
    one doc_id, are ranked one by one; a null doc_id comes last among equal scores. Equal rows of items count once, different
    texts of one item_id (null is one as well) make one item of all their terms; items without terms, or that match nothing,
    have no rows, nor has anything if a table is empty. Items are searched in blocks of ITEMS, each in one pass.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where("text is not null")
    asked = settled(items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct())
    # Items in blocks: a block's terms are bounded, so that the driver and the tasks can hold them.
    known = asked.select("item_id").distinct()
    blocks = max(1, math.ceil(known.count() / ITEMS))
    block = F.pmod(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("null"))), F.lit(blocks).cast("long"))
    out = None
    for b in range(blocks):
        terms: dict[int | None, dict[bytes, int]] = {}
        for r in asked.where(block == b).select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
            own = terms.setdefault(r["item_id"], {})
            for t in terms_of(bytes(r["text"])):
                own[t] = own.get(t, 0) + 1
        terms = {i: own for i, own in terms.items() if own}
        if not terms:
            continue
        names = spark.createDataFrame(list(enumerate(terms)), "item int, item_id long")
        found = block_search(docs, list(terms.values()), k, owners)
        found = found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    # Each task keeps its own k best before the exchange, so that an item's rows are few whatever the number of slices.
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
