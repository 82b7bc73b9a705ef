"""Repeated passages by sparse suffix arrays.

Suffixes are retained only where a text's own words say so: at the minimisers, the least hash of a run of K words among
W successive ones. Two texts that share K + W - 1 words share a minimiser. Suffixes whose K words occur nowhere else
are dropped by counting; the others carry the words before and after as hashes, are sorted by them over the cluster and
compared with their neighbours; a match is extended to the right and to the left, and reported from ``words`` words on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldtrace.llm.common import match
from fieldtrace.sources.writers import settled

#: Words of a reported passage, words hashed at a suffix, and positions among which one suffix is retained.
WORDS, RUN, WINDOW = 50, 15, 24
#: Words of context a suffix carries after and before its position. Before: the next minimiser to the left is no further.
AFTER, BEFORE = WORDS, WINDOW
#: Words hashed at a time and hashes remembered by a worker: bounds memory for texts of any length.
REMEMBERED = 1 << 18
SPAN_SCHEMA = "row_id long, start int, stop int"


class Words(dict):
    """word -> 64-bit hash, remembered for frequent words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(text: bytes | None, seen: Words) -> np.ndarray:
    words = (text or b"").split()
    return np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))


def run_hashes(h: np.ndarray, run: int = RUN) -> np.ndarray:
    """A hash of each ``run`` successive words: the sum of the words' hashes times odd powers, well mixed at the end."""
    n = len(h) - run + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(run):
            out += h[i : i + n] * power
            power = power * factor
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def minimisers(keys: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions that hold the least key (the first of equal ones) of some ``window`` successive keys, or of all."""
    n = len(keys)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    width = min(window, n)
    places = np.lib.stride_tricks.sliding_window_view(keys, width).argmin(axis=1) + np.arange(n - width + 1)
    return np.unique(places)


def anchors(rows: DataFrame) -> DataFrame:
    """(row_id, text as binary) -> (row_id, key, at): the retained suffixes of each text; at = -1 - its words once."""

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Words()
        for part in parts:
            ids, keys, places = [], [], []
            for row_id, text in zip(part["row_id"], part["text"]):
                h = word_hashes(text, seen)
                k = run_hashes(h)
                at = minimisers(k)
                ids.append(np.full(len(at), row_id))
                keys.append(k[at].view(np.int64))
                places.append(at)
                # A row without key tells the number of words.
                ids.append([row_id])
                keys.append([0])
                places.append([-1 - len(h)])
            yield pd.DataFrame({"row_id": np.concatenate(ids), "key": np.concatenate(keys), "at": np.concatenate(places).astype(np.int32)})

    return rows.mapInPandas(emit, "row_id long, key long, at int")


def contexts(rows: DataFrame) -> DataFrame:
    """(row_id, text, places) -> the words from a place on, then those before it, nearest first; equal ones of a text once, with all their places.

    A word is 4 bytes of its hash; 0 stands for no word, so a context that meets the end of its text is the shorter one.
    """

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Words()
        for part in parts:
            for row_id, text, places in zip(part["row_id"], part["text"], part["places"]):
                h = word_hashes(text, seen).astype(np.uint32)
                h[h == 0] = 1
                padded = np.concatenate([np.zeros(BEFORE, dtype=np.uint32), h, np.zeros(AFTER, dtype=np.uint32)])
                at = np.asarray(places, dtype=np.int64)
                after = padded[(at + BEFORE)[:, None] + np.arange(AFTER)]
                before = padded[(at + BEFORE - 1)[:, None] - np.arange(BEFORE)]
                both = np.concatenate([after, before], axis=1).astype(">u4")
                held: dict[bytes, list[int]] = {}
                for c, i in zip(both, at.tolist()):
                    held.setdefault(c.tobytes(), []).append(i)
                yield pd.DataFrame({"row_id": row_id, "places": list(held.values()), "context": list(held)})

    return rows.mapInPandas(emit, "row_id long, places array<int>, context binary")


def extents(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that rows of contexts share to the right and to the left of their positions."""
    equal = (a == b) & (a != 0)
    right, left = equal[:, :AFTER], equal[:, AFTER:]
    return np.where(right.all(axis=1), AFTER, right.argmin(axis=1)), np.where(left.all(axis=1), BEFORE, left.argmin(axis=1))


def spans_of(ids: np.ndarray, places: np.ndarray, c: np.ndarray, others: np.ndarray, words: int) -> pd.DataFrame:
    """What suffixes share with others (one each, or one for all) from ``words`` words on, at all their places."""
    right, left = extents(c, others)
    good = np.flatnonzero(right + left >= words)
    at = np.concatenate([np.zeros(0, dtype=np.int64), *places[good]]).astype(np.int64)
    each = np.repeat(good, [len(places[i]) for i in good])
    return pd.DataFrame({"row_id": ids[each], "start": at - left[each], "stop": at + right[each]})


#: Rows of a scan: a span; suffixes of a partition's first run that look for what precedes it, of its last run for what follows;
#: its first suffix, the first of its second run, its last suffix, the last of its last run but one.
SPAN, OPENING, CLOSING, FIRST, SECOND, LAST, FORMER = range(7)


def matched(sorted_suffixes: DataFrame, words: int) -> DataFrame:
    """Compares each suffix with the nearest ones of other texts before and after it in its sorted partition.

    Suffixes of one text stand in runs. The suffix before a run is carried as long as the run lasts, and so are those of its
    suffixes that may still share enough with what follows: ``words`` less BEFORE to the right, since all later ones share
    no more. What a run at a partition's edge lacks is told by rows of their own.
    """
    least = words - BEFORE

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        empty = b""

        def told(place: int, ids, c: np.ndarray, places=None) -> pd.DataFrame:
            return pd.DataFrame({"row_id": ids, "start": 0, "stop": 0, "task": task, "place": place, "context": [x.tobytes() for x in c], "places": [None] * len(c) if places is None else places})

        first = former = last = None
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for part in parts:
            if not len(part):
                continue
            ids, places = part["row_id"].to_numpy(), part["places"].to_numpy()
            c = np.frombuffer(b"".join(part["context"]), dtype=">u4").reshape(len(part), -1)
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            ends = np.append(starts[1:], len(ids))
            goes_on = last is not None and last[0] == ids[0]
            edges, spans = [], []
            if first is None:
                first = (ids[0], c[0])
                edges.append(told(FIRST, ids[:1], c[:1]))
            # Before: rows of the batch's first run look at what was carried.
            lead = former if goes_on else last
            n = ends[0]
            if lead is not None:
                spans.append(spans_of(ids[:n], places[:n], c[:n], lead[1][None], words))
            else:
                some = np.flatnonzero(extents(c[:n], first[1][None])[0] >= least)
                edges.append(told(OPENING, ids[some], c[some], places[some]))
            run = np.repeat(np.arange(len(starts)), ends - starts)
            spans.append(spans_of(ids[n:], places[n:], c[n:], c[starts[run[n:]] - 1], words))
            # After: what waited meets the first row of another text; the batch's last run waits.
            met = 0 if not goes_on else n
            if last is not None and met < len(ids):
                if former is None:
                    edges.append(told(SECOND, ids[met : met + 1], c[met : met + 1]))
                spans += [spans_of(*rows, c[met][None], words) for rows in waiting]
                former, waiting = last, []
            k = starts[-1]
            spans.append(spans_of(ids[:k], places[:k], c[:k], c[ends[run[:k]]], words))
            if k > 0:
                if former is None:
                    edges.append(told(SECOND, ids[n : n + 1], c[n : n + 1]))
                former = (ids[k - 1], c[k - 1])
            if waiting and extents(waiting[-1][2][-1:], c[-1:])[0][0] < least:
                waiting = []
            some = k + np.flatnonzero(extents(c[k:], c[-1:])[0] >= least)
            # The last row stays even where it is too short to match, so that what waits can be told from what comes.
            some = np.union1d(some, [len(ids) - 1])
            waiting.append((ids[some], places[some], c[some]))
            last = (ids[-1], c[-1])
            found = pd.concat(spans).drop_duplicates().assign(task=task, place=SPAN, context=empty, places=None)
            yield from (x for x in (found, *edges) if len(x))
        if last is not None:
            yield from (told(CLOSING, i, c, p) for i, p, c in waiting)
            yield told(LAST, [last[0]], last[1][None])
            if former is not None:
                yield told(FORMER, [former[0]], former[1][None])

    return sorted_suffixes.mapInPandas(scan, SPAN_SCHEMA + ", task int, place int, context binary, places array<int>")


def nearest(ends: dict[int, dict[int, tuple[int, bytes]]], tasks: list[int], outer: int, inner: int) -> dict[int, list[tuple[int, bytes]]]:
    """For each partition, the nearest suffix beyond its edge and the nearest of another text than that one's."""
    known: list[tuple[int, bytes]] = []
    out = {}
    for t in tasks:
        out[t] = known
        top = ends[t][outer]
        known = [top, *[x for x in (ends[t].get(inner), *known) if x is not None and x[0] != top[0]][:1]]
    return out


def across(edges: DataFrame, words: int) -> DataFrame:
    """Spans of suffixes whose nearest ones of other texts lie in other partitions, however many their run fills.

    Four suffixes of each partition meet at the driver.
    """
    ends: dict[int, dict[int, tuple[int, bytes]]] = {}
    for r in edges.where(F.col("place") >= FIRST).select("task", "place", "row_id", "context").collect():
        ends.setdefault(r["task"], {})[r["place"]] = (r["row_id"], bytes(r["context"]))
    before, after = nearest(ends, sorted(ends), LAST, FORMER), nearest(ends, sorted(ends, reverse=True), FIRST, SECOND)
    shared = edges.sparkSession.sparkContext.broadcast({OPENING: before, CLOSING: after})

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for (task, place, row_id), rows in part.groupby(["task", "place", "row_id"]):
                other = next((x for i, x in shared.value[place][task] if i != row_id), None)
                if other is not None:
                    c, x = (np.frombuffer(b, dtype=">u4") for b in (b"".join(rows["context"]), other))
                    yield spans_of(rows["row_id"].to_numpy(), rows["places"].to_numpy(), c.reshape(len(rows), -1), x[None], words)

    return edges.where(F.col("place").isin(OPENING, CLOSING)).mapInPandas(compare, SPAN_SCHEMA)


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a text as one."""
    order = W.partitionBy("row_id").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = spans.withColumn("_new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    islands = islands.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy("row_id", "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_island")


def repeated_spans(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, start, stop): the passages of each document, in words from 0, that other documents hold as well, merged.

    Words are what ASCII blanks separate. Every reported word lies in a passage of at least ``words`` words that another
    document shares; every shared passage of ``words`` + WINDOW - 1 words or more is found, and a shorter one where the
    sort makes its places neighbours. Passages that repeat within one document only are not reported. A text that
    several rows hold is reported whole if it has ``words`` words; null and shorter texts have no spans. Texts are told
    apart by a 64-bit hash, texts of any length are read whole, and an empty table gives no spans.
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("row_id")).where("text is not null")
    found = settled(anchors(rows.select("row_id", "text")))
    spread = found.where("at >= 0").groupBy("key").agg(F.min("row_id").alias("a"), F.max("row_id").alias("b"))
    keys = settled(spread.where("a <> b").select("key"))
    places = found.where("at >= 0").join(keys, "key", "left_semi").groupBy("row_id").agg(F.sort_array(F.collect_set("at")).alias("places"))
    # One row stands for all that hold the same text: their suffixes would only repeat each other.
    owners = settled(docs.where("text is not null").groupBy(F.xxhash64("text").alias("row_id")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")))
    held = settled(places.join(owners, "row_id").select("row_id", "doc_id", "places"))
    suffixes = contexts(match(rows, held, ["doc_id", "row_id"]).select("row_id", "text", "places"))
    ordered = suffixes.repartitionByRange("context", "row_id").sortWithinPartitions("context", "row_id")
    compared = settled(matched(ordered, words))
    spans = compared.where(F.col("place") == SPAN).select("row_id", "start", "stop")
    spans = spans.unionByName(across(compared.where(F.col("place") > SPAN), words))
    sizes = found.where("at < 0").select("row_id", (-1 - F.col("at")).alias("n")).where(F.col("n") >= words)
    copied = owners.where("copies > 1").join(sizes, "row_id", "inner").select("row_id", F.lit(0).alias("start"), F.col("n").cast("int").alias("stop")).distinct()
    joined = settled(merged(spans.unionByName(copied)))
    narrow = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("row_id"))
    return narrow.join(joined, "row_id").select("doc_id", "start", "stop")
