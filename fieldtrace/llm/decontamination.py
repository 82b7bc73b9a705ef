"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into units of a passage's length; with the passages of all documents they form a TF-IDF matrix
(words of units have rows of their own, the others share rows by hash; document frequencies over all documents) whose leading right singular vectors come from a distributed randomised SVD:
each task multiplies its rows, only sums the size of the vocabulary meet. A text is cut into words once, and written with their rows
for the fit and the search. A document's stretches are met with all units by the rows
they have in common: a stretch that lacks too many of a unit's words cannot hold a long enough subsequence of it, and no other
is left out. The windows of a candidate are tried in the order of their latent likeness to the unit; one must share a long
enough subsequence of words with it, and enough of its answer (the unit's last sentence), so rewordings are caught and chance
likeness is not. Latent likeness decides the order alone: which leaks are found does not depend on
the fit, only which of several windows gives an item's share.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from fieldtrace.llm.common import whole
from fieldtrace.sources.writers import settled

#: Words of a block and of a passage.
BLOCK, PASSAGE = 16, 48
#: Items up to so many words are one unit; longer ones become overlapping units of a passage.
UNIT = 64
#: Blocks of a window: any UNIT + 1 successive words lie inside one.
BLOCKS = UNIT // BLOCK + 1
#: Windows of a stretch, whose words are counted against the units at once.
STRETCH = 16
RANK, OVERSAMPLE, ROUNDS, SEED = 96, 16, 2, 11
#: Units of a block for which the rank grows by one.
UNITS_A_RANK = 32
#: Share of a unit's words in the common subsequence; of its answer's; share that needs no answer.
SHARED, ANSWERED, VERBATIM = 0.7, 0.5, 0.9
#: Units searched for in one pass over the documents, and rows of the latent space for their words (words beyond them share
#: rows) and for all other words of the corpus, which share them: the bounds of what is sent to every task and kept by the
#: driver, whatever the size of the benchmark and of the corpus.
UNITS_AT_A_TIME, FEATURES, OTHERS = 5_000, 1 << 17, 1 << 13
#: Words whose passages are multiplied at once, and the lengths that sums of rows are filled up to, a quarter more at the mean.
GROUP = 1 << 16
LENGTHS = np.array(sorted(f << k for f in (1, 3) for k in range(24)))
#: Rows that are summed at once: they stay near the processor.
ENTRIES = 1 << 12
#: Documents that are counted in bytes, before the counts are added up.
COUNTED = 255
#: Words of documents that are searched together.
WORDS_AT_A_TIME = 1 << 15
#: Pairs of a stretch and a unit that are counted at once.
CELLS = 1 << 17
#: Signs beyond ASCII that belong to no word; of ASCII, all but letters, digits and the underscore are blanks.
ODD = re.compile(r"[^\w\x00-\x7f]")
BLANKED = bytes(i if i > 127 or chr(i).isalnum() or chr(i) == "_" else 32 for i in range(256))
SENTENCE = re.compile(r"[.?!]+")
SLICE = 4096
LEAKS = ArrayType(StructType([StructField("item_id", LongType()), StructField("share", DoubleType())]))


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text (runs of word characters) as UTF-8."""
    text = (text or "").lower()
    if not text.isascii():
        text = ODD.sub(" ", text)
    return text.encode("utf-8", "replace").translate(BLANKED).split()


def as_text(words: list[bytes]) -> list[str]:
    return [w.decode() for w in words]


def units_of(text: str) -> list[tuple[list[str], list[str]]]:
    """(words, answer) of each unit of an item, lower-cased."""
    words = as_text(words_of(text))
    sentences = [s for s in (as_text(words_of(x)) for x in SENTENCE.split(text)) if s]
    if not words:
        return []
    if len(words) <= UNIT:
        return [(words, sentences[-1])]
    starts = [*range(0, len(words) - PASSAGE, PASSAGE // 2), len(words) - PASSAGE]
    return [(words[s : s + PASSAGE], words[s + PASSAGE * 3 // 4 : s + PASSAGE]) for s in starts]


def common_subsequence(masks: dict, n: int, words: list) -> int:
    """Length of the longest common subsequence of ``words`` and the n words whose places ``masks`` holds as bits."""
    full = (1 << n) - 1
    row = full
    for w in words:
        if (m := masks.get(w)) is not None:
            match = row & m
            row = ((row + match) | (row - match)) & full
    return n - row.bit_count()


def masks_of(words: list) -> dict:
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Places(dict):
    """word (UTF-8) -> its row; -1 for words outside the vocabulary."""

    def __missing__(self, word: str) -> int:
        return -1

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Rows of the words that have one."""
        found = np.fromiter(map(self.get, words, repeat(-1)), dtype=np.int32, count=len(words))
        return found[found >= 0]


class Vocabulary(Places):
    """word (UTF-8) -> its row: of its own (up to ``FEATURES``) for each of the given words, shared by hash for all others."""

    def __init__(self, words: set[bytes]):
        super().__init__((w, i % FEATURES) for i, w in enumerate(sorted(words)))
        self.own = min(len(words), FEATURES)

    def __reduce__(self):
        return Vocabulary, (set(self),)

    def __missing__(self, word: bytes) -> int:
        return self.own + zlib.crc32(word) % OTHERS

    def rows(self, words: list[bytes]) -> np.ndarray:
        """The row of each word."""
        found = np.fromiter(map(self.get, words, repeat(-1)), dtype=np.int32, count=len(words))
        other = found < 0
        fresh = list(compress(words, other.tolist()))
        found[other] = self.own + np.fromiter(map(zlib.crc32, fresh), dtype=np.int64, count=len(fresh)) % OTHERS
        return found


@dataclass
class Index:
    """What every task needs: vocabulary, weighted latent rows of its words, and the units with their vectors and postings."""

    vocabulary: Places = field(default_factory=Places)
    rows: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), dtype=np.float32))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), dtype=np.float32))
    units: list[tuple[int, list[bytes], list[bytes]]] = field(default_factory=list)


@dataclass
class Postings:
    """For each row of the units' words: the units that hold such a word, and at how many places."""

    edges: np.ndarray
    units: np.ndarray
    places: np.ndarray
    #: Places of each unit whose words a stretch must have.
    needed: np.ndarray


def postings_of(index: Index) -> Postings:
    found: Counter = Counter()
    for u, (_, words, _) in enumerate(index.units):
        found.update((index.vocabulary[w], u) for w in words)
    row, unit, places = np.array(sorted((*at, n) for at, n in found.items()), dtype=np.int64).reshape(-1, 3).T
    needed = np.array([next(k for k in range(len(w) + 1) if k >= SHARED * len(w)) for _, w, _ in index.units], dtype=np.int64)
    return Postings(np.searchsorted(row, np.arange(index.vocabulary.own + 1)), unit, places, needed)


def numbered(rows: DataFrame, vocabulary: Places, words: Column) -> DataFrame:
    """The rows, written with ids: the vocabulary's rows of the words of a text or array of words, in their order."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    @arrow_udf(BinaryType())
    def ids(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = shared.value
        for part in parts:
            # One text at a time: the words of a whole batch would take some hundred MB.
            texts = (x.as_py() for x in part)
            yield pa.array((vocabulary.rows([w.encode() for w in x] if isinstance(x, list) else words_of(x)).tobytes() for x in texts), pa.binary(), size=len(part))

    out = settled(rows.withColumn("ids", ids(words)))
    shared.destroy()
    return out


def fit_passages(docs: DataFrame, units: DataFrame, vocabulary: Places) -> DataFrame:
    """(ids, step) of the units, a passage each (step 0), and of all numbered documents, whose passages are ``step`` words long."""
    held = numbered(units.select("words"), vocabulary, F.col("words"))
    return held.select("ids", F.lit(0).alias("step")).unionByName(docs.select("ids", F.lit(PASSAGE).alias("step")))


def holders(documents: Iterator[bytes], size: int) -> np.ndarray:
    """For each row, how many of the documents (rows of words) hold it: marked and unmarked one document at a time, nothing is sorted."""
    out, some, mark = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.uint8), np.zeros(size, dtype=np.uint8)
    for k, ids in enumerate(documents, 1):
        own = np.frombuffer(ids, dtype=np.int32)
        mark[own] = 1
        some += mark
        mark[own] = 0
        if k % COUNTED == 0:
            out += some
            some[:] = 0
    return out + some


def document_frequencies(passages: DataFrame, size: int) -> np.ndarray:
    """For each row of the vocabulary, how many of all documents hold a word of it."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = holders((ids for part in parts for ids in part["ids"]), size)
        at = np.flatnonzero(out)
        yield pd.DataFrame({"at": at, "n": out[at]})

    counts = passages.where("step > 0").mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[counts["at"].to_numpy()] = counts["n"].to_numpy()
    return out


def starts_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, dtype=np.int64)


def weights(ids: np.ndarray, passage: np.ndarray, n: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, passage and TF-IDF weight of each word of n passages, by row, and what makes each passage's length 1; from each place's row and passage."""
    at = np.sort(ids.astype(np.int64) * n + passage)
    first = starts_of(at)
    row, held = np.divmod(at[first], n)
    value = np.diff(first, append=len(at)) * idf[row]
    norms = np.sqrt(np.bincount(held, value * value, minlength=n))
    return row, held, value, np.divide(1, norms, out=np.zeros_like(norms), where=norms > 0)


def weighted(words: list[bytes], vocabulary: Places, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and unit-length TF-IDF weights of a passage."""
    ids = np.array([vocabulary[w] for w in words if w in vocabulary], dtype=np.int64)
    row, _, value, inverse = weights(ids, np.zeros(len(ids), dtype=np.int64), 1, idf)
    return row, value * inverse[0]


def summed(first: np.ndarray, at: np.ndarray, value: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """For each run of entries (starting at ``first``) the sum of its rows ``at`` of the matrix, times the values."""
    sizes = np.diff(first, append=len(at))
    filled = LENGTHS[np.searchsorted(LENGTHS, sizes)]
    at, value = np.append(at, 0), np.append(value, 0).astype(matrix.dtype)
    out = np.empty((len(first), matrix.shape[1]), dtype=matrix.dtype)
    order = np.argsort(filled, kind="stable")
    for edge in np.split(order, starts_of(filled[order])[1:]):
        length = filled[edge[0]] if len(edge) else 1
        step = max(1, ENTRIES // length)
        for k in range(0, len(edge), step):
            some = edge[k : k + step]
            if length == 1:
                out[some] = matrix.take(at[first[some]], axis=0) * value[first[some], None]
                continue
            # Beyond a run's end stands the last entry, whose value is 0.
            place = np.where(np.arange(length) < sizes[some, None], first[some, None] + np.arange(length), len(at) - 1)
            out[some] = np.matmul(value[place][:, None], matrix.take(at[place], axis=0))[:, 0]
    return out


def groups(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Some passages at a time: the words' rows, the words' passages and the number of passages."""
    ids, passage, words, n = [], [], 0, 0
    for part in parts:
        for data, step in zip(part["ids"], part["step"]):
            own = np.frombuffer(data, dtype=np.int32)
            step = int(step) or max(1, len(own))
            stride = step * max(1, GROUP // step)
            for k in range(0, len(own), stride):
                some = own[k : k + stride]
                ids.append(some)
                passage.append(n + np.arange(len(some)) // step)
                words, n = words + len(some), n - (-len(some) // step)
                if words >= GROUP:
                    yield np.concatenate(ids), np.concatenate(passage), n
                    ids, passage, words, n = [], [], 0, 0
    if ids:
        yield np.concatenate(ids), np.concatenate(passage), n


def projected(parts: Iterator[pd.DataFrame], idf: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some passages at a time: what ``weights`` says of them, and the products of the unit-length passages with q."""
    for ids, passage, n in groups(parts):
        row, held, value, inverse = weights(ids, passage, n, idf)
        yield row, held, value, inverse, summed(starts_of(passage), ids, idf[ids], q) * inverse.astype(q.dtype)[:, None]


def multiply(passages: DataFrame, shared, basis, size: int, width: int) -> DataFrame:
    """A'(A Q) for the TF-IDF matrix A of the passages, in slices of rows: each task sums its rows, slices of the sums meet by groups.

    There are as many tasks as cores: what meets does not grow with the corpus.
    """

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = stacked(basis.value, width) if basis is not None else np.random.default_rng(SEED).standard_normal((size, width)).astype(np.float32)
        out = np.zeros((size, width))
        for part in parts:
            some = np.zeros((size, width), dtype=np.float32)
            for row, held, value, inverse, product in projected(iter([part]), shared.value, q):
                first = starts_of(row)
                sums = summed(first, held, value * inverse[held], product)
                sums += some.take(row[first], axis=0)
                some[row[first]] = sums
            out += some
        yield pd.DataFrame({"slice": range(0, size, SLICE), "data": [out[i : i + SLICE].tobytes() for i in range(0, size, SLICE)]})

    def total(key, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": [key[0]], "data": [sum(np.frombuffer(x) for x in part["data"]).tobytes()]})

    tasks = passages.sparkSession.sparkContext.defaultParallelism
    sums = passages.coalesce(tasks).mapInPandas(partial, SLICES).groupBy("slice").applyInPandas(total, SLICES)
    return settled(sums)


def squared(passages: DataFrame, shared, basis, width: int, use) -> bytes:
    """``use`` of (A Q)'(A Q), a width x width matrix, in a task: each task sums over its passages; only what ``use`` returns meets the driver."""

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, out = stacked(basis.value, width), np.zeros((width, width))
        for part in parts:
            for *_, product in projected(iter([part]), shared.value, q):
                out += product.T @ product
        yield pd.DataFrame({"data": [out.tobytes()]})

    tasks = passages.sparkSession.sparkContext.defaultParallelism
    return used(passages.coalesce(tasks).mapInPandas(partial, "data binary").repartition(1), width, use)


def used(sums: DataFrame, width: int, use) -> bytes:
    """``use`` of the sum of width x width matrices, in one task."""

    def finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = sum(np.frombuffer(x).reshape(width, width) for part in parts for x in part["data"])
        yield pd.DataFrame({"data": [use(out).tobytes()]})

    return bytes(sums.mapInPandas(finish, "data binary").first()["data"])


SLICES = "slice long, data binary"


def stacked(slices: list[bytes], width: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype=np.float32).reshape(-1, width) for x in slices])


def in_order(slices: DataFrame, dtype=np.float64) -> list[bytes]:
    """The slices by number, in single precision. The driver only passes Arrow batches on: no rows, no sort."""

    def single(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(data=[np.frombuffer(x, dtype=dtype).astype(np.float32).tobytes() for x in part["data"]])

    found = (slices if dtype == np.float32 else slices.mapInPandas(single, SLICES)).toArrow()
    return [x["data"] for x in sorted(found.to_pylist(), key=lambda x: x["slice"])]


def turned(left: DataFrame, right: DataFrame, width: int, use) -> bytes:
    """``use`` of the sum over slices of left' right, a width x width matrix, in a task; only what it returns meets the driver."""

    def product(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((width, width))
        for part in parts:
            for a, b in zip(part["a"], part["b"]):
                out += np.frombuffer(a).reshape(-1, width).T @ np.frombuffer(b).reshape(-1, width)
        yield pd.DataFrame({"data": [out.tobytes()]})

    pairs = left.withColumnRenamed("data", "a").join(right.withColumnRenamed("data", "b"), "slice").select("a", "b")
    return used(pairs.mapInPandas(product, "data binary").coalesce(1), width, use)


def times(slices: DataFrame, turn: bytes, width: int, finish=None) -> DataFrame:
    """Each slice times a matrix of ``width`` rows, then ``finish`` of its first row's number and itself."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.frombuffer(turn).reshape(width, -1)
        for part in parts:
            found = [(i, np.frombuffer(x).reshape(-1, width) @ m) for i, x in zip(part["slice"], part["data"])]
            yield pd.DataFrame({"slice": part["slice"], "data": [(finish(i, x) if finish else x).tobytes() for i, x in found]})

    return settled(slices.mapInPandas(run, SLICES))


def inverse_root(gram: np.ndarray) -> np.ndarray:
    """What makes the columns with this Gram matrix orthonormal; directions without length become zeros."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    scale = np.where(values > values.max() * 1e-12, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    return vectors * scale


def latent_rows(passages: DataFrame, vocabulary: Places, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The words' latent rows: the leading right singular vectors of the passages times idf, by randomised subspace iteration.

    Passages are rows of words or those of ``fit_passages``. The matrices stay in slices of the vocabulary: the driver passes
    the basis on as bytes and does no algebra.
    """
    if "ids" not in passages.columns:
        passages = numbered(passages.select("words"), vocabulary, F.col("words")).withColumn("step", F.lit(0))
    context, size = passages.sparkSession.sparkContext, len(idf)
    width = min(rank + OVERSAMPLE, size)
    kept = min(rank, width)
    shared, basis = context.broadcast(idf), None
    for _ in range(ROUNDS):
        sums = multiply(passages, shared, basis, size, width)
        q = times(sums, turned(sums, sums, width, inverse_root), width)
        if basis is not None:
            basis.destroy()
        basis = context.broadcast(in_order(q))

    def leading(small: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        return vectors[:, np.argsort(-values)[:kept]].copy()

    rows = times(q, squared(passages, shared, basis, width, leading), width, lambda i, x: (x * idf[i : i + len(x), None]).astype(np.float32))
    out = stacked(in_order(rows, np.float32), kept)
    basis.destroy()
    shared.destroy()
    return out


def unit_blocks(benchmark: DataFrame) -> Iterator[tuple[DataFrame, list, Vocabulary]]:
    """The units of (item_id, text), at most about ``UNITS_AT_A_TIME`` at once: as rows, as (item_id, words, answer), and the vocabulary."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [(i, w, a) for i, text in zip(part["item_id"], part["text"]) for w, a in units_of(text)]
            yield pd.DataFrame(out, columns=["item_id", "words", "answer"])

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    units = settled(items.mapInPandas(cut, "item_id long, words array<string>, answer array<string>"))
    blocks = -(-units.count() // UNITS_AT_A_TIME)
    block = F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks).cast("long"))
    for b in range(blocks):
        some = units.where(block == b)
        held = [(r["item_id"], [w.encode() for w in r["words"]], [w.encode() for w in r["answer"]]) for r in some.collect()]
        if held:
            held.sort()
            yield some, held, Vocabulary({w for _, words, _ in held for w in words})


def fitted(docs: DataFrame, units: DataFrame, held: list, vocabulary: Vocabulary) -> Index:
    """The index over some units, fitted on them and on all numbered documents."""
    passages = fit_passages(docs, units, vocabulary)
    idf = np.log((1.0 + docs.count()) / (1.0 + document_frequencies(passages, vocabulary.own + OTHERS))) + 0.1
    rows = latent_rows(passages, vocabulary, idf, RANK + len(held) // UNITS_A_RANK)
    vectors = np.stack([rows[[vocabulary[w] for w in words]].sum(axis=0) for _, words, _ in held])
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Index(vocabulary, rows, (vectors / np.maximum(norms, 1e-12)).astype(np.float32), held)


def build_index(docs: DataFrame, benchmark: DataFrame) -> list[Index]:
    """Indexes over all units of (item_id, text), at most about ``UNITS_AT_A_TIME`` of them in each."""
    return [fitted(numbered(docs.select("text"), v, F.col("text")), some, held, v) for some, held, v in unit_blocks(benchmark)]


def candidates(postings: Postings, texts: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(text, first block of a stretch, unit) where the stretch has as many of the unit's places as a leak must share; texts are rows of words."""
    bounds, rows, own = [], [], len(postings.edges) - 1
    for d, ids in enumerate(texts):
        for first in range(0, -(-len(ids) // BLOCK), STRETCH):
            # All that the windows of the stretch are compared by, for the longest unit.
            some = ids[max(0, first * BLOCK - UNIT) : (first + STRETCH - 1 + BLOCKS) * BLOCK + UNIT]
            rows.append(some[some < own] + np.int64(len(bounds) * own))
            bounds.append((d, first))
    if not bounds:
        return []
    cells = np.sort(np.concatenate(rows))
    stretch, row = np.divmod(cells[starts_of(cells)], own)
    sizes, n, out = postings.edges[row + 1] - postings.edges[row], len(postings.needed), []
    ends = np.cumsum(sizes)
    edges = np.searchsorted(stretch, np.arange(len(bounds) + 1))
    step = max(1, CELLS // n)
    for k in range(0, len(bounds), step):
        a, b = edges[k], edges[min(k + step, len(bounds))]
        if a == b:
            continue
        at = np.arange(ends[b - 1] - ends[a] + sizes[a]) + np.repeat(postings.edges[row[a:b]] - (ends[a:b] - sizes[a:b] - ends[a] + sizes[a]), sizes[a:b])
        cell = np.repeat(stretch[a:b] - k, sizes[a:b]) * n + postings.units[at]
        met = np.bincount(cell, postings.places[at], minlength=step * n).reshape(-1, n)
        out += [(*bounds[s + k], int(u)) for s, u in zip(*np.nonzero(met >= postings.needed))]
    return out


def likeness(index: Index, ids: np.ndarray) -> np.ndarray:
    """Cosines of a stretch's windows (one for each block) and all units in the latent space, from the rows of its words."""
    blocks = -(-len(ids) // BLOCK)
    sums = np.zeros((blocks + BLOCKS, index.rows.shape[1]), dtype=np.float32)
    sums[:blocks] = np.add.reduceat(index.rows[ids], np.arange(0, len(ids), BLOCK), axis=0)
    windows = sum(sums[k : k + blocks] for k in range(BLOCKS))
    return windows @ index.vectors.T / np.maximum(np.linalg.norm(windows, axis=1, keepdims=True), 1e-12)


def find(index: Index, masks: list, postings: Postings, texts: list[pa.StringScalar], ids: list[np.ndarray]) -> list[list[tuple[int, float]]]:
    """Leaks (item_id, share of words in common) of some documents, given as texts and the rows of their words."""
    done: dict[tuple[int, int], float] = {}
    seen, near, cut, own_words = (-1, -1), np.zeros((0, 0)), -1, []
    for d, first, u in candidates(postings, ids):
        item, unit, answer = index.units[u]
        if (d, item) in done:
            continue
        if d != cut:
            cut, own_words = d, words_of(texts[d].as_py())
        if (d, first) != seen:
            seen, near = (d, first), likeness(index, ids[d][first * BLOCK : (first + STRETCH - 1 + BLOCKS) * BLOCK])
        n = len(unit)
        unit_masks, answer_masks = masks[u]
        for w in first + np.argsort(-near[:STRETCH, u], kind="stable"):
            start = int(w) * BLOCK
            region = own_words[max(0, start - n) : start + BLOCKS * BLOCK + n]
            # No common subsequence is longer than the places of the unit whose words occur at all.
            places_met = 0
            for word in unit_masks.keys() & set(region):
                places_met |= unit_masks[word]
            if places_met.bit_count() < postings.needed[u]:
                continue
            share = common_subsequence(unit_masks, n, region) / n
            if share >= SHARED and (share >= VERBATIM or common_subsequence(answer_masks, len(answer), region) >= ANSWERED * len(answer)):
                done[d, item] = share
                break
    out: list[list[tuple[int, float]]] = [[] for _ in texts]
    for (d, item), share in done.items():
        out[d].append((item, share))
    return out


def leak_column(context, index: Index):
    shared = context.broadcast(index)

    @arrow_udf(LEAKS)
    def leaks(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        held = shared.value
        masks = [(masks_of(words), masks_of(answer)) for _, words, answer in held.units]
        postings = postings_of(held)
        for texts, ids in parts:
            out: list = []
            group: tuple[list, list] = ([], [])
            size = 0
            for text, data in zip(texts, ids):
                # Both stay where they are in the batch: few texts are looked into.
                group[0].append(text)
                group[1].append(np.frombuffer(data.as_buffer(), dtype=np.int32))
                size += len(group[1][-1])
                if size >= WORDS_AT_A_TIME:
                    out += find(held, masks, postings, *group)
                    group, size = ([], []), 0
            out += find(held, masks, postings, *group)
            yield pa.array([[{"item_id": i, "share": s} for i, s in sorted(x)] for x in out], pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64())])))

    return leaks


def with_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each row with doc (struct of all columns), doc_id and leaks: (item_id, share of its words in common order).

    Null and empty texts, an empty benchmark and items without words have no leaks. Repeated items are reported once.
    """
    out = docs.select(whole(docs), F.array().cast("array<struct<item_id:long,share:double>>").alias("leaks"))
    text = F.col("doc").getField("text")
    for units, held, vocabulary in unit_blocks(benchmark):
        # The documents are written beside the rows of their words, once for each block of units.
        out = numbered(out, vocabulary, text)
        found = leak_column(docs.sparkSession.sparkContext, fitted(out, units, held, vocabulary))(text, "ids")
        out = out.select("doc", F.concat("leaks", found).alias("leaks"))
    # Units of one item may lie in several indexes.
    items = F.transform("leaks", lambda x: x["item_id"])
    once = F.filter("leaks", lambda x, i: F.array_position(items, x["item_id"]) == i + 1)
    return out.select("doc", F.col("doc").getField("doc_id").alias("doc_id"), once.alias("leaks"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    return with_leaks(docs, benchmark).where(F.size("leaks") == 0).select("doc.*")
