"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A bounded sample of labelled texts is dealt to a fixed number of learners; each runs FTRL-proximal over its rows, and the
mean of their weights is the model (parameter mixing). A text's score is the sparse dot product of its n-gram shares
with the weights.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from fieldtrace.llm.common import hash_key, whole

#: Rows of each label in the training sample: its documented bound.
SAMPLE_ROWS = 6_000
LEARNERS, EPOCHS = 4, 10
BITS = 18
#: Learning rate, its floor, and the two penalties of FTRL-proximal.
ALPHA, BETA, L1, L2 = 3.0, 1.0, 1e-4, 1e-4
#: Hash of the bigram of any word with itself.
AGAIN = crc32(b"same again")
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Tokens hashed at a time and hashes remembered by a worker: bounds memory for texts of any length.
WINDOW, REMEMBERED = 1 << 16, 1 << 18


class Hashes(dict):
    """token -> hash, remembered for frequent tokens."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[token] = crc32(token.encode("utf-8", "replace"))
        return value


def features(text: str, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed unigrams and bigrams of the whole text: distinct indices and the square roots of their shares."""
    mask, found = (1 << BITS) - 1, []
    last = None
    tokens = iter(TOKEN.finditer(text))
    while True:
        window = [m.group() for _, m in zip(range(WINDOW), tokens)]
        if not window:
            break
        h = np.fromiter(map(hashes.__getitem__, window), dtype=np.uint64, count=len(window))
        chain = h if last is None else np.concatenate([[last], h])
        pairs = (chain[:-1] * np.uint64(0x9E3779B1) + chain[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)
        # A word after itself also counts as the one bigram "same again", whatever the word.
        again = np.full(int((chain[:-1] == chain[1:]).sum()), AGAIN, dtype=np.uint64)
        found.append(np.unique(np.concatenate([h ^ (h >> np.uint64(15)), pairs, again]) & np.uint64(mask), return_counts=True))
        last = h[-1]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    if len(found) == 1:
        index, counts = found[0]
    else:
        index, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([f[1] for f in found]))
    return index.astype(np.int64), np.sqrt(counts / counts.sum())


class Leader:
    """FTRL-proximal state: z and n per weight; the last weight is the intercept."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        shrunk = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, shrunk)

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        index, value = np.append(index, 1 << BITS), np.append(value, 1.0)
        w = self.weights(index)
        gradient = (1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ value))))) - label) * value
        n = self.n[index]
        self.z[index] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / ALPHA * w
        self.n[index] += gradient**2


@dataclass(frozen=True)
class Model:
    weights: np.ndarray

    def score(self, text: str | None, hashes: Hashes) -> float:
        index, value = features(text or "", hashes)
        total = float(self.weights[index] @ value) + float(self.weights[-1])
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, total))))


def learn_weights(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes, rows = Hashes(), []
    for part in parts:
        rows += [(*features(t, hashes), y, k) for t, y, k in zip(part["text"], part["label"], part["key"])]
    rows.sort(key=lambda r: r[3])
    leader = Leader()
    for _ in range(EPOCHS):
        for index, value, label, _ in rows:
            leader.learn(index, value, label)
    if rows:
        w = leader.weights(slice(None))
        at = np.append(np.nonzero(w[:-1])[0], 1 << BITS)
        yield pd.DataFrame({"at": at, "w": w[at], "one": 1.0 * (at == 1 << BITS)})


def train(sample: DataFrame) -> Model:
    """A model from a bounded sample of (doc_id, text, label) rows. Without rows it scores every text 0.5."""
    dealt = sample.withColumn("key", hash_key(F.col("doc_id"), "|order")).select("text", "label", "key").repartition(LEARNERS, "key")
    learned = dealt.mapInPandas(learn_weights, "at long, w double, one double")
    mean = learned.groupBy("at").agg(F.sum("w").alias("w"), F.sum("one").alias("one")).toPandas()
    weights = np.zeros((1 << BITS) + 1)
    weights[mean["at"].to_numpy()] = mean["w"] / max(1.0, mean["one"].sum())
    return Model(weights)


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Each row with doc (struct of all columns), doc_id, score (0 to 1) and predicted (1 at or above the threshold).

    Null and empty texts are scored by the intercept alone. Every row is scored by itself, repeated ones alike; texts of any
    length are read whole, a window of tokens at a time; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf(DoubleType())
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes, learned = Hashes(), shared.value
        for texts in parts:
            yield pd.Series([learned.score(t, hashes) for t in texts], dtype="float64")

    out = docs.select(whole(docs), "doc_id", score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
