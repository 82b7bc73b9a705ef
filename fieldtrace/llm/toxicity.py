"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The lexicon is learned: words and word beginnings that toxic texts of the sample use far more often than others, and in
many different contexts (so that words of one much-copied text stay out). The trees see how dense it is, how near
second-person words stand to it, and rates of capitals, punctuation and obfuscated spelling. Lexicon and trees are
fitted on one part of a bounded sample, the calibration on the other.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from fieldtrace.llm.common import hash_key, whole
from fieldtrace.sources.writers import settled

#: Rows of each label in the training sample: its documented bound. The share that fits, the rest calibrates.
SAMPLE_ROWS = 4_000
FIT_SHARE = 11 / 16
#: A term enters the lexicon with so many toxic texts, contexts and times the others' share; the lexicon's largest size.
SUPPORT, CONTEXTS, LIFT, LEXICON = 5, 4, 15.0, 4_000
BEGINNINGS = (4, 5)
TREES, DEPTH, STEP = 20, 3, 0.3
NEAR = 5
LETTERS = re.compile(r"[^\W\d_]+")
MIXED = re.compile(r"[^\W\d_][0-9@$*!|]+[^\W\d_]")
#: Digits and signs that stand for letters.
LEET = str.maketrans("0134578@$!|", "oieastbasil")
#: Second-person words of the corpus languages.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch tu tú te ti tus usted ustedes vous votre vos toi ton ta tes".split())
FEATURES = (
    "lexicon_hits", "lexicon_density", "hits_near_you", "you_density", "capitals", "shouted_words", "punctuation", "exclamations",
    "obfuscated", "obfuscated_hits", "length",
)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each UTF-16 unit: 1 capital, 2 other letter, 3 digit, 4 punctuation or symbol, 5 exclamation mark."""
    table = np.zeros(1 << 16, dtype=np.uint8)
    for code in range(1 << 16):
        kind = unicodedata.category(chr(code))
        table[code] = 1 if kind in ("Lu", "Lt") else 2 if kind[0] == "L" else 3 if kind[0] == "N" else 4 if kind[0] in "PS" else 0
    table[ord("!")] = 5
    return table


def terms(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def hits(words, lexicon: frozenset) -> set[str]:
    return {w for w in words if w in lexicon or w[:4] + "*" in lexicon or w[:5] + "*" in lexicon}


def features(text: str | None, lexicon: frozenset) -> list[float]:
    """The dense features, over the whole text; null counts as empty."""
    text = text or ""
    counts = np.bincount(classes()[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")], minlength=6)
    words = LETTERS.findall(text.lower())
    n, chars = max(1, len(words)), max(1, len(text))
    you = sum(w in YOU for w in words)
    found, near = 0, 0
    if bad := hits(set(words), lexicon):
        at = np.array([i for i, w in enumerate(words) if w in bad])
        found = len(at)
        if you:
            other = np.array([i for i, w in enumerate(words) if w in YOU])
            after = np.minimum(np.searchsorted(other, at), len(other) - 1)
            near = int((np.minimum(np.abs(other[after] - at), np.abs(other[np.maximum(after - 1, 0)] - at)) <= NEAR).sum())
    odd, odd_hits = 0, 0
    if MIXED.search(text):
        tokens = [t for t in text.lower().split() if MIXED.search(t)]
        odd = len(tokens)
        for token in tokens:
            plain = token.strip(".,;:?\"'()").translate(LEET)
            odd_hits += bool(hits([plain, plain.replace("*", "")], lexicon))
    shouted = sum(map(str.isupper, text.split())) if counts[1] > 3 else 0
    return [
        float(found), 100.0 * found / n, float(near), 100.0 * you / n, counts[1] / max(1, counts[1] + counts[2]), shouted / n,
        (counts[4] + counts[5]) / chars, counts[5] / chars, 100.0 * odd / n, float(odd_hits), math.log1p(len(words)),
    ]


@dataclass(frozen=True)
class Model:
    """Without trees (too few labels) every text gets the prior."""

    lexicon: frozenset
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float


def learn_lexicon(rows: DataFrame) -> frozenset:
    """Terms of (text, label) rows that mark label 1. One row per text and term is counted, in Spark."""

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for text, label in zip(part["text"], part["label"]):
                words = LETTERS.findall(text.lower())
                first = {}
                for before, word in zip(["", *words], words):
                    for term in terms(word):
                        first.setdefault(term, before)
                yield pd.DataFrame({"term": list(first), "before": list(first.values()), "label": label})

    once = rows.groupBy(F.xxhash64("text").alias("t")).agg(F.max(F.struct("text", "label")).alias("r")).select("r.text", "r.label")
    once = settled(once)
    totals = {r["label"]: r["count"] for r in once.groupBy("label").count().collect()}
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not other:
        return frozenset()
    seen = once.mapInPandas(emit, "term string, before string, label int")
    context = F.when(F.col("label") == 1, F.xxhash64("before") % 1024)
    counts = seen.groupBy("term", context.alias("context")).agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("o"))
    counts = counts.groupBy("term").agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.count("context").alias("contexts"))
    lift = ((F.col("t") + 0.5) / (toxic + 1.0)) / ((F.col("o") + 0.5) / (other + 1.0))
    chosen = counts.where((F.col("t") >= SUPPORT) & (F.col("contexts") >= CONTEXTS) & (lift >= LIFT))
    return frozenset(r["term"] for r in chosen.orderBy(F.desc("t"), "term").limit(LEXICON).collect())


def featured(rows: DataFrame, lexicon: frozenset) -> DataFrame:
    @pandas_udf(ArrayType(DoubleType()))
    def dense(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([features(t, lexicon) for t in texts])

    return rows.withColumn("_features", array_to_vector(dense(F.col("text"))))


def train(rows: DataFrame, counts: dict[int, int]) -> Model:
    """A model from a bounded sample of (doc_id, text, label) rows; ``counts`` says how many of each label there are."""
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    key = F.conv(F.substring(hash_key(F.col("doc_id"), "|part"), 1, 4), 16, 10).cast("double") / 65536
    sample = settled(rows.select("text", "label", (key < FIT_SHARE).alias("fit")))
    lexicon = learn_lexicon(sample.where("fit").select("text", "label"))
    seen = settled(featured(sample, lexicon).select("label", "fit", "_features"))
    sizes = {(r["fit"], r["label"]): r["count"] for r in seen.groupBy("fit", "label").count().collect()}
    if not sizes.get((True, 1)) or not sizes.get((True, 0)):
        return Model(lexicon, None, None, prior)
    trees = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7).setProbabilityCol("_q")
    model = trees.fit(seen.where("fit"))
    if not sizes.get((False, 1)) or not sizes.get((False, 0)):
        return Model(lexicon, model, None, prior)
    # The sample has its own share of each label; weights restore the table's.
    weight = F.when(F.col("label") == 1, F.lit(counts[1] / sizes[(False, 1)])).otherwise(F.lit(counts[0] / sizes[(False, 0)]))
    raw = model.transform(seen.where("not fit")).select(F.col("label").cast("double").alias("label"), vector_to_array("_q")[1].alias("_raw"), (weight / float(total)).alias("_weight"))
    calibration = IsotonicRegression(featuresCol="_raw", labelCol="label", weightCol="_weight", predictionCol="_score").fit(raw)
    return Model(lexicon, model, calibration, prior)


def scored(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Each row with doc (struct of all columns), doc_id, score (0 to 1) and predicted (1 at or above the threshold).

    Null, empty and blank texts have no words and score what the trees say of such a text. Every row is scored by itself,
    repeated ones alike; texts of any length are read whole; an empty table gives no rows.
    """
    rows = docs.select(whole(docs), "doc_id", "text")
    if model.trees is None:
        out = rows.withColumn("_score", F.lit(model.prior))
    else:
        out = model.trees.transform(featured(rows, model.lexicon)).withColumn("_raw", vector_to_array("_q")[1])
        out = model.calibration.transform(out) if model.calibration else out.withColumn("_score", F.col("_raw"))
    score = F.least(F.greatest(F.col("_score"), F.lit(0.0)), F.lit(1.0))
    return out.select("doc", "doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
