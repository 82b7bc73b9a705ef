"""Bounded training samples and held-out rules, shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import hash_key


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_sample(rows: DataFrame, by: str, most: int, seed: str, counts: dict | None = None) -> DataFrame:
    """About ``most`` rows of each value of ``by``, all if there are fewer, chosen by a hash of doc_id.

    The share is taken from exact counts, so the sample grows no further than ``most`` (plus chance of a few per
    cent) however large a value is. Few values of ``by`` are expected: their counts are the driver's.
    """
    counts = counts if counts is not None else {r[by]: r["count"] for r in rows.groupBy(by).count().collect()}
    unit = F.conv(F.substring(hash_key(F.col("doc_id"), seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col(by) == F.lit(value)) & (unit < F.lit(min(1.0, most / n))))
    return rows.where(keep)


def labelled(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held: int, most: int) -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample (doc_id, text, label) of the documents with label 0 or 1 outside the held-out remainder.

    Also the number of such labels. The sample is drawn from the labels, about ``most`` of each, so its ids have a
    proven bound and are broadcast: the documents are read once and not shuffled. Documents with several labels take
    the larger one; rows without text are left out.
    """
    marks = labels.where(F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    marks = marks.where(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), modulus) != held))
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    chosen = bounded_sample(marks, "label", most, f"|{column}", counts)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null"), counts
