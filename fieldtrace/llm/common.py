"""What several operators share: rows kept whole beside clashing names, hash keys, running totals, components."""

from __future__ import annotations

import math
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldtrace.sources.writers import settled

#: A word is a run of anything but the six ASCII blanks; as bytes this is what bytes.split() yields.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one window partition of a running total should hold.
BUCKET_ROWS = 16_384


def whole(df: DataFrame, name: str = "doc") -> Column:
    """All columns as one struct, so that an operator's own names cannot clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name)


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(id_column: Column, seed: str = "") -> Column:
    """32 hex digits that order rows at random but always alike; null ids share one key."""
    return F.md5(F.concat(F.coalesce(id_column.cast("string"), F.lit("null")), F.lit(seed)).cast("binary"))


def crc(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def match(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Joins on null-safe equality of the columns, which Spark still plans as an equi-join."""
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in columns})
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in columns))
    return left.join(other, on, how).drop(*(f"_r_{c}" for c in columns))


def bucket_digits(narrow: DataFrame) -> int:
    """How many hex digits of a key name its bucket in ``running``."""
    return max(0, math.ceil(math.log(max(narrow.count(), 1) / BUCKET_ROWS, 16)))


def running(
    rows: DataFrame, narrow: DataFrame, group: list[str], key: str, ties: list[str], amount: str, name: str, facts: DataFrame | None = None
) -> DataFrame:
    """Adds the sum of ``amount`` over the rows of the group that come earlier in the order (key, ties).

    ``key`` is a hex hash, so its first digits cut every group, however large, into even buckets. ``narrow`` holds
    group, key and amount of the same rows and is only counted and summed. What came before a bucket, and the columns of
    ``facts`` (a row for each group), enter it as a row at its head, so that ``rows`` meet no join and pass one shuffle.
    They may lack whole buckets.
    """
    bucket = F.substring(F.col(key), 1, bucket_digits(narrow))
    sums = narrow.groupBy(*group, bucket.alias("_bucket")).agg(F.sum(amount).alias("_sum"))
    earlier = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    heads = sums.select(*group, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).cast("long").alias("_offset"))
    if facts is not None:
        told = [c for c in facts.columns if c not in group]
        heads = match(heads, facts.select(*group, F.struct(*told).alias("_facts")), group)
    both = rows.withColumn("_bucket", bucket).unionByName(heads, allowMissingColumns=True)
    # A head has no key and so comes first.
    inside = W.partitionBy(*group, "_bucket").orderBy(F.col(key).asc_nulls_first(), *ties).rowsBetween(W.unboundedPreceding, -1)
    total = F.sum(F.coalesce("_offset", F.col(amount).cast("long"))).over(inside)
    if facts is None:
        return both.withColumn(name, total).where(F.col("_offset").isNull()).drop("_bucket", "_offset")
    summed = both.withColumns({name: total, "_facts": F.first("_facts", ignorenulls=True).over(inside)}).where(F.col("_offset").isNull())
    return summed.select(*rows.columns, name, *(F.col("_facts").getField(c).alias(c) for c in told))


def settled_any(df: DataFrame, condition: Column) -> tuple[DataFrame, bool]:
    """The same rows, written to the shared folder, and whether any of them meets the condition, observed on the way.

    A task that is repeated because an executor was lost is counted again, which turns no 0 into another number. Where
    Spark knows a table to be empty it observes nothing; then the written rows are looked at.
    """
    seen = Observation()
    kept = settled(df.observe(seen, F.count_if(condition).alias("n")))
    try:
        return kept, seen.get["n"] > 0
    except (Py4JJavaError, KeyError):
        return kept, not kept.where(condition).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): the smallest node of each connected component, for all nodes that have a link.

    Rounds of hooking and pointer jumping on whole tables: in each round every root takes the smallest root that a
    link shows it, then all pointers are followed to their ends. Links within one component are dropped, so the table
    of links shrinks, and a chain of n nodes needs about log n rounds. Each round is written to the shared folder, and
    whether anything is left is observed while it is written.
    """
    def open_links(pairs: DataFrame) -> tuple[DataFrame, bool]:
        distinct = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        return settled_any(distinct, F.lit(True))

    pointers = None
    links, left_over = open_links(edges)
    while left_over:
        hook = settled(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        moved = True
        while moved:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            jumped = hook.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved"))
            hook, moved = settled_any(jumped, F.col("moved"))
            hook = hook.drop("moved")
        fresh = hook
        if pointers is None:
            pointers = fresh
        else:
            ends = fresh.select(F.col("node").alias("root"), F.col("root").alias("end"))
            old = pointers.join(ends, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
            pointers = settled(old.unionByName(fresh.join(old.select("node"), "node", "left_anti")))
        left = fresh.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = fresh.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        joined = links.join(left, "a", "left").join(right, "b", "left")
        links, left_over = open_links(joined.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    if pointers is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    tops = pointers.select(F.col("root").alias("node"), "root").distinct()
    return pointers.unionByName(tops)
