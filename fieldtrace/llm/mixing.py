"""Mixing sources to target weights: a time-varying curriculum.

Every source has a target number of words and a schedule, a piecewise linear weight over the run [0, 1]. The schedule's
integral says which share of its words a source has delivered by a time; its inverse gives each document of the source,
laid end to end in hash order, the time at which its first word is due. Documents are then range-sorted by that time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldtrace.llm.common import bucket_digits, hash_key, match, running, whole, words_in
from fieldtrace.sources.writers import settled

WEIGHTS = (5, 2, 1)
#: Knots (time, weight), one schedule for each weight in turn: heavy sources fade out, light ones come late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))
SEED = "|mix"
#: Sources of which texts that are not taken are dropped before the shuffle (those with the most such words); their table is broadcast.
CUT_SOURCES = 1_000


def due(share: Column, knots) -> Column:
    """The time by which a schedule has delivered ``share`` of all its weight."""
    areas = [(b + a) / 2 * (t - s) for (s, a), (t, b) in zip(knots, knots[1:])]
    whole_area, before, out = sum(areas), 0.0, None
    for ((s, a), (t, b)), area in zip(zip(knots, knots[1:]), areas):
        rest = share * F.lit(whole_area) - F.lit(before)
        slope = (b - a) / (t - s)
        at = F.lit(s) + F.lit(2.0) * rest / (F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + F.lit(2.0 * slope) * rest, F.lit(0.0))))
        before += area
        out = F.when(rest < F.lit(area), at) if out is None else out.when(rest < F.lit(area), at)
    return out.otherwise(F.lit(knots[-1][0]))


def targets(totals: DataFrame, weights=WEIGHTS, cap: int = 3) -> DataFrame:
    """(source, source_size) -> also place, weight and target.

    Sources in code point order, null last, take the weights in turn and share all words by weight. A share above
    ``cap`` times the source's words is cut there and the excess shared again by weight; sorted by weight per word,
    the cut sources come first, so one pass of running sums finds where sharing again ends.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1).cast("double")
    placed = totals.withColumn("place", place).withColumn("weight", weight)
    size = F.col("source_size").cast("double")
    dense = F.when(F.col("source_size") == 0, F.lit(float("inf"))).otherwise(F.col("weight") / size)
    order = W.orderBy(F.desc("_dense"), "place")
    so_far = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()).cast("double") - F.coalesce(F.sum("source_size").over(so_far) * cap, F.lit(0)).cast("double")) / F.sum("weight").over(onward)
    leveled = placed.withColumn("_dense", dense).withColumn("_level", level).withColumn("_rank", F.row_number().over(order))
    free = F.col("_level") * F.col("weight") <= size * cap
    final = F.min(F.when(free, F.struct("_rank", "_level"))).over(W.partitionBy())["_level"]
    target = F.least(size * cap, F.coalesce(final * F.col("weight"), F.lit(0.0)))
    return leveled.withColumn("target", target).select("source", "source_size", "place", "target")


def plan(docs: DataFrame, carry: bool = True, weights=WEIGHTS, cap: int = 3, schedules=SCHEDULES, untaken: str = "whole") -> DataFrame:
    """Rows of ``docs`` with how often each is taken and when.

    Of rows that are not taken the doc may be null with untaken="bare"; they may be missing with untaken="dropped".

    Columns: doc (struct of all columns of docs; with carry=False of doc_id alone), doc_id, source, size,
    source_size, target, copies (times taken), taken (copies * size), first_position (time of the first copy, null if
    not taken), times (one per copy), _key and _before (where a source's rows are laid: their hash and the words before them).

    A source is taken whole as often as its target allows; what is left goes to documents in hash order, whole ones
    only, and what they leave to the one further document whose size is closest to it, if that comes nearer to the
    target. So a source misses its target by less than half of its smallest fitting document, and no document is
    taken more than ``cap`` times. Null or empty texts have size 0 and are never taken; a null source is a source of
    its own; documents with equal ids are kept apart; texts of any length are counted whole; an empty table gives an empty plan.
    """
    sized = docs.select(
        whole(docs) if carry else F.struct("doc_id").alias("doc"), "doc_id", "source", words_in(F.col("text")).alias("size"),
        hash_key(F.col("doc_id"), SEED).alias("_key"),
    )
    narrow = settled(sized.select("doc_id", "source", "size", "_key"))
    if not carry:
        sized = narrow.withColumn("doc", F.struct("doc_id"))
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    rounds = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    goals = targets(totals, weights, cap).withColumn("_full", rounds)
    goals = settled(goals.withColumn("_rest", F.col("target") - F.col("_full") * F.col("source_size")))

    def laid(rows: DataFrame, facts: DataFrame) -> DataFrame:
        laid_out = running(rows, narrow, ["source"], "_key", ["doc_id", "size"], "size", "_before", facts)
        return laid_out.withColumn("_base", F.col("_before") + F.col("size") <= F.col("_rest"))

    slim = settled(laid(narrow, goals))
    base = slim.groupBy("source").agg(
        F.sum(F.when(F.col("_base"), F.col("size")).otherwise(0)).alias("_based"), F.max(F.when(F.col("_base"), F.col("_key"))).alias("_to")
    )
    gaps = match(slim, base, ["source"]).withColumn("_gap", F.col("_rest") - F.col("_based"))
    miss = F.abs(F.col("size") - F.col("_gap"))
    last = gaps.where(~F.col("_base") & (F.col("size") > 0) & (miss < F.col("_gap")))
    last = last.groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "_before", "size", "_key")).alias("_last"))
    ends = match(base, last, ["source"], "left")
    ends = settled(ends.select(
        "source", "_based", "_to", F.col("_last._before").alias("_last"), F.coalesce("_last.size", F.lit(0)).alias("_last_size"), F.col("_last._key").alias("_last_key")
    ))
    told = ends.drop("_to", "_last_key")

    if carry:
        facts = match(goals, told, ["source"])
        if untaken != "whole":
            sized = possible(sized, match(goals, ends, ["source"]), bucket_digits(narrow))
            bare = sized.withColumn("doc", F.when(F.col("_possible"), F.col("doc")))
            sized = (bare if untaken == "bare" else sized.where("_possible")).drop("_possible")
        rows = laid(sized, facts)
    else:
        rows = match(slim.withColumn("doc", F.struct("doc_id")), told, ["source"])
    filler = F.coalesce((F.col("_before") == F.col("_last")) & (F.col("size") > 0), F.lit(False))
    extra = (F.col("_base") | filler) & (F.col("size") > 0)
    copies = F.when(F.col("size") > 0, F.col("_full") + extra.cast("long")).otherwise(F.lit(0)).cast("int")
    length = F.col("_full") * F.col("source_size") + F.col("_based") + F.col("_last_size")
    start = F.when(filler, F.col("_based")).otherwise(F.col("_before"))

    def share(copy: Column) -> Column:
        late = copy > F.col("_full")
        return ((copy - 1) * F.col("source_size") + F.when(late, start).otherwise(F.col("_before"))) / length

    def time(share: Column) -> Column:
        out = None
        for i, knots in enumerate(schedules):
            mine = F.col("place") % len(schedules) == i
            out = F.when(mine, due(share, knots)) if out is None else out.when(mine, due(share, knots))
        return out

    # A share is named many times over the schedules: it is worked out once, in an array of its own.
    shares = F.transform(F.sequence(F.lit(1), F.col("copies")), share)
    times = F.when(F.col("copies") > 0, F.transform(shares, time)).otherwise(F.array().cast("array<double>"))
    rows = rows.withColumn("copies", copies).withColumn("times", times)
    return rows.select(
        "doc", "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.get("times", F.lit(0)).alias("first_position"), "times",
        "_key", "_before",
    )


def possible(rows: DataFrame, ends: DataFrame, digits: int) -> DataFrame:
    """Adds _possible, false for buckets of which nothing is taken, for the sources where most words are not taken.

    Of a source that is not taken whole, the rows up to the key ``_to`` are taken, and one further row, ``_last_key``.
    """
    cut = ends.where("_full = 0").orderBy(F.desc(F.col("source_size") - F.col("_based")), "source").limit(CUT_SOURCES)
    cut = cut.select("source", *(F.substring(c, 1, digits).alias(c) for c in ("_to", "_last_key")), F.lit(True).alias("_cut"))
    bucket = F.substring("_key", 1, digits)
    needed = F.coalesce(bucket <= F.col("_to"), F.lit(False)) | F.coalesce(bucket == F.col("_last_key"), F.lit(False))
    return match(rows, F.broadcast(cut), ["source"], "left").select(*rows.columns, (F.col("_cut").isNull() | needed).alias("_possible"))


def in_order(each: DataFrame) -> DataFrame:
    """Copies, rows with _time and _key, in training order: range-sorted by the time they are due."""
    return each.repartitionByRange("_time", "_key").sortWithinPartitions("_time", "_key")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents in training order: each as often as the plan takes it, range-sorted by the time it is due."""
    planned = plan(docs, carry=True, untaken="dropped", **options)
    each = planned.select("doc", "_key", F.explode("times").alias("_time"))
    return in_order(each).select("doc.*")


def delivered(docs: DataFrame, **options) -> DataFrame:
    """A row for each row of ``docs``, read off the mixture: whole documents, a row for each copy, written in training order.

    Columns: doc_id, source, size, source_size, target, and what the mixture holds of the row: copies, taken (their
    words) and first_position (null if it holds none). Rows that are not taken pass the sort without their document.
    """
    row = ["doc_id", "source", "size", "source_size", "target", "_before"]
    doc = F.when(F.col("copies") > 0, F.col("doc")).alias("doc")
    each = plan(docs, carry=True, untaken="bare", **options).select(doc, *row, "_key", F.explode_outer("times").alias("_time"))
    mixture = settled(in_order(each), "zstd")
    # Of the rows of a source that are taken no two have the same words before them; the others stand for themselves.
    alone = F.when(F.col("_time").isNull(), F.monotonically_increasing_id()).alias("_alone")
    held = mixture.select(*row, alone, "_time").groupBy(*row, "_alone").agg(
        F.count("_time").cast("int").alias("copies"), F.min("_time").alias("first_position")
    )
    return held.select(*row[:-1], "copies", (F.col("copies") * F.col("size")).alias("taken"), "first_position")
