"""Splits by entity or by sample, and hash-driven sampling.

Random order comes from a hash of the key and a seed, so results repeat and do not depend on partitioning.
Ranks are counted bucket by bucket of the hash's leading digits: no window ever holds a whole class or table, and the
number of buckets follows the number of rows.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtrace.operators.ordered import match
from fieldtrace.sources.writers import settled

# Rows that a bucket of the hash should hold.
BUCKET_ROWS = 16_384


def bucket_digits(rows: int) -> int:
    """Leading hex digits of the hash that cut ``rows`` rows into buckets of ``BUCKET_ROWS``."""
    digits = 0
    while rows > BUCKET_ROWS * 16**digits:
        digits += 1
    return digits


def shuffle_key(seed: int, *keys: str) -> Column:
    """Hex hash of the keys and the seed; sorting by it shuffles."""
    return F.md5(F.concat_ws("#", *(F.col(k).cast("string") for k in keys), F.lit(str(seed))))


def hash_rank(df: DataFrame, key: Column, group: list[str]) -> DataFrame:
    """Add rank (from 0, by hash, within ``group``) and group_rows.

    The rows are counted once to choose the buckets; offsets per (group, bucket) are one row for many, joined without
    a hint.
    """
    digits = bucket_digits(df.count())
    rows = df.withColumn("_hash", key).withColumn("_bucket", F.substring("_hash", 1, digits))
    counts = rows.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    if not group:
        counts = counts.withColumn("_g", F.lit(0))
        rows = rows.withColumn("_g", F.lit(0))
    by = group or ["_g"]
    w = Window.partitionBy(*by).orderBy("_bucket")
    offsets = counts.select(
        *by,
        "_bucket",
        F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(*by)).alias("group_rows"),
    )
    within = Window.partitionBy(*by, "_bucket").orderBy("_hash")
    ranked = match(rows, offsets, [*by, "_bucket"])
    ranked = ranked.withColumn("rank", F.col("_off") + F.row_number().over(within) - 1)
    return ranked.drop("_hash", "_bucket", "_off", "_g")


def majority_label(df: DataFrame, entity: str = "entity_id", label: str = "label") -> DataFrame:
    """The most frequent label of each entity, the smallest one on ties."""
    counts = df.groupBy(entity, label).agg(F.count(F.lit(1)).alias("_n"))
    best = F.max_by(label, F.struct("_n", -F.col(label)))
    return counts.groupBy(entity).agg(best.alias("majority"), F.sum("_n").alias("rows"))


def stratified_entity_split(
    df: DataFrame,
    train: float = 0.7,
    val: float = 0.15,
    seed: int = 42,
    entity: str = "entity_id",
    label: str = "label",
) -> DataFrame:
    """(entity, majority, split): per majority class, shuffled entities cut at int(n*train) and int(n*val)."""
    ranked = hash_rank(majority_label(df, entity, label).drop("rows"), shuffle_key(seed, entity), ["majority"])
    n_train = F.floor(F.col("group_rows") * train)
    n_val = F.floor(F.col("group_rows") * val)
    split = F.when(F.col("rank") < n_train, "train").when(F.col("rank") < n_train + n_val, "val").otherwise("test")
    return ranked.select(entity, "majority", split.alias("split"))


def small_split(
    samples: DataFrame, keys: list[str], train: float = 0.7, val: float = 0.15, seed: int = 42
) -> DataFrame:
    """Sample-level split for fewer than three entities; keeps train, then test, then val from being empty."""
    ranked = hash_rank(samples, shuffle_key(seed, *keys), [])
    n = F.col("group_rows")
    n_train = F.greatest(F.lit(1), F.floor(n * train))
    rest = F.greatest(n - n_train, F.lit(0))
    n_val = F.when(n >= 3, F.least(F.greatest(F.lit(1), F.floor(n * val)), F.greatest(rest - 1, F.lit(0)))).otherwise(0)
    ranked = ranked.withColumns({"_train": n_train, "_val": n_val})
    no_test = (n - F.col("_train") - F.col("_val") == 0) & (n >= 2)
    from_val = no_test & (F.col("_val") > 1)
    from_train = no_test & ~from_val & (F.col("_train") > 1)
    ranked = ranked.withColumns(
        {
            "_val": F.col("_val") - from_val.cast("int"),
            "_train": F.col("_train") - from_train.cast("int"),
        }
    )
    split = (
        F.when(F.col("rank") < F.col("_train"), "train")
        .when(F.col("rank") < F.col("_train") + F.col("_val"), "val")
        .otherwise("test")
    )
    return ranked.withColumn("split", split).drop("rank", "group_rows", "_train", "_val")


def split_windows(
    samples: DataFrame, keys: list[str], train: float = 0.7, val: float = 0.15, seed: int = 42,
    entity: str = "entity_id", label: str = "label",
) -> DataFrame:
    """Samples with split: by entity, or by sample when there are fewer than three entities."""
    # Looking for three entities comes first, so that only one of the two ways is planned.
    if samples.select(entity).distinct().limit(3).count() < 3:
        return small_split(samples, keys, train, val, seed)
    by_entity = stratified_entity_split(samples, train, val, seed, entity, label).drop("majority")
    return samples.join(by_entity, entity)


def cached_split(spark: SparkSession, path: str, compute) -> DataFrame:
    """The split stored at ``path``; computed by ``compute()`` and stored when there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        compute().write.mode("ignore").parquet(path)
        return spark.read.parquet(path)


def unit_of(key: Column) -> Column:
    """A number in [0, 1) from the first twelve digits of a hash."""
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / float(16**12)


def allotted(units: DataFrame, n: int, total: float, shift: float, digits: int) -> DataFrame:
    """(unit, w) -> (unit, draws): n draws split over the units in proportion to w, exactly n in all.

    Unit after unit the running share is cut at whole draws, all cuts moved by one random ``shift``: the draws of a unit
    are its expected number, rounded up or down at random. Running totals are taken in two steps, over a leading part of
    the units' names and inside it; a unit ends where the next one begins, so no draw is lost or made twice.
    """
    sums = units.withColumn("_half", F.substring("unit", 1, 1 + digits // 2))
    before = Window.unboundedPreceding, -1
    by_half, by_unit = Window.orderBy("_half"), Window.partitionBy("_half").orderBy("unit")
    tops = sums.groupBy("_half").agg(F.sum("w").alias("_t"))
    tops = tops.withColumn("_top", F.coalesce(F.sum("_t").over(by_half.rowsBetween(*before)), F.lit(0.0)))
    tops = tops.select("_half", "_top", F.lead("_top").over(by_half).alias("_next_top"))
    inside = F.coalesce(F.sum("w").over(by_unit.rowsBetween(*before)), F.lit(0.0))
    placed = sums.join(tops, "_half").withColumn("_off", F.col("_top") + inside)
    cut = lambda x: F.floor(x / F.lit(total) * n + shift)
    end = F.coalesce(F.lead("_off").over(by_unit), F.col("_next_top"))
    return placed.select("unit", (F.coalesce(cut(end), F.lit(n)) - cut(F.col("_off"))).cast("bigint").alias("draws"))


def weighted_resample(samples: DataFrame, keys: list[str], weight: str = "weight", seed: int = 42) -> DataFrame:
    """As many draws as samples, with replacement, each sample in proportion to its weight; adds draw, a key of its own.

    The draws are first split over buckets of the samples' hash (``allotted``). Inside a bucket every sample begins at
    the running weight total in hash order, a draw is a hash-made point, and the two are met by one sort: a point belongs
    to the last sample that begins at or before it, so every point has exactly one, whatever the rounding. Points are made
    on a row of their bucket and share its exchange. A sample that expects more draws than a bucket has rows is a unit of
    its own, whose draws are made in chunks. Missing weights and those not above 0 are never drawn; if there are no others,
    nothing is. ``samples`` is read several times: settle it first when it is the end of a long chain.
    """
    w = F.col(weight).cast("double")
    rows = samples.select(F.struct(*samples.columns).alias("row"), shuffle_key(seed, *keys).alias("_hash"), w.alias("_w"))
    drawable = F.when(F.col("_w") > 0, F.col("_w"))
    n, total, most = rows.agg(F.count(F.lit(1)), F.sum(drawable), F.max(drawable)).first()
    if total is None:
        return samples.where("false").withColumn("draw", F.lit("").cast("string"))
    digits = bucket_digits(n)
    rows = rows.where("_w > 0").withColumn("_bucket", F.substring("_hash", 1, digits))
    shift = int(hashlib.md5(str(seed + 3).encode()).hexdigest()[:12], 16) / 16**12
    heavy = F.col("_w") * n > F.lit(total) * BUCKET_ROWS
    some_heavy = most * n > total * BUCKET_ROWS
    light, own = rows.where(~heavy) if some_heavy else rows, rows.where(heavy)
    units = light.groupBy(F.concat(F.lit("b"), "_bucket").alias("unit")).agg(F.sum("_w").alias("w"))
    if some_heavy:
        units = settled(units.unionByName(own.select(F.concat(F.lit("h"), "_hash").alias("unit"), F.col("_w").alias("w"))))
    shares = allotted(units, n, total, shift, digits)
    shares = settled(shares) if some_heavy else shares

    def key(offset: int, i: Column) -> Column:
        return F.md5(F.concat_ws("#", F.col("unit"), i.cast("string"), F.lit(str(seed + offset))))

    ordered = Window.partitionBy("unit").orderBy("_hash")
    begin = F.coalesce(F.sum("_w").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = light.withColumn("unit", F.concat(F.lit("b"), "_bucket")).withColumns({"_lo": begin, "_n": F.row_number().over(ordered)})
    whole = Window.partitionBy("unit").orderBy("_hash").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = placed.withColumn("_all", F.last(F.col("_lo") + F.col("_w")).over(whole)).join(shares, "unit", "left")
    made = F.transform(F.sequence(F.lit(1), F.col("draws")), lambda i: F.struct((unit_of(key(1, i)) * F.col("_all")).alias("x"), i.cast("bigint").alias("i")))
    begins = F.array(F.struct(F.col("_lo").alias("x"), F.lit(None).cast("bigint").alias("i")))
    events = F.when((F.col("_n") == 1) & (F.col("draws") > 0), F.concat(begins, made)).otherwise(begins)
    spread = placed.select("unit", "_hash", "row", F.inline(events))
    met = Window.partitionBy("unit").orderBy("x", F.asc_nulls_first("i"), "_hash").rowsBetween(Window.unboundedPreceding, 0)
    drawn = spread.withColumn("row", F.last(F.when(F.col("i").isNull(), F.col("row")), True).over(met)).where(F.col("i").isNotNull())

    drawn = drawn.select("unit", "row", "i")
    if not some_heavy:
        return drawn.select("row.*", key(2, F.col("i")).alias("draw"))
    chunks = own.withColumn("unit", F.concat(F.lit("h"), "_hash")).join(shares.where("draws > 0"), "unit")
    last = F.floor((F.col("draws") - 1) / BUCKET_ROWS)
    chunks = chunks.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).repartition("unit", "_chunk")
    first = F.col("_chunk") * BUCKET_ROWS + 1
    many = chunks.withColumn("i", F.explode(F.sequence(first, F.least(first + BUCKET_ROWS - 1, F.col("draws")))))
    out = drawn.unionByName(many.select("unit", "row", "i"))
    return out.select("row.*", key(2, F.col("i")).alias("draw"))


def shuffle_samples(samples: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """All samples in hash order (a range-partitioned sort)."""
    return samples.orderBy(shuffle_key(seed, *keys))
