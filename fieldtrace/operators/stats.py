"""Normalisation statistics, class weights and sample weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions.scalar import array_sum
from fieldtrace.schema import NUM_CLASSES

# Fixed values of the published normalisation rule.
MIN_STD = 1e-6
STD_OFFSET = 1e-6


def feature_stats(df: DataFrame, features: list[str], weight: str | None = None) -> DataFrame:
    """(feature, rows, mean, std): population moments of each feature, each row counted ``weight`` times.

    One aggregation: moments are taken per distinct weight (map-side combined, numerically stable) and the
    handful of per-weight moments is then merged. A spread below 1e-6 is reported as 1.
    """
    weight_col = F.lit(1) if weight is None else F.col(weight)
    moments = [F.struct(F.lit(f).alias("feature"), F.avg(f).alias("m"), F.var_pop(f).alias("v")) for f in features]
    grouped = df.groupBy(weight_col.alias("_w")).agg(F.count(F.lit(1)).alias("_n"), F.array(*moments).alias("_moments"))
    parts = grouped.where("_w > 0").select((F.col("_n") * F.col("_w")).alias("n"), F.inline("_moments"))
    of_feature = Window.partitionBy("feature")
    mean = F.sum(F.col("n") * F.col("m")).over(of_feature) / F.sum("n").over(of_feature)
    parts = parts.withColumn("mean", mean)
    off = F.col("m") - F.col("mean")
    merged = parts.groupBy("feature").agg(
        F.sum("n").alias("rows"),
        F.first("mean").alias("mean"),
        F.sqrt(F.sum(F.col("n") * (F.col("v") + off * off)) / F.sum("n")).alias("std"),
    )
    return merged.withColumn("std", F.when(F.col("std") < MIN_STD, 1.0).otherwise(F.col("std")))


def normalise(df: DataFrame, stats: DataFrame, features: list[str]) -> DataFrame:
    """Replace each feature by (x - mean) / (std + 1e-6); ``stats`` (a row per feature) becomes one constant."""
    entry = F.struct("feature", F.struct("mean", "std"))
    table = stats.agg(F.map_from_entries(F.collect_list(entry)).alias("s")).scalar()
    # Held in one column first: the subquery is then planned once, not once per feature.
    scaled = {f: F.expr(f"({f} - _stats['{f}'].mean) / (_stats['{f}'].std + {STD_OFFSET}D)") for f in features}
    return df.withColumn("_stats", table).withColumns(scaled).drop("_stats")


def class_counts(df: DataFrame, label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Rows per label, optionally per further columns."""
    return df.groupBy(*(by or []), label).agg(F.count(F.lit(1)).alias("rows"))


def _count_array(df: DataFrame, label: str, num_classes: int) -> DataFrame:
    """One row with the count of every class, absent classes as 0: a single partial aggregate."""
    counts = F.array(*(F.count_if(F.col(label) == c) for c in range(num_classes)))
    return df.agg(counts.alias("n"))


def _weight_rows(counts: DataFrame, weight) -> DataFrame:
    """Counts array -> (class_id, rows, weight) with the weights scaled to add up to the number of classes."""
    table = counts.withColumn("w", F.transform("n", lambda n: weight(F.greatest(n, F.lit(1)).cast("double"))))
    table = table.withColumn("total", array_sum(F.col("w")))
    table = table.select("total", "n", F.size("n").alias("k"), F.posexplode("w").alias("class_id", "raw"))
    scaled = F.col("raw") / F.col("total") * F.col("k")
    return table.select("class_id", F.get("n", F.col("class_id")).alias("rows"), scaled.alias("weight"))


def class_weights(
    df: DataFrame, label: str = "label", power: float = 0.5, num_classes: int = NUM_CLASSES
) -> DataFrame:
    """Inverse class frequency raised to ``power``; absent classes count as one row."""
    return _weight_rows(_count_array(df, label, num_classes), lambda n: F.pow(n, F.lit(-float(power))))


def effective_number_weights(
    df: DataFrame, label: str = "label", beta: float = 0.999, num_classes: int = NUM_CLASSES
) -> DataFrame:
    """(1 - beta) / (1 - beta^n) per class; beta <= 0 means 1/n."""
    beta = float(beta)

    def weight(n: Column) -> Column:
        return 1.0 / n if beta <= 0 else F.lit(1.0 - beta) / (1.0 - F.pow(F.lit(beta), n))

    return _weight_rows(_count_array(df, label, num_classes), weight)


def aux_pos_weights(df: DataFrame, classes: list[int], label: str = "label", power: float = 0.5) -> DataFrame:
    """One-vs-rest weight (others / own)^power of each listed class, both counts at least 1."""
    per_class = [
        F.struct(F.lit(c).alias("class_id"), F.count_if(F.col(label) == c).alias("pos")) for c in classes
    ]
    table = df.agg(F.count(F.lit(1)).alias("n"), F.array(*per_class).alias("t")).select("n", F.inline("t"))
    others = F.greatest(F.col("n") - F.col("pos"), F.lit(1))
    weight = F.pow(others / F.greatest(F.col("pos"), F.lit(1)), F.lit(float(power)))
    return table.select("class_id", F.col("pos").alias("rows"), weight.alias("pos_weight"))


def sample_weights(
    df: DataFrame,
    label: str = "label",
    mode: str = "class_balanced",
    power: float = 0.5,
    boost_classes: list[int] | None = None,
    boost_factor: float = 1.0,
    num_classes: int = NUM_CLASSES,
) -> DataFrame:
    """Add weight per sample: class count^-power, with listed classes multiplied in ``class_boost`` mode."""
    counts = _count_array(df, label, num_classes).scalar()
    base = F.pow(F.greatest(F.get(counts, F.col(label)), F.lit(1)).cast("double"), F.lit(-float(power)))
    if mode == "class_boost":
        base = base if power > 0 else F.lit(1.0)
        if boost_classes and boost_factor > 1:
            base = F.when(F.col(label).isin(boost_classes), base * float(boost_factor)).otherwise(base)
    return df.withColumn("weight", base)
