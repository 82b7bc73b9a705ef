"""Behaviour durations per class and the window/stride they suggest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.functions.scalar import clip
from fieldtrace.schema import class_dim

# The percentiles of the published report.
PERCENTILES = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95}


def duration_summary(runs: DataFrame, class_id: str = "class_id", duration: str = "duration_seconds") -> DataFrame:
    """Exact duration statistics of every class; classes without runs get zeros.

    The percentile aggregate keeps one count per distinct duration, which is small for whole seconds.
    """
    at = F.array(*map(F.lit, PERCENTILES.values()))
    stats = runs.groupBy(F.col(class_id).alias("class_id")).agg(
        F.count(F.lit(1)).alias("segment_count"),
        F.sum(duration).alias("total_seconds"),
        F.min(duration).cast("double").alias("min"),
        F.percentile(duration, at).alias("_p"),
        F.avg(duration).alias("mean"),
        F.max(duration).cast("double").alias("max"),
    )
    stats = stats.withColumns({name: F.get("_p", F.lit(i)) for i, name in enumerate(PERCENTILES)})
    dim = class_dim(runs.sparkSession).select("class_id", "class_name")
    names = ["segment_count", "total_seconds", "min", "p10", "p25", "median", "mean", "p75", "p90", "p95", "max"]
    filled = [F.coalesce(F.col(n), F.lit(0).cast("bigint" if i < 2 else "double")).alias(n) for i, n in enumerate(names)]
    return F.broadcast(dim).join(stats, "class_id", "left").select("class_id", "class_name", *filled)


def recommend_sampling(
    summary: DataFrame,
    context_scale: float = 2.0,
    stride_ratio: float = 0.25,
    min_window: int = 16,
    max_window: int = 512,
    min_stride: int = 1,
    max_stride: int = 20,
) -> DataFrame:
    """Add recommended_window and recommended_stride from p75 and median."""
    one = F.lit(1.0)
    window = F.ceil(F.greatest(F.col("p75") * context_scale, F.col("median"), one))
    stride = F.ceil(F.greatest(F.col("median"), one) * stride_ratio)
    return summary.withColumns(
        {
            "recommended_window": clip(window, min_window, max_window).cast("int"),
            "recommended_stride": clip(stride, min_stride, max_stride).cast("int"),
        }
    )


def duration_config(recommended: DataFrame) -> DataFrame:
    """The sampling configuration: class -> window, stride, median_duration, p75_duration, segment_count."""
    return recommended.select(
        "class_id",
        F.col("recommended_window").alias("window"),
        F.col("recommended_stride").alias("stride"),
        F.col("median").alias("median_duration"),
        F.col("p75").alias("p75_duration"),
        "segment_count",
    )
