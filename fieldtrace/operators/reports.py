"""Model comparison tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrace.schema import class_dim

TOP_REDUCTIONS = 8

SPLIT_METRICS = T.StructType([T.StructField(m, T.DoubleType()) for m in ("loss", "acc", "macro_f1", "weighted_f1")])
HISTORY = T.ArrayType(
    T.StructType(
        [
            T.StructField("epoch", T.IntegerType()),
            T.StructField("train", SPLIT_METRICS),
            T.StructField("val", SPLIT_METRICS),
        ]
    )
)


def metrics_long(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """One row per (ids, metric)."""
    return df.unpivot(ids, metrics, "metric", "score")


def scale_percent(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c) * 100.0 for c in columns})


def union_models(tables: dict[str, DataFrame]) -> DataFrame:
    """Per-class tables of several models under each other, with the model's name and the short class name."""
    tagged = [df.withColumn("model", F.lit(name)) for name, df in tables.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    dim = class_dim(out.sparkSession).select("class_id", F.col("short_name").alias("class"))
    return out.join(F.broadcast(dim), "class_id", "left").withColumn(
        "class", F.coalesce("class", F.col("class_id").cast("string"))
    )


def f1_pivot(per_class: DataFrame, models: list[str]) -> DataFrame:
    """Class by model table of f1 in percent."""
    return per_class.groupBy("class_id").pivot("model", models).agg(F.first("f1") * 100.0)


def best_single_gain(pivot: DataFrame, fused: str, singles: list[str]) -> DataFrame:
    """Add best_single and gain: the fused model against the best single one, per class."""
    best: Column = F.greatest(*singles) if len(singles) > 1 else F.col(singles[0])
    return pivot.withColumns({"best_single": best, "gain": F.col(fused) - best})


def fusion_delta(pivot: DataFrame, better: str, base: str) -> DataFrame:
    return pivot.withColumn("delta", F.col(better) - F.col(base))


def compare_confusions(base: DataFrame, better: DataFrame) -> DataFrame:
    """Off-diagonal cells that ``better`` gets wrong less often than ``base``, with the reduction."""
    keys = ["y_true", "y_pred"]
    both = base.withColumnRenamed("rows", "_base").join(better.withColumnRenamed("rows", "_better"), keys)
    cells = both.withColumn("reduction", F.col("_base") - F.col("_better")).drop("_base", "_better")
    return cells.where((F.col("y_true") != F.col("y_pred")) & (F.col("reduction") > 0))


def error_reductions(base: DataFrame, better: DataFrame, top: int = TOP_REDUCTIONS) -> DataFrame:
    """The largest reductions, labelled 'true -> predicted'; ties go to the smaller class ids."""
    dim = class_dim(base.sparkSession)
    cells = compare_confusions(base, better)
    cells = cells.join(F.broadcast(dim.select(F.col("class_id").alias("y_true"), F.col("short_name").alias("_a"))), "y_true")
    cells = cells.join(F.broadcast(dim.select(F.col("class_id").alias("y_pred"), F.col("short_name").alias("_b"))), "y_pred")
    ranked = cells.orderBy(F.desc("reduction"), "y_true", "y_pred").limit(top)
    return ranked.select(F.concat_ws(" -> ", "_a", "_b").alias("pair"), "reduction", "y_true", "y_pred")


def epoch_metrics(history: DataFrame, column: str = "history") -> DataFrame:
    """Training history as JSON text -> one row per epoch with train_* and val_* columns."""
    rows = history.select(F.inline(F.from_json(column, HISTORY)))
    flat = [F.col(f"{s}.{m}").alias(f"{s}_{m}") for s in ("train", "val") for m in SPLIT_METRICS.names]
    return rows.select("epoch", *flat)


def diagnostic_summary(predictions: DataFrame, date: str = "date", y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """rows, accuracy and errors per date."""
    hit = (F.col(y_true) == F.col(y_pred)).cast("double")
    return predictions.groupBy(date).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(hit).alias("accuracy"),
        F.count_if(F.col(y_true) != F.col(y_pred)).alias("errors"),
    )
