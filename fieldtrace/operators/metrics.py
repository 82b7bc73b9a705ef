"""Confusion matrices, per-class scores, summary scores and losses over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions.scalar import array_sum, log_softmax
from fieldtrace.schema import NUM_CLASSES, class_dim, class_pairs


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def add_correct(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    return df.withColumn("correct", F.col(y_true) == F.col(y_pred))


def pair_counts(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Rows per (y_true, y_pred) that occurs: the one pass over the data that every score below is built on."""
    return df.groupBy(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def confusion_matrix(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Dense (y_true, y_pred, rows) over all class pairs."""
    grid = class_pairs(df.sparkSession)
    cells = F.broadcast(grid).join(pair_counts(df, y_true, y_pred), ["y_true", "y_pred"], "left")
    return cells.select("y_true", "y_pred", F.coalesce("rows", F.lit(0)).alias("rows"))


def confusion_wide(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """One row per true class, one column per predicted class."""
    cells = confusion_matrix(df, y_true, y_pred)
    return cells.groupBy("y_true").pivot("y_pred", list(range(NUM_CLASSES))).agg(F.sum("rows")).withColumnsRenamed(
        {str(c): f"pred_{c}" for c in range(NUM_CLASSES)}
    )


def normalised_confusion(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Confusion cells as shares of their true class; an empty class stays 0."""
    of_class = Window.partitionBy("y_true")
    share = F.col("rows") / F.greatest(F.sum("rows").over(of_class), F.lit(1))
    return confusion_matrix(df, y_true, y_pred).select("y_true", "y_pred", share.alias("share"))


def label_union(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Labels that occur as truth or as prediction."""
    both = F.explode(F.array("y_true", "y_pred")).alias("class_id")
    return pair_counts(df, y_true, y_pred).select(both).distinct()


def per_class_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """precision, recall, f1, support (and predicted count) of every class, 0 where undefined."""
    own, hit = F.col("rows"), F.when(F.col("y_true") == F.col("y_pred"), F.col("rows")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("y_true").alias("class_id"), own.alias("support"), zero.alias("predicted"), hit.alias("hits")),
        F.struct(F.col("y_pred").alias("class_id"), zero.alias("support"), own.alias("predicted"), zero.alias("hits")),
    )
    sums = (
        pair_counts(df, y_true, y_pred)
        .select(F.inline(sides))
        .groupBy("class_id")
        .agg(*(F.sum(c).alias(c) for c in ("support", "predicted", "hits")))
    )
    dim = class_dim(df.sparkSession).select("class_id")
    table = F.broadcast(dim).join(sums, "class_id", "left").fillna(0, ["support", "predicted", "hits"])
    return table.select(
        "class_id",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "predicted",
    )


def per_class_recall(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    return per_class_metrics(df, y_true, y_pred).select("class_id", "recall")


def f1_scores(per_class: DataFrame) -> DataFrame:
    """macro_f1 over classes that occur as truth or prediction, weighted_f1 by support; 0.0 on no rows."""
    present = F.col("support") + F.col("predicted") > 0
    return per_class.agg(
        F.coalesce(F.avg(F.when(present, F.col("f1"))), F.lit(0.0)).alias("macro_f1"),
        F.coalesce(_ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)).alias("weighted_f1"),
    )


def accuracy(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Share of correct rows; 0.0 on no rows."""
    hits = F.avg((F.col(y_true) == F.col(y_pred)).cast("double"))
    return df.agg(F.coalesce(hits, F.lit(0.0)).alias("accuracy"))


def accuracy_raw_and_smoothed(df: DataFrame, y_true: str, raw: str, smoothed: str) -> DataFrame:
    """Accuracy of the plain and of the smoothed predictions, side by side."""
    def share(c: str) -> Column:
        return F.coalesce(F.avg((F.col(y_true) == F.col(c)).cast("double")), F.lit(0.0))

    return df.agg(share(raw).alias("accuracy_raw"), share(smoothed).alias("accuracy_smoothed"))


def scores_from_table(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """accuracy, macro_f1 and weighted_f1 recomputed from published per-class tables (recall, f1, support)."""
    total = F.sum("support")
    return metrics.groupBy(*(by or [])).agg(
        (F.sum(F.col("recall") * F.col("support")) / total).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1"),
    )


# Losses over a table with a logits array and the true class.


def target_row(label: Column, k: int, smoothing: float) -> Column:
    """One-hot row of length k, blended with the uniform distribution."""
    classes = F.sequence(F.lit(0), F.lit(k - 1))
    hit = 1.0 - smoothing + smoothing / k
    return F.transform(classes, lambda c: F.when(c == label, hit).otherwise(smoothing / k))


def _with_losses(df: DataFrame, logits: str, label: str, weights: DataFrame | None, k: int, smoothing: float):
    table = df.withColumns(
        {"_lp": log_softmax(F.col(logits)), "_t": target_row(F.col(label), k, smoothing), "_y": F.col(label)}
    )
    if weights is None:
        return table.withColumn("_w", F.array_repeat(F.lit(1.0), k))
    ordered = F.array_sort(F.collect_list(F.struct("class_id", "weight")))
    constant = weights.agg(F.transform(ordered, lambda s: s["weight"]).alias("w")).scalar()
    return table.withColumn("_w", constant)


def weighted_ce(
    df: DataFrame,
    logits: str = "logits",
    label: str = "label",
    weights: DataFrame | None = None,
    smoothing: float = 0.0,
    k: int = NUM_CLASSES,
) -> DataFrame:
    """Weighted cross-entropy over all rows: the sum of weighted losses over the sum of target weights."""
    t = _with_losses(df, logits, label, weights, k, smoothing)
    per_class = F.zip_with(F.col("_t"), F.col("_w"), lambda t, w: t * w)
    loss = -array_sum(F.zip_with(per_class, F.col("_lp"), lambda tw, lp: tw * lp))
    return t.agg((F.sum(loss) / F.sum(F.get("_w", F.col("_y")))).alias("loss"))


def focal_loss(
    df: DataFrame,
    logits: str = "logits",
    label: str = "label",
    weights: DataFrame | None = None,
    gamma: float = 2.0,
    smoothing: float = 0.0,
    k: int = NUM_CLASSES,
) -> DataFrame:
    """Mean focal loss; class-balanced when ``weights`` come from ``effective_number_weights``."""
    t = _with_losses(df, logits, label, weights, k, smoothing)
    per_class = F.zip_with(F.col("_t"), F.col("_w"), lambda t, w: t * w)
    focal = F.transform("_lp", lambda lp: F.pow(1.0 - F.exp(lp), F.lit(float(gamma))) * lp)
    return t.agg(F.avg(-array_sum(F.zip_with(per_class, focal, lambda tw, f: tw * f))).alias("loss"))


def aux_bce(
    df: DataFrame, classes: list[int], logits: str, label: str, pos_weights: DataFrame
) -> DataFrame:
    """Mean one-vs-rest binary cross-entropy over rows and listed classes, positives weighted."""
    ordered = F.array_sort(F.collect_list(F.struct("class_id", "pos_weight")))
    constant = pos_weights.agg(F.transform(ordered, lambda s: s["pos_weight"]).alias("w")).scalar()
    t = df.withColumn("_pw", constant)
    losses = []
    for i, c in enumerate(sorted(classes)):
        x = F.get(F.col(logits), F.lit(i))
        soft_neg = F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))
        soft_pos = F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))
        losses.append(F.when(F.col(label) == c, F.get("_pw", F.lit(i)) * soft_neg).otherwise(soft_pos))
    total = losses[0]
    for one in losses[1:]:
        total = total + one
    return t.agg(F.avg(total / len(losses)).alias("loss"))
