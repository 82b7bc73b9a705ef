"""From predictions to smoothed labels, scores and model comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fieldtrace.operators import metrics as M
from fieldtrace.operators import reports as R
from fieldtrace.operators.ordered import Order
from fieldtrace.operators.smoothing import smooth_runs


def evaluated(
    predictions: DataFrame, order: Order, smooth_classes: list[int] | None = None, min_duration: int = 5
) -> DataFrame:
    """Predictions (y_true, y_pred_raw) with the smoothed y_pred and whether it is right."""
    rows = smooth_runs(predictions, order, "y_pred_raw", smooth_classes, min_duration)
    return M.add_correct(rows.withColumnRenamed("smoothed", "y_pred")).drop("pos", "run_id", "run_pos")


def report(rows: DataFrame) -> dict[str, DataFrame]:
    """Score tables by name. The published accuracy is the raw one, all other scores use smoothed labels."""
    per_class = M.per_class_metrics(rows)
    return {
        "accuracy": M.accuracy_raw_and_smoothed(rows, "y_true", "y_pred_raw", "y_pred"),
        "f1": M.f1_scores(per_class),
        "per_class": per_class,
        "confusion": M.confusion_matrix(rows),
        "confusion_shares": M.normalised_confusion(rows),
    }


def comparison(per_class: dict[str, DataFrame], fused: str, base: str, singles: list[str]) -> DataFrame:
    """Class by model f1 with the fused model's gain over the best single model and over ``base``."""
    pivot = R.f1_pivot(R.union_models(per_class), list(per_class))
    return R.fusion_delta(R.best_single_gain(pivot, fused, singles), fused, base)
