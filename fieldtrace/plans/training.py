"""From a cleaned dataset to normalised training samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from fieldtrace.operators import anchors as A
from fieldtrace.operators import durations as D
from fieldtrace.operators import stats as N
from fieldtrace.operators.features import segment_features
from fieldtrace.operators.ordered import Order, with_hot
from fieldtrace.operators.segments import behaviour_runs
from fieldtrace.schema import FEATURE_NAMES
from fieldtrace.sources.writers import settled


@dataclass(frozen=True)
class Sampling:
    """Window and stride settings; adaptive strides apply to training rows only."""

    length: int = 512
    stride: int = 20
    eval_stride: int = 1
    context: str = "causal"
    adaptive: bool = False
    max_gap: float = 1.0
    min_stride: int = 1
    max_stride: int = 20
    stride_ratio: float = 0.25


def counted(rows: DataFrame, order: Order) -> tuple[DataFrame, Order]:
    """The rows written once and their hot entities counted once, for all the steps below."""
    rows = settled(rows)
    return rows, with_hot(rows, order)


def duration_report(rows: DataFrame, order: Order, max_gap: float = 1, **limits) -> DataFrame:
    """Duration statistics and recommended window and stride of every class."""
    return D.recommend_sampling(D.duration_summary(behaviour_runs(rows, order, "label", max_gap)), **limits)


def feature_rows(rows: DataFrame, order: Order, s: Sampling) -> DataFrame:
    return segment_features(rows, order, s.max_gap)


def training_stats(features: DataFrame, order: Order, s: Sampling, config: DataFrame | None = None) -> DataFrame:
    """Normalisation statistics over the slots of the training windows that ``samples`` builds."""
    weighted = A.slot_weights(
        features, order, s.length, s.max_gap, s.stride, s.context,
        adaptive=s.adaptive, config=config, ratio=s.stride_ratio, low=s.min_stride, high=s.max_stride,
    )
    return N.feature_stats(weighted, FEATURE_NAMES, "slot_weight")


def samples(
    features: DataFrame, stats: DataFrame, order: Order, s: Sampling, train: bool, config: DataFrame | None = None
) -> DataFrame:
    """Windows of normalised features around the anchors; ``stats`` always come from the training rows."""
    stride = s.stride if train or s.eval_stride <= 0 else s.eval_stride
    return A.build_windows(
        N.normalise(features, stats, FEATURE_NAMES),
        order,
        s.length,
        FEATURE_NAMES,
        s.context,
        s.max_gap,
        stride,
        adaptive=train and s.adaptive,
        config=config,
        ratio=s.stride_ratio,
        low=s.min_stride,
        high=s.max_stride,
    )
