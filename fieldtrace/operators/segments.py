"""Gap-free segments, exact-step islands and same-label runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.functions.coerce import epoch_micros
from fieldtrace.operators.ordered import Order, chunked, islands, own_rows
from fieldtrace.schema import class_dim


def second_step(order: Order) -> Column:
    return F.col(order.second) - F.lag(order.second).over(order.window())


def gap_break(order: Order, max_gap: float) -> Column:
    """Seconds or timestamps jump by more than ``max_gap``; equal or falling values do not break."""
    jump = second_step(order) > max_gap
    if order.time is None:
        return jump
    micros = epoch_micros(order.time)
    return jump | (micros - F.lag(micros).over(order.window()) > max_gap * 1e6)


def label_break(order: Order, label: str) -> Column:
    return F.col(label) != F.lag(label).over(order.window())


def segments(df: DataFrame, order: Order, max_gap: float = 1.0) -> DataFrame:
    """Add pos, segment_id, seg_pos (both counted from 0) and is_last of the gap-free segment."""
    rows = islands(chunked(df, order), order, {"segment": gap_break(order, max_gap)})
    rows = rows.withColumns({"seg_pos": F.col("pos") - F.col("segment_start"), "is_last": F.col("segment_last")})
    return own_rows(rows).drop("segment_start", "segment_last")


def row_positions(df: DataFrame, order: Order) -> DataFrame:
    """Add pos, the zero-based place of every row in its entity."""
    return own_rows(islands(chunked(df, order), order, {}))


def segment_bounds(df: DataFrame, order: Order, max_gap: float = 1.0) -> DataFrame:
    """One row per segment: first and last position, first and last second, number of rows."""
    rows = segments(df, order, max_gap)
    return rows.groupBy(order.entity, "segment_id").agg(
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
        F.min(order.second).alias("start_second"),
        F.max(order.second).alias("end_second"),
        F.count(F.lit(1)).alias("rows"),
    )


def step_islands(df: DataFrame, order: Order) -> DataFrame:
    """Add island_id and island_pos of stretches whose seconds rise by exactly one."""
    rows = islands(chunked(df, order), order, {"island": second_step(order) != 1})
    rows = rows.withColumn("island_pos", F.col("pos") - F.col("island_start"))
    return own_rows(rows).drop("island_start", "island_last")


def run_ids(df: DataFrame, order: Order, label: str = "label", max_gap: float = 1) -> DataFrame:
    """Add run_id and run_pos of same-label stretches; a gap in seconds ends a run too."""
    condition = label_break(order, label) | (second_step(order) > max_gap)
    rows = islands(chunked(df, order), order, {"run": condition})
    return own_rows(rows.withColumn("run_pos", F.col("pos") - F.col("run_start"))).drop("run_start", "run_last")


def segment_runs(df: DataFrame, order: Order, label: str = "label", max_gap: float = 1.0) -> DataFrame:
    """Segments and the same-label runs inside them, with places in both and end markers of both."""
    gap = gap_break(order, max_gap)
    flags = {"segment": gap, "run": gap | label_break(order, label)}
    rows = islands(chunked(df, order), order, flags)
    rows = rows.withColumns(
        {"seg_pos": F.col("pos") - F.col("segment_start"), "run_pos": F.col("pos") - F.col("run_start")}
    )
    return own_rows(rows).drop("segment_start", "run_start")


def behaviour_runs(df: DataFrame, order: Order, label: str = "label", max_gap: float = 1) -> DataFrame:
    """One row per same-label run: bounds, rows and duration (never shorter than the row count)."""
    rows = run_ids(df, order, label, max_gap)
    runs = rows.groupBy(order.entity, "run_id").agg(
        F.min(label).alias("class_id"),
        F.min(order.second).alias("start_second"),
        F.max(order.second).alias("end_second"),
        F.min_by(order.time, "pos").alias("start_time"),
        F.max_by(order.time, "pos").alias("end_time"),
        F.count(F.lit(1)).alias("rows"),
    )
    span = F.col("end_second") - F.col("start_second") + 1
    return runs.withColumn("duration_seconds", F.greatest(span, F.col("rows")))


def with_class_name(df: DataFrame, class_id: str = "class_id") -> DataFrame:
    """Add class_name; ids outside the class dimension keep their number as text."""
    dim = class_dim(df.sparkSession).select(F.col("class_id").alias(class_id), "class_name")
    named = df.join(F.broadcast(dim), class_id, "left")
    return named.withColumn("class_name", F.coalesce("class_name", F.col(class_id).cast("string")))
