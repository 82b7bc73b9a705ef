"""Minimum-duration smoothing of predicted labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.operators.ordered import Order
from fieldtrace.operators.segments import run_ids

# Runs of an entity that one task looks at; neighbours across a cut are copied over.
RUNS_PER_CHUNK = 1_000_000

# Positions that share a key when replaced runs are joined onto the rows.
BLOCK = 4096


def run_neighbours(runs: DataFrame, order: Order, per_chunk: int = RUNS_PER_CHUNK) -> DataFrame:
    """Add left and right: (rows, pred) of the run before and after, NULL at the ends of the entity.

    ``run_id`` counts up by one within an entity, so runs are cut by it and each edge run is copied across.
    """
    home = F.floor(F.col("run_id") / per_chunk)
    place = F.col("run_id") % per_chunk
    onward = F.when(place == per_chunk - 1, home + 1)
    backward = F.when((place == 0) & (home > 0), home - 1)
    spread = runs.withColumn("_part", F.explode(F.array_compact(F.array(home, onward, backward))))
    w = Window.partitionBy(order.entity, "_part").orderBy("run_id")
    me = F.struct("rows", "pred")
    spread = spread.withColumns({"left": F.lag(me).over(w), "right": F.lead(me).over(w)})
    return spread.where(F.col("_part") == home).drop("_part")


def replacement() -> Column:
    """Both neighbours agree: their label. Otherwise the neighbour with more rows, the larger label on ties."""
    left, right = F.col("left"), F.col("right")
    return F.when(left["pred"] == right["pred"], left["pred"]).otherwise(F.greatest(left, right)["pred"])


def smooth_runs(
    df: DataFrame,
    order: Order,
    pred: str = "pred",
    classes: list[int] | None = None,
    min_duration: int = 5,
    max_gap: float = 1,
    per_chunk: int = RUNS_PER_CHUNK,
) -> DataFrame:
    """Add smoothed: ``pred``, with short runs of the listed classes replaced by a neighbouring run's label.

    Every replacement looks at the original runs. Replaced runs come back once for each block of positions they touch,
    so the join onto the rows is on keys of at most ``BLOCK`` rows and neither a long run nor one of many rows in few
    seconds piles up in one task or one array.
    """
    rows = run_ids(df, order, pred, max_gap)
    if not classes:
        return rows.withColumn("smoothed", F.col(pred))
    runs = rows.groupBy(order.entity, "run_id").agg(
        F.min(pred).alias("pred"),
        (F.max(order.second) - F.min(order.second) + 1).alias("duration"),
        F.count(F.lit(1)).alias("rows"),
        F.min("pos").alias("_first"),
        F.max("pos").alias("_last"),
    )
    near = run_neighbours(runs, order, per_chunk)
    short = near.where(F.col("pred").isin(classes) & (F.col("duration") < max(int(min_duration), 1)))
    block = lambda pos: F.floor(F.col(pos) / BLOCK)
    changed = short.select(
        F.col(order.entity).alias("_who"),
        F.explode(F.sequence(block("_first"), block("_last"))).alias("_part"),
        "_first",
        "_last",
        F.coalesce(replacement(), F.col("pred")).alias("_new"),
    )
    inside = F.col("pos").between(F.col("_first"), F.col("_last"))
    on = F.col(order.entity).eqNullSafe(F.col("_who")) & (F.col("_block") == F.col("_part")) & inside
    return (
        rows.withColumn("_block", block("pos"))
        .join(changed, on, "left")
        .withColumn("smoothed", F.coalesce("_new", F.col(pred)))
        .drop("_new", "_who", "_part", "_block", "_first", "_last")
    )
