"""Anchors (the rows that get a sample), the windows around them, and how often a row appears in windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions.scalar import clip
from fieldtrace.operators.ordered import Order, chunked, deal, islands, match, own_rows
from fieldtrace.operators.segments import gap_break, label_break, second_step, segment_runs, segments
from fieldtrace.sources.writers import settled


def on_stride(place: str, stride, last: str) -> Column:
    """Every stride-th row counted from ``place`` = 0, and the last row even when it is off the stride."""
    stride = stride if isinstance(stride, Column) else F.lit(max(int(stride), 1))
    return (F.col(place) % stride == 0) | F.col(last)


def fixed_anchors(df: DataFrame, order: Order, max_gap: float = 1.0, stride: int = 20) -> DataFrame:
    """Anchor rows of every gap-free segment, with pos, segment_id, seg_pos and is_last."""
    return segments(df, order, max_gap).where(on_stride("seg_pos", stride, "is_last"))


def inferred_stride(
    df: DataFrame,
    order: Order,
    label: str = "label",
    max_gap: float = 1.0,
    ratio: float = 0.25,
    low: int = 1,
    high: int = 20,
) -> DataFrame:
    """Stride per (entity, segment, class): the class's median run length there times ``ratio``, clipped."""
    return strides_of(segment_runs(df, order, label, max_gap), order, label, ratio, low, high)


def strides_of(rows: DataFrame, order: Order, label: str, ratio: float, low: int, high: int) -> DataFrame:
    """``inferred_stride`` of rows that have their segment_id and run_id."""
    runs = rows.groupBy(order.entity, "segment_id", "run_id")
    lengths = runs.agg(
        F.min(label).alias(label), (F.max(order.second) - F.min(order.second) + 1).alias("duration")
    )
    typical = lengths.groupBy(order.entity, "segment_id", label).agg(
        F.percentile("duration", F.lit(0.5)).alias("median_duration")
    )
    stride = F.ceil(F.greatest("median_duration", F.lit(1.0)) * ratio)
    return typical.withColumn("stride", clip(stride, low, high).cast("int"))


def with_stride(
    rows: DataFrame,
    keys: list[str],
    label: str,
    inferred: DataFrame | None,
    config: DataFrame | None,
    default: int,
    low: int,
    high: int,
) -> DataFrame:
    """Add stride: the configured one of the class, else the inferred one, else ``default``.

    ``config`` has a row per class and is broadcast. ``inferred`` is as long as there are (segment, class)
    pairs and is written first: with a plain exchange on both sides, adaptive skew handling can split that join when
    one class of one segment holds much of the data.
    """
    choices = []
    if config is not None:
        chosen = clip(F.coalesce("stride", F.lit(default)), low, high).cast("int")
        table = config.select(F.col("class_id").alias(label), chosen.alias("_configured"))
        rows = rows.join(F.broadcast(table), label, "left")
        choices.append(F.col("_configured"))
    if inferred is not None:
        table = settled(inferred.select(*keys, "segment_id", label, F.col("stride").alias("_inferred")))
        rows = match(rows, table, [*keys, "segment_id", label], "left")
        choices.append(F.col("_inferred"))
    return rows.withColumn("stride", F.coalesce(*choices, F.lit(default))).drop("_configured", "_inferred")


def adaptive_anchors(
    df: DataFrame,
    order: Order,
    label: str = "label",
    max_gap: float = 1.0,
    config: DataFrame | None = None,
    default_stride: int = 20,
    ratio: float = 0.25,
    low: int = 1,
    high: int = 20,
) -> DataFrame:
    """Anchors per same-label run inside a segment, on the stride of the run's class, plus the run's last row.

    Segments and runs are found once and written: the strides come from the rows that they are joined to.
    """
    rows = settled(segment_runs(df, order, label, max_gap))
    inferred = strides_of(rows, order, label, ratio, low, high)
    rows = with_stride(rows, [order.entity], label, inferred, config, default_stride, low, high)
    return rows.where(on_stride("run_pos", F.col("stride"), "run_last"))


def window_rows(
    df: DataFrame,
    order: Order,
    length: int,
    max_gap: float,
    stride: int,
    adaptive: bool,
    label: str,
    config: DataFrame | None,
    ratio: float,
    low: int,
    high: int,
    dealt: bool = False,
) -> DataFrame:
    """Chunked rows with seg_pos and is_anchor, as windows and their statistics both need them.

    Anchors are every ``stride``-th row of a segment, or, with ``adaptive``, of a same-label run on its class's stride.
    With ``dealt`` the number of tasks follows the number of rows.
    """
    reach = length + 1
    gap = gap_break(order, max_gap)
    flags = {"segment": gap, "run": gap | label_break(order, label)} if adaptive else {"segment": gap}
    chunks = chunked(df, order, reach, reach)
    if dealt:
        chunks = deal(chunks, order, df.count())
    rows = islands(chunks, order, flags, reach, reach)
    rows = rows.withColumn("seg_pos", F.col("pos") - F.col("segment_start"))
    if not adaptive:
        return rows.withColumn("is_anchor", on_stride("seg_pos", stride, "segment_last"))
    rows = settled(rows)
    inferred = strides_of(rows.where("_own"), order, label, ratio, low, high)
    rows = with_stride(rows, [order.entity], label, inferred, config, stride, low, high)
    rows = rows.withColumn("_place", F.col("pos") - F.col("run_start"))
    rows = rows.withColumn("is_anchor", on_stride("_place", F.col("stride"), "run_last"))
    return rows.drop("stride", "_place", "run_id", "run_start", "run_last")


def window_reach(length: int, context: str) -> tuple[int, int]:
    """Rows before and after the anchor in a window: all before (causal) or about half and half (centered)."""
    if context == "causal":
        return length - 1, 0
    return length // 2, length - length // 2 - 1


def build_windows(
    df: DataFrame,
    order: Order,
    length: int,
    payload: list[str],
    context: str = "causal",
    max_gap: float = 1.0,
    stride: int = 20,
    adaptive: bool = False,
    label: str = "label",
    config: DataFrame | None = None,
    ratio: float = 0.25,
    low: int = 1,
    high: int = 20,
) -> DataFrame:
    """One row per anchor with ``window``: an array of ``length`` structs of ``payload``, edges repeated."""
    back, ahead = window_reach(length, context)
    rows = window_rows(df, order, length, max_gap, stride, adaptive, label, config, ratio, low, high)

    meta = [c for c in [*order.by, label] if c in df.columns]
    out = gathered(rows, order, "segment_id", [*meta, "pos", "seg_pos"], payload, length, back, ahead)
    return out.select(order.entity, *meta, "pos", "segment_id", "seg_pos", F.lit(back).alias("anchor_slot"), "window")


def gathered(
    rows: DataFrame, order: Order, part: str, meta: list[str], payload: list[str], length: int, back: int, ahead: int
) -> DataFrame:
    """One row per own row with is_anchor: entity, ``part``, ``meta`` and window, the rows around it inside its part.

    Rows are gathered once into blocks of ``length``; an anchor's window is a slice of its own block and the
    neighbouring ones, made where the block is, so that no anchor carries a block. Neighbours hold ``payload`` only.
    """
    at = F.row_number().over(order.window(part)) - 1
    rows = rows.select(
        order.entity,
        "_chunk",
        part,
        at.alias("_at"),
        F.struct(
            at.alias("_at"),
            (F.col("_own") & F.col("is_anchor")).alias("_anchor"),
            F.struct(*meta).alias("meta"),
            F.struct(*payload).alias("data"),
        ).alias("row"),
    )
    block = [order.entity, "_chunk", part]
    blocks = (
        rows.withColumn("_block", F.floor(F.col("_at") / length))
        .groupBy(*block, "_block")
        .agg(F.sort_array(F.collect_list("row")).alias("rows"))
    )
    near = Window.partitionBy(*block).orderBy("_block")
    blocks = blocks.select(*block, "_block", F.transform("rows", lambda r: r["data"]).alias("_data"), "rows")
    none = F.slice("_data", 1, 0)
    blocks = blocks.select(
        *block,
        "rows",
        F.coalesce(F.lag("_data").over(near), none).alias("_prev"),
        "_data",
        (F.coalesce(F.lead("_data").over(near), none) if ahead else none).alias("_next"),
    )
    blocks = blocks.select(*block, "rows", F.size("_prev").alias("_skip"), F.concat("_prev", "_data", "_next").alias("_all"))
    size = F.size("_all")

    def cut(row: Column, i: Column) -> Column:
        place = i + F.col("_skip")
        first, last = F.greatest(place - back, F.lit(0)), F.least(place + ahead, size - 1)
        window = F.concat(
            F.array_repeat(F.get("_all", F.lit(0)), F.greatest(back - place, F.lit(0))),
            F.slice("_all", first + 1, last - first + 1),
            F.array_repeat(F.get("_all", size - 1), F.greatest(place + ahead - size + 1, F.lit(0))),
        )
        return F.when(row["_anchor"], F.struct(row["meta"].alias("meta"), window.alias("window")))

    anchors = blocks.select(*block, F.explode(F.filter(F.transform("rows", cut), lambda x: x.isNotNull())).alias("row"))
    return anchors.select(order.entity, part, "row.meta.*", "row.window")


def consecutive_windows(
    df: DataFrame, order: Order, length: int, payload: list[str], label: str = "label"
) -> DataFrame:
    """Every window of ``length`` rows whose seconds rise by exactly one, keyed by its last row.

    The window's label is the one of its middle slot (``length // 2``).
    """
    chunks = chunked(df, order, before=length, after=1)
    rows = islands(chunks, order, {"island": second_step(order) != 1}, before=length, after=1)
    rows = rows.withColumn("island_pos", F.col("pos") - F.col("island_start"))
    rows = rows.withColumn("is_anchor", F.col("island_pos") >= length - 1).withColumn("_label", F.col(label))
    meta = [*order.by, "pos", "island_pos"]
    out = gathered(rows, order, "island_id", meta, [*payload, "_label"], length, length - 1, 0)
    values = F.transform("window", lambda r: F.struct(*(r[c].alias(c) for c in payload)))
    middle = F.get("window", F.lit(length // 2))["_label"]
    return out.select(*order.keys, "pos", "island_id", "island_pos", middle.alias("window_label"), values.alias("window"))


def slot_weights(
    df: DataFrame,
    order: Order,
    length: int,
    max_gap: float = 1.0,
    stride: int = 20,
    context: str = "causal",
    adaptive: bool = False,
    label: str = "label",
    config: DataFrame | None = None,
    ratio: float = 0.25,
    low: int = 1,
    high: int = 20,
) -> DataFrame:
    """Add slot_weight: how many slots of the anchors' windows (see ``build_windows``) the row fills, edge repeats included.

    Counted from running anchor totals, so nothing is exploded and the cost does not grow with ``length``.
    """
    back, ahead = window_reach(length, context)
    rows = window_rows(df, order, length, max_gap, stride, adaptive, label, config, ratio, low, high)
    ws = order.window("segment_id")
    whole = Window.partitionBy(order.entity, "_chunk", "segment_id")
    rows = rows.withColumn("_seen", F.count(F.when(F.col("is_anchor"), 1)).over(ws.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns(
        {
            "_all_seen": F.max("_seen").over(whole),
            "_end": F.max("seg_pos").over(whole),
        }
    )
    upto = F.coalesce(F.lead("_seen", back).over(ws), F.col("_all_seen"))
    earlier = F.coalesce(F.lag("_seen", ahead + 1).over(ws), F.lit(0))
    left = F.sum(F.when(F.col("is_anchor"), F.greatest(back - F.col("seg_pos"), F.lit(0)))).over(whole)
    right = F.sum(F.when(F.col("is_anchor"), F.greatest(F.col("seg_pos") + ahead - F.col("_end"), F.lit(0)))).over(whole)
    weight = upto - earlier
    weight += F.when(F.col("seg_pos") == 0, F.coalesce(left, F.lit(0))).otherwise(0)
    weight += F.when(F.col("segment_last"), F.coalesce(right, F.lit(0))).otherwise(0)
    rows = own_rows(rows.withColumn("slot_weight", weight.cast("bigint")))
    return rows.drop("_seen", "_all_seen", "_end", "segment_start", "segment_last")
