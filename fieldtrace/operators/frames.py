"""Choosing the frames of a sample from its window, and pooling frame vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions.scalar import clip, linspace, pad_left
from fieldtrace.operators.anchors import window_reach, window_rows
from fieldtrace.operators.ordered import Order


def slots_causal(anchor_slot: Column, k: int) -> Column:
    """The last k slots up to the anchor; the earliest is repeated in front when there are fewer."""
    first = F.greatest(anchor_slot - k + 1, F.lit(0))
    return pad_left(F.sequence(first, anchor_slot), k)


def slots_uniform(length: Column, k: int) -> Column:
    """k evenly spaced slots over the window, rounded half to even."""
    places = linspace(F.lit(0), length - 1, k)
    return F.transform(places, lambda p: F.bround(p).cast("int"))


def slots_center(seconds: Column, center: Column, radius: Column, k: int) -> Column:
    """For k target seconds around ``center`` the slot nearest in time, the first one on ties.

    The seconds of a window rise, so the nearest is the last one before the target or the first one from it on.
    """
    offsets = linspace(-radius, radius, k)

    def nearest(target: Column) -> Column:
        below = F.size(F.filter(seconds, lambda s: F.coalesce(s < target, F.lit(True))))
        before, after = F.get(seconds, below - 1), F.get(seconds, below)
        first = F.coalesce(target - before <= after - target, after.isNull())
        return F.when(first, F.greatest(F.array_position(seconds, before).cast("int") - 1, F.lit(0))).otherwise(below)

    targets = F.transform(offsets, lambda o: center + F.bround(o).cast("bigint"))
    return F.transform(targets, nearest)


def slot_single(anchor_slot: Column) -> Column:
    return F.array(anchor_slot)


def select_frames(
    samples: DataFrame, mode: str, k: int, radius: Column | None = None, window: str = "window", second: str = "second"
) -> DataFrame:
    """Add frame_slots, zero-based window slots chosen by ``mode``: nearest_causal, uniform or center.

    With k <= 1 it is the anchor's slot whatever the mode. ``samples`` comes from ``build_windows`` with
    ``second`` in its payload.
    """
    anchor = F.col("anchor_slot")
    if k <= 1:
        slots = slot_single(anchor)
    elif mode == "nearest_causal":
        slots = slots_causal(anchor, k)
    elif mode == "uniform":
        slots = slots_uniform(F.size(window), k)
    else:
        samples = samples.withColumn("_seconds", F.transform(window, lambda r: r[second]))
        slots = slots_center(F.col("_seconds"), F.col(second), F.lit(8) if radius is None else radius, k)
    return samples.withColumn("frame_slots", slots).drop("_seconds")


def frames_at(samples: DataFrame, column: str, window: str = "window") -> DataFrame:
    """Add frames: the window's ``column`` values at frame_slots."""
    return samples.withColumn("frames", F.transform("frame_slots", lambda i: F.get(F.col(window), i)[column]))


def with_radius(
    df: DataFrame, config: DataFrame, radius: int, scale: float, classes: list[int] | None = None, label: str = "label"
) -> DataFrame:
    """Add radius per class: half-even p75 * scale within [1, 4 * radius], or the fixed one for unlisted classes.

    A class missing from ``config`` falls back to its median, then to twice the fixed radius.
    """
    length = F.coalesce("p75_duration", "median_duration", F.lit(float(radius * 2)))
    scaled = clip(F.bround(length * float(scale)), 1, max(radius * 4, 1)).cast("int")
    table = config.select(F.col("class_id").alias(label), "p75_duration", "median_duration")
    joined = df.join(F.broadcast(table), label, "left")
    if classes:
        scaled = F.when(F.col(label).isin(classes), scaled).otherwise(F.lit(int(radius)))
    return joined.withColumn("radius", scaled).drop("p75_duration", "median_duration")


def uniform_hash(seed: int, *keys) -> Column:
    """A reproducible number in [0, 1) from a seed and key columns: twelve digits of an MD5 hash."""
    text = F.concat_ws("#", *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(16**12)


def frame_dropout(
    samples: DataFrame, p: float, keys: list[str], seed: int = 42, causal: bool = True, frames: str = "frames"
) -> DataFrame:
    """Replace random frames of a clip by its reference frame (last if causal, else the middle one).

    Never all of them: when every frame is drawn, one is spared. Single-frame clips stay as they are.
    """
    p = max(0.0, min(float(p), 0.95))
    size = F.size(frames)
    draws = F.transform(F.col(frames), lambda _, i: uniform_hash(seed, *keys, i) < p)
    spared = F.floor(uniform_hash(seed + 1, *keys) * size).cast("int")
    everything = F.forall("_drop", lambda d: d)
    reference = F.get(F.col(frames), size - 1 if causal else F.floor(size / 2).cast("int"))
    replaced = F.transform(
        F.col(frames),
        lambda f, i: F.when(F.get("_drop", i) & ~(F.col("_all") & (i == F.col("_spared"))), reference).otherwise(f),
    )
    rows = samples.withColumns({"_drop": draws, "_spared": spared})
    rows = rows.withColumn("_all", everything)
    return rows.withColumn(frames, F.when(size > 1, replaced).otherwise(F.col(frames))).drop("_drop", "_all", "_spared")


def nearest_row_join(
    df: DataFrame, order: Order, length: int, columns: list[str], k: int, radius: Column, context: str = "centered", **cut
) -> DataFrame:
    """One row per anchor and target second around it, with ``columns`` of the nearest row in the anchor's window.

    Anchors and windows are those of ``build_windows`` with the same arguments (``cut``: max_gap, stride and so on), but no
    window is built: targets are sorted among the rows of their segment, and each takes the last row at or before it or
    that row's successor, whichever is nearer (the earlier on ties; of rows of one second the first), kept within the
    window. Cost does not grow with ``length``, and rows without a second are nearest only where a window starts with one.
    ``radius`` may differ by row. Adds target (from 0) and nearest_<column>.
    """
    out = _nearest(df, order, length, columns, k, radius, context, **cut)
    meta = [F.col(f"_m{i}").alias(c) for i, c in enumerate(_carried(df, order))]
    return out.select(order.entity, *meta, "target", *(F.col(f"_found.{c}").alias(f"nearest_{c}") for c in columns))


def _nearest(df: DataFrame, order: Order, length: int, columns: list[str], k: int, radius: Column, context: str, **cut) -> DataFrame:
    """``nearest_row_join`` where its windows left the rows: entity, _chunk, segment_id, seg_pos, target, _found and, as _m0,
    _m1 and so on, ``order.by`` and the other columns: apart from each other, so that those nobody reads are not carried."""
    back, ahead = window_reach(length, context)
    rows = window_rows(df, order, length, **{"max_gap": 1.0, "stride": 20, "adaptive": False, "label": "label", "config": None, "ratio": 0.25, "low": 1, "high": 20, "dealt": True} | cut)
    ws = order.window("segment_id")
    upto = ws.rowsBetween(Window.unboundedPreceding, 0)
    data = F.struct(F.col(order.second).alias("s"), F.col("seg_pos").alias("p"), F.struct(*columns).alias("v"))
    rows = rows.withColumn("_d", data)
    opens = F.lag("_d").over(ws).isNull() | ~F.lag("_d").over(ws)["s"].eqNullSafe(F.col("_d.s"))
    rows = rows.withColumns({"_head": F.last(F.when(opens, F.col("_d")), True).over(upto), "_next": F.lead("_d").over(ws)})
    ends = ws.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.coalesce(F.lag("_d", back).over(ws), F.first("_d").over(upto)) if back else F.col("_d")
    last = F.coalesce(F.lead(F.struct("seg_pos", "_head"), ahead).over(ws), F.last(F.struct("seg_pos", "_head")).over(ends)) if ahead else F.struct("seg_pos", "_head")
    rows = rows.withColumns({"_first": first, "_last": last})
    # Targets join the rows of their segment where these are: the key of the exchange stays, only the order is new.
    targets = F.transform(linspace(-radius, radius, k), lambda o, i: F.struct((F.col(order.second) + F.bround(o).cast("bigint")).alias("at"), i.alias("target")))
    own = F.struct(F.col(order.second).cast("bigint").alias("at"), F.lit(None).cast("int").alias("target"))
    events = F.when(F.col("_own") & F.col("is_anchor"), F.concat(F.array(own), targets)).otherwise(F.array(own))
    part = [order.entity, "_chunk", "segment_id"]
    # Column names of the caller's give way to numbers.
    meta = [F.col(c).alias(f"_m{i}") for i, c in enumerate(_carried(df, order))]
    spread = rows.select(*part, "seg_pos", "_head", "_next", "_first", "_last", *meta, F.inline(events))
    # A row is sorted with what its kind needs: rows with what targets may take, targets with the ends of their window.
    kept = [c for c in spread.columns if c not in ("_head", "_next", "_first", "_last")]
    row = F.when(F.col("target").isNull() & F.col("at").isNotNull(), F.struct("seg_pos", "_head", "_next")).alias("_row")
    ends = F.when(F.col("target").isNotNull(), F.struct("_first", "_last")).alias("_ends")
    merged = Window.partitionBy(*part).orderBy("at", F.asc_nulls_first("target"), "seg_pos").rowsBetween(Window.unboundedPreceding, 0)
    met = spread.select(*kept, row, ends).withColumn("_b", F.last("_row", True).over(merged)).where(F.col("target").isNotNull())
    met = met.select("*", "_ends.*")

    def clipped(head: str) -> Column:
        return F.when(F.col(f"{head}.p") < F.col("_first.p"), F.col("_first")).otherwise(F.col(head))

    before, after = clipped("_b._head"), F.col("_b._next")
    nearer = F.when(F.col("at") - before["s"] <= after["s"] - F.col("at"), before).otherwise(after)
    found = (
        F.when(F.col("_b").isNull() | (F.col("_b.seg_pos") < F.col("_first.p")), F.col("_first"))
        .when(F.col("_b.seg_pos") >= F.col("_last.seg_pos"), clipped("_last._head"))
        .otherwise(nearer)
    )
    return met.select(*part, "seg_pos", "target", found["v"].alias("_found"), *(c for c in met.columns if c.startswith("_m")))


def _carried(df: DataFrame, order: Order) -> list[str]:
    """The columns that ``_nearest`` carries along as _m0, _m1 and so on."""
    return [*order.by, *(c for c in df.columns if c not in order.keys)]


def center_frames(df: DataFrame, order: Order, length: int, column: str, k: int, radius: Column, context: str = "centered", **cut) -> DataFrame:
    """One row per anchor with frames: ``column`` of the row nearest to each of k target seconds (see ``nearest_row_join``)."""
    rows = _nearest(df, order, length, [column], k, radius, context, **cut)
    # An anchor's targets are still together, so they are packed without an exchange.
    frames = F.sort_array(F.collect_list(F.struct("target", F.col(f"_found.{column}").alias("f"))))
    by = [F.any_value(f"_m{i}").alias(f"_m{i}") for i, _ in enumerate(order.by)]
    packed = rows.groupBy(order.entity, "_chunk", "segment_id", "seg_pos").agg(*by, frames.alias("f"))
    return packed.select(order.entity, *(F.col(f"_m{i}").alias(c) for i, c in enumerate(order.by)), F.transform("f", lambda x: x["f"]).alias("frames"))


def mean_pool(df: DataFrame, clip_keys: list[str], vector: str) -> DataFrame:
    """Average the frame vectors of each clip, dimension by dimension; partial sums are combined before the shuffle."""
    flat = df.select(*clip_keys, F.posexplode(vector).alias("dim", "x"))
    means = flat.groupBy(*clip_keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "m")))
    return means.groupBy(*clip_keys).agg(F.transform(ordered, lambda s: s["m"]).alias(vector))


def temporal_delta(df: DataFrame, clip_keys: list[str], order: str, vector: str) -> DataFrame:
    """Frame vector minus the previous frame's in the same clip, zeros for the first frame.

    A clip holds a fixed small number of frames, so a clip is one window partition.
    """
    w = Window.partitionBy(*clip_keys).orderBy(order)
    before = F.lag(vector).over(w)
    change = F.zip_with(F.col(vector), F.coalesce("_before", F.col(vector)), lambda a, b: a - b)
    return df.withColumn("_before", before).withColumn("delta", change).drop("_before")
