"""The kinematic feature layer: 36 columns per row, or the five raw ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions.scalar import array_sum, circular, sorted_median
from fieldtrace.operators.ordered import Order, breaks, chunked, local_position, own_rows
from fieldtrace.operators.segments import gap_break
from fieldtrace.schema import FEATURE_NAMES, RAW_FEATURES, ROLLED_SERIES

# Rows a feature looks back: a 20-row frame over a second difference, and one more row to see the gap before it.
LOOK_BACK = 22


def raw_features(df: DataFrame) -> DataFrame:
    return df.withColumn("features", F.array(*RAW_FEATURES))


def feature_array(df: DataFrame) -> DataFrame:
    """Pack the 36 feature columns into one array, in their fixed order."""
    return df.withColumn("features", F.array(*FEATURE_NAMES))


def _change(c: str, w) -> Column:
    return F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0))


def _derived() -> dict[str, Column]:
    speed, turn = F.col("speed"), F.col("angle_diff")
    return {
        "angular_speed": turn,
        "curvature": turn / (F.abs(speed) + 1e-3),
        "motion_energy": speed * speed + F.abs("acceleration"),
        "turn_indicator": F.abs(turn),
    }


def segment_features(df: DataFrame, order: Order, max_gap: float = 1.0) -> DataFrame:
    """Add the 36 feature columns; differences and frames restart at every gap-free segment.

    One exchange: the windows below all partition by (entity, chunk) or a refinement of it.
    """
    w = order.window()
    rows = chunked(df, order, before=LOOK_BACK, after=0)
    gap = breaks(local_position(rows, order), gap_break(order, max_gap), order)
    rows = rows.withColumn("_gap", gap)
    rows = rows.withColumn("_seg", F.count(F.when(F.col("_gap"), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    ws = order.window("_seg")
    rows = rows.withColumns(
        {
            "dx": _change("lon", ws),
            "dy": _change("lat", ws),
            "acceleration": _change("speed", ws),
            "depth_delta": _change("depth", ws),
            "angle_diff": circular(_change("heading", ws)),
            "local_speed_mean": F.avg("speed").over(ws.rowsBetween(-2, 0)),
            "local_heading_std": F.stddev_pop("heading").over(ws.rowsBetween(-2, 0)),
        }
    )
    rows = rows.withColumns(
        {
            **_derived(),
            "angular_acceleration": _change("angle_diff", ws),
            "jerk": _change("acceleration", ws),
        }
    )
    # angular_speed equals angle_diff by definition, so its frames are computed once and copied.
    frame = ws.rowsBetween(-19, 0)
    rolled = [s for s in ROLLED_SERIES if s != "angular_speed"]
    rows = rows.withColumns(
        {
            **{f"_last20_{s}": F.collect_list(s).over(frame) for s in rolled},
            **{f"{s}_std_20": F.stddev_pop(s).over(frame) for s in rolled},
            **{f"{s}_std_5": F.stddev_pop(s).over(ws.rowsBetween(-4, 0)) for s in rolled},
        }
    )
    medians = {}
    for s in rolled:
        last20 = F.col(f"_last20_{s}")
        last5 = F.slice(last20, F.greatest(F.size(last20) - 4, F.lit(1)), F.lit(5))
        medians[f"_sorted20_{s}"] = F.sort_array(last20)
        medians[f"_sorted5_{s}"] = F.sort_array(last5)
    rows = rows.withColumns(medians)
    final = {f"{s}_med_{n}": sorted_median(F.col(f"_sorted{n}_{s}")) for s in rolled for n in (5, 20)}
    for stat in ("med_5", "med_20", "std_5", "std_20"):
        source = final.get(f"angle_diff_{stat}", F.col(f"angle_diff_{stat}"))
        final[f"angular_speed_{stat}"] = source
    rows = own_rows(rows.withColumns(final))
    carried = [c for c in df.columns if c not in FEATURE_NAMES]
    return rows.select(*carried, *FEATURE_NAMES)


# Features of one window held as an array of rows: the same columns, but differences and frames start at the
# window's first row instead of the segment's.


def _changes(a: str) -> Column:
    return F.transform(F.col(a), lambda v, i: v - F.get(F.col(a), F.greatest(i - 1, F.lit(0))))


def _tail(a: str, i: Column, n: int) -> Column:
    return F.slice(F.col(a), F.greatest(i - n + 2, F.lit(1)), F.least(i + 1, F.lit(n)))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _std(a: Column) -> Column:
    """Population deviation in one pass: sums of differences from the first element and of their squares."""
    first, zero, n = F.get(a, F.lit(0)), F.lit(0.0), F.size(a)
    start = F.struct(zero.alias("s"), zero.alias("q"))
    added = lambda acc, x: F.struct((acc["s"] + (x - first)).alias("s"), (acc["q"] + (x - first) * (x - first)).alias("q"))
    spread = lambda acc: F.sqrt(F.greatest(acc["q"] / n - (acc["s"] / n) * (acc["s"] / n), zero))
    return F.aggregate(a, start, added, spread)


def _statistics(longest: Column) -> Column:
    """Median and deviation of a frame of up to 20 rows and of its last five."""
    last5 = F.slice(longest, F.greatest(F.size(longest) - 4, F.lit(1)), F.lit(5))
    frames = {20: lambda use: use(longest), 5: lambda use: _bound(last5, use)}
    return F.struct(
        *(frame(lambda a: _bound(F.sort_array(a), sorted_median)).alias(f"med_{n}") for n, frame in frames.items()),
        *(frame(_std).alias(f"std_{n}") for n, frame in frames.items()),
    )


def _rolled(a: str) -> Column:
    """Per row of the window the statistics of its frames, cut from the series once."""
    return F.transform(F.col(a), lambda _, i: _bound(_tail(a, i, 20), _statistics))


def window_features(df: DataFrame, rows: str = "window") -> DataFrame:
    """Per window (``rows``: an array of structs with the raw columns), add each feature as an array.

    Works row by row on the array: no shuffle on top of the one that built the windows.
    """
    df = df.withColumns({c: F.col(rows)[c] for c in RAW_FEATURES})
    df = df.withColumns(
        {
            "dx": _changes("lon"),
            "dy": _changes("lat"),
            "acceleration": _changes("speed"),
            "depth_delta": _changes("depth"),
            "angle_diff": F.transform(_changes("heading"), circular),
            "local_speed_mean": F.transform(
                F.col("speed"), lambda _, i: array_sum(_tail("speed", i, 3)) / F.least(i + 1, F.lit(3))
            ),
            "local_heading_std": F.transform(F.col("heading"), lambda _, i: _bound(_tail("heading", i, 3), _std)),
        }
    )
    df = df.withColumns(
        {
            "angular_speed": F.col("angle_diff"),
            "angular_acceleration": _changes("angle_diff"),
            "jerk": _changes("acceleration"),
            "curvature": F.zip_with("angle_diff", "speed", lambda t, s: t / (F.abs(s) + 1e-3)),
            "motion_energy": F.zip_with("speed", "acceleration", lambda s, a: s * s + F.abs(a)),
            "turn_indicator": F.transform("angle_diff", lambda t: F.abs(t)),
        }
    )
    # angular_speed equals angle_diff by definition, so its frames are computed once and copied.
    rolled = {s: f"_rolled_{s}" for s in ROLLED_SERIES if s != "angular_speed"}
    df = df.withColumns({name: _rolled(s) for s, name in rolled.items()})
    rolled["angular_speed"] = rolled["angle_diff"]
    df = df.withColumns({f"{s}_{stat}_{n}": F.col(rolled[s])[f"{stat}_{n}"] for s in ROLLED_SERIES for stat in ("med", "std") for n in (5, 20)})
    return df.drop(*rolled.values(), *(c for c in RAW_FEATURES if c not in FEATURE_NAMES))
