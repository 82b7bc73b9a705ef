"""Positions, segments, islands, runs, features, anchors and windows over the track."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.functions.scalar import circular, haversine_m
from fieldtrace.operators import anchors as A
from fieldtrace.operators import durations as D
from fieldtrace.operators import features as X
from fieldtrace.operators import segments as S
from fieldtrace.operators import stats as N
from fieldtrace.operators.clean import motion
from fieldtrace.registry.book import BOOK, joined, q6, r6, rounded
from fieldtrace.registry.views import ORDER, TRACK, segmented, track
from fieldtrace.schema import CLASS_NAMES, FEATURE_NAMES, RAW_FEATURES, ROLLED_SERIES

GAP, LONG_GAP = 12, 48
SEG, LONG_SEG = segmented(GAP), segmented(LONG_GAP)
KEY = ["entity_id", "tie"]


@BOOK.query("row_position", f"WITH {SEG} SELECT entity_id, tie, pos, seg_pos FROM seg")
def row_position(spark, sf):
    return S.segments(track(spark, sf), ORDER, GAP).select(*KEY, "pos", "seg_pos")


@BOOK.query("segment_id", f"WITH {SEG} SELECT entity_id, tie, segment_id FROM seg")
def segment_id(spark, sf):
    return S.segments(track(spark, sf), ORDER, GAP).select(*KEY, "segment_id")


@BOOK.query(
    "segment_bounds",
    f"""WITH {SEG} SELECT entity_id, segment_id, min(pos) AS first_pos, max(pos) AS last_pos,
    min(second) AS start_second, max(second) AS end_second, count(*) AS rows FROM seg GROUP BY ALL""",
)
def segment_bounds(spark, sf):
    return S.segment_bounds(track(spark, sf), ORDER, GAP)


ISLAND = f"""{TRACK},
stepped AS (SELECT *, row_number() OVER w - 1 AS pos,
    CASE WHEN second - lag(second) OVER w = 1 THEN 0 ELSE 1 END AS brk
  FROM track WINDOW w AS (PARTITION BY entity_id ORDER BY second, frame_time, tie)),
isl0 AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY entity_id ORDER BY pos) - 1 AS BIGINT) AS island_id FROM stepped),
isl AS (SELECT *, row_number() OVER (PARTITION BY entity_id, island_id ORDER BY pos) - 1 AS island_pos FROM isl0)"""


@BOOK.query("consecutive_island", f"WITH {ISLAND} SELECT entity_id, tie, island_id, island_pos FROM isl")
def consecutive_island(spark, sf):
    return S.step_islands(track(spark, sf), ORDER).select(*KEY, "island_id", "island_pos")


def runs_sql(label: str, gap: int) -> str:
    return f"""{TRACK},
    marked AS (SELECT *, row_number() OVER w - 1 AS pos,
        CASE WHEN lag(second) OVER w IS NULL OR {label} <> lag({label}) OVER w
          OR second - lag(second) OVER w > {gap} THEN 1 ELSE 0 END AS brk
      FROM track WINDOW w AS (PARTITION BY entity_id ORDER BY second, frame_time, tie)),
    run_rows AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY entity_id ORDER BY pos) - 1 AS BIGINT) AS run_id FROM marked),
    runs AS (SELECT entity_id, run_id, min({label}) AS class_id, min(second) AS start_second, max(second) AS end_second,
        arg_min(frame_time, pos) AS start_time, arg_max(frame_time, pos) AS end_time, count(*) AS rows,
        greatest(max(second) - min(second) + 1, count(*)) AS duration_seconds
      FROM run_rows GROUP BY entity_id, run_id)"""


RUNS = runs_sql("label", GAP)


@BOOK.query("run_id", f"WITH {RUNS} SELECT entity_id, tie, run_id FROM run_rows")
def run_id(spark, sf):
    return S.run_ids(track(spark, sf), ORDER, "label", GAP).select(*KEY, "run_id")


NAMES = "CASE class_id " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(CLASS_NAMES)) + " END"


@BOOK.query(
    "runs",
    f"""WITH {RUNS} SELECT entity_id, run_id, class_id, {NAMES} AS class_name, start_second, end_second,
    strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time, strftime(end_time, '%Y-%m-%d %H:%M:%S') AS end_time,
    rows, duration_seconds FROM runs""",
)
def runs(spark, sf):
    out = S.with_class_name(S.behaviour_runs(track(spark, sf), ORDER, "label", GAP))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start_time", "end_time")})


SUMMARY = f"""{RUNS},
dims AS (SELECT CAST(range AS INTEGER) AS class_id FROM range(11)),
summary AS (
  SELECT d.class_id, count(r.class_id) AS segment_count,
    CAST(coalesce(sum(duration_seconds), 0) AS BIGINT) AS total_seconds,
    coalesce(min(duration_seconds), 0)::DOUBLE AS min, coalesce(quantile_cont(duration_seconds, 0.10), 0)::DOUBLE AS p10,
    coalesce(quantile_cont(duration_seconds, 0.25), 0)::DOUBLE AS p25,
    coalesce(quantile_cont(duration_seconds, 0.5), 0)::DOUBLE AS median, coalesce(avg(duration_seconds), 0)::DOUBLE AS mean,
    coalesce(quantile_cont(duration_seconds, 0.75), 0)::DOUBLE AS p75,
    coalesce(quantile_cont(duration_seconds, 0.90), 0)::DOUBLE AS p90,
    coalesce(quantile_cont(duration_seconds, 0.95), 0)::DOUBLE AS p95, coalesce(max(duration_seconds), 0)::DOUBLE AS max
  FROM dims d LEFT JOIN runs r ON r.class_id = d.class_id GROUP BY d.class_id)"""
SUMMARY_DOUBLES = ["min", "p10", "p25", "median", "mean", "p75", "p90", "p95", "max"]


def summary_frame(spark, sf):
    return D.duration_summary(S.behaviour_runs(track(spark, sf), ORDER, "label", GAP))


@BOOK.query(
    "duration_summary",
    f"WITH {SUMMARY} SELECT class_id, {NAMES} AS class_name, segment_count, total_seconds, "
    + ", ".join(q6(c, c) for c in SUMMARY_DOUBLES)
    + " FROM summary",
)
def duration_summary(spark, sf):
    return rounded(summary_frame(spark, sf), SUMMARY_DOUBLES)


RECOMMENDED = """recommended AS (SELECT *,
    CAST(greatest(16, least(512, ceil(greatest(p75 * 2.0, median, 1)))) AS INTEGER) AS recommended_window,
    CAST(greatest(1, least(20, ceil(greatest(median, 1) * 0.25))) AS INTEGER) AS recommended_stride FROM summary)"""


@BOOK.query(
    "recommend_sampling",
    f"WITH {SUMMARY}, {RECOMMENDED} SELECT class_id, recommended_window, recommended_stride FROM recommended",
)
def recommend_sampling(spark, sf):
    out = D.recommend_sampling(summary_frame(spark, sf))
    return out.select("class_id", "recommended_window", "recommended_stride")


# Differences and frames inside the gap-free segments.

DIFF = f"""{LONG_SEG},
d1 AS (SELECT *,
    coalesce(lon - lag(lon) OVER s, 0) AS dx, coalesce(lat - lag(lat) OVER s, 0) AS dy,
    coalesce(speed - lag(speed) OVER s, 0) AS acceleration, coalesce(depth - lag(depth) OVER s, 0) AS depth_delta,
    coalesce(heading - lag(heading) OVER s, 0) AS turn
  FROM seg WINDOW s AS (PARTITION BY entity_id, segment_id ORDER BY pos)),
d2 AS (SELECT *, turn + 180 - 360 * floor((turn + 180) / 360) - 180 AS angle_diff FROM d1),
d3 AS (SELECT *, angle_diff AS angular_speed,
    coalesce(angle_diff - lag(angle_diff) OVER s, 0) AS angular_acceleration,
    coalesce(acceleration - lag(acceleration) OVER s, 0) AS jerk
  FROM d2 WINDOW s AS (PARTITION BY entity_id, segment_id ORDER BY pos))"""


def _frames(stat: str) -> str:
    fn = {"med": "median", "std": "stddev_pop"}[stat]
    return ", ".join(
        q6(f"{fn}({s}) OVER (PARTITION BY entity_id, segment_id ORDER BY pos ROWS {n - 1} PRECEDING)", f"{s}_{stat}_{n}")
        for s in ROLLED_SERIES
        for n in (5, 20)
    )


def features_frame(spark, sf):
    return X.segment_features(track(spark, sf), ORDER, LONG_GAP)


def picked(columns: list[str]):
    return lambda spark, sf: rounded(features_frame(spark, sf).select(*KEY, *columns), columns)


def plain(columns: list[str]) -> str:
    return f"WITH {DIFF} SELECT entity_id, tie, " + ", ".join(q6(c, c) for c in columns) + " FROM d3"


for name, columns in {
    "lag_diff": ["dx", "dy", "acceleration", "depth_delta"],
    "circular_diff": ["angle_diff", "angular_speed"],
    "second_diff": ["angular_acceleration", "jerk"],
}.items():
    BOOK.query(name, plain(columns))(picked(columns))

for name, stat in {"rolling_median": "med", "rolling_std": "std"}.items():
    columns = [f"{s}_{stat}_{n}" for s in ROLLED_SERIES for n in (5, 20)]
    BOOK.query(name, f"WITH {DIFF} SELECT entity_id, tie, {_frames(stat)} FROM d3")(picked(columns))

LOCAL = (
    q6("avg(speed) OVER (PARTITION BY entity_id, segment_id ORDER BY pos ROWS 2 PRECEDING)", "local_speed_mean")
    + ", "
    + q6("stddev_pop(heading) OVER (PARTITION BY entity_id, segment_id ORDER BY pos ROWS 2 PRECEDING)", "local_heading_std")
)
BOOK.query("local_stats", f"WITH {DIFF} SELECT entity_id, tie, {LOCAL} FROM d3")(
    picked(["local_speed_mean", "local_heading_std"])
)
DERIVED = ", ".join(
    [
        q6("angle_diff / (abs(speed) + 1e-3)", "curvature"),
        q6("speed * speed + abs(acceleration)", "motion_energy"),
        q6("abs(angle_diff)", "turn_indicator"),
    ]
)
BOOK.query("derived_motion", f"WITH {DIFF} SELECT entity_id, tie, {DERIVED} FROM d3")(
    picked(["curvature", "motion_energy", "turn_indicator"])
)
BASIC = ["lon", "lat", "speed", "acceleration", "angular_speed", "angular_acceleration", "angle_diff", "dx", "dy", "jerk", "depth_delta"]
FEATURES_SQL = (
    f"WITH {DIFF} SELECT entity_id, tie, "
    + ", ".join([*(q6(c, c) for c in BASIC), _frames("med"), _frames("std"), DERIVED, LOCAL])
    + " FROM d3"
)
BOOK.query("engineered_features", FEATURES_SQL)(picked(FEATURE_NAMES))


@BOOK.query(
    "raw_features",
    f"WITH {TRACK} SELECT entity_id, tie, concat_ws(',', lon, lat, speed, depth, heading) AS features FROM track",
)
def raw_features(spark, sf):
    return X.raw_features(track(spark, sf)).select(*KEY, joined("features").alias("features"))


# Anchors.

FIXED = "seg_pos % 3 = 0 OR is_last"


@BOOK.query("fixed_anchors", f"WITH {SEG} SELECT entity_id, tie, segment_id, seg_pos FROM seg WHERE {FIXED}")
def fixed_anchors(spark, sf):
    return A.fixed_anchors(track(spark, sf), ORDER, GAP, 3).select(*KEY, "segment_id", "seg_pos")


SEG_RUNS = f"""{LONG_SEG},
sr0 AS (SELECT *, CASE WHEN seg_pos = 0 OR label <> lag(label) OVER s THEN 1 ELSE 0 END AS rb
  FROM seg WINDOW s AS (PARTITION BY entity_id ORDER BY pos)),
sr1 AS (SELECT *, CAST(sum(rb) OVER (PARTITION BY entity_id ORDER BY pos) - 1 AS BIGINT) AS run_id FROM sr0),
sr AS (SELECT *, row_number() OVER r - 1 AS run_pos, lead(pos) OVER r IS NULL AS run_last
  FROM sr1 WINDOW r AS (PARTITION BY entity_id, run_id ORDER BY pos)),
lengths AS (SELECT entity_id, segment_id, label, run_id, max(second) - min(second) + 1 AS duration
  FROM sr GROUP BY ALL),
inferred AS (SELECT entity_id, segment_id, label, quantile_cont(duration, 0.5)::DOUBLE AS median_duration,
    CAST(greatest(1, least(20, ceil(greatest(quantile_cont(duration, 0.5), 1) * 0.25))) AS INTEGER) AS stride
  FROM lengths GROUP BY ALL)"""


@BOOK.query("inferred_stride", f"WITH {SEG_RUNS} SELECT * FROM inferred")
def inferred_stride(spark, sf):
    return A.inferred_stride(track(spark, sf), ORDER, "label", LONG_GAP)


@BOOK.query(
    "adaptive_anchors",
    f"""WITH {SEG_RUNS} SELECT entity_id, tie, segment_id, run_id, stride FROM sr JOIN inferred USING (entity_id, segment_id, label)
    WHERE run_pos % stride = 0 OR run_last""",
)
def adaptive_anchors(spark, sf):
    out = A.adaptive_anchors(track(spark, sf), ORDER, "label", LONG_GAP)
    return out.select(*KEY, "segment_id", "run_id", "stride")




@BOOK.query(
    "attach_duration_config",
    f"""WITH {SUMMARY}, {RECOMMENDED} SELECT entity_id, tie, coalesce(recommended_stride, 20) AS stride
    FROM track LEFT JOIN recommended ON label = class_id AND segment_count > 0""",
)
def attach_duration_config(spark, sf):
    config = D.duration_config(D.recommend_sampling(summary_frame(spark, sf))).where("segment_count > 0")
    out = A.with_stride(track(spark, sf), ["entity_id"], "label", None, config, 20, 1, 20)
    return out.select(*KEY, "stride")


def windows_sql(length: int, back: int, ahead: int, anchor: str, source: str = "seg", base: str = SEG) -> str:
    """Anchors with their window, slot by slot from the definition: clip the position, look the row up."""
    return f"""WITH {base},
    sized AS (SELECT *, max(seg_pos) OVER (PARTITION BY entity_id, segment_id) AS last_pos FROM {source}),
    slots AS (SELECT a.entity_id, a.tie, a.segment_id, s.range AS slot,
        greatest(0, least(a.last_pos, a.seg_pos - {back} + s.range)) AS at
      FROM sized a, range({length}) s WHERE {anchor})
    SELECT s.entity_id, s.tie, string_agg(r.tie, ',' ORDER BY slot) AS window_rows
    FROM slots s JOIN seg r ON r.entity_id = s.entity_id AND r.segment_id = s.segment_id AND r.seg_pos = s.at
    GROUP BY s.entity_id, s.tie"""


def window_frame(spark, sf, length, **options):
    out = A.build_windows(track(spark, sf), ORDER, length, ["tie"], **{"max_gap": GAP, **options})
    return out.select(*KEY, joined(F.transform("window", lambda r: r["tie"])).alias("window_rows"))


@BOOK.query("window_rows_causal", windows_sql(6, 5, 0, "true"))
def window_rows_causal(spark, sf):
    return window_frame(spark, sf, 6, stride=1)


@BOOK.query("window_rows_centered", windows_sql(7, 3, 3, "true"))
def window_rows_centered(spark, sf):
    return window_frame(spark, sf, 7, stride=1, context="centered")


@BOOK.query("build_windows", windows_sql(8, 4, 3, FIXED))
def build_windows(spark, sf):
    return window_frame(spark, sf, 8, stride=3, context="centered")


@BOOK.query(
    "build_windows_adaptive",
    windows_sql(
        5, 4, 0, "run_pos % stride = 0 OR run_last", "(SELECT * FROM sr JOIN inferred USING (entity_id, segment_id, label))", SEG_RUNS
    ),
)
def build_windows_adaptive(spark, sf):
    return window_frame(spark, sf, 5, adaptive=True, max_gap=LONG_GAP)


@BOOK.query(
    "gather_window",
    f"""WITH {SEG},
    sized AS (SELECT *, max(seg_pos) OVER (PARTITION BY entity_id, segment_id) AS last_pos FROM seg),
    slots AS (SELECT a.entity_id, a.tie, a.segment_id, CAST(s.range AS INTEGER) AS slot,
        greatest(0, least(a.last_pos, a.seg_pos - 3 + s.range)) AS at FROM sized a, range(4) s WHERE {FIXED})
    SELECT s.entity_id, s.tie, slot, r.speed, r.heading FROM slots s
    JOIN seg r ON r.entity_id = s.entity_id AND r.segment_id = s.segment_id AND r.seg_pos = s.at""",
)
def gather_window(spark, sf):
    out = A.build_windows(track(spark, sf), ORDER, 4, ["speed", "heading"], max_gap=GAP, stride=3)
    rows = out.select(*KEY, F.posexplode("window").alias("slot", "r"))
    return rows.select(*KEY, "slot", "r.speed", "r.heading")


def consecutive(length: int) -> str:
    return f"""{ISLAND},
full_windows AS (
  SELECT e.entity_id, e.tie, e.island_id, e.pos, m.label AS window_label
  FROM isl e JOIN isl m ON m.entity_id = e.entity_id AND m.pos = e.pos - {length - 1} + {length // 2} WHERE e.island_pos >= {length - 1})"""


def consecutive_sql(length: int) -> str:
    return f"""WITH {consecutive(length)} SELECT f.entity_id, f.tie, f.window_label, string_agg(r.tie, ',' ORDER BY r.pos) AS window_rows
    FROM full_windows f JOIN isl r ON r.entity_id = f.entity_id AND r.pos BETWEEN f.pos - {length - 1} AND f.pos
    GROUP BY ALL"""


@BOOK.query("windows_consecutive", consecutive_sql(4))
def windows_consecutive(spark, sf):
    out = A.consecutive_windows(track(spark, sf), ORDER, 4, ["tie"])
    return out.select(*KEY, "window_label", joined(F.transform("window", lambda r: r["tie"])).alias("window_rows"))


WINDOW_FEATURES = [
    "acceleration", "angle_diff", "angular_acceleration", "jerk", "curvature", "motion_energy", "turn_indicator",
    "local_speed_mean", "local_heading_std", "depth_delta", "dx", "dy",
    *(f"{s}_{t}_{n}" for s in ROLLED_SERIES for t in ("med", "std") for n in (5, 20)),
]
W = "OVER (PARTITION BY entity_id, sample ORDER BY slot)"


def _wf(fn: str, s: str, n: int) -> str:
    return f"{fn}({s}) OVER (PARTITION BY entity_id, sample ORDER BY slot ROWS {n - 1} PRECEDING)"


def window_features_sql(length: int) -> str:
    return f"""WITH {consecutive(length)},
w0 AS (SELECT f.entity_id, f.tie AS sample, r.pos - f.pos + {length - 1} AS slot, r.lon, r.lat, r.speed, r.depth, r.heading
  FROM full_windows f JOIN isl r ON r.entity_id = f.entity_id AND r.pos BETWEEN f.pos - {length - 1} AND f.pos),
w1 AS (SELECT *, coalesce(lon - lag(lon) {W}, 0) AS dx, coalesce(lat - lag(lat) {W}, 0) AS dy,
    coalesce(speed - lag(speed) {W}, 0) AS acceleration, coalesce(depth - lag(depth) {W}, 0) AS depth_delta,
    coalesce(heading - lag(heading) {W}, 0) AS turn FROM w0),
w2 AS (SELECT *, turn + 180 - 360 * floor((turn + 180) / 360) - 180 AS angle_diff FROM w1),
w3 AS (SELECT *, angle_diff AS angular_speed, coalesce(angle_diff - lag(angle_diff) {W}, 0) AS angular_acceleration,
    coalesce(acceleration - lag(acceleration) {W}, 0) AS jerk FROM w2)
SELECT entity_id, sample AS tie, CAST(slot AS INTEGER) AS slot, {", ".join([
    *(q6(c, c) for c in ("acceleration", "angle_diff", "angular_acceleration", "jerk", "depth_delta", "dx", "dy")),
    DERIVED,
    q6(_wf("avg", "speed", 3), "local_speed_mean"), q6(_wf("stddev_pop", "heading", 3), "local_heading_std"),
    *(q6(_wf(fn, s, n), f"{s}_{t}_{n}") for s in ROLLED_SERIES for t, fn in (("med", "median"), ("std", "stddev_pop")) for n in (5, 20)),
])} FROM w3"""


@BOOK.query("window_local_features", window_features_sql(4))
def window_local_features(spark, sf):
    return local_features(track(spark, sf), 4)


def local_features(rows, length):
    out = A.consecutive_windows(rows, ORDER, length, RAW_FEATURES)
    out = X.window_features(out).select(*KEY, *WINDOW_FEATURES)
    zipped = F.arrays_zip(*WINDOW_FEATURES)
    rows = out.select(*KEY, F.posexplode(zipped).alias("slot", "r"))
    return rows.select(*KEY, "slot", *(r6(F.col(f"r.{c}")).alias(c) for c in WINDOW_FEATURES))


# Slot weights from the definition (every slot looked up), against the closed form.


def weights_sql(length: int, back: int) -> str:
    return f"""{SEG},
    sized AS (SELECT *, max(seg_pos) OVER (PARTITION BY entity_id, segment_id) AS last_pos FROM seg),
    filled AS (SELECT a.entity_id, a.segment_id, greatest(0, least(a.last_pos, a.seg_pos - {back} + s.range)) AS seg_pos,
        count(*) AS n FROM sized a, range({length}) s WHERE {FIXED} GROUP BY 1, 2, 3),
    weighted AS (SELECT seg.*, coalesce(n, 0) AS slot_weight FROM seg LEFT JOIN filled USING (entity_id, segment_id, seg_pos))"""


for name, (length, back, context) in {
    "slot_weight": (6, 5, "causal"),
    "slot_weight_centered": (7, 3, "centered"),
}.items():
    BOOK.query(name, f"WITH {weights_sql(length, back)} SELECT entity_id, tie, slot_weight FROM weighted")(
        lambda spark, sf, length=length, context=context: A.slot_weights(
            track(spark, sf), ORDER, length, GAP, 3, context
        ).select(*KEY, "slot_weight")
    )

ADAPTIVE_WEIGHTS = f"""{SEG_RUNS},
    sized AS (SELECT *, max(seg_pos) OVER (PARTITION BY entity_id, segment_id) AS last_pos FROM sr JOIN inferred USING (entity_id, segment_id, label)),
    filled AS (SELECT a.entity_id, a.segment_id, greatest(0, least(a.last_pos, a.seg_pos - 4 + s.range)) AS seg_pos,
        count(*) AS n FROM sized a, range(5) s WHERE run_pos % stride = 0 OR run_last GROUP BY 1, 2, 3),
    weighted AS (SELECT seg.*, coalesce(n, 0) AS slot_weight FROM seg LEFT JOIN filled USING (entity_id, segment_id, seg_pos))"""


def adaptive_weights(spark, sf):
    return A.slot_weights(track(spark, sf), ORDER, 5, LONG_GAP, adaptive=True)


@BOOK.query("slot_weight_adaptive", f"WITH {ADAPTIVE_WEIGHTS} SELECT entity_id, tie, slot_weight FROM weighted")
def slot_weight_adaptive(spark, sf):
    return adaptive_weights(spark, sf).select(*KEY, "slot_weight")


@BOOK.query(
    "feature_stats_adaptive",
    f"""WITH {ADAPTIVE_WEIGHTS}, long_rows AS (UNPIVOT weighted ON {", ".join(RAW_FEATURES)} INTO NAME feature VALUE x),
    means AS (SELECT feature, sum(x * slot_weight) / sum(slot_weight) AS mean, CAST(sum(slot_weight) AS BIGINT) AS rows FROM long_rows GROUP BY feature),
    stats AS (SELECT feature, any_value(m.rows) AS rows, any_value(mean) AS mean, sqrt(sum(slot_weight * (x - mean) * (x - mean)) / any_value(m.rows)) AS std0
      FROM long_rows JOIN means m USING (feature) GROUP BY feature)
    SELECT feature, rows, {q6('mean', 'mean')}, {q6('CASE WHEN std0 < 1e-6 THEN 1 ELSE std0 END', 'std')} FROM stats""",
)
def feature_stats_adaptive(spark, sf):
    return rounded(N.feature_stats(adaptive_weights(spark, sf), RAW_FEATURES, "slot_weight"), ["mean", "std"])


@BOOK.query(
    "stride_chain",
    f"""WITH {SEG_RUNS} SELECT entity_id, tie, CASE WHEN label IN (2, 5) THEN 7 ELSE stride END AS stride
    FROM sr JOIN inferred USING (entity_id, segment_id, label)""",
)
def stride_chain(spark, sf):
    """Configured strides of two classes, inferred ones for the rest."""
    rows = S.segment_runs(track(spark, sf), ORDER, "label", LONG_GAP)
    inferred = A.inferred_stride(track(spark, sf), ORDER, "label", LONG_GAP)
    config = track(spark, sf).select(F.col("label").alias("class_id"), F.lit(7).alias("stride")).where("class_id in (2, 5)").distinct()
    return A.with_stride(rows, ["entity_id"], "label", inferred, config, 20, 1, 20).select(*KEY, "stride")


STATS = f"""{weights_sql(6, 5)},
long_rows AS (UNPIVOT weighted ON {", ".join(RAW_FEATURES)} INTO NAME feature VALUE x),
means AS (SELECT feature, sum(x * slot_weight) / sum(slot_weight) AS mean, CAST(sum(slot_weight) AS BIGINT) AS rows
  FROM long_rows GROUP BY feature),
stats AS (SELECT feature, any_value(m.rows) AS rows, any_value(mean) AS mean,
    sqrt(sum(slot_weight * (x - mean) * (x - mean)) / any_value(m.rows)) AS std0
  FROM long_rows JOIN means m USING (feature) GROUP BY feature),
norms AS (SELECT feature, rows, mean, CASE WHEN std0 < 1e-6 THEN 1 ELSE std0 END AS std FROM stats)"""


def stats_frame(spark, sf):
    weighted = A.slot_weights(track(spark, sf), ORDER, 6, GAP, 3)
    return N.feature_stats(weighted, RAW_FEATURES, "slot_weight")


@BOOK.query("feature_stats", f"WITH {STATS} SELECT feature, rows, {q6('mean', 'mean')}, {q6('std', 'std')} FROM norms")
def feature_stats(spark, sf):
    return rounded(stats_frame(spark, sf), ["mean", "std"])


def _z(f: str) -> str:
    pick = f"(SELECT {{}} FROM norms WHERE feature = '{f}')"
    return q6(f"({f} - {pick.format('mean')}) / ({pick.format('std')} + 1e-6)", f)


@BOOK.query("normalise", f"WITH {STATS} SELECT entity_id, tie, {', '.join(map(_z, RAW_FEATURES))} FROM track")
def normalise(spark, sf):
    rows = track(spark, sf)
    return rounded(N.normalise(rows, stats_frame(spark, sf), RAW_FEATURES).select(*KEY, *RAW_FEATURES), RAW_FEATURES)


@BOOK.query(
    "apply_stats",
    f"""WITH {STATS}, one AS (SELECT max(mean) FILTER (feature = 'speed') AS m, max(std) FILTER (feature = 'speed') AS s FROM norms)
    SELECT entity_id, tie, {q6('m', 'speed_mean')}, {q6('s', 'speed_std')} FROM track, one""",
)
def apply_stats(spark, sf):
    speed = stats_frame(spark, sf).where("feature = 'speed'")
    rows = track(spark, sf).select(*KEY)
    return rows.withColumns(
        {"speed_mean": r6(speed.select("mean").scalar()), "speed_std": r6(speed.select("std").scalar())}
    )


# Distances.

HAVERSINE = """2.0 * 6371000.0 * atan2(
  sqrt(pow(sin(radians({lat} - {lat0}) / 2), 2) + cos(radians({lat0})) * cos(radians({lat})) * pow(sin(radians({lon} - {lon0}) / 2), 2)),
  sqrt(1 - (pow(sin(radians({lat} - {lat0}) / 2), 2) + cos(radians({lat0})) * cos(radians({lat})) * pow(sin(radians({lon} - {lon0}) / 2), 2))))"""


@BOOK.query(
    "prev_distance",
    f"""WITH {TRACK}, m AS (SELECT entity_id, tie, lat, lon, second - lag(second) OVER w AS second_gap,
      coalesce(lag(lat) OVER w, lat) AS lat0, coalesce(lag(lon) OVER w, lon) AS lon0
      FROM track WINDOW w AS (PARTITION BY entity_id ORDER BY second, frame_time, tie))
    SELECT entity_id, tie, second_gap, {q6(HAVERSINE.format(lat="lat", lat0="lat0", lon="lon", lon0="lon0"), "prev_distance")} FROM m""",
)
def prev_distance(spark, sf):
    out = motion(track(spark, sf), ORDER)
    return out.select(*KEY, "second_gap", r6("prev_distance").alias("prev_distance"))


@BOOK.query(
    "haversine",
    f"WITH {TRACK} SELECT tie, {q6(HAVERSINE.format(lat='lat', lat0='35.0', lon='lon', lon0='120.0'), 'metres')} FROM track",
)
def haversine(spark, sf):
    metres = haversine_m(F.lit(35.0), F.lit(120.0), F.col("lat"), F.col("lon"))
    return track(spark, sf).select("tie", r6(metres).alias("metres"))


@BOOK.query(
    "floored_modulo",
    f"WITH {TRACK} SELECT tie, {q6('(heading - 400) + 180 - 360 * floor(((heading - 400) + 180) / 360) - 180', 'folded')} FROM track",
)
def floored_modulo(spark, sf):
    return track(spark, sf).select("tie", r6(circular(F.col("heading") - 400)).alias("folded"))
