"""Movement-shaped views over the star-schema test tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.functions.coerce import epoch_micros, epoch_second
from fieldtrace.operators.ordered import Order

ORDER = Order()
BASE_MICROS = 1704067200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trajectory per user: an event is a row, and an hour of real time plays the part of a second."""
    e = table(spark, sf_dir, "events").withColumn("us", epoch_micros("ts") - BASE_MICROS)
    day = "CAST(floor(us / 86400000000) % 11 AS INT)"
    return e.selectExpr(
        "user_id AS entity_id",
        "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, 0, CAST(floor(us / 3600) / 1000000 AS DECIMAL(18, 6))) AS frame_time",
        "event_id AS tie",
        "ts AS fix_time",
        "floor(us / 3600000000) AS second",
        f"{day} AS label",
        f"CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 11 AS INT) ELSE {day} END AS pred",
        "120 + (event_id % 97) * 1e-4D AS lon",
        "35 + (event_id % 89) * 1e-4D AS lat",
        "value AS speed",
        "try_cast(get_json_object(props, '$.k') AS DOUBLE) / 100 AS depth",
        "CAST((event_id * 37) % 360 AS DOUBLE) AS heading",
    )


TRACK = f"""track AS (
  SELECT user_id AS entity_id, event_id AS tie, ts AS fix_time,
    TIMESTAMP '2024-01-01 00:00:00'
      + to_microseconds(CAST(floor((epoch_us(ts) - {BASE_MICROS}) / 3600.0) AS BIGINT)) AS frame_time,
    CAST(floor((epoch_us(ts) - {BASE_MICROS}) / 3600000000.0) AS BIGINT) AS second,
    CAST(floor((epoch_us(ts) - {BASE_MICROS}) / 86400000000.0) % 11 AS INTEGER) AS label,
    CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 11 AS INTEGER)
         ELSE CAST(floor((epoch_us(ts) - {BASE_MICROS}) / 86400000000.0) % 11 AS INTEGER) END AS pred,
    120 + (event_id % 97) * 1e-4::DOUBLE AS lon, 35 + (event_id % 89) * 1e-4::DOUBLE AS lat,
    value AS speed, CAST(props->>'$.k' AS DOUBLE) / 100 AS depth,
    CAST((event_id * 37) % 360 AS DOUBLE) AS heading
  FROM events)"""


def segmented(max_gap: float) -> str:
    """CTEs up to ``seg``: the track with pos, segment_id, seg_pos and is_last."""
    return f"""{TRACK},
flagged AS (
  SELECT *, row_number() OVER w - 1 AS pos,
    CASE WHEN lag(second) OVER w IS NULL THEN 1
         WHEN second - lag(second) OVER w > {max_gap} THEN 1
         WHEN (epoch_us(frame_time) - epoch_us(lag(frame_time) OVER w)) / 1e6 > {max_gap} THEN 1
         ELSE 0 END AS gap
  FROM track WINDOW w AS (PARTITION BY entity_id ORDER BY second, frame_time, tie)),
numbered AS (
  SELECT *, CAST(sum(gap) OVER (PARTITION BY entity_id ORDER BY pos) - 1 AS BIGINT) AS segment_id FROM flagged),
seg AS (
  SELECT *, row_number() OVER s - 1 AS seg_pos, lead(pos) OVER s IS NULL AS is_last
  FROM numbered WINDOW s AS (PARTITION BY entity_id, segment_id ORDER BY pos))"""


# A dirty variant of the track: rows as they reach the cleaning stage, with every kind of defect.

DAYS = [f"2024-01-{d:02d}" for d in range(1, 31)]
SPLIT_DATES = {"train": DAYS[:20], "val": DAYS[20:25], "test": DAYS[25:]}


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-second rows with missing times, bad labels, lost audio, odd headings, copies and jumps."""
    return track(spark, sf_dir).withColumn("name", F.expr("concat('user', entity_id, '.mp4')")).selectExpr(
        "tie",
        "concat('frames/f', CASE WHEN tie % 50 = 49 THEN tie - 1 ELSE tie END, '.jpg') AS frame_path",
        "CASE WHEN tie % 41 <> 0 THEN frame_time END AS frame_time",
        "CASE WHEN tie % 5 = 0 THEN 'guess' ELSE 'meta' END AS timestamp_source",
        "tie % 5 = 0 AS timestamp_inferred",
        "name AS entity_id",
        "CAST(tie * 25 AS DOUBLE) AS frame_number",
        "second",
        "120 + (tie % 97) * 3e-6D AS lon",
        "35 + (tie % 89) * 3e-6D AS lat",
        "fix_time",
        "CASE WHEN tie % 29 <> 0 THEN speed % 7 END AS speed",
        "CASE WHEN tie % 47 = 0 THEN -1D ELSE CAST((tie * 37) % 361 AS DOUBLE) END AS heading",
        "depth",
        "entity_id % 13 AS did",
        "CASE WHEN tie % 43 = 0 THEN 11 ELSE label END AS label",
        "second + 1704067200 AS epoch_second",
        "concat('/raw/', name) AS source_video_path",
        "second AS audio_start_second",
        "1D AS audio_duration_seconds",
        "concat('clips/', name, '/', second, '.wav') AS audio_path",
        "CASE WHEN tie % 37 <> 0 THEN tie % 31 <> 0 END AS audio_exists",
        "tie % 17 = 0 AS audio_is_silence_fill",
    )


OBSERVATIONS = f"""{TRACK},
observations AS (
  SELECT tie, 'frames/f' || CASE WHEN tie % 50 = 49 THEN tie - 1 ELSE tie END || '.jpg' AS frame_path,
    CASE WHEN tie % 41 <> 0 THEN frame_time END AS frame_time,
    CASE WHEN tie % 5 = 0 THEN 'guess' ELSE 'meta' END AS timestamp_source, tie % 5 = 0 AS timestamp_inferred,
    'user' || entity_id || '.mp4' AS entity_id, CAST(tie * 25 AS DOUBLE) AS frame_number, second,
    120 + (tie % 97) * 3e-6::DOUBLE AS lon, 35 + (tie % 89) * 3e-6::DOUBLE AS lat, fix_time,
    CASE WHEN tie % 29 <> 0 THEN speed % 7 END AS speed,
    CASE WHEN tie % 47 = 0 THEN -1.0::DOUBLE ELSE CAST((tie * 37) % 361 AS DOUBLE) END AS heading, depth,
    entity_id % 13 AS did, CASE WHEN tie % 43 = 0 THEN 11 ELSE label END AS label,
    second + 1704067200 AS epoch_second, '/raw/user' || entity_id || '.mp4' AS source_video_path,
    second AS audio_start_second, 1.0::DOUBLE AS audio_duration_seconds,
    'clips/user' || entity_id || '.mp4/' || second || '.wav' AS audio_path,
    CASE WHEN tie % 37 <> 0 THEN tie % 31 <> 0 END AS audio_exists, tie % 17 = 0 AS audio_is_silence_fill
  FROM track)"""


def sql_list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


SPLIT_CASE = (
    f"CASE WHEN date IN ({sql_list(SPLIT_DATES['train'])}) THEN 'train' WHEN date IN ({sql_list(SPLIT_DATES['val'])}) "
    f"THEN 'val' WHEN date IN ({sql_list(SPLIT_DATES['test'])}) THEN 'test' END"
)


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The track with the real date of each event."""
    return track(spark, sf_dir).withColumn("date", F.date_format("fix_time", "yyyy-MM-dd"))


DATED = f"{TRACK}, dated AS (SELECT *, strftime(fix_time, '%Y-%m-%d') AS date FROM track)"
SPLITTED = f"{DATED}, splitted AS (SELECT *, {SPLIT_CASE} AS split FROM dated)"


# Trajectory points (orders) against per-second observations (line items).


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_totalprice").alias("lon"),
        F.when(k % 5 != 0, F.col("o_totalprice") / 2).alias("lat"),
        F.col("o_orderdate").alias("fix_time"),
        F.length("o_orderpriority").cast("double").alias("speed"),
        (k % 360).cast("double").alias("heading"),
        (k % 3).cast("double").alias("depth"),
        F.col("o_custkey").alias("did"),
        F.when(k % 7 != 0, (k % 11).cast("string")).otherwise(F.col("o_orderstatus")).alias("label"),
        epoch_second("o_orderdate").alias("epoch_second"),
        k.alias("point_id"),
    )


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("entity_id"),
        F.col("l_orderkey").alias("frame_number"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("speed"),
        F.col("l_returnflag").alias("label"),
        epoch_second("l_shipdate").alias("epoch_second"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
    )


ALIGN = """points AS (
  SELECT o_totalprice AS lon, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 2 END AS lat, o_orderdate AS fix_time,
    CAST(length(o_orderpriority) AS DOUBLE) AS speed, CAST(o_orderkey % 360 AS DOUBLE) AS heading,
    CAST(o_orderkey % 3 AS DOUBLE) AS depth, o_custkey AS did,
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 11 AS VARCHAR) ELSE o_orderstatus END AS label,
    CAST(floor(epoch_us(o_orderdate) / 1e6) AS BIGINT) AS epoch_second, o_orderkey AS point_id FROM orders),
aligned AS (
  SELECT l_suppkey AS entity_id, l_orderkey AS frame_number, l_linenumber AS line, l_quantity AS speed, l_returnflag AS label,
    CAST(floor(epoch_us(l_shipdate) / 1e6) AS BIGINT) AS epoch_second, strftime(l_shipdate, '%Y-%m-%d') AS date FROM lineitem),
first_points AS (
  SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY epoch_second ORDER BY fix_time, point_id) = 1)"""
