"""The cleaning rule chain and its report.

Rules apply in sequence, each one only to what the earlier ones left: required values, label range, audio present,
heading range, one row per (entity, second), one row per frame, no impossible jump.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.functions import coerce
from fieldtrace.functions.scalar import haversine_m
from fieldtrace.operators.align import keep_first
from fieldtrace.operators.observed import Counts
from fieldtrace.operators.ordered import Order, chunked, hot_entities, own_rows
from fieldtrace.sources.writers import settled

# Fixed values of the published rules.
LABEL_LOW, LABEL_HIGH = 0, 10
HEADING_HIGH = 359.999999
JUMP_FLOOR_MPS, JUMP_FACTOR, JUMP_OFFSET = 12.0, 1.5, 2.0
REQUIRED = ["frame_time", "fix_time", "frame_path", "audio_path", "entity_id", "source_video_path"]
NUMERIC = [
    "frame_number", "second", "lon", "lat", "speed", "heading", "depth", "did", "label", "epoch_second",
    "audio_start_second", "audio_duration_seconds",
]

MOTION_ORDER = Order(entity="entity_id", second="second", time="frame_time", tie="frame_path")


def coerce_rows(df: DataFrame) -> DataFrame:
    """Times and numbers from whatever they arrived as; unreadable values become NULL."""
    numbers = {c: coerce.number_of(df, c) for c in NUMERIC if c in df.columns}
    times = {c: coerce.to_time(c) for c in ("frame_time", "fix_time")}
    return df.withColumns({**numbers, **times})


def in_range(c: str, low: float, high: float) -> Column:
    return F.coalesce(F.col(c).between(low, high), F.lit(False))


def normalised_heading(c: str = "heading") -> Column:
    """A full circle is north."""
    return F.when(F.col(c) == 360, 0.0).otherwise(F.col(c))


def mark_rows(df: DataFrame, required: list[str] = REQUIRED, audio_flag: str = "audio_exists") -> DataFrame:
    """Row-local rules: add drop_reason (the first rule a row breaks, else NULL) and heading_was_360."""
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    reason = (
        F.when(missing, "missing_required")
        .when(~in_range("label", LABEL_LOW, LABEL_HIGH), "invalid_label")
        .when(~coerce.flag(audio_flag), "missing_audio")
    )
    df = df.withColumns({"_early": reason, "heading_was_360": reason.isNull() & F.coalesce(F.col("heading") == 360, F.lit(False))})
    df = df.withColumn("heading", normalised_heading())
    late = F.when(~in_range("heading", 0, HEADING_HIGH), "invalid_heading")
    return df.withColumn("drop_reason", F.coalesce("_early", late)).drop("_early")


def passing(df: DataFrame, required: list[str] = REQUIRED, audio_flag: str = "audio_exists") -> DataFrame:
    """Rows that break none of the row-local rules, heading normalised.

    Written as separate simple filters on the source columns, which reach the scan one by one.
    """
    for c in required:
        df = df.where(F.col(c).isNotNull())
    heading = F.col("heading").between(0, HEADING_HIGH) | (F.col("heading") == 360)
    kept = df.where(F.col("label").between(LABEL_LOW, LABEL_HIGH)).where(coerce.flag(audio_flag)).where(heading)
    return kept.withColumn("heading", normalised_heading())


def motion(df: DataFrame, order: Order = MOTION_ORDER, hot: DataFrame | None = None) -> DataFrame:
    """Add second_gap and prev_distance (metres) to the previous row of the entity.

    A missing previous coordinate is replaced by the current one; an entity's first row has no gap.
    """
    w = order.window()
    rows = chunked(df, order, before=1, after=0, hot=hot)
    lat0 = F.coalesce(F.lag("lat").over(w), F.col("lat"))
    lon0 = F.coalesce(F.lag("lon").over(w), F.col("lon"))
    rows = rows.withColumns({"_lat0": lat0, "_lon0": lon0, "second_gap": F.col(order.second) - F.lag(order.second).over(w)})
    rows = rows.withColumn("prev_distance", haversine_m(F.col("_lat0"), F.col("_lon0"), F.col("lat"), F.col("lon")))
    return own_rows(rows).drop("_lat0", "_lon0")


def is_jump() -> Column:
    """Moved faster since the previous second than the reported speed can explain; unknown speed never flags."""
    allowed = F.greatest(F.lit(JUMP_FLOOR_MPS), F.col("speed") * JUMP_FACTOR + JUMP_OFFSET)
    allowed = F.when(F.col("speed").isNotNull(), allowed)
    return F.coalesce((F.col("second_gap") == 1) & (F.col("prev_distance") > allowed), F.lit(False))


def jump_flags(df: DataFrame, order: Order = MOTION_ORDER, hot: DataFrame | None = None) -> DataFrame:
    return motion(df, order, hot).withColumn("gps_jump", is_jump())


def early_hot(df: DataFrame, order: Order) -> DataFrame:
    """Hot entities before the rules: one column of a row-local plan instead of the whole chain again."""
    return order.hot if order.hot is not None else settled(hot_entities(df.select(order.entity), order))


def survivors(coerced: DataFrame, first_by: list[str], order: Order = MOTION_ORDER, frame: str = "frame_path") -> DataFrame:
    """Rows left after the row-local rules and both deduplications, with the jump flag and copy counts.

    ``first_by`` decides which of several rows is the first one; it has to be unique. Hot entities are counted
    before the rules.
    """
    hot = early_hot(coerced, order)
    left = keep_first(passing(coerced), [order.entity, order.second], first_by, "_copies")
    per_second = left.withColumn("same_second", F.col("_copies") - 1).drop("_copies")
    left = keep_first(per_second, [frame], first_by, "_copies")
    left = left.withColumn("same_frame", F.col("_copies") - 1).drop("_copies")
    return jump_flags(left, order, hot)


def final_casts(df: DataFrame) -> DataFrame:
    """Integer, boolean and text forms of the output, and the date."""
    ints = {c: F.col(c).cast("int") for c in ("frame_number", "label", "audio_start_second") if c in df.columns}
    longs = {c: F.col(c).cast("bigint") for c in ("second", "epoch_second") if c in df.columns}
    flags = {c: coerce.flag(c) for c in ("timestamp_inferred", "audio_exists", "audio_is_silence_fill") if c in df.columns}
    times = {c: coerce.time_text(c) for c in ("frame_time", "fix_time")}
    return df.withColumn("date", coerce.day("frame_time")).withColumns({**ints, **longs, **flags, **times})


def clean_rows(df: DataFrame, first_by: list[str], order: Order = MOTION_ORDER) -> DataFrame:
    """The cleaned rows."""
    coerced = coerce_rows(df)
    hot = early_hot(coerced, order)
    # No counts are wanted here, so both deduplications can be rank filters.
    left = keep_first(passing(coerced), [order.entity, order.second], first_by)
    left = keep_first(left, ["frame_path"], first_by)
    left = jump_flags(left, order, hot).where(~F.col("gps_jump"))
    return final_casts(left.drop("gps_jump", "second_gap", "prev_distance"))


#: The measures of the report, in the order of the rules.
MEASURES = [
    "source_rows", "dropped_missing_required", "dropped_invalid_label", "dropped_missing_audio", "normalized_heading_360_to_0",
    "dropped_invalid_heading", "dropped_duplicate_entity_second", "dropped_duplicate_frame_path", "dropped_extreme_motion_rows", "clean_rows",
]


def lost(reason: str) -> Column:
    return F.count_if(F.col("drop_reason") == reason)


def local_counts() -> dict[str, Column]:
    """Over marked rows: how many each row-local rule takes, and how many pass."""
    return {
        "source_rows": F.count(F.lit(1)),
        "dropped_missing_required": lost("missing_required"),
        "dropped_invalid_label": lost("invalid_label"),
        "dropped_missing_audio": lost("missing_audio"),
        "normalized_heading_360_to_0": F.count_if("heading_was_360"),
        "dropped_invalid_heading": lost("invalid_heading"),
        "passed": F.count_if(F.col("drop_reason").isNull()),
    }


def watched(df: DataFrame, first_by: list[str], order: Order, counts: Counts) -> DataFrame:
    """The cleaned rows of a plan that counts what each rule takes while they pass."""
    coerced = coerce_rows(df)
    hot = early_hot(coerced, order)
    marked = counts.at(mark_rows(coerced), **local_counts())
    left = marked.where(F.col("drop_reason").isNull()).drop("drop_reason", "heading_was_360")
    left = counts.at(keep_first(left, [order.entity, order.second], first_by), seconds=F.count(F.lit(1)))
    left = counts.at(keep_first(left, ["frame_path"], first_by), frames=F.count(F.lit(1)))
    left = counts.at(jump_flags(left, order, hot), dropped_extreme_motion_rows=F.count_if("gps_jump"))
    return left.where(~F.col("gps_jump")).drop("gps_jump", "second_gap", "prev_distance")


def reported(df: DataFrame, first_by: list[str], order: Order, counts: Counts) -> DataFrame:
    found = counts.read()
    return report_of(df.sparkSession, found if found is not None else recounted(df, first_by, order))


def clean_with_report(df: DataFrame, first_by: list[str], order: Order = MOTION_ORDER) -> tuple[DataFrame, DataFrame]:
    """The cleaned rows, written once to the work folder, and the report of that very run (see ``clean_report``).

    The rows lost to each rule are observed as they pass, so the source is read and the rules are applied once. Should
    executors be lost so that parts of the run are repeated, the counts are taken again by plain aggregates.
    """
    counts = Counts()
    rows = settled(final_casts(watched(df, first_by, order, counts)))
    return rows, reported(df, first_by, order, counts)


def recounted(df: DataFrame, first_by: list[str], order: Order) -> dict[str, int]:
    """The counts of ``clean_with_report`` by aggregates over the rules."""
    coerced = coerce_rows(df)
    local = mark_rows(coerced).agg(*(c.alias(n) for n, c in local_counts().items())).first().asDict()
    jumps = F.count_if("gps_jump").alias("dropped_extreme_motion_rows")
    left = survivors(coerced, first_by, order).agg(F.count(F.lit(1)).alias("frames"), F.coalesce(F.sum("same_frame"), F.lit(0)).alias("same"), jumps).first()
    return local | {"seconds": left["frames"] + left["same"], "frames": left["frames"], "dropped_extreme_motion_rows": left["dropped_extreme_motion_rows"]}


def report_of(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    counts = counts | {
        "dropped_duplicate_entity_second": counts["passed"] - counts["seconds"],
        "dropped_duplicate_frame_path": counts["seconds"] - counts["frames"],
        "clean_rows": counts["frames"] - counts["dropped_extreme_motion_rows"],
    }
    return spark.createDataFrame([(m, counts[m]) for m in MEASURES], "measure string, rows long")


def clean_report(df: DataFrame, first_by: list[str], order: Order = MOTION_ORDER) -> DataFrame:
    """(measure, rows): source rows, rows lost to each rule in turn, headings set to 0, clean rows.

    For the report alone: the rows pass the rules and are kept nowhere.
    """
    counts = Counts()
    watched(df, first_by, order, counts).write.format("noop").mode("overwrite").save()
    return reported(df, first_by, order, counts)
