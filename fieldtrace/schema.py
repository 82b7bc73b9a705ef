"""Column names, row types and the class dimension."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# They have to equal the published data format.
NUM_CLASSES = 11
CLASS_NAMES = [
    "Reverse empty harvesting",
    "Straight empty harvesting",
    "Turning empty harvesting",
    "Full-load harvesting",
    "Reverse transfer",
    "Straight transfer",
    "Turning transfer",
    "Engine-off waiting",
    "Idling waiting",
    "Unloading",
    "Road driving",
]
CLASS_SHORT_NAMES = ["R-EH", "S-EH", "T-EH", "Full", "R-Tr", "S-Tr", "T-Tr", "Off", "Idle", "Unload", "Road"]
# Header of the aligned files -> the ASCII names used by the operators.
SOURCE_COLUMNS = {
    "video_file": "entity_id",
    "second_in_video": "second",
    "分类": "label",
    "经度": "lon",
    "纬度": "lat",
    "速度": "speed",
    "深度": "depth",
    "方向角": "heading",
    "定位时间": "fix_time",
    "时间戳": "epoch_second",
}
# Header of the raw trajectory parts -> ASCII names.
PART_COLUMNS = {
    "时间": "fix_time",
    "方向": "heading",
    "标记": "label",
    "经度": "lon",
    "纬度": "lat",
    "速度": "speed",
    "深度": "depth",
}
# The columns a trajectory point brings, in their published order.
TRAJECTORY_COLUMNS = ["lon", "lat", "fix_time", "speed", "heading", "depth", "did", "label", "epoch_second"]
RAW_FEATURES = ["lon", "lat", "speed", "depth", "heading"]
ROLLED_SERIES = ["speed", "acceleration", "angular_speed", "angular_acceleration", "angle_diff"]
# The published feature order.
FEATURE_NAMES = (
    ["lon", "lat", "speed", "acceleration", "angular_speed", "angular_acceleration", "angle_diff"]
    + [f"{s}_{stat}_{n}" for s in ROLLED_SERIES for stat, n in (("med", 5), ("med", 20), ("std", 5), ("std", 20))]
    + ["dx", "dy", "jerk", "curvature", "motion_energy", "turn_indicator"]
    + ["local_speed_mean", "local_heading_std", "depth_delta"]
)
# The columns the cleaning stage asks for.
CLEAN_INPUT_COLUMNS = [
    "frame_path", "frame_time", "timestamp_inferred", "entity_id", "frame_number", "second", "lon", "lat",
    "fix_time", "speed", "heading", "depth", "did", "label", "epoch_second", "source_video_path",
    "audio_start_second", "audio_duration_seconds", "audio_path", "audio_exists", "audio_is_silence_fill",
]
# The columns of the cleaned dataset.
ANCHOR_COLUMNS = [
    "split", "frame_path", "frame_time", "timestamp_source", "timestamp_inferred", "entity_id", "video_path",
    "frame_number", "second", "lon", "lat", "fix_time", "speed", "heading", "depth", "did", "label",
    "epoch_second", "audio_start_second", "audio_duration_seconds", "audio_path", "audio_exists",
    "audio_is_silence_fill",
]
SPLITS = ["train", "val", "test"]

DURATION_ENTRY = T.StructType(
    [
        T.StructField("window", T.IntegerType()),
        T.StructField("stride", T.IntegerType()),
        T.StructField("median_duration", T.DoubleType()),
        T.StructField("p75_duration", T.DoubleType()),
        T.StructField("segment_count", T.LongType()),
    ]
)
STATS_SCHEMA = T.StructType(
    [
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("mean", T.ArrayType(T.DoubleType())),
        T.StructField("std", T.ArrayType(T.DoubleType())),
    ]
)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Return ``df`` unchanged, or raise naming every missing column in sorted order."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def class_dim(spark: SparkSession, num_classes: int = NUM_CLASSES) -> DataFrame:
    """The class dimension (class_id, class_name, short_name): one row per class, fixed size."""
    ids = spark.range(num_classes).select(F.col("id").cast("int").alias("class_id"))
    return ids.select(
        "class_id",
        F.get(F.array(*map(F.lit, CLASS_NAMES)), F.col("class_id")).alias("class_name"),
        F.get(F.array(*map(F.lit, CLASS_SHORT_NAMES)), F.col("class_id")).alias("short_name"),
    )


def class_pairs(spark: SparkSession, num_classes: int = NUM_CLASSES) -> DataFrame:
    """All (y_true, y_pred) cells of a confusion matrix; size fixed by the number of classes."""
    cell = F.col("id").cast("int")
    return spark.range(num_classes * num_classes).select(
        F.floor(cell / num_classes).cast("int").alias("y_true"),
        (cell % num_classes).cast("int").alias("y_pred"),
    )
