"""Writers: datasets by split or date, tables as CSV, run summaries and statistics as JSON."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """A new folder name below the shared folder the session names in spark.checkpoint.dir.

    Only a local session (a test: driver and tasks are one process) may do without that setting and then gets a
    temporary folder of this machine; on a cluster a missing setting is an error, since executors would not see
    each other's files.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="fieldtrace-")
    return f"{shared.rstrip('/')}/fieldtrace-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def settled(df: DataFrame, codec: str | None = None) -> DataFrame:
    """The same rows, written once to the shared work folder and read back; ``codec`` compresses them (else the session's).

    For a long chain that several branches use: the branches then scan a table instead of repeating the chain.
    """
    path = work_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_split(df: DataFrame, path: str, order: list[str], file_format: str = "parquet", by: str = "split") -> None:
    """One folder per split, rows sorted inside each file; partitioning by range keeps large splits spread out."""
    ranged = df.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    ranged.write.partitionBy(by).mode("overwrite").option("header", True).format(file_format).save(path)


def write_by_date(df: DataFrame, path: str, order: list[str], file_format: str = "parquet") -> None:
    write_split(df, path, order, file_format, "date")


def write_table(df: DataFrame, path: str) -> None:
    """CSV with header: segments, duration summaries, per-class and per-epoch metrics, predictions."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Long-form run summary (section, measure, value) as JSON lines."""
    df.write.mode("overwrite").json(path)


def stats_json(stats: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, std) -> one row of JSON text {columns, mean, std} in the order of ``features``."""
    place = F.array_position(F.array(*map(F.lit, features)), F.col("feature"))
    ordered = F.array_sort(F.collect_list(F.struct(place.alias("i"), "feature", "mean", "std")))
    packed = F.struct(
        F.transform("o", lambda s: s["feature"]).alias("columns"),
        F.transform("o", lambda s: s["mean"]).alias("mean"),
        F.transform("o", lambda s: s["std"]).alias("std"),
    )
    return stats.agg(ordered.alias("o")).select(F.to_json(packed).alias("value"))


def duration_config_json(config: DataFrame) -> DataFrame:
    """(class_id, window, stride, ...) -> one row of JSON text keyed by class."""
    entry = F.struct("window", "stride", "median_duration", "p75_duration", "segment_count")
    pairs = F.array_sort(F.collect_list(F.struct("class_id", entry.alias("entry"))))
    keyed = F.transform("p", lambda s: F.struct(s["class_id"].cast("string"), s["entry"]))
    return config.agg(pairs.alias("p")).select(F.to_json(F.map_from_entries(keyed)).alias("value"))


def write_json_text(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("overwrite").text(path)


def summary_rows(section: str, df: DataFrame, keys: list[str]) -> DataFrame:
    """Long form of a summary table: (section, key, measure, value) with values as text."""
    measures = [c for c in df.columns if c not in keys]
    key = F.concat_ws("/", *(F.col(k).cast("string") for k in keys)) if keys else F.lit("")
    text = [F.struct(F.lit(m).alias("measure"), F.to_json(F.struct(F.col(m).alias("v"))).alias("value")) for m in measures]
    return df.select(F.lit(section).alias("section"), key.alias("key"), F.inline(F.array(*text)))
