"""Readers: aligned rows, trajectory parts, configurations, asset inventories, clips."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrace.functions import coerce
from fieldtrace.functions.scalar import basename, date_in_name, fit_length
from fieldtrace.operators.align import keep_first
from fieldtrace.schema import DURATION_ENTRY, PART_COLUMNS, SOURCE_COLUMNS, STATS_SCHEMA, TRAJECTORY_COLUMNS, require_columns
from fieldtrace.sources.media import media_files, with_contents
from fieldtrace.sources.named_csv import has, read_named

NUMBERS = ["lon", "lat", "speed", "depth", "heading"]


def read_text_columns(spark: SparkSession, paths, columns: list[str] | None = None) -> DataFrame:
    """CSV with header, every column as text. Naming ``columns`` spares the look at the header."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(paths)


def read_aligned(spark: SparkSession, paths, columns: list[str] | None = None, fill: float | None = 0.0) -> DataFrame:
    """Aligned per-second rows under ASCII names, with times, integers and numbers parsed.

    Files may have their columns in any order, and each its own: they are matched by name. ``columns`` says that all
    files have just these, in this order, and spares the look at the headers. Unreadable positions become ``fill``, an
    unreadable epoch second -1; a file without epoch seconds takes them from its fix times; extra columns are carried
    through as text. A file without a required column is an error that names it.
    """
    required = ["entity_id", "frame_time", "second", "label", *NUMBERS]
    if columns:
        raw = require_columns(read_text_columns(spark, paths, columns).withColumnsRenamed(SOURCE_COLUMNS), required)
        known = F.lit(True)
    else:
        raw = read_named(spark, paths, SOURCE_COLUMNS, required)
        known = has("epoch_second")
    parsed = {c: coerce.to_number(c, fill) for c in NUMBERS}
    parsed |= {c: coerce.to_number(c) for c in ("did",) if c in raw.columns}
    parsed |= {c: coerce.to_number(c).cast("bigint") for c in ("frame_number",) if c in raw.columns}
    parsed |= {"second": coerce.to_number("second").cast("bigint"), "label": coerce.to_label("label")}
    parsed |= {c: coerce.to_time(c) for c in ("frame_time", "fix_time") if c in raw.columns}
    rows = raw.withColumns(parsed)
    if "epoch_second" in raw.columns:
        # A row without a readable epoch second matches no trajectory point.
        fixed = coerce.epoch_second("fix_time") if "fix_time" in raw.columns else F.lit(None).cast("bigint")
        second = F.when(known, coerce.to_number("epoch_second").cast("bigint")).otherwise(fixed)
        rows = rows.withColumn("epoch_second", F.coalesce(second, F.lit(-1).cast("bigint")))
    return rows.drop("_file", "_names")


def normalise_part(raw: DataFrame) -> DataFrame:
    """Trajectory part columns under ASCII names: rows without a time go, bad labels become -1, absent columns NULL."""
    raw = raw.withColumnsRenamed(PART_COLUMNS)
    require_columns(raw, ["fix_time", "label"])
    raw = raw.withColumns({"fix_time": coerce.to_time("fix_time"), "label": coerce.to_label("label")})
    raw = raw.where(F.col("fix_time").isNotNull()).withColumn("epoch_second", coerce.epoch_second("fix_time"))
    numbers = {c: coerce.to_number(c) for c in [*NUMBERS, "did"] if c in raw.columns}
    raw = raw.withColumns(numbers)
    absent = {c: F.lit(None).cast("double") for c in TRAJECTORY_COLUMNS if c not in raw.columns}
    return raw.withColumns(absent) if absent else raw


def read_parts(spark: SparkSession, paths, columns: list[str] | None = None, dated_by: str = "file_name") -> DataFrame:
    """Trajectory points of all parts, one row per (date, second), the earliest one.

    Files may differ in the columns they have and in their order: they are matched by name. Naming ``columns`` says that
    all files have just these, in this order, and spares the look at the headers. The date comes from the file name, or
    from the whole path with ``dated_by="file_path"``; files without a date are ignored. A dated file without a time or a
    label column is an error that names it.
    """
    if columns:
        raw = read_text_columns(spark, paths, columns).select("*", F.col(f"_metadata.{dated_by}").alias("_file"))
        raw = raw.withColumn("_date", date_in_name(F.col("_file"))).where(F.col("_date").isNotNull())
    else:
        raw = read_named(spark, paths, PART_COLUMNS, ["fix_time", "label"], "file" if dated_by == "file_path" else dated_by, date_in_name)
    points = normalise_part(raw).select(F.col("_date").alias("date"), F.col("_file").alias("part_file"), *TRAJECTORY_COLUMNS)
    return keep_first(points, ["date", "epoch_second"], ["fix_time", "part_file", "lon", "lat", "speed", "heading"])


def read_by_date(spark: SparkSession, path: str) -> DataFrame:
    """A dataset that ``write_by_date`` made; date is a date, and filters on it choose folders."""
    return spark.read.parquet(path).withColumn("date", F.col("date").cast("date"))


def parse_duration_config(texts: DataFrame, column: str = "value") -> DataFrame:
    """JSON text {class: {window, stride, median_duration, p75_duration, segment_count}} -> one row per class."""
    parsed = F.from_json(column, T.MapType(T.StringType(), DURATION_ENTRY))
    rows = texts.select(F.explode(parsed).alias("class_id", "entry"))
    return rows.select(F.col("class_id").cast("int").alias("class_id"), "entry.*")


def read_duration_config(spark: SparkSession, path: str) -> DataFrame:
    return parse_duration_config(spark.read.text(path, wholetext=True))


def parse_stats(texts: DataFrame, column: str = "value") -> DataFrame:
    """JSON text {columns, mean, std} -> (feature, mean, std)."""
    s = texts.select(F.from_json(column, STATS_SCHEMA).alias("s"))
    zipped = s.select(F.inline(F.arrays_zip("s.columns", "s.mean", "s.std")))
    return zipped.select(F.col("columns").alias("feature"), "mean", "std")


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return parse_stats(spark.read.text(path, wholetext=True))


def asset_inventory(spark: SparkSession, root: str, suffixes: list[str]) -> DataFrame:
    """(name, path, length): one file per base name below ``root``.

    Suffixes are ranked by their place in the list, then paths by name. Tasks list the folders; contents are not read.
    """
    return pick_assets(media_files(spark, root, suffixes), suffixes)


def pick_assets(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """``asset_inventory`` over a listing (path, length)."""
    suffix = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    rank = F.array_position(F.array(*map(F.lit, suffixes)), suffix)
    found = files.withColumns({"name": basename(F.col("path")), "_rank": rank}).where("_rank > 0")
    return keep_first(found, ["name"], ["_rank", "path"]).select("name", "path", "length")


def decode_pcm16(content: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and mono samples in [-1, 1) of a 16-bit PCM clip."""
    with wave.open(io.BytesIO(content)) as clip:
        if clip.getsampwidth() != 2:
            raise ValueError(f"clip has samples of {clip.getsampwidth()} bytes, not 2")
        samples = np.frombuffer(clip.readframes(clip.getnframes()), dtype="<i2").astype(np.float32) / 32768.0
        return clip.getframerate(), samples.reshape(-1, clip.getnchannels()).mean(axis=1)


def decode_waveforms(files: DataFrame, sample_rate: int = 16000) -> DataFrame:
    """(path, content) of clips -> (path, waveform of exactly ``sample_rate`` samples), channels averaged.

    Bytes are decoded in Arrow batches; padding and cutting stay in Spark expressions. A clip at another sample
    rate fails the job: resampling is not part of this package.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            clips = [decode_pcm16(c) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "rate": [r for r, _ in clips], "samples": [s for _, s in clips]})

    decoded = files.select("path", "content").mapInPandas(decode, "path string, rate int, samples array<float>")
    wrong = F.raise_error(F.concat(F.lit("unexpected sample rate in "), F.col("path"))).cast("array<float>")
    fitted = fit_length(F.col("samples"), sample_rate, F.lit(0.0).cast("float"))
    return decoded.select("path", F.when(F.col("rate") == sample_rate, fitted).otherwise(wrong).alias("waveform"))


def read_waveforms(rows: DataFrame, root: str, path: str = "audio_path", sample_rate: int = 16000) -> DataFrame:
    """Add waveform to rows whose ``path`` is relative to ``root``; NULL where there is no such file.

    The listing meets the rows by path first; only then are bytes read, of the files that some row names, and decoded in
    the same task: no clip is shuffled.
    """
    listed = media_files(rows.sparkSession, root).select("path", below(root, "path").alias("_name"))
    wanted = rows.select(F.col(path).alias("_name")).where("_name is not null").distinct()
    clips = decode_waveforms(with_contents(listed.join(wanted, "_name", "left_semi").select("path")), sample_rate)
    return rows.join(clips.select(below(root, "path").alias(path), "waveform"), path, "left")


def below(root: str, path) -> Column:
    """The part of a path below ``root``."""
    return F.substring_index(path, root.rstrip("/") + "/", -1) if root else F.col(path)


def attach_waveforms(rows: DataFrame, files: DataFrame, root: str = "", path: str = "audio_path", sample_rate: int = 16000) -> DataFrame:
    """``read_waveforms`` over a table (path, content): only the clips that some row names are decoded."""
    wanted = rows.select(F.col(path).alias("path")).where("path is not null").distinct()
    named = files.select(below(root, "path").alias("path"), "content").join(wanted, "path", "left_semi")
    clips = decode_waveforms(named, sample_rate).withColumnRenamed("path", path)
    return rows.join(clips, path, "left")


def frame_refs(rows: DataFrame, inventory: DataFrame, path: str = "frame_path", root: str = "") -> DataFrame:
    """Add frame_name and is_missing: frames the inventory lacks get a placeholder downstream.

    A frame is there when the inventory's ``path``, below ``root``, is the row's whole path; base names may repeat.
    """
    named = rows.withColumn("frame_name", basename(F.col(path)))
    known = inventory.select(below(root, "path").alias(path)).distinct().withColumn("is_missing", F.lit(False))
    return named.join(known, path, "left").withColumn("is_missing", F.coalesce("is_missing", F.lit(True)))


def read_model_metrics(spark: SparkSession, glob: str) -> DataFrame:
    """Per-class metric files of several models (``.../<model>/<file>.csv``) in one table with the model's name.

    Columns are matched by name in each file; a file without one of them is an error that names it.
    """
    columns = ["class_id", "precision", "recall", "f1", "support"]
    raw = read_named(spark, glob, {}, columns)
    return raw.select(
        F.element_at(F.split("_file", "/"), -2).alias("model"),
        F.col("class_id").try_cast("int").alias("class_id"),
        *(F.col(c).try_cast("double").alias(c) for c in ("precision", "recall", "f1")),
        F.col("support").try_cast("bigint").alias("support"),
    )
