"""Per-second media assets: clip plan, coverage, silence registry, target paths and existence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.functions.coerce import day
from fieldtrace.functions.scalar import basename, clip_name, stem
from fieldtrace.operators.align import examples
from fieldtrace.operators.ordered import match
from fieldtrace.sources.writers import settled

# Fixed values of the published layout and report.
CLIP_SECONDS = 1.0
MISSING_EXAMPLES = 20
VERIFY_EXAMPLES = 10
ASSET_COLUMNS = ["frame_path", "audio_path", "video_path"]


def by_first_row(df: DataFrame, firsts: DataFrame, key: str) -> DataFrame:
    """Rows with the values of their entity's first row.

    The small table is written first: with a plain exchange on both sides, adaptive skew handling can split the join
    when one entity holds much of the data (and broadcast the table while it is small). NULL is an entity, too.
    """
    return match(df, settled(firsts), [key])


def first_of_entity(df: DataFrame, columns: dict[str, Column], order: list, entity: str = "entity_id") -> DataFrame:
    """One row per entity with values of its first row in ``order``; combined on the map side."""
    values = F.struct(*(c.alias(n) for n, c in columns.items()))
    return df.groupBy(entity).agg(F.min_by(values, F.struct(*order)).alias("_v")).select(entity, "_v.*")


def clip_path(root: str, split: Column, date: Column, entity: Column, second: Column) -> Column:
    return F.concat_ws("/", F.lit(root), F.lit("audio_segments"), split, date, stem(entity), clip_name(second))


def clip_plan(df: DataFrame, order: list, root: str, entity: str = "entity_id", split: str | None = "split") -> DataFrame:
    """Add the clip of every row: audio_path, audio_start_second, audio_duration_seconds.

    The folder carries split and date of the entity's first row, not of the row itself.
    """
    named = {"_split": F.col(split) if split else F.lit("all"), "_date": day("frame_time")}
    firsts = first_of_entity(df, named, order, entity)
    path = clip_path(root, F.col("_split"), F.col("_date"), F.col(entity).cast("string"), F.col("second").cast("int"))
    return (
        by_first_row(df, firsts, entity)
        .withColumns(
            {
                "audio_path": path,
                "audio_start_second": F.col("second").cast("int"),
                "audio_duration_seconds": F.lit(CLIP_SECONDS),
            }
        )
        .drop("_split", "_date")
    )


def attach_source_path(df: DataFrame, inventory: DataFrame, name: str = "entity_id") -> DataFrame:
    """Add source_video_path by file name, '' when the inventory has none."""
    paths = inventory.select(F.col("name").alias(name), F.col("path").alias("source_video_path"))
    return df.join(paths, name, "left").fillna("", ["source_video_path"])


def missing_sources(df: DataFrame, inventory: DataFrame, name: str = "entity_id") -> DataFrame:
    """Entities without an asset."""
    return df.select(name).distinct().join(inventory.select(F.col("name").alias(name)), name, "left_anti")


def attach_asset_flag(df: DataFrame, present: DataFrame, path: str, flag: str) -> DataFrame:
    """Add ``flag``: is the row's path among ``present`` (a table with a ``path`` column)?"""
    known = present.select(F.col("path").alias(path)).distinct().withColumn(flag, F.lit(True))
    return df.join(known, path, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def attach_clips(df: DataFrame, present: DataFrame, silence: DataFrame) -> DataFrame:
    """audio_exists and audio_is_silence_fill of every planned clip."""
    df = attach_asset_flag(df, present, "audio_path", "audio_exists")
    return attach_asset_flag(df, silence, "audio_path", "audio_is_silence_fill")


def silence_registry(plan: DataFrame, present: DataFrame, old: DataFrame) -> DataFrame:
    """Paths filled with silence: those registered before and every planned clip that is not there."""
    gone = plan.select(F.col("audio_path").alias("path")).join(present.select("path"), "path", "left_anti")
    return old.select("path").unionByName(gone).distinct()


def clip_requests(plan: DataFrame, present: DataFrame, silence: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Distinct (entity, second, audio_path) asked for, with _there, _silent and _written."""
    asked = plan.where(F.col("second").isNotNull())
    requests = asked.groupBy(entity, "second", "audio_path").agg(F.count(F.lit(1)).alias("_rows"))
    requests = attach_asset_flag(requests, present, "audio_path", "_there")
    requests = attach_asset_flag(requests, silence, "audio_path", "_silent")
    return requests.withColumn("_written", F.col("_there") | F.col("_silent"))


def silence_filled_seconds(plan: DataFrame, present: DataFrame, silence: DataFrame, entity: str = "entity_id") -> DataFrame:
    """(entity, second) of every requested clip that is silence only, as rows: their number has no bound."""
    return clip_requests(plan, present, silence, entity).where(F.col("_silent") & ~F.col("_there")).select(entity, "second")


def clip_coverage(plan: DataFrame, present: DataFrame, silence: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Per entity: requested, written, missing and silence-filled clips, second range, ok, first missing seconds.

    A second asked for by several rows is one request; a row without a second asks for nothing. Which seconds were
    filled with silence is a table of its own, ``silence_filled_seconds``.
    """
    requests = clip_requests(plan, present, silence, entity)
    totals = requests.groupBy(entity).agg(
        F.count(F.lit(1)).alias("requested_seconds"),
        F.count_if("_written").alias("written_clips"),
        F.count_if(~F.col("_written")).alias("missing_clips"),
        F.count_if(F.col("_silent") & ~F.col("_there")).alias("silence_filled_clips"),
        F.min("second").alias("min_second"),
        F.max("second").alias("max_second"),
        (F.count_if(~F.col("_written")) == 0).alias("ok"),
    )
    missing = requests.where(~F.col("_written"))
    few = examples(missing, [entity], "second", MISSING_EXAMPLES, "missing_second_examples")
    none = F.array().cast("array<bigint>")
    return totals.join(few, entity, "left").withColumn(
        "missing_second_examples", F.coalesce("missing_second_examples", none)
    )


def coverage_totals(coverage: DataFrame) -> DataFrame:
    """Totals over all entities."""
    sums = [F.sum(c).alias(c) for c in ("requested_seconds", "written_clips", "missing_clips", "silence_filled_clips")]
    return coverage.agg(F.count(F.lit(1)).alias("videos"), *sums, F.count_if(~F.col("ok")).alias("failed_videos"))


def audio_coverage(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows and rows with audio."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if("audio_exists").alias("audio_exists_rows"))


def rewrite_paths(df: DataFrame, order: list, frames: str, audio: str, videos: str, entity: str = "entity_id") -> DataFrame:
    """Point frames, clips and videos at their place in the cleaned layout.

    A video is stored under the date of its first row. Frames and clips belong to one row, so theirs are local.
    """
    firsts = first_of_entity(df, {"_video_date": F.col("date")}, order, "source_video_path")
    named = by_first_row(df, firsts, "source_video_path")
    video = F.concat_ws("/", F.lit(videos), F.col("_video_date"), basename(F.col("source_video_path")))
    return named.withColumns(
        {
            "frame_path": F.concat_ws("/", F.lit(frames), "date", F.lit("aligned_frames"), basename(F.col("frame_path"))),
            "audio_path": F.concat_ws(
                "/", F.lit(audio), "split", "date", stem(F.col(entity).cast("string")), basename(F.col("audio_path"))
            ),
            "video_path": video,
            "source_video_path": video,
        }
    ).drop("_video_date")


def link_report(df: DataFrame) -> DataFrame:
    """Distinct frames, clips and videos, counted over partially aggregated paths."""
    longer = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("path")) for c in ASSET_COLUMNS))).alias("a"))
    return longer.select("a.*").distinct().groupBy("kind").agg(F.count("path").alias("unique_paths"))


def verify_assets(df: DataFrame, inventory: DataFrame, columns: list[str] = ASSET_COLUMNS) -> DataFrame:
    """Per path column: distinct paths checked, how many the inventory lacks, and the first ten of those."""
    kinds = F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("path")) for c in columns))
    paths = df.select(F.inline(kinds)).distinct()
    paths = attach_asset_flag(paths, inventory, "path", "_there")
    totals = paths.groupBy("kind").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(~F.col("_there")).alias("missing")
    )
    few = examples(paths.where(~F.col("_there")), ["kind"], "path", VERIFY_EXAMPLES, "missing_examples")
    none = F.array().cast("array<string>")
    return totals.join(F.broadcast(few), "kind", "left").withColumn(
        "missing_examples", F.coalesce("missing_examples", none)
    )
