"""From raw parts and per-second observations to a cleaned, split dataset: one lazy plan up to the write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from fieldtrace.functions import coerce
from fieldtrace.operators import align, assets, clean
from fieldtrace.operators.ordered import Order
from fieldtrace.schema import ANCHOR_COLUMNS, CLEAN_INPUT_COLUMNS, TRAJECTORY_COLUMNS, require_columns
from fieldtrace.sources.writers import settled, write_by_date, write_split

OUTPUT_ORDER = ["frame_time", "entity_id", "second", "frame_path"]


@dataclass(frozen=True)
class Layout:
    """Where the cleaned assets live."""

    frames: str = "frames"
    audio: str = "audio_segments"
    videos: str = "videos"


def aligned_with_trajectory(aligned: DataFrame, parts: DataFrame) -> DataFrame:
    """Observations of each date that have a trajectory point in their second, with the point's values.

    ``parts`` comes from ``read_parts`` and is unique per (date, epoch_second).
    """
    on = ["date", "epoch_second"]
    if "epoch_second" not in aligned.columns:
        aligned = aligned.withColumn("epoch_second", coerce.epoch_second("fix_time"))
    rows = align.overlay(aligned, parts, on, TRAJECTORY_COLUMNS)
    return rows.withColumn("label", coerce.to_label("label"))


def with_clips(rows: DataFrame, order: list[str], root: str, videos: DataFrame, present: DataFrame, silence: DataFrame) -> DataFrame:
    """Plan a clip per row, then look up the video it is cut from, whether it is there and whether it is silence."""
    planned = assets.clip_plan(rows, order, root)
    return assets.attach_clips(assets.attach_source_path(planned, videos), present, silence)


def cleaned_dataset(
    rows: DataFrame, splits: dict[str, list[str]], first_by: list[str], layout: Layout = Layout(), order: Order = clean.MOTION_ORDER
) -> tuple[DataFrame, DataFrame]:
    """Cleaned rows with split, target paths and the published columns (plus date), and the report of the cleaning.

    The cleaned rows are written to the work folder once: finding each video's first row and placing the rows
    both read them, and the report is what that run observed. So is the placed dataset, which the writers and the
    reports read several times.
    """
    cleaned, report = clean.clean_with_report(require_columns(rows, CLEAN_INPUT_COLUMNS), first_by, order)
    placed = align.assign_split(cleaned, splits)
    placed = assets.rewrite_paths(placed, order.by, layout.frames, layout.audio, layout.videos)
    return settled(placed.select(*ANCHOR_COLUMNS, "date")), report


def write_dataset(dataset: DataFrame, root: str, file_format: str = "parquet") -> None:
    """The dataset by split and by date."""
    write_split(dataset, f"{root}/splits", OUTPUT_ORDER, file_format)
    write_by_date(dataset, f"{root}/dates", OUTPUT_ORDER, file_format)


def dataset_report(dataset: DataFrame, cleaning: DataFrame) -> dict[str, DataFrame]:
    """The summary tables of a run, by name; ``cleaning`` is the report that came with the dataset."""
    return {
        "clean": cleaning,
        "splits": align.split_summary(dataset),
        "classes": align.split_class_counts(dataset),
        "assets": assets.link_report(dataset),
        "audio": assets.audio_coverage(dataset, ["split"]),
    }
