"""Aligning trajectory points with per-second observations, date splits and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions.coerce import to_label
from fieldtrace.functions.scalar import listed
from fieldtrace.schema import SPLITS, TRAJECTORY_COLUMNS


def keep_first(df: DataFrame, keys: list[str], order: list, copies: str | None = None) -> DataFrame:
    """The first row of every key in the given order, optionally with how many rows shared the key.

    Without ``copies`` this is a rank filter, which Spark also applies before the exchange; with it, one
    aggregate combined on the map side. Either way a key shared by many rows sends few of them over the wire.
    """
    if copies is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    best = F.min_by(F.struct(*df.columns), F.struct(*order))
    firsts = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(
        best.alias("_row"), F.count(F.lit(1)).alias("_copies")
    )
    return firsts.select("_row.*", F.col("_copies").alias(copies))


def first_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of every key; pruned before the exchange like any rank filter."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def examples(df: DataFrame, keys: list[str], value: str, n: int, name: str) -> DataFrame:
    """The n smallest values of every key, as a sorted array column."""
    few = first_n(df, keys, [F.col(value)], n)
    return few.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))


def semi_join_on_second(aligned: DataFrame, trajectory: DataFrame, on: list[str]) -> DataFrame:
    """Aligned rows whose second occurs in the trajectory."""
    return aligned.join(trajectory, on, "left_semi")


def overlay(aligned: DataFrame, trajectory: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Aligned rows with a trajectory point, its columns put over theirs, missing values included.

    ``trajectory`` has one row per key. The semi join and the overlay are this one inner join.
    """
    over = [c for c in columns if c not in on]
    points = trajectory.select(*on, *(F.col(c).alias(f"_over_{c}") for c in over))
    joined = aligned.join(points, on)
    order = aligned.columns + [c for c in over if c not in aligned.columns]
    return joined.select(*(F.col(f"_over_{c}").alias(c) if c in over else F.col(c) for c in order))


def filter_and_overlay(
    aligned: DataFrame,
    trajectory: DataFrame,
    on: list[str],
    order: list,
    columns: list[str] = TRAJECTORY_COLUMNS,
    label: str = "label",
) -> DataFrame:
    """Deduplicate the trajectory per key (first in ``order``), overlay it, and make the label an integer."""
    rows = overlay(aligned, keep_first(trajectory, on, order), on, columns)
    return rows.withColumn(label, to_label(label))


def on_dates(df: DataFrame, dates: str, date: str = "date") -> DataFrame:
    """Rows of the dates in a comma list. ``isin`` on the plain column prunes partitions where the table has them."""
    return df.where(F.col(date).isin(listed(dates)))


def date_summary(
    aligned: DataFrame, trajectory: DataFrame, filtered: DataFrame, date: str = "date", part: str | None = None,
    label: str = "label", time: str = "frame_time",
) -> DataFrame:
    """Rows per date on each side and after filtering; a date missing on one side shows 0 there.

    Also part_files (distinct values of ``part`` on the trajectory side, sorted; empty without that column),
    class_counts (label -> filtered rows) and the filtered rows' time_start and time_end.
    """
    kinds = ["trajectory_rows", "aligned_source_rows", "filtered_rows"]
    tagged = [
        df.select(date, *(F.lit(1 if k == kind else 0).alias(k) for k in kinds))
        for kind, df in zip(kinds, (trajectory, aligned, filtered))
    ]
    union = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    rows = union.groupBy(date).agg(*(F.sum(k).alias(k) for k in kinds))
    cells = filtered.groupBy(date, label).agg(F.count(F.lit(1)).alias("_n"), F.min(time).alias("_a"), F.max(time).alias("_b"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(label).cast("int"), "_n")))
    classes = cells.groupBy(date).agg(F.map_from_entries(pairs).alias("class_counts"), F.min("_a").alias("time_start"), F.max("_b").alias("time_end"))
    none = F.array().cast("array<string>")
    if part:
        parts = trajectory.select(date, part).distinct().groupBy(date).agg(F.sort_array(F.collect_list(part)).alias("part_files"))
        rows = rows.join(parts, date, "left").withColumn("part_files", F.coalesce("part_files", none))
    else:
        rows = rows.withColumn("part_files", none)
    return rows.join(classes, date, "left")


def split_of(date: Column, splits: dict[str, list[str]]) -> Column:
    """Split name of a date; a date in several lists takes the last of train, val, test that lists it."""
    named = [(name, splits[name]) for name in SPLITS if splits.get(name)]
    out = F.lit(None).cast("string")
    for name, dates in named:
        out = F.when(date.isin(dates), name).otherwise(out)
    return out


def assign_split(df: DataFrame, splits: dict[str, list[str]], date: str = "date", strict: bool = True) -> DataFrame:
    """Add split by date. With ``strict`` a date in no list fails the job and names the date."""
    split = split_of(F.col(date), splits)
    if strict:
        unknown = F.raise_error(F.concat(F.lit("unassigned date: "), F.coalesce(F.col(date), F.lit("none"))))
        split = F.coalesce(split, unknown.cast("string"))
    return df.withColumn("split", split)


def unassigned_dates(df: DataFrame, splits: dict[str, list[str]], date: str = "date") -> DataFrame:
    return df.where(split_of(F.col(date), splits).isNull()).select(date).distinct()


def split_summary(
    df: DataFrame, split: str = "split", entity: str = "entity_id", date: str = "date", time: str = "frame_time"
) -> DataFrame:
    """rows, videos, dates, time_start, time_end per split and for all of them (split 'all').

    Distinct videos and dates are found by a partial aggregate per (split, video, date) first.
    """
    cells = df.groupBy(split, entity, date).agg(
        F.count(F.lit(1)).alias("_n"), F.min(time).alias("_lo"), F.max(time).alias("_hi")
    )
    return (
        cells.groupingSets([[F.col(split)], []], F.col(split))
        .agg(
            F.sum("_n").alias("rows"),
            F.countDistinct(entity).alias("videos"),
            F.array_sort(F.collect_set(date)).alias("dates"),
            F.min("_lo").alias("time_start"),
            F.max("_hi").alias("time_end"),
        )
        .withColumn(split, F.coalesce(split, F.lit("all")))
    )


def split_class_counts(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Rows per label for each split and for all."""
    counts = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("_n"))
    rolled = counts.groupingSets([[F.col(split), F.col(label)], [F.col(label)]], F.col(split), F.col(label))
    return rolled.agg(F.sum("_n").alias("rows")).withColumn(split, F.coalesce(split, F.lit("all")))


def union_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """All splits in one table, with ``split`` as the first column."""
    tagged = [df.select(F.lit(name).alias("split"), "*") for name, df in parts.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def on_wanted_dates(df: DataFrame, wanted: DataFrame, date: str = "date") -> DataFrame:
    """Rows whose date a table lists. Over a dataset written by date, only the listed dates' folders are read.

    The table is one row per day at most once its repeats are gone, so it is broadcast; the scan then takes its partitions
    from the broadcast while the query runs.
    """
    return df.join(F.broadcast(wanted.select(date).where(F.col(date).isNotNull()).distinct()), date, "left_semi")


def first_entities(df: DataFrame, n: int, order: list, entity: str = "entity_id") -> DataFrame:
    """Rows of the n entities that appear first in ``order``; a report option, so the limit is the point."""
    starts = df.groupBy(entity).agg(F.min(F.struct(*order)).alias("_first"))
    chosen = starts.orderBy("_first", entity).limit(n).select(entity)
    return df.join(F.broadcast(chosen), entity, "left_semi")


def resolve_sources(dates: DataFrame, inventory: DataFrame, priority: list[str]) -> DataFrame:
    """For every date the inventory entry of the best location (``priority`` order), NULL where there is none."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("location"))
    ranked = inventory.withColumn("_rank", rank).where("_rank > 0")
    best = keep_first(ranked, ["date"], ["_rank", "path"]).drop("_rank")
    return dates.join(best, "date", "left")


def ordered_output(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sort for a sink by those of ``columns`` that exist."""
    return df.orderBy(*[c for c in columns if c in df.columns])
