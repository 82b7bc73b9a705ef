"""CSV files of unlike headers as one table: columns are matched by name, file by file, in one scan of the lines.

The files' headers are a table; each line meets the header of its own file and takes every wanted column from the
position that header gives it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.sources.writers import settled

#: Up to so many files their headers are broadcast; beyond, lines and headers meet in a shuffle.
BROADCAST_FILES = 100_000
#: Different column names that all files together may have.
MOST_NAMES = 10_000
#: Files named in an error.
NAMED = 5


def lines_of(spark: SparkSession, paths) -> DataFrame:
    """(value, file, file_name, block) of every line that is not blank."""
    lines = spark.read.text(paths)
    tagged = lines.select("value", *(F.col(f"_metadata.{m}").alias(a) for m, a in (("file_path", "file"), ("file_name", "file_name"), ("file_block_start", "block"))))
    return tagged.where(F.trim("value") != "")


def renamed(names: Column, renames: dict[str, str]) -> Column:
    if not renames:
        return names
    known = F.create_map(*(F.lit(x) for pair in renames.items() for x in pair))
    return F.transform(names, lambda n: F.coalesce(F.element_at(known, n), n))


def headers(lines: DataFrame, renames: dict[str, str]) -> DataFrame:
    """(file, header, names): the first line of each file and its fields' names, without quotes and byte order mark."""
    first = lines.where("block = 0").withColumn("_line", F.monotonically_increasing_id())
    held = first.groupBy("file").agg(F.min_by("value", "_line").alias("header"), F.first("file_name").alias("file_name"))
    fields = F.transform(F.split(F.regexp_replace("header", "[\"\ufeff\r]", ""), ","), lambda n: F.trim(n))
    return held.select("file", "file_name", "header", renamed(fields, renames).alias("names"))


def require_names(held: DataFrame, required: list[str]) -> None:
    """An error that names files without one of ``required`` and what they lack."""
    lacking = F.array_except(F.array(*map(F.lit, sorted(required))), "names")
    bad = held.select("file", lacking.alias("lacks")).where(F.size("lacks") > 0).orderBy("file").limit(NAMED).collect()
    if bad:
        raise ValueError("missing required columns: " + "; ".join(f"{list(r['lacks'])} in the header of {r['file']}" for r in bad))


def read_named(spark: SparkSession, paths, renames: dict[str, str], required: list[str], dated_by: str | None = None, date=None) -> DataFrame:
    """All files' rows as text, one column for each name that some header has, plus file and names (of the file's header).

    ``renames`` maps header names to column names; a column that a file lacks is NULL in its rows, and of two columns of
    one name the first counts. Every file needs the ``required`` columns; a file that lacks one is an error, and so is
    a path without any header. With ``dated_by`` (file or file_name) and ``date``, a function of that column, files for which
    it is NULL are left out and the rest get a date. Fields may be quoted but do not span lines; empty files give no rows.
    """
    lines = lines_of(spark, paths)
    if date is not None:
        lines = lines.withColumn("date", date(F.col(dated_by))).where(F.col("date").isNotNull())
    held = settled(headers(lines, renames))
    require_names(held, required)
    # Names in the order of their positions; as many as columns, whatever the number of files.
    named = held.select("file", F.posexplode("names").alias("at", "name")).where("name <> ''").groupBy("name").agg(F.min("at").alias("at"))
    names = [r["name"] for r in named.orderBy("at", "name").limit(MOST_NAMES + 1).collect()]
    files, width = held.agg(F.count(F.lit(1)), F.max(F.size("names"))).first()
    if not names:
        raise ValueError(f"no file with a header in {paths}")
    if len(names) > MOST_NAMES:
        raise ValueError(f"the headers hold more than {MOST_NAMES} names")
    places = F.transform(F.array(*map(F.lit, names)), lambda n: F.array_position("names", n).cast("int") - 1)
    places = held.select(F.col("file").alias("_of"), F.col("header").alias("_header"), F.col("names").alias("_names"), places.alias("_places"))
    rows = lines.join(F.broadcast(places) if files <= BROADCAST_FILES else places, F.col("file") == F.col("_of"))
    rows = rows.where(F.col("value") != F.col("_header"))
    fields = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)))
    kept = ["date"] if date is not None else []
    rows = rows.select("file", *kept, "_names", "_places", fields.alias("_fields"))
    rows = rows.withColumn("_fields", F.array(*(F.col(f"_fields.c{i}") for i in range(width))))
    columns = [F.get("_fields", F.get("_places", F.lit(i))).alias(n) for i, n in enumerate(names)]
    return rows.select(*columns, F.col("file").alias("_file"), F.col("_names"), *(F.col(k).alias("_date") for k in kept))


def has(name: str) -> Column:
    """Whether the header of a row's file has the column."""
    return F.array_contains("_names", name)
