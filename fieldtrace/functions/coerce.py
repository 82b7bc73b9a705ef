"""Column coercions. Bad input turns into NULL (or a stated fill), never into an error or NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c, fill: float | None = None) -> Column:
    """Number or NULL; NaN counts as missing. ``fill`` replaces what is missing."""
    value = F.nanvl(_col(c).try_cast("double"), F.lit(None).cast("double"))
    return value if fill is None else F.coalesce(value, F.lit(float(fill)))


def number_of(df: DataFrame, c: str) -> Column:
    """``to_number`` of a column of ``df``; integer columns need no look for bad text or NaN."""
    whole = isinstance(df.schema[c].dataType, T.IntegralType)
    return F.col(c).cast("double") if whole else to_number(c)


def to_time(c) -> Column:
    """Zone-free timestamp or NULL."""
    return _col(c).try_cast("timestamp_ntz")


def to_label(c, fill: int = -1) -> Column:
    """Integer label; fractions are cut toward zero, unreadable text becomes ``fill``."""
    return F.coalesce(to_number(c).try_cast("int"), F.lit(fill))


def flag(c) -> Column:
    """Boolean with missing read as False."""
    return F.coalesce(_col(c).try_cast("boolean"), F.lit(False))


def epoch_micros(c: str) -> Column:
    """Microseconds since 1970 of a zone-free timestamp column, whatever the session time zone is."""
    return F.expr(
        f"(unix_date(CAST({c} AS DATE)) * 86400L + hour({c}) * 3600 + minute({c}) * 60) * 1000000"
        f" + CAST(extract(SECOND FROM {c}) * 1000000 AS BIGINT)"
    )


def epoch_second(c: str) -> Column:
    """Whole seconds since 1970, rounded down."""
    return F.floor(epoch_micros(c) / 1000000).cast("bigint")


def day(c) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd")


def time_text(c) -> Column:
    return F.date_format(_col(c), TIME_FORMAT)


def coerce_numbers(df: DataFrame, columns: list[str], fill: float | None = None) -> DataFrame:
    return df.withColumns({c: to_number(c, fill) for c in columns})


def coerce_times(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: to_time(c) for c in columns})


def align_columns(df: DataFrame, renames: dict[str, str], wanted: dict[str, str]) -> DataFrame:
    """Rename, add absent columns as typed NULLs, keep ``wanted`` (name -> type) in its order."""
    df = df.withColumnsRenamed(renames)
    absent = {n: F.lit(None).cast(t) for n, t in wanted.items() if n not in df.columns}
    return (df.withColumns(absent) if absent else df).select(*wanted)
