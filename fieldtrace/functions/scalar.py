"""Scalar and array expressions shared by the operators; all built-in, all code-generated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published rules.
EARTH_RADIUS_M = 6371000.0


def clip(x: Column, low, high) -> Column:
    """x limited to [low, high]; NULL stays NULL."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(x.isNotNull(), F.greatest(low, F.least(x, high)))


def circular(x: Column) -> Column:
    """Angle difference in degrees folded into [-180, 180)."""
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres between two points given in degrees."""
    half_lat = F.radians(lat2 - lat1) / 2.0
    half_lon = F.radians(lon2 - lon1) / 2.0
    h = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lon), F.lit(2.0)
    )
    return F.lit(2.0 * EARTH_RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(1.0 - h))


def linspace(start: Column, stop: Column, n: int) -> Column:
    """n evenly spaced values from start to stop; n = 1 gives start alone."""
    if n == 1:
        return F.array(start.cast("double"))
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(steps, lambda i: start.cast("double") + i * ((stop - start).cast("double") / (n - 1)))


def sorted_median(ordered: Column) -> Column:
    """Median of a non-empty sorted array: the mean of the middle two when the count is even."""
    n = F.size(ordered)
    low = F.floor((n - 1) / 2).cast("int")
    high = F.floor(n / 2).cast("int")
    return (F.get(ordered, low) + F.get(ordered, high)) / 2.0


def item_clipped(a: Column, i: Column) -> Column:
    """Zero-based element, with positions outside the array clipped to its ends."""
    return F.get(a, clip(i, F.lit(0), F.size(a) - 1).cast("int"))


def pad_left(a: Column, n: int) -> Column:
    """Lengthen to n by repeating the first element in front."""
    return F.concat(F.array_repeat(F.get(a, F.lit(0)), F.greatest(F.lit(n) - F.size(a), F.lit(0))), a)


def mono(channels: Column) -> Column:
    """Average an array of equally long channels into one."""
    count = F.size(channels)
    rest = F.slice(channels, F.lit(2), F.greatest(count - 1, F.lit(0)))
    total = F.aggregate(rest, F.get(channels, F.lit(0)), lambda acc, ch: F.zip_with(acc, ch, lambda a, b: a + b))
    return F.transform(total, lambda x: x / count)


def fit_length(a: Column, n: int, fill: Column) -> Column:
    """Cut to n elements, or append ``fill`` until there are n."""
    return F.slice(F.concat(a, F.array_repeat(fill, F.greatest(F.lit(n) - F.size(a), F.lit(0)))), 1, n)


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    shifted = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(shifted, lambda e: e / array_sum(shifted))


def log_softmax(a: Column) -> Column:
    top = F.array_max(a)
    log_total = top + F.log(array_sum(F.transform(a, lambda x: F.exp(x - top))))
    return F.transform(a, lambda x: x - log_total)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def argmax(a: Column) -> Column:
    """Zero-based position of the largest element, the first one on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def split_list(text: Column) -> Column:
    """Comma list -> trimmed, non-empty items."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def split_ids(text: Column) -> Column:
    return F.transform(split_list(text), lambda x: x.cast("int"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def relative_to(path: Column, root: str) -> Column:
    """``path`` without a leading ``root``; other paths stay as they are."""
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 2**31 - 1)).otherwise(path)


def clip_name(second: Column) -> Column:
    return F.format_string("%06d.wav", second)


def date_in_name(name: Column) -> Column:
    """First yyyy-mm-dd in a file name, NULL when there is none."""
    return F.nullif(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def listed(text: str) -> list[str]:
    """The non-empty items of a comma list, trimmed."""
    return [item.strip() for item in text.split(",") if item.strip()]
