"""Counts taken from the run that writes the rows, instead of from runs of their own.

Spark adds up what its tasks observe. A task that runs twice, because an executor with its output was lost, is added
twice, so every set of counts also observes which partitions it saw and how often: if one was seen twice, the counts are void.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: The digits of monotonically_increasing_id that count rows within a partition.
WITHIN = (1 << 33) - 1


class Counts:
    """Named counts at several places of one plan; ``read`` after the plan's rows were written."""

    def __init__(self) -> None:
        self.places: list[Observation] = []

    def at(self, df: DataFrame, **counts: Column) -> DataFrame:
        """The same rows; ``counts`` are aggregates over them. An empty partition is not seen."""
        place = Observation()
        self.places.append(place)
        kept = df.columns
        marked = df.withColumns({"_opens": F.monotonically_increasing_id().bitwiseAND(WITHIN) == 0, "_slice": F.spark_partition_id()})
        seen = [F.count_if("_opens").alias("_seen"), F.collect_set("_slice").alias("_slices")]
        return marked.observe(place, *seen, *(c.alias(n) for n, c in counts.items())).select(*kept)

    def read(self) -> dict[str, int] | None:
        """All counts by name, or None if some partition was counted twice or a place held no plan at all.

        Where Spark knows a table to be empty it plans neither rows nor counts.
        """
        out: dict[str, int] = {}
        for place in self.places:
            try:
                found = dict(place.get)
            except Py4JJavaError:
                return None
            if found.pop("_seen", 0) != len(found.pop("_slices", [None])):
                return None
            out |= found
        return out
