"""Window operators on long stretches of successive seconds: order lines per supplier, so that frames of 20 rows are full."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldtrace.operators import anchors as A
from fieldtrace.registry.book import BOOK, joined
from fieldtrace.registry.sequences import KEY, consecutive_sql
from fieldtrace.registry.views import ORDER, TRACK, table

LENGTH = 24

LINES = """track AS (SELECT l_suppkey AS entity_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS second,
    TIMESTAMP '2024-01-01 00:00:00' AS frame_time, l_suppkey * 10000000 + second AS tie, CAST(l_orderkey % 11 AS INTEGER) AS label,
    120 + (l_partkey % 97) * 1e-4::DOUBLE AS lon, 35 + (l_partkey % 89) * 1e-4::DOUBLE AS lat, CAST(l_quantity AS DOUBLE) AS speed,
    CAST(l_linenumber AS DOUBLE) / 4 AS depth, CAST((l_orderkey * 37) % 360 AS DOUBLE) AS heading FROM lineitem)"""


def lines(spark, sf):
    """A trajectory per supplier: its order lines, one second apart."""
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")) - 1
    return table(spark, sf, "lineitem").withColumn("second", place.cast("bigint")).selectExpr(
        "l_suppkey AS entity_id", "second", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS frame_time", "l_suppkey * 10000000 + second AS tie",
        "CAST(l_orderkey % 11 AS INT) AS label", "120 + (l_partkey % 97) * 1e-4D AS lon", "35 + (l_partkey % 89) * 1e-4D AS lat",
        "CAST(l_quantity AS DOUBLE) AS speed", "CAST(l_linenumber AS DOUBLE) / 4 AS depth", "CAST((l_orderkey * 37) % 360 AS DOUBLE) AS heading",
    )


@BOOK.query("windows_consecutive_dense", consecutive_sql(LENGTH).replace(TRACK, LINES))
def windows_consecutive_dense(spark, sf):
    out = A.consecutive_windows(lines(spark, sf), ORDER, LENGTH, ["tie"])
    return out.select(*KEY, "window_label", joined(F.transform("window", lambda r: r["tie"])).alias("window_rows"))
