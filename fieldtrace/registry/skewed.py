"""Ordered operators where one entity (NULL) holds half of all rows and is cut, with NULL and stray seconds.

The SQL is that of the same operator over evenly spread entities, with the track made uneven.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from fieldtrace.operators import anchors as A
from fieldtrace.operators import segments as S
from fieldtrace.operators.ordered import with_hot
from fieldtrace.registry.book import BOOK, joined
from fieldtrace.registry.sequences import GAP, KEY
from fieldtrace.registry.views import BASE_MICROS, ORDER, track

#: Rows from which an entity is cut: a tenth of the table, so that the large entity becomes five chunks at every size.
CHUNKS, LEAST = 10, 60
LENGTH = 6

ENTITY = "CASE WHEN event_id % 2 = 1 THEN user_id WHEN event_id % 6 = 0 THEN -1 END"
SECOND = f"CAST(floor((epoch_us(ts) - {BASE_MICROS}) / 3600000000.0) AS BIGINT)"


def uneven(name: str) -> str:
    """The SQL of a registered query over the uneven track; NULL entities meet by IS NOT DISTINCT FROM."""
    sql = BOOK.sql[name].replace("user_id AS entity_id", f"{ENTITY} AS entity_id")
    odd = f"CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id = 8 THEN 4000000000 ELSE {SECOND} END AS second"
    sql = sql.replace(f"{SECOND} AS second", odd)
    sql = sql.replace("ORDER BY second, frame_time, tie", "ORDER BY second NULLS FIRST, frame_time, tie")
    sql = sql.replace("CASE WHEN lag(second) OVER w IS NULL THEN 1", "CASE WHEN row_number() OVER w = 1 THEN 1")
    sql = sql.replace("r.entity_id = s.entity_id", "r.entity_id IS NOT DISTINCT FROM s.entity_id")
    return sql.replace(
        "FROM seg LEFT JOIN filled USING (entity_id, segment_id, seg_pos)",
        "FROM seg LEFT JOIN filled f ON f.entity_id IS NOT DISTINCT FROM seg.entity_id AND f.segment_id = seg.segment_id AND f.seg_pos = seg.seg_pos",
    )


def rows(spark, sf):
    out = track(spark, sf)
    second = F.expr("CASE WHEN tie % 31 = 0 THEN NULL WHEN tie = 8 THEN 4000000000 ELSE second END")
    entity = F.expr("CASE WHEN tie % 2 = 1 THEN entity_id WHEN tie % 6 = 0 THEN -1 END")
    return out.withColumns({"second": second, "entity_id": entity})


def hot(spark, sf):
    df = rows(spark, sf)
    return df, with_hot(df, replace(ORDER, hot_rows=max(LEAST, df.count() // CHUNKS)))


@BOOK.query("row_position_hot", uneven("row_position"))
def row_position_hot(spark, sf):
    return S.segments(*hot(spark, sf), GAP).select(*KEY, "pos", "seg_pos")


@BOOK.query("segment_id_hot", uneven("segment_id"))
def segment_id_hot(spark, sf):
    return S.segments(*hot(spark, sf), GAP).select(*KEY, "segment_id")


@BOOK.query("fixed_anchors_hot", uneven("fixed_anchors"))
def fixed_anchors_hot(spark, sf):
    return A.fixed_anchors(*hot(spark, sf), GAP, 3).select(*KEY, "segment_id", "seg_pos")


@BOOK.query("window_rows_causal_hot", uneven("window_rows_causal"))
def window_rows_causal_hot(spark, sf):
    out = A.build_windows(*hot(spark, sf), LENGTH, ["tie"], max_gap=GAP, stride=1)
    return out.select(*KEY, joined(F.transform("window", lambda r: r["tie"])).alias("window_rows"))


@BOOK.query("slot_weight_hot", uneven("slot_weight"))
def slot_weight_hot(spark, sf):
    return A.slot_weights(*hot(spark, sf), LENGTH, GAP, 3, "causal").select(*KEY, "slot_weight")
