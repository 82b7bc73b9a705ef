"""One entity holds much of the data: cutting it must not change any result."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import anchors as A
from fieldtrace.operators import segments as S
from fieldtrace.operators.clean import jump_flags
from fieldtrace.operators.features import segment_features
from fieldtrace.operators.ordered import chunked, hot_entities, with_hot
from fieldtrace.operators.smoothing import smooth_runs
from fieldtrace.registry.views import ORDER, track

SF = "/root/testdata/sf0.001"
WHOLE = replace(ORDER, hot_rows=10**9)
GAP = 12


@pytest.fixture(scope="module")
def rows(spark):
    """Half of all rows belong to one entity, which has three others beside it."""
    entity = F.when(F.col("tie") % 2 == 0, F.lit(0)).otherwise(1 + F.col("tie") % 3).cast("bigint")
    return track(spark, SF).withColumn("entity_id", entity).cache()


def same(left, right):
    columns = sorted(left.columns)
    assert sorted(right.columns) == columns

    def plain(df):
        def cell(v):
            return round(v, 9) + 0.0 if isinstance(v, float) else v

        return sorted(repr([cell(v) for v in r]) for r in df.select(*columns).collect())

    a, b = plain(left), plain(right)
    assert a == b
    assert a


@pytest.mark.parametrize("hot_rows", [30, 77, 499])
def test_hot_entity_is_found_and_cut(spark, rows, hot_rows):
    order = replace(ORDER, hot_rows=hot_rows)
    hot = hot_entities(rows, order).collect()
    assert 0 in {r.entity_id for r in hot}
    chunks = chunked(rows, order).where("_own").groupBy("entity_id", "_chunk").count().collect()
    assert max(r["count"] for r in chunks if r["_chunk"] >= 0) <= hot_rows
    assert sum(r["count"] for r in chunks) == rows.count()


@pytest.mark.parametrize("hot_rows", [50, 200])
def test_null_and_stray_seconds_and_entities_are_kept(rows, hot_rows):
    """NULL seconds, one far-off second and a NULL entity change neither the rows nor the size of a chunk."""
    odd = rows.withColumn("second", F.expr("CASE WHEN tie % 10 = 0 THEN NULL WHEN tie = 7 THEN 4000000000 ELSE second END"))
    odd = odd.withColumn("entity_id", F.expr("CASE WHEN entity_id = 0 THEN NULL ELSE entity_id END"))
    order = replace(ORDER, hot_rows=hot_rows)
    chunks = chunked(odd, order).where("_own").groupBy("entity_id", "_chunk").count().collect()
    assert sum(r["count"] for r in chunks) == odd.count()
    assert max(r["count"] for r in chunks if r["_chunk"] >= 0) <= hot_rows
    same(S.row_positions(odd, order), S.row_positions(odd, WHOLE))
    same(S.segments(odd, order, 2), S.segments(odd, WHOLE, 2))


OPERATORS = {
    "segments": lambda df, o: S.segments(df, o, 2),
    "segment_runs": lambda df, o: S.segment_runs(df, o, "label", 2),
    "islands": lambda df, o: S.step_islands(df, o),
    "runs": lambda df, o: S.behaviour_runs(df, o, "label", 1),
    "one_segment": lambda df, o: S.segments(df, o, 10**6),
    "features": lambda df, o: segment_features(df, o, GAP),
    "features_one_segment": lambda df, o: segment_features(df, o, 10**6),
    "fixed_anchors": lambda df, o: A.fixed_anchors(df, o, GAP, 7),
    "adaptive_anchors": lambda df, o: A.adaptive_anchors(df, o, "label", GAP),
    "causal": lambda df, o: A.build_windows(df, o, 6, ["tie", "speed"], "causal", 3, 2),
    "causal_one_segment": lambda df, o: A.build_windows(df, o, 6, ["tie"], "causal", 10**6, 5),
    "centered": lambda df, o: A.build_windows(df, o, 7, ["tie"], "centered", 3, 1),
    "adaptive_windows": lambda df, o: A.build_windows(df, o, 5, ["tie"], "causal", GAP, adaptive=True),
    "consecutive": lambda df, o: A.consecutive_windows(df, o, 3, ["tie"]),
    "weights": lambda df, o: A.slot_weights(df, o, 6, 3, 4),
    "weights_centered": lambda df, o: A.slot_weights(df, o, 9, 3, 4, "centered"),
    "weights_adaptive": lambda df, o: A.slot_weights(df, o, 6, GAP, 20, adaptive=True),
    "weights_one_segment": lambda df, o: A.slot_weights(df, o, 12, 10**6, 5, "centered"),
    "jumps": lambda df, o: jump_flags(df, o),
    "smoothing": lambda df, o: smooth_runs(df, o, "pred", [0, 3, 7], 5, per_chunk=4 if o.hot_rows < 10**6 else 10**6),
}


CASES = [(name, 40) for name in sorted(OPERATORS)] + [("features", 90), ("weights_centered", 90), ("causal", 90)]


@pytest.mark.parametrize("name, hot_rows", CASES)
def test_cutting_changes_nothing(rows, name, hot_rows):
    run = OPERATORS[name]
    same(run(rows, replace(ORDER, hot_rows=hot_rows)), run(rows, WHOLE))


@pytest.mark.parametrize("name", ["segments", "weights_centered", "smoothing"])
def test_hot_entities_counted_once(rows, name):
    order = with_hot(rows, replace(ORDER, hot_rows=60))
    fewer = rows.where("tie % 5 <> 0")
    same(OPERATORS[name](rows, order), OPERATORS[name](rows, WHOLE))
    same(OPERATORS[name](fewer, order), OPERATORS[name](fewer, WHOLE))


def test_result_does_not_depend_on_partitioning(spark, rows):
    shuffled = rows.repartition(5, F.hash("tie"))
    same(segment_features(shuffled, replace(ORDER, hot_rows=60), GAP), segment_features(rows, WHOLE, GAP))
