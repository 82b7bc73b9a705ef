"""Counts observed while rows are written, the as-of merge over cut entities and other plans that must not read twice."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import clean
from fieldtrace.operators import frames as FR
from fieldtrace.operators.observed import Counts
from fieldtrace.registry.preparation import FIRST_BY, RULE_ORDER
from fieldtrace.registry.views import ORDER, observations, track
from fieldtrace.sources.writers import settled

SF = "/root/testdata/sf0.001"


def test_counts_are_those_of_the_rows(spark):
    counts = Counts()
    rows = counts.at(spark.range(0, 1000, 1, 7), all=F.count(F.lit(1)))
    rows = counts.at(rows.where("id % 3 = 0").repartition(5), some=F.count(F.lit(1)), top=F.max("id"))
    out = settled(rows)
    assert out.columns == ["id"] and out.count() == 334
    assert counts.read() == {"all": 1000, "some": 334, "top": 999}


def test_a_partition_seen_twice_voids_the_counts(spark):
    counts = Counts()
    rows = counts.at(spark.range(0, 100, 1, 2), all=F.count(F.lit(1)))
    # Both branches run the observed part: as when a lost executor's tasks run again.
    settled(rows.union(rows))
    assert counts.read() is None or counts.read() == {"all": 100}


def test_report_and_recount_agree_and_the_source_is_read_once(spark, monkeypatch):
    rows = observations(spark, SF)
    cleaned, report = clean.clean_with_report(rows, FIRST_BY, RULE_ORDER)
    found = {r["measure"]: r["rows"] for r in report.collect()}
    again = {r["measure"]: r["rows"] for r in clean.report_of(spark, clean.recounted(rows, FIRST_BY, RULE_ORDER)).collect()}
    assert found == again and list(found) == clean.MEASURES
    assert found["clean_rows"] == cleaned.count() == clean.clean_rows(rows, FIRST_BY, RULE_ORDER).count()
    # The run that writes the rows is the report's only one.
    monkeypatch.setattr(clean, "recounted", None)
    seen = []
    monkeypatch.setattr(clean, "settled", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or settled(df))
    clean.clean_with_report(rows, FIRST_BY, replace(RULE_ORDER, hot=spark.createDataFrame([], "entity_id string, _rows long, _size long")))
    assert len(seen) == 1 and seen[0].count("FileScan parquet") == 1
    # Counts that a repeated task made void are taken again.
    monkeypatch.undo()
    monkeypatch.setattr(Counts, "read", lambda self: None)
    assert {r["measure"]: r["rows"] for r in clean.clean_report(rows, FIRST_BY, RULE_ORDER).collect()} == found


def test_an_empty_table_has_a_report(spark):
    report = clean.clean_report(observations(spark, SF).where("false"), FIRST_BY, RULE_ORDER)
    assert {r["rows"] for r in report.collect()} == {0}


@pytest.mark.parametrize("context", ["centered", "causal"])
@pytest.mark.parametrize("length", [1, 7, 64])
def test_nearest_rows_equal_a_search_in_windows(spark, context, length):
    """Cut entities, repeated seconds and windows cut inside a run of equal seconds change nothing."""
    rows = track(spark, SF).withColumn("entity_id", F.expr("CASE WHEN tie % 2 = 0 THEN 0 ELSE tie % 3 END")).withColumn("second", F.floor(F.col("second") / 4))
    rows = rows.withColumn("radius", F.col("tie") % 9)
    order = replace(ORDER, hot_rows=90)
    got = FR.nearest_row_join(rows, order, length, ["tie", "second"], 5, F.col("radius"), context, max_gap=10, stride=2)
    assert {"label", "speed", "radius", "target"} <= set(got.columns)
    held = {}
    for r in rows.select("entity_id", "second", "frame_time", "tie", "radius").collect():
        held.setdefault(r["entity_id"], []).append(r)
    from fieldtrace.operators.segments import segments

    segs = {r["tie"]: (r["segment_id"], r["seg_pos"]) for r in segments(rows, order, 10).collect()}
    by_segment = {}
    for entity, own in held.items():
        for r in sorted(own, key=lambda r: (r["second"], r["frame_time"], r["tie"])):
            by_segment.setdefault((entity, segs[r["tie"]][0]), []).append(r)
    back, ahead = (length - 1, 0) if context == "causal" else (length // 2, length - length // 2 - 1)
    want = set()
    for own in by_segment.values():
        for i, r in enumerate(own):
            if i % 2 and i != len(own) - 1:
                continue
            slots = [own[min(max(j, 0), len(own) - 1)] for j in range(i - back, i + ahead + 1)]
            for target in range(5):
                at = r["second"] + round(-r["radius"] + target * (2 * r["radius"] / 4))
                best = min(slots, key=lambda s: abs(s["second"] - at))
                want.add((r["tie"], target, best["tie"], best["second"]))
    assert {(r["tie"], r["target"], r["nearest_tie"], r["nearest_second"]) for r in got.collect()} == want


def test_tasks_of_the_merge_follow_the_rows_and_unread_columns_stay_out(spark, monkeypatch):
    from fieldtrace.operators import ordered

    monkeypatch.setattr(ordered, "TASK_ROWS", 60)
    rows = settled(track(spark, SF))
    want = -(-rows.count() // 60)
    assert want > spark.sparkContext.defaultParallelism
    for order in (ORDER, replace(ORDER, hot_rows=60)):
        near = FR.nearest_row_join(rows, order, 9, ["tie"], 5, F.lit(5), max_gap=12, stride=3).select("entity_id", "tie", "target", "nearest_tie")
        frames = FR.center_frames(rows, order, 9, "tie", 5, F.lit(5), max_gap=12, stride=3)
        for out in (near, frames):
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            merge = plan[: plan.index("Repartition")]
            assert f", {want}" in plan[plan.index("Repartition") :].splitlines()[0]
            assert "lat#" not in merge and "heading#" not in merge
