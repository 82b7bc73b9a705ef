"""Hand-computed cases for the single rules, and published values as goldens."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fieldtrace.functions import coerce, scalar
from fieldtrace.operators import align, anchors, clean, durations, features, frames, metrics, reports, segments, splits, stats
from fieldtrace.operators.ordered import Order
from fieldtrace.operators.smoothing import smooth_runs
from fieldtrace.schema import FEATURE_NAMES, require_columns
from fieldtrace.sources import readers, writers

ORDER = Order()


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.fixture(scope="module")
def demo(spark):
    """Eight consecutive seconds of one trajectory."""
    rows = [
        (
            "demo.mp4", i, f"2024-10-18 08:00:{i:02d}", i, 3, 120.006 + 0.0008 * i, 35.003 + 0.0005 * i,
            1.35 + 0.15 * i, 0.46 + 0.03 * i, 51.0 + 11 * i,
        )
        for i in range(8)
    ]
    names = "entity_id string, second bigint, t string, tie bigint, label int, lon double, lat double, speed double, depth double, heading double"
    return spark.createDataFrame(rows, names).withColumn("frame_time", coerce.to_time("t")).drop("t")


def test_demo_features(demo):
    rows = features.segment_features(demo, ORDER, 1.0).orderBy("second").collect()
    assert list(rows[0].asDict())[-36:] == FEATURE_NAMES
    assert [round(r.acceleration, 9) for r in rows] == [0] + [0.15] * 7
    assert [r.angle_diff for r in rows] == [0] + [11] * 7
    assert [r.angular_acceleration for r in rows] == [0, 11] + [0] * 6
    assert [round(r.jerk, 9) for r in rows] == [0, 0.15] + [0] * 6
    assert rows[4].speed_med_5 == pytest.approx(1.65)
    assert rows[7].speed_std_20 == pytest.approx(0.34369318)


def test_demo_anchors_and_windows(demo):
    assert anchors.fixed_anchors(demo, ORDER, 1.0, 1).count() == 8
    assert [r.second for r in anchors.fixed_anchors(demo, ORDER, 1.0, 3).orderBy("second").collect()] == [0, 3, 6, 7]
    assert anchors.consecutive_windows(demo, ORDER, 4, ["second"]).count() == 5
    w = anchors.build_windows(demo, ORDER, 4, ["second"], stride=3).orderBy("second").collect()
    assert [[x.second for x in r.window] for r in w] == [[0, 0, 0, 0], [0, 1, 2, 3], [3, 4, 5, 6], [4, 5, 6, 7]]
    long = one(anchors.build_windows(demo, ORDER, 20, ["second"], "centered", stride=100).where("second = 7"))
    assert [x.second for x in long.window] == [0] * 4 + list(range(1, 8)) + [7] * 9
    run = one(segments.behaviour_runs(demo, ORDER))
    assert (run.class_id, run.rows, run.duration_seconds) == (3, 8, 8)


def test_row_level_statistics(demo):
    got = {r.feature: r for r in stats.feature_stats(demo, ["lon", "lat", "speed", "depth", "heading"]).collect()}
    # The published statistics of these eight rows.
    mean = {"lon": 120.0088, "lat": 35.00475, "speed": 1.875, "depth": 0.565, "heading": 89.5}
    std = {"lon": 0.00183303, "lat": 0.00114564, "speed": 0.34369318, "depth": 0.06873864, "heading": 25.20416632}
    for f in mean:
        assert got[f].mean == pytest.approx(mean[f])
        assert got[f].std == pytest.approx(std[f], rel=1e-5)


def test_constant_feature_gets_unit_std(demo):
    flat = demo.withColumn("speed", F.lit(2.5))
    table = stats.feature_stats(flat, ["speed"])
    assert one(table).std == 1.0
    assert {r.speed for r in stats.normalise(flat, table, ["speed"]).collect()} == {0.0}


def test_recommended_sampling_golden(spark):
    # Class, median, p75 -> window, stride of the published configuration.
    golden = [
        (0, 6.0, 9.0, 18, 2), (1, 3.0, 5.0, 16, 1), (2, 5.0, 7.0, 16, 2), (3, 24.0, 49.0, 98, 6), (4, 7.0, 13.0, 26, 2),
        (5, 8.0, 13.0, 26, 2), (6, 6.0, 9.0, 18, 2), (7, 4.0, 14.25, 29, 1), (8, 10.0, 23.0, 46, 3),
        (9, 12.0, 22.0, 44, 3), (10, 22.0, 29.0, 58, 6),
    ]
    df = spark.createDataFrame([g[:3] for g in golden], "class_id int, median double, p75 double")
    got = durations.recommend_sampling(df).orderBy("class_id").collect()
    assert [(r.recommended_window, r.recommended_stride) for r in got] == [g[3:] for g in golden]


def test_durations_of_absent_classes_are_zero(spark):
    runs = spark.createDataFrame([(3, 4), (3, 8), (12, 5)], "class_id int, duration_seconds bigint")
    rows = durations.recommend_sampling(durations.duration_summary(runs)).orderBy("class_id").collect()
    assert len(rows) == 11
    assert (rows[3].segment_count, rows[3].total_seconds, rows[3].median, rows[3].p75) == (2, 12, 6.0, 7.0)
    assert (rows[0].segment_count, rows[0].max, rows[0].recommended_window, rows[0].recommended_stride) == (0, 0.0, 16, 1)


def test_published_scores_golden(spark):
    # Recall, f1 and support per class of the published class-gate model.
    table = [
        (0.8515752, 0.8297469, 3079), (0.40585533, 0.4366893, 1742), (0.6779379, 0.6421633, 1804),
        (0.9525345, 0.95719606, 14579), (0.76782274, 0.6663879, 1038), (0.63227355, 0.60907257, 1667),
        (0.34984985, 0.37610975, 666), (0.93565345, 0.8836015, 5517), (0.6906558, 0.73163235, 5169),
        (0.33163264, 0.3913305, 980), (0.36407766, 0.47619045, 206),
    ]
    df = spark.createDataFrame(table, "recall double, f1 double, support bigint")
    got = one(reports.scale_percent(metrics.scores_from_table(df), ["accuracy", "macro_f1", "weighted_f1"]))
    assert [round(v, 2) for v in got] == [81.36, 63.64, 81.01]


SMOOTHING = {
    "both neighbours agree": ([3, 3, 3, 7, 7, 3, 3], [3] * 7),
    "longer neighbour wins": ([3, 3, 3, 7, 4, 4], [3, 3, 3, 3, 4, 4]),
    "tie takes the larger label": ([3, 3, 7, 4, 4], [3, 3, 4, 4, 4]),
    "only run stays": ([7, 7], [7, 7]),
    "long run stays": ([3, 7, 7, 7, 7, 7, 3], [3, 7, 7, 7, 7, 7, 3]),
}


@pytest.mark.parametrize("case", sorted(SMOOTHING))
def test_smoothing(spark, case):
    before, after = SMOOTHING[case]
    rows = [("v", i, i, p) for i, p in enumerate(before)]
    df = spark.createDataFrame(rows, "entity_id string, second bigint, tie bigint, pred int")
    order = Order(time=None)
    got = smooth_runs(df, order, "pred", [7], 5).orderBy("second").collect()
    assert [r.smoothed for r in got] == after


def test_smoothing_uses_original_runs(spark):
    df = spark.createDataFrame([("v", i, i, p) for i, p in enumerate([1, 1, 7, 9, 2, 2])], "entity_id string, second bigint, tie bigint, pred int")
    got = smooth_runs(df, Order(time=None), "pred", [7, 9], 5).orderBy("second").collect()
    assert [r.smoothed for r in got] == [1, 1, 1, 2, 2, 2]


def test_smoothing_without_classes_changes_nothing(spark):
    df = spark.createDataFrame([("v", 0, 0, 7), ("v", 1, 1, 3)], "entity_id string, second bigint, tie bigint, pred int")
    got = smooth_runs(df, Order(time=None), "pred", [], 5).orderBy("second").collect()
    assert [r.smoothed for r in got] == [7, 3]


def observation(i, **change):
    row = dict(
        frame_path=f"f{i}.jpg", frame_time=f"2024-10-18 08:00:{i:02d}", timestamp_inferred="False", entity_id="a.mp4",
        frame_number=str(i * 25), second=str(i), lon="120.0", lat="35.0", fix_time=f"2024-10-18 08:00:{i:02d}", speed="1.0",
        heading="10", depth="0.5", did="4", label="3", epoch_second=str(1729238400 + i), source_video_path="/v/a.mp4",
        audio_start_second=str(i), audio_duration_seconds="1.0", audio_path=f"{i}.wav", audio_exists="True",
        audio_is_silence_fill="False", row_id=i,
    )
    row.update(change)
    return Row(**row)


@pytest.fixture(scope="module")
def dirty(spark):
    far = "120.001"  # about 91 metres east
    rows = [
        observation(0),
        observation(1, frame_time="soon"),
        observation(2, label="11"),
        observation(3, audio_exists=None),
        observation(4, heading="360"),
        observation(5, heading="-1"),
        observation(6),
        observation(7, second="6"),
        observation(8, frame_path="f6.jpg", second="8"),
        observation(9, second="20"),
        observation(10, second="21", lon=far),
        observation(11, second="23"),
        observation(12, second="24", lon=far, speed=None),
        observation(13, second="25", lon=far, entity_id="b.mp4", source_video_path="/v/b.mp4"),
        observation(14, second="x", label="oops"),
    ]
    return spark.createDataFrame(rows)


def test_clean_rows(dirty):
    order = Order(tie="frame_path")
    kept = sorted(r.row_id for r in clean.clean_rows(dirty, ["row_id"], order).collect())
    assert kept == [0, 4, 6, 9, 11, 12, 13]
    row = one(clean.clean_rows(dirty, ["row_id"], order).where("row_id = 4"))
    assert (row.heading, row.label, row.second, row.date, row.audio_exists) == (0.0, 3, 4, "2024-10-18", True)
    report = {r.measure: r.rows for r in clean.clean_report(dirty, ["row_id"], order).collect()}
    assert report == {
        "source_rows": 15, "dropped_missing_required": 1, "dropped_invalid_label": 2, "dropped_missing_audio": 1,
        "normalized_heading_360_to_0": 1, "dropped_invalid_heading": 1, "dropped_duplicate_entity_second": 1,
        "dropped_duplicate_frame_path": 1, "dropped_extreme_motion_rows": 1, "clean_rows": 7,
    }


def test_required_columns_are_named(demo):
    with pytest.raises(ValueError, match=r"\['aaa', 'zzz'\]"):
        require_columns(demo, ["zzz", "second", "aaa"])


def test_unassigned_date_fails(demo):
    dated = demo.withColumn("date", coerce.day("frame_time"))
    with pytest.raises(Exception, match="unassigned date: 2024-10-18"):
        align.assign_split(dated, {"train": ["2024-10-19"]}).collect()
    both = {"train": ["2024-10-18"], "test": ["2024-10-18"]}
    assert {r.split for r in align.assign_split(dated, both).collect()} == {"test"}


def test_overlay_keeps_missing_values(spark):
    left = spark.createDataFrame([(1, 5.0, "keep"), (2, 6.0, "gone")], "epoch_second bigint, speed double, name string")
    right = spark.createDataFrame([(1, None), (3, 7.0)], "epoch_second bigint, speed double")
    row = one(align.overlay(left, right, ["epoch_second"], ["epoch_second", "speed"]))
    assert (row.epoch_second, row.speed, row.name) == (1, None, "keep")


def test_missing_class_counts_as_one(spark):
    df = spark.createDataFrame([(0,)] * 4, "label int")
    rows = stats.class_weights(df, power=0.5).orderBy("class_id").collect()
    assert sum(r.weight for r in rows) == pytest.approx(11)
    assert rows[0].weight * 2 == pytest.approx(rows[1].weight)
    assert [r.rows for r in rows] == [4] + [0] * 10


def test_metrics_of_empty_input(spark):
    df = spark.createDataFrame([], "y_true int, y_pred int")
    assert one(metrics.f1_scores(metrics.per_class_metrics(df))).asDict() == {"macro_f1": 0.0, "weighted_f1": 0.0}
    assert one(metrics.accuracy(df)).accuracy == 0.0
    assert metrics.confusion_matrix(df).agg(F.sum("rows"), F.count("*")).first()[:] == (0, 121)


def test_macro_f1_counts_present_classes_only(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "y_true int, y_pred int")
    assert one(metrics.f1_scores(metrics.per_class_metrics(df))).macro_f1 == pytest.approx((2 / 3 + 0) / 2)


def test_scalar_rules(spark):
    row = one(
        spark.range(1).select(
            scalar.circular(F.lit(180.0)).alias("half"),
            scalar.circular(F.lit(-350.0)).alias("back"),
            scalar.clip(F.lit(None).cast("double"), 0.0, 1.0).alias("none"),
            scalar.linspace(F.lit(-8), F.lit(8), 5).alias("lin"),
            scalar.linspace(F.lit(-8), F.lit(8), 1).alias("lin1"),
            frames.slots_uniform(F.lit(10), 4).alias("uniform"),
            scalar.stem(F.lit("/a/b.c/d.tar.gz")).alias("stem"),
            scalar.stem(F.lit("/a/.hidden")).alias("hidden"),
            scalar.relative_to(F.lit("/data/x/y"), "/data/").alias("rel"),
            scalar.clip_name(F.lit(12)).alias("clip"),
            scalar.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("arg"),
            scalar.date_in_name(F.lit("part_2024-10-18_a.csv")).alias("date"),
            scalar.date_in_name(F.lit("part.csv")).alias("no_date"),
            coerce.to_number(F.lit("NaN")).alias("nan"),
            coerce.to_label(F.lit("4.7")).alias("label"),
            coerce.to_label(F.lit("x")).alias("bad_label"),
        )
    )
    assert row.asDict() == {
        "half": -180.0, "back": 10.0, "none": None, "lin": [-8.0, -4.0, 0.0, 4.0, 8.0], "lin1": [-8.0], "uniform": [0, 3, 6, 9],
        "stem": "d.tar", "hidden": ".hidden", "rel": "x/y", "clip": "000012.wav", "arg": 1, "date": "2024-10-18", "no_date": None,
        "nan": None, "label": 4, "bad_label": -1,
    }


@pytest.mark.parametrize("n, sizes", [(1, (1, 0, 0)), (2, (1, 0, 1)), (3, (2, 0, 1)), (7, (4, 1, 2)), (20, (14, 3, 3))])
def test_small_split_sizes(spark, n, sizes):
    rows = splits.small_split(spark.range(n), ["id"]).groupBy("split").count().collect()
    got = {r.split: r["count"] for r in rows}
    assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == sizes


def test_entity_split_is_a_partition(spark):
    df = spark.range(400).select((F.col("id") % 100).alias("entity_id"), (F.col("id") % 3).cast("int").alias("label"))
    got = splits.stratified_entity_split(df)
    assert got.count() == got.select("entity_id").distinct().count() == 100
    assert {r.split for r in got.collect()} == {"train", "val", "test"}


def test_few_entities_split_by_sample(spark):
    df = spark.range(40).select("id", (F.col("id") % 2).alias("entity_id"), F.lit(1).alias("label"))
    counts = {r.split: r["count"] for r in splits.split_windows(df, ["id"]).groupBy("split").count().collect()}
    assert counts == {"train": 28, "val": 6, "test": 6}


def test_weighted_resample(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") < 1000, 10.0).otherwise(1.0).alias("weight"))
    drawn = splits.weighted_resample(df, ["id"])
    assert drawn.count() == drawn.select("draw").distinct().count() == 6000
    heavy = drawn.where("id < 1000").count() / 6000
    assert heavy == pytest.approx(10 / 15, abs=0.03)
    again = {r.id for r in splits.weighted_resample(df.repartition(7), ["id"]).collect()}
    assert again == {r.id for r in drawn.collect()}


def test_resample_gives_every_draw_once_whatever_the_weights(spark, monkeypatch):
    monkeypatch.setattr(splits, "BUCKET_ROWS", 64)
    # Many last weights far below rounding of the running total, zeros, missing ones, and one that takes a third of all draws.
    weight = F.expr("CASE WHEN id = 7 THEN 1e6 WHEN id % 5 = 0 THEN 0D WHEN id % 7 = 0 THEN NULL WHEN id < 1000 THEN 2e3 ELSE 1e-13 END")
    df = spark.range(3000).select("id", weight.alias("weight"), F.lit("x").alias("row"))
    drawn = splits.weighted_resample(df, ["id"])
    assert drawn.columns == ["id", "weight", "row", "draw"]
    rows = drawn.collect()
    assert len(rows) == len({r.draw for r in rows}) == 3000
    assert all(r.weight for r in rows)
    share = 1e6 / (1e6 + 2e3 * df.where("weight = 2e3").count())
    assert sum(r.id == 7 for r in rows) == pytest.approx(3000 * share, abs=1)
    again = splits.weighted_resample(df.repartition(5), ["id"]).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert splits.weighted_resample(df.where("weight = 0"), ["id"]).count() == 0
    assert splits.weighted_resample(df.where("false"), ["id"]).count() == 0


def test_allotted_shares_are_within_one_draw(spark):
    units = spark.range(1, 400).selectExpr("concat('b', lpad(hex(id), 3, '0')) AS unit", "1D / id AS w")
    total = sum(1 / i for i in range(1, 400))
    shares = {r["unit"]: r["draws"] for r in splits.allotted(units, 100_000, total, 0.3, 3).collect()}
    assert sum(shares.values()) == 100_000
    assert all(abs(shares[f"b{i:03X}"] - 100_000 / i / total) < 1 + 1e-6 for i in range(1, 400))


def test_frame_dropout_never_drops_everything(spark):
    df = spark.range(300).select("id", F.array(*map(F.lit, "abcde")).alias("frames"))
    rows = frames.frame_dropout(df, 0.95, ["id"]).collect()
    assert all(len(r.frames) == 5 and r.frames[4] == "e" for r in rows)
    assert any(r.frames != list("abcde") for r in rows)
    assert frames.frame_dropout(df, 0.0, ["id"]).where(F.array_join("frames", "") != "abcde").count() == 0


def wav(rate, channels, samples):
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as clip:
        clip.setnchannels(channels)
        clip.setsampwidth(2)
        clip.setframerate(rate)
        clip.writeframes(np.asarray(samples, dtype="<i2").tobytes())
    return buffer.getvalue()


def test_waveforms_from_files(spark, tmp_path):
    folder = tmp_path / "clips" / "a"
    folder.mkdir(parents=True)
    (folder / "000001.wav").write_bytes(wav(4, 2, [16384, 0, -16384, 0]))
    (folder / "000002.wav").write_bytes(wav(4, 1, [16384] * 6))
    rows = spark.createDataFrame([("a/000001.wav",), ("a/000002.wav",), ("a/none.wav",)], "audio_path string")
    got = {r.audio_path: r.waveform for r in readers.read_waveforms(rows, str(tmp_path / "clips"), sample_rate=4).collect()}
    assert got == {"a/000001.wav": [0.25, -0.25, 0, 0], "a/000002.wav": [0.5] * 4, "a/none.wav": None}


def test_inventory_prefers_the_first_suffix(spark, tmp_path):
    for name in ("b/x.MP4", "a/x.mp4", "c/x.mp4", "c/y.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    got = readers.asset_inventory(spark, str(tmp_path), [".mp4", ".MP4"]).collect()
    assert sorted((r.name, r.path.rsplit("/", 2)[1]) for r in got) == [("x.MP4", "b"), ("x.mp4", "a")]


def test_aligned_file_with_byte_order_mark(spark, tmp_path):
    text = "﻿frame_path,frame_time,video_file,second_in_video,分类,经度,纬度,速度,深度,方向角\n"
    text += "a.ppm,2024-10-18 08:00:00,v.mp4,0,3,120.0,35.0,bad,0.5,51\n"
    (tmp_path / "train.csv").write_text(text, encoding="utf-8")
    row = one(readers.read_aligned(spark, str(tmp_path / "train.csv")))
    assert (row.frame_path, row.entity_id, row.second, row.label, row.speed) == ("a.ppm", "v.mp4", 0, 3, 0.0)


def test_parts_by_file_name(spark, tmp_path):
    head = "时间,方向,标记,经度,纬度,速度\n"
    (tmp_path / "p_2024-10-18_1.csv").write_text(head + "2024-10-18 08:00:01,9,x,1,2,3\n2024-10-18 08:00:01,8,4,1,2,4\nnever,1,1,1,1,1\n", encoding="utf-8")
    (tmp_path / "p_undated.csv").write_text(head + "2024-10-18 08:00:02,9,4,1,2,3\n", encoding="utf-8")
    row = one(readers.read_parts(spark, str(tmp_path / "*.csv")))
    assert (row.date, row.epoch_second, row.speed, row.label, row.depth, row.did) == ("2024-10-18", 1729238401, 3.0, -1, None, None)


def test_work_folder_follows_the_session(spark):
    class Context:
        applicationId = "app-1"

        def __init__(self, master):
            self.master = master

    class Session:
        def __init__(self, master, **settings):
            self.conf, self.sparkContext = settings, Context(master)

    named = Session("yarn", **{"spark.checkpoint.dir": "/shared/place/"})
    assert writers.work_folder(named).startswith("/shared/place/fieldtrace-app-1/")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            writers.work_folder(Session(master))
    assert "fieldtrace-" in writers.work_folder(Session("local[2]"))
    assert writers.work_folder(spark) != writers.work_folder(spark)
