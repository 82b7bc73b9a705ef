"""The end-to-end plans on the test tables."""

from dataclasses import replace

from pyspark.sql import functions as F

from fieldtrace.operators.clean import MOTION_ORDER
from fieldtrace.operators.metrics import per_class_metrics
from fieldtrace.plans import evaluation, prepare, training
from fieldtrace.registry.views import DAYS, ORDER, observations, track
from fieldtrace.schema import ANCHOR_COLUMNS, FEATURE_NAMES, NUM_CLASSES

SF = "/root/testdata/sf0.001"


def test_prepare(spark, tmp_path):
    rows = observations(spark, SF)
    splits = {"train": ["2024-01-01"], "test": DAYS}
    order = replace(MOTION_ORDER, hot_rows=50)
    dataset, cleaning = prepare.cleaned_dataset(rows, splits, ["tie"], order=order)
    assert dataset.columns == [*ANCHOR_COLUMNS, "date"]
    prepare.write_dataset(dataset, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out" / "splits"))
    assert back.count() == dataset.count() > 0
    report = prepare.dataset_report(dataset, cleaning)
    clean_rows = report["clean"].where("measure = 'clean_rows'").first().rows
    assert clean_rows == dataset.count()
    total = report["splits"].where("split = 'all'").first()
    assert total.rows == clean_rows
    assert report["classes"].where("split = 'all'").agg(F.sum("rows")).first()[0] == clean_rows


def test_training_samples(spark):
    s = training.Sampling(length=5, stride=3, max_gap=12)
    features = training.feature_rows(track(spark, SF), ORDER, s)
    stats = training.training_stats(features, ORDER, s)
    train = training.samples(features, stats, ORDER, s, train=True)
    dense = training.samples(features, stats, ORDER, s, train=False)
    assert dense.count() == features.count() > train.count() > 0
    # Normalising with the window-weighted statistics centres the training windows' slots.
    means = train.select(F.explode("window").alias("r")).agg(*(F.avg(f"r.{f}").alias(f) for f in FEATURE_NAMES)).first()
    assert all(abs(v) < 1e-4 for v in means)


def test_adaptive_samples_use_the_duration_report(spark):
    rows = track(spark, SF)
    s = training.Sampling(length=4, max_gap=48, adaptive=True)
    features = training.feature_rows(rows, ORDER, s)
    stats = training.training_stats(features, ORDER, s)
    config = training.duration_report(rows, ORDER, 48).selectExpr("class_id", "recommended_stride AS stride")
    train = training.samples(features, stats, ORDER, s, train=True, config=config)
    assert 0 < train.count() <= rows.count()


def test_evaluation(spark):
    rows = track(spark, SF).withColumnsRenamed({"label": "y_true", "pred": "y_pred_raw"})
    scored = evaluation.evaluated(rows, ORDER, [0, 3, 7])
    assert scored.count() == rows.count()
    changed = scored.where("y_pred <> y_pred_raw")
    assert changed.where(~F.col("y_pred_raw").isin(0, 3, 7)).count() == 0
    out = evaluation.report(scored)
    raw = scored.where("y_true = y_pred_raw").count() / scored.count()
    assert abs(out["accuracy"].first().accuracy_raw - raw) < 1e-12
    assert out["confusion"].agg(F.sum("rows")).first()[0] == rows.count()
    tables = {m: per_class_metrics(scored, "y_true", c) for m, c in (("a", "y_pred_raw"), ("b", "y_pred"))}
    table = evaluation.comparison(tables, "b", "a", ["a"])
    assert table.count() == NUM_CLASSES
    assert table.where("abs(gain - delta) > 1e-9").count() == 0
