"""Models loaded by workers, a fit held against a plain one, and dates that choose folders."""

import json
import os

import numpy as np
import pytest
from pyspark import SparkFiles
from pyspark.sql import functions as F

from fieldtrace.operators import align
from fieldtrace.operators import scoring as SC
from fieldtrace.sources.readers import read_by_date
from fieldtrace.sources.writers import write_by_date


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    rng = np.random.default_rng(1)
    means = {2: [0.0, 0.0, 1.0], 5: [4.0, 0.0, 0.0], 9: [0.0, 4.0, 0.0]}
    rows = [(i, k, (rng.normal(0, 0.3, 3) + m).tolist()) for i, (k, m) in enumerate(list(means.items()) * 400)]
    frame = spark.createDataFrame([*rows, (9999, 2, None)], "id long, label int, x array<double>").repartition(24)
    name = SC.ship_model(SC.centroids(frame, "x"))
    log = str(tmp_path)

    def load():
        import tempfile

        tempfile.mkstemp(prefix=f"{os.getpid()}-", dir=log)
        return SC.load_linear(name)

    scored = SC.batch_score(frame, load, "x", 3, batch_size=7)
    got = {r["id"]: r["y_pred"] for r in scored.collect()}
    assert got.pop(9999) is None
    assert got == {i: k for i, k, _ in rows}
    pids = [f.split("-")[0] for f in os.listdir(log)]
    assert pids and len(pids) == len(set(pids))
    assert SC.batch_score(frame.where("false"), load, "x", 3).count() == 0


def test_a_model_is_sent_as_one_file(spark):
    """A cluster refuses local folders."""
    model = spark.createDataFrame([(k, [1.0 * k], 0.0) for k in range(40)], "class_id int, vector array<double>, bias double").repartition(5)
    for some in (model, model.where("false")):
        name = SC.ship_model(some)
        path = SparkFiles.get(name)
        assert os.path.isfile(path)
        with open(path) as file:
            assert [r["class_id"] for r in json.load(file)] == [r["class_id"] for r in some.orderBy("class_id").collect()]


def test_ties_go_to_the_smaller_class(spark):
    model = spark.createDataFrame([(7, [1.0], 0.0), (3, [1.0], 0.0)], "class_id int, vector array<double>, bias double")
    name = SC.ship_model(model)
    rows = spark.createDataFrame([([2.0],)], "x array<double>")
    assert SC.batch_score(rows, lambda: SC.load_linear(name), "x", 1).first()["y_pred"] == 3


def test_baseline_fit_is_as_good_as_a_plain_one(spark):
    """Weighted log loss of the fitted classifier against gradient descent on the same convex loss."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (300, 2))
    y = (x @ np.array([[1.0, -1.0, 0.2], [0.4, 0.8, -1.2]]) + rng.gumbel(0, 1, (300, 3))).argmax(axis=1)
    w = np.where(y == 0, 2.0, 1.0)
    frame = spark.createDataFrame([(*map(float, r), int(k), float(v)) for r, k, v in zip(x, y, w)], "a double, b double, label int, weight double")
    scored = SC.baseline_classifier(frame, frame, ["a", "b"], weight="weight", max_iter=100).select("a", "b", "y_pred").collect()
    theta = np.zeros((3, 3))
    full, hot = np.column_stack([x, np.ones(300)]), np.eye(3)[y]
    for _ in range(4000):
        z = full @ theta
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        theta -= 0.5 * full.T @ ((p - hot) * w[:, None]) / w.sum()
    plain = (full @ theta).argmax(axis=1)
    same = {(r["a"], r["b"]): r["y_pred"] for r in scored}
    agree = np.mean([same[tuple(map(float, r))] == k for r, k in zip(x, plain)])
    assert agree > 0.98


@pytest.fixture(scope="module")
def by_date(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("dates"))
    rows = spark.range(400).select("id", F.date_format(F.expr("date_add(DATE'2024-01-01', CAST(id % 20 AS INT))"), "yyyy-MM-dd").alias("date"))
    write_by_date(rows, path, ["id"])
    return read_by_date(spark, path)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_dates_as_literals_prune_folders(by_date):
    rows = align.on_dates(by_date, "2024-01-03,2024-01-07")
    assert rows.count() == 40
    plan = plan_of(rows)
    assert "PartitionFilters: [date#" in plan and "2024-01-03" in plan


def test_dates_of_a_table_prune_folders_while_running(spark, by_date):
    days = spark.range(20).select(F.expr("date_add(DATE'2024-01-01', CAST(id AS INT))").alias("date"), (F.col("id") * 7 % 20).alias("score"))
    wanted = days.where("score > 16").unionByName(spark.createDataFrame([(None, 99)], "date date, score long"))
    rows = align.on_wanted_dates(by_date, wanted)
    assert rows.count() == 60
    assert "dynamicpruningexpression" in plan_of(rows)
