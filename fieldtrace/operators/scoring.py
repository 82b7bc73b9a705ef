"""Turning logits or features into predictions."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrace.functions.scalar import argmax, array_sum, softmax
from fieldtrace.schema import FEATURE_NAMES, NUM_CLASSES
from fieldtrace.sources.writers import work_folder


def late_fusion(df: DataFrame, logits: list[Column], gates: Column, k: int = NUM_CLASSES) -> DataFrame:
    """Add fused (per class the gate-weighted sum of the modalities' logits) and y_pred, its argmax.

    ``gates`` is a flat array, class by class, of one score per modality; each class has its own softmax.
    """
    m = len(logits)
    staged = df.withColumns({f"_l{i}": lg for i, lg in enumerate(logits)})
    staged = staged.withColumn("_gates", gates)
    per_class = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.slice("_gates", c * m + 1, F.lit(m)))
    staged = staged.withColumn("_shares", F.transform(per_class, softmax))
    votes = F.array(*(F.col(f"_l{i}") for i in range(m)))
    fused = F.transform(
        "_shares",
        lambda share, c: array_sum(F.zip_with(share, F.transform(votes, lambda v: F.get(v, c)), lambda g, x: g * x)),
    )
    staged = staged.withColumn("fused", fused).drop("_gates", "_shares", *(f"_l{i}" for i in range(m)))
    return staged.withColumn("y_pred", argmax(F.col("fused")))


def join_predictions(anchors: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Anchor rows with their predictions and whether they are right."""
    return anchors.join(predictions, keys).withColumn("correct", F.col("y_true") == F.col("y_pred"))


def ship_model(model: DataFrame) -> str:
    """Stores a fitted model's table (class_id, vector: array<double>, bias) and sends it along with the job; gives its name.

    The file lies in the shared work folder; Spark brings it to every worker once. A model has a row per class. The one
    file is sent, not its folder: a cluster takes no local folders.
    """
    spark, path = model.sparkSession, work_folder(model.sparkSession)
    rows = F.sort_array(F.collect_list(F.struct("class_id", "vector", "bias")))
    model.agg(F.to_json(rows).alias("value")).coalesce(1).write.text(path)
    file = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").first()["path"]
    spark.sparkContext.addFile(file)
    return file.rsplit("/", 1)[1]


def load_linear(name: str) -> Callable[[np.ndarray], np.ndarray]:
    """Reads a shipped model: inputs (n, d) -> the class of the largest vector . input + bias, the smallest id on ties."""
    rows = json.loads(Path(SparkFiles.get(name)).read_text())
    ids = np.array([r["class_id"] for r in rows], dtype=np.int32)
    vectors, bias = np.array([r["vector"] for r in rows], dtype=np.float64), np.array([r["bias"] for r in rows], dtype=np.float64)
    return lambda inputs: ids[(inputs.astype(np.float64) @ vectors.T + bias).argmax(axis=1)]


def centroids(samples: DataFrame, inputs: str, label: str = "label") -> DataFrame:
    """A nearest-mean classifier as a linear model: per class the mean of ``inputs``, and less half its square as bias."""
    flat = samples.where(F.col(label).isNotNull()).select(label, F.posexplode(inputs).alias("i", "x"))
    means = flat.groupBy(label, "i").agg(F.avg("x").alias("m"))
    packed = means.groupBy(F.col(label).alias("class_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector"))
    return packed.withColumn("bias", -array_sum(F.transform("vector", lambda x: x * x)) / 2)


def batch_score(
    samples: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], inputs: str, size: int, name: str = "y_pred", batch_size: int = 4096
) -> DataFrame:
    """Adds the integer prediction of a loaded model for ``inputs``, arrays of ``size`` numbers; NULL for NULL arrays.

    ``load`` runs once in each worker and returns the predictor, which gets up to ``batch_size`` rows at a time as a
    matrix. Only the inputs cross over to Python and only the predictions come back.
    """
    from pyspark.ml.functions import predict_batch_udf

    predict = predict_batch_udf(load, return_type=T.IntegerType(), batch_size=batch_size, input_tensor_shapes=[[size]])
    # The predictor wants whole matrices: rows without inputs get zeros, whose prediction is dropped.
    filled = F.coalesce(F.col(inputs).cast("array<double>"), F.array_repeat(F.lit(0.0), size))
    return samples.withColumn(name, F.when(F.col(inputs).isNotNull(), predict(filled)))


def baseline_classifier(
    train: DataFrame,
    score: DataFrame,
    features: list[str] = FEATURE_NAMES,
    label: str = "label",
    weight: str | None = None,
    max_iter: int = 20,
):
    """Fit a multinomial logistic regression on the anchors' features and add y_pred to ``score``.

    Training is eager (it is a sequence of Spark jobs); scoring is lazy.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    assemble = VectorAssembler(inputCols=features, outputCol="_features")
    model = LogisticRegression(
        featuresCol="_features", labelCol=label, predictionCol="_prediction", maxIter=max_iter,
        **({"weightCol": weight} if weight else {}),
    ).fit(assemble.transform(train))
    scored = model.transform(assemble.transform(score))
    return scored.withColumn("y_pred", F.col("_prediction").cast("int")).drop(
        "_features", "_prediction", "rawPrediction", "probability"
    )
