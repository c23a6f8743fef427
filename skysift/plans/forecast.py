"""Gradient-boosted forecast: split, fit, evaluate, save, load, score."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.functions.scoring import clamp_prediction
from skysift.operators.features import FEATURES, real_features, single_features, training_set
from skysift.plans.trees import Ensemble, with_prediction
from skysift.session import shared_folder, staged
from skysift.sources import files

SEED = 42
TRAIN_SHARE = 80


class Fitted(NamedTuple):
    model: PipelineModel
    rmse: float
    test_rows: int


def split(rows: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """80/20 by a hash of the row's identity: the same rows however they are partitioned."""
    identity = [c for c in ("city", "event_time", "event_id") if c in rows.columns]
    bucket = F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(100))
    return rows.filter(bucket < TRAIN_SHARE), rows.filter(bucket >= TRAIN_SHARE)


def pipeline(trees: int = 200, rate: float = 0.05, depth: int = 4, subsample: float = 0.8, seed: int = SEED) -> Pipeline:
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    boosted = GBTRegressor(
        featuresCol="features",
        labelCol="label",
        predictionCol="raw_prediction",
        maxIter=trees,
        stepSize=rate,
        maxDepth=depth,
        subsamplingRate=subsample,
        seed=seed,
    )
    return Pipeline(stages=[assembler, boosted])


def rmse(scored: DataFrame) -> float:
    return RegressionEvaluator(predictionCol="raw_prediction", labelCol="label", metricName="rmse").evaluate(scored)


def train(readings: DataFrame, label: str = "trend", **settings) -> Fitted:
    """Fit on the training share and measure the error on the rest.

    The training set is written once: every tree reads it, none recomputes it.
    """
    shared_folder(readings.sparkSession)
    rows = staged(training_set(readings, label), "training")
    fit_rows, test_rows = split(rows)
    model = pipeline(**settings).fit(fit_rows)
    scored = model.transform(test_rows).select("label", "raw_prediction")
    return Fitted(model, rmse(scored), scored.count())


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_or_train(spark: SparkSession, path: str, readings: DataFrame, **settings) -> PipelineModel:
    if not files.exists(spark, path):
        save(train(readings, **settings).model, path)
    return PipelineModel.load(path)


def history_features(readings: DataFrame) -> DataFrame:
    """What ``score_history`` scores, written once for several models."""
    shared_folder(readings.sparkSession)
    return staged(real_features(readings), "history")


def score_history(readings: DataFrame, model: PipelineModel | Ensemble, rows: DataFrame | None = None) -> DataFrame:
    """Predict after each real reading of a warmed-up city, from its last twelve real readings.

    ``rows``: the ``history_features`` of these readings, where they are at hand.
    """
    return _scored(real_features(readings) if rows is None else rows, model).drop(*FEATURES)


def score_reading(df: DataFrame, model: PipelineModel | Ensemble | None) -> DataFrame:
    """Add ``prediction`` from each reading alone; null without a model."""
    if model is None:
        return df.withColumn("prediction", F.lit(None).cast("double"))
    return _scored(single_features(df), model).drop(*FEATURES)


def _scored(df: DataFrame, model: PipelineModel | Ensemble) -> DataFrame:
    raw = with_prediction(df, model, "raw_prediction") if isinstance(model, Ensemble) else model.transform(df)
    return raw.withColumn("prediction", clamp_prediction(F.col("raw_prediction"))).drop("features", "raw_prediction")
