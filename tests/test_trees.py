"""Compiled ensembles against the fitted models and against another engine."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor

from skysift.plans import forecast, trees

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = [(i, rng.uniform(-5, 5), float(rng.randrange(4)), rng.gauss(0, 1)) for i in range(600)]
    return spark.createDataFrame([(*r, r[1] * r[2] + abs(r[3])) for r in rows], "id long, a double, b double, c double, label double").cache()


def fitted(table, model):
    return Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="features"), model]).fit(table)


MODELS = {
    "boosted": lambda: GBTRegressor(maxIter=30, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, seed=1, predictionCol="p"),
    "one tree": lambda: DecisionTreeRegressor(maxDepth=5, predictionCol="p"),
    "forest": lambda: RandomForestRegressor(numTrees=8, seed=1, predictionCol="p"),
}


def near(a, b):
    return abs(a - b) <= 1e-12 * max(1, abs(a))


@pytest.mark.parametrize("kind", MODELS)
def test_equals_the_fitted_model(table, kind):
    model = fitted(table, MODELS[kind]())
    both = trees.with_prediction(model.transform(table), trees.ensemble(model), "q").select("p", "q").collect()
    assert len({r.p for r in both}) > 10
    assert all(near(r.p, r.q) for r in both)
    if kind == "one tree":
        assert all(r.p == r.q for r in both)


def test_sql_equals_the_columns(table):
    found = trees.ensemble(fitted(table, MODELS["boosted"]()))
    rows = [(r.a, r.b, r.c, r.q) for r in trees.with_prediction(table, found, "q").collect()]
    db = duckdb.connect()
    db.execute("CREATE TABLE t (a DOUBLE, b DOUBLE, c DOUBLE, q DOUBLE)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    got = db.execute(f"SELECT q, {trees.prediction_sql(found)} FROM t").fetchall()
    assert all(p == q for p, q in got)


def test_edges_of_a_split(spark):
    tree = trees.Split("x", 1.5, trees.Leaf(1.0), trees.Leaf(2.0))
    found = trees.Ensemble((tree, trees.Leaf(10.0)), (1.0, 0.5))
    df = spark.createDataFrame([(1.5,), (1.5000001,), (None,), (float("nan"),), (float("-inf"),)], "x double")
    assert [r.p for r in trees.with_prediction(df, found, "p").collect()] == [6.0, 7.0, 7.0, 7.0, 6.0]
    assert found.features() == {"x"}
    assert trees.nodes(found) == [(0, 1, "x", 1.5), (0, 2, None, 1.0), (0, 3, None, 2.0), (1, 1, None, 10.0)]


def test_other_pipelines_are_refused(table):
    model = fitted(table, MODELS["one tree"]())
    with pytest.raises(ValueError):
        trees.ensemble(PipelineModel(model.stages[1:]))


def test_forecast_scores_alike(spark):
    rng = random.Random(6)
    start = datetime(2024, 1, 1)
    rows = [
        (i, start + timedelta(seconds=30 * i), rng.choice("xy"), round(rng.uniform(0, 300), 2), 1.0, round(rng.uniform(0, 9), 1), 3.0, 0.5, 4.0, "Low", "s", rng.random() < 0.8)
        for i in range(300)
    ]
    schema = "event_id long, event_time timestamp, city string, pm25 double, pm10 double, no2 double, o3 double, co double, so2 double, traffic string, source string, is_real boolean"
    table = spark.createDataFrame(rows, schema)
    model = forecast.train(table, trees=25).model
    compiled = trees.ensemble(model)
    for score in (lambda m: forecast.score_history(table, m), lambda m: forecast.score_reading(table, m)):
        by_model = {r.event_id: r.prediction for r in score(model).collect()}
        assert by_model and by_model == {r.event_id: r.prediction for r in score(compiled).collect()}
