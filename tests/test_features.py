import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skysift.operators import features, gaps
from skysift.plans import enrich, forecast, trees
from tests import model

START = datetime(2024, 1, 1)
SCHEMA = (
    "event_id long, event_time timestamp, city string, pm25 double, pm10 double, no2 double, o3 double,"
    " co double, so2 double, traffic string, source string, is_real boolean"
)


def rows(cities=("a", "b"), n=60, seed=3):
    rng = random.Random(seed)
    out = []
    for city in cities:
        for i in range(n):
            values = [round(rng.uniform(0, 300), 2) for _ in range(6)]
            time = START + timedelta(seconds=60 * i + rng.randrange(0, 50))
            out.append((len(out), time, city, *values, "Low", "s", rng.random() < 0.7))
    return out


@pytest.fixture(scope="module")
def data(spark):
    return rows(), spark.createDataFrame(rows(), SCHEMA).persist()


def expected_features(past):
    """Feature values of the last row of ``past`` (rows of one city, oldest first)."""
    recent = past[-12:]
    out = {}
    for offset, name in enumerate(features.MEASURES):
        values = [r[3 + offset] for r in recent]
        mean = sum(values) / len(values)
        out[f"{name}_mean"] = mean
        out[f"{name}_std"] = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
        out[f"{name}_last"] = values[-1]
        out[f"{name}_step"] = sum(b - a for a, b in zip(values, values[1:])) / (len(values) - 1)
    for back in range(3):
        out[f"pm25_t{back}"] = past[-1 - back][3]
    angle = past[-1][1].hour / 24 * 2 * math.pi
    return {**out, "hour_sin": math.sin(angle), "hour_cos": math.cos(angle)}


def by_city(all_rows):
    return {c: sorted((r for r in all_rows if r[2] == c), key=lambda r: (r[1], r[0])) for c in ("a", "b")}


@pytest.mark.parametrize("limit", [None, 8])
def test_features_match_brute_force(data, small_segments, limit):
    source, df = data
    if limit:
        small_segments(limit)
    got = {r.event_id: r for r in features.window_features(df).collect()}
    assert len(features.FEATURES) == 25
    wanted = {}
    for past in by_city(source).values():
        for i in range(2, len(past)):
            wanted[past[i][0]] = expected_features(past[: i + 1])
    assert set(got) == set(wanted)
    for key, values in wanted.items():
        for name, value in values.items():
            assert math.isclose(got[key][name], value, rel_tol=1e-9, abs_tol=1e-6)


@pytest.mark.parametrize("limit", [None, 12])
def test_labels_match_brute_force(data, small_segments, limit):
    source, df = data
    if limit:
        small_segments(limit)
    trend, seen = {}, {}
    for past in by_city(source).values():
        for i in range(23, len(past)):
            slope = (past[i][3] - past[i - 5][3]) / 5
            trend[past[i][0]] = model.index(max(0.0, past[i][3] + 12 * slope))
            if i + 12 < len(past):
                seen[past[i][0]] = model.index(past[i + 12][3])
    for kind, wanted in (("trend", trend), ("observed", seen)):
        out = features.training_set(df, kind).collect()
        assert {r.event_id for r in out} == set(wanted)
        assert all(math.isclose(r.label, wanted[r.event_id], abs_tol=1e-9) for r in out)
        sample = next(r for r in out if r.city == "b")
        past = [r for r in by_city(source)["b"] if (r[1], r[0]) <= (sample.event_time, sample.event_id)]
        assert math.isclose(sample.pm10_std, expected_features(past)["pm10_std"], abs_tol=1e-6)
    with pytest.raises(ValueError):
        features.training_set(df, "other")


def test_warm_up_counts_real_readings(data):
    source, df = data
    got = {r.event_id: r.ready for r in features.warmed_up(df).collect()}
    for past in by_city(source).values():
        real = 0
        for r in past:
            real += r[11]
            assert got[r[0]] == (real >= 12)
    assert len(got) == len(source)


def test_real_features_skip_other_readings(data):
    source, df = data
    ids = {r.event_id for r in features.real_features(df).collect()}
    wanted = set()
    for past in by_city(source).values():
        wanted |= {r[0] for r in [r for r in past if r[11]][11:]}
    assert ids == wanted


def test_single_reading_features(spark):
    df = spark.createDataFrame([(1, None, "a", 4.0, None, 1.0, 2.0, 3.0, None, "Low", "s", True)], SCHEMA)
    got = features.single_features(df).first()
    assert (got.pm25_mean, got.pm25_std, got.pm25_last, got.pm25_step, got.pm25_t2) == (4.0, 0.0, 4.0, 0.0, 4.0)
    assert (got.pm10_mean, got.hour_sin, got.hour_cos) == (0.0, 0.0, 1.0)


def test_gap_fill(spark):
    def at(i, seconds, pm25, real, city="a"):
        return (i, START + timedelta(seconds=seconds), city, pm25, 1.0, 1.0, 1.0, 1.0, 1.0, "Low", "s", real)

    data = [at(1, 3, 5.0, True), at(2, 25, 99.0, False), at(3, 40, 7.0, True), at(4, 41, 8.0, True), at(5, 0, 1.0, True, "b")]
    got = gaps.fill_gaps(spark.createDataFrame(data, SCHEMA)).orderBy("event_time").collect()
    assert [(r.city, r.event_time.second, r.pm25, r.source, r.is_real) for r in got] == [
        ("a", s, 5.0, "Interpolated", False) for s in (10, 20, 30)
    ]


def test_split_is_stable(data):
    _, df = data
    rows = features.training_set(df)
    fit, test = forecast.split(rows)
    again, _ = forecast.split(rows.repartition(7, "event_id"))
    assert fit.count() + test.count() == rows.count() and 0 < test.count() < fit.count()
    assert fit.select("event_id").exceptAll(again.select("event_id")).isEmpty()


def test_train_save_load_score(data, spark, tmp_path):
    _, df = data
    fitted = forecast.train(df, trees=3)
    assert fitted.rmse > 0 and fitted.test_rows > 0
    path = str(tmp_path / "model")
    forecast.save(fitted.model, path)
    model_again = forecast.load_or_train(spark, path, df)
    scored = forecast.score_history(df, model_again)
    assert scored.filter("prediction < 0 or prediction > 500 or prediction is null").isEmpty()
    assert scored.count() == features.real_features(df).count()

    single = forecast.score_reading(df, fitted.model)
    records = enrich.enrich_readings(single, F.col("prediction"), ["event_id"])
    check = records.join(single.select("event_id", "prediction"), "event_id")
    assert check.filter("next_hour_aqi <> prediction").isEmpty()
    none = enrich.enrich_readings(forecast.score_reading(df, None), F.col("prediction"))
    assert none.filter("next_hour_aqi <> aqi").isEmpty()


def test_trains_when_no_model_is_stored(data, spark, tmp_path):
    _, df = data
    path = str(tmp_path / "new")
    model_now = forecast.load_or_train(spark, path, df, trees=2)
    assert (tmp_path / "new" / "metadata").exists()
    assert forecast.score_reading(df, model_now).filter("prediction is null").isEmpty()


def test_default_model_settings():
    boosted = forecast.pipeline().getStages()[-1]
    assert (boosted.getMaxIter(), boosted.getStepSize(), boosted.getMaxDepth(), boosted.getSubsamplingRate(), boosted.getSeed()) == (
        200, 0.05, 4, 0.8, 42)


def test_only_means_and_spreads_go_through_the_sliding_frame(data):
    """Numbers and look-backs take one step a row: no other aggregate starts anew at every row."""
    _, df = data
    for rows in (features.window_features(df), features.training_set(df)):
        plan = rows._jdf.queryExecution().analyzed().toString()
        assert plan.count("specifiedwindowframe(RowFrame, -11, currentrow$())") == 2 * len(features.MEASURES)
        assert "specifiedwindowframe(RowFrame, -23, currentrow$())" not in plan


def test_several_models_share_the_features_of_a_history(spark, monkeypatch):
    """The history's features are worked out once, however many models score them."""
    turns = []
    whole = forecast.real_features
    monkeypatch.setattr(forecast, "real_features", lambda rows: turns.append(1) or whole(rows))
    start = datetime(2024, 1, 1)
    rows = [(i, "A", start + timedelta(minutes=i), True, *[float(i % 7 + m) for m in range(6)], "Low", "s") for i in range(20)]
    readings = spark.createDataFrame(
        rows,
        "event_id long, city string, event_time timestamp, is_real boolean, pm25 double, pm10 double, no2 double, o3 double,"
        " co double, so2 double, traffic string, source string",
    )
    found = [trees.Ensemble((trees.Split("pm25_last", 3.0, trees.Leaf(10.0), trees.Leaf(20.0)),), (w,)) for w in (1.0, 2.0)]
    shared = forecast.history_features(readings)
    for model in found:
        got = forecast.score_history(readings, model, shared).collect()
        assert len(turns) == 1
        assert sorted(got) == sorted(forecast.score_history(readings, model).collect()) and len(got) == 9
        turns.pop()
