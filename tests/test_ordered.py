"""Frames dealt over segments must equal whole-city frames on skewed, bursty, tied and untimed data."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skysift.operators import ordered
from skysift.operators.rolling import history_points, with_history, with_history_stats

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, event_time timestamp, city string, aqi double"


def rows_of(kind: str):
    rng = random.Random(7)
    rows, n = [], 0

    def put(city, time):
        nonlocal n
        n += 1
        rows.append((n, time, city, float(rng.randrange(0, 5000)) / 10))

    for _ in range(20):
        put("quiet", START + timedelta(hours=rng.randrange(0, 400)))
    for _ in range(600):
        put("busy", START + timedelta(seconds=rng.randrange(0, 40_000)))
    if kind == "burst":
        for i in range(900):
            put("busy", START + timedelta(seconds=20_000, milliseconds=i))
    if kind == "instant":
        for _ in range(300):
            put("busy", START + timedelta(seconds=20_000))
        for _ in range(150):
            put("stuck", START)
    if kind == "untimed":
        for _ in range(900):
            put("busy", None)
    if kind == "many":
        for i in range(300):
            put(f"c{i % 40}", START + timedelta(seconds=rng.randrange(0, 400)))
    if kind == "sparse":
        for i in range(200):
            put("busy", START + timedelta(days=30 * i))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("kind", ["plain", "burst", "instant", "untimed", "sparse", "many"])
@pytest.mark.parametrize("parts", [3, 12, 70])
def test_segments_equal_whole_city(spark, small_segments, kind, parts):
    df = spark.createDataFrame(rows_of(kind), SCHEMA)
    whole = with_history(df, split=False)
    small_segments(parts)
    cut = with_history(df)
    assert "_segment" in cut._jdf.queryExecution().analyzed().toString()
    assert cut.columns == whole.columns
    assert cut.count() == df.count()
    assert whole.exceptAll(cut).isEmpty()


@pytest.mark.parametrize("kind", ["burst", "instant", "untimed"])
def test_segments_are_bounded(spark, small_segments, kind):
    df = spark.createDataFrame(rows_of(kind), SCHEMA)
    small_segments(16)
    sizes = {}

    def add(frame, window):
        sizes["rows"] = frame.groupBy("city", "_segment").count().collect()
        return frame.withColumn("nth", F.row_number().over(window))

    ordered.with_frames(df, 29, add)
    assert sum(r.city == "busy" for r in sizes["rows"]) >= 10
    # A segment holds about its share, and what it carries.
    assert max(r["count"] for r in sizes["rows"]) <= 2 * df.count() / 16 + 29


def test_source_is_read_once(spark, tmp_path):
    spark.createDataFrame(rows_of("plain"), SCHEMA).write.parquet(str(tmp_path / "source"))
    out = with_history(spark.read.parquet(str(tmp_path / "source")))
    files = {part for part in out.inputFiles() if str(tmp_path / "source") in part}
    assert not files


def test_missing_city_is_a_city(spark, small_segments):
    rows = [(i, START + timedelta(seconds=i), None if i % 3 else "a", float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = with_history(df, split=False)
    small_segments(9)
    cut = with_history(df)
    assert cut.count() == 120 and whole.exceptAll(cut).isEmpty()


def test_empty_table(spark):
    assert with_history(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_order_without_ids_is_total(spark):
    df = spark.createDataFrame([(START, "a", 1.0)], "event_time timestamp, city string, pm25 double")
    assert ordered.event_order(df) == ["event_time", "pm25"]


def test_history_limits_and_stats(spark):
    rows = [(i, START + timedelta(minutes=i), "a", float(i)) for i in range(1, 41)]
    df = with_history_stats(with_history(spark.createDataFrame(rows, SCHEMA)))
    last = df.orderBy(F.col("event_id").desc()).first()
    assert last.history == [float(v) for v in range(11, 41)]
    assert (last.avg_aqi, last.max_aqi, last.min_aqi, last.reading_count) == (25.5, 40.0, 11.0, 30)
    second = df.filter("event_id = 2").first()
    assert (second.history, second.avg_aqi) == ([1.0, 2.0], 1.5)
    labels = history_points(df.filter("event_id = 40"), ["event_id"]).orderBy("pos").collect()
    assert len(labels) == 20
    assert (labels[0].label, labels[0].aqi, labels[-1].label, labels[-1].aqi) == ("-19", 21.0, "Now", 40.0)


def test_row_limit_is_applied_before_the_shuffle(spark, small_segments):
    small_segments(12)
    df = spark.createDataFrame(rows_of("plain"), SCHEMA)
    plan = with_history(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_plain_window_reference(spark):
    """The unsplit frame itself, against a hand-made window."""
    df = spark.createDataFrame(rows_of("plain"), SCHEMA)
    w = Window.partitionBy("city").orderBy("event_time", "event_id").rowsBetween(-29, 0)
    by_hand = df.withColumn("history", F.collect_list("aqi").over(w))
    assert by_hand.exceptAll(with_history(df)).isEmpty()
