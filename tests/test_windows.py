import math
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from skysift.functions import scoring
from skysift.operators.windows import window_report
from skysift.plans import enrich

START = datetime(2024, 1, 1)
SCHEMA = (
    "event_id long, event_time timestamp, city string, pm25 double, pm10 double, no2 double, o3 double,"
    " co double, so2 double, traffic string, source string, is_real boolean"
)


def reading(i, seconds, pm25, city="a", traffic="Low", real=True, pm10=1.0):
    return (i, START + timedelta(seconds=seconds), city, pm25, pm10, 2.0, 3.0, 0.004, 5.0, traffic, "s", real)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_report_values(spark):
    df = frame(spark, [reading(1, 0, 6.0), reading(2, 299, 12.0, traffic="High", real=None), reading(3, 300, 100.0)])
    first, second = window_report(df).orderBy("window_start").collect()
    assert (first.window_start, first.window_end) == (START, START + timedelta(minutes=5))
    assert (first.avg_aqi, first.avg_pm25, first.max_aqi, first.min_aqi, first.reading_count) == (37.5, 9.0, 50.0, 25.0, 2)
    assert (first.latest_aqi, first.latest_pm25, first.traffic, first.is_real, first.category) == (50.0, 12.0, "High", None, "Good")
    assert (second.reading_count, second.avg_co) == (1, 0.004)


def test_ties_in_means_round_half_up(spark):
    df = frame(spark, [reading(1, 0, 1.0), reading(2, 1, 1.01)])
    assert window_report(df, latest=False).first().avg_pm25 == 1.01


def test_records_without_city_and_missing_pm25(spark):
    rows = [reading(1, 0, None), reading(2, 1, 9.0, city=""), reading(3, 2, 9.0, city=None)]
    report = window_report(frame(spark, rows)).collect()
    assert [(r.city, r.latest_aqi, r.avg_pm25, r.latest_pm25, r.category) for r in report] == [("a", 0.0, None, None, "Good")]


def test_newest_by_time_then_id(spark):
    rows = [reading(2, 10, 20.0), reading(1, 10, 30.0), reading(3, 5, 40.0)]
    assert window_report(frame(spark, rows)).first().latest_pm25 == 20.0


def test_hash_aggregate_without_latest(spark):
    plan = window_report(frame(spark, [reading(1, 0, 6.0)]), latest=False)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "BatchEvalPython" not in plan


def test_zero_index_falls_back_to_mean(spark):
    rows = [reading(1, 0, 12.0), reading(2, 10, 0.0)]
    record = enrich.window_records(frame(spark, rows), 300).first()
    assert (record.aqi, record.avg_aqi, record.min_aqi, record.category) == (25.0, 25.0, 0.0, "Good")


def test_category_sees_rounded_index_per_reading_only(spark):
    pm25 = 12.0 + 23.4 * (0.04 - 0.0) / 49  # index 51.04 → 51.0
    low = 50.0 / 50 * 12  # exactly 50
    df = frame(spark, [reading(1, 0, pm25), reading(2, 400, low)])
    records = enrich.enrich_readings(df, extra=["event_id"]).orderBy("event_id").collect()
    assert [(r.aqi, r.category) for r in records] == [(51.0, "Moderate"), (50.0, "Good")]


def test_record_has_28_fields_and_defaults(spark):
    row = (1, START, "a", 9.0, None, None, None, None, None, None, None, None)
    record = enrich.enrich_readings(frame(spark, [row])).first().asDict()
    assert len(record) == 28
    assert (record["pm10"], record["traffic"], record["source"], record["is_real"]) == (0.0, "Medium", "Unknown", True)
    assert (record["alert"], record["next_hour_aqi"], record["history_aqi"]) == ("", record["aqi"], [record["aqi"]])


def test_fixed_history_length_for_confidence(spark):
    df = frame(spark, [reading(1, 0, 9.0)])
    recent = enrich.scored_readings(df).withColumn("history", F.array("aqi"))
    assert enrich.with_judgement(recent).first().message.confidence == "low"
    assert enrich.with_judgement(recent, history_len=10).first().message.confidence == "medium"


def test_means_keep_every_value(spark):
    rows = [
        ("nan", [float("nan"), 10.0]), ("huge", [1e15, 3.0]), ("tiny", [1e-5, 1e-5]), ("tie", [0.125, 0.125]), ("null", [None, 4.0]),
        ("large", [1e300, 1e300]),
    ]
    df = spark.createDataFrame([(k, v) for k, vs in rows for v in vs], "k string, x double")
    got = {r.k: (r.two, r.five) for r in df.groupBy("k").agg(
        scoring.rounded_mean(F.col("x"), 2).alias("two"), scoring.rounded_mean(F.col("x"), 5).alias("five")).collect()}
    assert math.isnan(got["nan"][0])
    assert got["huge"][0] == (1e15 + 3) / 2
    assert got["tiny"] == (0.0, 1e-5)
    assert got["tie"][0] == 0.13
    assert got["null"][0] == 4.0
    assert got["large"][0] == 1e300
