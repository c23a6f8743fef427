import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skysift.functions import cleaning, scoring, sql
from skysift.operators import lookups
from tests import model

slow = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def index_of(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, pm25 double")
    rows = df.select("i", scoring.index_from_pm25(F.col("pm25")).alias("aqi")).orderBy("i").collect()
    return [r.aqi for r in rows]


def test_index_vectors(spark):
    inputs = [6.0, 0.0, 12.0, -5.0, 500.4, 500.5, float("nan"), None, 12.0001, 35.4, 55.4, 150.4, 250.4, 350.4]
    got = index_of(spark, inputs)
    assert got[:8] == [25.0, 0.0, 50.0, 500.0, 500.0, 500.0, 500.0, 0.0]
    assert 51.0 < got[8] < 51.01
    assert got[9:] == [100.0, 150.0, 200.0, 300.0, 400.0]
    ranges = {23.8: (65, 85), 45.0: (101, 150), 100.0: (151, 200), 200.0: (201, 300), 500.0: (400, 500)}
    for value, (lo, hi) in zip(index_of(spark, list(ranges)), ranges.values()):
        assert lo <= value <= hi


def test_index_just_above_each_breakpoint(spark):
    edges = [12.0, 35.4, 55.4, 150.4, 250.4, 350.4]
    got = index_of(spark, [math.nextafter(e, 1000) for e in edges])
    assert [round(v) for v in got] == [51, 101, 151, 201, 301, 401]


@slow
@given(st.lists(st.floats(-10, 600) | st.none(), min_size=50, max_size=200))
def test_index_matches_model(spark, values):
    assert index_of(spark, values) == [model.index(v) for v in values]


@slow
@given(st.lists(st.floats(-10, 600), min_size=50, max_size=100))
def test_table_and_sql_forms_match_column_form(spark, values):
    sql.register(spark)
    df = spark.createDataFrame([(v,) for v in values], "pm25 double")
    scored = lookups.index_from_table(df, lookups.breakpoint_table(spark)).withColumn(
        "chain", scoring.index_from_pm25(F.col("pm25"))
    )
    scored = scored.withColumn("call", F.expr("aqi_index(pm25)"))
    assert scored.filter("aqi <> chain or call <> chain").isEmpty()


@pytest.mark.parametrize(
    "aqi,label,css",
    [
        (25.0, "Good", "good"),
        (50.0, "Good", "good"),
        (50.04, "Moderate", "moderate"),
        (125.0, "Unhealthy for Sensitive", "sensitive"),
        (175.0, "Unhealthy", "unhealthy"),
        (250.0, "Very Unhealthy", "very-unhealthy"),
        (350.0, "Hazardous", "hazardous"),
        (1200.0, "Hazardous", "hazardous"),
    ],
)
def test_tiers(spark, aqi, label, css):
    x = F.lit(aqi)
    row = spark.range(1).select(scoring.category(x), scoring.css_class(x), scoring.severity(x)).first()
    assert tuple(row) == (label, css, css)


def test_tiers_of_missing_and_beyond(spark):
    none, far = F.lit(None).cast("double"), F.lit(1000.0)
    row = spark.range(1).select(
        scoring.category(none),
        scoring.css_class(none),
        scoring.health_advisory(none),
        scoring.outlook_label(far, strict=True),
        scoring.outlook_css(far, strict=True),
        scoring.outlook_label(far),
        scoring.clamp_prediction(F.lit(-3.0)),
        scoring.clamp_prediction(far),
        scoring.clamp_prediction(F.lit(12.34)),
    ).first()
    assert tuple(row) == ("Unknown", "good", "", "Unknown", "good", "Hazardous", 0.0, 500.0, 12.3)


def test_traffic_hours(spark):
    rows = spark.range(24).select("id", cleaning.traffic_level(F.col("id")).alias("t")).collect()
    got = {r.id: r.t for r in rows}
    assert {h for h, t in got.items() if t == "High"} == {7, 8, 9, 10, 17, 18, 19, 20}
    assert {h for h, t in got.items() if t == "Low"} == {2, 3, 4, 5}


def test_fallbacks(spark):
    number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    row = spark.range(1).select(
        cleaning.or_else(F.lit(0.0), F.lit(3.0)),
        cleaning.or_else(number, F.lit(0.0)),
        cleaning.text_or(F.lit(""), text, F.lit("z")),
        cleaning.flag(F.lit(None).cast("boolean")),
        cleaning.display(text, "%"),
        cleaning.display(F.lit(3), "%"),
        cleaning.milligrams(F.lit(1234.5)),
        cleaning.parsed_time(F.lit("junk")),
        cleaning.hour_sin(F.lit(None).cast("timestamp")),
        cleaning.hour_cos(F.lit(None).cast("timestamp")),
    ).first()
    assert tuple(row) == (3.0, 0.0, "z", 0, "—", "3%", 1.235, None, 0.0, 1.0)


def test_place_names(spark):
    rows = [("Oslo", "Viken", "NO"), ("Oslo", "", "NO"), ("Oslo", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "name string, state string, country string")
    name = cleaning.place_name(F.col("name"), F.col("state"), F.col("country"), F.lit(59.914), F.lit(10.75))
    assert [r[0] for r in df.select(name).collect()] == ["Oslo, Viken", "Oslo, NO", "Oslo", "Unknown (59.91,10.75)"]


def test_numbers_are_shown_without_an_empty_fraction(spark):
    df = spark.createDataFrame([(50.0,), (12.5,), (None,), (20_000_000.0,)], "x double")
    shown = [r.x for r in df.select(cleaning.display_number(F.col("x")).alias("x")).collect()]
    assert shown == ["50", "12.5", "—", "20000000"]
