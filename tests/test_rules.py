import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skysift import constants as K
from skysift.functions import rules, scoring
from skysift.operators import lookups
from tests import model

slow = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def judge(spark, histories, **columns):
    df = spark.createDataFrame(list(enumerate(histories)), "i int, h array<double>")
    return df.orderBy("i").select(*[c.alias(n) for n, c in columns.items()]).collect()


@pytest.mark.parametrize(
    "history,arrow",
    [
        ([100, 105, 110, 115, 120, 130], "↑"),
        ([130, 125, 118, 112, 108, 100], "↓"),
        ([100, 101, 100, 102, 100, 101], "→"),
        ([100], "→"),
        ([100, 200], "→"),
        ([], "→"),
        ([5, 90, 400], "→"),
        ([0, 0, 0, 15], "→"),
        ([0, 0, 0, 15.3], "↑"),
        ([15.3, 0, 0, 0], "↓"),
        ([500, 500, 500, 1, 1, 1, 1, 1, 1], "→"),
    ],
)
def test_trend(spark, history, arrow):
    assert judge(spark, [[float(v) for v in history]], t=rules.trend(F.col("h")))[0].t == arrow


INSIGHTS = [
    ([10], 10, "→", "baseline"),
    ([40, 42, 41, 40, 39, 40], 40, "→", "flat_good"),
    ([70, 72, 71, 70, 69, 70], 70, "→", "flat"),
    ([120, 125, 130, 135, 140, 145], 145, "↑", "rising_high"),
    ([30, 32, 34, 36, 38, 40], 40, "↑", "rising"),
    ([100, 150, 110, 160, 120, 170], 170, "→", "variable"),
    ([210, 220, 230, 240, 250, 260], 260, "→", "critical"),
    ([140, 135, 130, 125, 120, 115], 115, "↓", "falling_high"),
    ([60, 58, 56, 54, 52, 50], 50, "↓", "falling"),
]


@pytest.mark.parametrize("history,aqi,arrow,name", INSIGHTS)
def test_insight(spark, history, aqi, arrow, name):
    text = rules.insight(F.col("h"), F.lit(float(aqi)), F.lit(arrow))
    assert judge(spark, [[float(v) for v in history]], x=text)[0].x == K.INSIGHT[name]


ALERTS = [
    ([50, 60, 70, 80, 90], 90, K.ALERT_SPIKE),
    ([300, 310, 320], 350, K.ALERT_LEVELS[0][1]),
    ([240, 245, 250], 250, K.ALERT_LEVELS[1][1]),
    ([170, 175, 180], 180, K.ALERT_LEVELS[2][1]),
    ([115, 118, 120], 120, K.ALERT_LEVELS[3][1]),
    ([38, 39, 40], 40, None),
    ([40], 40, None),
    ([40, 65], 65, None),
    ([0, 100, 110, 112, 115, 118], 118, K.ALERT_LEVELS[3][1]),
]


@pytest.mark.parametrize("history,aqi,text", ALERTS)
def test_alert(spark, history, aqi, text):
    assert judge(spark, [[float(v) for v in history]], x=rules.alert(F.col("h"), F.lit(float(aqi))))[0].x == text


def test_spike_rule_looks_at_five_values(spark):
    ok = [[10.0, 20.0, 35.0], [0.0, 90.0, 90.0, 90.0, 90.0, 90.0]]
    assert [r.x for r in judge(spark, ok, x=rules.jump(F.col("h")))] == [25.0, 0.0]


@slow
@given(st.lists(st.lists(st.integers(0, 5000).map(lambda v: v / 10), min_size=1, max_size=30), min_size=20, max_size=60))
def test_rules_match_model(spark, histories):
    h = F.col("h")
    aqi = F.get(h, F.size(h) - 1)
    rows = judge(spark, histories, t=rules.trend(h), a=rules.alert(h, aqi), i=rules.insight(h, aqi, rules.trend(h)))
    for values, row in zip(histories, rows):
        assert (row.t, row.a, row.i) == (model.trend(values), model.alert(values), model.insight(values))


def message_of(spark, aqi, arrow, prediction, traffic, seen):
    x = F.lit(float(aqi))
    m = rules.message(scoring.severity(x), x, F.lit(arrow), F.lit(float(prediction)), F.lit(traffic), F.lit(seen))
    return spark.range(1).select(m.alias("m")).first().m


@pytest.mark.parametrize(
    "aqi,arrow,prediction,traffic,seen,expected",
    [
        (35, "→", 37, "Low", 0, {"severity": "good", "title": "excellent", "confidence": "low"}),
        (42, "↑", 55, "Low", 0, {"severity": "good", "title": "signs of change"}),
        (75, "↓", 60, "Medium", 0, {"severity": "moderate", "title": "improving"}),
        (120, "↑", 145, "High", 0, {"severity": "sensitive", "title": "worsening", "summary": "traffic"}),
        (160, "↑", 185, "High", 0, {"severity": "unhealthy", "title": "worsening", "summary": "traffic"}),
        (350, "→", 340, "Low", 0, {"severity": "hazardous", "advice": "indoors"}),
        (250, "↓", 250, None, 0, {"summary": "Very Unhealthy air quality with downward trend."}),
        (100, "↑", 125, "Low", 0, {"prediction_note": "worsen significantly"}),
        (100, "↑", 110, "Low", 0, {"prediction_note": "rise further"}),
        (150, "↓", 120, "Low", 0, {"prediction_note": "improve significantly"}),
        (150, "↓", 144, "Low", 0, {"prediction_note": "improve in"}),
        (80, "→", 82, "Low", 0, {"prediction_note": "remain"}),
        (50, "→", 55, "Low", 0, {"prediction_note": "remain"}),
        (50, "→", 52, "Low", 20, {"confidence": "high"}),
        (50, "→", 52, "Low", 15, {"confidence": "high"}),
        (50, "→", 52, "Low", 10, {"confidence": "medium"}),
        (50, "→", 52, "Low", 4, {"confidence": "low"}),
        (50, "?", 52, "Low", 4, {"title": "Air quality is good and unchanged", "summary": "stable trend"}),
    ],
)
def test_message(spark, aqi, arrow, prediction, traffic, seen, expected):
    got = message_of(spark, aqi, arrow, prediction, traffic, seen).asDict()
    assert set(got) == {"severity", "title", "summary", "prediction_note", "advice", "confidence"}
    for field, part in expected.items():
        assert part in got[field]


@pytest.mark.parametrize(
    "aqi,arrow,prediction,level,score",
    [
        (300, "↑", 350, "critical", 185),
        (200, "↑", 210, "high", 123),
        (100, "→", 100, "medium", 50),
        (30, "↓", 25, "low", 15),
        (120, "→", 120, "medium", 60),
        (120, "↑", 120, "medium", 80),
        (105, "→", 105, "medium", 52),
        (79.9, "→", 79.9, "low", 40),
    ],
)
def test_priority(spark, aqi, arrow, prediction, level, score):
    p = rules.priority(F.lit(float(aqi)), F.lit(arrow), F.lit(float(prediction)))
    assert tuple(spark.range(1).select(p.alias("p")).first().p) == (level, score)


def test_badges_and_alert_line(spark):
    row = spark.range(1).select(
        rules.badge(F.lit("high")),
        rules.badge(F.lit(None).cast("string")),
        rules.shown_alert(F.lit("good"), F.lit("t"), F.lit("a")),
        rules.shown_alert(F.lit("hazardous"), F.lit(""), F.lit("a")),
        rules.shown_alert(F.lit("unhealthy"), F.lit(None).cast("string"), F.lit("")),
    ).first()
    assert tuple(row) == ("🟠", "⚪", "No active alerts", "a", "Alert active")


def test_title_table_agrees_with_titles(spark):
    df = spark.createDataFrame([(s, t) for s, t, _ in K.TITLES] + [("odd-level", "↑")], "severity string, trend string")
    joined = lookups.join_title(df, lookups.title_table(spark))
    plain = joined.withColumn("direct", rules.title(F.col("severity"), F.col("trend")))
    assert plain.filter("title <> direct").isEmpty()
    assert plain.filter("severity = 'odd-level'").first().title == "Air quality is odd level and worsening"
