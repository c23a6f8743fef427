"""History table, latest rows, catalog, active set, message sources."""

import json
import time
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skysift.constants import DEFAULT_ACTIVE
from skysift.operators import lookups
from skysift.operators.gaps import fill_gaps
from skysift.plans import views
from skysift.session import shuffle_width
from skysift.sources import catalog, history, kafka, readings
from skysift.sources.versions import VersionedTable

NOW = datetime(2024, 3, 1, 12)
FIELDS = "city string, timestamp timestamp, aqi double, next_hour_aqi double, is_real boolean, trend string, source string"


def record(spark, *rows):
    return spark.createDataFrame(list(rows), FIELDS)


def row(city="TestCity", back=0, aqi=75.0, ahead=80.0, real=True, source="Test"):
    return (city, NOW - timedelta(minutes=back), aqi, ahead, real, "→", source)


def test_insert_and_query(spark, tmp_path):
    path = str(tmp_path / "h")
    history.append_history(record(spark, row(), row(back=61), row(city="Else")), path)
    table = history.read_history(spark, path)
    found = history.city_history(table, "TestCity", NOW, 1).collect()
    assert [(r.city, r.aqi, r.prediction, r.is_real, r.pm25) for r in found] == [("TestCity", 75.0, 80.0, 1, None)]
    assert history.city_history(table, "Nobody", NOW, 1).isEmpty()
    assert [r.timestamp for r in history.city_history(table, "TestCity", NOW, 24).collect()] == [
        NOW - timedelta(minutes=61), NOW]


def test_count_and_reopen(spark, tmp_path):
    path = str(tmp_path / "h")
    for i in range(5):
        history.append_history(record(spark, row(aqi=50.0 + i * 10, back=i)), path)
    again = history.read_history(spark.newSession(), path)
    assert history.reading_count(again).first().total_readings == 5
    assert again.filter("aqi = 90").count() == 1


def test_load_replaces_itself_only(spark, tmp_path):
    path = str(tmp_path / "h")
    history.append_history(record(spark, row(city="a")), path, load="1")
    history.append_history(record(spark, row(city="b")), path, load="2")
    history.append_history(record(spark, row(city="c")), path, load="2")
    assert {r.city for r in history.read_history(spark, path).collect()} == {"a", "c"}


def test_incomplete_rows_are_set_aside(spark, tmp_path):
    good, bad = str(tmp_path / "h"), str(tmp_path / "bad")
    history.append_history(record(spark, row(), row(aqi=None), row(city=None)), good, bad)
    assert history.read_history(spark, good).count() == 1
    assert spark.read.parquet(bad).count() == 2


def test_row_defaults(spark):
    df = record(spark, row(ahead=0.0, real=None)).withColumn("prediction", F.lit(9.0)).drop("source")
    got = history.history_rows(df).first()
    assert (got.prediction, got.is_real, got.source) == (9.0, 0, "")
    assert history.history_rows(record(spark, row(ahead=0.0))).first().prediction is None


def test_range_read_prunes(spark, tmp_path):
    path = str(tmp_path / "h")
    history.append_history(record(spark, *[row(back=i * 600) for i in range(20)]), path)
    plan = history.city_history(history.read_history(spark, path), "TestCity", NOW, 24)._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in text
    assert "EqualTo(city,TestCity)" in text and "GreaterThanOrEqual(timestamp" in text


def test_latest_keeps_ties(spark):
    df = record(spark, row(city="a"), row(city="a", aqi=1.0), row(city="a", back=1), row(city="b", back=9))
    assert sorted((r.city, r.aqi) for r in lookups.latest_rows(df, "timestamp").collect()) == [
        ("a", 1.0), ("a", 75.0), ("b", 75.0)]
    plan = lookups.latest_rows(df, "timestamp")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Sort" not in plan


def test_recent_rows_equal_ranked_rows(spark):
    rows = [row(city=c, back=b, aqi=float(b)) for c, n in (("a", 200), ("b", 3), ("c", 12)) for b in range(0, n * 7, 7)]
    rows += [("c", None, 1.0, 1.0, True, "→", "s"), ("b", None, 2.0, 1.0, True, "→", "s")]
    df = record(spark, *rows)
    for n in (1, 5, 12, 13, 500):
        wanted = lookups.newest_rows(df, n, ["timestamp", "aqi"])
        got = lookups.recent_rows(df, n, ["timestamp", "aqi"])
        assert got.count() == wanted.count() and wanted.exceptAll(got).isEmpty()


def test_builtin_catalog(spark):
    places = catalog.builtin_catalog(spark)
    assert places.count() == 44
    assert places.groupBy("region").count().count() == 5


def test_active_set_file(spark, tmp_path):
    places = catalog.builtin_catalog(spark)

    def names(text):
        path = tmp_path / f"{uuid.uuid4().hex}.json"
        if text is not None:
            path.write_text(text)
        return {r.name for r in catalog.active_set(spark, str(path), places).collect()}

    assert names(json.dumps({"Lima": {"lat": 1.0}, "Oslo": {}}, indent=2)) == {"Lima", "Oslo"}
    assert names("{}") == set()
    assert names(None) == names("not json") == set(DEFAULT_ACTIVE)


def test_choose_and_save_active(spark, tmp_path):
    places = catalog.builtin_catalog(spark)

    def picked(*names):
        return spark.createDataFrame([(n,) for n in names], "name string")

    path = str(tmp_path / "active")
    catalog.save_active(picked("Lima", "Paris", "Atlantis"), places, path)
    assert {r.name for r in catalog.active_set(spark, path, places).collect()} == {"Lima", "Paris"}
    with pytest.raises(ValueError, match="at least 1"):
        catalog.choose_active(picked("Atlantis"), places)
    with pytest.raises(ValueError, match="Maximum 8"):
        catalog.choose_active(places.limit(9).select("name"), places)


def test_membership(spark):
    state = record(spark, row(city="a"), row(city="b"), row(city="c"))
    active = spark.createDataFrame([("a",), ("c",), ("z",)], "city string")
    assert {r.city for r in views.current_snapshot(state, active).collect()} == {"a", "c"}
    assert {r.city for r in lookups.drop_active(state, active).collect()} == {"b"}
    flags = lookups.with_active_flag(state.select("city"), active).collect()
    assert {r.city: r.active for r in flags} == {"a": True, "b": False, "c": True}


def test_worst_city_counts_missing_as_zero(spark):
    state = record(spark, row(city="b", aqi=None), row(city="a", aqi=0.0))
    assert views.worst_city(state).first().city == "a"


def test_decode_tolerates_garbage(spark):
    texts = [
        '{"city": "a", "timestamp": "2024-01-01T00:00:00+02:00", "pm25": 3.5, "is_real": false, "more": 1}',
        '{"city": "b", "timestamp": "junk", "pm25": "wrong"}',
        '{"city": "", "pm25": 1}',
        "garbage",
    ]
    df = readings.decoded(spark.createDataFrame([(t.encode(),) for t in texts], "value binary"))
    a, b = df.orderBy("city").collect()
    assert (a.city, a.event_time, a.pm25, a.is_real) == ("a", datetime(2023, 12, 31, 22), 3.5, False)
    assert (b.city, b.event_time, b.pm25) == ("b", None, None)


def test_encode_writes_nulls(spark):
    df = spark.createDataFrame([("a", None, "↑")], "city string, aqi double, trend string")
    assert json.loads(readings.encoded(df).first().value) == {"city": "a", "aqi": None, "trend": "↑"}


def test_provider_payload(spark):
    body = json.dumps({"list": [{"components": {"pm2_5": 3.0, "co": 1234.5}}]})
    df = spark.createDataFrame([("a", NOW, body), ("b", NOW, "{}")], "city string, event_time timestamp, payload string")
    a, b = readings.from_provider(df).orderBy("city").collect()
    assert (a.pm25, a.co, a.pm10, a.source, a.is_real, a.traffic) == (3.0, 1.235, 0.0, "OpenWeatherMap", True, "Medium")
    assert (b.pm25, b.so2) == (0.0, 0.0)


def test_topic_options():
    assert kafka.source_options("k:9092") == {
        "kafka.bootstrap.servers": "k:9092",
        "subscribe": "raw-aqi",
        "startingOffsets": "latest",
        "failOnDataLoss": "false",
        "maxOffsetsPerTrigger": "1000000",
    }
    assert "maxOffsetsPerTrigger" not in kafka.source_options("k:9092", limit=None)
    assert kafka.sink_options("k:9092")["topic"] == "processed-aqi"
    publish = kafka.publish_options("k:9092")
    assert (publish["topic"], publish["kafka.acks"], publish["kafka.compression.type"]) == ("raw-aqi", "all", "gzip")


def test_versions_survive_replay_and_are_pruned(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "v"), "n long")
    assert table.read().isEmpty()
    for version in range(5):
        table.write(spark.range(version, version + 1).toDF("n"), version)
    table.write(spark.range(9, 10).toDF("n"), 4)
    assert table.read().first().n == 9 and table.read(before=4).first().n == 3
    assert table.versions() == [2, 3, 4]
    (tmp_path / "v" / "v=4" / "_SUCCESS").unlink()
    assert table.read().first().n == 3


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_city_history_ignores_the_machines_zone(spark, monkeypatch, zone):
    table = spark.createDataFrame([("a", h) for h in (9, 11, 12)], "city string, h int").selectExpr(
        "city", "make_timestamp(2024, 1, 20, h, 0, 0, 'UTC') AS timestamp", *[f"0.0D AS {c}" for c in
        ("aqi", "pm25", "pm10", "no2", "o3", "co", "so2", "prediction")], "'' AS trend", "1 AS is_real", "'' AS category",
        "'' AS source", "DATE '2024-01-20' AS event_date")
    monkeypatch.setenv("TZ", zone)
    time.tzset()
    try:
        assert history.city_history(table, "a", datetime(2024, 1, 20, 13), 2).count() == 2
    finally:
        monkeypatch.undo()
        time.tzset()


def test_shuffle_width_is_bounded():
    assert shuffle_width(1 << 30) == 16
    assert shuffle_width(100 * 10**12) == 20_000


def test_long_silence_is_filled_in_short_arrays(spark):
    rows = [("a", 0, True), ("a", 86_400 * 30, True), ("a", 86_400 * 31, False)]
    df = spark.createDataFrame(rows, "city string, s long, is_real boolean").selectExpr(
        "city", "timestamp_seconds(s) AS event_time", "s AS event_id", *[f"1.0D AS {c}" for c in ("pm25", "pm10", "no2", "o3", "co", "so2")],
        "is_real")
    filled = fill_gaps(df)
    assert filled.count() == filled.select("event_time").distinct().count() == 86_400 * 3 - 1
