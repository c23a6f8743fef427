"""Streams against their batch twins, over several micro-batches and restarts."""

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skysift.constants import TRIGGER_SECONDS
from skysift.operators.windows import window_report
from skysift.plans import enrich, forecast, views
from skysift.sources import catalog, history
from skysift.sources.readings import file_stream
from skysift.streaming import jobs

START = datetime(2024, 1, 1)
SCHEMA = (
    "event_id long, event_time timestamp, city string, pm25 double, pm10 double, no2 double, o3 double,"
    " co double, so2 double, traffic string, source string, is_real boolean"
)


def rows(n=400, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        city = "busy" if rng.random() < 0.6 else rng.choice(["b", "c"])
        pm25 = round(rng.uniform(0, 520), 2) if rng.random() < 0.95 else None
        out.append((i, START + timedelta(seconds=20 * i), city, pm25, 1.5, 2.0, 3.0, 0.5, 4.0, rng.choice(["High", "Low"]), "s", rng.random() < 0.5))
    return out


class Feed:
    """A folder that receives one parquet file per micro-batch."""

    def __init__(self, spark, tmp_path):
        self.spark, self.base = spark, str(tmp_path)
        self.work, self.out = f"{self.base}/work", f"{self.base}/out"
        self.all = []

    def add(self, batch):
        self.all += batch
        frame = self.spark.createDataFrame(batch, SCHEMA).coalesce(1)
        frame.write.mode("append").parquet(f"{self.base}/in")

    def stream(self):
        return file_stream(self.spark, f"{self.base}/in", SCHEMA, files_per_batch=1)

    def table(self):
        return self.spark.createDataFrame(self.all, SCHEMA)

    def result(self):
        return self.spark.read.parquet(self.out)


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def same(got, wanted):
    got = got.select(*wanted.columns)
    assert got.count() == wanted.count()
    assert wanted.exceptAll(got).isEmpty()


def chunks(data, n):
    return [data[i : i + n] for i in range(0, len(data), n)]


def test_window_report_update_mode(feed, spark):
    parts = chunks(rows(), 130)
    for part in parts[:2]:
        feed.add(part)
        jobs.report_windows(feed.stream(), jobs.file_sink(feed.out), feed.work, drain=True).awaitTermination()
    for part in parts[2:]:
        feed.add(part)
    jobs.report_windows(feed.stream(), jobs.file_sink(feed.out), feed.work, drain=True).awaitTermination()
    same(jobs.last_emissions(spark, feed.out, ["window_start", "city"]), window_report(feed.table()))


def test_batches_start_by_the_clock(feed, spark):
    """Without ``drain`` a stream goes on and takes what has arrived every ten seconds."""
    parts = chunks(rows(), 200)
    feed.add(parts[0])
    query = jobs.report_windows(feed.stream(), jobs.file_sink(feed.out), feed.work)

    def until(done):
        end = time.time() + 90
        while not done() and time.time() < end and query.isActive:
            time.sleep(0.1)
        assert done(), query.exception()

    def taken():
        return [p for p in query.recentProgress if p["numInputRows"] > 0]

    try:
        until(lambda: len(taken()) == 1 and not query.status["isTriggerActive"])
        feed.add(parts[1])
        until(lambda: len(taken()) == 2)
        assert query.isActive
    finally:
        query.stop()
    started = datetime.fromisoformat(taken()[1]["timestamp"]).timestamp()
    assert started % TRIGGER_SECONDS < 2
    same(jobs.last_emissions(spark, feed.out, ["window_start", "city"]), window_report(feed.table()))


def test_late_reading_is_dropped(feed, spark):
    data = rows(200)
    feed.add(data)
    jobs.report_windows(feed.stream(), jobs.file_sink(feed.out), feed.work, drain=True).awaitTermination()
    wanted = window_report(feed.table())
    late = (9999, START, "busy", 400.0, 1.0, 1.0, 1.0, 1.0, 1.0, "Low", "s", True)
    feed.add([late])
    jobs.report_windows(feed.stream(), jobs.file_sink(feed.out), feed.work, drain=True).awaitTermination()
    same(jobs.last_emissions(spark, feed.out, ["window_start", "city"]), wanted)


@pytest.mark.parametrize("limit", [None, 6])
def test_reading_enrichment_with_restart(feed, small_segments, limit):
    if limit:
        small_segments(limit)
    for n, part in enumerate(chunks(rows(), 140)):
        feed.add(part)
        if n != 1:  # the second and third part are taken together, after a restart
            query = jobs.enrich_stream(feed.stream(), jobs.file_sink(feed.out), feed.work, ["event_id"], drain=True)
            query.awaitTermination()
    same(feed.result(), enrich.enrich_readings(feed.table(), extra=["event_id"]))


def test_trained_model_scores_a_stream(feed, spark):
    data = rows(300)
    table = spark.createDataFrame(data, SCHEMA)
    model = forecast.train(table, trees=3).model

    def score(df):
        return forecast.score_reading(df, model)

    for part in chunks(data, 100):
        feed.add(part)
    jobs.enrich_stream(feed.stream(), jobs.file_sink(feed.out), feed.work, ["event_id"], drain=True, score=score).awaitTermination()
    scored, column = enrich.with_score(enrich.scored_readings(table), score)
    wanted = enrich.judged_readings(enrich.with_history(scored), column, ["event_id"])
    same(feed.result(), wanted)
    assert wanted.filter("next_hour_aqi <> aqi").count() > 100


def test_window_records_take_a_score(spark):
    table = spark.createDataFrame(rows(200), SCHEMA)
    got = enrich.window_records(table, 300, score=lambda df: df.withColumn("prediction", F.lit(42.0)))
    assert {r.next_hour_aqi for r in got.select("next_hour_aqi").collect()} == {42.0}


def test_out_of_order_batches_append_in_order_of_arrival(feed):
    def reading(i, minute, pm25):
        return (i, START + timedelta(minutes=minute), "a", pm25, 1.0, 1.0, 1.0, 1.0, 1.0, "Low", "s", True)

    feed.add([reading(1, 10, 12.0), reading(2, 5, 6.0)])
    jobs.enrich_stream(feed.stream(), jobs.file_sink(feed.out), feed.work, ["event_id"], drain=True).awaitTermination()
    feed.add([reading(3, 1, 0.0)])
    jobs.enrich_stream(feed.stream(), jobs.file_sink(feed.out), feed.work, ["event_id"], drain=True).awaitTermination()
    got = {r.event_id: r.history_aqi for r in feed.result().collect()}
    assert got == {2: [25.0], 1: [25.0, 50.0], 3: [25.0, 50.0, 0.0]}


def test_replayed_batch_gives_the_same_history(spark, tmp_path):
    df = spark.createDataFrame(rows(60), SCHEMA)
    scored = enrich.scored_readings(df)
    memory = jobs._CityHistory(spark, str(tmp_path / "w"), scored, ["event_time", "event_id"])
    results = []
    for batch_id, condition in [(0, "event_id < 30"), (1, "event_id >= 30"), (1, "event_id >= 30")]:
        recent, tail = memory.extended(scored.filter(condition), batch_id)
        results.append(sorted((r.event_id, tuple(r.history)) for r in recent.select("event_id", "history").collect()))
        memory.keep(tail, batch_id)
    assert results[1] == results[2]
    assert memory.extended(scored.filter("false"), 2) is None


def test_window_enrichment_closed_windows(feed):
    for n, part in enumerate(chunks(rows(500), 170)):
        feed.add(part)
        if n:
            query = jobs.enrich_window_stream(feed.stream(), jobs.file_sink(feed.out), feed.work, drain=True)
            query.awaitTermination()
    last = max(r[1] for r in feed.all)
    closed = enrich.window_records(feed.table(), 300).filter(F.col("timestamp") <= F.lit(last - timedelta(seconds=600)))
    assert closed.count() > 50
    same(feed.result(), closed)


def test_state_and_history_follow_records(spark, tmp_path):
    base = str(tmp_path)
    records = enrich.enrich_readings(spark.createDataFrame(rows(120), SCHEMA))
    nameless = records.limit(1).withColumn("city", F.lit(""))
    for condition in ("timestamp < '2024-01-01 00:20:00'", "timestamp >= '2024-01-01 00:20:00'"):
        records.unionByName(nameless).filter(condition).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = file_stream(spark, f"{base}/in", records.schema, files_per_batch=1)
        state = jobs.state_table(spark, f"{base}/state", stream)
        jobs.follow_records(stream, state, f"{base}/history", f"{base}/bad", f"{base}/work", drain=True).awaitTermination()
    table = history.read_history(spark, f"{base}/history")
    assert table.count() == records.count()
    assert table.select("load").distinct().count() == 2
    wanted = {r.city: (r.timestamp, r.aqi) for r in records.orderBy("timestamp").collect()}
    assert {r.city: (r.timestamp, r.aqi) for r in state.read().collect()} == wanted

    # A second query over the same history, with its own checkpoint, replaces nothing.
    again = file_stream(spark, f"{base}/in", records.schema)
    other = jobs.state_table(spark, f"{base}/state2", again)
    jobs.follow_records(again, other, f"{base}/history", f"{base}/bad", f"{base}/work2", drain=True).awaitTermination()
    assert history.read_history(spark, f"{base}/history").count() == 2 * records.count()

    # Warm start from the table, then an older record does not displace a newer one.
    fresh = jobs.state_table(spark, f"{base}/state3", records)
    jobs.warm_start(fresh, table)
    assert {r.city: (r.timestamp, r.aqi) for r in fresh.read().collect()} == wanted
    jobs.upsert_state(fresh, records.filter("timestamp < '2024-01-01 00:01:00'"), 0)
    assert {r.city: (r.timestamp, r.aqi) for r in fresh.read().collect()} == wanted


def test_live_active_set(feed, spark, tmp_path):
    config = tmp_path / "active.json"
    places = catalog.builtin_catalog(spark)
    for cities, part in (({"busy": {}}, rows(60)), ({"b": {}, "c": {}}, [(r[0] + 100, *r[1:]) for r in rows(60)])):
        config.write_text(json.dumps(cities))
        feed.add(part)
        sink = jobs.keep_live(jobs.file_sink(feed.out), str(config), places)
        jobs.enrich_stream(feed.stream(), sink, feed.work, ["event_id"], drain=True).awaitTermination()
    got = {(r.event_id >= 100, r.city) for r in feed.result().collect()}
    assert got == {(False, "busy"), (True, "b"), (True, "c")}


def test_latest_records_shortcut(spark):
    df = spark.createDataFrame(rows(300), SCHEMA)
    full = enrich.enrich_readings(df, extra=["event_id"])
    newest = full.groupBy("city").agg(F.max("event_id").alias("event_id"))
    same(views.latest_records(df), full.join(newest, ["city", "event_id"]).select(*full.columns))
