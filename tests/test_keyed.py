"""Keyed state, warm starts and late readings."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skysift.operators.windows import window_report
from skysift.plans import enrich
from skysift.sources import history
from skysift.sources.readings import file_stream
from skysift.streaming import jobs, keyed

START = datetime(2024, 1, 1)
SCHEMA = (
    "event_id long, event_time timestamp, city string, pm25 double, pm10 double, no2 double, o3 double,"
    " co double, so2 double, traffic string, source string, is_real boolean"
)


def reading(i, seconds, city, pm25=12.0):
    time = None if seconds is None else START + timedelta(seconds=seconds)
    return (i, time, city, pm25, 1.5, 2.0, 3.0, 0.5, 4.0, "Low", "s", True)


def rows(n=300, seed=5):
    rng = random.Random(seed)
    cities = [c for c in ("busy", "b", "c", "", None) for _ in range(6 if c == "busy" else 2)]
    return [reading(i, 20 * i, rng.choice(cities), round(rng.uniform(0, 520), 2) if rng.random() < 0.9 else None) for i in range(n)]


@pytest.fixture
def feed(spark, tmp_path):
    class Feed:
        work, out = f"{tmp_path}/work", f"{tmp_path}/out"

        def add(self, batch):
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            return file_stream(spark, f"{tmp_path}/in", SCHEMA, files_per_batch=1)

        def enrich(self, batch, **settings):
            jobs.enrich_keyed(self.add(batch), jobs.file_sink(self.out), self.work, ["event_id"], drain=True, **settings).awaitTermination()

        def result(self):
            return spark.read.parquet(self.out)

        def state(self):
            return keyed.state_of(spark, f"{self.work}/checkpoint")

    return Feed()


def same(got, wanted):
    got = got.select(*wanted.columns)
    assert got.count() == wanted.count()
    assert wanted.exceptAll(got).isEmpty()


def test_equals_the_table_over_restarts(feed, spark):
    data = rows()
    for part in (data[:100], data[100:103], data[103:]):
        feed.enrich(part)
    same(feed.result(), enrich.enrich_readings(spark.createDataFrame(data, SCHEMA), extra=["event_id"]))
    held = {r.city: r.n for r in feed.state().groupBy("city").agg(F.count("*").alias("n")).collect()}
    assert held["busy"] == 29 and set(held) == {"busy", "b", "c"}


def test_order_of_arrival_and_missing_times(feed):
    feed.enrich([reading(1, 600, "a", 12.0), reading(2, 300, "a", 6.0), reading(4, None, "a", 3.0)])
    feed.enrich([reading(3, 60, "a", 0.0)])
    got = {r.event_id: r.history_aqi for r in feed.result().collect()}
    assert got == {4: [12.5], 2: [12.5, 25.0], 1: [12.5, 25.0, 50.0], 3: [12.5, 25.0, 50.0, 0.0]}


def test_a_batch_changes_its_own_cities_only(feed):
    feed.enrich([reading(1, 0, "a"), reading(2, 0, "b")])
    before = {tuple(r) for r in feed.state().collect()}
    feed.enrich([reading(3, 60, "b", 0.0)])
    assert {tuple(r) for r in feed.state().collect()} == before | {("b", 0.0)}


def test_warm_start_goes_on_where_the_table_ends(feed, spark, tmp_path):
    data = rows(400, seed=8)
    early, rest = spark.createDataFrame(data[:250], SCHEMA), data[250:]
    history.append_history(enrich.enrich_readings(early), f"{tmp_path}/history")
    known = keyed.carried_values(history.read_history(spark, f"{tmp_path}/history"), ["timestamp"])
    for part in (rest[:80], rest[80:]):
        feed.enrich(part, initial=known)  # the second time it is not read again
    whole = enrich.enrich_readings(spark.createDataFrame(data, SCHEMA), extra=["event_id"])
    same(feed.result(), whole.filter("event_id >= 250"))


def test_silent_cities_are_forgotten(feed):
    query = jobs.enrich_keyed(feed.add([reading(1, 0, "a"), reading(2, 0, "b")]), jobs.file_sink(feed.out), feed.work, ["event_id"], idle_seconds=1)
    try:
        query.awaitTermination(25)
    finally:
        query.stop()
    assert feed.state().count() == 0 and feed.result().count() == 2
    with pytest.raises(ValueError):
        feed.enrich([reading(3, 60, "b")], idle_seconds=1)


def gate(feed, batch):
    sinks = jobs.once_sink(f"{feed.out}/kept"), jobs.once_sink(f"{feed.out}/late")
    jobs.gate_late(feed.add(batch), *sinks, f"{feed.work}/gate", drain=True).awaitTermination()


def test_late_and_untimed_readings_are_kept_apart(feed, spark):
    gate(feed, [reading(1, 0, "a"), reading(2, 2000, "a"), reading(3, None, "a")])
    # The watermark is 2000 - 600 = 1400: windows that end at 1200 are closed, the one that ends at 1500 is open.
    gate(feed, [reading(4, 1199, "a"), reading(5, 1200, "a"), reading(6, 1399, "b"), reading(7, 100, "b"), reading(8, 3000, "a")])
    gate(feed, [reading(9, 2399, "a"), reading(10, 2400, "a")])
    kept, late = spark.read.parquet(f"{feed.out}/kept"), spark.read.parquet(f"{feed.out}/late")
    assert sorted(r.event_id for r in kept.collect()) == [1, 2, 5, 6, 8, 10]
    assert sorted((r.event_id, r.reason) for r in late.collect()) == [(3, "untimed"), (4, "late"), (7, "late"), (9, "late")]
    counts = {(r.city, r.window_start): (r.late_rows, r.least_behind) for r in jobs.late_counts(late.filter("reason = 'late'")).collect()}
    assert counts == {
        ("a", START + timedelta(seconds=900)): (1, 201), ("b", START): (1, 1300), ("a", START + timedelta(seconds=2100)): (1, 1),
    }


def test_a_report_of_punctual_readings_drops_nothing(feed, spark):
    rng = random.Random(4)
    data = rows(400, seed=11)
    arrival = [min(3, r[0] // 100 + (rng.randrange(4) if rng.random() < 0.3 else 0)) for r in data]
    for n in range(4):
        gate(feed, [r for r, a in zip(data, arrival) if a == n])
        stream = file_stream(spark, f"{feed.out}/kept", SCHEMA).select(*[f.split()[0] for f in SCHEMA.split(", ")])
        jobs.report_windows(stream, jobs.file_sink(f"{feed.out}/report"), f"{feed.work}/report", drain=True).awaitTermination()
    kept = spark.read.parquet(f"{feed.out}/kept").drop("batch")
    assert 0 < kept.count() < 400
    assert kept.count() + spark.read.parquet(f"{feed.out}/late").count() == 400
    same(jobs.last_emissions(spark, f"{feed.out}/report", ["window_start", "city"]), window_report(kept))


def test_batches_appear_once_and_whole(spark, tmp_path):
    sink = jobs.once_sink(f"{tmp_path}/o")
    sink(spark.range(3), 0)
    sink(spark.range(9), 0)
    assert spark.read.parquet(f"{tmp_path}/o").count() == 3


def test_names_are_looked_up_once_for_all_rows():
    """A row's values are not sought by name row by row."""
    from pyspark.sql import Row

    sought = []

    class Watched(Row):
        def __getitem__(self, item):
            sought.append(item)
            return super().__getitem__(item)

    class Values:
        def get(self):
            return iter([(1.0,)])

        def put(self, values):
            self.kept = values

    processor = keyed.CityHistory(["city", "event_time", "event_id", "aqi"], ["event_time", "event_id"], "aqi", None)
    processor.values = Values()
    named = Row("event_id", "city", "aqi", "event_time")
    rows = [Watched(*named(2, "A", 3.0, 20)), Watched(*named(1, "A", None, 20)), Watched(*named(3, "A", 2.0, None))]
    for row in rows:
        row.__fields__ = named
    out = list(processor.handleInputRows(("A",), iter(rows), None))
    assert [r.event_id for r in out] == [3, 1, 2]
    assert [r.history for r in out] == [[1.0, 2.0], [1.0, 2.0], [1.0, 2.0, 3.0]]
    assert processor.values.kept == [(1.0,), (2.0,), (None,), (3.0,)] and not sought
