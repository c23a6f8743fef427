"""Merging the loads of the history table beside readers, appenders and replays."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skysift.sources import history, upkeep

START = datetime(2024, 1, 1)


def records(spark, n, first=0):
    rows = [(f"c{i % 3}", START + timedelta(hours=i), float(i)) for i in range(first, first + n)]
    return spark.createDataFrame(rows, "city string, timestamp timestamp, aqi double")


def values(table):
    return sorted(r.aqi for r in table.select("aqi").collect())


def data_files(path):
    return [f for f in Path(path).rglob("*.parquet") if "_upkeep" not in f.parts]


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "history")
    for n in range(12):
        history.append_history(records(spark, 60).filter(F.col("aqi") % 12 == n), path, load=f"load-{n}")
    return path


def test_rows_stay_and_files_become_few(spark, table):
    before = len(data_files(table))
    assert history.merge_loads(spark, table) > 30
    merged = history.read_history(spark, table)
    assert values(merged) == [float(i) for i in range(60)]
    loads = merged.select("event_date", "load").distinct().groupBy("event_date").count().collect()
    assert len(loads) == 3 and {r["count"] for r in loads} == {1}
    assert upkeep.vacuum(spark, table, F.lit(datetime.now() + timedelta(days=1))) > 30
    assert len(data_files(table)) < before / 3
    assert values(history.read_history(spark, table)) == [float(i) for i in range(60)]
    assert history.merge_loads(spark, table) == 0


def test_files_are_sorted(spark, table):
    history.merge_loads(spark, table)
    merged = history.read_history(spark, table)
    rows = merged.withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
    for file in {r.file for r in rows}:
        keys = [(r.city, r.timestamp) for r in rows if r.file == file]
        assert keys == sorted(keys)


def test_replays_and_new_loads(spark, table):
    history.merge_loads(spark, table)
    history.append_history(records(spark, 60).filter(F.col("aqi") % 12 == 3), table, load="load-3")
    assert values(history.read_history(spark, table)) == [float(i) for i in range(60)]
    history.append_history(records(spark, 6, first=60), table, load="load-12")
    history.append_history(records(spark, 6, first=60), table, load="load-12")
    assert values(history.read_history(spark, table)) == [float(i) for i in range(66)]
    # A load whose rows reach into a date merged without it: those are new, the others are known.
    history.append_history(records(spark, 90).filter(F.col("aqi") % 12 == 3), table, load="load-3")
    assert values(history.read_history(spark, table)) == [*[float(i) for i in range(66)], 75.0, 87.0]


def test_a_reader_goes_on(spark, table):
    reader = history.read_history(spark, table)
    history.merge_loads(spark, table)
    assert values(reader) == [float(i) for i in range(60)]
    # Nothing merged is old enough to go.
    assert upkeep.vacuum(spark, table, F.lit(datetime.now() - timedelta(days=1))) == 0
    assert values(reader) == [float(i) for i in range(60)]


def test_a_merge_counts_only_when_complete(spark, table):
    """Files of a merge that did not end are no part of the table, and go with the next vacuum."""
    history._replace(history.read_history(spark, table).withColumn("load", F.lit("merged-broken")), table, ["event_date", "load"])
    history.append_history(records(spark, 1, first=100), table, load="other")
    history.merge_loads(spark, table)
    assert values(history.read_history(spark, table)) == [*[float(i) for i in range(60)], 100.0]
    upkeep.vacuum(spark, table, F.lit(datetime.now() - timedelta(days=1)))
    assert not [f for f in data_files(table) if "merged-broken" in str(f)]


def test_of_two_merges_one_fails(spark, table):
    base, held = upkeep.version(spark, table), upkeep.entries(spark, table)
    history.merge_loads(spark, table)
    with pytest.raises(RuntimeError):
        upkeep.commit(spark, table, held, base)
    assert values(history.read_history(spark, table)) == [float(i) for i in range(60)]


def test_merged_loads_are_passed_over_by_partition(spark, table):
    history.merge_loads(spark, table)
    plan = history.read_history(spark, table)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "load" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "Join" not in plan


def test_newest_rows_come_from_the_newest_dates(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "history")
    rows = [("a", START + timedelta(days=i), float(i)) for i in range(40)]
    rows += [("b", START + timedelta(days=i), float(i)) for i in range(20, 38)] + [("silent", START, -1.0), ("silent", START, -2.0)]
    history.append_history(spark.createDataFrame(rows, "city string, timestamp timestamp, aqi double"), path)
    cities = lambda *names: spark.createDataFrame([(n,) for n in names], "city string")
    read = []
    plain = history.latest_rows
    monkeypatch.setattr(history, "latest_rows", lambda df, time: read.append(len(df.select("event_date").distinct().collect())) or plain(df, time))
    found = lambda *names: sorted((r.city, r.aqi) for r in history.latest_records(spark, path, cities(*names)).collect())
    assert found("a") == [("a", 39.0)] and read == [1]
    assert found("a", "b") == [("a", 39.0), ("b", 37.0)] and read[1:] == [1, 1]
    assert found("silent", "a", "nowhere") == [("a", 39.0), ("silent", -2.0), ("silent", -1.0)]
    assert found() == []
