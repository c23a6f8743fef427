"""Which loads of a table partitioned by date and load have been merged.

A merge writes the rows of many loads of a date to one new load, then adds a version to a small table beside the data: a row per
(date, load) with the load it went into. Until that version is complete, readers keep to the old loads; from then on, to the new
one. Old files stay until they are removed by ``vacuum``, so a reader that started before goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.sources import files
from skysift.sources.versions import VersionedTable

MERGED = "merged-"
SCHEMA = "event_date date, load string, target string, merged_at timestamp, gone boolean"


def _folder(path: str) -> str:
    # Names that begin like this are no part of the table.
    return f"{path.rstrip('/')}/_upkeep"


def log(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, f"{_folder(path)}/log", SCHEMA)


def entries(spark: SparkSession, path: str) -> DataFrame:
    return log(spark, path).read()


def commit(spark: SparkSession, path: str, rows: DataFrame, base: int) -> None:
    """Make ``rows`` the version after ``base``; an error if another caller has claimed it."""
    if not files.claim(spark, f"{_folder(path)}/claims/{base + 1}"):
        raise RuntimeError(f"version {base + 1} of {path} belongs to another merge")
    log(spark, path).write(rows.coalesce(1), base + 1)


def version(spark: SparkSession, path: str) -> int:
    return max(log(spark, path).versions(), default=-1)


def live(spark: SparkSession, path: str) -> Column:
    """Condition on the partition columns that holds for rows in force.

    Only merged loads whose files are still there are listed: as many as were merged since the last ``vacuum``.
    """
    if not files.exists(spark, _folder(path)):
        return ~F.col("load").startswith(MERGED)
    found = entries(spark, path)
    targets = [r["target"] for r in found.select("target").distinct().collect()]
    old = [r["k"] for r in found.filter("not gone").select(F.concat_ws("/", "event_date", "load").alias("k")).collect()]
    key = F.concat_ws("/", F.col("event_date").cast("string"), "load")
    known = ~F.col("load").startswith(MERGED) | F.col("load").isin(targets)
    return known & ~key.isin(old) if old else known


def vacuum(spark: SparkSession, path: str, before: Column) -> int:
    """Remove the files of loads merged before a time, and of merges that never became complete; returns how many folders went.

    The caller chooses a time before which no reader can have started. Their entries stay, so that a replayed load is still known.
    """
    base, found = version(spark, path), entries(spark, path)
    due = found.filter(~F.col("gone") & (F.col("merged_at") < before))
    folders = [f"event_date={r['event_date']}/load={r['load']}" for r in due.select("event_date", "load").collect()]
    known = {r["target"] for r in found.select("target").distinct().collect()}
    for date in files.children(spark, path):
        if date.startswith("event_date="):
            loads = [name[5:] for name in files.children(spark, f"{path}/{date}") if name.startswith(f"load={MERGED}")]
            folders += [f"{date}/load={load}" for load in loads if load not in known]
    for folder in folders:
        files.remove(spark, f"{path.rstrip('/')}/{folder}")
    if folders:
        commit(spark, path, found.withColumn("gone", F.col("gone") | (F.col("merged_at") < before)), base)
    return len(folders)
