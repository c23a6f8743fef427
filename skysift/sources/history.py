"""The history table: append, merge of many loads, range read, newest rows."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.functions.cleaning import flag, or_else
from skysift.operators.lookups import latest_rows
from skysift.session import staged
from skysift.sources import files, upkeep

HISTORY_SCHEMA = (
    "city string, timestamp timestamp, aqi double, pm25 double, pm10 double, no2 double, o3 double,"
    " co double, so2 double, trend string, prediction double, is_real int, category string, source string,"
    " event_date date, load string"
)
PARTITIONS = ["event_date", "load"]
COLUMNS = [name for name in (part.split()[0] for part in HISTORY_SCHEMA.split(", ")) if name not in PARTITIONS]
REQUIRED = ["city", "timestamp", "aqi"]


def history_rows(records: DataFrame) -> DataFrame:
    """Enriched records in the columns of the history table."""
    absent = F.lit(None).cast("double")
    predicted = [F.col(c) for c in ("next_hour_aqi", "prediction") if c in records.columns] or [absent]
    optional = {
        name: F.col(name) if name in records.columns else F.lit(None).cast(kind)
        for name, kind in [
            *[(c, "double") for c in ("pm25", "pm10", "no2", "o3", "co", "so2")],
            *[(c, "string") for c in ("trend", "category", "source")],
            ("is_real", "boolean"),
        ]
    }
    return (
        records.withColumns(
            {
                **optional,
                # A zero prediction gives way to the second field, which stands as it is.
                "prediction": or_else(*predicted, *([absent] if len(predicted) == 1 else [])),
                "is_real": flag(optional["is_real"]),
                "source": optional["source"] if "source" in records.columns else F.lit(""),
            }
        )
        .select(*COLUMNS)
        .withColumn("event_date", F.to_date("timestamp"))
    )


def _complete():
    complete = F.lit(True)
    for name in REQUIRED:
        complete = complete & F.col(name).isNotNull()
    return complete


def split_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows fit for the table, and rows that lack a required value."""
    return rows.filter(_complete()), rows.filter(~_complete())


def append_history(records: DataFrame, path: str, rejects: str | None = None, load: str | None = None) -> None:
    """Append records to the table, partitioned by date and load.

    A load replaces only itself, so a replayed micro-batch leaves no duplicates; dates on which it has been merged already
    keep what they have. Range partitioning by (date, city, time) bounds the files of each date however
    the rows spread over cities, and sorted files let city and time filters skip
    row groups. Rows lacking a required value go to ``rejects`` instead.
    """
    load = load or uuid.uuid4().hex
    good, bad = split_rows(history_rows(records).withColumn("load", F.lit(load)))
    if files.exists(records.sparkSession, f"{path}/_upkeep"):
        merged = upkeep.entries(records.sparkSession, path).filter(F.col("load") == load).select("event_date")
        good = good.join(merged, "event_date", "left_anti").select(*good.columns)
    _replace(_laid_out(good), path, ["event_date", "load"])
    if rejects:
        _replace(bad.drop("event_date"), rejects, ["load"])


def _laid_out(rows: DataFrame) -> DataFrame:
    by = ["event_date", "city", "timestamp"]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def merge_loads(spark: SparkSession, path: str, least: int = 2) -> int:
    """Merge the loads of each date that has ``least`` or more into one, sorted by (city, time); returns how many went.

    Readers and appenders may run beside it: loads that arrive meanwhile are left for the next merge. Of two merges at a
    time one fails and changes nothing. Old files stay until ``upkeep.vacuum``.
    """
    base, held = upkeep.version(spark, path), upkeep.entries(spark, path)
    loads = read_history(spark, path).select(*PARTITIONS).distinct()
    # Names of partitions, as the driver lists them for every read.
    crowded = loads.groupBy("event_date").agg(F.collect_list("load").alias("loads")).filter(F.size("loads") >= least)
    chosen = {r["event_date"]: r["loads"] for r in crowded.filter("event_date is not null").collect()}
    if not chosen:
        return 0
    keys = [f"{date}/{load}" for date, names in chosen.items() for load in names]
    target = f"{upkeep.MERGED}{uuid.uuid4().hex}"
    picked = F.concat_ws("/", F.col("event_date").cast("string"), "load").isin(keys)
    rows = read_history(spark, path).filter(picked).withColumn("load", F.lit(target))
    _replace(_laid_out(rows), path, ["event_date", "load"])
    pairs = [(date, load, target) for date, names in chosen.items() for load in names]
    gone = spark.createDataFrame(pairs, "event_date date, load string, target string").withColumns(
        {"merged_at": F.current_timestamp(), "gone": F.lit(False)}
    )
    upkeep.commit(spark, path, held.unionByName(gone), base)
    return len(pairs)


def _replace(rows: DataFrame, path: str, by: list[str]) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The rows in force when the read is set up; merged loads are passed over by their partition alone."""
    return spark.read.schema(HISTORY_SCHEMA).parquet(path).filter(upkeep.live(spark, path))


def latest_records(spark: SparkSession, path: str, cities: DataFrame) -> DataFrame:
    """All rows holding the newest time of each of the cities (``city``), found from the newest dates on.

    Dates are read in steps that double, each for the cities not found so far, until none is left: recent cities cost the
    newest dates only, one that has been silent, or has no row, the older ones once. Dates are the table's partitions.
    """
    names = [name[len("event_date=") :] for name in files.children(spark, path) if name.startswith("event_date=2")]
    dates, table = sorted(names, reverse=True), read_history(spark, path)
    wanted, found, at, step = staged(cities.select("city").distinct(), "cities"), [], 0, 1
    while at < len(dates):
        newest, oldest = dates[at], dates[min(at + step, len(dates)) - 1]
        span = table.filter(F.col("event_date").between(F.lit(oldest).cast("date"), F.lit(newest).cast("date")))
        found.append(staged(latest_rows(span.join(wanted, "city", "left_semi"), "timestamp"), "latest"))
        wanted = staged(wanted.join(found[-1], "city", "left_anti"), "cities")
        if wanted.isEmpty():
            break
        at, step = at + step, step * 2
    out = table.limit(0)
    for part in found:
        out = out.unionByName(part)
    return out


def city_history(table: DataFrame, city: str, as_of: datetime, hours: int = 24) -> DataFrame:
    """Rows of a city not older than ``hours`` before ``as_of``, oldest first.

    ``as_of`` without a zone is UTC; the zone of the machine plays no part.
    """
    as_of = as_of.replace(tzinfo=timezone.utc) if as_of.tzinfo is None else as_of.astimezone(timezone.utc)
    cutoff = as_of - timedelta(hours=hours)
    micros = (cutoff - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    recent = table.filter((F.col("city") == city) & (F.col("timestamp") >= F.timestamp_micros(F.lit(micros))))
    if "event_date" in table.columns:
        recent = recent.filter(F.col("event_date") >= F.lit(cutoff.date()))
    return recent.select(*COLUMNS).orderBy("timestamp")


def reading_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("total_readings"))
