"""Readings and dimensions derived from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.constants import MAX_ACTIVE
from skysift.functions.cleaning import traffic_level

# Declared, so that building a query reads no file.
EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)
NATION_SCHEMA = "n_nationkey int, n_name string, n_regionkey int"
REGION_SCHEMA = "r_regionkey int, r_name string"


def _number(text: Column) -> Column:
    return F.get_json_object(text, "$.k").cast("double")


def readings_from_events(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Give an events table, or a stream of it, the shape of sensor readings."""
    k = F.col("k")
    base = events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("event_time"),
        (F.col("user_id") % 25).cast("int").alias("city_key"),
        "value",
        "event_type",
        _number(F.col("props")).alias("k"),
    )
    return base.join(catalog.select("city_key", "city", "region"), "city_key").select(
        "event_id",
        "event_time",
        "city",
        "region",
        F.col("value").alias("pm25"),
        (F.col("value") + k).alias("pm10"),
        k.alias("no2"),
        (F.lit(100.0) - k).alias("o3"),
        (k / 100.0).alias("co"),
        (k / 4.0).alias("so2"),
        traffic_level(F.hour("event_time")).alias("traffic"),
        F.col("event_type").alias("source"),
        (F.col("event_type") != "error").alias("is_real"),
    )


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.schema(NATION_SCHEMA).parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.schema(REGION_SCHEMA).parquet(f"{sf_dir}/region.parquet")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("city_key"), F.col("n_name").alias("city"), F.col("r_name").alias("region")
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    return readings_from_events(events, cities(spark, sf_dir))


def active_cities(spark: SparkSession, sf_dir: str, size: int = MAX_ACTIVE) -> DataFrame:
    """The cities with the lowest keys."""
    return cities(spark, sf_dir).orderBy("city_key").limit(size).select("city")
