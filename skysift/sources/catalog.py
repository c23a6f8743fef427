"""Place catalog and the active set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skysift.constants import CATALOG, DEFAULT_ACTIVE, MAX_ACTIVE
from skysift.sources import files

CATALOG_SCHEMA = "name string, lat double, lon double, region string"


def builtin_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, CATALOG_SCHEMA)


def with_custom_places(catalog: DataFrame, added: DataFrame) -> DataFrame:
    """Add places (``name, lat, lon, added_at``); the newest entry of a name wins."""
    old = catalog.withColumn("added_at", F.lit(None).cast("timestamp"))
    new = added.withColumn("region", F.lit("Custom")).select(*old.columns)
    newest = Window.partitionBy("name").orderBy(F.col("added_at").desc_nulls_last(), "lat", "lon")
    ranked = old.unionByName(new).withColumn("_nth", F.row_number().over(newest))
    return ranked.filter("_nth = 1").select(*catalog.columns)


def active_set(spark: SparkSession, path: str, catalog: DataFrame) -> DataFrame:
    """Names in the active-set file (the keys of one JSON object).

    Without a readable object the defaults found in the catalog apply; an empty
    object is an empty set.
    """
    defaults = catalog.filter(F.col("name").isin(DEFAULT_ACTIVE)).select("name")
    if not files.exists(spark, path):
        return defaults
    parsed = spark.read.text(path, wholetext=True).select(
        F.from_json("value", "map<string,string>").alias("places")
    )
    if parsed.filter("places is not null").isEmpty():
        return defaults
    return parsed.select(F.explode(F.map_keys("places")).alias("name"))


def choose_active(selected: DataFrame, catalog: DataFrame, limit: int = MAX_ACTIVE) -> DataFrame:
    """Known names of a selection; an empty or too large one is an error."""
    valid = selected.join(catalog, "name", "left_semi").select("name")
    n = len(valid.limit(limit + 1).take(limit + 1))
    if n > limit:
        raise ValueError(f"Maximum {limit} cities allowed")
    if n == 0:
        raise ValueError("Select at least 1 city")
    return valid


def save_active(selected: DataFrame, catalog: DataFrame, path: str, limit: int = MAX_ACTIVE) -> DataFrame:
    """Check a selection and write it as the active-set object."""
    chosen = choose_active(selected, catalog, limit).join(catalog, "name")
    entry = F.struct("name", F.struct("lat", "lon", "region").alias("place"))
    body = chosen.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    body.coalesce(1).write.mode("overwrite").text(path)
    return chosen.select("name")
