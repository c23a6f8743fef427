"""Raw readings: JSON messages, provider responses, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from skysift.constants import SOURCE_PROVIDER
from skysift.functions.cleaning import milligrams, parsed_time, traffic_level, with_city

RAW_SCHEMA = StructType(
    [
        StructField("city", StringType()),
        StructField("timestamp", StringType()),
        *[StructField(name, DoubleType()) for name in ("pm25", "pm10", "no2", "o3", "co", "so2")],
        StructField("traffic", StringType()),
        StructField("source", StringType()),
        StructField("is_real", BooleanType()),
    ]
)

PROVIDER_SCHEMA = (
    "list array<struct<components: struct<pm2_5: double, pm10: double, no2: double,"
    " o3: double, co: double, so2: double>>>"
)


def decoded(messages: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """JSON messages → readings with an event time.

    Garbage decodes to nulls only and is dropped with the records that name no
    city; a malformed time gives a null event time.
    """
    kept = keep or []
    parsed = messages.select(*kept, F.from_json(F.col(value).cast("string"), RAW_SCHEMA).alias("data"))
    return with_city(
        parsed.select(*kept, "data.*").withColumn("event_time", parsed_time(F.col("timestamp")))
    )


def encoded(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One JSON text ``value`` per row; null fields are written out."""
    fields = F.struct(*(columns or df.columns))
    return df.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("value"))


def as_raw(readings: DataFrame) -> DataFrame:
    """Readings in the raw message schema; the time as ISO text with offset."""
    time = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return readings.withColumn("timestamp", time).select(*RAW_SCHEMA.fieldNames())


def from_provider(responses: DataFrame, payload: Column | None = None) -> DataFrame:
    """Stored provider responses (``city``, ``event_time``, JSON ``payload``) → readings.

    Missing components count as 0; CO arrives in µg/m³.
    """
    body = F.from_json(F.col("payload") if payload is None else payload, PROVIDER_SCHEMA)
    part = responses.withColumn("part", F.get(body["list"], F.lit(0))["components"])
    names = {"pm25": "pm2_5", "pm10": "pm10", "no2": "no2", "o3": "o3", "co": "co", "so2": "so2"}
    measures = {name: F.coalesce(F.col(f"part.{field}"), F.lit(0.0)) for name, field in names.items()}
    measures["co"] = milligrams(measures["co"])
    labels = {
        "traffic": traffic_level(F.hour("event_time")),
        "source": F.lit(SOURCE_PROVIDER),
        "is_real": F.lit(True),
    }
    return part.withColumns({**measures, **labels}).drop("part", "payload")


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None, **options) -> DataFrame:
    """Stream the files of a folder; the testable twin of the topic source."""
    reader = spark.readStream.schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
