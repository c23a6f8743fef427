"""The scalar rules as SQL functions of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from skysift.constants import AQI_CEILING, BREAKPOINTS, CATEGORIES


def _index_body() -> str:
    rows = " ".join(
        f"WHEN pm25 >= {lo}D AND pm25 <= {hi}D THEN {base}D + (pm25 - {lo}D) / {hi - lo!r}D * {top - base}D"
        for lo, hi, base, top in BREAKPOINTS
    )
    return f"CASE WHEN pm25 IS NULL THEN 0D {rows} ELSE {AQI_CEILING}D END"


def _tier_body(field: int, missing: str) -> str:
    rows = " ".join(f"WHEN aqi <= {tier[0]} THEN '{tier[field]}'" for tier in CATEGORIES)
    return f"CASE WHEN aqi IS NULL THEN '{missing}' {rows} ELSE '{CATEGORIES[-1][field]}' END"


def register(spark: SparkSession) -> None:
    """Define ``aqi_index(pm25)``, ``aqi_category(aqi)`` and ``aqi_severity(aqi)`` for SQL users."""
    define = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{define} aqi_index(pm25 DOUBLE) RETURNS DOUBLE RETURN {_index_body()}")
    spark.sql(f"{define} aqi_category(aqi DOUBLE) RETURNS STRING RETURN {_tier_body(1, 'Unknown')}")
    spark.sql(f"{define} aqi_severity(aqi DOUBLE) RETURNS STRING RETURN {_tier_body(2, 'hazardous')}")
