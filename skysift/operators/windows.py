"""Event-time windows per city; the same function serves tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.constants import WATERMARK_SECONDS, WINDOW_SECONDS
from skysift.functions import scoring
from skysift.functions.cleaning import with_city
from skysift.operators.ordered import event_order

MEAN_DIGITS = {"pm25": 2, "pm10": 2, "no2": 2, "o3": 2, "co": 3, "so2": 2}


def scored(readings: DataFrame) -> DataFrame:
    """Index of each reading and the labels that follow from it."""
    return with_labels(readings.withColumn("aqi", scoring.index_from_pm25(F.col("pm25"))))


def with_labels(df: DataFrame, value: str = "aqi") -> DataFrame:
    aqi = F.col(value)
    return df.withColumns(
        {
            "category": scoring.category(aqi),
            "css_class": scoring.css_class(aqi),
            "health_advisory": scoring.health_advisory(aqi),
        }
    )


def watermarked(readings: DataFrame, seconds: int = WATERMARK_SECONDS) -> DataFrame:
    return readings.withWatermark("event_time", f"{seconds} seconds")


def window_report(readings: DataFrame, seconds: int = WINDOW_SECONDS, latest: bool = True) -> DataFrame:
    """Means, extremes and count per (window, city), and the window's newest reading.

    Only the index is computed per reading; the three labels of the newest reading
    follow from its index afterwards, so they are neither carried nor shuffled.
    Without ``latest`` all buffers are fixed-width and the plan is a hash aggregate.
    """
    source = with_city(readings).withColumn("aqi", scoring.index_from_pm25(F.col("pm25")))
    measures = [
        F.round(F.avg("aqi"), 1).alias("avg_aqi"),
        *[scoring.rounded_mean(F.col(c), d).alias(f"avg_{c}") for c, d in MEAN_DIGITS.items()],
        F.max("aqi").alias("max_aqi"),
        F.min("aqi").alias("min_aqi"),
        F.count(F.lit(1)).alias("reading_count"),
    ]
    if latest:
        # One comparison per row decides all newest-reading columns; nulls are kept.
        order = [c for c in event_order(readings) if c == "event_time" or c == "event_id"]
        carried = ["aqi", *MEAN_DIGITS, "traffic", "source", "is_real"]
        measures.append(F.max(F.struct(*order, *carried)).alias("newest"))
    report = source.groupBy(F.window("event_time", f"{seconds} seconds").alias("span"), "city").agg(*measures)
    out = report.withColumns({"window_start": F.col("span.start"), "window_end": F.col("span.end")})
    if latest:
        out = with_labels(
            out.withColumns(
                {
                    **{f"latest_{c}": F.col(f"newest.{c}") for c in ("aqi", *MEAN_DIGITS)},
                    **{c: F.col(f"newest.{c}") for c in ("traffic", "source", "is_real")},
                }
            ).drop("newest"),
            "latest_aqi",
        )
    return out.drop("span")
