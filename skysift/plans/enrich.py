"""The enriched record (28 fields), per reading and per window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions import rules, scoring
from skysift.functions.cleaning import or_else, with_city, with_defaults
from skysift.operators.rolling import with_history, with_history_stats, with_trend
from skysift.operators.windows import with_labels, window_report
from skysift.session import staged

RECORD = [
    "city", "timestamp", "aqi", "pm25", "pm10", "no2", "o3", "co", "so2",
    "category", "css_class", "health_advisory", "trend", "insight", "alert",
    "traffic", "source", "is_real", "next_hour_aqi", "next_hour_label", "next_hour_css",
    "history_aqi", "message", "priority", "avg_aqi", "max_aqi", "min_aqi", "reading_count",
]


def scored_readings(readings: DataFrame) -> DataFrame:
    """Readings with defaults filled in and the index rounded to one decimal."""
    aqi = F.round(scoring.index_from_pm25(F.col("pm25")), 1)
    return with_defaults(with_city(readings).withColumn("aqi", aqi))


def with_judgement(
    df: DataFrame, prediction: Column | None = None, strict_labels: bool = False, history_len: int | None = None
) -> DataFrame:
    """Everything decided from ``aqi``, ``history`` and ``traffic``.

    Without a prediction the current index stands in for it. ``history_len``
    replaces the real history length in the confidence rule.
    """
    history, aqi = F.col("history"), F.col("aqi")
    # The index has one decimal already.
    expected = aqi if prediction is None else F.round(F.coalesce(prediction, aqi), 1)
    arrow, ahead = F.col("trend"), F.col("next_hour_aqi")
    seen = F.size(history) if history_len is None else F.lit(history_len)
    base = df.withColumns({"next_hour_aqi": expected, "severity": scoring.severity(aqi)})
    return with_trend(base).withColumns(
        {
            "insight": rules.insight(history, aqi, arrow),
            "alert": F.coalesce(rules.alert(history, aqi), F.lit("")),
            "next_hour_label": scoring.outlook_label(ahead, strict_labels),
            "next_hour_css": scoring.outlook_css(ahead, strict_labels),
            "history_aqi": rules.exposed(history),
            "message": rules.message(F.col("severity"), aqi, arrow, ahead, F.col("traffic"), seen),
            "priority": rules.priority(aqi, arrow, ahead),
        }
    )


def judged_readings(recent: DataFrame, prediction: Column | None = None, extra: list[str] | None = None) -> DataFrame:
    """Finish scored readings that carry their ``history``; statistics cover that history."""
    judged = with_judgement(with_history_stats(with_labels(recent)), prediction)
    return judged.withColumnRenamed("event_time", "timestamp").select(*RECORD, *(extra or []))


def enrich_readings(
    readings: DataFrame, prediction: Column | None = None, extra: list[str] | None = None, **ordering
) -> DataFrame:
    """One enriched record per reading; statistics cover the last 30 readings of the city."""
    return judged_readings(with_history(scored_readings(readings), **ordering), prediction, extra)


def with_score(rows: DataFrame, score: Callable[[DataFrame], DataFrame] | None) -> tuple[DataFrame, Column | None]:
    """Rows after the ``score`` step, which adds ``prediction`` to each row, and that column; without a step no column."""
    return (rows, None) if score is None else (score(rows), F.col("prediction"))


def windows_as_readings(report: DataFrame) -> DataFrame:
    """A window report seen as one reading per window, timed at the window's end."""
    value = F.round(or_else(F.col("latest_aqi"), F.col("avg_aqi")), 1)
    digits = {"pm25": 2, "pm10": 2, "no2": 2, "o3": 2, "co": 3, "so2": 2}
    return report.select(
        "city",
        F.col("window_end").alias("event_time"),
        value.alias("aqi"),
        *[F.round(f"latest_{c}", d).alias(c) for c, d in digits.items()],
        "category",
        "css_class",
        "health_advisory",
        F.coalesce("traffic", F.lit("Medium")).alias("traffic"),
        F.coalesce("source", F.lit("Unknown")).alias("source"),
        F.coalesce("is_real", F.lit(True)).alias("is_real"),
        *[F.round(c, 1).alias(c) for c in ("avg_aqi", "max_aqi", "min_aqi")],
        "reading_count",
    )


def judged_windows(recent: DataFrame, prediction: Column | None = None, extra: list[str] | None = None) -> DataFrame:
    """Finish windows that carry their ``history``; statistics are those of the window."""
    judged = with_judgement(recent, prediction, strict_labels=True)
    return judged.withColumnRenamed("event_time", "timestamp").select(*RECORD, *(extra or []))


def enrich_windows(
    windows: DataFrame, prediction: Column | None = None, score: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """One enriched record per (window, city); ``score`` may add the prediction instead of a column."""
    rows, scored = with_score(windows, score)
    return judged_windows(with_history(rows, order=["event_time"]), prediction if scored is None else scored)


def window_records(
    readings: DataFrame,
    seconds: int,
    prediction: Column | None = None,
    score: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Window report and its enrichment.

    The report is a small fraction of the readings and is read more than once
    afterwards, so it is written first: the readings are scanned a single time.
    """
    report = staged(window_report(readings, seconds), "report")
    return enrich_windows(windows_as_readings(report), prediction, score)
