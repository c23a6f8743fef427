"""Per-city history: the newest index values, their statistics, trend, chart labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.constants import HISTORY_ROWS, HISTORY_SHOWN
from skysift.functions import rules
from skysift.functions.scoring import SCALE, scaled
from skysift.operators.ordered import with_frames


def with_history(df: DataFrame, rows: int = HISTORY_ROWS, value: str = "aqi", **ordering) -> DataFrame:
    """Add ``history``: the last ``rows`` values of the city, this one last.

    Everything else that looks back is computed from this one array, so the
    window keeps a single frame.
    """

    def add(frame: DataFrame, window) -> DataFrame:
        return frame.withColumn("history", F.collect_list(value).over(window.rowsBetween(1 - rows, 0)))

    return with_frames(df, rows - 1, add, **ordering)


def with_trend(df: DataFrame) -> DataFrame:
    return df.withColumn("trend", rules.trend(F.col("history")))


def history_mean(history: Column) -> Column:
    """Mean of an array of non-negative values, one decimal, half-up, in whole numbers."""
    total = F.aggregate(history, F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(scaled(x), F.lit(0)))
    parts = F.size(history) * F.lit(SCALE).cast("bigint")
    return F.floor((total * 10 + parts / 2) / parts) / F.lit(10.0)


def with_history_stats(df: DataFrame) -> DataFrame:
    """Statistics of ``history``, whose values have one decimal already."""
    history = F.col("history")
    return df.withColumns(
        {
            "avg_aqi": history_mean(history),
            "max_aqi": F.array_max(history),
            "min_aqi": F.array_min(history),
            "reading_count": F.size(history).cast("long"),
        }
    )


def history_points(df: DataFrame, keys: list[str], shown: int = HISTORY_SHOWN) -> DataFrame:
    """One row per exposed history value with its axis label: ``-k`` … ``Now``."""
    points = df.select(*keys, F.posexplode(rules.exposed(F.col("history"), shown)).alias("pos", "aqi"),
                       F.least(F.size("history"), F.lit(shown)).alias("shown"))
    back = F.col("shown") - 1 - F.col("pos")
    label = F.when(back == 0, F.lit("Now")).otherwise(F.concat(F.lit("-"), back.cast("string")))
    return points.select(*keys, "pos", label.alias("label"), "aqi")
