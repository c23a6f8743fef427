"""Gap filling between real readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.constants import FILL_SECONDS, SOURCE_FILLED
from skysift.functions.cleaning import POLLUTANTS, is_real, traffic_level
from skysift.operators.ordered import with_frames


#: Points of one block.
BLOCK = 8_640


def fill_gaps(readings: DataFrame, step: int = FILL_SECONDS) -> DataFrame:
    """Repeat the last real reading on every grid point before the next real one.

    The grid counts ``step`` seconds from the epoch; points strictly between two
    successive real readings of a city are filled. Nothing precedes the first.
    """
    real = readings.filter(is_real(F.col("is_real")))

    def add(frame: DataFrame, window) -> DataFrame:
        return frame.withColumn("last", F.lag(F.struct("event_time", *POLLUTANTS)).over(window))

    gaps = with_frames(real, 1, add).filter(F.col("last").isNotNull())
    micros = step * 1_000_000
    first = F.floor(F.unix_micros("last.event_time") / micros) + 1
    final = F.ceil(F.unix_micros("event_time") / micros) - 1
    return (
        gaps.filter(first <= final)
        .select("city", *[F.col(f"last.{c}") for c in POLLUTANTS], first.alias("_first"), final.alias("_final"))
        # Two steps, blocks and then points, keep every array short however long a city was silent.
        .withColumn("_block", F.explode(F.sequence(F.floor(F.col("_first") / BLOCK), F.floor(F.col("_final") / BLOCK))))
        .withColumn(
            "_point",
            F.explode(
                F.sequence(
                    F.greatest(F.col("_first"), F.col("_block") * BLOCK),
                    F.least(F.col("_final"), F.col("_block") * BLOCK + (BLOCK - 1)),
                )
            ),
        )
        .withColumn("event_time", F.timestamp_micros(F.col("_point") * micros))
        .withColumns(
            {
                "traffic": traffic_level(F.hour("event_time")),
                "source": F.lit(SOURCE_FILLED),
                "is_real": F.lit(False),
            }
        )
        .drop("_point", "_block", "_first", "_final")
    )
