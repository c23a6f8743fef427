"""Bounded row frames over few, heavy keys.

A frame such as "the last 30 readings of this city" partitions by city, so one
task would hold all rows of a city. Here the rows are dealt once into segments:
ranges of the total order (city, time, id), about as large as any other shuffle
partition, so a busy city spreads over many and small cities share one. A row frame
only ever looks back ``carry`` rows, so each segment also receives copies of
the last ``carry`` rows before it; they feed the frames and are dropped afterwards.
Results equal those of the uncut window, at every size and for every key.

Only the last city of a segment can go on in the next one, so at most ``carry`` rows
of a segment are copied on. A segment with fewer rows than that passes on what it got.
Missing times and equal instants are told apart by id. Rows that agree in
the whole order stay together: without ids these are exact copies.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from skysift.session import staged

_SEGMENT, _CARRIED = "_segment", "_carried"


def event_order(df: DataFrame) -> list[str]:
    """Total order of readings: event time, then id, or all remaining columns without one."""
    if "event_id" in df.columns:
        return ["event_time", "event_id"]
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return ["event_time", *[c for c in plain if c not in ("event_time", "city")]]


def with_frames(
    df: DataFrame,
    carry: int,
    add: Callable[[DataFrame, WindowSpec], DataFrame],
    key: str = "city",
    order: Sequence[str] | None = None,
    split: bool = True,
) -> DataFrame:
    """Apply ``add(frame, window)`` where frames look back at most ``carry`` rows per key.

    ``split=False`` is for callers that have already limited the rows of each key.
    """
    order = list(order or event_order(df))
    if not split:
        return add(df, Window.partitionBy(key).orderBy(*order))
    dealt = df.repartitionByRange(key, *order).withColumn(_SEGMENT, F.spark_partition_id())
    own = staged(dealt, "segments").withColumn(_CARRIED, F.lit(False))
    frame = own.unionByName(_carried(own, carry, key, order))
    out = add(frame, Window.partitionBy(key, _SEGMENT).orderBy(*order))
    return out.filter(~F.col(_CARRIED)).drop(_SEGMENT, _CARRIED)


def _carried(own: DataFrame, carry: int, key: str, order: list[str]) -> DataFrame:
    """Copies of the rows that later segments look back to.

    ``_back`` counts from a segment's end, ``_at`` along all such rows of a key.
    """
    backwards = Window.partitionBy(_SEGMENT).orderBy(*[F.col(c).desc_nulls_last() for c in (key, *order)])
    tail = own.withColumn("_back", F.row_number().over(backwards)).filter(F.col("_back") <= carry)
    going_on = tail.withColumn("_open", F.first(key).over(backwards)).filter(F.col(key).eqNullSafe(F.col("_open")))
    along = Window.partitionBy(key).orderBy(_SEGMENT, F.col("_back").desc())
    near = Window.partitionBy(key).orderBy("_at").rangeBetween(0, carry - 1)
    last = F.max(F.when(F.col("_back") == 1, F.col(_SEGMENT))).over(near)
    return (
        going_on.withColumn("_at", F.row_number().over(along))
        .withColumn("_last", last)
        .withColumn(_SEGMENT, F.explode(F.sequence(F.col(_SEGMENT) + 1, F.col("_last") + 1)))
        .withColumn(_CARRIED, F.lit(True))
        .drop("_back", "_open", "_at", "_last")
    )
