"""Per-city history in Spark's own keyed state.

The newest index values of a city are list state in RocksDB. A micro-batch opens the state of its own cities only, and
Spark checkpoints what changed; a restart or a replayed batch finds the state of the batch before. An initial state,
taken from the history table, lets a fresh checkpoint go on where the table ends. A timer drops a city that has been
silent for long, if the caller asks for that.

The rows of a city in one micro-batch are ordered and pass through one task, so the intake limit of the source bounds
what a task holds. Where one city sends more than a task takes, ``jobs.enrich_stream`` cuts it over many.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from skysift.constants import HISTORY_ROWS
from skysift.operators.lookups import recent_rows

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_disk_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB instead of executor heap; a batch uploads its changes, not the whole state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class CityHistory(StatefulProcessor):
    """Gives each row the values of its city's last ``HISTORY_ROWS`` rows, its own last."""

    def __init__(self, names: list[str], order: list[str], value: str, idle_seconds: int | None):
        self.names, self.value, self.idle_seconds = names, value, idle_seconds
        self.order_places = [names.index(name) for name in order]

    def init(self, handle) -> None:
        self.handle = handle
        self.values = handle.getListState("values", "value double")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.values.put([(value,) for value in initialState["values"]])
        self._seen(timerValues)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        build = Row(*self.names, "history")
        recent = deque((value for (value,) in self.values.get()), maxlen=HISTORY_ROWS)
        at = self.names.index(self.value)
        for row in sorted(self._plain(rows), key=self._place):
            recent.append(row[at])
            yield build(*row, [value for value in recent if value is not None])
        self.values.put([(value,) for value in list(recent)[1 - HISTORY_ROWS :]])
        self._seen(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.values.clear()
        return iter(())

    def _plain(self, rows: Iterator[Row]) -> Iterator[tuple]:
        """Values in order of ``names``, looked up by name once for all rows."""
        places = None
        for row in rows:
            if places is None:
                places = [row.__fields__.index(name) for name in self.names]
            values = tuple(row)
            yield tuple([values[place] for place in places])

    def _place(self, row: tuple) -> tuple:
        """Nulls first, as in the windows of a table."""
        return tuple([(row[at] is not None, row[at]) for at in self.order_places])

    def _seen(self, timerValues) -> None:
        if self.idle_seconds is None:
            return
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.idle_seconds)


def carried_values(table: DataFrame, order: list[str], key: str = "city", value: str = "aqi") -> DataFrame:
    """(city, values): the newest values of each city of a table, oldest first; ``order`` starts with a time."""
    tail = recent_rows(table.filter(F.length(key) > 0), HISTORY_ROWS - 1, order, key)
    pairs = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_value"))))  # at most 29 a city
    return tail.groupBy(key).agg(pairs.alias("_pairs")).select(key, F.transform("_pairs", lambda p: p["_value"]).alias("values"))


def with_keyed_history(
    rows: DataFrame,
    order: list[str],
    key: str = "city",
    value: str = "aqi",
    initial: DataFrame | None = None,
    idle_seconds: int | None = None,
) -> DataFrame:
    """Add ``history`` to a stream of rows, in order of arrival, within a micro-batch by ``order``.

    ``initial`` (see ``carried_values``) is read by the first batch of a fresh checkpoint only. With ``idle_seconds`` a city without
    rows for so long starts anew.
    """
    use_disk_state(rows.sparkSession)
    times = [f.name for f in rows.schema.fields if f.dataType.typeName() == "timestamp"]
    # Times travel as whole microseconds, which no zone of a machine touches.
    plain = rows.withColumns({name: F.unix_micros(name) for name in times})
    fields = [StructField(f.name, LongType() if f.name in times else f.dataType) for f in rows.schema.fields]
    schema = StructType([*fields, StructField("history", ArrayType(DoubleType()))])
    processor = CityHistory(rows.columns, order, value, idle_seconds)
    out = plain.groupBy(key).transformWithState(
        processor,
        schema,
        "Append",
        "ProcessingTime" if idle_seconds is not None else "None",
        initial.groupBy(key) if initial is not None else None,
    )
    return out.withColumns({name: F.timestamp_micros(name) for name in times})


def state_of(spark: SparkSession, checkpoint: str, key: str = "city") -> DataFrame:
    """(city, value): the values held after the last complete batch."""
    source = spark.read.format("statestore").option("stateVarName", "values").option("flattenCollectionTypes", "true")
    return source.load(checkpoint).select(F.col(f"key.{key}").alias(key), F.col("list_element.value").alias("value"))


def newest_records(records: DataFrame, key: str = "city") -> DataFrame:
    """Update-mode aggregate of a stream: the newest record of each city; of equal times the one of the later micro-batch.

    A micro-batch has one time of its own, which Spark logs before it runs, so a replay orders alike. Equal times inside a batch are
    ordered by the other columns. State is written for the cities of the batch alone.
    """
    use_disk_state(records.sparkSession)
    rest = [c for c in records.columns if c not in (key, "timestamp")]
    arrived = records.filter(F.length(key) > 0).withColumn("_arrival", F.current_timestamp())
    return arrived.groupBy(key).agg(F.max(F.struct("timestamp", "_arrival", *rest)).alias("newest"))


def newest_held(spark: SparkSession, checkpoint: str, columns: list[str], key: str = "city") -> DataFrame:
    """The records that ``newest_records`` holds, read from Spark's state, in the given columns."""
    held = spark.read.format("statestore").load(checkpoint)
    (buffer,) = held.schema["value"].dataType.names
    newest = F.col("value").getField(buffer)
    return held.select(*[F.col(f"key.{key}").alias(c) if c == key else newest.getField(c).alias(c) for c in columns])
