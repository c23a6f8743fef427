"""Streaming jobs: window report, per-reading and per-window enrichment, state and history.

Each micro-batch runs the same DataFrame transformations as the batch queries.
Per-city history between batches is a small versioned table (the last 29 index
values of each city) read at the start of a batch and replaced at its end, so a
busy city inside a batch is cut over many tasks like in a batch query, no row
passes through the driver, and a restart continues from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from skysift.constants import HISTORY_ROWS, TRIGGER_SECONDS, WATERMARK_SECONDS, WINDOW_SECONDS
from skysift.functions.cleaning import window_start
from skysift.operators.lookups import keep_active, latest_rows, latest_state
from skysift.operators.ordered import event_order
from skysift.operators.rolling import with_history
from skysift.operators.windows import watermarked, window_report
from skysift.plans.enrich import judged_readings, judged_windows, scored_readings, windows_as_readings, with_score
from skysift.sources import files, history
from skysift.sources.catalog import active_set
from skysift.sources.kafka import publish_enriched
from skysift.sources.versions import VersionedTable
from skysift.streaming.keyed import newest_records, use_disk_state, with_keyed_history

Sink = Callable[[DataFrame, int], None]
# Adds ``prediction`` to each row, e.g. ``lambda rows: forecast.score_reading(rows, model)``.
Score = Callable[[DataFrame], DataFrame]

def file_sink(path: str) -> Sink:
    """One folder per batch, so that a replayed batch replaces itself."""

    def write(records: DataFrame, batch_id: int) -> None:
        records.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def once_sink(path: str) -> Sink:
    """One folder per batch that appears as a whole and is never replaced, so that another stream may read it."""

    def write(records: DataFrame, batch_id: int) -> None:
        spark, target = records.sparkSession, f"{path}/batch={batch_id}"
        if files.exists(spark, target):
            return
        # Readers pass over names that begin like this.
        draft = f"{path}/_writing-{batch_id}"
        records.write.mode("overwrite").parquet(draft)
        files.move(spark, draft, target)

    return write


def topic_sink(brokers: str, **options) -> Sink:
    def write(records: DataFrame, batch_id: int) -> None:
        publish_enriched(records, brokers, **options)

    return write


def _start(
    df: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str, drain: bool
) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if drain else {"processingTime": f"{TRIGGER_SECONDS} seconds"}
    return writer.trigger(**trigger).start()


def report_windows(
    readings: DataFrame, sink: Sink, work: str, seconds: int = WINDOW_SECONDS, drain: bool = False
) -> StreamingQuery:
    """Window report in update mode: a changed (window, city) is sent again with each batch."""
    use_disk_state(readings.sparkSession)
    return _start(window_report(watermarked(readings), seconds), sink, f"{work}/checkpoint", "update", drain)


def last_emissions(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Final value per key of an update-mode output written by ``file_sink``."""
    newest = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    rows = spark.read.parquet(path).withColumn("_nth", F.row_number().over(newest))
    return rows.filter("_nth = 1").drop("_nth", "batch")


class _CityHistory:
    """Carries the newest index values of each city from batch to batch."""

    def __init__(self, spark: SparkSession, work: str, rows: DataFrame, order: list[str]):
        known = {f.name: f for f in rows.schema.fields}
        self.order = order
        self.kept = ["city", "arrival", *order, *([] if "aqi" in order else ["aqi"])]
        fields = [StructField("arrival", LongType()) if n == "arrival" else known[n] for n in self.kept]
        self.staging = VersionedTable(spark, f"{work}/staged", rows.schema)
        self.carry = VersionedTable(spark, f"{work}/carry", StructType(fields))

    def extended(self, batch: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame] | None:
        """Batch rows with their ``history``, and the rows to carry on; none for an empty batch.

        Rows keep their order of arrival: everything carried comes before the batch,
        whose rows are ordered by event time.
        """
        self.staging.write(batch, batch_id)
        fresh = self.staging.read(before=batch_id + 1)
        if fresh.isEmpty():
            return None
        arrived = fresh.withColumn("arrival", F.lit(batch_id).cast("long"))
        rows = arrived.unionByName(self.carry.read(before=batch_id), allowMissingColumns=True)
        order = ["arrival", *self.order]
        recent = with_history(rows, order=order).filter(F.col("arrival") == batch_id)
        newest = Window.partitionBy("city").orderBy(*[F.col(c).desc_nulls_last() for c in order])
        tail = rows.select(*self.kept).withColumn("_nth", F.row_number().over(newest))
        return recent.drop("arrival"), tail.filter(F.col("_nth") < HISTORY_ROWS).drop("_nth")

    def keep(self, tail: DataFrame, batch_id: int) -> None:
        self.carry.write(tail, batch_id)


def _enrich(
    rows: DataFrame, order: list[str], finish: Callable[[DataFrame], DataFrame], sink: Sink, work: str, drain: bool
) -> StreamingQuery:
    memory = _CityHistory(rows.sparkSession, work, rows, order)

    def step(batch: DataFrame, batch_id: int) -> None:
        extended = memory.extended(batch, batch_id)
        if extended:
            recent, tail = extended
            sink(finish(recent), batch_id)
            memory.keep(tail, batch_id)

    return _start(rows, step, f"{work}/checkpoint", "append", drain)


def enrich_stream(
    readings: DataFrame,
    sink: Sink,
    work: str,
    extra: list[str] | None = None,
    drain: bool = False,
    score: Score | None = None,
) -> StreamingQuery:
    """One enriched record per reading, with history in order of arrival, predicted by ``score`` if given.

    Within a batch readings are ordered by event time; one that arrives in a later
    batch is appended late. Output equals the batch query when batches arrive in
    order.
    """
    rows = scored_readings(readings)

    def finish(recent: DataFrame) -> DataFrame:
        return judged_readings(*with_score(recent, score), extra)

    return _enrich(rows, event_order(readings), finish, sink, work, drain)


def enrich_keyed(
    readings: DataFrame,
    sink: Sink,
    work: str,
    extra: list[str] | None = None,
    drain: bool = False,
    score: Score | None = None,
    initial: DataFrame | None = None,
    idle_seconds: int | None = None,
) -> StreamingQuery:
    """As ``enrich_stream``, with the history of each city in Spark's keyed state.

    ``initial`` (``keyed.carried_values`` of a history table) is where a fresh checkpoint begins. The sink is to run one action per
    batch: a second one would work the batch out again. A stream that forgets idle cities wakes for its timers and cannot be drained.
    """
    if drain and idle_seconds is not None:
        raise ValueError("a stream with timers does not end by itself")
    recent = with_keyed_history(scored_readings(readings), event_order(readings), initial=initial, idle_seconds=idle_seconds)

    def step(batch: DataFrame, batch_id: int) -> None:
        sink(judged_readings(*with_score(batch, score), extra), batch_id)

    return _start(recent, step, f"{work}/checkpoint", "append", drain)


def gate_late(
    readings: DataFrame,
    punctual: Sink,
    late: Sink,
    work: str,
    seconds: int = WINDOW_SECONDS,
    delay: int = WATERMARK_SECONDS,
    drain: bool = False,
) -> StreamingQuery:
    """Part readings whose window is closed from those that still count.

    A window closes when the watermark reaches its end: the newest event time of all earlier batches, less ``delay``, which is
    the watermark a windowed aggregation has for the batch. Closed ones go to ``late`` with a ``reason`` (``late``, or ``untimed``
    without a time), the watermark and the start of the window they missed; the others go on unchanged. An aggregation that reads
    what ``punctual`` wrote drops nothing more. Each batch is judged by the marks of the batches before it, so a replay decides alike.
    """
    spark = readings.sparkSession
    marks = VersionedTable(spark, f"{work}/marks", "mark timestamp")
    staging = VersionedTable(spark, f"{work}/staged", readings.schema)

    def step(batch: DataFrame, batch_id: int) -> None:
        staging.write(batch, batch_id)
        fresh = staging.read(before=batch_id + 1)
        before = marks.read(before=batch_id)
        newest = before.unionByName(fresh.select(F.col("event_time").alias("mark"))).agg(F.max("mark").alias("mark"))
        marks.write(newest, batch_id)
        mark = before.select(F.unix_micros(F.max("mark"))).first()[0]  # one number
        closed = F.lit(None).cast("timestamp") if mark is None else F.timestamp_micros(F.lit(mark - delay * 1_000_000))
        start = window_start(F.col("event_time"), seconds)
        reason = F.when(F.col("event_time").isNull(), F.lit("untimed")).when(
            F.unix_micros(start) + seconds * 1_000_000 <= F.unix_micros(closed), F.lit("late")
        )
        punctual(fresh.filter(reason.isNull()), batch_id)
        missed = fresh.withColumns({"reason": reason, "watermark": closed, "window_start": start})
        late(missed.filter(F.col("reason").isNotNull()), batch_id)

    return _start(readings, step, f"{work}/checkpoint", "append", drain)


def late_counts(missed: DataFrame) -> DataFrame:
    """Readings that missed their window, per window, city and reason, with the span of their delay in seconds."""
    behind = F.unix_seconds("watermark") - F.unix_seconds("event_time")
    return missed.groupBy("window_start", "city", "reason").agg(
        F.count(F.lit(1)).alias("late_rows"), F.min(behind).alias("least_behind"), F.max(behind).alias("most_behind")
    )


def enrich_window_stream(
    readings: DataFrame,
    sink: Sink,
    work: str,
    seconds: int = WINDOW_SECONDS,
    delay: int = WATERMARK_SECONDS,
    drain: bool = False,
    score: Score | None = None,
) -> StreamingQuery:
    """One enriched record per closed window, in order of the windows' ends, predicted by ``score`` if given."""
    use_disk_state(readings.sparkSession)
    windows = windows_as_readings(window_report(watermarked(readings, delay), seconds))
    return _enrich(windows, ["event_time"], lambda r: judged_windows(*with_score(r, score)), sink, work, drain)


STATE_ORDER = ["timestamp", "arrival"]


def state_table(spark: SparkSession, path: str, records: DataFrame) -> VersionedTable:
    return VersionedTable(spark, path, records.schema.add("arrival", LongType()))


def warm_start(state: VersionedTable, table: DataFrame) -> None:
    """Fill an empty state with each city's latest row of the history table."""
    if state.versions():
        return
    latest = latest_state(latest_rows(table, "timestamp"), ["timestamp"])
    rows = latest.withColumnRenamed("prediction", "next_hour_aqi").withColumn("is_real", F.col("is_real") == 1)
    known = [f.name for f in state.schema.fields if f.name in rows.columns]
    empty = state.spark.createDataFrame([], state.schema)
    state.write(empty.unionByName(rows.select(*known), allowMissingColumns=True), -1)


def upsert_state(state: VersionedTable, records: DataFrame, batch_id: int) -> None:
    """Keep the newest record per city; of equal times the later arrival."""
    arrived = records.withColumn("arrival", F.lit(batch_id).cast("long"))
    merged = state.read(before=batch_id).unionByName(arrived)
    state.write(latest_state(merged, STATE_ORDER), batch_id)


def follow_records(
    records: DataFrame, state: VersionedTable, history_path: str, rejects: str, work: str, drain: bool = False
) -> StreamingQuery:
    """Feed the latest state and the history table from one stream of enriched records.

    A load is named after the query of the checkpoint and its batch: a replay
    replaces itself, and a new checkpoint replaces nothing.
    """
    staging = VersionedTable(records.sparkSession, f"{work}/staged", records.schema)

    def step(batch: DataFrame, batch_id: int) -> None:
        staging.write(batch.filter(F.length("city") > 0), batch_id)
        fresh = staging.read(before=batch_id + 1)
        if not fresh.isEmpty():
            upsert_state(state, fresh, batch_id)
            query_id = fresh.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            history.append_history(fresh, history_path, rejects, load=f"{query_id}-{batch_id}")

    return _start(records, step, f"{work}/checkpoint", "append", drain)


def hold_latest(records: DataFrame, work: str, sink: Sink | None = None, drain: bool = False) -> StreamingQuery:
    """Keep the newest record of each city in Spark's state (see ``keyed.newest_held``); ``sink`` gets those a batch changed."""

    def step(changed: DataFrame, batch_id: int) -> None:
        if sink:
            sink(changed.select("city", "newest.*").drop("_arrival"), batch_id)
        else:
            changed.write.format("noop").mode("overwrite").save()

    return _start(newest_records(records), step, f"{work}/checkpoint", "update", drain)


def keep_live(sink: Sink, path: str, catalog: DataFrame, work: str | None = None) -> Sink:
    """Pass on only cities that are active now: the active set is read anew for each batch.

    With ``work`` the set a batch saw is written there first; a replayed batch, and whoever asks later, sees the same.
    """

    def write(records: DataFrame, batch_id: int) -> None:
        spark = records.sparkSession
        active = active_set(spark, path, catalog)
        if work:
            seen = VersionedTable(spark, f"{work}/active", "name string")
            if batch_id not in seen.versions():
                seen.write(active.coalesce(1), batch_id)
            active = seen.read(before=batch_id + 1)
        sink(keep_active(records, active.withColumnRenamed("name", "city")), batch_id)

    return write
