"""Session settings and column helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Separators of words: space and the ASCII controls from tab to carriage return.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
ARROW_ROWS = 1_000


def ready(spark: SparkSession) -> SparkSession:
    """Times in UTC; Arrow batches small enough for a worker to hold, long texts included."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text in order; none for a null, empty or blank one."""
    core = F.btrim(text, F.lit(SPACES))
    return F.when(core != "", F.split(core, SPACE_RUN)).otherwise(F.array().cast("array<string>"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc(key: Column) -> Column:
    """CRC-32 of a key written as text."""
    return F.crc32(key.cast("string").cast("binary"))


#: Keys with at least one in so many of a table's rows count as hot; there are at most as many of them.
HOT_SHARE = 1_000


def join_counted(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Left join of staged ``rows`` with staged ``groups`` of one row per key, whose ``size`` counts a key's rows.

    The at most ``HOT_SHARE`` hot keys are joined beside the rows by broadcast; the others are shuffled, none of
    them large. ``key`` is not null in ``groups``.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.filter(F.col(size) * HOT_SHARE >= total)
    rest = groups.filter(F.col(size) * HOT_SHARE < total)
    met = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    missing = others.filter(F.col(key).isNull())
    for field in groups.schema:
        if field.name != key:
            missing = missing.withColumn(field.name, F.lit(None).cast(field.dataType))
    return met.unionByName(others.filter(F.col(key).isNotNull()).join(rest, key, "left")).unionByName(missing)
