"""Latest rows, membership and dimension joins.

No join carries a broadcast hint: the optimizer knows the sizes of dimensions and
of limited sets, and broadcasts them only while they are below its threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skysift.constants import BREAKPOINTS, CATEGORIES, TITLES
from skysift.functions import rules
from skysift.session import staged


def latest_rows(df: DataFrame, time: str = "event_time", key: str = "city") -> DataFrame:
    """All rows holding the newest time of their key; ties are kept.

    A hash aggregate over two columns finds the times; that table (one row per key)
    is staged, so the rows are filtered by a join planned by its real size and
    nothing is sorted.
    """
    named = df.filter(F.length(key) > 0)
    newest = staged(newest_time(named, time, key), "newest")
    match = (named[key] == newest[key]) & named[time].eqNullSafe(newest["max_ts"])
    return named.join(newest, match, "left_semi")


def latest_state(df: DataFrame, order: list[str], key: str = "city") -> DataFrame:
    """Exactly one row per key: the last in ``order``."""
    return newest_rows(df.filter(F.length(key) > 0), 1, order, key)


def recent_rows(df: DataFrame, n: int, order: list[str], key: str = "city") -> DataFrame:
    """The last ``n`` rows of each key of a large table; ``order`` starts with a time.

    Rows are first counted per hour. Only the newest hours that hold ``n`` rows of
    a key are kept, and only those rows are ranked.
    """
    hour = F.date_trunc("hour", order[0])
    counts = df.groupBy(key, hour.alias("_hour")).agg(F.count(F.lit(1)).alias("_rows"))
    back = Window.partitionBy(key).orderBy(F.col("_hour").desc_nulls_last())
    newer = F.sum("_rows").over(back) - F.col("_rows")
    floors = counts.withColumn("_newer", newer).filter(F.col("_newer") < n).groupBy(key)
    # A key with too few timed rows keeps those without a time as well.
    needed = floors.agg(F.min("_hour").alias("_floor"), F.max(F.col("_hour").isNull()).alias("_untimed"))
    kept = df.join(staged(needed, "floors"), key)
    recent = kept.filter((F.col(order[0]) >= F.col("_floor")) | (F.col("_untimed") & F.col(order[0]).isNull()))
    return newest_rows(recent.drop("_floor", "_untimed"), n, order, key)


def newest_rows(df: DataFrame, n: int, order: list[str], key: str = "city") -> DataFrame:
    """The last ``n`` rows of each key, limited before the shuffle."""
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_nth", F.row_number().over(newest)).filter(F.col("_nth") <= n).drop("_nth")


def newest_time(df: DataFrame, time: str = "event_time", key: str = "city") -> DataFrame:
    return df.groupBy(key).agg(F.max(time).alias("max_ts"))


def keep_active(df: DataFrame, active: DataFrame, key: str = "city") -> DataFrame:
    return df.join(active, key, "left_semi")


def drop_active(df: DataFrame, active: DataFrame, key: str = "city") -> DataFrame:
    """Rows whose key left the active set."""
    return df.join(active, key, "left_anti")


def with_place(df: DataFrame, catalog: DataFrame, key: str = "city") -> DataFrame:
    """Add the catalog's columns; unknown names are dropped."""
    return df.join(catalog, key)


def with_active_flag(catalog: DataFrame, active: DataFrame, key: str = "city") -> DataFrame:
    marked = active.select(key).distinct().withColumn("_active", F.lit(True))
    return catalog.join(marked, key, "left").withColumn("active", F.col("_active").isNotNull()).drop("_active")


def by_region(catalog: DataFrame, name: str = "city") -> DataFrame:
    """Names per region, sorted; places without a region are ``Global``."""
    region = F.coalesce(F.nullif(F.col("region"), F.lit("")), F.lit("Global"))
    return catalog.groupBy(region.alias("region")).agg(F.sort_array(F.collect_list(name)).alias("cities"))


def title_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TITLES, "severity string, trend string, title string")


def join_title(df: DataFrame, titles: DataFrame) -> DataFrame:
    """Title from a template table, or the plain one where no template fits."""
    plain = rules.plain_title(F.col("severity"), F.col("trend"))
    return df.join(titles, ["severity", "trend"], "left").withColumn("title", F.coalesce("title", plain))


def breakpoint_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(lo, hi, float(base), float(top)) for lo, hi, base, top in BREAKPOINTS],
        "lo_pm double, hi_pm double, lo_aqi double, hi_aqi double",
    )


def category_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "max int, label string, css string, health_advisory string")


def _last_before(table: DataFrame, value: Column, name: str, function) -> DataFrame:
    """One row per segment with ``function`` of ``value`` over all earlier segments; a row per shuffle partition, no more."""
    earlier = Window.orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    return table.select("_segment", function(value).over(earlier).alias(name))


def first_matches(ranges: DataFrame, order: list[str], low: str, high: str) -> DataFrame:
    """Of overlapping ranges (both ends belong to them) those that are the first, in ``order``, to hold some value.

    ``order`` begins with ``low``. A range is one of them if it ends after all ranges before it; the ends of those kept
    ascend, and the range for a value is the first kept one that ends at or after it, if that begins early enough.
    """
    known = ranges.filter(F.col(low).isNotNull() & F.col(high).isNotNull())
    dealt = staged(known.repartitionByRange(*order).withColumn("_segment", F.spark_partition_id()), "ranges")
    tops = dealt.groupBy("_segment").agg(F.max(high).alias("_top"))
    before = _last_before(tops, F.col("_top"), "_before", F.max)
    inside = Window.partitionBy("_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.max(high).over(inside), F.col("_before"))
    kept = dealt.join(before, "_segment").withColumn("_reached", reached)
    return kept.filter(F.col("_reached").isNull() | (F.col(high) > F.col("_reached"))).drop("_segment", "_before", "_reached")


def with_first_range(df: DataFrame, value: Column, ranges: DataFrame, order: list[str], low: str, high: str, name: str) -> DataFrame:
    """Add, as a struct, the first range in ``order`` that holds the value of a row; null where none does.

    Values and ends of ranges are dealt once into segments of their common order, ties by a number of their own, so that neither a
    frequent value nor a dense stretch of ranges is one task. A segment's last values look to the first end of a later one.
    """
    first = first_matches(ranges.select(*order), order, low, high)
    range_type = f"struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in first.schema.fields)}>"
    row = F.struct(*df.columns)
    points = df.select(value.alias("_at"), row.alias("_row"), F.lit(None).cast(range_type).alias("_range"), F.monotonically_increasing_id().alias("_own"))
    # Of equal places values come before ends: a range holds its end.
    points = points.withColumn("_kind", F.lit(0))
    no_row = F.lit(None).cast(points.schema["_row"].dataType)
    ends = first.select(F.col(high).alias("_at"), no_row.alias("_row"), F.struct(*first.columns).alias("_range"), F.lit(0).cast("long").alias("_own"))
    by = ["_at", "_kind", "_own"]
    both = points.unionByName(ends.withColumn("_kind", F.lit(1))).repartitionByRange(*by)
    dealt = staged(both.withColumn("_segment", -F.spark_partition_id()), "points")
    heads = dealt.groupBy("_segment").agg(F.min_by("_range", F.when(F.col("_kind") == 1, F.col("_at"))).alias("_head"))
    later = _last_before(heads, F.col("_head"), "_later", lambda c: F.last(c, ignorenulls=True))
    back = Window.partitionBy("_segment").orderBy(*[F.col(c).desc() for c in by]).rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.join(later, "_segment").withColumn("_met", F.coalesce(F.last("_range", ignorenulls=True).over(back), F.col("_later")))
    holds = F.col("_at") >= F.col(f"_met.{low}")
    return met.filter("_kind = 0").select("_row.*", F.when(holds, F.col("_met")).alias(name))


def index_from_ranges(df: DataFrame, breakpoints: DataFrame, pm25: Column | None = None) -> DataFrame:
    """As ``index_from_table``, for a breakpoint table of any size: values and breakpoints are merged in order."""
    x = F.col("pm25") if pm25 is None else pm25
    order = ["lo_pm", "hi_pm", "lo_aqi", "hi_aqi"]
    found = with_first_range(df.withColumn("_x", x.cast("double")), F.col("_x"), breakpoints, order, "lo_pm", "hi_pm", "_hit")
    return found.withColumn("aqi", _range_score(F.col("_x"), F.col("_hit"))).drop("_x", "_hit")


def _range_score(x: Column, hit: Column) -> Column:
    score = hit["lo_aqi"] + (x - hit["lo_pm"]) / (hit["hi_pm"] - hit["lo_pm"]) * (hit["hi_aqi"] - hit["lo_aqi"])
    return F.when(x.isNull(), F.lit(0.0)).otherwise(F.coalesce(score, F.lit(500.0)))


def index_from_table(df: DataFrame, breakpoints: DataFrame, pm25: Column | None = None) -> DataFrame:
    """Score against a user's small breakpoint table; the lowest matching row wins.

    The table becomes one sorted array, put into each row as a scalar subquery, so
    the readings are neither multiplied nor regrouped.
    """
    x = F.col("pm25") if pm25 is None else pm25
    row = F.struct("lo_pm", "hi_pm", "lo_aqi", "hi_aqi")
    scale = breakpoints.agg(F.sort_array(F.collect_list(row))).scalar()
    hit = F.get(F.filter("_scale", lambda b: (x >= b["lo_pm"]) & (x <= b["hi_pm"])), F.lit(0))
    return df.withColumn("_scale", scale).withColumn("aqi", _range_score(x, hit)).drop("_scale")
