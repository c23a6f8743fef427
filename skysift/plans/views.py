"""Snapshot, ranking and catalog queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift import constants as K
from skysift.functions import rules
from skysift.functions.cleaning import display, display_number, name_contains, text_or, with_city
from skysift.operators.lookups import keep_active, newest_rows, recent_rows, with_active_flag
from skysift.operators.ordered import event_order
from skysift.plans.enrich import enrich_readings


def latest_records(readings: DataFrame) -> DataFrame:
    """Enriched record of each city's newest reading.

    A record needs 30 readings of history, so only those are kept before anything
    is enriched.
    """
    order = event_order(readings)
    recent = recent_rows(with_city(readings), K.HISTORY_ROWS, order)
    extra = [c for c in order if c == "event_id"]
    return newest_rows(enrich_readings(recent, extra=extra, split=False), 1, ["timestamp", *extra])


def current_snapshot(state: DataFrame, active: DataFrame) -> DataFrame:
    """Latest record of each active city."""
    return keep_active(state, active)


def catalog_listing(catalog: DataFrame, active: DataFrame) -> DataFrame:
    return with_active_flag(catalog, active).orderBy("region", "city")


def ranked(snapshot: DataFrame) -> DataFrame:
    """Worst first; a missing score counts as 0."""
    return snapshot.orderBy(F.coalesce(F.col("priority.score"), F.lit(0)).desc(), "city")


def overview(snapshot: DataFrame) -> DataFrame:
    """Cards of the active cities, worst first."""
    return ranked(snapshot).select(
        "city",
        rules.badge(F.col("priority.priority")).alias("badge"),
        F.coalesce(F.col("priority.score"), F.lit(0)).alias("score"),
        display_number(F.col("aqi")).alias("aqi"),
        display(F.col("category")).alias("category"),
        display_number(F.col("pm25")).alias("pm25"),
        display_number(F.col("pm10")).alias("pm10"),
        F.coalesce("css_class", F.lit("")).alias("css_class"),
    )


def worst_city(state: DataFrame, value: str = "aqi") -> DataFrame:
    """The city with the highest index; a missing one counts as 0."""
    return state.orderBy(F.coalesce(F.col(value), F.lit(0.0)).desc(), "city").limit(1)


def place_view(snapshot: DataFrame) -> DataFrame:
    """Texts of the detail view, with their fallbacks."""
    note = F.col("message")
    return snapshot.select(
        "city",
        display_number(F.col("aqi")).alias("aqi"),
        display(F.col("category")).alias("category"),
        text_or(F.col("trend"), F.lit(K.FLAT)).alias("trend"),
        text_or(note["summary"], F.col("insight"), F.lit(K.INSIGHT_FALLBACK)).alias("insight"),
        display_number(F.col("next_hour_aqi")).alias("prediction"),
        text_or(note["prediction_note"], F.col("next_hour_label"), F.lit("")).alias("prediction_note"),
        text_or(F.col("traffic"), F.lit("Medium")).alias("traffic"),
        rules.shown_alert(note["severity"], note["title"], F.col("alert")).alias("alert"),
        text_or(note["advice"], F.col("health_advisory"), F.lit(K.MISSING)).alias("health"),
    )


def search(catalog: DataFrame, text: str) -> DataFrame:
    return catalog.filter(name_contains(F.col("city"), text))


def filled_selection(selected: DataFrame, visible: DataFrame, size: int = K.MAX_ACTIVE) -> DataFrame:
    """A selection (``city, pos``) filled up to ``size`` from the visible list (``city, pos``).

    The first ``size`` of a selection stay; further names follow in list order.
    """
    added = visible.join(selected, "city", "left_anti")
    listed = selected.withColumn("chosen", F.lit(True)).unionByName(added.withColumn("chosen", F.lit(False)))
    return listed.orderBy(F.col("chosen").desc(), "pos", "city").limit(size)
