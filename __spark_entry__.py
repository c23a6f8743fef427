
from __future__ import annotations

import sys
from collections.abc import Callable
from datetime import datetime
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

import oracles
from skysift.functions import cleaning, rules, scoring, sql
from skysift.operators import features, gaps, lookups, rolling, windows
from skysift.plans import enrich, forecast, trees, views
from skysift.session import fresh_folder, prepare, staged
from skysift.sources import catalog, files, history, readings as messages, tables
from skysift.streaming import jobs, keyed

try:
    import corpus_pipeline
    from skysift.llm import queries as corpus_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "skysift.llm"):
        raise
    corpus_pipeline = corpus_queries = None

Query = Callable[[SparkSession, str], DataFrame]

SIX_HOURS = 21_600
AS_OF = datetime(2024, 1, 20)
HISTORY_HOURS = 72
SILENT_CITY, SILENT_FROM = "NATION_7", "2024-01-06 00:00:00"
TREES = 200
COMPILED_TREES = 20
BATCHES = 5
WARM_LOADS = 2
MERGED_LOADS = 12
MEASURES = ["pm25", "pm10", "no2", "o3", "co", "so2"]


def entry(spark: SparkSession) -> DataFrame:
    """Window report (5 minutes, per city) at the smallest scale."""
    return queries()["window_report_5m"](spark, "/root/testdata/sf0.001")


# --- helpers ---------------------------------------------------------------------------


def _plain(df: DataFrame) -> DataFrame:
    """Zone-free timestamps, as the SQL twins return them."""
    times = {f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields if f.dataType.typeName() == "timestamp"}
    return df.withColumns(times) if times else df


def _list_text(values):
    return F.array_join(F.transform(values, lambda x: x.cast("decimal(6,1)").cast("string")), ",")


def _flat(records: DataFrame) -> DataFrame:
    """Enriched records with nested fields as columns of their own."""
    nested = [F.col(f"message.{f}").alias(f) for f in ("severity", "title", "summary", "prediction_note", "advice", "confidence")]
    nested += [F.col("priority.priority").alias("priority"), F.col("priority.score").alias("score")]
    rest = [c for c in records.columns if c not in ("message", "priority", "history_aqi")]
    return _plain(records.select(*rest, _list_text(F.col("history_aqi")).alias("history_aqi"), *nested))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.scored_readings(tables.readings(spark, sf))


def _trended(spark: SparkSession, sf: str) -> DataFrame:
    """Readings with history and trend: the input of the rules."""
    return rolling.with_trend(rolling.with_history(_scored(spark, sf)))


def _loads(events: DataFrame) -> Column:
    """The load of an event when the events arrive in ``BATCHES`` loads in order of time."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(seconds), F.max(seconds)).first()
    step = ((last or 0) - (first or 0)) // BATCHES + 1
    return F.coalesce(F.floor((seconds - F.lit(first or 0)) / step), F.lit(0))


def _delayed(load: Column) -> Column:
    """Every seventh event arrives one to three loads late, the last load at the latest."""
    behind = F.when(F.col("event_id") % 7 == 3, F.col("event_id") % 3 + 1).otherwise(F.lit(0))
    return F.least(load + behind, F.lit(BATCHES - 1))


def _drained(
    spark: SparkSession,
    sf: str,
    *start: Callable[[DataFrame], StreamingQuery],
    first: int = 0,
    arrival: Callable[[Column], Column] = lambda load: load,
) -> str:
    """Run jobs over ``BATCHES`` loads of the events, by default in order of time, stopped and restarted after each.

    A load is one micro-batch, however many files it has. Loads before ``first`` are left out. Returns where the events are.
    """
    events = spark.read.schema(tables.EVENTS_SCHEMA).parquet(f"{sf}/events.parquet")
    folder, load = fresh_folder(spark, "arrivals"), arrival(_loads(events))
    for n in range(first, BATCHES):
        events.filter(load == n).write.mode("append").parquet(folder)
        for job in start:
            stream = messages.file_stream(spark, folder, tables.EVENTS_SCHEMA)
            job(tables.readings_from_events(stream, tables.cities(spark, sf))).awaitTermination()
    return folder


# --- scoring and windows ---------------------------------------------------------------


def aqi_reading(spark, sf):
    df = windows.scored(tables.readings(spark, sf))
    return df.select("event_id", "city", "pm25", "aqi", "category", "css_class", "health_advisory",
                     scoring.severity(F.col("aqi")).alias("severity"))


def _report(seconds: int, latest: bool) -> Query:
    def query(spark, sf):
        return _plain(windows.window_report(tables.readings(spark, sf), seconds, latest))

    return query


def sql_functions(spark, sf):
    sql.register(spark)
    tables.readings(spark, sf).createOrReplaceTempView("skysift_readings")
    return spark.sql(
        "SELECT event_id, aqi_index(pm25) AS aqi, aqi_category(aqi_index(pm25)) AS category,"
        " aqi_severity(aqi_index(pm25)) AS severity FROM skysift_readings"
    )


def breakpoint_range_join(spark, sf):
    df = lookups.index_from_table(tables.readings(spark, sf), lookups.breakpoint_table(spark))
    return df.select("event_id", "aqi")


def overlapping_ranges(spark, sf):
    """Readings against as many overlapping breakpoint rows as half the events; the lowest matching row wins."""
    readings = tables.readings(spark, sf)
    rows = readings.filter("event_id % 2 = 0 and no2 > 0").select(
        (F.col("pm25") - F.col("no2") / 50.0).alias("lo_pm"), (F.col("pm25") + F.col("no2") / 70.0).alias("hi_pm"),
        F.col("no2").alias("lo_aqi"), (F.col("no2") + 50.0).alias("hi_aqi"),
    )
    return lookups.index_from_ranges(readings, rows, F.col("pm10") / 1.5).select("event_id", "city", "aqi")


# --- latest rows, catalog, history -----------------------------------------------------


def latest_per_city(spark, sf):
    latest = enrich.scored_readings(lookups.latest_rows(tables.readings(spark, sf)))
    return _plain(latest.select("city", "event_time", "event_id", "aqi", *MEASURES, "traffic", "source", "is_real"))


def newest_time(spark, sf):
    return _plain(lookups.newest_time(tables.readings(spark, sf)))


def _history_table(spark, sf) -> DataFrame:
    path = fresh_folder(spark, "history")
    history.append_history(enrich.enrich_readings(tables.readings(spark, sf)), path)
    return history.read_history(spark, path)


def history_table(spark, sf):
    return _plain(_history_table(spark, sf).drop("load"))


def city_history(spark, sf):
    return _plain(history.city_history(_history_table(spark, sf), "NATION_3", AS_OF, HISTORY_HOURS))


def latest_from_history(spark, sf):
    """Newest rows of all cities from the history table, read from its newest dates on; one city has been silent for long."""
    path = fresh_folder(spark, "history")
    silent = (F.col("city") == SILENT_CITY) & (F.col("timestamp") >= F.lit(SILENT_FROM).cast("timestamp"))
    history.append_history(enrich.enrich_readings(tables.readings(spark, sf)).filter(~silent), path)
    return _plain(history.latest_records(spark, path, tables.cities(spark, sf)).drop("load"))


def history_rejects(spark, sf):
    """Rows of the history table that lack a required value: here, times that do not parse."""
    text = F.when(F.col("is_real"), F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise(F.lit("n/a"))
    records = _scored(spark, sf).withColumn("timestamp", cleaning.parsed_time(text))
    good, bad = history.split_rows(history.history_rows(records))
    both = good.withColumn("stored", F.lit(True)).unionByName(bad.withColumn("stored", F.lit(False)))
    return both.groupBy("city", "stored", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("is_real").alias("real_rows"))


def reading_count(spark, sf):
    return history.reading_count(tables.readings(spark, sf))


def current_snapshot(spark, sf):
    records = views.latest_records(tables.readings(spark, sf)).drop("event_id")
    return _flat(views.current_snapshot(records, tables.active_cities(spark, sf)))


def ranked_overview(spark, sf):
    records = views.latest_records(tables.readings(spark, sf))
    return views.overview(views.current_snapshot(records, tables.active_cities(spark, sf)))


def city_view(spark, sf):
    return views.place_view(views.latest_records(tables.readings(spark, sf)))


def worst_city(spark, sf):
    return views.worst_city(enrich.scored_readings(lookups.latest_rows(tables.readings(spark, sf)))).select("city", "aqi")


def stale_cities(spark, sf):
    latest = lookups.latest_rows(tables.readings(spark, sf))
    return lookups.drop_active(latest, tables.active_cities(spark, sf)).select("city", "event_id")


def catalog_active(spark, sf):
    return views.catalog_listing(tables.cities(spark, sf), tables.active_cities(spark, sf)).select("city", "region", "active")


def place_lookup(spark, sf):
    """Active cities with their catalog entry; names the catalog lacks are dropped."""
    known = tables.cities(spark, sf).filter("region <> 'ASIA'")
    return lookups.with_place(tables.active_cities(spark, sf), known)


def regions(spark, sf):
    places = tables.cities(spark, sf).withColumn("region", F.when(F.col("region") != "ASIA", F.col("region")))
    grouped = lookups.by_region(places)
    return grouped.select("region", F.array_join("cities", ",").alias("cities"))


def city_search(spark, sf):
    return views.search(tables.cities(spark, sf), "Nation_1").select("city", "region")


def active_update(spark, sf):
    """Known names of a selection, checked against the limit."""
    known = tables.cities(spark, sf).select(F.col("city").alias("name"), "region")
    picked = known.filter("region = 'EUROPE'").select("name").unionByName(known.limit(1).select(F.lit("Atlantis").alias("name")))
    return catalog.choose_active(picked, known)


def capped_selection(spark, sf):
    places = tables.cities(spark, sf).withColumnRenamed("city_key", "pos")
    visible = views.search(places, "NATION_1").select("city", "pos")
    return views.filled_selection(places.filter("pos in (3, 11, 20)").select("city", "pos"), visible)


def custom_place(spark, sf):
    customer = spark.read.parquet(f"{sf}/customer.parquet")
    key = F.col("c_custkey")
    name = F.when(key % 3 != 0, F.col("c_name"))
    state = F.when(key % 2 == 0, F.col("c_mktsegment")).otherwise(F.lit(""))
    country = F.when(key % 5 != 0, F.col("c_nationkey").cast("string"))
    lat, lon = (key % 90).cast("double") + 0.25, (key % 180).cast("double") - 0.75
    return customer.select("c_custkey", cleaning.place_name(name, state, country, lat, lon).alias("place"))


def custom_catalog(spark, sf):
    """Catalog with added places: of equal names the newest entry wins."""
    places = tables.cities(spark, sf).select(
        F.col("city").alias("name"), F.col("city_key").cast("double").alias("lat"), F.lit(0.0).alias("lon"), "region"
    )
    events = spark.read.parquet(f"{sf}/events.parquet")
    added = events.filter("event_type = 'signup'").select(
        F.concat(F.lit("NATION_"), (F.col("user_id") % 40).cast("string")).alias("name"),
        F.col("value").alias("lat"),
        F.col("event_id").cast("double").alias("lon"),
        F.col("ts").cast("timestamp").alias("added_at"),
    )
    return catalog.with_custom_places(places, added)


# --- history per city and rules --------------------------------------------------------


def trend(spark, sf):
    return _trended(spark, sf).select("event_id", "city", "aqi", "trend")


def history20(spark, sf):
    shown = rules.exposed(F.col("history"))
    return rolling.with_history(_scored(spark, sf)).select("event_id", "city", F.size("history").alias("history_len"),
                                                           _list_text(shown).alias("history_aqi"))


def rolling_stats30(spark, sf):
    stats = rolling.with_history_stats(rolling.with_history(_scored(spark, sf)))
    return stats.select("event_id", "city", "avg_aqi", "max_aqi", "min_aqi", "reading_count")


def history_labels(spark, sf):
    return rolling.history_points(rolling.with_history(_scored(spark, sf)), ["event_id"])


def recent_movement(spark, sf):
    h = F.col("history")
    df = rolling.with_history(_scored(spark, sf))
    return df.select("event_id", F.round(rules.recent_range(h), 1).alias("range6"), F.round(rules.jump(h), 1).alias("jump5"))


def insight(spark, sf):
    text = rules.insight(F.col("history"), F.col("aqi"), F.col("trend"))
    return _trended(spark, sf).select("event_id", text.alias("insight"))


def alert(spark, sf):
    return _trended(spark, sf).select("event_id", rules.alert(F.col("history"), F.col("aqi")).alias("alert"))


def _predicted(spark, sf):
    """Trended readings with a stand-in prediction: the index of the previous reading."""
    h = F.col("history")
    previous = F.coalesce(F.get(h, F.size(h) - 2), F.col("aqi"))
    return _trended(spark, sf).withColumns({"prediction": previous, "severity": scoring.severity(F.col("aqi"))})


def message(spark, sf):
    text = rules.message(F.col("severity"), F.col("aqi"), F.col("trend"), F.col("prediction"), F.col("traffic"), F.size("history"))
    return _predicted(spark, sf).withColumn("m", text).select("event_id", "m.*")


def priority(spark, sf):
    df = _predicted(spark, sf).withColumn("p", rules.priority(F.col("aqi"), F.col("trend"), F.col("prediction")))
    return df.select("event_id", "p.*", rules.badge(F.col("p.priority")).alias("badge"))


def title_join(spark, sf):
    df = _predicted(spark, sf).select("event_id", "severity", "trend")
    return lookups.join_title(df, lookups.title_table(spark)).select("event_id", "severity", "trend", "title")


def shown_alert(spark, sf):
    level, arrow = F.col("severity"), F.col("trend")
    title = F.when(F.col("is_real"), rules.title(level, arrow))
    line = rules.shown_alert(level, title, rules.alert(F.col("history"), F.col("aqi")))
    return _predicted(spark, sf).select("event_id", line.alias("alert_line"))


def prediction_outlook(spark, sf):
    """Clamped predictions with their label and class; here the index pushed beyond both ends."""
    pushed = scoring.clamp_prediction(F.col("aqi") * 3 - 100)
    df = _scored(spark, sf).withColumn("prediction", pushed)
    p = F.col("prediction")
    return df.select("event_id", "prediction", scoring.outlook_label(p).alias("label"), scoring.outlook_css(p).alias("css"),
                     scoring.outlook_label(p * 3, strict=True).alias("strict_label"))


# --- payloads and records --------------------------------------------------------------


def json_roundtrip(spark, sf):
    df = messages.decoded(messages.encoded(messages.as_raw(tables.readings(spark, sf))))
    return _plain(df.drop("timestamp"))


def provider_payload(spark, sf):
    parts = F.struct(F.col("pm25").alias("pm2_5"), "pm10", "no2", "o3", (F.col("co") * 1000).alias("co"),
                     F.when(F.col("is_real"), F.col("so2")).alias("so2"))
    body = F.to_json(F.struct(F.array(F.struct(parts.alias("components"))).alias("list")))
    stored = tables.readings(spark, sf).select("event_id", "city", "event_time", body.alias("payload"))
    return _plain(messages.from_provider(stored))


def traffic_level(spark, sf):
    hour = F.hour("event_time")
    df = tables.readings(spark, sf).select(hour.alias("hour"), cleaning.traffic_level(hour).alias("traffic"))
    return df.groupBy("hour", "traffic").agg(F.count(F.lit(1)).alias("n"))


def field_defaults(spark, sf):
    """Missing values, zero values and empty texts, each filled by its rule."""
    base = tables.readings(spark, sf)
    holes = base.withColumns(
        {
            "pm10": F.when(F.col("no2") > 10, F.col("pm10")),
            "traffic": F.when(F.col("traffic") != "Low", F.col("traffic")),
            "source": F.when(F.col("source") != "view", F.col("source")),
            "is_real": F.when(F.col("source") != "click", F.col("is_real")),
        }
    )
    shown = holes.withColumns(
        {
            "source_text": cleaning.display(F.col("source"), " feed"),
            "real_flag": cleaning.flag(F.col("is_real")),
            "counts_as_real": cleaning.is_real(F.col("is_real")),
            "no2_or_o3": cleaning.or_else(F.col("no2"), F.col("o3")),
        }
    )
    return cleaning.with_defaults(cleaning.with_city(shown)).select(
        "event_id", "pm10", "traffic", "source", "is_real", "source_text", "real_flag", "counts_as_real", "no2_or_o3"
    )


def reading_enrichment(spark, sf):
    return _flat(enrich.enrich_readings(tables.readings(spark, sf), extra=["event_id"]))


def _window_enrichment(seconds: int) -> Query:
    def query(spark, sf):
        return _flat(enrich.window_records(tables.readings(spark, sf), seconds))

    return query


# --- features and forecast -------------------------------------------------------------


def _rounded(df: DataFrame) -> DataFrame:
    return _plain(df.withColumns({c: F.round(c, 6) for c, kind in df.dtypes if kind == "double"}))


def features25(spark, sf):
    return _rounded(features.window_features(tables.readings(spark, sf)))


def real_features(spark, sf):
    return _rounded(features.real_features(tables.readings(spark, sf)))


def single_features(spark, sf):
    return _rounded(features.single_features(tables.readings(spark, sf)).select("event_id", *features.FEATURES))


def _labels(kind: str) -> Query:
    def query(spark, sf):
        return _rounded(features.training_set(tables.readings(spark, sf), kind).select("event_id", "city", *features.FEATURES, "label"))

    return query


def warmup_gate(spark, sf):
    return features.warmed_up(tables.readings(spark, sf)).select("event_id", "city", "ready")


def gap_fill(spark, sf):
    """Every filled point, summed up per city, day and traffic level."""
    filled = gaps.fill_gaps(tables.readings(spark, sf))
    sums = [F.sum(F.rint(F.col(m) * 1000).cast("bigint")).alias(f"{m}_sum") for m in MEASURES]
    days = filled.groupBy("city", F.to_date("event_time").alias("day"), "traffic").agg(
        F.count(F.lit(1)).alias("points"), F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"), *sums
    )
    return _plain(days)


def gbt_rmse(spark, sf):
    """Train, evaluate on the held-out share, and score every reading of a warmed-up city."""
    readings = tables.readings(spark, sf)
    fitted = forecast.train(readings, trees=TREES)
    scored = forecast.score_history(readings, fitted.model)
    return scored.groupBy("city").agg(
        F.count(F.lit(1)).alias("scored_rows"), F.round(F.avg("prediction"), 1).alias("mean_prediction")
    ).withColumn("rmse", F.lit(fitted.rmse))


def _compiled(spark, sf):
    """Readings, written once for all that read them, a fitted forecast and its trees."""
    readings = staged(tables.readings(spark, sf), "readings")
    fitted = forecast.train(readings, trees=COMPILED_TREES)
    return readings, fitted, trees.ensemble(fitted.model)


def _agreement(by_model: DataFrame, by_columns: DataFrame, name: str) -> DataFrame:
    """Per city the rows scored by a fitted model, and those that column expressions score alike, to the last digit."""
    other = by_columns.select("event_id", F.col("prediction").alias("_other"))
    both = by_model.select("event_id", "city", "prediction").join(other, "event_id", "full")
    same = F.col("prediction").eqNullSafe(F.col("_other"))
    return both.groupBy("city").agg(F.count(F.lit(1)).alias(name), F.count_if(same).alias(f"{name}_alike"))


def forecast_expression(spark, sf):
    """A fitted forecast against its column expressions: after each real reading of a warmed-up city, and from each reading alone."""
    readings, fitted, compiled = _compiled(spark, sf)
    rows = forecast.history_features(readings)
    full = _agreement(forecast.score_history(readings, fitted.model, rows), forecast.score_history(readings, compiled, rows), "history_rows")
    alone = _agreement(forecast.score_reading(readings, fitted.model), forecast.score_reading(readings, compiled), "single_rows")
    return alone.join(full, "city", "left").select("city", "single_rows", "single_rows_alike", "history_rows", "history_rows_alike")


def forecast_error(spark, sf):
    """Split, error on the held-out share worked out in plain columns, and a saved model read again."""
    rows = staged(features.training_set(tables.readings(spark, sf)), "rows")
    fit_rows, test_rows = forecast.split(rows)
    path = f"{fresh_folder(spark, 'model')}/forecast"
    readings = tables.readings(spark, sf)
    first = forecast.load_or_train(spark, path, readings, trees=COMPILED_TREES)
    again = forecast.load_or_train(spark, path, readings, trees=1)  # finds the first one
    compiled = trees.ensemble(first)
    error = F.sqrt(F.avg(F.pow(F.col("raw_prediction") - F.col("label"), F.lit(2.0))))
    plain = trees.with_prediction(test_rows, compiled, "raw_prediction").agg(error.alias("plain"))
    measured = forecast.rmse(first.transform(test_rows))
    share = fit_rows.count() / max(rows.count(), 1)
    return plain.select(
        F.lit(rows.count()).alias("rows"), F.lit(fit_rows.count() + test_rows.count()).alias("split_rows"),
        F.lit(abs(share - 0.8) < 0.1).alias("share_is_near"), (F.abs(F.col("plain") / F.lit(measured) - 1) < 1e-9).alias("error_is_equal"),
        F.lit(trees.ensemble(again) == compiled).alias("model_is_kept"),
    )


# --- streams ---------------------------------------------------------------------------


def stream_window_report(spark, sf):
    work = fresh_folder(spark, "report-stream")
    sink = jobs.file_sink(f"{work}/out")
    _drained(spark, sf, lambda rows: jobs.report_windows(rows, sink, work, drain=True))
    return _plain(jobs.last_emissions(spark, f"{work}/out", ["window_start", "city"]))


def stream_enrichment(spark, sf):
    work = fresh_folder(spark, "reading-stream")
    sink = jobs.file_sink(f"{work}/out")
    _drained(spark, sf, lambda rows: jobs.enrich_stream(rows, sink, work, extra=["event_id"], drain=True))
    return _flat(spark.read.parquet(f"{work}/out").drop("batch"))


def stream_scored(spark, sf):
    """As ``stream_enrichment``, with a score step whose predictions can be checked by hand."""
    work = fresh_folder(spark, "scored-stream")

    def score(rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", scoring.clamp_prediction(F.col("aqi") * 3 - 100))

    sink = jobs.file_sink(f"{work}/out")
    _drained(spark, sf, lambda rows: jobs.enrich_stream(rows, sink, work, extra=["event_id"], drain=True, score=score))
    return _flat(spark.read.parquet(f"{work}/out").drop("batch"))


def stream_window_enrichment(spark, sf):
    work = fresh_folder(spark, "window-stream")
    sink = jobs.file_sink(f"{work}/out")
    _drained(spark, sf, lambda rows: jobs.enrich_window_stream(rows, sink, work, drain=True))
    return _flat(spark.read.parquet(f"{work}/out").drop("batch"))


def stream_keyed_enrichment(spark, sf):
    """As ``stream_enrichment``, with each city's history in keyed state."""
    work = fresh_folder(spark, "keyed-stream")
    sink = jobs.file_sink(f"{work}/out")
    _drained(spark, sf, lambda rows: jobs.enrich_keyed(rows, sink, work, extra=["event_id"], drain=True))
    return _flat(spark.read.parquet(f"{work}/out").drop("batch"))


def stream_warm_start(spark, sf):
    """The first loads are enriched as a table and appended to a history; a fresh stream takes up the others where that ends."""
    work, events = fresh_folder(spark, "warm-stream"), spark.read.schema(tables.EVENTS_SCHEMA).parquet(f"{sf}/events.parquet")
    early = tables.readings_from_events(events.filter(_loads(events) < WARM_LOADS), tables.cities(spark, sf))
    history.append_history(enrich.enrich_readings(early), f"{work}/history")
    known = keyed.carried_values(history.read_history(spark, f"{work}/history"), ["timestamp"])
    sink = jobs.file_sink(f"{work}/out")

    def start(rows: DataFrame) -> StreamingQuery:
        return jobs.enrich_keyed(rows, sink, work, extra=["event_id"], drain=True, initial=known)

    _drained(spark, sf, start, first=WARM_LOADS)
    return _flat(spark.read.parquet(f"{work}/out").drop("batch"))


def stream_late_rows(spark, sf):
    """Loads that hold late events: those whose window is closed are kept apart and counted, the report covers the others."""
    work = fresh_folder(spark, "late-stream")
    gate = lambda rows: jobs.gate_late(rows, jobs.once_sink(f"{work}/kept"), jobs.once_sink(f"{work}/late"), f"{work}/gate", drain=True)
    schema = tables.readings(spark, sf).schema

    def report(_: DataFrame) -> StreamingQuery:
        rows = messages.file_stream(spark, f"{work}/kept", schema).select(*schema.names)
        return jobs.report_windows(rows, jobs.file_sink(f"{work}/out"), f"{work}/report", drain=True)

    _drained(spark, sf, gate, report, arrival=_delayed)
    counted = jobs.last_emissions(spark, f"{work}/out", ["window_start", "city"]).select(
        "window_start", "city", "reading_count", "max_aqi", "min_aqi"
    )
    late = jobs.late_counts(spark.read.parquet(f"{work}/late")).select("window_start", "city", "late_rows", "most_behind")
    return _plain(counted.join(late, ["window_start", "city"], "full"))


def stream_forecast(spark, sf):
    """Readings scored by a fitted model inside a stream, against the same model applied to the table: rows that agree, per city."""
    readings, fitted, compiled = _compiled(spark, sf)
    work = fresh_folder(spark, "forecast-stream")
    sink = jobs.file_sink(f"{work}/out")
    score = lambda rows: forecast.score_reading(rows, compiled)
    _drained(spark, sf, lambda rows: jobs.enrich_keyed(rows, sink, work, extra=["event_id"], drain=True, score=score))
    scored = forecast.score_reading(enrich.scored_readings(readings), fitted.model)
    streamed = spark.read.parquet(f"{work}/out").select("event_id", F.col("next_hour_aqi").alias("prediction"))
    return _agreement(scored, streamed, "rows")


def history_merged(spark, sf):
    """Many loads, merged while a reader is under way and one load is replayed: the table's rows, its loads, and what the reader saw."""
    path = fresh_folder(spark, "merged")
    records = staged(enrich.enrich_readings(tables.readings(spark, sf), extra=["event_id"]), "records")
    load = F.pmod(F.col("event_id"), F.lit(MERGED_LOADS))
    for n in range(MERGED_LOADS):
        history.append_history(records.filter(load == n), path, load=f"load-{n}")
    before = history.read_history(spark, path)
    history.merge_loads(spark, path)
    history.append_history(records.filter(load == 3), path, load="load-3")  # a replay
    now = history.read_history(spark, path)
    loads = now.select("event_date", "load").distinct().groupBy("event_date").agg(F.count(F.lit(1)).alias("loads"))
    seen = before.groupBy("event_date").agg(F.count(F.lit(1)).alias("seen_by_reader"))
    return _plain(now.groupBy("event_date", "city").agg(
        F.count(F.lit(1)).alias("rows"), F.max("timestamp").alias("newest"), F.max("aqi").alias("max_aqi")
    ).join(loads, "event_date").join(seen, "event_date"))


def stream_keyed_latest(spark, sf):
    """Enriched records in loads by day of arrival; the newest of each city, read from Spark's state."""
    work = fresh_folder(spark, "latest-stream")
    records = staged(enrich.enrich_readings(tables.readings(spark, sf)), "records")
    days = F.pmod(F.dayofyear("timestamp"), F.lit(3))  # no order of time
    for n in range(3):
        records.filter(days == n).write.mode("append").parquet(f"{work}/records")
        jobs.hold_latest(messages.file_stream(spark, f"{work}/records", records.schema), work, drain=True).awaitTermination()
    return _flat(keyed.newest_held(spark, f"{work}/checkpoint", records.columns))


def stream_live_set(spark, sf):
    """The active set changes with every load; the last load is replayed after one more change, and sees the set it saw first."""
    work, cities = fresh_folder(spark, "live-stream"), tables.cities(spark, sf)
    known = cities.select(F.col("city").alias("name"), "city_key", "region", F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    out, turns = jobs.file_sink(f"{work}/out"), iter([*range(BATCHES), 0])
    sink = jobs.keep_live(lambda rows, n: out(rows.select("event_id", "city"), n), f"{work}/chosen", known, work)

    def start(rows: DataFrame) -> StreamingQuery:
        catalog.save_active(known.filter(F.pmod("city_key", F.lit(BATCHES)) == next(turns)).select("name"), known, f"{work}/chosen")
        return jobs.enrich_keyed(rows, sink, work, extra=["event_id"], drain=True)

    folder = _drained(spark, sf, start)
    # As after a failure between the sink and the end of the batch.
    files.remove(spark, f"{work}/checkpoint/commits/{BATCHES - 1}")
    start(tables.readings_from_events(messages.file_stream(spark, folder, tables.EVENTS_SCHEMA), cities)).awaitTermination()
    return spark.read.parquet(f"{work}/out").select(F.col("batch").cast("bigint").alias("load"), "event_id", "city")


def _followed(spark, sf):
    """Enriched records, streamed into the latest state and the history table."""
    work = fresh_folder(spark, "follow-stream")
    enrich.enrich_readings(tables.readings(spark, sf)).write.parquet(f"{work}/records")
    schema = spark.read.parquet(f"{work}/records").schema
    records = messages.file_stream(spark, f"{work}/records", schema)
    state = jobs.state_table(spark, f"{work}/state", records)
    jobs.follow_records(records, state, f"{work}/history", f"{work}/rejects", work, drain=True).awaitTermination()
    return state.read(), history.read_history(spark, f"{work}/history")


def stream_latest_state(spark, sf):
    state, _ = _followed(spark, sf)
    return _flat(state.drop("arrival"))


def stream_history(spark, sf):
    _, table = _followed(spark, sf)
    return _plain(table.drop("load"))


_QUERIES: dict[str, Query] = {
    "aqi_reading": aqi_reading,
    "window_report_5m": _report(300, latest=False),
    "window_report_6h": _report(SIX_HOURS, latest=False),
    "window_latest": _report(300, latest=True),
    "window_latest_6h": _report(SIX_HOURS, latest=True),
    "sql_functions": sql_functions,
    "breakpoint_range_join": breakpoint_range_join,
    "overlapping_ranges": overlapping_ranges,
    "latest_per_city": latest_per_city,
    "newest_time": newest_time,
    "history_table": history_table,
    "city_history": city_history,
    "latest_from_history": latest_from_history,
    "history_rejects": history_rejects,
    "reading_count": reading_count,
    "current_snapshot": current_snapshot,
    "ranked_overview": ranked_overview,
    "city_view": city_view,
    "worst_city": worst_city,
    "stale_cities": stale_cities,
    "catalog_active": catalog_active,
    "place_lookup": place_lookup,
    "regions": regions,
    "city_search": city_search,
    "active_update": active_update,
    "capped_selection": capped_selection,
    "custom_place": custom_place,
    "custom_catalog": custom_catalog,
    "trend": trend,
    "history20": history20,
    "rolling_stats30": rolling_stats30,
    "history_labels": history_labels,
    "recent_movement": recent_movement,
    "insight": insight,
    "alert": alert,
    "message": message,
    "priority": priority,
    "title_join": title_join,
    "shown_alert": shown_alert,
    "prediction_outlook": prediction_outlook,
    "json_roundtrip": json_roundtrip,
    "provider_payload": provider_payload,
    "traffic_level": traffic_level,
    "field_defaults": field_defaults,
    "reading_enrichment": reading_enrichment,
    "window_enrichment": _window_enrichment(300),
    "window_enrichment_6h": _window_enrichment(SIX_HOURS),
    "features25": features25,
    "real_features": real_features,
    "single_features": single_features,
    "training_labels": _labels("trend"),
    "observed_labels": _labels("observed"),
    "warmup_gate": warmup_gate,
    "gap_fill": gap_fill,
    "gbt_rmse": gbt_rmse,
    "stream_window_report": stream_window_report,
    "stream_enrichment": stream_enrichment,
    "stream_scored": stream_scored,
    "stream_window_enrichment": stream_window_enrichment,
    "forecast_expression": forecast_expression,
    "forecast_error": forecast_error,
    "stream_keyed_enrichment": stream_keyed_enrichment,
    "stream_warm_start": stream_warm_start,
    "stream_late_rows": stream_late_rows,
    "stream_forecast": stream_forecast,
    "stream_keyed_latest": stream_keyed_latest,
    "stream_live_set": stream_live_set,
    "history_merged": history_merged,
    "stream_latest_state": stream_latest_state,
    "stream_history": stream_history,
}


def queries() -> dict[str, Query]:

    def ready(query: Query) -> Query:
        return lambda spark, sf_dir: query(prepare(spark, sf_dir), sf_dir)

    corpus = corpus_queries.queries() | {"pipeline": corpus_pipeline.run} if corpus_queries else {}
    return {name: ready(query) for name, query in _QUERIES.items()} | corpus


def oracle_sql() -> dict[str, str]:
    """SQL twin of each query; ``gbt_rmse`` has none (iterative training)."""
    return oracles.build() | (corpus_queries.oracle_sql() if corpus_queries else {})


def core_queries() -> set[str]:
    """Names of the queries that stand without the corpus operators."""
    return set(_QUERIES)
