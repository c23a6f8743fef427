"""SQL twins of the registered queries, for DuckDB on the same tables.

Written independently of the Spark expressions; only sentences and labels are
shared with ``skysift.constants``.
"""

from __future__ import annotations

from skysift import constants as K


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# The breakpoints of the index.
def _index(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL THEN 0::DOUBLE
      WHEN {x} >= 0 AND {x} <= 12::DOUBLE THEN 0::DOUBLE + ({x} - 0::DOUBLE) / (12::DOUBLE - 0::DOUBLE) * 50::DOUBLE
      WHEN {x} >= 12::DOUBLE AND {x} <= 35.4::DOUBLE THEN 51::DOUBLE + ({x} - 12::DOUBLE) / (35.4::DOUBLE - 12::DOUBLE) * 49::DOUBLE
      WHEN {x} >= 35.4::DOUBLE AND {x} <= 55.4::DOUBLE THEN 101::DOUBLE + ({x} - 35.4::DOUBLE) / (55.4::DOUBLE - 35.4::DOUBLE) * 49::DOUBLE
      WHEN {x} >= 55.4::DOUBLE AND {x} <= 150.4::DOUBLE THEN 151::DOUBLE + ({x} - 55.4::DOUBLE) / (150.4::DOUBLE - 55.4::DOUBLE) * 49::DOUBLE
      WHEN {x} >= 150.4::DOUBLE AND {x} <= 250.4::DOUBLE THEN 201::DOUBLE + ({x} - 150.4::DOUBLE) / (250.4::DOUBLE - 150.4::DOUBLE) * 99::DOUBLE
      WHEN {x} >= 250.4::DOUBLE AND {x} <= 350.4::DOUBLE THEN 301::DOUBLE + ({x} - 250.4::DOUBLE) / (350.4::DOUBLE - 250.4::DOUBLE) * 99::DOUBLE
      WHEN {x} >= 350.4::DOUBLE AND {x} <= 500.4::DOUBLE THEN 401::DOUBLE + ({x} - 350.4::DOUBLE) / (500.4::DOUBLE - 350.4::DOUBLE) * 99::DOUBLE
      ELSE 500::DOUBLE END"""


def _tier(x: str, field: int, beyond: str | None = None) -> str:
    last = K.CATEGORIES[-1][field] if beyond is None else beyond
    arms = " ".join(f"WHEN {x} <= {tier[0]} THEN {_text(tier[field])}" for tier in K.CATEGORIES)
    return f"CASE {arms} ELSE {_text(last)} END"


def _traffic(hour: str) -> str:
    return f"CASE WHEN {hour} IN (7,8,9,10,17,18,19,20) THEN 'High' WHEN {hour} IN (2,3,4,5) THEN 'Low' ELSE 'Medium' END"


READINGS = f"""
cities AS (SELECT n_nationkey AS city_key, n_name AS city, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
active AS (SELECT city FROM cities ORDER BY city_key LIMIT 8),
numbered AS (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
readings AS (
  SELECT event_id, ts AS event_time, city, region, value AS pm25, value + k AS pm10, k AS no2, 100::DOUBLE - k AS o3,
         k / 100::DOUBLE AS co, k / 4::DOUBLE AS so2, {_traffic("hour(ts)")} AS traffic,
         event_type AS source, event_type <> 'error' AS is_real
  FROM numbered JOIN cities ON city_key = user_id % 25)"""

SCORED = f"""{READINGS},
raw AS (SELECT *, {_index("pm25")} AS aqi_raw FROM readings),
scored AS (SELECT *, round(aqi_raw, 1) AS aqi FROM raw)"""


def _shown(history: str) -> str:
    return (
        f"array_to_string(list_transform({history}[greatest(len({history}) - 19, 1):],"
        " lambda v: CAST(v AS DECIMAL(6,1))::VARCHAR), ',')"
    )


def _sequence(source: str, order: str) -> str:
    """History, trend and the measures derived from it, for any table with city and aqi."""
    return f"""
hist AS (SELECT *, list(aqi) OVER (PARTITION BY city ORDER BY {order} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS history FROM {source}),
ends AS (SELECT *, len(history) AS hn, history[greatest(len(history) - 5, 1):] AS r6, history[greatest(len(history) - 4, 1):] AS r5 FROM hist),
moved AS (SELECT *, (r6[len(r6)-2] + r6[len(r6)-1] + r6[len(r6)]) / 3 - (r6[1] + r6[2] + r6[3]) / 3 AS delta,
          list_max(r6) - list_min(r6) AS range6, r5[len(r5)] - r5[1] AS jump5 FROM ends),
trended AS (SELECT *, CASE WHEN hn < 3 THEN '→' WHEN delta > 5 THEN '↑' WHEN delta < -5 THEN '↓' ELSE '→' END AS trend,
            {_tier("aqi", 2)} AS severity FROM moved)"""


HISTORY = f"""{SCORED},{_sequence("scored", "event_time, event_id")}"""

_INSIGHT = f"""CASE WHEN hn < 3 THEN {_text(K.INSIGHT["baseline"])}
 WHEN aqi > 200 THEN {_text(K.INSIGHT["critical"])}
 WHEN range6 > 30 THEN {_text(K.INSIGHT["variable"])}
 WHEN trend = '↑' AND aqi > 100 THEN {_text(K.INSIGHT["rising_high"])}
 WHEN trend = '↓' AND aqi > 100 THEN {_text(K.INSIGHT["falling_high"])}
 WHEN trend = '→' AND aqi <= 50 THEN {_text(K.INSIGHT["flat_good"])}
 WHEN trend = '→' THEN {_text(K.INSIGHT["flat"])}
 WHEN trend = '↑' THEN {_text(K.INSIGHT["rising"])}
 ELSE {_text(K.INSIGHT["falling"])} END"""

_ALERT = f"""CASE WHEN hn < 2 THEN NULL WHEN jump5 > 25 THEN {_text(K.ALERT_SPIKE)}
 WHEN aqi > 300 THEN {_text(K.ALERT_LEVELS[0][1])} WHEN aqi > 200 THEN {_text(K.ALERT_LEVELS[1][1])}
 WHEN aqi > 150 THEN {_text(K.ALERT_LEVELS[2][1])} WHEN aqi > 100 THEN {_text(K.ALERT_LEVELS[3][1])} END"""


def _note(prediction: str) -> str:
    d = f"({prediction} - aqi)"
    return f"""CASE WHEN {d} > 15 THEN {_text(K.OUTLOOK["much_worse"])} WHEN {d} > 5 THEN {_text(K.OUTLOOK["worse"])}
 WHEN {d} < -15 THEN {_text(K.OUTLOOK["much_better"])} WHEN {d} < -5 THEN {_text(K.OUTLOOK["better"])}
 ELSE {_text(K.OUTLOOK["same"])} END"""


_SUMMARY = f"""CASE severity WHEN 'good' THEN 'Good' WHEN 'moderate' THEN 'Moderate' WHEN 'sensitive' THEN 'Sensitive'
 WHEN 'unhealthy' THEN 'Unhealthy' WHEN 'very-unhealthy' THEN 'Very Unhealthy' ELSE 'Hazardous' END || ' air quality with '
 || CASE trend WHEN '↑' THEN 'upward' WHEN '↓' THEN 'downward' ELSE 'stable' END || ' trend.'
 || CASE WHEN lower(traffic) = 'high' THEN {_text(K.TRAFFIC_SENTENCE)} ELSE '' END"""

_TITLE = "CASE " + " ".join(f"WHEN severity = '{s}' AND trend = '{t}' THEN {_text(x)}" for s, t, x in K.TITLES) + " END"
_ADVICE = "CASE severity " + " ".join(f"WHEN '{s}' THEN {_text(x)}" for s, x in K.ADVICE.items()) + " END"
_CONFIDENCE = "CASE WHEN hn >= 15 THEN 'high' WHEN hn >= 5 THEN 'medium' ELSE 'low' END"


def _points(prediction: str) -> str:
    return (
        "(aqi * 0.5::DOUBLE + CASE WHEN trend = '↑' THEN 20::DOUBLE ELSE 0::DOUBLE END"
        f" + CASE WHEN {prediction} > aqi THEN ({prediction} - aqi) * 0.3::DOUBLE ELSE 0::DOUBLE END)"
    )


def _level(points: str) -> str:
    return f"CASE WHEN {points} >= 150 THEN 'critical' WHEN {points} >= 100 THEN 'high' WHEN {points} >= 40 THEN 'medium' ELSE 'low' END"


def _message(prediction: str) -> str:
    return (
        f"severity, {_TITLE} AS title, {_SUMMARY} AS summary, {_note(prediction)} AS prediction_note,"
        f" {_ADVICE} AS advice, {_CONFIDENCE} AS confidence"
    )


def _record(time: str, strict: bool, ahead: str = "aqi") -> str:
    """Columns of the enriched record that are decided from aqi and history."""
    beyond = ("Unknown", "good") if strict else (None, None)
    return f"""city, {time} AS timestamp, aqi, pm25, pm10, no2, o3, co, so2, trend, {_INSIGHT} AS insight, coalesce({_ALERT}, '') AS alert,
 traffic, source, is_real, round({ahead}, 1) AS next_hour_aqi, {_tier(ahead, 1, beyond[0])} AS next_hour_label,
 {_tier(ahead, 2, beyond[1])} AS next_hour_css, {_shown("history")} AS history_aqi, {_message(ahead)},
 {_level(_points(ahead))} AS priority, round_even({_points(ahead)}, 0)::INT AS score"""


_STATS30 = """round(list_sum(list_transform(history, lambda v: CAST(v AS DECIMAL(18,4)))) / len(history) + 1e-9, 1)::DOUBLE AS avg_aqi,
 round(list_max(history), 1) AS max_aqi, round(list_min(history), 1) AS min_aqi, len(history) AS reading_count"""

def _reading_records(source: str, ahead: str = "aqi") -> str:
    return f"""SELECT event_id, {_record("event_time", False, ahead)}, {_tier("aqi", 1)} AS category, {_tier("aqi", 2)} AS css_class,
            {_tier("aqi", 3)} AS health_advisory, {_STATS30} FROM {source}"""


RECORDS = f"""{HISTORY},
records AS ({_reading_records("trended")}),
latest AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY city ORDER BY timestamp DESC, event_id DESC) = 1)"""

_HISTORY_COLUMNS = """city, timestamp, aqi, pm25, pm10, no2, o3, co, so2, trend, CASE WHEN next_hour_aqi = 0 THEN NULL ELSE next_hour_aqi END AS prediction,
 CASE WHEN is_real THEN 1 ELSE 0 END AS is_real, category, source"""


def _windows(seconds: int) -> str:
    """Window report with the newest reading of each window."""
    return f"""{SCORED},
spans AS (SELECT *, time_bucket(INTERVAL '{seconds} seconds', event_time) AS window_start FROM raw),
report AS (
  SELECT window_start, window_start + INTERVAL '{seconds} seconds' AS window_end, city,
    round(avg(aqi_raw), 1) AS avg_aqi, round(avg(pm25) + 1e-9, 2) AS avg_pm25, round(avg(pm10) + 1e-9, 2) AS avg_pm10,
    round(avg(no2) + 1e-9, 2) AS avg_no2, round(avg(o3) + 1e-9, 2) AS avg_o3, round(avg(co) + 1e-9, 3) AS avg_co,
    round(avg(so2) + 1e-9, 2) AS avg_so2, max(aqi_raw) AS max_aqi, min(aqi_raw) AS min_aqi, count(*) AS reading_count
  FROM spans GROUP BY ALL),
newest AS (SELECT window_start, city, aqi_raw AS latest_aqi, pm25 AS latest_pm25, pm10 AS latest_pm10, no2 AS latest_no2,
    o3 AS latest_o3, co AS latest_co, so2 AS latest_so2, traffic, source, is_real, {_tier("aqi_raw", 1)} AS category,
    {_tier("aqi_raw", 2)} AS css_class, {_tier("aqi_raw", 3)} AS health_advisory
  FROM spans QUALIFY row_number() OVER (PARTITION BY window_start, city ORDER BY event_time DESC, event_id DESC) = 1),
full_report AS (SELECT * FROM report JOIN newest USING (window_start, city))"""


def _window_records(seconds: int, closed: bool = False) -> str:
    kept = ", (SELECT max(event_time) - INTERVAL '600 seconds' AS mark FROM readings) WHERE window_end <= mark" if closed else ""
    return f"""WITH {_windows(seconds)},
points AS (SELECT city, window_end, round(CASE WHEN latest_aqi = 0 THEN avg_aqi ELSE latest_aqi END, 1) AS aqi,
   round(latest_pm25, 2) AS pm25, round(latest_pm10, 2) AS pm10, round(latest_no2, 2) AS no2, round(latest_o3, 2) AS o3,
   round(latest_co, 3) AS co, round(latest_so2, 2) AS so2, category, css_class, health_advisory, traffic, source, is_real,
   round(avg_aqi, 1) AS avg_aqi, round(max_aqi, 1) AS max_aqi, round(min_aqi, 1) AS min_aqi, reading_count FROM full_report{kept}),
{_sequence("points", "window_end")}
SELECT {_record("window_end", True)}, category, css_class, health_advisory, avg_aqi, max_aqi, min_aqi, reading_count FROM trended"""


_MEASURES = ["pm25", "pm10", "no2", "o3", "co"]


def _feature_columns() -> str:
    parts = []
    for m in _MEASURES:
        parts += [
            f"round(avg({m}) OVER w, 6) AS {m}_mean",
            f"round(stddev_pop({m}) OVER w, 6) AS {m}_std",
            f"round({m}, 6) AS {m}_last",
            f"round(({m} - first({m}) OVER w) / (count(*) OVER w - 1), 6) AS {m}_step",
        ]
    parts += [
        "round(pm25, 6) AS pm25_t0",
        "round(coalesce(lag(pm25, 1) OVER o, pm25), 6) AS pm25_t1",
        "round(coalesce(lag(pm25, 2) OVER o, pm25), 6) AS pm25_t2",
        "round(sin(2 * pi() * hour(event_time) / 24), 6) AS hour_sin",
        "round(cos(2 * pi() * hour(event_time) / 24), 6) AS hour_cos",
    ]
    return ", ".join(parts)


def _features(where: str, at_least: int) -> str:
    return f"""WITH {READINGS} SELECT city, event_time, event_id, {_feature_columns()}
FROM readings WHERE {where}
WINDOW w AS (PARTITION BY city ORDER BY event_time, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
       o AS (PARTITION BY city ORDER BY event_time, event_id)
QUALIFY count(*) OVER w >= {at_least}"""


def _single_feature_columns() -> str:
    parts = []
    for m in _MEASURES:
        parts += [f"round({m}, 6) AS {m}_mean", f"0::DOUBLE AS {m}_std", f"round({m}, 6) AS {m}_last", f"0::DOUBLE AS {m}_step"]
    parts += [f"round(pm25, 6) AS pm25_t{i}" for i in range(3)]
    parts += ["round(sin(2 * pi() * hour(event_time) / 24), 6) AS hour_sin", "round(cos(2 * pi() * hour(event_time) / 24), 6) AS hour_cos"]
    return ", ".join(parts)


def _display(x: str, suffix: str = "") -> str:
    return f"coalesce(nullif({x}::VARCHAR, '') || '{suffix}', '—')"


def _number(x: str) -> str:
    return f"coalesce(regexp_replace({x}::VARCHAR, '\\.0$', ''), '—')"


def build() -> dict[str, str]:
    report = "window_start, window_end, city, avg_aqi, avg_pm25, avg_pm10, avg_no2, avg_o3, avg_co, avg_so2, max_aqi, min_aqi, reading_count"
    predicted = f"""WITH {HISTORY}, predicted AS (SELECT *, coalesce(history[hn - 1], aqi) AS prediction FROM (SELECT * FROM trended WHERE hn > 1)
 UNION ALL SELECT *, aqi AS prediction FROM trended WHERE hn = 1)"""
    history_rows = f"WITH {RECORDS} SELECT {_HISTORY_COLUMNS}, CAST(timestamp AS DATE) AS event_date FROM records"
    q = {
        "aqi_reading": f"""WITH {SCORED} SELECT event_id, city, pm25, aqi_raw AS aqi, {_tier("aqi_raw", 1)} AS category,
 {_tier("aqi_raw", 2)} AS css_class, {_tier("aqi_raw", 3)} AS health_advisory, {_tier("aqi_raw", 2)} AS severity FROM raw""",
        "window_report_5m": f"WITH {_windows(300)} SELECT {report} FROM report",
        "window_report_6h": f"WITH {_windows(21600)} SELECT {report} FROM report",
        "window_latest": f"WITH {_windows(300)} SELECT * FROM full_report",
        "window_latest_6h": f"WITH {_windows(21600)} SELECT * FROM full_report",
        "sql_functions": f"""WITH {SCORED} SELECT event_id, aqi_raw AS aqi, {_tier("aqi_raw", 1)} AS category, {_tier("aqi_raw", 2)} AS severity FROM raw""",
        "breakpoint_range_join": f"WITH {SCORED} SELECT event_id, aqi_raw AS aqi FROM raw",
        "latest_per_city": f"""WITH {SCORED} SELECT s.city, s.event_time, s.event_id, s.aqi, pm25, pm10, no2, o3, co, so2, traffic, source, is_real
 FROM scored s JOIN (SELECT city, max(event_time) AS m FROM scored GROUP BY city) l ON s.city = l.city AND s.event_time = l.m""",
        "newest_time": f"WITH {READINGS} SELECT city, max(event_time) AS max_ts FROM readings GROUP BY city",
        "history_table": history_rows,
        "city_history": f"""WITH {RECORDS} SELECT {_HISTORY_COLUMNS} FROM records
 WHERE city = 'NATION_3' AND timestamp >= TIMESTAMP '2024-01-20' - INTERVAL '72 hours' ORDER BY timestamp""",
        "history_rejects": f"""WITH {READINGS} SELECT city, is_real AS stored, source, count(*) AS n, sum(CASE WHEN is_real THEN 1 ELSE 0 END)::BIGINT AS real_rows
 FROM readings GROUP BY ALL""",
        "reading_count": f"WITH {READINGS} SELECT count(*) AS total_readings FROM readings",
        "current_snapshot": f"WITH {RECORDS} SELECT * EXCLUDE (event_id) FROM latest WHERE city IN (SELECT city FROM active)",
        "ranked_overview": f"""WITH {RECORDS} SELECT city, CASE priority WHEN 'critical' THEN '🔴' WHEN 'high' THEN '🟠' WHEN 'medium' THEN '🟡' WHEN 'low' THEN '🟢' ELSE '⚪' END AS badge,
 score, {_number("aqi")} AS aqi, {_display("category")} AS category, {_number("pm25")} AS pm25, {_number("pm10")} AS pm10, css_class
 FROM latest WHERE city IN (SELECT city FROM active) ORDER BY score DESC, city""",
        "city_view": f"""WITH {RECORDS} SELECT city, {_number("aqi")} AS aqi, {_display("category")} AS category, trend, summary AS insight,
 {_number("next_hour_aqi")} AS prediction, prediction_note, traffic,
 CASE WHEN severity IN ('unhealthy', 'very-unhealthy', 'hazardous') THEN title ELSE 'No active alerts' END AS alert, advice AS health FROM latest""",
        "worst_city": f"""WITH {SCORED}, newest AS (SELECT * FROM scored QUALIFY rank() OVER (PARTITION BY city ORDER BY event_time DESC) = 1)
 SELECT city, aqi FROM newest ORDER BY aqi DESC, city LIMIT 1""",
        "stale_cities": f"""WITH {READINGS} SELECT city, event_id FROM readings WHERE city NOT IN (SELECT city FROM active)
 QUALIFY rank() OVER (PARTITION BY city ORDER BY event_time DESC) = 1""",
        "catalog_active": f"WITH {READINGS} SELECT city, region, city IN (SELECT city FROM active) AS active FROM cities ORDER BY region, city",
        "place_lookup": f"WITH {READINGS} SELECT city, city_key, region FROM active JOIN cities USING (city) WHERE region <> 'ASIA'",
        "regions": f"""WITH {READINGS} SELECT CASE WHEN region = 'ASIA' THEN 'Global' ELSE region END AS region, string_agg(city, ',' ORDER BY city) AS cities
 FROM cities GROUP BY 1""",
        "city_search": f"WITH {READINGS} SELECT city, region FROM cities WHERE lower(city) LIKE '%nation\\_1%' ESCAPE '\\'",
        "active_update": f"WITH {READINGS} SELECT city AS name FROM cities WHERE region = 'EUROPE'",
        "capped_selection": f"""WITH {READINGS}, listed AS (SELECT city, city_key AS pos, city_key IN (3, 11, 20) AS chosen FROM cities
 WHERE city_key IN (3, 11, 20) OR contains(city, 'NATION_1')) SELECT city, pos, chosen FROM listed ORDER BY chosen DESC, pos, city LIMIT 8""",
        "custom_place": """SELECT c_custkey, concat_ws(', ', CASE WHEN c_custkey % 3 <> 0 THEN c_name
   ELSE printf('Unknown (%.2f,%.2f)', (c_custkey % 90)::DOUBLE + 0.25, (c_custkey % 180)::DOUBLE - 0.75) END,
   CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment WHEN c_custkey % 5 <> 0 THEN c_nationkey::VARCHAR END) AS place FROM customer""",
        "custom_catalog": f"""WITH {READINGS}, added AS (SELECT 'NATION_' || (user_id % 40) AS name, value AS lat, event_id::DOUBLE AS lon, 'Custom' AS region
   FROM events WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts DESC) = 1)
 SELECT name, lat, lon, region FROM added UNION ALL
 SELECT city, city_key::DOUBLE, 0::DOUBLE, region FROM cities WHERE city NOT IN (SELECT name FROM added)""",
        "trend": f"WITH {HISTORY} SELECT event_id, city, aqi, trend FROM trended",
        "history20": f"WITH {HISTORY} SELECT event_id, city, hn::INT AS history_len, {_shown('history')} AS history_aqi FROM trended",
        "rolling_stats30": f"WITH {HISTORY} SELECT event_id, city, {_STATS30} FROM trended",
        "history_labels": f"""WITH {HISTORY}, cut AS (SELECT event_id, history[greatest(hn - 19, 1):] AS h FROM trended),
 points AS (SELECT event_id, len(h) AS n, h, unnest(range(len(h)))::INT AS pos FROM cut)
 SELECT event_id, pos, CASE WHEN pos = n - 1 THEN 'Now' ELSE '-' || (n - 1 - pos) END AS label, h[pos + 1] AS aqi FROM points""",
        "recent_movement": f"WITH {HISTORY} SELECT event_id, round(range6, 1) AS range6, round(jump5, 1) AS jump5 FROM trended",
        "insight": f"WITH {HISTORY} SELECT event_id, {_INSIGHT} AS insight FROM trended",
        "alert": f"WITH {HISTORY} SELECT event_id, {_ALERT} AS alert FROM trended",
        "message": f"{predicted} SELECT event_id, {_message('prediction')} FROM predicted",
        "priority": f"""{predicted}, ranked AS (SELECT event_id, {_points("prediction")} AS points FROM predicted)
 SELECT event_id, {_level("points")} AS priority, round_even(points, 0)::INT AS score,
 CASE {_level("points")} WHEN 'critical' THEN '🔴' WHEN 'high' THEN '🟠' WHEN 'medium' THEN '🟡' ELSE '🟢' END AS badge FROM ranked""",
        "title_join": f"WITH {HISTORY} SELECT event_id, severity, trend, {_TITLE} AS title FROM trended",
        "shown_alert": f"""WITH {HISTORY} SELECT event_id, CASE WHEN severity IN ('unhealthy', 'very-unhealthy', 'hazardous')
 THEN CASE WHEN is_real THEN {_TITLE} ELSE coalesce({_ALERT}, 'Alert active') END ELSE 'No active alerts' END AS alert_line FROM trended""",
        "prediction_outlook": f"""WITH {SCORED}, pushed AS (SELECT event_id, round(least(greatest(aqi * 3 - 100, 0), 500), 1) AS prediction FROM scored)
 SELECT event_id, prediction, {_tier("prediction", 1)} AS label, {_tier("prediction", 2)} AS css, {_tier("(prediction * 3)", 1, "Unknown")} AS strict_label FROM pushed""",
        "json_roundtrip": f"WITH {READINGS} SELECT * EXCLUDE (event_id, region) FROM readings",
        "provider_payload": f"""WITH {READINGS} SELECT event_id, city, event_time, pm25, pm10, no2, o3, round(co * 1000 / 1000, 3) AS co,
 CASE WHEN is_real THEN so2 ELSE 0 END AS so2, traffic, 'OpenWeatherMap' AS source, TRUE AS is_real FROM readings""",
        "traffic_level": f"WITH {READINGS} SELECT hour(event_time)::INT AS hour, traffic, count(*) AS n FROM readings GROUP BY ALL",
        "field_defaults": f"""WITH {READINGS} SELECT event_id, CASE WHEN no2 > 10 THEN pm10 ELSE 0 END AS pm10,
 CASE WHEN traffic = 'Low' THEN 'Medium' ELSE traffic END AS traffic, CASE WHEN source = 'view' THEN 'Unknown' ELSE source END AS source,
 CASE WHEN source = 'click' THEN TRUE ELSE is_real END AS is_real, CASE WHEN no2 = 0 THEN o3 ELSE no2 END AS no2_or_o3,
 CASE WHEN source = 'view' THEN '—' ELSE source || ' feed' END AS source_text,
 CASE WHEN source = 'click' OR NOT is_real THEN 0 ELSE 1 END AS real_flag, source = 'click' OR is_real AS counts_as_real FROM readings""",
        "reading_enrichment": f"WITH {RECORDS} SELECT * FROM records",
        "window_enrichment": _window_records(300),
        "window_enrichment_6h": _window_records(21600),
        "features25": _features("TRUE", 3),
        "real_features": _features("is_real", 12),
        "single_features": f"WITH {READINGS} SELECT event_id, {_single_feature_columns()} FROM readings",
        "training_labels": f"""WITH {READINGS}, sloped AS (SELECT *, row_number() OVER o AS rn, greatest(0, pm25 + (pm25 - lag(pm25, 5) OVER o) / 5 * 12) AS ahead
 FROM readings WINDOW o AS (PARTITION BY city ORDER BY event_time, event_id)), features AS ({_features("TRUE", 3)})
 SELECT features.* EXCLUDE (event_time), round({_index("ahead")}, 6) AS label FROM sloped JOIN features USING (event_id) WHERE rn >= 24""",
        "observed_labels": f"""WITH {SCORED}, led AS (SELECT event_id, city, row_number() OVER o AS rn, lead(aqi_raw, 12) OVER o AS later
 FROM raw WINDOW o AS (PARTITION BY city ORDER BY event_time, event_id)), features AS ({_features("TRUE", 3)})
 SELECT features.* EXCLUDE (event_time), round(later, 6) AS label FROM led JOIN features USING (event_id) WHERE rn >= 24 AND later IS NOT NULL""",
        "warmup_gate": f"""WITH {READINGS} SELECT event_id, city, sum(CASE WHEN is_real THEN 1 ELSE 0 END) OVER (PARTITION BY city ORDER BY event_time, event_id
 ROWS UNBOUNDED PRECEDING) >= 12 AS ready FROM readings""",
        "gap_fill": f"""WITH {READINGS}, paired AS (SELECT *, lead(event_time) OVER (PARTITION BY city ORDER BY event_time, event_id) AS until FROM readings WHERE is_real),
 points AS (SELECT *, unnest(range(epoch_us(event_time) // 10000000 + 1, (epoch_us(until) - 1) // 10000000 + 1)) AS p FROM paired WHERE until IS NOT NULL),
 placed AS (SELECT * REPLACE (make_timestamp(p * 10000000) AS event_time) FROM points)
 SELECT city, CAST(event_time AS DATE) AS day, {_traffic("hour(event_time)")} AS traffic, count(*) AS points, min(event_time) AS first_time, max(event_time) AS last_time,
 {", ".join(f"CAST(sum(CAST(round({m} * 1000) AS BIGINT)) AS BIGINT) AS {m}_sum" for m in ("pm25", "pm10", "no2", "o3", "co", "so2"))} FROM placed GROUP BY ALL""",
    }
    # Loads as the registered streams make them: five spans of equal length.
    loads = """spans5 AS (SELECT min(epoch_us(ts) // 1000000) AS first, (max(epoch_us(ts) // 1000000) - min(epoch_us(ts) // 1000000)) // 5 + 1 AS step FROM events),
 loads AS (SELECT event_id, (epoch_us(ts) // 1000000 - first) // step AS load FROM events, spans5)"""
    q["overlapping_ranges"] = f"""WITH {READINGS},
 scale AS (SELECT DISTINCT pm25 - no2 / 50::DOUBLE AS lo, pm25 + no2 / 70::DOUBLE AS hi, no2 AS a, no2 + 50::DOUBLE AS b FROM readings WHERE event_id % 2 = 0 AND no2 > 0),
 hits AS (SELECT event_id, min(row(lo, hi, a, b)) AS h FROM readings JOIN scale ON pm10 / 1.5::DOUBLE >= lo AND pm10 / 1.5::DOUBLE <= hi GROUP BY event_id)
 SELECT event_id, city, coalesce(h[3] + (pm10 / 1.5::DOUBLE - h[1]) / (h[2] - h[1]) * (h[4] - h[3]), 500::DOUBLE) AS aqi FROM readings LEFT JOIN hits USING (event_id)"""
    q["latest_from_history"] = f"""WITH {RECORDS}, heard AS (SELECT * FROM records WHERE NOT (city = 'NATION_7' AND timestamp >= TIMESTAMP '2024-01-06'))
 SELECT {_HISTORY_COLUMNS}, CAST(timestamp AS DATE) AS event_date FROM heard QUALIFY rank() OVER (PARTITION BY city ORDER BY timestamp DESC) = 1"""
    q["stream_keyed_enrichment"] = q["reading_enrichment"]
    q["stream_warm_start"] = f"WITH {RECORDS}, {loads} SELECT records.* FROM records JOIN loads USING (event_id) WHERE load >= 2"
    q["stream_live_set"] = f"""WITH {READINGS}, {loads} SELECT load, event_id, city FROM readings JOIN loads USING (event_id)
 JOIN cities USING (city) WHERE city_key % 5 = load"""
    q["stream_late_rows"] = f"""WITH {_windows(300)}, {loads},
 arrived AS (SELECT event_id, least(load + CASE WHEN event_id % 7 = 3 THEN event_id % 3 + 1 ELSE 0 END, 4) AS load FROM loads),
 timed AS (SELECT * FROM spans JOIN arrived USING (event_id)),
 marks AS (SELECT n AS load, (SELECT max(event_time) FROM timed WHERE load < n) - INTERVAL '600 seconds' AS mark FROM range(5) r(n)),
 judged AS (SELECT *, coalesce(window_start + INTERVAL '300 seconds' <= mark, FALSE) AS late FROM timed JOIN marks USING (load))
 SELECT window_start, city, nullif(count(*) FILTER (NOT late), 0) AS reading_count, max(aqi_raw) FILTER (NOT late) AS max_aqi,
 min(aqi_raw) FILTER (NOT late) AS min_aqi, nullif(count(*) FILTER (late), 0) AS late_rows,
 max(epoch_us(mark) // 1000000 - epoch_us(event_time) // 1000000) FILTER (late) AS most_behind FROM judged GROUP BY window_start, city"""
    real = "(SELECT *, sum(is_real::INT) OVER (PARTITION BY city ORDER BY event_time, event_id) AS nth FROM readings)"
    q["forecast_expression"] = f"""WITH {READINGS}, s AS (SELECT city, count(*) AS single_rows FROM readings GROUP BY city),
 h AS (SELECT city, count(*) AS history_rows FROM {real} WHERE is_real AND nth >= 12 GROUP BY city)
 SELECT city, single_rows, single_rows AS single_rows_alike, history_rows, history_rows AS history_rows_alike FROM s LEFT JOIN h USING (city)"""
    q["forecast_error"] = f"""WITH {READINGS}, n AS (SELECT row_number() OVER (PARTITION BY city ORDER BY event_time, event_id) AS nth FROM readings)
 SELECT count(*)::INT AS rows, count(*)::INT AS split_rows, TRUE AS share_is_near, TRUE AS error_is_equal, TRUE AS model_is_kept FROM n WHERE nth >= 24"""
    q["stream_forecast"] = f"WITH {READINGS} SELECT city, count(*) AS rows, count(*) AS rows_alike FROM readings GROUP BY city"
    q["history_merged"] = f"""WITH {RECORDS}, dated AS (SELECT *, CAST(timestamp AS DATE) AS event_date FROM records),
 days AS (SELECT event_date, count(*) AS seen_by_reader, (count(DISTINCT event_id % 12) > 0)::BIGINT AS loads FROM dated GROUP BY event_date)
 SELECT event_date, city, count(*) AS rows, max(timestamp) AS newest, max(aqi) AS max_aqi, any_value(loads) AS loads,
 any_value(seen_by_reader) AS seen_by_reader FROM dated JOIN days USING (event_date) GROUP BY event_date, city"""
    q["stream_window_report"] = q["window_latest"]
    q["stream_enrichment"] = q["reading_enrichment"]
    scored = "(SELECT *, round(least(greatest(aqi * 3 - 100, 0), 500), 1) AS prediction FROM trended)"
    q["stream_scored"] = f"WITH {HISTORY} {_reading_records(scored, 'prediction')}"
    q["stream_window_enrichment"] = _window_records(300, closed=True)
    q["stream_keyed_latest"] = f"WITH {RECORDS} SELECT * EXCLUDE (event_id) FROM latest"
    q["stream_latest_state"] = f"WITH {RECORDS} SELECT * EXCLUDE (event_id) FROM latest"
    q["stream_history"] = history_rows
    return q
