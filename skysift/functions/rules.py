"""Rules over a reading and its recent history: trend, insight, alert, message, priority.

``history`` is always an array column of index values, oldest first, newest last.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skysift import constants as K


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def _newest(history: Column, n: int) -> Column:
    """The last ``n`` elements, or all of a shorter array."""
    return F.slice(history, F.greatest(F.size(history) - F.lit(n - 1), F.lit(1)), F.lit(n))


def exposed(history: Column, n: int = K.HISTORY_SHOWN) -> Column:
    return _newest(history, n)


def _back(history: Column, n: int) -> Column:
    """The ``n``-th newest element; null where the array is shorter."""
    return F.get(history, F.size(history) - F.lit(n))


def trend(history: Column) -> Column:
    """Compare the means of the first and last three of the newest six values."""
    start = F.greatest(F.size(history) - F.lit(6), F.lit(0))
    a, b, c = (F.get(history, start + F.lit(i)) for i in range(3))
    x, y, z = (_back(history, n) for n in (3, 2, 1))
    change = (x + y + z) / F.lit(3.0) - (a + b + c) / F.lit(3.0)
    return (
        F.when(F.size(history) < 3, F.lit(K.FLAT))
        .when(change > 5.0, F.lit(K.UP))
        .when(change < -5.0, F.lit(K.DOWN))
        .otherwise(F.lit(K.FLAT))
    )


def recent_range(history: Column) -> Column:
    """Largest minus smallest of the newest six values."""
    recent = [_back(history, n) for n in range(1, 7)]
    return F.greatest(*recent) - F.least(*recent)


def jump(history: Column) -> Column:
    """Newest value minus the oldest of the newest five."""
    return _back(history, 1) - F.get(history, F.greatest(F.size(history) - F.lit(5), F.lit(0)))


def insight(history: Column, aqi: Column, arrow: Column) -> Column:
    text = {name: F.lit(sentence) for name, sentence in K.INSIGHT.items()}
    rising, falling, flat = (arrow == F.lit(a) for a in (K.UP, K.DOWN, K.FLAT))
    return (
        F.when(F.size(history) < 3, text["baseline"])
        .when(aqi > 200, text["critical"])
        .when(recent_range(history) > 30, text["variable"])
        .when(rising & (aqi > 100), text["rising_high"])
        .when(falling & (aqi > 100), text["falling_high"])
        .when(flat & (aqi <= 50), text["flat_good"])
        .when(flat, text["flat"])
        .when(rising, text["rising"])
        .otherwise(text["falling"])
    )


def alert(history: Column, aqi: Column) -> Column:
    """Alert sentence, or null where there is nothing to tell."""
    rule = F.when(F.size(history) < 2, F.lit(None).cast("string"))
    rule = rule.when(jump(history) > 25, F.lit(K.ALERT_SPIKE))
    for limit, sentence in K.ALERT_LEVELS:
        rule = rule.when(aqi > limit, F.lit(sentence))
    return rule


def outlook(aqi: Column, prediction: Column) -> Column:
    delta = prediction - aqi
    return (
        F.when(delta > 15, F.lit(K.OUTLOOK["much_worse"]))
        .when(delta > 5, F.lit(K.OUTLOOK["worse"]))
        .when(delta < -15, F.lit(K.OUTLOOK["much_better"]))
        .when(delta < -5, F.lit(K.OUTLOOK["better"]))
        .otherwise(F.lit(K.OUTLOOK["same"]))
    )


def summary(level: Column, arrow: Column, traffic: Column) -> Column:
    word = F.coalesce(_lookup(arrow, K.TREND_WORDS), F.lit(K.TREND_WORDS[K.FLAT]))
    heavy = F.when(F.lower(traffic) == "high", F.lit(K.TRAFFIC_SENTENCE)).otherwise(F.lit(""))
    return F.concat(
        F.initcap(F.translate(level, "-", " ")), F.lit(" air quality with "), word, F.lit(" trend."), heavy
    )


def plain_title(level: Column, arrow: Column) -> Column:
    """Title used where no template fits."""
    verb = F.coalesce(_lookup(arrow, K.TREND_VERBS), F.lit(K.TREND_VERBS[K.FLAT]))
    return F.concat(F.lit("Air quality is "), F.translate(level, "-", " "), F.lit(" and "), verb)


def title(level: Column, arrow: Column) -> Column:
    templates = {f"{sev} {mark}": text for sev, mark, text in K.TITLES}
    return F.coalesce(_lookup(F.concat_ws(" ", level, arrow), templates), plain_title(level, arrow))


def advice(level: Column) -> Column:
    return F.coalesce(_lookup(level, K.ADVICE), F.lit(K.ADVICE_DEFAULT))


def confidence(history_len: Column) -> Column:
    return (
        F.when(history_len >= 15, F.lit("high"))
        .when(history_len >= 5, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def message(
    level: Column, aqi: Column, arrow: Column, prediction: Column, traffic: Column, history_len: Column
) -> Column:
    """Structured message; ``level`` is the severity of ``aqi``, best kept as a column of its own."""
    return F.struct(
        level.alias("severity"),
        title(level, arrow).alias("title"),
        summary(level, arrow, traffic).alias("summary"),
        outlook(aqi, prediction).alias("prediction_note"),
        advice(level).alias("advice"),
        confidence(history_len).alias("confidence"),
    )


def priority_points(aqi: Column, arrow: Column, prediction: Column) -> Column:
    """Unrounded urgency: half the index, a bonus while rising, a share of the expected rise."""
    rising = F.when(arrow == K.UP, F.lit(20.0)).otherwise(F.lit(0.0))
    growth = F.when(prediction > aqi, (prediction - aqi) * F.lit(0.3)).otherwise(F.lit(0.0))
    return aqi * F.lit(0.5) + rising + growth


def priority(aqi: Column, arrow: Column, prediction: Column) -> Column:
    points = priority_points(aqi, arrow, prediction)
    level = (
        F.when(points >= 150, F.lit("critical"))
        .when(points >= 100, F.lit("high"))
        .when(points >= 40, F.lit("medium"))
        .otherwise(F.lit("low"))
    )
    return F.struct(level.alias("priority"), F.bround(points, 0).cast("int").alias("score"))


def badge(level: Column) -> Column:
    return F.coalesce(_lookup(level, K.PRIORITY_BADGES), F.lit(K.BADGE_DEFAULT))


def shown_alert(level: Column, heading: Column, sentence: Column) -> Column:
    """Alert line of the place view: only the upper severities show one."""
    text = F.coalesce(F.nullif(heading, F.lit("")), F.nullif(sentence, F.lit("")), F.lit(K.ALERT_FALLBACK))
    return F.when(F.coalesce(level, F.lit("good")).isin(K.ALERTING), text).otherwise(F.lit(K.NO_ALERT))
