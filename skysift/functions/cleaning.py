"""Scalar helpers for readings: defaults, units, flags, time, display text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.constants import MISSING

POLLUTANTS = ["pm25", "pm10", "no2", "o3", "co", "so2"]


def with_city(df: DataFrame) -> DataFrame:
    """Drop records that name no city."""
    return df.filter(F.length("city") > 0)


def with_defaults(df: DataFrame) -> DataFrame:
    """Fill missing measures and labels."""
    fills = {name: F.coalesce(F.col(name), F.lit(0.0)) for name in POLLUTANTS}
    fills["traffic"] = F.coalesce("traffic", F.lit("Medium"))
    fills["source"] = F.coalesce("source", F.lit("Unknown"))
    fills["is_real"] = F.coalesce("is_real", F.lit(True))
    return df.withColumns(fills)


def parsed_time(text: Column) -> Column:
    """ISO text → timestamp; malformed text gives null."""
    return F.try_to_timestamp(text)


def window_start(time: Column, seconds: int) -> Column:
    """Start of the tumbling window of an event time, null for null."""
    micros, span = F.unix_micros(time), F.lit(seconds * 1_000_000)
    return F.timestamp_micros(micros - F.pmod(micros, span))


def traffic_level(hour: Column) -> Column:
    return (
        F.when(hour.between(7, 10) | hour.between(17, 20), F.lit("High"))
        .when(hour.between(2, 5), F.lit("Low"))
        .otherwise(F.lit("Medium"))
    )


def milligrams(micrograms: Column) -> Column:
    return F.round(micrograms / F.lit(1000.0), 3)


def or_else(value: Column, *others: Column) -> Column:
    """First number that is neither null nor zero; the last one stands as it is."""
    chain = [value, *others]
    return F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in chain[:-1]], chain[-1])


def text_or(value: Column, *others: Column) -> Column:
    """First text that is neither null nor empty; the last one stands as it is."""
    chain = [value, *others]
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in chain[:-1]], chain[-1])


def flag(value: Column) -> Column:
    return F.coalesce(value.cast("int"), F.lit(0))


def is_real(value: Column) -> Column:
    """Real-reading predicate; an unmarked reading counts as real."""
    return F.coalesce(value, F.lit(True))


def hour_sin(time: Column) -> Column:
    return F.coalesce(F.sin(F.hour(time) * F.lit(2 * math.pi / 24)), F.lit(0.0))


def hour_cos(time: Column) -> Column:
    return F.coalesce(F.cos(F.hour(time) * F.lit(2 * math.pi / 24)), F.lit(1.0))


def display(value: Column, suffix: str = "") -> Column:
    text = F.nullif(value.cast("string"), F.lit(""))
    return F.coalesce(F.concat(text, F.lit(suffix)), F.lit(MISSING))


def display_number(value: Column, suffix: str = "") -> Column:
    """A number as the page prints it: its shortest exact digits, whole ones without a fraction.

    Exponents appear from 1e21 on and below 1e-6 only, as ``1.5e+21`` and ``5e-7``.
    """
    digits, size = value.cast("string"), F.abs(value)
    # Decimals wide enough for 17 digits of any such number.
    plain = F.when(size >= 1, digits.try_cast("decimal(38,16)").cast("string")).otherwise(
        digits.try_cast("decimal(38,23)").cast("string")
    )
    short = F.regexp_replace(plain, r"\.?0+$", "")
    parts = F.regexp_extract(digits, r"^(.*?)(?:\.0)?E", 1)
    power = F.regexp_extract(digits, r"E(-?[0-9]+)$", 1)
    sign = F.when(power.startswith("-"), F.lit("e")).otherwise(F.lit("e+"))
    text = (
        F.when(size == 0, F.lit("0"))
        .when((size >= 1e-6) & (size < 1e21), short)
        .when(digits.contains("E"), F.concat(parts, sign, power))
        .otherwise(digits)
    )
    return display(text, suffix)


def place_name(name: Column, state: Column, country: Column, lat: Column, lon: Column) -> Column:
    """Display name of a custom place: its name, then state or else country."""
    fallback = F.format_string("Unknown (%.2f,%.2f)", lat, lon)
    suffix = F.coalesce(F.nullif(state, F.lit("")), F.nullif(country, F.lit("")))
    return F.concat_ws(", ", F.coalesce(name, fallback), suffix)


def name_contains(name: Column, text: str) -> Column:
    return F.lower(name).contains(text.lower())
