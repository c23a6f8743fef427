"""Air-quality index columns: score, tier, label, prediction clamp, rounding."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from skysift.constants import AQI_CEILING, BREAKPOINTS, CATEGORIES


def index_from_pm25(pm25: Column) -> Column:
    """PM2.5 concentration → index; a missing value scores 0, one off the scale 500."""
    score = F.when(pm25.isNull(), F.lit(0.0))
    for lo, hi, base, top in BREAKPOINTS:
        score = score.when(
            (pm25 >= F.lit(lo)) & (pm25 <= F.lit(hi)),
            F.lit(float(base)) + (pm25 - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(top - base)),
        )
    return score.otherwise(F.lit(AQI_CEILING))


def _tier(aqi: Column, field: int, missing: str, beyond: str | None = None) -> Column:
    """Pick one field of the first tier whose limit holds the value.

    Counting the limits below the value and indexing a constant array keeps the
    generated code far smaller than a chain of conditions would.
    """
    passed = reduce(add, [(aqi > F.lit(float(tier[0]))).cast("int") for tier in CATEGORIES])
    texts = [tier[field] for tier in CATEGORIES]
    texts.append(texts[-1] if beyond is None else beyond)
    return F.coalesce(F.get(F.array(*[F.lit(t) for t in texts]), passed), F.lit(missing))


def category(aqi: Column) -> Column:
    return _tier(aqi, 1, "Unknown")


def css_class(aqi: Column) -> Column:
    return _tier(aqi, 2, "good")


def health_advisory(aqi: Column) -> Column:
    return _tier(aqi, 3, "")


def severity(aqi: Column) -> Column:
    return _tier(aqi, 2, CATEGORIES[-1][2])


def outlook_label(prediction: Column, strict: bool = False) -> Column:
    """Label of a prediction; ``strict`` names values beyond all tiers ``Unknown``."""
    return _tier(prediction, 1, "Unknown", "Unknown" if strict else None)


def outlook_css(prediction: Column, strict: bool = False) -> Column:
    return _tier(prediction, 2, "good", "good" if strict else None)


def clamp_prediction(prediction: Column) -> Column:
    """Bring a model output into 0..500 with one decimal."""
    return F.round(F.least(F.greatest(prediction, F.lit(0.0)), F.lit(AQI_CEILING)), 1)


SCALE = 10_000


def scaled(value: Column) -> Column:
    """A measure in whole ten-thousandths; NaN becomes null.

    Whole numbers add up exactly in any order, and cheaply. Readings carry at most
    three decimals, so nothing is lost.
    """
    return F.rint(value * F.lit(float(SCALE))).try_cast("bigint")


MICRO = 1_000_000


def rounded_mean(value: Column, digits: int) -> Column:
    """Mean rounded half-up; NaN and huge or tiny values count as in a plain mean.

    Readings carry few decimals, so means fall on exact ties often; a floating sum
    would decide them by the order of the rows. Where every value is a whole number of millionths, but for
    the noise of its arithmetic, the sum is exact; one other value, or an overflow, makes it the plain mean.
    """
    scaled_up = value * F.lit(float(MICRO))
    whole = F.rint(scaled_up)
    exact = F.when((F.abs(value) < float(MICRO)) & (F.abs(scaled_up - whole) < 1e-4), whole.cast("bigint"))
    total, parts = F.try_sum(exact), F.count(exact)
    mean = total.cast("decimal(20,0)") / F.nullif((parts * MICRO).cast("decimal(20,0)"), F.lit(0))
    plain = F.round(F.avg(value), digits)
    return F.when((parts == F.count(value)) & total.isNotNull(), F.round(mean, digits).cast("double")).otherwise(plain)
