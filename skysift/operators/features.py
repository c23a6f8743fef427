"""Model features and labels per reading, from bounded frames per city."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skysift.constants import FEATURE_ROWS, HORIZON_STEPS
from skysift.functions import scoring
from skysift.functions.cleaning import hour_cos, hour_sin, is_real, with_city, with_defaults
from skysift.operators.ordered import event_order, with_frames
from skysift.session import staged

MEASURES = ["pm25", "pm10", "no2", "o3", "co"]
FEATURES = [
    *[f"{name}_{stat}" for name in MEASURES for stat in ("mean", "std", "last", "step")],
    *["pm25_t0", "pm25_t1", "pm25_t2"],
    *["hour_sin", "hour_cos"],
]
ELIGIBLE_ROW = FEATURE_ROWS + 12
SLOPE_ROWS = 6


def _window_features(frame: DataFrame, window) -> DataFrame:
    recent = window.rowsBetween(1 - FEATURE_ROWS, 0)
    # Numbers and look-backs take one step a row; only means and spreads go through the whole frame.
    added = {"seen": F.least(F.row_number().over(window), F.lit(FEATURE_ROWS))}
    for name in MEASURES:
        value = F.col(name)
        added[f"{name}_mean"] = F.avg(name).over(recent)
        added[f"{name}_std"] = F.stddev_pop(name).over(recent)
        added[f"{name}_last"] = value
        added[f"{name}_first"] = F.coalesce(F.lag(name, FEATURE_ROWS - 1).over(window), F.first(name).over(window))
    for back in (1, 2):
        added[f"pm25_t{back}"] = F.coalesce(F.lag("pm25", back).over(window), F.col("pm25"))
    out = frame.withColumns(added)
    # Successive differences telescope: their mean is (last - first) / (n - 1).
    steps = {
        f"{name}_step": (F.col(name) - F.col(f"{name}_first")) / F.nullif(F.col("seen") - 1, F.lit(0))
        for name in MEASURES
    }
    timed = {"pm25_t0": F.col("pm25"), "hour_sin": hour_sin(F.col("event_time")), "hour_cos": hour_cos(F.col("event_time"))}
    return out.withColumns({**steps, **timed})


def _keep(df: DataFrame) -> list[str]:
    return ["city", *[c for c in event_order(df) if c in ("event_time", "event_id")]]


def window_features(readings: DataFrame, at_least: int = 3) -> DataFrame:
    """25 features over the last 12 readings of a city, from its ``at_least``-th reading on."""
    clean = with_defaults(with_city(readings))
    out = with_frames(clean, FEATURE_ROWS - 1, _window_features).filter(F.col("seen") >= at_least)
    return out.select(*_keep(readings), *FEATURES)


def real_features(readings: DataFrame) -> DataFrame:
    """Features over real readings only, once a city has twelve of them."""
    return window_features(readings.filter(is_real(F.col("is_real"))), at_least=FEATURE_ROWS)


def single_features(df: DataFrame) -> DataFrame:
    """Features of one reading taken alone: no spread, no change, equal lags."""
    fixed = {}
    for name in MEASURES:
        value = F.coalesce(F.col(name), F.lit(0.0))
        fixed.update({f"{name}_mean": value, f"{name}_last": value})
        fixed.update({f"{name}_{stat}": F.lit(0.0) for stat in ("std", "step")})
    fixed.update({f"pm25_t{back}": F.coalesce("pm25", F.lit(0.0)) for back in range(3)})
    fixed.update({"hour_sin": hour_sin(F.col("event_time")), "hour_cos": hour_cos(F.col("event_time"))})
    return df.withColumns(fixed)


def training_set(readings: DataFrame, label: str = "trend", horizon_steps: int = HORIZON_STEPS) -> DataFrame:
    """Features and label of every reading from the 24th of its city on.

    ``trend`` extends the slope of the last six PM2.5 values by ``horizon_steps``
    and scores the result; ``observed`` takes the index really seen that many
    readings later (and has no label for a city's last readings).
    """
    if label not in ("trend", "observed"):
        raise ValueError(f"unknown label: {label}")
    clean = with_defaults(with_city(readings))
    kept = [*_keep(readings), *FEATURES]

    def add(frame: DataFrame, window) -> DataFrame:
        out = _window_features(frame, window).withColumn(
            "_nth", F.least(F.row_number().over(window), F.lit(ELIGIBLE_ROW))
        )
        if label == "observed":
            # Seen from the later reading: the row of ``horizon_steps`` ago gets this index.
            earlier = F.lag(F.struct(*kept, "_nth"), horizon_steps).over(window)
            now = scoring.index_from_pm25(F.col("pm25"))
            return out.select(*[c for c in frame.columns if c.startswith("_")], earlier.alias("_row"), now.alias("label"))
        start = F.lag("pm25", SLOPE_ROWS - 1).over(window)
        slope = (F.col("pm25") - start) / F.lit(float(SLOPE_ROWS - 1))
        ahead = F.greatest(F.lit(0.0), F.col("pm25") + slope * F.lit(float(horizon_steps)))
        return out.withColumn("label", scoring.index_from_pm25(ahead))

    look_back = ELIGIBLE_ROW - 1 + (horizon_steps if label == "observed" else 0)
    out = with_frames(clean, look_back, add)
    if label == "observed":
        out = out.filter(F.col("_row").isNotNull()).select("_row.*", "label")
    return out.filter(F.col("_nth") >= ELIGIBLE_ROW).select(*kept, "label")


def warmed_up(readings: DataFrame, needed: int = FEATURE_ROWS) -> DataFrame:
    """Mark readings whose city has had ``needed`` real readings by then.

    Only each city's ``needed``-th real reading matters; it is found with a row
    limit before the shuffle. That table (one row per city) is staged, so the join
    is planned by its real size.
    """
    order = event_order(readings)
    real = readings.filter(is_real(F.col("is_real"))).select("city", F.struct(*order).alias("_ready"))
    nth = F.row_number().over(Window.partitionBy("city").orderBy("_ready"))
    ready = real.withColumn("_nth", nth).filter(F.col("_nth") <= needed).filter(F.col("_nth") == needed).drop("_nth")
    marked = readings.join(staged(ready, "ready"), "city", "left")
    return marked.withColumn("ready", F.coalesce(F.struct(*order) >= F.col("_ready"), F.lit(False))).drop("_ready")
