"""Overlapping ranges: the merge against the small-table form."""

import random

import pytest

from skysift.operators import lookups

SCALE = "lo_pm double, hi_pm double, lo_aqi double, hi_aqi double"


def both(spark, values, scale):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, pm25 double")
    table = spark.createDataFrame(scale, SCALE)
    return [sorted((r.id, str(r.aqi)) for r in f(df, table).collect()) for f in (lookups.index_from_table, lookups.index_from_ranges)]


@pytest.mark.parametrize("parts", [None, 13])
def test_equals_the_small_table(spark, small_segments, parts):
    if parts:
        small_segments(parts)
    rng = random.Random(3)
    scale = []
    for _ in range(200):
        lo = float(rng.randrange(100))
        scale.append((lo, lo + rng.choice([1, 2, 3, 40]), float(rng.randrange(9)), float(rng.randrange(9, 20))))
    scale += scale[:20] + [(None, 5.0, 0.0, 1.0), (5.0, None, 0.0, 1.0), (200.0, 300.0, 1.0, 2.0)]
    values = [rng.choice([float(rng.randrange(320)), rng.uniform(-5, 320)]) for _ in range(800)] + [7.0] * 300 + [None, float("nan")] * 5
    small, merged = both(spark, values, scale)
    assert small == merged


def test_no_ranges_and_no_values(spark):
    small, merged = both(spark, [1.0, None], [])
    assert small == merged
    assert both(spark, [], [(0.0, 1.0, 0.0, 1.0)]) == [[], []]


def test_ranges_kept_end_after_all_before(spark):
    rows = [(0.0, 10.0, 0.0, 0.0), (1.0, 3.0, 0.0, 0.0), (2.0, 12.0, 0.0, 0.0), (2.0, 12.0, 0.0, 0.0), (11.0, 12.0, 0.0, 0.0), (20.0, 21.0, 0.0, 0.0)]
    kept = lookups.first_matches(spark.createDataFrame(rows, SCALE), ["lo_pm", "hi_pm", "lo_aqi", "hi_aqi"], "lo_pm", "hi_pm")
    assert sorted(r.hi_pm for r in kept.collect()) == [10.0, 12.0, 21.0]
