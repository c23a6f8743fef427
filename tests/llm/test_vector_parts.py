"""Nearest vectors where parts are many, cut twice, or hold equal rows; searched parts follow a measured recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.llm import vector_index


def vectors(spark, x, ids=None):
    rows = list(zip(range(len(x)) if ids is None else ids.tolist(), x.tolist()))
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)


def recall(found, x, ids, every):
    """Share of distances as small as those of an exhaustive search, which ties between equal rows leave alone."""
    hit = total = 0
    mine = {}
    for row in found:
        mine.setdefault(row.query_id, []).append(row)
    for q in sorted({i for i in ids.tolist() if i % every == 0}):
        d = np.sqrt(((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(1))
        best = np.sort(d[ids != q])[:10]
        assert [r.rank for r in mine[q]] == list(range(1, len(best) + 1))
        hit += sum(r.score <= best[-1] + 1e-9 for r in mine[q])
        total += len(best)
    return hit / total


@pytest.fixture
def loose():
    """Directions with little structure, the hard case for parts."""
    x = np.random.default_rng(5).normal(size=(3_000, 24))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_parts_cut_twice(spark, loose, monkeypatch):
    seen = []
    refined = vector_index._refined
    monkeypatch.setattr(vector_index, "_refined", lambda *a: seen.append(refined(*a)) or seen[-1])
    monkeypatch.setattr(vector_index, "SHARD_ROWS", 300)
    found = vector_index.nearest(vectors(spark, loose), F.col("vec_id") % 30 == 0, parts=16, sample_rows=100).collect()
    assert seen[0].weights.shape[1] == 4 and [r.weights.shape[1] for r in seen[0].below.values()] == [4] * 4
    assert recall(found, loose, np.arange(len(loose)), 30) >= 0.85


def test_more_probes_find_more_and_all_parts_find_all(spark, loose):
    table, ids = vectors(spark, loose), np.arange(len(loose))
    few, all_parts = (
        recall(vector_index.nearest(table, F.col("vec_id") % 30 == 0, parts=8, probes=p).collect(), loose, ids, 30) for p in (2, 8)
    )
    assert few < all_parts == 1.0


def test_searched_parts_follow_the_structure(spark):
    """Well parted groups need few parts, and the same plan finds that out."""
    rng = np.random.default_rng(2)
    x = 10 * rng.normal(size=(16, 24))[rng.integers(0, 16, 3_000)] + rng.normal(size=(3_000, 24))
    asked = []
    enough = vector_index._enough
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(vector_index, "_enough", lambda *a: asked.append(enough(*a)) or asked[-1])
        found = vector_index.nearest(vectors(spark, x), F.col("vec_id") % 30 == 0, parts=16).collect()
    assert asked[0] <= 4
    assert recall(found, x, np.arange(len(x)), 30) >= 0.9


def test_equal_rows_spread_over_tiles(spark, loose, monkeypatch):
    """A third of all rows are one row; they fill many tiles of a shard, and all others are still found."""
    monkeypatch.setattr(vector_index, "SHARD_ROWS", 100)
    x = np.vstack([loose[:1_000], np.repeat(loose[:1], 500, axis=0)])
    ids = np.r_[np.arange(1_000), np.zeros(500, np.int64)]
    found = vector_index.nearest(vectors(spark, x, ids), F.col("vec_id") % 30 == 0, parts=4, probes=4).collect()
    assert recall(found, x, ids, 30) == 1.0
    assert all(r.vec_id != r.query_id for r in found)
    assert len(found) == 10 * len({i for i in ids.tolist() if i % 30 == 0})


def test_all_vectors_equal(spark):
    x = np.ones((600, 4))
    found = vector_index.nearest(vectors(spark, x), F.col("vec_id") == 7).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(i, 0.0) for i in (0, 1, 2, 3, 4, 5, 6, 8, 9, 10)]


def test_large_parts_have_tiles_and_small_ones_share_a_shard():
    assert vector_index._shards([30, 30, 50, 250, 40], 100) == [(0, 1), (0, 1), (1, 1), (2, 3), (3, 1)]
