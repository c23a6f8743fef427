"""Nearest neighbours by learned partitions.

A bounded sample gives an exact neighbour graph, which is cut into equal parts with few edges between them; a small
classifier learns the parts from the vectors. The parts grow with the root of the rows: where they are more than a
sample can tell apart, each part is cut once more by a graph and a classifier of its own. Every vector is filed in its
most probable part. A query is routed to its most probable parts and compared exactly with all vectors filed there. How
many these are is measured: some vectors kept out of the sample are compared with all rows, and as many parts are
searched as their true neighbours ask for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.session import staged

#: Distinct vectors at most that a graph and its classifier are fitted on, chosen by a hash.
SAMPLE_ROWS = 4_096
#: Sampled vectors that a part has at least, and rows of the table.
PART_SAMPLE, PART_ROWS = 16, 256
#: Vectors beside the sample whose true neighbours say how many parts to search, and the share of these to be found.
TRIAL_ROWS, RECALL = 256, 0.94
#: Parts lie together in shards: as many as these, of a least number of rows and of so many bytes at most.
SHARDS, SHARD_ROWS, SHARD_BYTES = 64, 2_000, 64 << 20
#: Queries that meet one copy of a shard at most.
QUERY_ROWS = 50_000


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and every component finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


# --- fitting, on the bounded sample ----------------------------------------------------


def _graph(x: np.ndarray, k: int) -> np.ndarray:
    """Symmetric matrix of the k-nearest-neighbour graph."""
    square = (x * x).sum(1)
    near = square[:, None] + square - 2 * x @ x.T
    np.fill_diagonal(near, np.inf)
    out = np.zeros((len(x), len(x)), np.float32)
    rows = np.arange(len(x))[:, None]
    out[rows, np.argpartition(near, k - 1, axis=1)[:, :k]] = 1
    return np.maximum(out, out.T)


def _halves(graph: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Equal halves with few edges between them: the second eigenvector's median, then gainful swaps."""
    degree = np.maximum(graph.sum(1), 1)
    v = x @ np.linalg.svd(x - x.mean(0), full_matrices=False)[2][0]
    for _ in range(60):
        v = v - (degree * v).sum() / degree.sum()
        v = 0.5 * v + 0.5 * (graph @ v) / degree
        v = v / max(np.linalg.norm(v), 1e-12)
    side = np.zeros(len(v), bool)
    side[np.argsort(v, kind="stable")[len(v) // 2 :]] = True
    for _ in range(20):
        across = graph @ side.astype(np.float32)
        gain = np.where(side, degree - 2 * across, 2 * across - degree)
        left, right = (np.flatnonzero(s)[np.argsort(-gain[s], kind="stable")] for s in (~side, side))
        n = min(len(left), len(right), max(1, len(v) // 50))
        pairs = gain[left[:n]] + gain[right[:n]] - 2 * graph[left[:n], right[:n]]
        if not (pairs > 0).any():
            break
        side[left[:n][pairs > 0]], side[right[:n][pairs > 0]] = True, False
    return side


def balanced_parts(x: np.ndarray, parts: int, k: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Part of each row, and for each row the shares of its own and its neighbours' parts.

    Sizes differ by one at most for every halving.
    """
    out, shares = np.zeros(len(x), np.int64), np.ones((len(x), 1))
    if parts > 1:
        graph = _graph(x, min(k, len(x) - 1))
        groups = [np.arange(len(x))]
        while len(groups) < parts:
            groups = [g[m] for g in groups for s in [_halves(graph[np.ix_(g, g)], x[g])] for m in (~s, s)]
        for number, group in enumerate(groups):
            out[group] = number
        one = np.eye(parts)[out]
        shares = 0.2 * one + 0.8 * (graph @ one) / np.maximum(graph.sum(1, keepdims=True), 1)
    return out, shares


class Router:
    """Probabilities of parts: a softmax over linear scores, fitted to the parts of each vector and its neighbours.

    ``below`` holds the routers of parts that are cut once more.
    """

    def __init__(self, x: np.ndarray, goal: np.ndarray, steps: int = 150, decay: float = 1e-3):
        self.middle, self.scale = x.mean(0), max(float(x.std()), 1e-12)
        self.below: dict[int, Router] = {}
        z, self.weights = self._inputs(x), np.zeros((x.shape[1] + 1, goal.shape[1]))
        first, second = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for step in range(1, steps + 1):
            slope = z.T @ (np.exp(self._logs(z)) - goal) / len(z) + decay * self.weights
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
            self.weights -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.middle) / self.scale, np.ones(len(x))])

    def _logs(self, z: np.ndarray) -> np.ndarray:
        a = z @ self.weights
        a = a - a.max(1, keepdims=True)
        return a - np.log(np.exp(a).sum(1, keepdims=True))

    def _leaves(self) -> list[int]:
        """First leaf of each part, and the number of leaves."""
        counts = [self.below[p].weights.shape[1] if p in self.below else 1 for p in range(self.weights.shape[1])]
        return [0, *np.cumsum(counts).tolist()]

    def filed(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: its most probable part, and within that the most probable one."""
        parts, starts = self._logs(self._inputs(x)).argmax(1), np.array(self._leaves())
        out = starts[parts]
        for part, router in self.below.items():
            mine = np.flatnonzero(parts == part)
            out[mine] += router.filed(x[mine]) if len(mine) else 0
        return out

    def probable(self, x: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """The given leaves for each row, the most probable first."""
        logs, starts = self._logs(self._inputs(x)), self._leaves()
        out = np.empty((len(x), starts[-1]))
        for part, (start, end) in enumerate(zip(starts, starts[1:])):
            router = self.below.get(part)
            out[:, start:end] = logs[:, part : part + 1] + (router._logs(router._inputs(x)) if router else 0)
        return leaves[np.argsort(-out[:, leaves], axis=1, kind="stable")]


def _halvings(parts: int, sampled: int) -> int:
    """The largest power of two up to ``parts`` that leaves each part ``PART_SAMPLE`` sampled vectors."""
    return 1 << (max(1, min(parts, sampled // PART_SAMPLE)).bit_length() - 1)


def fit(x: np.ndarray, parts: int) -> Router | None:
    """Router of as many parts as the sample can tell apart; None for a single one."""
    parts = _halvings(parts, len(x))
    return Router(x, balanced_parts(x, parts)[1]) if parts > 1 else None


# --- filing and searching --------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _thinned(rows: DataFrame, share: Column) -> DataFrame:
    """Rows whose vector's hash, ``mark``, lies in the first ``share`` of all hashes."""
    marked = rows.withColumn("mark", F.xxhash64("vector"))
    return marked.filter(F.pmod("mark", F.lit(1 << 20)) < F.ceil(F.least(share, F.lit(1.0)) * (1 << 20)))


def _sample(rows: DataFrame, total: int, wanted: int) -> DataFrame:
    """At most ``wanted`` distinct vectors in the order of a hash; rows are thinned out by the hash before they are sorted."""
    thin = _thinned(rows, F.lit(4.0 * wanted / max(total, 1)))
    return thin.groupBy("vector", "mark").agg(F.min("id").alias("id")).orderBy("mark", "id").limit(wanted)


def _with_parts(router: Router | None):
    """Adds ``part``, and ``nth``, a running number in the task that spreads equal rows."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            parts = router.filed(_matrix(batch.column("vector"))) if router and len(batch) else np.zeros(len(batch))
            added = [pa.array(parts, pa.int32()), pa.array(np.arange(done, done + len(batch)), pa.int64())]
            done += len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "part", "nth"])

    return file


def _routed(router: Router | None, filled: np.ndarray, shards: np.ndarray, probes: int):
    """Adds ``visits``: the shards that hold a row's most probable parts, each with these parts."""
    kind = pa.list_(pa.struct([("shard", pa.int32()), ("parts", pa.list_(pa.int32()))]))
    # Scores of a few million parts at a time.
    step = max(1, 4_000_000 // max(1, len(filled)))

    def visits(places: np.ndarray) -> list[dict]:
        places = np.sort(places)
        starts = np.flatnonzero(np.r_[True, shards[places[1:]] != shards[places[:-1]]])
        return [{"shard": int(shards[p[0]]), "parts": filled[p].tolist()} for p in np.split(places, starts[1:])]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), step):
                batch = whole.slice(start, step)
                if router:
                    parts = router.probable(_matrix(batch.column("vector")), filled)[:, :probes]
                    places = np.searchsorted(filled, parts)
                else:
                    places = np.zeros((len(batch), 1), np.int64)
                added = pa.array([visits(p) for p in places], kind)
                yield pa.RecordBatch.from_arrays([*batch.columns, added], [*batch.schema.names, "visits"])

    return route


def _refined(coarse: DataFrame, router: Router, sizes: dict[int, int], cuts: int, rows: int) -> Router:
    """Cut each part into about ``cuts`` by a router of its own, fitted in Spark on a bounded sample of the part's rows."""
    shares = F.create_map(*[F.lit(x) for p, n in sizes.items() for x in (p, 4.0 * rows / n)])
    thin = _thinned(coarse, F.try_element_at(shares, F.col("part"))).groupBy("part", "vector", "mark").agg(F.min("id").alias("id"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("mark", "id"))
    sample = thin.withColumn("nth", nth).filter(F.col("nth") <= rows)

    def learn(group: pa.Table) -> pa.Table:
        found = fit(_matrix(group.sort_by("nth").column("vector").combine_chunks()), cuts)
        flat = [] if found is None else [*found.middle, found.scale, *found.weights.ravel()]
        return pa.table({"part": group.column("part").slice(0, 1), "flat": pa.array([flat], pa.list_(pa.float64()))})

    wide = len(router.middle)
    for row in sample.groupBy("part").applyInArrow(learn, "part int, flat array<double>").collect():  # one row a part
        if row["flat"]:
            below, flat = Router.__new__(Router), np.array(row["flat"])
            below.middle, below.scale, below.below = flat[:wide], flat[wide], {}
            below.weights = flat[wide + 1 :].reshape(wide + 1, -1)
            router.below[row["part"]] = below
    return router


def _trial(ids: np.ndarray, x: np.ndarray, k: int):
    """The ``k`` nearest of each trial vector among the rows of a task, with their parts."""
    schema = pa.schema([("trial", pa.int32()), ("rough", pa.float64()), ("id", pa.int64()), ("part", pa.int32())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.full((len(x), k), np.inf), np.zeros((len(x), k), np.int64), np.zeros((len(x), k), np.int64)]
        for batch in batches:
            if not len(batch):
                continue
            y, names = _matrix(batch.column("vector")), batch.column("id").to_numpy()
            rough = (y * y).sum(1) - 2 * (x @ y.T)
            rough[ids[:, None] == names] = np.inf
            parts = np.broadcast_to(batch.column("part").to_numpy(), rough.shape)
            both = [np.hstack(p) for p in zip(best, (rough, np.broadcast_to(names, rough.shape), parts))]
            near = np.argpartition(both[0], k - 1, axis=1)[:, :k]
            best = [np.take_along_axis(b, near, axis=1) for b in both]
        number, at = np.nonzero(np.isfinite(best[0]))
        columns = [number, *(b[number, at] for b in best)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return search


def _enough(index: DataFrame, router: Router, filled: np.ndarray, trial: list, k: int, recall: float) -> int:
    """The fewest probable parts that hold the share ``recall`` of the true neighbours of the trial vectors."""
    ids, x = np.array([r["id"] for r in trial]), np.array([r["vector"] for r in trial], np.float64)
    found = index.select("id", "vector", "part").mapInArrow(_trial(ids, x, k), "trial int, rough double, id long, part int")
    rank = F.row_number().over(Window.partitionBy("trial").orderBy("rough", "id"))
    true = found.withColumn("rank", rank).filter(F.col("rank") <= k).select("trial", "part").collect()
    # ``order`` lists places in ``filled``; ``rank`` is its inverse.
    order = np.searchsorted(filled, router.probable(x, filled))
    ranks = np.argsort(order, axis=1)
    at = np.sort([ranks[r["trial"], np.searchsorted(filled, r["part"])] for r in true])
    return int(at[min(len(at) - 1, math.ceil(recall * len(at)) - 1)]) + 1 if len(at) else len(filled)


def _shards(sizes: list[int], rows: int) -> list[tuple[int, int]]:
    """Shard and number of tiles of each part: small parts in a row share a shard, a large one is cut into tiles of ``rows``."""
    out, shard, room = [], -1, 0
    for size in sizes:
        if size > room:
            shard, room = shard + 1, rows
        room = max(0, room - size)
        out.append((shard, max(1, -(-size // rows))))
    return out


def _sweep(k: int):
    """Nearest rows per query and shard. A shard's rows come before its queries: rows are kept, queries pass by in batches."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def found(names: np.ndarray, queries: np.ndarray, asked: list, held: tuple) -> pa.RecordBatch:
        parts, ids, x, square = held
        kinds, starts = np.unique(parts, return_index=True)
        ends = [*starts[1:], len(parts)]
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for start in range(0, len(names), 64):
            block = queries[start : start + 64]
            asks = np.array([np.isin(kinds, a) for a in asked[start : start + 64]])
            table = np.full((len(block), len(x)), np.inf)
            for part, (left, right) in enumerate(zip(starts, ends)):
                mine = np.flatnonzero(asks[:, part])
                table[mine, left:right] = square[left:right] - 2 * (block[mine] @ x[left:right].T)
            for name, row, rough in zip(names[start : start + 64], block, table):
                rough[ids == name] = np.inf
                cut = np.partition(rough, k - 1)[k - 1] if len(rough) > k else np.inf
                # The margin is far above what rounding can change.
                near = np.flatnonzero((rough <= cut + 1e-9 * (1 + square.max() + row @ row)) & np.isfinite(rough))
                exact = np.sqrt(((x[near] - row) ** 2).sum(1))
                order = np.lexsort((ids[near], exact))[:k]
                out.append((np.full(len(order), name), ids[near[order]], exact[order]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, ready = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("shard", "tile", "block", "turn")])
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            for start, end in zip(starts, [*starts[1:], len(batch)]):
                key, turn, piece = tuple(keys[start, :3]), keys[start, 3], batch.slice(start, end - start)
                ids, x, parts = piece.column("id").to_numpy(), _matrix(piece.column("vector")), piece.column("parts")
                if key != group:
                    group, held, ready = key, [], None
                if turn == 0:
                    held.append((parts.flatten().to_numpy(), ids, x))
                elif held:
                    if ready is None:
                        columns = [np.concatenate(c) for c in zip(*held)]
                        order = np.argsort(columns[0], kind="stable")
                        columns, held = [c[order] for c in columns], held[:1]
                        ready = (*columns, (columns[2] ** 2).sum(1))
                    yield found(ids, x, parts.to_pylist(), ready)

    return sweep


def nearest(
    vectors: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
    parts: int | None = None, probes: int | None = None, sample_rows: int = SAMPLE_ROWS, recall: float = RECALL,
) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank (from 1), vec_id, score (Euclidean).

    ``queries`` says which rows ask; each is compared with every row of its most probable parts but itself, and
    with further parts until these hold ``k`` others. There are about as many ``parts`` as the root of the rows, of
    ``PART_ROWS`` rows at least, and ``probes`` of them are searched: if not given, as many as hold the share ``recall``
    of the true neighbours of up to ``TRIAL_ROWS`` vectors. Ties go to the smaller id. Vectors that are null, empty,
    zero, or hold null or non-finite components take no part; nor do those of another length than
    the most frequent one, or with a null id. Of rows that share an id each is a neighbour of its own, but none of
    another of them, and one of them asks. A group of equal vectors lies in one part, which is cut into tiles by row if it is large.
    """
    known = vectors.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), queries.alias("asks")
    )
    length = known.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    known = known.filter(F.size("vector") == (length["n"] if length else 0))
    total = length["count"] if length else 0
    wanted = parts or min(math.isqrt(total), total // PART_ROWS)

    sampled = _sample(known, total, sample_rows + TRIAL_ROWS).collect() if wanted > 1 else []
    kept = min(sample_rows, len(sampled) - len(sampled) // 8)
    learnt, trial = np.array([r["vector"] for r in sampled[:kept]], np.float64), sampled[kept:][:TRIAL_ROWS]
    router = fit(learnt, wanted) if len(learnt) else None
    shape = "id long, vector array<double>, asks boolean, part int, nth long"
    filed = lambda: known.mapInArrow(_with_parts(router), shape)
    counted = lambda df, by="part": {r[by]: r["count"] for r in df.groupBy(by).count().collect()}
    cuts = wanted // router.weights.shape[1] if router else 1
    if cuts > 1:
        coarse = filed()
        router = _refined(coarse, router, counted(coarse), cuts, sample_rows)
    index = staged(filed(), "filed")
    sizes = counted(index)
    filled = np.array(sorted(sizes), np.int64)
    if probes is None:
        probes = _enough(index, router, filled, trial, k, recall) if router and trial else max(1, len(filled))
    probes = max(probes, min(range(1, len(sizes) + 1), key=lambda n: (sum(sorted(sizes.values())[:n]) <= k, n), default=1))

    most = SHARD_BYTES // (8 * length["n"]) if length else SHARD_ROWS
    laid = _shards([sizes[p] for p in filled.tolist()], max(1, min(most, max(SHARD_ROWS, total // SHARDS))))
    shards = np.array([shard for shard, _ in laid], np.int64)
    once = index.filter("asks").groupBy("id").agg(F.min("vector").alias("vector"))
    routed = "id long, vector array<double>, visits array<struct<shard: int, parts: array<int>>>"
    asked = staged(once.mapInArrow(_routed(router, filled, shards, probes), routed), "asked")
    sent = asked.select("id", "vector", F.inline("visits"))
    # Queries meet a shard in blocks; only where they are many is a shard copied. These tables have a row a part.
    visited = counted(sent, "shard")
    rows = [(p, shard, n, max(1, -(-visited.get(shard, 0) // QUERY_ROWS))) for p, (shard, n) in zip(filled.tolist(), laid)]
    layout = vectors.sparkSession.createDataFrame(rows, "part int, shard int, tiles int, blocks int")
    per_shard = layout.groupBy("shard").agg(F.max("tiles").alias("tiles"), F.max("blocks").alias("blocks"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    held = (
        index.join(layout, "part")
        .withColumn("tile", F.pmod("nth", F.col("tiles").cast("long")).cast("int"))
        .withColumn("block", F.explode(each("blocks")))
        .withColumn("parts", F.array("part"))
    )
    sent = (
        sent.join(per_shard, "shard")
        .withColumn("tile", F.explode(each("tiles")))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    )
    by = ["shard", "tile", "block"]
    row = lambda df, turn: df.select(*by, F.lit(turn).alias("turn"), "id", "vector", "parts")
    met = row(held, 0).unionByName(row(sent, 1)).repartition(*by).sortWithinPartitions(*by, "turn")
    found = met.mapInArrow(_sweep(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
