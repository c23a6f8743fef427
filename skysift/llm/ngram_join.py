"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersections.

Two texts link when ``100 * |A and B| >= percent * |A or B|`` over their sets of distinct
``k``-word shingles. Every link is found; none is emitted twice over:

1. Equal sets are one class (its smallest id stands for it), so copies never meet.
2. Linked sets differ in few shingles. The space of hashes is cut into pieces; of two linked sets
   more pieces agree than their common pieces can be empty, so at least one filled piece
   among the first few is the same in both (`_Pieces`). The classes of one size group that share a
   filled piece form a tile (a very full one is cut, and its cuts meet in pairs).
3. In a tile hashed bitmaps bound each pair's overlap from above by bit counts. Classes whose
   bound allows a link are joined into neighbourhoods; all links lie inside one.
4. A neighbourhood is cut by size band and hash into units of work of bounded size, which read the texts anew.
   Inside one, what the bitmaps let pass is intersected exactly. Pairs already connected are not compared, so
   tiles and units emit spanning forests; connected components follow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.llm.components import components
from skysift.llm.tokens import mixed, shingle_sets, slices
from skysift.session import staged

TILE_SHINGLES = 1_000_000
TILE_ROWS = 8_192
UNIT_ROWS = 20_000
_HALF = np.uint64(32)


class _Pieces:
    """Which pieces of the hash space a set of ``n`` shingles is filed under.

    Sizes are grouped in classes of a factor of two; a set is filed in its own class and,
    if a larger partner may lie there, in the next. With at most ``d`` differing
    shingles at most ``d`` pieces differ. A set of size n files its first m(n) = d(n) + 1 + s(n)
    pieces, so two linked sets agree in more than s of them. Sets with at most s empty
    pieces file only filled ones; the rare others file empty ones too.
    """

    def __init__(self, percent: int):
        self.percent = percent

    def largest(self, n):
        return n * 100 // self.percent

    def differing(self, n):
        """Most shingles in which a set of n differs from a linked one: both sizes give the bound."""
        return (100 - self.percent) * (n + self.largest(n)) // (100 + self.percent)

    def classes(self, n: int) -> list[int]:
        own = n.bit_length()
        return [own] if self.largest(n) < 1 << own else [own, own + 1]

    @lru_cache(maxsize=64)
    def layout(self, group: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        """Pieces of a class, its smallest size, and for each size m(n) and s(n)."""
        top = (1 << group) - 1
        low = max(1, (1 << (group - 1)) * self.percent // 100)
        sizes = np.arange(low, top + 1, dtype=np.int64)
        need = self.differing(sizes) + 1
        pieces = int(need[-1]) + 2
        empty = need * np.exp(-sizes / pieces)
        filed = np.maximum.accumulate(np.minimum(pieces, need + (empty + 3 * np.sqrt(empty)).astype(np.int64)))
        return pieces, low, filed, filed - need

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        n, out = len(hashes), []
        if n == 0 or self.differing(n) == 0:
            return np.zeros(0, np.uint64)
        for group in self.classes(n):
            pieces, low, filed, spare = self.layout(group)
            m = int(filed[n - low])
            place = ((hashes >> _HALF) * np.uint64(pieces)) >> _HALF
            used = hashes[: np.searchsorted(place, m)]
            place = place[: len(used)].astype(np.int64)
            cuts = np.flatnonzero(np.diff(place, prepend=-1))
            sums = np.add.reduceat(mixed(used), cuts) if len(cuts) else np.zeros(0, np.uint64)
            at = place[cuts]
            partners = spare[max(0, -(-n * self.percent // 100) - low) : n - low + 1]
            if m - len(cuts) > partners.min():
                empty = np.setdiff1d(np.arange(m), at)
                at, sums = np.concatenate([at, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
            out.append(mixed(sums + mixed(at.astype(np.uint64) + np.uint64(group << 40))))
        return np.concatenate(out)


_DESCRIBED = "id long, n_shingles long, mark binary, keys array<bigint>, bits binary"


def _described(percent: int, k: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Pieces(percent)
        for whole in batches:
            for batch in slices(whole, "text"):
                sizes, marks, keys, maps = [], [], [], []
                for hashes in shingle_sets(batch.column("text"), k):
                    sizes.append(len(hashes))
                    sums = [mixed(hashes + np.uint64(turn)).sum(dtype=np.uint64) for turn in (1, 2)]
                    marks.append(sums[0].tobytes() + sums[1].tobytes())
                    keys.append(pieces.keys(hashes).view(np.int64))
                    maps.append(_bitmap(hashes, _width(len(hashes))).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        pa.array(sizes, pa.int64()),
                        pa.array(marks, pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()),
                            pa.array(np.concatenate([np.zeros(0, np.int64), *keys])),
                        ),
                        pa.array(maps, pa.binary()),
                    ],
                    ["id", "n_shingles", "mark", "keys", "bits"],
                )

    return describe


def _width(n: int) -> int:
    """Bits of the bitmap of a set of n: a power of two of one and a half times n or more."""
    return max(64, 1 << (3 * n // 2).bit_length())


def _bitmap(hashes: np.ndarray, width: int) -> np.ndarray:
    spot = hashes & np.uint64(width - 1)
    out = np.zeros(width // 64, np.uint64)
    np.bitwise_or.at(out, (spot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63)))
    return out


def _folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The same set's bitmap at a smaller width."""
    return np.bitwise_or.reduce(bitmap.reshape(-1, words), axis=0)


def _forest(percent: int, ids: np.ndarray, sizes: np.ndarray, maps: np.ndarray, exact=None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that may link by size and bitmap, or that do by ``exact(a, b)``.

    Rows are in the order of their sizes. Pairs that are connected already are passed over.
    """
    group, found = np.arange(len(ids)), []
    # Up to here sizes can link to the set at each place.
    reach = np.searchsorted(sizes, sizes * 100 // percent, "right")
    for a in range(len(ids)):
        later = a + 1 + np.flatnonzero(group[a + 1 : reach[a]] != group[a])
        if not len(later):
            continue
        # Each bit set on one side only stands for an element missing on the other.
        here = np.bitwise_count(maps[a] & ~maps[later]).sum(axis=1, dtype=np.int64)
        there = np.bitwise_count(maps[later] & ~maps[a]).sum(axis=1, dtype=np.int64)
        most = np.minimum(sizes[a] - here, sizes[later] - there)
        later = later[(100 + percent) * most >= percent * (sizes[a] + sizes[later])]
        if exact is None:
            found += [(int(ids[a]), int(ids[b])) for b in later if ids[b] != ids[a]]
            group[np.isin(group, group[later])] = group[a]
            continue
        for b in later:
            if group[b] != group[a] and ids[b] != ids[a] and exact(a, b):
                found.append((int(ids[a]), int(ids[b])))
                group[group == group[b]] = group[a]
    return found


def _tile_pairs(percent: int):
    def pairs(table: pa.Table) -> pa.Table:
        table = table.sort_by([("piece", "ascending"), ("t1", "ascending"), ("t2", "ascending"), ("n_shingles", "ascending"), ("id", "ascending")])
        ids, sizes = (table.column(c).to_numpy() for c in ("id", "n_shingles"))
        maps, tile = table.column("bits").to_pylist(), np.stack([table.column(c).to_numpy() for c in ("piece", "t1", "t2")])
        cuts = [0, *(1 + np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(axis=0))), len(ids)]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                bits = [np.frombuffer(m, np.uint64) for m in maps[a:b]]
                least = min(map(len, bits))
                out += _forest(percent, ids[a:b], sizes[a:b], np.stack([_folded(m, least) for m in bits]))
        return _edges(out)

    return pairs


def _edges(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})


def _links(percent: int, ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Exact links among the sets of one neighbourhood, as a spanning forest."""
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    sets = [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets], np.int64)
    width = _width(int(sizes.max()))

    def exact(a: int, b: int) -> bool:
        shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        return 100 * shared >= percent * (sizes[a] + sizes[b] - shared)

    return _forest(percent, np.array([ids[i] for i in order]), sizes, np.stack([_bitmap(s, width) for s in sets]), exact)


def _linked(percent: int, k: int):
    def link(table: pa.Table) -> pa.Table:
        clusters, ids = table.column("cluster").to_pylist(), table.column("id").to_pylist()
        members: dict[int, list[tuple[int, np.ndarray]]] = {}
        row = 0
        for whole in table.select(["text"]).to_batches():
            for batch in slices(whole, "text"):
                for hashes in shingle_sets(batch.column("text"), k):
                    members.setdefault(clusters[row], []).append((ids[row], hashes))
                    row += 1
        return _edges([p for group in members.values() for p in _links(percent, [i for i, _ in group], [g for _, g in group])])

    return link


def _units(members: DataFrame, percent: int) -> DataFrame:
    """Units of work for each class: (id, cluster, u1 … u4), about one tile of shingles per side."""
    total = members.groupBy("cluster").agg(F.sum("n_shingles").alias("total"))
    small = total.filter(F.col("total") <= TILE_SHINGLES)
    shares = F.greatest(F.lit(1), F.ceil(F.col("bytes") / TILE_SHINGLES)).cast("long")
    bundles = small.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("bytes")).select(shares.alias("bundles"))
    banded = members.withColumn("band", F.floor(F.ln("n_shingles") / -math.log(percent / 100)))
    sized = banded.join(total, "cluster")
    nothing = F.lit(0).cast("long")
    light = (
        sized.filter(F.col("total") <= TILE_SHINGLES)
        .crossJoin(F.broadcast(bundles))  # one row
        .select("id", "cluster", F.lit(-1).cast("long").alias("u1"),
                F.pmod(F.xxhash64("cluster"), F.col("bundles")).alias("u2"), nothing.alias("u3"), nothing.alias("u4"))
    )
    heavy = sized.filter(F.col("total") > TILE_SHINGLES)
    cells = heavy.groupBy("cluster", "band").agg(
        F.greatest(F.lit(1), F.ceil(F.sum("n_shingles") / TILE_SHINGLES)).cast("long").alias("tiles")
    )
    beside = lambda step, name: cells.select("cluster", (F.col("band") + step).alias("band"), F.col("tiles").alias(name))
    placed = (
        heavy.join(cells, ["cluster", "band"])
        .join(beside(1, "below"), ["cluster", "band"], "left")
        .join(beside(-1, "above"), ["cluster", "band"], "left")
        .withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    )
    each = lambda count: F.sequence(F.lit(0).cast("long"), count - 1)
    unit = lambda b1, t1, b2, t2: F.struct(b1.alias("u1"), t1.alias("u2"), b2.alias("u3"), t2.alias("u4"))
    band, tile, none = F.col("band"), F.col("tile"), F.array().cast("array<struct<u1:bigint,u2:bigint,u3:bigint,u4:bigint>>")
    spread = F.concat(
        F.transform(each(F.col("tiles")), lambda t: unit(band, F.least(t, tile), band, F.greatest(t, tile))),
        F.coalesce(F.transform(each(F.col("above")), lambda t: unit(band, tile, band + 1, t)), none),
        F.coalesce(F.transform(each(F.col("below")), lambda t: unit(band - 1, t, band, tile)), none),
    )
    return light.unionByName(placed.select("id", "cluster", F.explode(spread).alias("u")).select("id", "cluster", "u.*"))


def _near(filed: DataFrame, described: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that connect, in each tile, all classes whose bitmaps allow a link."""
    met = staged(
        filed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("piece"))).filter("n > 1"), "tiles"
    )
    tiles = F.ceil(F.col("n") / TILE_ROWS)
    tile = F.pmod(F.xxhash64("id"), F.col("tiles"))
    others = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1),
        lambda t: F.struct(F.least(t, tile).alias("t1"), F.greatest(t, tile).alias("t2")),
    )
    cut = met.withColumn("tiles", tiles).select("id", "piece", F.explode(others).alias("t")).select("id", "piece", "t.*")
    units = max(1, -(-met.count() // UNIT_ROWS))
    unit = F.pmod(F.xxhash64("piece", "t1", "t2"), F.lit(units))
    work = cut.join(described, "id").select("id", "piece", "t1", "t2", "n_shingles", "bits", unit.alias("unit"))
    return work.groupBy("unit").applyInArrow(_tile_pairs(percent), "a long, b long").distinct()


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``n_shingles``, ``class_id`` (smallest id with an equal
    set) and ``component_id`` (smallest id reachable by links, its own included).

    A null or empty text, or one without words, has an empty set and links with nothing; both ids are
    then its own. Rows that share an id count as one node. A null id stays null and links with
    nothing. An empty table gives no rows. Other columns are not read. The longest text must fit a task's
    memory several times over.
    """
    named = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    described = staged(
        named.mapInArrow(_described(percent, k), _DESCRIBED), "shingles"
    )
    filled = described.filter("n_shingles > 0 and id is not null")
    classes = staged(
        filled.groupBy("mark", "n_shingles").agg(F.min("id").alias("class_id")), "classes"
    )
    heads = classes.select(F.col("class_id").alias("id"), "mark")
    filed = filled.join(heads, ["id", "mark"]).select("id", F.explode("keys").alias("piece"))
    around = components(_near(filed, filled.join(heads, ["id", "mark"]).select("id", "n_shingles", "bits"), percent))
    sizes = classes.groupBy(F.col("class_id").alias("id")).agg(F.max("n_shingles").alias("n_shingles"))
    members = staged(
        around.select(F.col("node").alias("id"), F.col("component").alias("cluster")).join(sizes, "id"), "neighbours"
    )
    units = _units(members, percent)
    work = units.join(named.filter("id is not null"), "id")
    links = work.groupBy("u1", "u2", "u3", "u4", *_own_cluster()).applyInArrow(_linked(percent, k), "a long, b long")
    joined = components(links.distinct()).select(F.col("node").alias("class_id"), "component")
    per_class = classes.join(joined, "class_id", "left").select(
        "mark", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id")
    )
    own: Column = F.col("id")
    return (
        described.select("id", "n_shingles", "mark")
        .join(per_class, ["mark", "n_shingles"], "left")
        .select(
            F.col("id").alias(key),
            "n_shingles",
            F.when(own.isNotNull(), F.coalesce("class_id", own)).alias("class_id"),
            F.when(own.isNotNull(), F.coalesce("component_id", own)).alias("component_id"),
        )
    )


def _own_cluster() -> list[Column]:
    """Bundles hold many small neighbourhoods; a large one has units of its own."""
    return [F.when(F.col("u1") >= 0, F.col("cluster")).alias("own")]


def one_per_component(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keep one document of each component: the one with the smallest id.

    Of repeated rows of that id one stays; rows without an id all stay, for nothing links them.
    Columns and their names are those of ``docs``.
    """
    keep = jaccard_classes(docs, k, percent, key, text).filter(F.col("component_id") == F.col(key)).select(
        F.col(key).alias("_kept_id")
    ).distinct()
    held = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("_kept_id"))
    known = held.filter("_kept_id is not null").join(keep, "_kept_id", "left_semi").dropDuplicates(["_kept_id"])
    return known.unionByName(held.filter("_kept_id is null")).select("row.*")
