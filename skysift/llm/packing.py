"""Best-fit packing of documents into bins under conflicts.

A bin holds at most one document of a source and one of a group of duplicates. Items are dealt
over shards of about ``SHARD_ITEMS`` by a hash of a number of their own; a shard is packed in one task, largest item first.
Bins are kept in order of what is left in them; an item goes to the first bin from its own size upwards whose
source and duplicate bitmaps admit it: the tightest compatible one. Shards bound the
memory and work of a task at any size of the table; every item is placed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import let, words
from skysift.session import staged

CAPACITY = 2_048
SHARD_ITEMS = 20_000
_OUT = "bin_id long, row long, piece long, first_word long, n_words long"


class _Bits:
    """Which marks each bin carries; a mark is -1 where an item conflicts with none by it."""

    def __init__(self, marks: np.ndarray, bins: int):
        self.marks = marks
        self.rows = np.zeros((bins, max(0, int(marks.max(initial=-1))) // 64 + 1), np.uint64)

    def free(self, item: int, bins: np.ndarray) -> np.ndarray:
        mark = self.marks[item]
        if mark < 0:
            return np.ones(len(bins), bool)
        return (self.rows[bins, mark >> 6] & np.uint64(1 << (int(mark) & 63))) == 0

    def put(self, item: int, target: int) -> None:
        mark = self.marks[item]
        if mark >= 0:
            self.rows[target, mark >> 6] |= np.uint64(1 << (int(mark) & 63))


def _numbered(values: np.ndarray) -> np.ndarray:
    """Dense numbers of the values that occur at least twice; -1 for others, which conflict with nothing."""
    _, place, times = np.unique(values, return_inverse=True, return_counts=True)
    return np.where(times > 1, np.cumsum(times > 1) - 1, -1)[place]


def best_fit(sizes: np.ndarray, sources: np.ndarray, groups: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item, items taken in the order given; sizes are from 1 to ``capacity``.

    Among compatible bins with room the one with least room left is taken; of equals the oldest.
    """
    n = len(sizes)
    source, group = _Bits(_numbered(sources), n), _Bits(_numbered(groups), n)
    order, used, out = np.zeros(n, np.int64), 0, np.zeros(n, np.int64)
    opened = 0
    for item, size in enumerate(sizes.tolist()):
        at, step, target = int(np.searchsorted(order[:used], size << 32)), 64, -1
        while at < used:
            bins = order[at : min(used, at + step)] & 0xFFFFFFFF
            fits = np.flatnonzero(source.free(item, bins) & group.free(item, bins))
            if len(fits):
                at += int(fits[0])
                target, left = int(bins[fits[0]]), int(order[at] >> 32) - size
                break
            at, step = at + len(bins), step * 2
        if target < 0:
            at, target, left = used, opened, capacity - size
            opened, used = opened + 1, used + 1
        key = (left << 32) | target
        to = int(np.searchsorted(order[:at], key))
        order[to + 1 : at + 1] = order[to:at].copy()
        order[to] = key
        source.put(item, target)
        group.put(item, target)
        out[item] = target
    return out


def _packed(capacity: int):
    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_words", "row", "piece"], ascending=[False, True, True], kind="stable")
        if len(part):
            bins = best_fit(*(part[c].to_numpy() for c in ("n_words", "source", "cluster")), capacity)
            part = part.assign(bin_id=(part["shard"].to_numpy() << 32) + bins)
        else:
            part = part.assign(bin_id=np.zeros(0, np.int64))
        return part[["bin_id", "row", "piece", "first_word", "n_words"]]

    return pack


def text_cluster(w: Column) -> Column:
    """Group of duplicates from the words of a text: equal words are equal groups."""
    return F.xxhash64(F.array_join(w, " "))


def packed(
    docs: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", source: str = "source",
    cluster: str | None = None, shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """Every document's place: ``bin_id``, ``key``, ``piece``, ``first_word``, ``n_words``.

    A text longer than ``capacity`` words is cut into full pieces, each of which fills a bin, and a rest.
    One without words (null, empty, blank) takes no room: one row with a null bin. ``cluster`` names
    a column of duplicate groups; without it equal word sequences are duplicates. Two rows conflict if
    their sources or groups are equal (a null source equals a null source), so repeated rows never share a
    bin. Rows with a null key are packed too. Other columns are not read.
    """
    shards = max(1, -(-docs.count() // shard_items))
    group = F.xxhash64(F.col(cluster)) if cluster else None
    sized = docs.select(
        F.col(key).cast("long").alias("row"),
        F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit(""))).alias("source"),
        let(
            words(F.col(text).cast("string")),
            lambda w: F.struct(F.size(w).cast("long").alias("n"), (text_cluster(w) if group is None else group).alias("c")),
        ).alias("m"),
    ).select("row", "source", F.col("m.n").alias("total"), F.col("m.c").alias("cluster"), F.monotonically_increasing_id().alias("own"))
    # Sizes and hashes only, written once: rows without an id, and equal ones, keep a number to be dealt by.
    sized = staged(sized, "sizes")
    shard = F.pmod(F.xxhash64(F.lit("shard"), "own"), F.lit(shards)).cast("long")
    pieces = sized.withColumn("shard", shard).withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("total") - 1, F.lit(0)).cast("long"), F.lit(capacity).cast("long")))
    ).select(
        "row", "source", "cluster", "shard",
        F.expr(f"piece div {capacity}").alias("piece"),
        F.col("piece").alias("first_word"),
        F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("piece")).alias("n_words"),
    )
    empty = pieces.filter("n_words = 0").select(F.lit(None).cast("long").alias("bin_id"), "row", "piece", "first_word", "n_words")
    rest = pieces.filter("n_words > 0").groupBy("shard").applyInPandas(_packed(capacity), _OUT)
    return empty.unionByName(rest).withColumnRenamed("row", key)
