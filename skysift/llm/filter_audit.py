"""Interaction of five document filters: what each removes, finds removed already, or alone would catch, in every order.

A document is reduced to the mask of the filters it fails, and documents to counts per part and mask. The 120 orders
of the filters are numbered by their Lehmer code, that is lexicographically, so all orders that begin alike are a run
of numbers. A mask is removed at a step by the orders whose beginning ends in its first failing filter there: a few runs
per step. Each run adds a part's count where it begins and takes it off after its end; a prefix sum over the 120
numbers then gives the count of every order. The work after the masks does not depend on the number of documents.
"""

from __future__ import annotations

from collections import Counter
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.llm.common import join_counted, words
from skysift.session import staged

FILTERS = "ABCDE"
STEPS = len(FILTERS)
ORDERS = factorial(STEPS)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lehmer_rank(beginning: tuple[int, ...], of: int = STEPS) -> int:
    """Number of the first lexicographic order of ``range(of)`` with this beginning."""
    rank = 0
    for place, item in enumerate(beginning):
        smaller = item - sum(earlier < item for earlier in beginning[:place])
        rank += smaller * factorial(of - 1 - place)
    return rank


def interval_ends() -> list[tuple[int, int, int, int, int]]:
    """(mask, step, rank, removed, redundant): how the counts of a mask change where its runs begin and end.

    ``removed`` for runs of orders that remove the mask at the step, ``redundant`` for those whose filter of the step it fails
    after an earlier one. Runs that touch cancel out.
    """
    ends: Counter = Counter()
    for mask in range(1, 1 << STEPS):
        for step in range(1, STEPS + 1):
            for beginning in permutations(range(STEPS), step):
                if not mask >> beginning[-1] & 1:
                    continue
                kind = int(any(mask >> item & 1 for item in beginning[:-1]))
                first = lehmer_rank(beginning)
                ends[mask, step, first, kind] += 1
                ends[mask, step, first + factorial(STEPS - step), kind] -= 1
    places = sorted({k[:3] for k, v in ends.items() if v and k[2] < ORDERS})
    return [(*place, ends[(*place, 0)], ends[(*place, 1)]) for place in places]


def order_names() -> list[str]:
    """The orders by number."""
    return ["".join(p) for p in permutations(FILTERS)]


def text_mask(text: Column, found: Column) -> Column:
    """Mask of the filters A to D for a text (not null) and its words."""
    n, distinct = F.size(found), F.size(F.array_distinct(found))
    upper = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    fails = [n < 100, distinct.cast("long") * 100 < n.cast("long") * 80, upper.cast("long") * 100 > F.length(text).cast("long") * 10,
             text.rlike("[#$%&*|]")]
    mask = F.lit(0)
    for place, failed in enumerate(fails):
        mask = mask + F.when(failed, F.lit(1 << place)).otherwise(F.lit(0))
    return mask


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Per document ``id``, ``part`` and the ``mask`` of the filters it fails; the texts are read once.

    Filter E fails where a smaller id has the same text; texts are told apart by their SHA-256. A null text is empty, a null
    part is the empty one, a null id is no smaller than any and has none below it.
    """
    body = docs.select(
        F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).withColumn("words", words(F.col("text")))
    narrow = staged(
        body.select("id", "part", text_mask(F.col("text"), F.col("words")).alias("mask"),
                    F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")),
        "masks",
    )
    same = narrow.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    both = join_counted(narrow, staged(same, "same_texts"), "digest", "copies")
    copy = F.when(F.col("id") > F.col("first_id"), F.lit(1 << 4)).otherwise(F.lit(0))
    return both.select("id", "part", (F.col("mask") + copy).alias("mask"))


def audited(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts per ``part``, ``filter_order`` and ``step`` from rows of (id, part, mask) and labels (doc_id, quality, toxic).

    A document is good (toxic) if any of its label rows says 1. Repeated rows count each; every part has all 600 rows.
    An empty table gives none.
    """
    spark = masks.sparkSession
    # Rows of one id are merged first, so that no id is a heavy key of the join.
    documents = masks.groupBy("id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").groupBy("id").agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("bad")
    )
    count = lambda flag: F.sum(F.col("n") * F.coalesce(F.col(flag), F.lit(0)))
    groups = staged(
        documents.join(marks, "id", "left").groupBy("part", "mask").agg(
            F.sum("n").alias("n"), count("good").alias("good"), count("bad").alias("bad")
        ),
        "mask_counts",
    )
    alone = [F.sum(F.when(F.col("mask") == 1 << place, F.col("n")).otherwise(F.lit(0))) for place in range(STEPS)]
    parts = groups.groupBy("part").agg(F.sum("n").alias("total"), F.array(*alone).alias("alone"))
    grid = parts.select("*", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("rank")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("step")
    )
    # A fixed table of a few thousand rows.
    ends = spark.createDataFrame(interval_ends(), "mask int, step int, rank int, removes int, repeats int")
    changes = groups.join(ends, "mask").groupBy("part", "step", "rank").agg(
        F.sum(F.col("n") * F.col("removes")).alias("removed"), F.sum(F.col("n") * F.col("repeats")).alias("redundant"),
        F.sum(F.col("good") * F.col("removes")).alias("good_lost"), F.sum(F.col("bad") * F.col("removes")).alias("toxic_lost"),
    )
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    counts = ["removed", "redundant", "good_lost", "toxic_lost"]
    summed = grid.join(changes, ["part", "step", "rank"], "left").select(
        "part", "total", "alone", "rank", "step", *[F.coalesce(F.sum(c).over(along), F.lit(0)).alias(c) for c in counts]
    )
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    order = F.get(F.array(*[F.lit(name) for name in order_names()]), F.col("rank"))
    named = summed.withColumns({"kept": F.col("total") - F.sum("removed").over(so_far), "filter_order": order})
    named = named.withColumn("place", F.instr(F.lit(FILTERS), F.substr("filter_order", F.col("step"), F.lit(1))))
    return named.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", F.get("alone", F.col("place") - 1).alias("unique_fails"),
        "good_lost", "toxic_lost", F.sum("removed").over(Window.partitionBy("part", "place")).alias("shapley"),
    )
