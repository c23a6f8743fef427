"""Learned decision lists for text quality, emitted as ordered conditional columns.

Everything per document is a DataFrame expression. A bounded sample of labelled rows is
described by the same expressions; on its figures sequential covering grows conjunctions of thresholds
against junk, prunes each on rows held back, and stops when no precise rule is left.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import SPACE_RUN, SPACES, let, words

WINDOW = 8
FEWEST_WORDS = 20
REPEATED_PERCENT = 30
SAMPLE_ROWS = 20_000
SYMBOLS = "#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "n_words", "mean_word", "symbols_per_word", "bangs_per_word", "capital_share", "distinct_share",
    "dup_line_share", "repeat_share",
]


def _repeats(hashes: Column) -> Column:
    """Words covered by windows that occur more than once; ``hashes`` has one value per word."""
    starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
    windows = F.when(
        F.size(hashes) >= WINDOW,
        F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(found: Column) -> Column:
        placed = F.array_sort(F.transform(found, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(placed, lambda s: let(F.array_sort(repeated_places(s)), spread))

    def repeated_places(s: Column) -> Column:
        same = lambda e, other: F.coalesce(e["h"] == F.get(s, other)["h"], F.lit(False))
        marked = F.transform(s, lambda e, i: F.when(same(e, i - 1) | same(e, i + 1), e["i"]))
        return F.filter(marked, lambda x: x.isNotNull())

    def spread(places: Column) -> Column:
        steps = F.transform(
            places, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1), x + WINDOW) - x)
        )
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0)))


def _removed(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _measured(text: Column) -> Column:
    """All counts of one text in a struct; null counts as empty."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")

    def of(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return let(
            F.struct(hashes.alias("h"), F.transform(lines, lambda x: F.xxhash64(x)).alias("l")),
            lambda v: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _removed(text, "[#*$%&|<>]+").cast("long").alias("n_symbols"),
                (F.size(v["l"]) - F.size(F.array_distinct(v["l"]))).cast("long").alias("n_dup_lines"),
                _repeats(v["h"]).cast("long").alias("n_repeat_words"),
                F.size(v["l"]).cast("long").alias("n_lines"),
                F.size(F.array_distinct(v["h"])).cast("long").alias("n_distinct"),
                _removed(text, "!+").cast("long").alias("n_bangs"),
                _removed(text, "[A-Z]+").cast("long").alias("n_capitals"),
            ),
        )

    return let(words(text), of)


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: the key, ``COUNTS`` and the features that rules test, all from its whole text.

    Null and empty texts have zero counts and zero shares. Rows are not merged; other columns are not read.
    """
    held = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    flat = held.select(F.col(key), _measured(F.col("text")).alias("m")).select(F.col(key), "m.*")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return flat.select(
        F.col(key),
        *COUNTS,
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "n_words").alias("symbols_per_word"),
        share("n_bangs", "n_words").alias("bangs_per_word"),
        share("n_capitals", "word_chars").alias("capital_share"),
        share("n_distinct", "n_words").alias("distinct_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
    )


def base_failed() -> Column:
    """The fixed rules: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < FEWEST_WORDS) | (
        100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words")
    )


# --- learning --------------------------------------------------------------------------


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        value = F.col(self.feature).cast("double")
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


Rule = tuple[Test, ...]


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, key: str = "doc_id") -> DataFrame:
    """Documents with a quality label, ``rows`` of them at most, chosen by a hash of the id.

    The chosen ids are at most ``rows`` pairs of numbers, which bounds what is broadcast.
    """
    known = labels.filter(f"quality is not null and {key} is not null").groupBy(key).agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64(key), key).limit(rows)
    return counted(docs.join(F.broadcast(chosen.select(key)), key, "left_semi"), key).join(F.broadcast(chosen), key)


def _thresholds(values: Sequence[float], most: int = 64) -> list[float]:
    ordered = sorted(values)
    picks = {ordered[(len(ordered) - 1) * i // most] for i in range(most + 1)} if ordered else set()
    return sorted(picks)


def _grown(rows: list[dict], tests: list[Test]) -> Rule:
    """Add the test with the largest information gain until only junk is covered."""
    rule: list[Test] = []
    while True:
        junk = sum(r["junk"] for r in rows)
        if not junk or junk == len(rows) or len(rule) == len(FEATURES):
            return tuple(rule)
        before, best = math.log2(junk / len(rows)), (1e-9, None)
        for feature in FEATURES:
            ordered = sorted((r[feature], r["junk"]) for r in rows)
            values, sums = [v for v, _ in ordered], [0]
            for _, bad in ordered:
                sums.append(sums[-1] + bad)
            for test in tests:
                if test.feature == feature:
                    at = bisect.bisect_right(values, test.threshold)
                    n = len(rows) - at if test.above else at
                    p = junk - sums[at] if test.above else sums[at]
                    if p and n < len(rows):
                        gain = p * (math.log2(p / n) - before)
                        if gain > best[0] + 1e-12:
                            best = (gain, test)
        if best[1] is None:
            return tuple(rule)
        rule.append(_centred(best[1], rows))
        rows = [r for r in rows if best[1].holds(r)]


def _centred(test: Test, rows: list[dict]) -> Test:
    """Move a threshold to the middle of the gap between the rows it parts."""
    inside = [r[test.feature] for r in rows if test.holds(r)]
    outside = [r[test.feature] for r in rows if not test.holds(r)]
    near = (min(inside), max(outside)) if test.above else (max(inside), min(outside))
    return Test(test.feature, test.above, sum(near) / 2)


def _covered(rule: Rule, rows: list[dict]) -> list[dict]:
    return [r for r in rows if all(t.holds(r) for t in rule)]


def _worth(rule: Rule, rows: list[dict]) -> float:
    hit = _covered(rule, rows)
    junk = sum(r["junk"] for r in hit)
    return (2 * junk - len(hit)) / len(hit) if hit else -1.0


def learned(rows: list[dict], precision: float = 0.95, fewest: int = 3) -> list[Rule]:
    """Ordered rules against junk from described rows with ``junk`` 0 or 1 and a text ``fold`` key.

    Two thirds of the rows grow rules, the rest prune them. A rule enters the list while at least ``fewest`` rows
    in all fall under it and its share of junk, on either part, reaches ``precision``.
    """
    kept_back = lambda r: int(hashlib.md5(r["fold"].encode()).hexdigest()[:8], 16) % 3 == 0
    grow, prune = [r for r in rows if not kept_back(r)], [r for r in rows if kept_back(r)]
    tests = [Test(f, above, t) for f in FEATURES for t in _thresholds([r[f] for r in rows]) for above in (True, False)]
    rules: list[Rule] = []
    while any(r["junk"] for r in grow):
        rule = _grown(grow, tests)
        options = [rule[:n] for n in range(1, len(rule) + 1)]
        if not options:
            break
        rule = max(options, key=lambda o: (_worth(o, prune), -len(o)))
        hits = [_covered(rule, part) for part in (grow, prune)]
        exact = all(sum(r["junk"] for r in h) >= precision * len(h) for h in hits)
        if not exact or len(hits[0]) + len(hits[1]) < fewest or not hits[0]:
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not all(t.holds(r) for t in rule)] for part in (grow, prune))
    return rules


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, key: str = "doc_id") -> list[Rule]:
    """Learn the list; without usable labels it is empty and nothing is rejected by it."""
    found = labelled_sample(docs, labels, rows, key).select(key, "quality", *FEATURES).collect()
    described = [
        {f: float(r[f]) for f in FEATURES} | {"junk": int(r["quality"] == 0), "fold": str(r[key])} for r in found
    ]
    return learned(sorted(described, key=lambda r: r["fold"]))


def accepted(rules: list[Rule]) -> Column:
    """The list as one conditional column over the features: false under its first rule that holds, else true."""
    verdict = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        condition = F.lit(True)
        for test in rule:
            condition = condition & test.column()
        verdict = verdict.when(condition, F.lit(False))
    return verdict.otherwise(F.lit(True))


def judged(docs: DataFrame, rules: list[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, counts, features, ``base_failed`` and ``kept`` of every document."""
    both = counted(docs, key, text).withColumn("base_failed", base_failed())
    return both.withColumn("kept", ~F.col("base_failed") & accepted(rules))


def good_documents(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows that pass, with their own columns, whatever these are called."""
    held = docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"))
    return judged(held, rules, "row", "text").filter("kept").select("row.*")
