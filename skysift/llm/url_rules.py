"""Host and path rules for URLs, by a sort-merge range join.

A host is keyed by its labels in reverse, each followed by a dot, so a rule's host and all its subdomains are one
interval of keys that begins at the rule's own. Rules and pages are range-partitioned and sorted
together; a sweep keeps a stack of the rules whose intervals hold the current key. A partition
starts with the rules that enclose its first key, found by joining that key's prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.session import staged

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def host_key(name: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.", -1)), "."), F.lit("."))


class _Level:
    """The rules of one host: the longest path that begins a given one."""

    def __init__(self, key: str):
        self.key, self.rules, self.lengths = key, {}, []

    def add(self, path: str, rule: str, verdict: str) -> None:
        held = self.rules.get(path)
        # Of two rules for one host and path a block holds.
        if held is None or verdict == "block":
            self.rules[path] = (rule, verdict)
            self.lengths = sorted({len(p) for p in self.rules}, reverse=True)

    def best(self, path: str) -> tuple[str, str] | None:
        return next((self.rules[path[:n]] for n in self.lengths if path[:n] in self.rules), None)


def _swept(default: str):
    schema = pa.schema([("id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, []
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("part", "key", "kind", "id", "host", "path", "rule", "verdict")]
            for at, key, kind, page, name, way, rule, verdict in zip(*columns):
                if at != part:
                    part, stack = at, []
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1].key != key:
                        stack.append(_Level(key))
                    stack[-1].add(way, rule, verdict)
                else:
                    hits = [hit for level in stack if (hit := level.best(way))]
                    best = max(hits, key=lambda hit: (len(hit[0]), hit[0].find("/"))) if hits else (None, default)
                    out.append((page, name, way, *best))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, schema)], schema=schema)

    return sweep


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: key, ``host``, ``path``, ``rule`` (host and path as one text, or null) and ``verdict``.

    ``rules`` has host, path, verdict (``allow`` or ``block``). A rule fits its host and all subdomains where the
    path begins with its own; of fitting rules the longest text wins, of equally long ones that with the longer
    host; of two for the same host and path a block. A page no rule fits gets ``default``; so does one
    without a URL, whose host and path are empty. Rules with a null field are ignored, repeated ones count once. Rows
    are not merged.
    """
    named = rules.dropna(subset=["host", "path", "verdict"]).select(
        F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict"
    )
    none = F.lit(None).cast("string")
    laid = named.select(
        host_key(F.col("host")).alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "host", "path",
        F.concat("host", "path").alias("rule"), "verdict",
    ).distinct()
    asked = pages.select(host(F.col(url).cast("string")).alias("host"), path(F.col(url).cast("string")).alias("path"), F.col(key).cast("long").alias("id"))
    asked = asked.select(
        host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "id", "host", "path", none.alias("rule"), none.alias("verdict")
    )
    # The id spreads the pages of one host over partitions.
    dealt = asked.unionByName(laid).repartitionByRange("key", "kind", F.xxhash64("id", "path"))
    parts = staged(dealt.withColumn("part", F.spark_partition_id()), "url-parts")
    labels = F.split("low", r"\.")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit("."))
    )
    first = parts.groupBy("part").agg(F.min("key").alias("low")).select("part", F.explode(prefixes).alias("key"))
    around = first.join(laid, "key").select(*parts.columns)
    ordered = parts.unionByName(around).repartition("part").sortWithinPartitions("part", "key", "kind")
    return ordered.mapInArrow(_swept(default), "id long, host string, path string, rule string, verdict string").withColumnRenamed("id", key)
