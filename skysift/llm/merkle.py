"""Merkle manifest of a table: leaves, trees per part, root, proofs, and folds that resume copied hash states.

Rows are leaves, dealt into ranges of (part, key) and numbered there. A tree is built in blocks of ``BLOCK`` neighbours,
one task per block and round, until one node of each part is left; the parts' nodes are leaves of one more tree. A parent
hashes its children one after another and retains a copy of the hash state before each of them. Folding a changed leaf
takes the copy before its slot, adds the replacement and the siblings to its right, and goes on so in the parent of that one:
what lies to the left is never hashed again. All leaves of a block share the parents above it, so their states are made once per block.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.llm.common import crc
from skysift.session import staged

FAN = 8
#: Three levels of the tree.
BLOCK = FAN**3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEPS = "array<struct<left:string,right:string>>"


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 over the fields, each as its length in bytes, a colon and its text, or a dash for null."""
    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


class Parent:
    """A node over up to ``FAN`` children: its digest, and the hash state before each child."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: list[str]):
        self.children, self.states = children, []
        state = sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def folded(self, slot: int, child: str) -> str:
        """The digest with another child: the state before it, the child, the siblings to the right."""
        state = self.states[slot].copy()
        state.update("".join([child, *self.children[slot + 1 :]]).encode())
        return state.hexdigest()

    def siblings(self, slot: int) -> tuple[str, str]:
        return "".join(self.children[:slot]), "".join(self.children[slot + 1 :])


def _levels(digests: list[str], in_part: int, block: int) -> list[list[Parent]]:
    """Parents over a block's neighbours, level by level, up to one node; none where the part has one node only."""
    out, most = [], block
    while in_part > 1 and most > 1:
        parents = [Parent(digests[at : at + FAN]) for at in range(0, len(digests), FAN)]
        out.append(parents)
        digests, in_part, most = [p.digest for p in parents], -(-in_part // FAN), most // FAN
    return out


def _chain(levels: list[list[Parent]], at: int) -> list[tuple[str, str]]:
    """Siblings to the left and to the right of each node on the way up from a place in the block."""
    out = []
    for parents in levels:
        out.append(parents[at // FAN].siblings(at % FAN))
        at //= FAN
    return out


class _Above:
    """A parent above a block, known by what lies left and right of the way up: one state serves all of the block."""

    __slots__ = ("state", "right")

    def __init__(self, left: str, right: str):
        self.state, self.right = sha256(left.encode()), right.encode()

    def folded(self, child: str) -> str:
        state = self.state.copy()
        state.update(child.encode())
        state.update(self.right)
        return state.hexdigest()


def _numbered(df: DataFrame, part: str, order: list[str]) -> DataFrame:
    """Add ``at``, the place of each row in its part, and ``in_part``, the rows of the part.

    Rows are dealt into ranges, counted per range and part, and numbered within; no part is gathered in one task. Rows equal in
    the whole order are told apart by a number of their own.
    """
    own = df.withColumn("_own", F.monotonically_increasing_id())
    dealt = own.repartitionByRange(part, *order, "_own").withColumn("_range", F.spark_partition_id())
    dealt = staged(dealt, "ranges")
    counts = dealt.groupBy(part, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        part, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(part)).alias("in_part"),
    )
    inside = Window.partitionBy(part, "_range").orderBy(*order, "_own")
    placed = dealt.withColumn("_nth", F.row_number().over(inside)).join(starts, [part, "_range"])
    return placed.withColumn("at", F.col("_before") + F.col("_nth") - 1).drop("_range", "_own", "_n", "_nth", "_before")


@dataclass
class Tree:
    """Rounds of nodes (part, at, in_part, digest), each the tops of the blocks of the one before, and one node per part."""

    rounds: list[DataFrame]
    roots: DataFrame
    block: int


def _block(size: int) -> Column:
    return F.floor(F.col("at") / size).alias("block")


def _top(block: int):
    def top(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("at")
        digests, in_part = list(nodes["digest"]), int(nodes["in_part"].iloc[0])
        levels = _levels(digests, in_part, block)
        return pd.DataFrame({
            "part": nodes["part"].iloc[:1], "at": nodes["at"].iloc[:1] // block, "in_part": -(-in_part // block),
            "digest": levels[-1][0].digest if levels else digests[0],
        })

    return top


def build(leaves: DataFrame, block: int = BLOCK) -> Tree:
    """Trees over nodes (part, at, in_part, digest); ``part`` is a text, never null. ``block`` is a power of ``FAN``."""
    rounds, nodes = [], leaves
    while True:
        tops = nodes.select("part", "at", "in_part", "digest").groupBy("part", _block(block)).applyInPandas(
            _top(block), "part string, at long, in_part long, digest string"
        )
        rounds.append(nodes)
        nodes = staged(tops, "nodes")
        if (nodes.agg(F.max("in_part")).first()[0] or 0) <= 1:  # one number
            return Tree(rounds, nodes, block)


def _ways(block: int, name: str = "at"):
    def ways(key: tuple, nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("at")
        levels = _levels(list(nodes["digest"]), int(nodes["in_part"].iloc[0]), block) if len(nodes) else []
        rest = [(s["left"], s["right"]) for s in above["steps"].iloc[0]] if len(above) else []
        steps = [[{"left": a, "right": b} for a, b in _chain(levels, int(at) % block) + rest] for at in nodes["at"]]
        return pd.DataFrame({"part": nodes["part"], name: nodes[name], "steps": steps})

    return ways


def ways_up(tree: Tree, above: DataFrame | None = None) -> DataFrame:
    """(part, block, steps): the siblings on the way from each block of the first round to the end of ``above``.

    ``above`` holds (part, steps), the way on from each part's node; without it there is none.
    """
    ways = tree.roots.select("part", "at", F.array().cast(_STEPS).alias("steps"))
    if above is not None:
        ways = tree.roots.select("part", "at").join(above, "part")
    for nodes in reversed(tree.rounds[1:]):
        upper = ways.withColumnRenamed("at", "block")
        below = nodes.select("part", "at", "in_part", "digest", _block(tree.block))
        ways = below.groupBy("part", "block").cogroup(upper.groupBy("part", "block")).applyInPandas(
            _ways(tree.block), f"part string, at long, steps {_STEPS}"
        )
    return staged(ways.withColumnRenamed("at", "block"), "ways")


def _folded(block: int):
    def fold(key: tuple, leaves: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        """Proof and fold of each leaf of a block, through its own parents and those above it."""
        leaves = leaves.sort_values("at")
        levels = _levels(list(leaves["digest"]), int(leaves["in_part"].iloc[0]), block) if len(leaves) else []
        steps = list(above["steps"].iloc[0]) if len(above) else []
        parents = [_Above(s["left"], s["right"]) for s in steps]
        rest = "".join(s["left"] + s["right"] for s in steps).encode()
        proofs, folds = [], []
        for at, own, new in zip(leaves["at"], leaves["digest"], leaves["replacement"]):
            place, node = int(at) % block, own if new is None else new
            proof = sha256()
            for level in levels:
                parent, slot = level[place // FAN], place % FAN
                proof.update("".join(parent.siblings(slot)).encode())
                node, place = parent.folded(slot, node), place // FAN
            proof.update(rest)
            for parent in parents:
                node = parent.folded(node)
            proofs.append(proof.hexdigest())
            folds.append(node)
        return leaves[["part", "key", "digest"]].assign(proof=proofs, folded=folds)

    return fold


def manifest(
    docs: DataFrame, tampered: Column, replacement: list[Column], fields: list[str], key: str = "doc_id", part: str = "lang", block: int = BLOCK
) -> DataFrame:
    """Per row: key, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    A leaf hashes the ``fields``; where ``tampered`` holds, the fold starts from a leaf of the ``replacement`` columns instead. Leaves of a
    part ascend by key (null first), of equal keys by leaf; each row is a leaf of its own, repeated rows too. Parts ascend
    bytewise, null first; null and empty are two parts. Nulls in any field are part of the leaf. An empty table gives no rows.
    Columns outside ``fields`` are not read.
    """
    leaf = leaf_digest([F.col(c) for c in fields])
    changed = F.when(F.coalesce(tampered, F.lit(False)), leaf_digest(replacement))
    part_text = F.col(part).cast("string")
    # Parts as texts that sort like their values, null first.
    named = F.when(part_text.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), part_text))
    narrow = staged(docs.select(F.col(key).alias("key"), named.alias("part"), leaf.alias("digest"), changed.alias("replacement")), "leaves")
    leaves = staged(_numbered(narrow, "part", ["key", "digest"]), "placed")
    tree = build(leaves, block)
    # The parts' nodes are the leaves of one more tree, with a single part.
    subroots = tree.roots.select(F.lit("").alias("part"), F.col("part").alias("name"), F.col("digest"))
    upper = staged(_numbered(subroots, "part", ["name"]), "subroots")
    top = build(upper, block)
    ways = ways_up(top)
    fan_in = upper.select("part", "at", "in_part", "digest", "name", _block(block))
    named_ways = fan_in.groupBy("part", "block").cogroup(ways.groupBy("part", "block")).applyInPandas(
        _ways(block, "name"), f"part string, name string, steps {_STEPS}"
    ).select(F.col("name").alias("part"), "steps")
    root = top.roots.select("digest").first()  # one value
    up = ways_up(tree, staged(named_ways, "part_ways"))
    # Keys travel as texts: pandas has no whole numbers beside nulls.
    own = leaves.select("part", "at", "in_part", F.col("key").cast("string").alias("key"), "digest", "replacement", _block(block))
    folds = own.groupBy("part", "block").cogroup(up.groupBy("part", "block")).applyInPandas(
        _folded(block), "part string, key string, digest string, proof string, folded string"
    )
    out = folds.join(tree.roots.select("part", F.col("digest").alias("subroot")), "part")
    whole = F.lit(root["digest"] if root else None)
    return out.select(
        F.col("key").cast(docs.schema[key].dataType).alias(key), F.col("digest").alias("leaf"), "subroot", whole.alias("root"), F.col("proof").alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == whole).alias("verified"),
    )


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def one_in_three(key: str = "doc_id") -> Column:
    return crc(F.col(key)) % 3 == 0
