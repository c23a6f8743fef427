"""Fitted tree ensembles as column expressions and as SQL.

A fitted pipeline is read out node by node and becomes conditions over the feature columns: one nested condition per
tree, and the weighted sum of the trees. Scoring then is part of the plan around it: it needs no assembled
vectors, works in streams and in SQL, and is optimized with the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    """Rows whose feature is at most the threshold go left; all others, missing ones too, go right."""

    feature: str
    threshold: float
    left: Leaf | Split
    right: Leaf | Split


@dataclass(frozen=True)
class Ensemble:
    trees: tuple[Leaf | Split, ...]
    weights: tuple[float, ...]

    def features(self) -> set[str]:
        found: set[str] = set()
        todo = list(self.trees)
        while todo:
            node = todo.pop()
            if isinstance(node, Split):
                found.add(node.feature)
                todo += [node.left, node.right]
        return found


def _node(java, names: list[str]) -> Leaf | Split:
    if java.getClass().getSimpleName() == "LeafNode":
        return Leaf(java.prediction())
    split = java.split()
    if split.getClass().getSimpleName() != "ContinuousSplit":
        raise ValueError("only numeric features can be compiled")
    return Split(names[split.featureIndex()], split.threshold(), _node(java.leftChild(), names), _node(java.rightChild(), names))


def ensemble(model: PipelineModel) -> Ensemble:
    """Trees and weights of a fitted pipeline of an assembler and a boosted (or single, or averaged) tree regression."""
    assembler, fitted = model.stages[0], model.stages[-1]
    if not isinstance(assembler, VectorAssembler):
        raise ValueError("the first stage must assemble the features")
    names = assembler.getInputCols()
    trees = fitted.trees if hasattr(fitted, "trees") else [fitted]
    weights = list(fitted.treeWeights) if hasattr(fitted, "treeWeights") else [1.0]
    if "RandomForest" in type(fitted).__name__:
        weights = [1.0 / len(trees)] * len(trees)
    return Ensemble(tuple(_node(t._java_obj.rootNode(), names) for t in trees), tuple(float(w) for w in weights))


def nodes(found: Ensemble) -> list[tuple[int, int, str | None, float]]:
    """(tree, place, feature, number): the threshold of a split or the value of a leaf; children of place p are 2p and 2p + 1."""
    out = []
    for tree, root in enumerate(found.trees):
        todo = [(1, root)]
        while todo:
            place, node = todo.pop()
            if isinstance(node, Leaf):
                out.append((tree, place, None, node.value))
            else:
                out.append((tree, place, node.feature, node.threshold))
                todo += [(2 * place, node.left), (2 * place + 1, node.right)]
    return sorted(out)


def tree_column(node: Leaf | Split) -> Column:
    if isinstance(node, Leaf):
        return F.lit(node.value)
    return F.when(F.col(node.feature) <= F.lit(node.threshold), tree_column(node.left)).otherwise(tree_column(node.right))


def with_prediction(df: DataFrame, found: Ensemble, name: str) -> DataFrame:
    """Add the weighted sum of the trees.

    Trees are columns of one array, summed in a second step: generated code is cut by column, and no method grows
    with the number of trees. The sum runs in order of the trees; the fitted model adds in lanes, so the
    two can differ in the last digits of a double, never in a tree.
    """
    parts = F.array(*[tree_column(t) for t in found.trees])
    weights = F.array(*[F.lit(w) for w in found.weights])
    values = df.withColumn("_trees", parts)
    total = F.aggregate(F.zip_with("_trees", weights, lambda x, w: x * w), F.lit(0.0), lambda total, x: total + x)
    return values.withColumn(name, total).drop("_trees")


def tree_sql(node: Leaf | Split) -> str:
    if isinstance(node, Leaf):
        return f"CAST({node.value!r} AS DOUBLE)"
    return f"CASE WHEN {node.feature} <= CAST({node.threshold!r} AS DOUBLE) THEN {tree_sql(node.left)} ELSE {tree_sql(node.right)} END"


def prediction_sql(found: Ensemble) -> str:
    """The weighted sum of the trees as one SQL expression over the feature columns, in order of the trees."""
    terms = [f"{tree_sql(t)} * CAST({w!r} AS DOUBLE)" for t, w in zip(found.trees, found.weights)]
    return "(" + " + ".join(["CAST(0.0 AS DOUBLE)", *terms]) + ")"
