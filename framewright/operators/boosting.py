"""Boosting with more than two classes, and trees of two-class classifiers. A round reads
the rows once, for all features together; what comes to the driver is a table of features,
bins and classes."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.workspace import fresh_dir


@dataclass(frozen=True)
class Stump:
    """Class ``above`` where the feature is over the threshold, else ``below``."""

    feature: str
    threshold: float
    below: int
    above: int
    alpha: float

    def decided(self) -> Column:
        return F.when(F.col(self.feature) > self.threshold, F.lit(self.above)).otherwise(F.lit(self.below))


def _ranges(rows: DataFrame, x: list[str], label: str) -> tuple[dict[str, tuple[float, float]], list[int]]:
    """The ranges of the features that vary, and the classes."""
    got = rows.agg(F.array_sort(F.collect_set(label)).alias("classes"), *[g(f).cast("double").alias(f"{n}{k}") for k, f in enumerate(x) for n, g in (("a", F.min), ("b", F.max))]).first()
    ends = {f: (got[f"a{k}"], got[f"b{k}"]) for k, f in enumerate(x)}
    return {f: (a, b) for f, (a, b) in ends.items() if a is not None and b > a}, got["classes"]


def _edge(low, high, i, bins: int):
    return low + (high - low) * i / bins


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """The number of inner edges of a range's equal parts that are under a value. Division
    finds it up to one, comparison with the edges settles it."""
    near = F.floor((value - low) * bins / (high - low))
    over = lambda i: value > _edge(low, high, i, bins)
    found = F.when(over(near + 1), near + 1).when(over(near), near).otherwise(near - 1)
    return F.greatest(F.lit(0), F.least(found, F.lit(bins - 1))).cast("int")


def _best(table: np.ndarray) -> tuple[float, int, int, int]:
    """Of weights by bin and class: the most weight that a cut after a bin leaves right, the
    bin, and the classes on both sides; the first of ties."""
    low = table.cumsum(0)[:-1]
    high = table.sum(0)[None, :] - low
    right = np.round(low.max(1) + high.max(1), 12)
    b = int(right.argmax())
    return float(right[b]), b, int(low[b].argmax()), int(high[b].argmax())


def boosted(rows: DataFrame, x: list[str], label: str, rounds: int = 10, bins: int = 64, cost: str | None = None) -> list[Stump]:
    """AdaBoost over stumps whose sides may decide for any class. ``label`` holds integers;
    the thresholds tried are the edges of ``bins`` equal parts of each feature's range.
    Rounds end at an error of 0 or of a half and more; of a first perfect stump the weight
    is 1. ``cost`` is a column of costs of a wrong decision, at most 1."""
    ranges, classes = _ranges(rows, x, label)
    chosen: list[Stump] = []
    if not ranges or len(classes) < 2:
        return chosen
    own = F.col(cost) if cost else F.lit(1.0)
    parts = [F.struct(F.lit(f).alias("feature"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f).cast("double").alias("v")) for f, (a, b) in ranges.items()]
    cut = _bin(F.col("_p.v"), F.col("_p.a"), F.col("_p.b"), bins).alias("bin")
    for _ in range(rounds):
        weight = own
        for s in chosen:
            weight = weight * own * F.exp(F.when(s.decided() == F.col(label), -s.alpha).otherwise(s.alpha))
        table = rows.select(F.col(label).alias("_y"), weight.alias("_w"), own.alias("_o"), F.explode(F.array(*parts)).alias("_p"))
        table = table.filter("_p.v is not null")
        got = table.groupBy(F.col("_p.feature").alias("feature"), cut, "_y").agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_o")).alias("c")).collect()
        best = None
        for f in sorted(ranges):
            t, c = np.zeros((bins, len(classes))), np.zeros((bins, len(classes)))
            for r in got:
                if r["feature"] == f:
                    at = r["bin"], classes.index(r["_y"])
                    t[at], c[at] = r["w"], r["c"]
            right, b, low, high = _best(t)
            if best is None or right / t.sum() > best[0] + 1e-12:
                hit = c[: b + 1, low].sum() + c[b + 1 :, high].sum()
                best = (right / t.sum(), f, _edge(*ranges[f], b + 1, bins), classes[low], classes[high], hit, c.sum() - hit)
        accuracy, f, threshold, low, high, hit, miss = best
        error = 1 - accuracy
        if error <= 1e-12:
            return chosen or [Stump(f, threshold, low, high, 1.0)]
        if error >= 0.5 or miss > hit:
            return chosen or [Stump(f, threshold, low, high, 0.5 * math.log(hit / miss))]
        chosen.append(Stump(f, threshold, low, high, 0.5 * math.log(hit / miss)))
    return chosen


def voted(stumps: list[Stump], classes: list[int]) -> Column:
    """The class with the largest sum of weights, the lowest of ties."""
    sums = []
    for c in sorted(classes):
        votes = [F.when(s.decided() == c, F.lit(s.alpha)).otherwise(F.lit(0.0)) for s in stumps]
        sums.append(F.struct(F.round(-sum(votes[1:], votes[0]), 9).alias("v"), F.lit(c).alias("c")))
    return F.array_min(F.array(*sums))["c"]


@dataclass(frozen=True)
class Node:
    """A two-class decision: rows with labels in ``yes`` go to ``then``, those in ``no`` to
    ``other``; a side is a further node or a label's name."""

    yes: tuple[str, ...]
    no: tuple[str, ...]
    then: "Node | str"
    other: "Node | str"
    stumps: tuple[Stump, ...] = ()


def grown(rows: DataFrame, x: list[str], label: str, node: "Node | str", rounds: int = 5, bins: int = 64) -> "Node | str":
    """The tree with each node trained on the rows whose label is on one of its sides. The
    rows are written once, as every round of every node reads them."""
    path = fresh_dir(rows.sparkSession, "tree")
    rows.select(*x, label).write.parquet(path)
    return _grown(rows.sparkSession.read.parquet(path), x, label, node, rounds, bins)


def _grown(rows: DataFrame, x: list[str], label: str, node: "Node | str", rounds: int, bins: int) -> "Node | str":
    if isinstance(node, str):
        return node
    asked = rows.filter(F.col(label).isin(*node.yes, *node.no)).withColumn("_side", F.col(label).isin(*node.yes).cast("int"))
    then, other = (_grown(rows, x, label, side, rounds, bins) for side in (node.then, node.other))
    return Node(node.yes, node.no, then, other, tuple(boosted(asked, x, "_side", rounds, bins)))


def classified(node: "Node | str") -> Column:
    """The label that a row reaches; a node without training takes its ``yes`` side."""
    if isinstance(node, str):
        return F.lit(node)
    if not node.stumps:
        return classified(node.then)
    return F.when(voted(list(node.stumps), [0, 1]) == 1, classified(node.then)).otherwise(classified(node.other))
