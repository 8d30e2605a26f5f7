"""Boosting of several classes and classifier trees against a plain version in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import boosting as B


def plain(x, y, rounds, bins):
    """The same rounds over arrays, each cut and pair of classes tried in turn."""
    n, classes = len(y), sorted(set(y.tolist()))
    w, out = np.full(n, 1 / n), []
    for _ in range(rounds):
        best = None
        for d in range(x.shape[1]):
            lo, hi = x[:, d].min(), x[:, d].max()
            for i in range(1, bins):
                t = lo + (hi - lo) * i / bins
                over = x[:, d] > t
                for a in classes:
                    for b in classes:
                        right = w[np.where(over, y == b, y == a)].sum()
                        if best is None or right > best[0] + 1e-9:
                            best = (right, d, t, a, b)
        right, d, t, a, b = best
        ok = np.where(x[:, d] > t, y == b, y == a)
        if 1 - right <= 1e-12:
            return out or [(d, t, a, b, 1.0)]
        if 1 - right >= 0.5:
            return out or [(d, t, a, b, 0.5 * np.log(right / (1 - right)))]
        alpha = 0.5 * np.log(right / (1 - right))
        out.append((d, t, a, b, alpha))
        w = w * np.where(ok, np.exp(-alpha), np.exp(alpha))
        w /= w.sum()
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_several_classes(spark, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, 120)
    x = np.stack([np.where(y == 0, -1.0, 1.0) + rng.normal(0, 0.8, 120), (y == 2) * 2.0 + rng.normal(0, 0.7, 120)], 1)
    df = spark.createDataFrame([(int(c), float(a), float(b)) for c, (a, b) in zip(y, x)], "y int, x0 double, x1 double")
    got, want = B.boosted(df, ["x0", "x1"], "y", 4, 8), plain(x, y, 4, 8)
    assert [(s.feature, round(s.threshold, 9), s.below, s.above, round(s.alpha, 9)) for s in got] == [
        (f"x{d}", round(t, 9), a, b, round(w, 9)) for d, t, a, b, w in want
    ]
    votes = np.array([[sum(w for d, t, a, b, w in want if (b if r[d] > t else a) == c) for c in range(3)] for r in x])
    rows = df.select("x0", "x1", B.voted(got, [0, 1, 2]).alias("v")).collect()
    assert [r["v"] for r in rows] == np.round(votes, 9).argmax(1).tolist()


def test_perfect_and_empty(spark):
    df = spark.createDataFrame([(int(i > 4), float(i)) for i in range(10)], "y int, x double")
    one = B.boosted(df, ["x"], "y", 3, 9)
    assert len(one) == 1 and one[0].alpha == 1.0 and (one[0].below, one[0].above) == (0, 1)
    assert B.boosted(df.limit(0), ["x"], "y") == []
    assert B.boosted(df.withColumn("y", F.lit(1)), ["x"], "y") == []
    assert B.boosted(df.withColumn("x", F.lit(2.0)), ["x"], "y") == []


def test_tree(spark):
    kinds = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(kinds[k % 4], k % 4 * 10.0 + k % 3) for k in range(80)], "l string, x double")
    tree = B.Node(("a", "b"), ("c", "d"), B.Node(("a",), ("b",), "a", "b"), B.Node(("c",), ("d",), "c", "d"))
    out = df.select("l", B.classified(B.grown(df, ["x"], "l", tree)).alias("t"))
    assert out.filter("l <> t").count() == 0
    assert B.classified(tree) is not None
