"""Walks and ranks where batches, files, nulls and ties meet."""

import numpy as np
from pyspark.sql import functions as F

from framewright.operators import joins as J
from framewright.operators import runs as R
from framewright.operators import stats as T


def walked(speech, length, pause):
    out, at = [0] if len(speech) else [], length
    while at < len(speech):
        if speech[at]:
            end = at
            while end < len(speech) and speech[end]:
                end += 1
            later = [k for k in range(end, len(speech)) if speech[k]]
            at = end + (max((later[0] - end) // 2, pause) if later else 0)
        if at < len(speech):
            out.append(at)
            at += length
    return out


def test_pseudo_scenes_over_batches(spark):
    rng = np.random.default_rng(5)
    files = {k: (rng.random(n) < 0.6).tolist() for k, n in enumerate([0, 1, 4, 5, 23, 40, 40, 61])}
    files[None] = [True, False, True, True, False, False, True]
    rows = [(k, i, s) for k, v in files.items() for i, s in enumerate(v)]
    df = spark.createDataFrame(rows, "f int, fli long, s boolean").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted((str(r["f"]), r["scene"], r["boundary"]) for r in R.pseudo_scenes(df, F.col("s"), 4, ["f"], pause=2).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == sorted((str(k), n, b) for k, v in files.items() for n, b in enumerate(walked(v, 4, 2)))


def test_ranks_of_any_values(spark):
    values = [0.0, -3.5, -3.5, 1e-300, 7.0, 7.0, 7.0, -1e300, float("inf"), None, 2.0, float("-inf")]
    df = spark.createDataFrame([(k, v) for k in (1, None) for v in values], "k int, x double")
    real = sorted(v for v in values if v is not None)
    got = {(r["k"], r["p"]): r["value"] for r in T.percentiles(df, "x", {p: T.nearest_rank(p) for p in (0, 25, 50, 100)}, ["k"]).collect()}
    want = {p: real[max(1, int(len(real) * p / 100 + 0.5)) - 1] for p in (0, 25, 50, 100)}
    assert got == {(k, p): v for k in (1, None) for p, v in want.items()}
    joined = {(r["k"], r["p"]): r["value"] for r in T.percentiles(df, "x", {50: T.nearest_rank(50)}, ["k"], most=0).collect()}
    assert joined == {(k, 50): want[50] for k in (1, None)}
    assert T.percentile(df.limit(0), "x", 50, ["k"]).count() == 0


def test_ids_and_distances(spark):
    df = spark.createDataFrame([("b", 5), ("a", 3), ("c", -2), ("a", 9), ("d", 0)], "n string, o long")
    assert {r["n"]: r["id"] for r in J.ids_of(df, "n", F.col("o")).collect()} == {"c": 0, "d": 1, "a": 2, "b": 3}
    v = spark.createDataFrame([(k, [float(k * k)]) for k in range(7)], "k int, v array<double>")
    got = sorted((r["a"], r["b"], r["d"]) for r in J.distances_from(v.filter("k % 3 = 0"), v, "k", "v", most=2).collect())
    want = [(a, b, float(abs(a * a - b * b))) for a in (0, 3, 6) for b in range(7) if a < b or a > b and b % 3]
    assert got == sorted(want)


def test_means_in_any_order(spark):
    """Means of decimals as written, so none of their own values is above them by a rounding error."""
    files = {0: [0.1] * 10, 1: [1.1, 2.2, 3.3] * 20, 2: [1e-30, 2e-30, 3e-30], 3: [3e200, 1e200, 2e200], 4: [0.0] * 3, 5: [52.915, 52.935] * 30, 6: [-7e-310] * 7}
    df = spark.createDataFrame([(k, x) for k, v in files.items() for x in v], "f int, x double")
    for rows in (df.repartition(1), df.repartition(7), df.orderBy(F.desc("x"))):
        got = {r["f"]: (r["n"], r["mean"]) for r in T.histogram(rows, "x", 1, ["f"]).collect()}
        want = {0: 0.1, 1: 2.2, 2: 2e-30, 3: 2e200, 4: 0.0, 5: 52.925, 6: -7e-310}
        assert {k: m for k, (_, m) in got.items() if k not in (2, 3)} == {k: m for k, m in want.items() if k not in (2, 3)}
        assert all(abs(got[k][1] / want[k] - 1) < 1e-15 for k in (2, 3)) and {k: n for k, (n, _) in got.items()} == {k: len(v) for k, v in files.items()}
