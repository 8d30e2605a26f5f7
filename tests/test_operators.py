import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import joins as J
from framewright.operators import kernels as K
from framewright.operators import models as M
from framewright.operators import registry
from framewright.operators import runs as R
from framewright.operators import scores as S
from framewright.operators import stats as T
from framewright.operators import windows as W


def frames(spark, values, file=1):
    return spark.createDataFrame([(file, i, v) for i, v in enumerate(values)], "f int, fli long, v string")


def test_runs_part_the_axis(spark):
    rows = sorted(tuple(r) for r in R.runs(frames(spark, "aabca"), F.col("v"), ["f"]).collect())
    assert [(s, e) for _, _, s, e, _ in rows] == [(0, 1), (2, 2), (3, 3), (4, 4)]
    assert R.runs(frames(spark, "").limit(0), F.col("v"), ["f"]).count() == 0


def test_short_gap(spark):
    df = frames(spark, "sgsggs").withColumn("mask", F.when(F.col("v") == "s", 1024).otherwise(131072))
    out = R.relabel_short_gaps(df, F.col("v") == "g", F.col("v") == "s", 2, F.lit(9), ["f"]).orderBy("fli")
    assert [r["mask"] for r in out.collect()] == [1024, 9, 1024, 131072, 131072, 1024]


def test_segments_and_split(spark):
    s = R.segments(frames(spark, "xbxbx"), F.col("v") == "b", ["f"]).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in s] == [(1, 2), (3, 4)]
    p = R.split_long(spark.createDataFrame([(1, 0, 6)], "f int, start long, end long"), 3).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in p] == [(0, 2), (3, 5), (6, 6)]


@pytest.mark.parametrize("n", [1, 2, 5, 6])
def test_percentile_is_nearest_rank(spark, n):
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("x"))
    got = T.percentile(df, "x", 50, ["k"]).first()["value"]
    assert got == max(1, int(n * 0.5 + 0.5)) - 1


def test_interval_join_is_complete(spark):
    rng = np.random.default_rng(0)
    make = lambda: [(int(k), int(s), int(s + n)) for k, s, n in zip(rng.integers(0, 2, 30), rng.integers(0, 100, 30), rng.integers(0, 40, 30))]
    a, b = make(), make()
    df = lambda x: spark.createDataFrame(x, "k int, start long, end long")
    got = sorted((r["k"], r["start"], r["end"], r["b_start"], r["b_end"], r["overlap"]) for r in J.interval_join(df(a), df(b), ["k"], 16).collect())
    want = sorted((k, s, e, t, u, min(e, u) - max(s, t) + 1) for k, s, e in a for j, t, u in b if k == j and s <= u and t <= e)
    assert got == want


def test_empty_denominators(spark):
    zero = spark.createDataFrame([(0, 0, 0, 0)], "tp long, fp long, fn long, tn long")
    r = S.detection(zero).first()
    assert (r["recall"], r["precision"], r["miss_rate"], r["accuracy"]) == (1, 1, 0, 1)


def test_em_never_loses_likelihood(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(-1, 0.3, (60, 2)), rng.normal(1, 0.5, (40, 2))])
    df = spark.createDataFrame([([float(a), float(b)],) for a, b in x], "v array<double>")
    start = M.Mixture((0.5, 0.5), ((-0.5, 0.0), (0.5, 0.0)), ((1.0, 1.0), (1.0, 1.0)))
    model, history = M.fit_mixture(df, "v", start, iterations=6, stop=0.0, floor=1e-6)
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:]))
    assert sorted(round(m[0]) for m in model.means) == [-1, 1]


def test_stump_and_boosting(spark):
    df = spark.createDataFrame([(float(i), int(i >= 6), 0.1) for i in range(10)], "x double, y int, w double")
    b = M.best_split(df, "x", "y", "w").first()
    assert b["threshold"] == 5.5 and b["above"] and abs(b["error"]) < 1e-9
    assert len(M.adaboost(df, ["x"], "y")) == 1


def test_framing_covers_whole_frames(spark):
    df = spark.range(20).select(F.lit(1).alias("f"), F.col("id").alias("fli"), F.col("id").cast("double").alias("x"))
    got = {r["frame"]: r["samples"] for r in W.framed(df, "x", 8, 4, ["f"]).collect()}
    assert got == {k: [float(v) for v in range(4 * k, 4 * k + 8)] for k in range(4)}
    assert W.framed(df.limit(0), "x", 8, 4, ["f"]).count() == 0


def test_kernels():
    rng = np.random.default_rng(2)
    x = rng.normal(size=64)
    a, g = K.lpc(x, 4)
    r = np.array([x[: 64 - k] @ x[k:] for k in range(5)])
    want = np.linalg.solve([[r[abs(i - j)] for j in range(4)] for i in range(4)], -r[1:])
    assert np.allclose(a[1:], want) and g > 0
    assert len(K.line_spectrum(a)) == 4
    t = np.arange(400) / 8000
    assert abs(K.pitch(np.sin(2 * np.pi * 200 * t), 8000.0) - 200) < 1
    assert K.dtw(np.ones((5, 2)), np.ones((6, 2))) == 0
    d = np.abs(np.subtract.outer(np.arange(3), np.arange(3))).astype(float)
    assert K.emd(np.array([1.0, 0, 0]), np.array([0, 0, 1.0]), d) == 2
    assert K.emd(np.array([0.5, 0.5, 0]), np.array([0, 0.5, 0.5]), d) == 1
    assert K.delta_bic(rng.normal(0, 1, (80, 2)), rng.normal(5, 1, (80, 2))) > 0
    assert K.delta_bic(rng.normal(0, 1, (80, 2)), rng.normal(0, 1, (80, 2))) < 0
    assert K.mfcc(rng.normal(size=(3, 128)), 8000.0, 20, 12).shape == (3, 12)


def test_hmm_by_enumeration():
    rng = np.random.default_rng(3)
    start, move, emit = (np.log(rng.dirichlet(np.ones(2))), np.log(rng.dirichlet(np.ones(2), 2)), np.log(rng.random((4, 2))))
    scores = {p: start[p[0]] + emit[0, p[0]] + sum(move[p[i - 1], p[i]] + emit[i, p[i]] for i in range(1, 4)) for p in itertools.product(range(2), repeat=4)}
    path, best = K.viterbi(start, move, emit)
    assert tuple(path) == max(scores, key=scores.get) and np.isclose(best, max(scores.values()))
    assert np.isclose(K.forward(start, move, emit), np.logaddexp.reduce(list(scores.values())))


def test_agglomeration():
    x = np.array([0.0, 1.0, 10.0, 11.5])
    d = np.abs(np.subtract.outer(x, x))
    assert [m[:2] for m in K.agglomerate(d, "single")] == [(0, 1), (2, 3), (0, 2)]
    assert [m[:2] for m in K.agglomerate(d, "single", stop=2.0)] == [(0, 1), (2, 3)]


def test_registry():
    registry.plugin("test", "one")(lambda: 1)
    assert registry.build("test", "one") == 1 and registry.names("test") == ["one"]
    with pytest.raises(KeyError):
        registry.build("test", "two")


def test_clusters_hold_every_vector(spark, sf_dir):
    from framewright.plans import catalog

    rows = catalog.QUERIES["agglomerative_clusters"](spark, sf_dir).collect()
    ids = {r["vec_id"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()}
    assert {r["vec_id"] for r in rows} == ids and len(rows) == len(ids)
    assert len({r["cluster"] for r in rows}) == 3 and {r["cluster"] for r in rows} <= ids


def test_clusters_without_a_matrix(spark):
    """The merges of the closest pairs one by one, equal vectors too, in less memory than half a matrix."""
    import tracemalloc

    from framewright.operators import clustering as C

    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 2))
    v[rng.integers(0, 400, 90)] = v[7]
    m = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    df = spark.createDataFrame([(3 * k, x) for k, x in enumerate(v.tolist())] + [(5000, None)], "k long, v array<double>")
    for rule, stop, count in (("single", np.inf, 9), ("complete", np.inf, 3), ("average", np.inf, 380), ("average", 0.8, 1)):
        name = list(range(400))
        for i, j, _ in K.agglomerate(m, rule, stop, count):
            name = [i if x == j else x for x in name]
        got = {r["k"]: r["cluster"] for r in C.cluster_models(spark, df, "k", "v", rule, stop, count).collect()}
        assert got == {3 * k: 3 * n for k, n in enumerate(name)} | {5000: 5000}
    first, _, weight = C._distinct(v)
    assert C._merges(spark, v[first], weight, "average", local=10_000) == C._merges(spark, v[first], weight, "average")
    assert C.cluster_models(spark, df.limit(0), "k", "v").count() == 0
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rng.normal(size=(3000, 2)).tolist())], "k long, v array<double>")
    tracemalloc.start()
    out = C.cluster_models(spark, df, "k", "v", clusters=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.count() == 3000 and peak < 4 * 3000**2


def test_adaptive_threshold_by_hand(spark):
    """alpha / N times the last N = min(most, index) distances; 0 for the first."""
    from framewright.operators import windows

    df = spark.createDataFrame([(1, k, float(10**k)) for k in range(6)], "f int, fli int, d double")
    got = [r["t"] for r in df.select("fli", windows.adaptive_threshold("d", ["f"], alpha=2.0, most=3).alias("t")).orderBy("fli").collect()]
    assert got == pytest.approx([0, 20, 110, 2 * 1110 / 3, 2 * 11100 / 3, 2 * 111000 / 3])


def test_classes_without_rows_count_as_nothing(spark):
    """Three classes of which one has no hypothesis and one no truth."""
    from framewright.operators import scores

    m = spark.createDataFrame([("a", "a", 6), ("a", "b", 2), ("c", "a", 2)], "hyp string, gt string, n long")
    r = scores.classification(m).first()
    # omission: a 2/8, b 2/2, c 0; commission: a 2/8, b 0, c 2/2
    assert (r["omission"], r["commission"]) == pytest.approx((1.25 / 3, 1.25 / 3)) and r["misclassification"] == pytest.approx(0.4)


def test_concordance_of_ties(spark):
    """Pairs (1,2), (1,3), (2,3): less in a: no, yes, yes; in b: no, yes, no (a tie)."""
    from framewright.operators import scores

    rows = lambda s: spark.createDataFrame([(1, k + 1, v) for k, v in enumerate(s)], "f int, i int, s double")
    got = scores.concordance(rows([2.0, 1.0, 3.0]), rows([1.0, 1.0, 1.5]), "f", "i", "s").first()[0]
    assert got == pytest.approx(1.0)
    got = scores.concordance(rows([2.0, 1.0, 3.0]), rows([1.0, 0.5, 0.5]), "f", "i", "s").first()[0]
    assert got == pytest.approx(1 / 3)


def test_silence_margins_by_hand(spark):
    from framewright.functions import labels as L
    from framewright.operators import segmentation

    both = L.MASK["silence"]
    df = spark.createDataFrame([(0, 0, 0.0, 0.0), (1, both, 2.0, 8.0), (2, 0, 20.0, 8.0), (3, 0, 0.0, 8.0), (4, 0, 8.0, 1.0)], "k int, mask long, e double, z double")
    got = [(r["p_silence"], r["mask"] & both != 0) for r in segmentation.silence_by_thresholds(df, "e", "z", 10.0, 4.0).orderBy("k").collect()]
    # 1: min(1 - 2/10, 4/8) / 2; 2: min(10/20, 4/8) / 2; 3: min(1, 4/8) / 2; 4: min(1 - 8/10, 1 - 1/4) / 2 + 1/2
    assert [p for p, _ in got] == pytest.approx([1.0, 0.25, 0.25, 0.25, 0.6])
    assert [s for _, s in got] == [True, False, False, False, True]


def test_stated_sets_in_blocks(spark):
    """Beyond one block the results are the same."""
    from framewright.operators import joins, stats

    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=3)]) for k in range(60)], "k long, v array<double>")
    near = lambda most: joins.nearest(df, df.filter("k % 3 = 0").select(F.col("k"), "v"), "v", "k", "owner", most).select("k", "owner").orderBy("k").collect()
    assert near(4096) == near(4)
    pairs = lambda most: sorted(map(tuple, joins.pairwise(df, "k", "v", most).collect()))
    assert pairs(5000) == pairs(9) and len(pairs(9)) == 60 * 59 // 2
    dense = lambda block: sorted(map(tuple, stats.pareto_density(df, "v", "k", 1.0, df.filter("k % 2 = 0"), block).collect()))
    assert dense(4096) == dense(7) and len(dense(7)) == 30
