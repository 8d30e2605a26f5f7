"""Models, classifiers, clustering; iterative ones have no SQL counterpart."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from framewright.functions import vectors as V
from framewright.operators import clustering as C
from framewright.operators import joins as J
from framewright.operators import models as M
from framewright.operators import spectral
from framewright.operators import windows as W
from framewright.plans.base import frames, query, rounded, table

#: A fixed mixture over the first two dimensions.
TWO = M.Mixture((0.4, 0.6), ((-0.1, 0.1), (0.1, 0.0)), ((0.05, 0.04), (0.03, 0.02)))
WORLD = M.Mixture(tuple([1 / 6] * 6), tuple((-0.25 + 0.1 * k, 0.05 * k - 0.1) for k in range(6)), tuple([(0.03, 0.03)] * 6))


def points(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.slice("embedding", 1, 2).alias("v"))


POINTS = "p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings)"


def _component(m: M.Mixture, k: int) -> str:
    const = math.log(m.weights[k]) - 0.5 * sum(math.log(2 * math.pi * v) for v in m.variances[k])
    (ma, mb), (va, vb) = m.means[k], m.variances[k]
    return f"({const!r}::DOUBLE - (a - ({ma!r})::DOUBLE) ** 2 / (2 * {va!r}::DOUBLE) - (b - ({mb!r})::DOUBLE) ** 2 / (2 * {vb!r}::DOUBLE))"


def _mixture(m: M.Mixture) -> str:
    return "ln(" + " + ".join(f"exp({_component(m, k)})" for k in range(len(m.weights))) + ")"


@query("gauss_loglik", f"WITH {POINTS} SELECT vec_id, round({_component(TWO, 1)}, 6) AS ll FROM p")
def gauss_loglik(spark, sf):
    return rounded(points(spark, sf).select("vec_id", M.component_log(TWO, 1, F.col("v")).alias("ll")), "ll")


@query("gmm_score_fixed_params", f"WITH {POINTS} SELECT label, round(avg({_mixture(TWO)}), 6) AS score FROM p GROUP BY label")
def gmm_score_fixed_params(spark, sf):
    return rounded(points(spark, sf).groupBy("label").agg(F.avg(M.log_likelihood(TWO, F.col("v"))).alias("score")), "score")


@query(
    "gmm_em_one_step",
    f"""WITH {POINTS}, g AS (SELECT a, b, {_mixture(TWO)} AS ll, [{_component(TWO, 0)}, {_component(TWO, 1)}] AS l FROM p),
    r AS (SELECT k, exp(l[k + 1] - ll) AS g, ll, a, b FROM g, range(0, 2) t(k))
    SELECT k::INT AS k, round(sum(g), 6) AS n, round(sum(ll), 6) AS ll, round(sum(g * a), 6) AS s0, round(sum(g * b), 6) AS s1,
      round(sum(g * a * a), 6) AS q0, round(sum(g * b * b), 6) AS q1 FROM r GROUP BY k""",
)
def gmm_em_one_step(spark, sf):
    e = M.expectation(points(spark, sf), "v", TWO)
    at = [F.get(c, F.lit(d)).alias(f"{n}{d}") for c, n in (("sums", "s"), ("squares", "q")) for d in (0, 1)]
    return rounded(e.select("k", "n", "ll", *at), "n", "ll", "s0", "s1", "q0", "q1")


@query(
    "ubm_map_means",
    f"""WITH {POINTS}, g AS (SELECT a, b, {_mixture(TWO)} AS ll, [{_component(TWO, 0)}, {_component(TWO, 1)}] AS l FROM p WHERE label = 3),
    r AS (SELECT k, exp(l[k + 1] - ll) AS g, a, b FROM g, range(0, 2) t(k)), s AS (SELECT k, sum(g) AS n, sum(g * a) AS a, sum(g * b) AS b FROM r GROUP BY k)
    SELECT k::INT AS k, round(a / (n + 16) + 16 / (n + 16) * CASE k WHEN 0 THEN -0.1 ELSE 0.1 END, 6) AS m0,
      round(b / (n + 16) + 16 / (n + 16) * CASE k WHEN 0 THEN 0.1 ELSE 0.0 END, 6) AS m1 FROM s""",
)
def ubm_map_means(spark, sf):
    stats = M.expectation(points(spark, sf).filter("label = 3"), "v", TWO).collect()  # a row a component
    adapted = M.adapt_means(TWO, stats)
    rows = [(k, float(m[0]), float(m[1])) for k, m in enumerate(adapted.means)]
    return rounded(spark.createDataFrame(rows, "k int, m0 double, m1 double"), "m0", "m1")


@query(
    "ubm_top5_llr",
    f"""WITH {POINTS}, l AS (SELECT vec_id, {_mixture(TWO)} AS m, list_reverse_sort([{', '.join(f'exp({_component(WORLD, k)})' for k in range(6))}]) AS w FROM p)
    SELECT vec_id, round(m - ln(list_sum(w[1:5])), 6) AS llr FROM l""",
)
def ubm_top5_llr(spark, sf):
    return rounded(points(spark, sf).select("vec_id", M.ratio_score(TWO, WORLD, F.col("v")).alias("llr")), "llr")


STUMP = """WITH d AS (SELECT l_discount::DOUBLE AS v, sum(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END) AS p, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1.0::DOUBLE END) AS q FROM lineitem GROUP BY 1),
    c AS (SELECT v, lead(v) OVER (ORDER BY v) AS nx, sum(p) OVER (ORDER BY v) AS lp, sum(q) OVER (ORDER BY v) AS lq, sum(p) OVER () AS tp, sum(q) OVER () AS tq FROM d),
    e AS (SELECT (v + nx) / 2 AS threshold, least(lp + tq - lq, lq + tp - lp) AS error, lp + tq - lq <= lq + tp - lp AS above FROM c WHERE nx IS NOT NULL)
    SELECT round(threshold, 6) AS threshold, round(error, 6) AS error, above FROM e ORDER BY error, threshold LIMIT 1"""


@query("stump_best_split", STUMP)
def stump_best_split(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_discount").cast("double").alias("x"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.lit(1.0).alias("w"))
    return rounded(M.best_split(rows, "x", "y", "w"), "threshold", "error")


@query("adaboost_rounds")
def adaboost_rounds(spark, sf):
    """Boosted stumps over three features, and the training error of their vote."""
    rows = points(spark, sf).select((F.col("label") < 5).cast("int").alias("y"), *[F.get("v", F.lit(d)).cast("double").alias(f"x{d}") for d in (0, 1)])
    stumps = M.adaboost(rows, ["x0", "x1"], "y", rounds=4)
    wrong = (M.strong(stumps) > 0) != (F.col("y") > 0)
    return rows.agg(F.lit(len(stumps)).alias("rounds"), F.avg(wrong.cast("double")).alias("error"))


@query(
    "pareto_density",
    f"""WITH {POINTS}, q AS (SELECT * FROM p WHERE vec_id % 50 = 0)
    SELECT q.vec_id AS query, round(count(*) / (SELECT count(*) FROM p), 6) AS density FROM q JOIN p ON (p.a - q.a) ** 2 + (p.b - q.b) ** 2 <= 0.01 GROUP BY q.vec_id""",
)
def pareto_density(spark, sf):
    from framewright.operators.stats import pareto_density as density

    p = points(spark, sf)
    return rounded(density(p, "v", "vec_id", 0.1, p.filter("vec_id % 50 = 0")), "density")


MEANS = [[-0.2, 0.0], [0.0, 0.15], [0.2, -0.1]]
NEAREST = f"""WITH {POINTS}, d AS (SELECT *, [round((a + 0.2) ** 2 + b ** 2, 9), round(a ** 2 + (b - 0.15) ** 2, 9), round((a - 0.2) ** 2 + (b + 0.1) ** 2, 9)] AS e FROM p),
    n AS (SELECT *, list_min(e) AS m, list_position(e, list_min(e)) - 1 AS k FROM d)"""


@query("kmeans_one_iteration", NEAREST + " SELECT k::INT AS k, count(*) AS n, round(sum(m), 6) AS error, round(avg(a), 6) AS m0, round(avg(b), 6) AS m1 FROM n GROUP BY k")
def kmeans_one_iteration(spark, sf):
    s = M.kmeans_step(points(spark, sf), "v", MEANS)
    return rounded(s.select("k", "n", "error", *[F.get("mean", F.lit(d)).alias(f"m{d}") for d in (0, 1)]), "error", "m0", "m1")


@query("kmeans_assign", NEAREST + " SELECT vec_id, k::INT AS k FROM n")
def kmeans_assign(spark, sf):
    templates = spark.createDataFrame([(k, m) for k, m in enumerate(MEANS)], "k int, v array<double>")
    return J.nearest(points(spark, sf), templates, "v", "k", "near").select("vec_id", F.col("near").alias("k"))


@query("kmeans_full")
def kmeans_full(spark, sf):
    means, error = M.kmeans(points(spark, sf), "v", MEANS)
    return spark.createDataFrame([(k, float(m[0]), float(m[1]), float(error)) for k, m in enumerate(means)], "k int, m0 double, m1 double, error double")


@query("gmm_em_full")
def gmm_em_full(spark, sf):
    model, history = M.fit_mixture(points(spark, sf), "v", TWO, iterations=8, stop=0.01, floor=0.001)
    rows = [(k, float(w), float(m[0]), float(m[1]), len(history)) for k, (w, m) in enumerate(zip(model.weights, model.means))]
    return spark.createDataFrame(rows, "k int, weight double, m0 double, m1 double, iterations int")


LINK = f"""WITH {POINTS}, d AS (SELECT x.label AS lx, y.label AS ly, sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2) AS d FROM p x JOIN p y
      ON x.vec_id % 50 = 0 AND (x.vec_id < y.vec_id OR x.vec_id > y.vec_id AND y.vec_id % 50 <> 0)),
    o AS (SELECT least(lx, ly) AS x, greatest(lx, ly) AS y, d FROM d WHERE lx <> ly)"""


@query("linkage", LINK + ' SELECT x, y, round(min(d), 6) AS single, round(max(d), 6) AS complete, round(avg(d), 6) AS average FROM o GROUP BY x, y')
def linkage(spark, sf):
    """From the distances of every 50th vector from all vectors."""
    p = points(spark, sf)
    return rounded(C.linkage(J.distances_from(p.filter("vec_id % 50 = 0"), p, "vec_id", "v"), p, "vec_id", "label"), "single", "complete", "average")


@query(
    "identify_argmax",
    f"""WITH {POINTS}, m AS (SELECT label AS model, avg(a) AS ma, avg(b) AS mb FROM p GROUP BY ALL),
    s AS (SELECT p.vec_id, model, round((a - ma) ** 2 + (b - mb) ** 2, 9) AS d FROM p, m), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, model) AS k FROM s)
    SELECT vec_id, CASE WHEN d <= 0.02 THEN model ELSE -1 END AS speaker FROM r WHERE k = 1""",
)
def identify_argmax(spark, sf):
    """Closed-set identification by class means; too far from all is a new speaker."""
    p = points(spark, sf)
    m = p.groupBy("label").agg(F.array(*[F.avg(F.get("v", F.lit(d)).cast("double")) for d in (0, 1)]).alias("v"))
    near = J.nearest(p, m.withColumnRenamed("label", "model"), "v", "model", "speaker")
    return near.select("vec_id", F.when(F.col("error") <= 0.02, F.col("speaker")).otherwise(F.lit(-1)).alias("speaker"))


@query(
    "within_cluster_dispersion",
    f"WITH {POINTS} SELECT label, count(*) AS n, round(count(*) * (var_pop(a) + var_pop(b)), 6) AS dispersion FROM p GROUP BY label",
)
def within_cluster_dispersion(spark, sf):
    return rounded(C.dispersion(points(spark, sf), "v", "label"), "dispersion")


@query("agglomerative_clusters")
def agglomerative_clusters(spark, sf):
    return C.cluster_models(spark, points(spark, sf), "vec_id", "v", clusters=3)


@query(
    "gaussian_by_class",
    f"""WITH {POINTS} SELECT label, count(*) AS n, round(avg(a), 6) AS m0, round(avg(b), 6) AS m1, round(covar_samp(a, a), 6) AS c00,
      round(covar_samp(a, b), 6) AS c01, round(covar_samp(b, b), 6) AS c11 FROM p GROUP BY label""",
)
def gaussian_by_class(spark, sf):
    g = M.gaussian(points(spark, sf), "v", ["label"], 2)
    cols = [F.get("mean", F.lit(d)).alias(f"m{d}") for d in (0, 1)] + [F.get("cov", F.lit(k)).alias(c) for k, c in enumerate(("c00", "c01", "c11"))]
    return rounded(g.select("label", "n", *cols), "m0", "m1", "c00", "c01", "c11")


def _framed(spark, sf, size=32, step=16):
    return W.framed(frames(spark, sf).withColumn("x", F.col("x") - 50), "x", size, step, ["file_id"])


@query("mfcc")
def mfcc(spark, sf):
    return spectral.mfcc(_framed(spark, sf), 8000.0, filters=8, coefficients=4)


@query("lpc")
def lpc(spark, sf):
    return spectral.lpc(_framed(spark, sf), 4)


@query("lpc_cepstrum")
def lpc_cepstrum(spark, sf):
    return spectral.lpc_cepstrum(_framed(spark, sf), 4, 6)


@query("line_spectrum")
def line_spectrum(spark, sf):
    return spectral.line_spectrum(_framed(spark, sf), 4)


@query("pitch")
def pitch(spark, sf):
    return spectral.pitch(_framed(spark, sf), 1000.0, low=60.0, high=400.0)


@query("dtw")
def dtw(spark, sf):
    p = table(spark, sf, "embeddings").select((F.col("vec_id") % 20).alias("key"), F.col("vec_id").alias("at"), F.slice("embedding", 1, 4).alias("v"))
    return spectral.sequence_scores(p.filter("at % 40 < 20"), p.filter("at % 40 >= 20"), "key", "at", "v")


@query("change_scores")
def change_scores(spark, sf):
    f = frames(spark, sf).withColumn("v", F.array("x"))
    return spectral.change_scores(f, "v", ["file_id"], "fli", 16, 8)


@query("trajectories", """WITH f AS (SELECT user_id AS file_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS fli FROM events),
    t AS (SELECT file_id, fli, list(x) OVER (PARTITION BY file_id ORDER BY fli ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS t FROM f)
    SELECT file_id, fli, round(t[1] + 2 * t[2] + 3 * t[3], 6) AS s FROM t WHERE len(t) = 3""")
def trajectories(spark, sf):
    t = W.context(frames(spark, sf), "x", 3, ["file_id"])
    s = V.dot(F.col("trajectory"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return rounded(t.select("file_id", "fli", s.alias("s")), "s")
