"""Statistical models: training is aggregation, scoring an expression.

Mixtures are kept as small local parameter lists (components times dimensions); every pass
over the data is one DataFrame aggregation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mixture:
    """A mixture of Gaussians with diagonal covariances."""

    weights: tuple[float, ...]
    means: tuple[tuple[float, ...], ...]
    variances: tuple[tuple[float, ...], ...]

    @property
    def dim(self) -> int:
        return len(self.means[0])


def component_log(model: Mixture, k: int, x: Column) -> Column:
    """log(weight * density) of one component."""
    const = math.log(model.weights[k]) if model.weights[k] > 0 else -705.0
    const -= 0.5 * sum(math.log(2 * math.pi * v) for v in model.variances[k])
    mean = F.array(*[F.lit(float(v)) for v in model.means[k]])
    half = F.array(*[F.lit(0.5 / v) for v in model.variances[k]])
    terms = F.zip_with(F.zip_with(x, mean, lambda a, m: (a.cast("double") - m) * (a.cast("double") - m)), half, lambda d, h: d * h)
    return F.lit(const) - F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


def log_likelihood(model: Mixture, x: Column, top: int | None = None) -> Column:
    """Log of the mixture's density, of its ``top`` best components if asked."""
    logs = F.array(*[component_log(model, k, x) for k in range(len(model.weights))])
    if top is not None:
        logs = F.slice(F.reverse(F.array_sort(logs)), 1, top)
    most = F.array_max(logs)
    return most + F.ln(F.aggregate(F.transform(logs, lambda v: F.exp(v - most)), F.lit(0.0), lambda s, v: s + v))


def expectation(rows: DataFrame, x: str, model: Mixture) -> DataFrame:
    """One pass of EM statistics: per component n, sums and sums of squares, and the log
    likelihood: ``k, n, ll, sums, squares``."""
    comps = range(len(model.weights))
    parts = rows.select(F.col(x).alias("_x"), F.array(*[component_log(model, k, F.col(x)) for k in comps]).alias("_l"))
    most = F.array_max("_l")
    ll = most + F.ln(F.aggregate(F.transform("_l", lambda v: F.exp(v - most)), F.lit(0.0), lambda s, v: s + v))
    parts = parts.withColumn("_ll", ll)
    aggs = [F.sum("_ll").alias("ll"), F.count(F.lit(1)).alias("rows")]
    for k in comps:
        g = F.exp(F.get("_l", F.lit(k)) - F.col("_ll"))
        aggs.append(F.sum(g).alias(f"n{k}"))
        for d in range(model.dim):
            v = F.get("_x", F.lit(d)).cast("double")
            aggs += [F.sum(g * v).alias(f"s{k}_{d}"), F.sum(g * v * v).alias(f"q{k}_{d}")]
    one = parts.agg(*aggs)
    long = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                F.col(f"n{k}").alias("n"),
                F.col("rows"),
                F.col("ll"),
                F.array(*[F.col(f"s{k}_{d}") for d in range(model.dim)]).alias("sums"),
                F.array(*[F.col(f"q{k}_{d}") for d in range(model.dim)]).alias("squares"),
            )
            for k in comps
        ]
    )
    return one.select(F.explode(long).alias("_c")).select("_c.*")


def maximisation(stats: list, floor: float = 0.01, least_weight: float = 0.0) -> tuple[Mixture, float]:
    """A new mixture from collected statistics (one row a component), and the likelihood
    that the old one had."""
    weights, means, variances = [], [], []
    for r in sorted(stats, key=lambda r: r["k"]):
        if r["n"] <= 0 or r["n"] / r["rows"] < least_weight:
            continue
        mean = [s / r["n"] for s in r["sums"]]
        weights.append(r["n"] / r["rows"])
        means.append(tuple(mean))
        variances.append(tuple(max(floor, q / r["n"] - m * m) for q, m in zip(r["squares"], mean)))
    total = sum(weights)
    return Mixture(tuple(w / total for w in weights), tuple(means), tuple(variances)), stats[0]["ll"]


def fit_mixture(rows: DataFrame, x: str, start: Mixture, iterations: int = 150, stop: float = 100.0, floor: float = 0.01) -> tuple[Mixture, list[float]]:
    """EM until the likelihood changes by at most ``stop``; the model and its history."""
    model, history = start, []
    for _ in range(iterations):
        model, ll = maximisation(expectation(rows, x, model).collect(), floor)
        history.append(ll)
        if len(history) > 1 and abs(history[-1] - history[-2]) <= stop:
            break
    return model, history


def combine(a: Mixture, n_a: int, b: Mixture, n_b: int) -> Mixture:
    """The mixture of two, weighted by what they were trained on."""
    n = n_a + n_b
    weights = tuple(w * n_a / n for w in a.weights) + tuple(w * n_b / n for w in b.weights)
    return Mixture(weights, a.means + b.means, a.variances + b.variances)


def adapt_means(world: Mixture, stats: list, relevance: float = 16.0) -> Mixture:
    """MAP adaptation of a world model's means with n / (n + relevance)."""
    means = list(world.means)
    for r in stats:
        a = r["n"] / (r["n"] + relevance)
        if r["n"] > 0:
            means[r["k"]] = tuple(a * s / r["n"] + (1 - a) * m for s, m in zip(r["sums"], world.means[r["k"]]))
    return Mixture(world.weights, tuple(means), world.variances)


def ratio_score(model: Mixture, world: Mixture, x: Column, top: int = 5) -> Column:
    """Log-likelihood ratio of a model against the world, with the best components only."""
    return log_likelihood(model, x, top) - log_likelihood(world, x, top)


def kmeans_step(rows: DataFrame, x: str, means: list[list[float]]) -> DataFrame:
    """One Lloyd pass: ``k, n, error`` and the new ``mean`` of each cluster, the nearest by
    squared error and the first of ties."""
    from framewright.functions.vectors import squared_error

    best = F.array_min(
        F.array(*[F.struct(F.round(squared_error(F.col(x), F.array(*[F.lit(float(v)) for v in m])), 9).alias("d"), F.lit(k).alias("k")) for k, m in enumerate(means)])
    )
    dims = len(means[0])
    parts = rows.select(F.col(x).alias("_x"), best.alias("_b"))
    sums = [F.avg(F.get("_x", F.lit(d)).cast("double")).alias(f"m{d}") for d in range(dims)]
    one = parts.groupBy(F.col("_b.k").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("_b.d").alias("error"), *sums)
    return one.select("k", "n", "error", F.array(*[F.col(f"m{d}") for d in range(dims)]).alias("mean"))


def kmeans(rows: DataFrame, x: str, means: list[list[float]], iterations: int = 50) -> tuple[list[list[float]], float]:
    """Lloyd's iterations until the error stops falling; the means and the error."""
    last = math.inf
    for _ in range(iterations):
        got = {r["k"]: r for r in kmeans_step(rows, x, means).collect()}
        error = sum(r["error"] for r in got.values())
        if error >= last - 1e-9:
            break
        last, means = error, [got[k]["mean"] if k in got else means[k] for k in range(len(means))]
    return means, last


def gaussian(rows: DataFrame, x: str, keys: list[str], dims: int) -> DataFrame:
    """A Gaussian for each key in one pass: ``n``, ``mean`` and upper-triangle ``cov``."""
    at = lambda d: F.get(F.col(x), F.lit(d)).cast("double")
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    one = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(at(d)) for d in range(dims)]).alias("mean"),
        F.array(*[F.covar_samp(at(i), at(j)) for i, j in pairs]).alias("cov"),
    )
    return one


def best_split(rows: DataFrame, x: str, label: str, weight: str, bins: int = 1024) -> DataFrame:
    """Decision stump on one feature: prefix sums of class weights over the sorted distinct
    values, thresholds half way to the next value; the least error, then the lowest. Sums
    run inside bins of the feature's range, on top of those of the bins before, so that no
    task sorts all values."""
    one = rows.groupBy(F.col(x).alias("v")).agg(
        F.sum(F.when(F.col(label) > 0, F.col(weight)).otherwise(0.0)).alias("p"),
        F.sum(F.when(F.col(label) > 0, 0.0).otherwise(F.col(weight))).alias("q"),
    )
    span = F.broadcast(one.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))  # one row
    place = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (bins - 1))).otherwise(F.lit(0))
    placed = one.join(span).withColumn("b", place)
    up = Window.orderBy("b")  # at most a row a bin
    tops = placed.groupBy("b").agg(F.sum("p").alias("bp"), F.sum("q").alias("bq"), F.min("v").alias("first"))
    tops = tops.select(
        "b", (F.sum("bp").over(up) - F.col("bp")).alias("op"), (F.sum("bq").over(up) - F.col("bq")).alias("oq"), F.lead("first").over(up).alias("after")
    )
    w = Window.partitionBy("b").orderBy("v")
    low = placed.join(F.broadcast(tops), "b").select(
        "v",
        F.coalesce(F.lead("v").over(w), F.col("after")).alias("next"),
        (F.col("op") + F.sum("p").over(w)).alias("lp"),
        (F.col("oq") + F.sum("q").over(w)).alias("lq"),
    )
    total = one.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    cand = low.filter("next is not null").join(F.broadcast(total))
    cand = cand.select(
        ((F.col("v") + F.col("next")) / 2).alias("threshold"),
        F.least(F.col("lp") + F.col("tq") - F.col("lq"), F.col("lq") + F.col("tp") - F.col("lp")).alias("error"),
        (F.col("lp") + F.col("tq") - F.col("lq") <= F.col("lq") + F.col("tp") - F.col("lp")).alias("above"),
    )
    best = F.min(F.struct(F.round("error", 9).alias("error"), F.col("threshold"), F.col("above"))).alias("b")
    return cand.agg(best).select("b.threshold", "b.error", "b.above")


def adaboost(rows: DataFrame, x: list[str], label: str, rounds: int = 10) -> list[tuple[str, float, bool, float]]:
    """AdaBoost over stumps: (feature, threshold, above, alpha) of each round. Weights are an
    expression of the stumps so far, so no weight column is stored."""
    y = F.when(F.col(label) > 0, 1.0).otherwise(-1.0)
    chosen: list[tuple[str, float, bool, float]] = []
    n = rows.count()
    for _ in range(rounds):
        vote = strong(chosen) if chosen else F.lit(0.0)
        raw = rows.withColumn("_w", F.exp(-y * vote))
        norm = raw.agg(F.sum("_w")).first()[0] if n else 1.0
        weighted = raw.withColumn("_w", F.col("_w") / norm)
        fits = [(f, best_split(weighted, f, label, "_w").first()) for f in x]
        f, b = min(((f, b) for f, b in fits if b is not None and b["threshold"] is not None), key=lambda t: (t[1]["error"], t[0]))
        error = max(b["error"], 1e-12)
        if error >= 0.5:
            break
        chosen.append((f, b["threshold"], b["above"], 0.5 * math.log((1 - error) / error)))
        if b["error"] <= 0:
            break
    return chosen


def strong(stumps: list[tuple[str, float, bool, float]]) -> Column:
    """The boosted classifier's signed vote."""
    votes = [F.when((F.col(f) > t) == F.lit(above), F.lit(a)).otherwise(F.lit(-a)) for f, t, above, a in stumps]
    return sum(votes[1:], votes[0])
