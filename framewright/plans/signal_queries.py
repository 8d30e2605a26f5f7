"""Segmentation and further signal features; kernels have no SQL counterpart."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from framewright.functions import labels as L
from framewright.operators import kernels, learners, segmentation, signal_kernels, spectral
from framewright.operators import windows as W
from framewright.plans.base import frames, query, rounded, table

KEYS = ["file_id"]


def framed(spark, sf, size=32, step=16):
    return W.framed(frames(spark, sf).withColumn("x", F.col("x") - 50), "x", size, step, KEYS)


@query(
    "silence_thresholds",
    """, e AS (SELECT event_id, mask, x AS energy, x / 20 AS zcr FROM frames), h AS (SELECT *, energy < 37.442281::DOUBLE AND zcr < 1.710257::DOUBLE AS hit FROM e)
    SELECT event_id, CAST(CASE WHEN hit THEN 131072 ELSE mask & ~131072 END AS BIGINT) AS mask, round(least(CASE WHEN energy < 37.442281::DOUBLE THEN 1 - energy / 37.442281::DOUBLE ELSE 37.442281::DOUBLE / energy END,
      CASE WHEN zcr < 1.710257::DOUBLE THEN 1 - zcr / 1.710257::DOUBLE ELSE 1.710257::DOUBLE / zcr END) / 2 + CASE WHEN hit THEN 0.5 ELSE 0 END, 6) AS p_silence FROM h""",
)
def silence_thresholds(spark, sf):
    f = frames(spark, sf).select("event_id", "mask", F.col("x").alias("energy"), (F.col("x") / 20).alias("zcr"))
    out = segmentation.silence_by_thresholds(f, "energy", "zcr")
    return rounded(out.select("event_id", F.col("mask").cast("long").alias("mask"), "p_silence"), "p_silence")


@query("silence_otsu")
def silence_otsu(spark, sf):
    out = segmentation.silence_by_otsu(frames(spark, sf), "x", KEYS)
    return out.select("event_id", F.col("mask").cast("long").alias("mask"))


@query(
    "voicing",
    """, t AS (SELECT event_id, CAST(CASE WHEN mask & 1024 = 0 THEN mask WHEN x > 50 THEN (mask & ~8192) | 4096 ELSE (mask & ~4096) | 8192 END AS BIGINT) AS mask FROM frames) SELECT * FROM t""",
)
def voicing(spark, sf):
    out = segmentation.voicing(frames(spark, sf), F.when(F.col("x") > 50, F.col("x")).otherwise(F.lit(0.0)))
    return out.select("event_id", F.col("mask").cast("long").alias("mask"))


@query(
    "segment_models",
    """, k AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY fli) AS segment FROM frames)
    SELECT file_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, round(avg(x), 6) AS mean, round(var_samp(x), 6) AS variance, min(fli) AS "start", max(fli) AS "end",
      count(*) < 3 AS short FROM k WHERE mask & 1024 <> 0 GROUP BY file_id, segment""",
)
def segment_models(spark, sf):
    m = segmentation.segment_models(frames(spark, sf), F.col("event_type") == "signup", L.has_any(F.col("mask"), L.MASK["speech"]), "x", KEYS, "fli", 3)
    return rounded(m, "mean", "variance")


@query("change_points")
def change_points(spark, sf):
    f = frames(spark, sf).withColumn("v", F.array("x"))
    scores = spectral.change_scores(f, "v", KEYS, "fli", 16, 8)
    return segmentation.peaks_over_threshold(scores, "score", KEYS, "at")


def _kernel(name, f, size=32, step=16):
    def run(spark, sf):
        return spectral.extracted(framed(spark, sf, size, step), f)

    query(name)(run)


_kernel("wavelet", lambda x: np.array([np.concatenate(signal_kernels.wavelet(r, 4, 2)) for r in x]))
_kernel("cepstrum", signal_kernels.cepstrum)
_kernel("lpc_residual", lambda x: np.array([signal_kernels.residual(r, kernels.lpc(r, 4)[0]) for r in x]))
_kernel("formants", lambda x: np.array([signal_kernels.formants(kernels.lpc(r, 8)[0], 8000.0) for r in x]))
_kernel("band_pass", lambda x: np.array([signal_kernels.filtered(r, signal_kernels.band_pass(15, 0.1, 0.6)) for r in x]))
_kernel("resampled", lambda x: np.array([signal_kernels.resampled(r, 8000.0, 4000.0) for r in x]))
_kernel("dot_pattern", lambda x: np.array([signal_kernels.dot_pattern(r, 8).ravel() for r in x]))
_kernel("spectrum", kernels.spectrum)


@query("noise_frame_ratio")
def noise_frame_ratio(spark, sf):
    """The lag-1 correlation of a frame with the one before decides, by window functions."""
    from framewright.functions import vectors as V

    f = framed(spark, sf).withColumn("before", F.expr("lag(samples) over (partition by file_id order by frame)")).filter("before is not null")
    best = F.greatest(*[V.normalised_correlation(F.col("before"), F.col("samples"), k, 32) for k in range(1, 8)])
    return f.select("file_id", "frame", (best < 0.3).cast("int").alias("noise"))


@query("discriminants")
def discriminants(spark, sf):
    """Directions that separate the classes, from scatter sums that Spark makes."""
    d = 4
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(at(i)).alias(f"s{i}") for i in range(d)]]
    sums += [F.sum(at(i) * at(j)).alias(f"q{i}_{j}") for i in range(d) for j in range(d)]
    got = table(spark, sf, "embeddings").groupBy("label").agg(*sums).orderBy("label").collect()  # a row a class
    n = np.array([r["n"] for r in got], dtype=float)
    s = np.array([[r[f"s{i}"] for i in range(d)] for r in got])
    q = np.array([[[r[f"q{i}_{j}"] for j in range(d)] for i in range(d)] for r in got])
    mean = s / n[:, None]
    within = (q - n[:, None, None] * mean[:, :, None] * mean[:, None, :]).sum(0)
    off = mean - s.sum(0) / n.sum()
    value, vector = np.linalg.eig(np.linalg.pinv(within) @ (off.T * n) @ off)
    order = np.argsort(-np.real(value))
    rows = [(k, float(np.real(value[order[k]])), [float(v) for v in np.real(vector[:, order[k]])]) for k in range(d)]
    return spark.createDataFrame(rows, "direction int, value double, vector array<double>")


@query("models_by_class")
def models_by_class(spark, sf):
    """A codebook for each class, trained in parallel; a class is held by one task."""
    import pandas as pd

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        book = learners.codebook(np.stack(pdf["v"].to_numpy()), 2)
        return pd.DataFrame({"label": [int(pdf["label"].iloc[0])] * 2, "k": [0, 1], "mean": [list(map(float, b)) for b in book]})

    e = table(spark, sf, "embeddings").select("label", F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double")).alias("v"))
    return e.groupBy("label").applyInPandas(train, "label long, k int, mean array<double>")
