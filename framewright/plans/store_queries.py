"""Stores and tables: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import labels as L
from framewright.functions import phones
from framewright.plans.base import frames, query, rounded, table
from framewright.sources import stores
from framewright.workspace import fresh_dir

KEYS = ["file_id"]


@query(
    "selected_samples",
    """, s AS (SELECT file_id, fli * 4 + k AS sample FROM frames, range(4) t(k)), w AS (SELECT file_id, fli FROM frames WHERE mask & 1024 <> 0 AND mask & 4096 = 0)
    SELECT DISTINCT s.file_id, s.sample FROM s JOIN w ON s.file_id = w.file_id AND s.sample >= w.fli * 4 AND s.sample < w.fli * 4 + 6""",
)
def selected_samples(spark, sf):
    """Samples in frames of six samples at a step of four that are speech, but not voiced."""
    f = frames(spark, sf)
    samples = f.select("file_id", F.explode(F.sequence(F.col("fli") * 4, F.col("fli") * 4 + 3)).alias("sample"))
    return stores.selected_samples(samples, f, L.MASK["speech"], L.MASK["voiced"], 6, 4, KEYS)


@query(
    "frame_list",
    """, t AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'pureSpeech,speech' ELSE 'noisySpeech,speech,voiced' END AS mask, 'noise' AS truth,
      CAST(file_id % 5 AS BIGINT) AS true_speaker, CAST(-1 AS BIGINT) AS speaker FROM frames WHERE event_type IN ('click', 'signup')) SELECT * FROM t""",
)
def frame_list(spark, sf):
    f = frames(spark, sf).select("event_id", "mask", F.lit(L.MASK["noise"]).alias("truth"), (F.col("file_id") % 5).alias("true_speaker"), F.lit(-1).cast("long").alias("speaker"))
    return stores.frame_list(f, L.MASK["speech"])


@query("stored_frames", ", t AS (SELECT file_id, fli, CAST(mask AS BIGINT) AS mask FROM frames) SELECT * FROM t")
def stored_frames(spark, sf):
    path = fresh_dir(spark, "frames")
    stores.write_frames(frames(spark, sf).select("file_id", "fli", F.col("mask").cast("long").alias("mask")), path)
    return stores.read_frames(spark, path)


@query("stored_clusters", "SELECT vec_id, label % 3 AS cluster FROM embeddings")
def stored_clusters(spark, sf):
    path = fresh_dir(spark, "clusters")
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    for number in (2, 3):
        stores.write_clusters(e.select("vec_id", (F.col("label") % number).alias("cluster")), path, number)
    return stores.read_clusters(spark, path, 3).drop("partition")


@query(
    "stored_matrix",
    "SELECT vec_id AS row, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings",
)
def stored_matrix(spark, sf):
    """Written as text, read back, and transposed there and back."""
    path = fresh_dir(spark, "matrix")
    v = F.transform("embedding", lambda x: x.cast("double"))
    stores.write_matrix(table(spark, sf, "embeddings").select("vec_id", v.alias("v")), path, "vec_id", "v")
    m = stores.read_matrix(spark, path)
    return m.select("row", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(
    "transposed",
    """WITH t AS (SELECT s_suppkey, unnest([s_acctbal::DOUBLE, s_nationkey::DOUBLE]) AS v, unnest([0, 1]) AS row FROM supplier)
    SELECT CAST(row AS BIGINT) AS row, list(v ORDER BY s_suppkey) AS v FROM t GROUP BY row""",
)
def transposed(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.array(F.col("s_acctbal").cast("double"), F.col("s_nationkey").cast("double")).alias("v"))
    return stores.transposed(s, "s_suppkey", "v")


@query(
    "features_by_shot",
    """, t AS (SELECT file_id, fli // 20 AS shot, count(*) AS frames, round(avg(x), 6) AS mean_0, round(stddev_samp(x), 6) AS sd_0, round(avg(x / 2), 6) AS mean_1, round(stddev_samp(x / 2), 6) AS sd_1 FROM frames GROUP BY ALL) SELECT * FROM t""",
)
def features_by_shot(spark, sf):
    f = frames(spark, sf).withColumn("feat", F.array(F.col("x"), F.col("x") / 2))
    return rounded(stores.by_shot(f, F.floor(F.col("fli") / 20), KEYS, 2), "mean_0", "sd_0", "mean_1", "sd_1")


@query(
    "labels_by_frame",
    """, t AS (SELECT file_id, fli, CAST(mask & 1024 <> 0 AS INT) AS speech, CAST(mask & 131072 <> 0 AS INT) AS silence FROM frames) SELECT * FROM t""",
)
def labels_by_frame(spark, sf):
    return stores.by_frame(frames(spark, sf), ["speech", "silence"], KEYS)


@query(
    "virtual_axis",
    """SELECT n_nationkey, CAST(sum(length(n_name)) OVER (ORDER BY n_nationkey) - length(n_name) AS BIGINT) AS "start", CAST(sum(length(n_name)) OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS "end" FROM nation""",
)
def virtual_axis(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", F.length("n_name").cast("long").alias("n"))
    return stores.virtual_axis(n, "n_nationkey", "n").select("n_nationkey", "start", "end")


@query("phone_codes", "SELECT n_nationkey, n_nationkey % 60 AS code, true AS again FROM nation")
def phone_codes(spark, sf):
    """A phone's name has the code that it was looked up by."""
    rows = table(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") % 60).alias("code"))
    return rows.select("n_nationkey", "code", (phones.phone_code(phones.phone_name(F.col("code"))) == F.col("code")).alias("again"))
