"""Label updates, phones, order statistics and merge histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.functions import labels as L
from framewright.functions import phones
from framewright.operators import scores as S
from framewright.operators import segmentation
from framewright.operators import stats as T
from framewright.operators import updates as U
from framewright.plans.base import frames, query, rounded, table

KEYS = ["file_id"]


@query(
    "label_update_where",
    """, t AS (SELECT event_id, mask & 1024 <> 0 AND x > 60 AS updated, mask FROM frames)
    SELECT event_id, updated, CAST(CASE WHEN updated THEN mask | 16384 ELSE mask END AS BIGINT) AS mask FROM t""",
)
def label_update_where(spark, sf):
    hit = L.has_any(F.col("mask"), L.MASK["speech"]) & (F.col("x") > 60)
    out = U.set_where(frames(spark, sf), hit, L.add(F.col("mask"), L.MASK["male"]))
    return out.select("event_id", "updated", F.col("mask").cast("long").alias("mask"))


@query(
    "label_update_ranges",
    """, r AS (SELECT file_id, fli AS s, fli + 4 AS e, CASE event_type WHEN 'signup' THEN 16384 ELSE 32768 END AS types FROM frames WHERE event_type IN ('signup', 'error')),
    m AS (SELECT f.event_id, bit_or(types) AS u FROM frames f JOIN r ON f.file_id = r.file_id AND f.fli BETWEEN s AND e GROUP BY ALL)
    SELECT event_id, CAST(mask | coalesce(u, 0) AS BIGINT) AS mask FROM frames LEFT JOIN m USING (event_id)""",
)
def label_update_ranges(spark, sf):
    f = frames(spark, sf)
    types = F.when(F.col("event_type") == "signup", L.MASK["male"]).otherwise(L.MASK["female"])
    r = f.filter(F.col("event_type").isin("signup", "error")).select("file_id", F.col("fli").alias("start"), (F.col("fli") + 4).alias("end"), types.alias("types"))
    return U.set_ranges(f, r, KEYS, bucket=16).select("event_id", F.col("mask").cast("long").alias("mask"))


@query(
    "speaker_homogeneous",
    """, k AS (SELECT file_id, fli // 8 AS segment, CASE WHEN mask & 1024 <> 0 THEN event_id % 3 END AS s FROM frames)
    SELECT file_id, segment, count(DISTINCT s) <= 1 AS homogeneous FROM k GROUP BY ALL""",
)
def speaker_homogeneous(spark, sf):
    f = frames(spark, sf).withColumns({"segment": F.floor(F.col("fli") / 8), "speaker": F.col("event_id") % 3})
    return U.homogeneous(f, ["file_id", "segment"])


@query(
    "consistency_check",
    ", t AS (SELECT event_id FROM frames WHERE (mask & 1024 <> 0 OR event_type = 'view') AND x > 50) SELECT * FROM t",
)
def consistency_check(spark, sf):
    f = frames(spark, sf).withColumn("mask", F.when(F.col("x") > 50, L.add(F.col("mask"), L.MASK["speakerBoundary"] | L.MASK["noiseBoundary"])).otherwise(F.col("mask")))
    f = f.filter(F.col("event_type").isin("view", "click", "signup"))
    return U.inconsistent(f).select("event_id")


@query(
    "label_probabilities",
    ", t AS (SELECT event_id, round(least(x / 100, 1), 6) AS p12, 1.0::DOUBLE AS p4 FROM frames) SELECT * FROM t",
)
def label_probabilities(spark, sf):
    f = frames(spark, sf).withColumn("probabilities", F.create_map(F.lit(4), F.lit(1.0), F.lit(12), F.lit(1.0)))
    out = U.set_probability(f, L.MASK["voiced"], F.least(F.col("x") / 100, F.lit(1.0)))
    return rounded(out.select("event_id", F.col("probabilities")[12].alias("p12"), F.col("probabilities")[4].alias("p4")), "p12")


@query(
    "phone_labels",
    """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 5122 WHEN 1 THEN 9218 WHEN 2 THEN 3074 ELSE 131072 END AS mask FROM nation""",
)
def phone_labels(spark, sf):
    k = F.col("n_nationkey") % 4
    phone = F.when(k == 0, "iy").when(k == 1, "SH").when(k == 2, "pau").otherwise("h#")
    return table(spark, sf, "nation").select("n_nationkey", phones.phone_mask(phone).alias("mask"))


@query(
    "all_deciles",
    """WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, p * 10 AS p, v AS value FROM r, range(1, 10) t(p) WHERE r = greatest(1, round(n * p / 10.0))""",
)
def all_deciles(spark, sf):
    out = T.percentiles(table(spark, sf, "events"), "value", {p: T.nearest_rank(p) for p in range(10, 100, 10)}, ["event_type"])
    return out.withColumn("p", F.col("p").cast("long"))


@query(
    "kth_smallest",
    "SELECT event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r FROM events) WHERE r = 5",
)
def kth_smallest(spark, sf):
    w = Window.partitionBy("event_type").orderBy("value", "event_id")
    return table(spark, sf, "events").withColumn("r", F.row_number().over(w)).filter("r = 5").select("event_type", "value")


@query(
    "identification_accuracy",
    "SELECT role, round(count(*) FILTER (length(text) % 2 = turn % 2) / count(*), 6) AS accuracy FROM conversations GROUP BY role",
)
def identification_accuracy(spark, sf):
    right = F.length("text") % 2 == F.col("turn") % 2
    return rounded(table(spark, sf, "conversations").groupBy("role").agg(F.avg(right.cast("double")).alias("accuracy")), "accuracy")


@query(
    "speaker_turns",
    """WITH c AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS b FROM conversations)
    SELECT conv_id, CAST(sum(b) AS BIGINT) AS changes, CAST(sum(length(text)) AS BIGINT) AS chars FROM c GROUP BY conv_id""",
)
def speaker_turns(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    change = (~F.col("role").eqNullSafe(F.lag("role").over(w)) | (F.row_number().over(w) == 1)).cast("long")
    return table(spark, sf, "conversations").withColumn("b", change).groupBy("conv_id").agg(F.sum("b").alias("changes"), F.sum(F.length("text")).alias("chars"))


@query(
    "crosstab",
    """SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS "F", count(*) FILTER (l_linestatus = 'O') AS "O" FROM lineitem GROUP BY l_returnflag""",
)
def crosstab(spark, sf):
    m = S.confusion(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")
    return m.groupBy(F.col("hyp").alias("l_returnflag")).pivot("gt", ["F", "O"]).agg(F.sum("n")).na.fill(0)


@query("merge_history")
def merge_history(spark, sf):
    """Members and purity of each merge of a small dendrogram of class means."""
    import numpy as np

    from framewright.operators import kernels

    m = table(spark, sf, "embeddings").groupBy("label").agg(F.array(*[F.avg(F.get("embedding", F.lit(d)).cast("double")) for d in range(4)]).alias("v")).orderBy("label").collect()  # a row a class
    v = np.array([r["v"] for r in m])
    merges = kernels.agglomerate(np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)))
    return segmentation.merge_tree(spark, merges, list(range(len(m)))).groupBy("step").agg(F.count(F.lit(1)).alias("members"), F.min("leaf").alias("first"))
