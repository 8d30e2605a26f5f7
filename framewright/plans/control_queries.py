"""Order statistics, subsets, voicing, and the control of clustering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.functions import labels as L
from framewright.operators import joins as J
from framewright.operators import partitions as P
from framewright.operators import runs as R
from framewright.operators import scores as S
from framewright.operators import segmentation as G
from framewright.operators import stats as T
from framewright.plans.base import FRAMES, frames, query, rounded, table

KEYS = ["file_id"]


@query(
    "all_percentiles",
    """WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r,
      count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
    SELECT l_returnflag, CAST(p AS BIGINT) AS p, v AS value FROM r, range(0, 101) t(p) WHERE r = greatest(1, n * p // 100)""",
)
def all_percentiles(spark, sf):
    return T.all_percentiles(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"]).withColumn("p", F.col("p").cast("long"))


@query(
    "without_outliers",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    q AS (SELECT event_type, max(value) FILTER (r = greatest(1, round(n * 0.25::DOUBLE))) AS a, max(value) FILTER (r = greatest(1, round(n * 0.75::DOUBLE))) AS b FROM r GROUP BY event_type)
    SELECT event_id, value FROM events JOIN q USING (event_type) WHERE value BETWEEN a - (b - a) * 0.2::DOUBLE AND b + (b - a) * 0.2::DOUBLE""",
)
def without_outliers(spark, sf):
    return T.without_outliers(table(spark, sf, "events"), "value", ["event_type"], 0.2).select("event_id", "value")


@query("thinned_evenly", ", t AS (SELECT event_id FROM frames WHERE floor((fli + 1) * 0.3::DOUBLE) > floor(fli * 0.3::DOUBLE)) SELECT * FROM t")
def thinned_evenly(spark, sf):
    return T.thinned_evenly(frames(spark, sf), F.col("fli"), 30.0).select("event_id")


@query("training_subset", "SELECT event_id, value FROM events ORDER BY ('0x' || substr(md5('train:' || event_id), 1, 8))::BIGINT, event_id LIMIT 200")
def training_subset(spark, sf):
    return T.training_subset(table(spark, sf, "events"), "event_id", 200, salt="train").select("event_id", "value")


@query(
    "pareto_radius",
    """WITH a AS (SELECT s_suppkey AS k, s_acctbal::DOUBLE AS x FROM supplier), d AS (SELECT abs(a.x - b.x) AS d FROM a JOIN a b ON a.k < b.k),
    r AS (SELECT d, row_number() OVER (ORDER BY d) AS r, count(*) OVER () AS n FROM d)
    SELECT round(coalesce(max(d) FILTER (r = greatest(1, round(n * 0.18::DOUBLE)) AND d > 0), min(d) FILTER (d > 0), 1.0), 6) AS radius FROM r""",
)
def pareto_radius(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.array(F.col("s_acctbal").cast("double")).alias("v"))
    pairs = J.pairwise(s, "s_suppkey", "v").select(F.round("d", 9).alias("d"))
    return rounded(T.pareto_radius(pairs, "d"), "radius")


@query(
    "scene_window",
    """, s AS (SELECT event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY fli) AS BIGINT) AS scene FROM frames)
    SELECT event_id, scene FROM s WHERE scene BETWEEN 1 AND 4 AND (22 & (1::BIGINT << scene)) <> 0""",
)
def scene_window(spark, sf):
    numbered = R.ordinal(frames(spark, sf), F.col("event_type") == "signup", KEYS)
    return R.scene_window(numbered, "scene", 1, 4, selection=22).select("event_id", "scene")


_VOICED = """, c AS (SELECT *, 100 - x AS z, mask & ~12288 AS clean FROM frames), a AS (SELECT * FROM c WHERE clean & 133120 <> 0 AND clean & 1 = 0),
    u AS (SELECT file_id, 'x' AS f, x AS v FROM a UNION ALL SELECT file_id, 'z', z FROM a),
    e AS (SELECT file_id, f, min(v) AS lo, max(v) AS hi FROM u GROUP BY ALL),
    h AS (SELECT file_id, f, CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * 4), 3) ELSE 0 END AS bin, count(*) AS n, avg(v) AS mean FROM u JOIN e USING (file_id, f) GROUP BY ALL),
    p AS (SELECT *, n / sum(n) OVER g AS p FROM h WINDOW g AS (PARTITION BY file_id, f)),
    m AS (SELECT *, sum(p * (bin + 1)) OVER g AS m, sum(p) OVER s AS w, sum(p * (bin + 1)) OVER s AS k FROM p WINDOW g AS (PARTITION BY file_id, f), s AS (PARTITION BY file_id, f ORDER BY bin)),
    b AS (SELECT file_id, f, bin + 1 AS t, row_number() OVER (PARTITION BY file_id, f ORDER BY round((m * w - k) * (m * w - k) / (w * (1 - w) + 1e-9::DOUBLE), 9) DESC, bin) AS r FROM m),
    l AS (SELECT file_id, f, coalesce(arg_max(mean, bin) FILTER (bin <= t AND mean > 0), arg_min(mean, bin) FILTER (bin > t AND mean > 0)) AS level FROM h JOIN b USING (file_id, f) WHERE r = 1 GROUP BY ALL),
    o AS (SELECT event_id, c.mask AS truth, clean, clean & 133120 <> 0 AND clean & 1 = 0 AS asked, coalesce(x > lx.level, false) OR coalesce(z > lz.level, false) AS hit, z, lz.level AS lz
      FROM c LEFT JOIN l lx ON lx.file_id = c.file_id AND lx.f = 'x' LEFT JOIN l lz ON lz.file_id = c.file_id AND lz.f = 'z'),
    t AS (SELECT event_id, truth, CAST(CASE WHEN asked AND hit THEN 9220 WHEN clean & 131072 <> 0 THEN 131072 WHEN clean & 1024 <> 0 AND clean & 2048 = 0 THEN clean | 4096 ELSE clean END AS BIGINT) AS mask,
      round(CASE WHEN asked THEN CASE WHEN z > lz THEN 1 - lz / z ELSE z / lz END END, 6) AS p_unvoiced FROM o)"""


def _voiced(spark, sf):
    f = frames(spark, sf).withColumn("z", 100 - F.col("x")).withColumn("truth", F.col("mask"))
    return G.voicing_by_otsu(f, ["x", "z"], KEYS, bins=4)


@query("voicing_otsu", _VOICED + " SELECT event_id, mask, p_unvoiced FROM t")
def voicing_otsu(spark, sf):
    out = _voiced(spark, sf).select("event_id", F.col("mask").cast("long").alias("mask"), "p_unvoiced")
    return rounded(out, "p_unvoiced")


@query(
    "voicing_scores",
    """, t AS (SELECT mask | 1024 | (CASE WHEN x > 60 THEN 4096 ELSE 8192 END) AS h, CASE WHEN fli % 3 = 0 THEN 1024 | 8192 ELSE 1024 | 4096 END AS g FROM frames WHERE event_type <> 'signup')
    SELECT count(*) FILTER (h & 4096 <> 0 AND g & 4096 <> 0) AS tn, count(*) FILTER (h & 4096 <> 0 AND g & 4096 = 0) AS fn,
      count(*) FILTER (h & 4096 = 0 AND g & 4096 <> 0) AS fp, count(*) FILTER (h & 4096 = 0 AND g & 4096 = 0) AS tp FROM t""",
)
def voicing_scores(spark, sf):
    """With the unvoiced frames as the positive class."""
    f = frames(spark, sf).filter("event_type <> 'signup'")
    said = L.add(F.col("mask"), L.MASK["speech"]).bitwiseOR(F.when(F.col("x") > 60, L.MASK["voiced"]).otherwise(L.MASK["unvoiced"]))
    true = F.when(F.col("fli") % 3 == 0, L.MASK["unvoiced"]).otherwise(L.MASK["voiced"]).bitwiseOR(F.lit(L.MASK["speech"]))
    return S.flipped(S.voicing_scores(f.select(said.alias("h"), true.alias("g")), "h", "g"))


#: The orders of a customer as the steps of a clustering.
_STEPS = """WITH s AS (SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS step,
      o_totalprice::DOUBLE AS price, (o_orderkey % 97)::DOUBLE AS error, 1 + o_orderkey % 7 AS cost FROM orders),
    t AS (SELECT *, CASE WHEN step > 0 THEN price END AS criterion FROM s)"""


def _steps(spark, sf):
    o = table(spark, sf, "orders")
    step = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long")
    s = o.select("o_custkey", step.alias("step"), F.col("o_totalprice").cast("double").alias("price"), (F.col("o_orderkey") % 97).cast("double").alias("error"), (1 + F.col("o_orderkey") % 7).alias("cost"))
    return s.withColumn("criterion", F.when(F.col("step") > 0, F.col("price")))


@query(
    "final_partition",
    _STEPS
    + """, l AS (SELECT o_custkey, max(step) AS last, coalesce(max(step) FILTER (step > 0 AND criterion < 150000), 0) AS icr FROM t GROUP BY 1),
    w AS (SELECT o_custkey, step - 1 AS wcd FROM t WHERE step > 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY criterion, step) = 1),
    e AS (SELECT o_custkey, step AS error FROM t QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY error, step) = 1)
    SELECT o_custkey, last, icr, coalesce(wcd, 0) AS wcd, error, CAST(ceil(error + (last - error) * 0.5::DOUBLE) AS BIGINT) AS fewer FROM l JOIN e USING (o_custkey) LEFT JOIN w USING (o_custkey)""",
)
def final_partition(spark, sf):
    t, out = _steps(spark, sf), None
    for kind in ("last", "icr", "wcd", "error"):
        one = P.final_step(t, ["o_custkey"], kind, 150000.0).select("o_custkey", F.col("step").alias(kind))
        out = one if out is None else out.join(one, "o_custkey")
    return out.withColumn("fewer", P.specific_step(F.col("error"), F.col("last"), 0.75))


@query(
    "tuned_penalty",
    _STEPS
    + """, r AS (SELECT *, CASE WHEN step > 0 THEN price / cost END AS r FROM t),
    n AS (SELECT *, min(r) OVER w AS least, lead(r) OVER w AS next FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY step))
    SELECT o_custkey, step, round(next, 6) AS over FROM n WHERE next IS NULL OR least IS NULL OR next < least
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY error, step) = 1""",
)
def tuned_penalty(spark, sf):
    return rounded(P.tuned_penalty(_steps(spark, sf), ["o_custkey"], gain="price"), "over")


@query(
    "merging_goes_on",
    _STEPS + """ SELECT o_custkey, step, coalesce(criterion - 100000 >= 0, true) AS bic, 10 - step > 4 AS known, true AS every, false AS none FROM t""",
)
def merging_goes_on(spark, sf):
    c, left = F.col("criterion") - 100000, 10 - F.col("step")
    rule = lambda name: P.goes_on(name, c, left, F.lit(4))
    return _steps(spark, sf).select(
        "o_custkey", "step", rule("criterion").alias("bic"), rule("knowledge").alias("known"), rule("optimal").alias("every"), rule("never").alias("none")
    )


@query(
    "own_frames",
    """, m AS (SELECT event_type AS c, avg(x) AS m, var_samp(x) AS v FROM frames GROUP BY ALL),
    b AS (SELECT event_id, event_type, c, row_number() OVER (PARTITION BY event_id ORDER BY round(0.5 * (ln(2 * pi() * v) + (x - m) * (x - m) / v), 9), c) AS r FROM frames, m WHERE v > 0)
    SELECT event_id FROM b WHERE r = 1 AND c = event_type""",
)
def own_frames(spark, sf):
    return P.own_frames(frames(spark, sf), "event_type", "x").select("event_id")


@query(
    "random_baseline",
    """WITH d AS (SELECT event_type, CAST(r AS BIGINT) AS repeat, ('0x' || substr(md5('cluster:' || event_id || ':' || r), 1, 8))::BIGINT / 4294967296::DOUBLE AS u FROM events, range(5) t(r)),
    c AS (SELECT repeat, CASE WHEN u < 0.5 THEN 0 WHEN u < 0.75 THEN 1 ELSE 2 END AS c, event_type, count(*) AS n FROM d GROUP BY ALL),
    m AS (SELECT repeat, c, max(n) AS m, sum(n) AS a FROM c GROUP BY ALL) SELECT repeat, round(sum(m) / sum(a), 6) AS purity FROM m GROUP BY repeat""",
)
def random_baseline(spark, sf):
    return rounded(P.random_baseline(table(spark, sf, "events"), "event_id", "event_type", [2.0, 1.0, 1.0], 5), "purity")
