"""Aggregations, order statistics, frame features, joins and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import labels as L
from framewright.functions import vectors as V
from framewright.operators import joins as J
from framewright.operators import scores as S
from framewright.operators import stats as T
from framewright.operators import windows as W
from framewright.plans.base import frames, query, rounded, table

KEYS = ["file_id"]


@query(
    "label_mode",
    """, b AS (SELECT file_id, bit, count(*) FILTER ((mask >> bit) & 1 = 1) AS n FROM frames, (VALUES (0), (1), (2), (4), (10), (12), (17)) v(bit) GROUP BY ALL)
    SELECT file_id, arg_max(bit, n * 100 - bit) AS bit, max(n) AS n, round(max(n) / sum(n), 6) AS share FROM b GROUP BY file_id""",
)
def label_mode(spark, sf):
    return rounded(T.label_mode(frames(spark, sf), "mask", [0, 1, 2, 4, 10, 12, 17], KEYS), "share")


@query(
    "speaker_mode",
    """, c AS (SELECT file_id, CASE WHEN mask & 1024 <> 0 THEN CAST(event_id % 7 AS BIGINT) ELSE -1 END AS s, count(*) AS n FROM frames GROUP BY ALL)
    SELECT file_id, arg_max(s, n * 100 - s) AS mode, max(n) AS n, round(max(n) / sum(n), 6) AS share FROM c WHERE s <> -1 GROUP BY file_id""",
)
def speaker_mode(spark, sf):
    f = frames(spark, sf).withColumn("s", F.when(L.has_any(F.col("mask"), 1024), F.col("event_id") % 7).otherwise(F.lit(-1)))
    return rounded(T.mode(f, "s", KEYS, ignore=[L.NO_SPEAKER]), "share")


@query(
    "type_agreement",
    """SELECT source, count(*) FILTER (quality = 1) AS gt, count(*) FILTER (toxic = 1) AS hyp,
       count(*) FILTER (quality = 1 AND toxic = 1) AS agreed, count(*) FILTER (quality <> toxic) AS errors
       FROM labels JOIN documents USING (doc_id) GROUP BY source""",
)
def type_agreement(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return rows.groupBy("source").agg(
        F.count_if(q).alias("gt"), F.count_if(t).alias("hyp"), F.count_if(q & t).alias("agreed"), F.count_if(q != t).alias("errors")
    )


@query(
    "covariance_pairs",
    """, e AS (SELECT label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings)
    SELECT label, 0 AS i, 0 AS j, round(covar_samp(a, a), 6) AS cov FROM e GROUP BY label
    UNION ALL SELECT label, 0, 1, round(covar_samp(a, b), 6) FROM e GROUP BY label
    UNION ALL SELECT label, 0, 2, round(covar_samp(a, c), 6) FROM e GROUP BY label
    UNION ALL SELECT label, 1, 1, round(covar_samp(b, b), 6) FROM e GROUP BY label
    UNION ALL SELECT label, 1, 2, round(covar_samp(b, c), 6) FROM e GROUP BY label
    UNION ALL SELECT label, 2, 2, round(covar_samp(c, c), 6) FROM e GROUP BY label""",
)
def covariance_pairs(spark, sf):
    return rounded(T.covariances(table(spark, sf, "embeddings"), "embedding", [0, 1, 2], ["label"]), "cov")


@query(
    "column_stats",
    """SELECT dim - 1 AS dim, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(min(x), 6) AS low, round(max(x), 6) AS high
    FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY dim""",
)
def column_stats(spark, sf):
    return rounded(T.column_stats(table(spark, sf, "embeddings"), "embedding", []), "mean", "sd", "low", "high")


def _rank(p: float) -> str:
    return f"""SELECT l_returnflag, l_linestatus, v AS value FROM (SELECT l_returnflag, l_linestatus, l_extendedprice::DOUBLE AS v,
      row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n
      FROM lineitem) WHERE r = greatest(1, round(n * {p / 100}))"""


def _percentile(spark, sf, p):
    rows = table(spark, sf, "lineitem").withColumn("l_extendedprice", F.col("l_extendedprice").cast("double"))
    return T.percentile(rows, "l_extendedprice", p, ["l_returnflag", "l_linestatus"])


@query("percentile_nearest_rank", _rank(18))
def percentile_nearest_rank(spark, sf):
    return _percentile(spark, sf, 18)


@query("median_nearest_rank", _rank(50))
def median_nearest_rank(spark, sf):
    return _percentile(spark, sf, 50)


BINS = """, lim AS (SELECT file_id, min(x) AS a, max(x) AS b FROM frames GROUP BY ALL),
    bins AS (SELECT file_id, CASE WHEN b > a THEN least(CAST(floor((x - a) / (b - a) * 10) AS BIGINT), 9) ELSE 0 END AS bin, count(*) AS n, avg(x) AS mean
      FROM frames JOIN lim USING (file_id) GROUP BY ALL)"""


@query("histogram_bins", BINS + " SELECT file_id, bin, n, round(mean, 9) AS mean FROM bins")
def histogram_bins(spark, sf):
    return rounded(T.histogram(frames(spark, sf), "x", 10, KEYS), "mean", digits=9)


@query(
    "otsu_threshold",
    BINS + """, p AS (SELECT *, n / sum(n) OVER (PARTITION BY file_id) AS p FROM bins),
    c AS (SELECT *, sum(p * (bin + 1)) OVER (PARTITION BY file_id) AS m, sum(p) OVER w AS o, sum(p * (bin + 1)) OVER w AS k
      FROM p WINDOW w AS (PARTITION BY file_id ORDER BY bin ROWS UNBOUNDED PRECEDING)),
    v AS (SELECT file_id, bin, round((m * o - k) * (m * o - k) / (o * (1 - o) + 1e-9), 9) AS v FROM c),
    t AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY v DESC, bin) AS r FROM v)
    SELECT file_id, bin AS threshold_bin, round(v, 6) AS variance FROM t WHERE r = 1""",
)
def otsu_threshold(spark, sf):
    return rounded(T.otsu(T.histogram(frames(spark, sf), "x", 10, KEYS), KEYS, 10), "variance")


@query("snr", ", t AS (SELECT file_id, round(10 * log10(sum(x * x) FILTER (mask & 1024 <> 0) / sum(x * x) FILTER (mask & 1024 = 0)), 6) AS snr FROM frames GROUP BY ALL) SELECT * FROM t")
def snr(spark, sf):
    speech = L.has_any(F.col("mask"), 1024)
    one = T.snr(F.when(speech, F.col("x")), F.when(~speech, F.col("x")))
    return rounded(frames(spark, sf).groupBy("file_id").agg(one.alias("snr")), "snr")


@query("speaker_count", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_quantity >= 10 GROUP BY l_suppkey")
def speaker_count(spark, sf):
    return table(spark, sf, "lineitem").filter(F.col("l_quantity") >= 10).groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("n"))


# Frame features ---------------------------------------------------------------------

FRAMED = """, s AS (SELECT file_id, CAST(f.range AS BIGINT) AS frame, fli - f.range * 8 AS t, x - 50 AS x
      FROM frames, range(0, 1000) f WHERE fli >= f.range * 8 AND fli < f.range * 8 + 16),
    w AS (SELECT file_id, frame, list(x ORDER BY t) AS v FROM s GROUP BY ALL HAVING count(*) = 16)"""


def framed(spark, sf):
    f = frames(spark, sf).withColumn("x", F.col("x") - 50)
    return W.framed(f, "x", 16, 8, KEYS)


@query("framing", FRAMED + " SELECT file_id, frame, round(v[1], 6) AS first, round(v[16], 6) AS last, round(list_sum(v), 6) AS total FROM w")
def framing(spark, sf):
    s = F.col("samples")
    out = framed(spark, sf).select("file_id", "frame", F.get(s, F.lit(0)).alias("first"), F.get(s, F.lit(15)).alias("last"), V.total(s).alias("total"))
    return rounded(out, "first", "last", "total")


@query("zcr", FRAMED + " SELECT file_id, frame, CAST(list_sum([CASE WHEN (v[i] < 0) <> (v[i + 1] < 0) THEN 1 ELSE 0 END FOR i IN range(1, 16)]) AS INT) AS zcr FROM w")
def zcr(spark, sf):
    return framed(spark, sf).select("file_id", "frame", V.sign_changes(F.col("samples")).alias("zcr"))


@query("ste_db", FRAMED + " SELECT file_id, frame, round(CASE WHEN list_sum([y * y FOR y IN v[2:]]) > 0 THEN 10 * log10(list_sum([y * y FOR y IN v[2:]])) ELSE -873 END, 6) AS ste FROM w")
def ste_db(spark, sf):
    return rounded(framed(spark, sf).select("file_id", "frame", V.energy_db(F.col("samples")).alias("ste")), "ste")


def _tapered(kind: str, formula: str):
    sql = FRAMED + f" SELECT file_id, frame, round(list_sum([v[i] * ({formula}) FOR i IN range(1, 17)]), 6) AS total FROM w"

    def run(spark, sf):
        return rounded(framed(spark, sf).select("file_id", "frame", V.total(V.tapered(F.col("samples"), kind, 16)).alias("total")), "total")

    query(f"{kind}_window", sql)(run)


_tapered("hamming", "0.54 - 0.46 * cos(2 * pi() * (i - 1) / 15)")
_tapered("hann", "0.5 * (1 - cos(2 * pi() * (i - 1) / 15))")
_tapered("bartlett", "1 - abs(2.0 * (i - 1) / 15 - 1)")


@query(
    "dct_slaney",
    FRAMED + """ SELECT file_id, frame, round(list_sum([v[i] FOR i IN range(1, 17)]) * sqrt(2 / 16.0) / sqrt(2), 6) AS c0,
      round(list_sum([v[i] * cos(pi() * 1 * (i - 0.5) / 16) FOR i IN range(1, 17)]) * sqrt(2 / 16.0), 6) AS c1,
      round(list_sum([v[i] * cos(pi() * 2 * (i - 0.5) / 16) FOR i IN range(1, 17)]) * sqrt(2 / 16.0), 6) AS c2 FROM w""",
)
def dct_slaney(spark, sf):
    d = framed(spark, sf).select("file_id", "frame", V.dct(F.col("samples"), 16).alias("c"))
    return rounded(d.select("file_id", "frame", *[F.get("c", F.lit(k)).alias(f"c{k}") for k in range(3)]), "c0", "c1", "c2")


@query("dwt_haar", FRAMED + " SELECT file_id, frame, round((v[1] + v[2]) * sqrt(0.5), 6) AS low, round((v[15] - v[16]) * sqrt(0.5), 6) AS high FROM w")
def dwt_haar(spark, sf):
    s = F.col("samples")
    out = framed(spark, sf).select("file_id", "frame", F.get(V.haar(s), F.lit(0)).alias("low"), F.get(V.haar(s, low=False), F.lit(7)).alias("high"))
    return rounded(out, "low", "high")


_PREV = "lag(samples) over (partition by file_id order by frame)"


@query(
    "normalized_correlation",
    FRAMED + """, p AS (SELECT *, lag(v) OVER (PARTITION BY file_id ORDER BY frame) AS u FROM w)
    SELECT file_id, frame, round(list_sum([v[i] * u[i + 1] FOR i IN range(1, 16)]) /
      (sqrt(list_sum([v[i] * v[i] FOR i IN range(1, 16)])) * sqrt(list_sum([u[i] * u[i] FOR i IN range(2, 17)]))), 6) AS r FROM p WHERE u IS NOT NULL""",
)
def normalized_correlation(spark, sf):
    f = framed(spark, sf).withColumn("before", F.expr(_PREV)).filter("before is not null")
    return rounded(f.select("file_id", "frame", V.normalised_correlation(F.col("samples"), F.col("before"), 1, 16).alias("r")), "r")


SPECTRUM = FRAMED + """, f AS (SELECT file_id, frame, [list_sum([v[i] * cos(2 * pi() * k * (i - 1) / 16) FOR i IN range(1, 17)]) ** 2
      + list_sum([v[i] * sin(2 * pi() * k * (i - 1) / 16) FOR i IN range(1, 17)]) ** 2 FOR k IN range(1, 9)] AS p FROM w)"""


def spectra(spark, sf):
    return framed(spark, sf).select("file_id", "frame", V.power_spectrum(F.col("samples"), 16, 8).alias("p"))


@query(
    "brightness_bandwidth",
    SPECTRUM + """, b AS (SELECT *, list_sum([p[k] * 500.0 * k FOR k IN range(1, 9)]) / list_sum(p) AS br FROM f)
    SELECT file_id, frame, round(br, 6) AS brightness, round(sqrt(list_sum([p[k] * (500.0 * k - br) ** 2 FOR k IN range(1, 9)]) / list_sum(p)), 6) AS bandwidth FROM b""",
)
def brightness_bandwidth(spark, sf):
    hz = F.array(*[F.lit(500.0 * k) for k in range(1, 9)])
    b = spectra(spark, sf).withColumn("brightness", V.dot(F.col("p"), hz) / V.total(F.col("p")))
    spread = V.total(F.zip_with("p", hz, lambda p, f: p * (f - F.col("brightness")) * (f - F.col("brightness"))))
    return rounded(b.select("file_id", "frame", "brightness", F.sqrt(spread / V.total(F.col("p"))).alias("bandwidth")), "brightness", "bandwidth")


@query(
    "subband_power",
    SPECTRUM + """ SELECT file_id, frame, round(ln(list_sum(p)), 6) AS total, round(p[1] / list_sum(p), 6) AS b0, round(p[2] / list_sum(p), 6) AS b1,
      round((p[3] + p[4]) / list_sum(p), 6) AS b2, round((p[5] + p[6] + p[7] + p[8]) / list_sum(p), 6) AS b3 FROM f""",
)
def subband_power(spark, sf):
    p = F.col("p")
    band = lambda a, n: V.total(F.slice(p, a, n)) / V.total(p)
    out = spectra(spark, sf).select("file_id", "frame", F.ln(V.total(p)).alias("total"), band(1, 1).alias("b0"), band(2, 1).alias("b1"), band(3, 2).alias("b2"), band(5, 4).alias("b3"))
    return rounded(out, "total", "b0", "b1", "b2", "b3")


@query(
    "spectral_flux",
    SPECTRUM.replace("AS p FROM w", "AS p, v FROM w") + """, g AS (SELECT file_id, frame, [ln(sqrt(y) + 2.220446049250313e-16) FOR y IN list_concat([list_sum(v) ** 2], p)] AS l FROM f),
    u AS (SELECT *, lag(l) OVER (PARTITION BY file_id ORDER BY frame) AS u FROM g),
    x AS (SELECT file_id, frame, list_sum([(l[k] - u[k]) ** 2 FOR k IN range(1, 10)]) / 8 AS flux FROM u),
    y AS (SELECT file_id, frame, coalesce(flux, lead(flux) OVER (PARTITION BY file_id ORDER BY frame)) AS flux FROM x)
    SELECT file_id, frame, round(flux, 6) AS flux FROM y WHERE flux IS NOT NULL""",
)
def spectral_flux(spark, sf):
    """Squared differences of the logarithms of magnitudes, with the machine's epsilon, over
    all nine bins; the first frame has its successor's value."""
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x)
    powers = F.concat(F.array(total * total), V.power_spectrum(F.col("samples"), 16, 8))
    f = framed(spark, sf).select("file_id", "frame", F.transform(powers, lambda y: F.ln(F.sqrt(y) + 2.220446049250313e-16)).alias("l"))
    by = "over (partition by file_id order by frame)"
    f = f.withColumn("u", F.expr(f"lag(l) {by}")).withColumn("flux", V.squared_error(F.col("l"), F.col("u")) / 8)
    f = f.withColumn("flux", F.coalesce("flux", F.expr(f"lead(flux) {by}"))).filter("flux is not null")
    return rounded(f.select("file_id", "frame", "flux"), "flux")


@query(
    "block_silence_removal",
    """, b AS (SELECT file_id, fli // 8 AS block, sum(x * x) AS e FROM frames GROUP BY ALL),
    l AS (SELECT *, min(e) OVER (PARTITION BY file_id) AS low, avg(e) OVER (PARTITION BY file_id) AS mid FROM b)
    SELECT file_id, block, round(e, 6) AS e FROM l WHERE e > low + 0.3 * (mid - low)""",
)
def block_silence_removal(spark, sf):
    from pyspark.sql import Window

    b = frames(spark, sf).groupBy("file_id", F.floor(F.col("fli") / 8).alias("block")).agg(F.sum(F.col("x") * F.col("x")).alias("e"))
    w = Window.partitionBy("file_id")
    low, mid = F.min("e").over(w), F.avg("e").over(w)
    kept = b.withColumn("_t", low + 0.3 * (mid - low)).filter(F.col("e") > F.col("_t")).drop("_t")
    return rounded(kept, "e")


# Joins ------------------------------------------------------------------------------

HALVES = """, k AS (SELECT *, fli // 7 AS h, (fli + 3) // 9 AS g FROM frames),
    hyp AS (SELECT file_id, h, min(fli) AS s, max(fli) AS e FROM k GROUP BY ALL), gt AS (SELECT file_id, g, min(fli) AS s, max(fli) AS e FROM k GROUP BY ALL)"""


def halves(spark, sf):
    k = frames(spark, sf).withColumns({"h": F.floor(F.col("fli") / 7), "g": F.floor((F.col("fli") + 3) / 9)})
    part = lambda c: k.groupBy("file_id", c).agg(F.min("fli").alias("start"), F.max("fli").alias("end"))
    return part("h"), part("g")


@query(
    "interval_overlap_join",
    HALVES + """ SELECT hyp.file_id, h, g, least(hyp.e, gt.e) - greatest(hyp.s, gt.s) + 1 AS overlap
    FROM hyp JOIN gt ON hyp.file_id = gt.file_id AND hyp.s <= gt.e AND gt.s <= hyp.e""",
)
def interval_overlap_join(spark, sf):
    h, g = halves(spark, sf)
    return J.interval_join(h, g, KEYS, 32).select("file_id", "h", F.col("b_g").alias("g"), "overlap")


@query(
    "owner_of_cluster",
    HALVES + """, o AS (SELECT h, g, sum(least(hyp.e, gt.e) - greatest(hyp.s, gt.s) + 1) AS c
      FROM hyp JOIN gt ON hyp.file_id = gt.file_id AND hyp.s <= gt.e AND gt.s <= hyp.e GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY c DESC, g) AS k FROM o)
    SELECT h, g AS owner, CAST(c AS BIGINT) AS covered FROM r WHERE k = 1""",
)
def owner_of_cluster(spark, sf):
    h, g = halves(spark, sf)
    return J.owners(h, g, KEYS, "h", "g", 32)


@query(
    "pairwise_distance",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(list_sum([(x[1] - x[2]) ** 2 FOR x IN list_zip(a.v, b.v)])), 6) AS d
    FROM e a JOIN e b ON a.vec_id < b.vec_id AND a.vec_id % 50 = 0 OR a.vec_id > b.vec_id AND a.vec_id % 50 = 0 AND b.vec_id % 50 <> 0""",
)
def pairwise_distance(spark, sf):
    """Distances of the stated queries, every 50th vector, from all vectors; a pair of two
    queries is there once."""
    e = table(spark, sf, "embeddings")
    return rounded(J.distances_from(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding"), "d")


@query(
    "nearest_template",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), t AS (SELECT * FROM e WHERE vec_id % 50 = 0),
    d AS (SELECT e.vec_id, t.vec_id AS template, round(list_sum([(x[1] - x[2]) ** 2 FOR x IN list_zip(e.v, t.v)]), 9) AS d FROM e, t),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, template) AS k FROM d)
    SELECT vec_id, template, round(d, 6) AS error FROM r WHERE k = 1""",
)
def nearest_template(spark, sf):
    e = table(spark, sf, "embeddings")
    out = J.nearest(e, e.filter("vec_id % 50 = 0"), "embedding", "vec_id", "template")
    return rounded(out.select("vec_id", "template", "error"), "error")


@query("anti_unknown_segments", HALVES + " SELECT file_id, s AS \"start\", e AS \"end\" FROM hyp EXCEPT SELECT file_id, s, e FROM gt")
def anti_unknown_segments(spark, sf):
    h, g = halves(spark, sf)
    return J.without_known(h, g, ["file_id", "start", "end"]).select("file_id", "start", "end")


@query(
    "explicit_model_wildcard",
    """WITH rules AS (SELECT n_nationkey % 5 AS scene, n_nationkey % 3 AS segment, n_name AS model FROM nation),
    p AS (SELECT s_suppkey, s_nationkey % 4 + 1 AS scene, s_suppkey % 2 + 1 AS segment FROM supplier)
    SELECT s_suppkey, p.scene, p.segment, model FROM p JOIN rules r ON (r.scene = 0 OR r.scene = p.scene) AND (r.segment = 0 OR r.segment = p.segment)""",
)
def explicit_model_wildcard(spark, sf):
    n = table(spark, sf, "nation")
    rules = n.select((F.col("n_nationkey") % 5).alias("scene"), (F.col("n_nationkey") % 3).alias("segment"), F.col("n_name").alias("model"))
    p = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") % 4 + 1).alias("scene"), (F.col("s_suppkey") % 2 + 1).alias("segment"))
    return J.wildcard(p, rules, ["scene", "segment"])


@query(
    "name_ids",
    ", f AS (SELECT event_type, min(event_id) AS o FROM frames GROUP BY ALL) SELECT event_type, row_number() OVER (ORDER BY o, event_type) - 1 AS id FROM f",
)
def name_ids(spark, sf):
    return J.ids_of(frames(spark, sf), "event_type", F.col("event_id")).withColumn("id", F.col("id").cast("long"))


# Scores -----------------------------------------------------------------------------

MATRIX = "WITH m AS (SELECT l_returnflag AS hyp, l_linestatus AS gt, count(*) AS n FROM lineitem GROUP BY ALL)"


def matrix(spark, sf):
    return S.confusion(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("confusion_matrix", MATRIX + " SELECT * FROM m")
def confusion_matrix(spark, sf):
    return matrix(spark, sf)


@query(
    "detection_scores",
    """WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (toxic = 1 AND quality <> 1) AS fp,
      count(*) FILTER (toxic <> 1 AND quality = 1) AS fn, count(*) FILTER (toxic <> 1 AND quality <> 1) AS tn FROM labels)
    SELECT round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision, round(fn / (tp + fn), 6) AS miss_rate,
      round(fp / (tp + fn + fp), 6) AS false_alarm_rate, round((fp + fn) / (tp + fp + fn + tn), 6) AS error_rate,
      round(tn / (tn + fp), 6) AS specificity, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c""",
)
def detection_scores(spark, sf):
    c = S.counts(table(spark, sf, "labels"), F.col("toxic") == 1, F.col("quality") == 1)
    d = S.detection(c)
    return rounded(d, *d.columns)


TRADE = """WITH m AS (SELECT c_mktsegment AS hyp, c2 AS gt, count(*) AS n FROM (SELECT c_mktsegment,
      first_value(c_mktsegment) OVER (PARTITION BY c_custkey // 2 ORDER BY c_custkey) AS c2 FROM customer) GROUP BY ALL),
    r AS (SELECT hyp AS class, sum(n)::DOUBLE AS r, sum(n) FILTER (hyp = gt)::DOUBLE AS tp FROM m GROUP BY ALL), c AS (SELECT gt AS class, sum(n)::DOUBLE AS c FROM m GROUP BY ALL),
    a AS (SELECT sum(n)::DOUBLE AS al FROM m), o AS (SELECT class, coalesce(tp, 0) AS tp, r, c, al FROM r JOIN c USING (class), a)"""


def trade(spark, sf):
    from pyspark.sql import Window

    c = table(spark, sf, "customer")
    w = Window.partitionBy(F.floor(F.col("c_custkey") / 2)).orderBy("c_custkey")
    return S.confusion(c.withColumn("c2", F.first("c_mktsegment").over(w)), "c_mktsegment", "c2")


@query("one_vs_rest", TRADE + " SELECT class, tp::BIGINT AS tp, (r - tp)::BIGINT AS fp, (c - tp)::BIGINT AS fn, (al - r - c + tp)::BIGINT AS tn FROM o")
def one_vs_rest(spark, sf):
    return S.one_vs_rest(trade(spark, sf))


@query("kappa", TRADE + ", k AS (SELECT sum(tp) / max(al) AS po, sum(r * c) / max(al * al) AS pe FROM o) SELECT round((po - pe) / (1 - pe), 6) AS kappa FROM k")
def kappa(spark, sf):
    return rounded(S.classification(trade(spark, sf)).select("kappa"), "kappa")


@query("omission_commission", TRADE + " SELECT round(avg(coalesce((c - tp) / nullif(c, 0), 0)), 6) AS omission, round(avg(coalesce((r - tp) / nullif(r, 0), 0)), 6) AS commission, round((max(al) - sum(tp)) / max(al), 6) AS misclassification FROM o")
def omission_commission(spark, sf):
    c = S.classification(trade(spark, sf)).drop("kappa")
    return rounded(c, *c.columns)


PURITY = MATRIX + """, r AS (SELECT hyp, sum(n)::DOUBLE AS t, sum(n * n)::DOUBLE AS q FROM m GROUP BY ALL), c AS (SELECT gt, sum(n)::DOUBLE AS t, sum(n * n)::DOUBLE AS q FROM m GROUP BY ALL),
    x AS (SELECT sum(t) AS n, count(*) AS k, sum(q / t) AS pr, sum((0.5 - q / (t * t)) * t * t) AS rr FROM r), y AS (SELECT sum(q / t) AS pc, sum(0.5 * t * t) AS rc FROM c)"""


@query("cluster_purity", PURITY + " SELECT round(pr / n, 6) AS cluster_purity, round(pc / n, 6) AS class_purity, round(sqrt(pr / n * pc / n), 6) AS purity FROM x, y")
def cluster_purity(spark, sf):
    c = S.clustering(matrix(spark, sf)).select("cluster_purity", "class_purity", "purity")
    return rounded(c, *c.columns)


@query("rand_index", PURITY + " SELECT round(rr + rc, 3) AS rand_index FROM x, y")
def rand_index(spark, sf):
    return rounded(S.clustering(matrix(spark, sf)).select("rand_index"), "rand_index", digits=3)


@query("bbn_metric", PURITY + " SELECT round(pr - 0.5 * k, 5) AS bbn FROM x, y")
def bbn_metric(spark, sf):
    return rounded(S.clustering(matrix(spark, sf)).select("bbn"), "bbn", digits=5)


@query(
    "concordance",
    """WITH s AS (SELECT ps.file AS f, ps.item AS i, ps.a AS a, ps.b AS b FROM (SELECT l_suppkey % 10 AS file, l_partkey % 6 AS item,
      sum(l_quantity)::DOUBLE AS a, sum(l_extendedprice)::DOUBLE AS b FROM lineitem GROUP BY ALL) ps),
    p AS (SELECT (round(x.a - y.a, 4) < 0) = (round(x.b - y.b, 4) < 0) AS same FROM s x JOIN s y ON x.f = y.f AND x.i < y.i)
    SELECT round(count(*) FILTER (same) / count(*), 6) AS concordance FROM p""",
)
def concordance(spark, sf):
    s = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("f"), (F.col("l_partkey") % 6).alias("i")).agg(
        F.round(F.sum("l_quantity"), 4).alias("a"), F.round(F.sum("l_extendedprice"), 4).alias("b")
    )
    out = S.concordance(s.select("f", "i", F.col("a").alias("s")), s.select("f", "i", F.col("b").alias("s")), "f", "i", "s")
    return rounded(out, "concordance")


@query(
    "change_detection_tolerance",
    """, t AS (SELECT file_id, fli AS t FROM frames WHERE event_type = 'signup'), h AS (SELECT file_id, fli AS h FROM frames WHERE event_type = 'click'),
    n AS (SELECT file_id, h, t, row_number() OVER (PARTITION BY file_id, h ORDER BY abs(h - t), t) AS k FROM h JOIN t USING (file_id) WHERE abs(h - t) <= 2),
    tp AS (SELECT file_id, count(DISTINCT t) AS tp FROM n WHERE k = 1 GROUP BY ALL), a AS (SELECT file_id, count(*) AS f FROM h GROUP BY ALL), b AS (SELECT file_id, count(*) AS t FROM t GROUP BY ALL)
    SELECT file_id, coalesce(tp, 0) AS tp, coalesce(f, 0) - coalesce(tp, 0) AS fp, coalesce(t, 0) - coalesce(tp, 0) AS fn
    FROM a FULL JOIN b USING (file_id) LEFT JOIN tp USING (file_id)""",
)
def change_detection_tolerance(spark, sf):
    f = frames(spark, sf)
    return J.matched_boundaries(f.filter("event_type = 'click'"), f.filter("event_type = 'signup'"), KEYS, "fli", 2)


@query(
    "der",
    """, k AS (SELECT *, event_id % 5 AS g, (event_id // 2) % 5 AS h FROM frames)
    SELECT count(*) AS frames, count(*) FILTER (h % 5 IS DISTINCT FROM g) AS wrong, round(count(*) FILTER (h IS DISTINCT FROM g) / count(*), 6) AS der FROM k WHERE mask <> 131072""",
)
def der(spark, sf):
    k = frames(spark, sf).withColumns({"g": F.col("event_id") % 5, "h": F.floor(F.col("event_id") / 2) % 5})
    mapping = k.select(F.col("h").alias("hyp_id"), F.col("h").alias("gt_id")).distinct()
    return rounded(S.error_rate(k, "g", "h", mapping, F.col("mask") != L.MASK["silence"]), "der")


@query(
    "grouping_by_ce",
    """, k AS (SELECT *, fli // 10 AS seg, fli // 50 AS scene FROM frames)
    SELECT file_id, seg, scene, count(*) AS n, count(*) FILTER (mask & 1024 <> 0) AS hits FROM k GROUP BY GROUPING SETS ((file_id, seg), (file_id, scene), (file_id), ())""",
)
def grouping_by_ce(spark, sf):
    k = frames(spark, sf).withColumns({"seg": F.floor(F.col("fli") / 10), "scene": F.floor(F.col("fli") / 50)})
    c = [F.col("file_id"), F.col("seg"), F.col("scene")]
    sets = [[c[0], c[1]], [c[0], c[2]], [c[0]], []]
    return k.groupingSets(sets, *c).agg(F.count(F.lit(1)).alias("n"), F.count_if(L.has_any(F.col("mask"), 1024)).alias("hits"))
