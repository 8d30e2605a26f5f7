"""Labels, predicates, time axis, scalar and string functions, runs and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import labels as L
from framewright.functions import mathx, strings, timeaxis
from framewright.operators import runs as R
from framewright.operators import windows as W
from framewright.plans.base import FRAMES, frames, query, rounded, table

KEYS = ["file_id"]
SPEECH = L.MASK["speech"]


@query("label_any", ", t AS (SELECT event_id FROM frames WHERE mask & 4112 <> 0) SELECT * FROM t")
def label_any(spark, sf):
    return frames(spark, sf).filter(L.matches(F.col("mask"), L.MASK["voiced"] | L.MASK["music"])).select("event_id")


@query("label_all", ", t AS (SELECT event_id FROM frames WHERE mask & 5120 = 5120) SELECT * FROM t")
def label_all(spark, sf):
    return frames(spark, sf).filter(L.matches(F.col("mask"), L.MASK["voiced"] | SPEECH, unite=True)).select("event_id")


@query("label_none", ", t AS (SELECT event_id FROM frames WHERE mask & 1024 <> 0 AND mask & 4096 = 0) SELECT * FROM t")
def label_none(spark, sf):
    return frames(spark, sf).filter(L.matches(F.col("mask"), SPEECH, without=L.MASK["voiced"])).select("event_id")


@query(
    "label_add_exclusive",
    ", t AS (SELECT event_id, CAST((mask & ~(131072 | 1 | 32 | 8 | 64 | 16 | 512 | 2097152)) | 1024 AS BIGINT) AS mask FROM frames) SELECT * FROM t",
)
def label_add_exclusive(spark, sf):
    return frames(spark, sf).select("event_id", L.add_exclusive(F.col("mask"), "speech").cast("long").alias("mask"))


@query("label_remove", ", t AS (SELECT event_id, CAST(mask & ~5120 AS BIGINT) AS mask FROM frames) SELECT * FROM t")
def label_remove(spark, sf):
    return frames(spark, sf).select("event_id", L.remove(F.col("mask"), 5120).cast("long").alias("mask"))


@query("label_bitcount", ", t AS (SELECT event_id, CAST(bit_count(mask) AS BIGINT) AS bits FROM frames) SELECT * FROM t")
def label_bitcount(spark, sf):
    return frames(spark, sf).select("event_id", F.bit_count("mask").cast("long").alias("bits"))


@query(
    "label_conflicts",
    """, t AS (SELECT event_id, mask | 131072 AS m FROM frames)
    SELECT event_id, CAST(CASE WHEN m = 131072 THEN 0 WHEN m & 1 <> 0 THEN 131073 WHEN m & 4096 <> 0 THEN 136196
      WHEN m & 1024 <> 0 THEN 132098 ELSE 16 END AS BIGINT) AS conflict FROM t""",
)
def label_conflicts(spark, sf):
    return frames(spark, sf).select("event_id", L.conflicts(L.add(F.col("mask"), L.MASK["silence"])).cast("long").alias("conflict"))


@query(
    "label_names",
    """, t AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'noise' WHEN 'click' THEN 'pureSpeech,speech'
      WHEN 'signup' THEN 'noisySpeech,speech,voiced' WHEN 'purchase' THEN 'music' ELSE 'silence' END AS names FROM frames)
    SELECT * FROM t""",
)
def label_names(spark, sf):
    return frames(spark, sf).select("event_id", L.names(F.col("mask")).alias("names"))


@query(
    "segment_predicate_count",
    """, t AS (SELECT file_id, fli // 20 AS seg, mask & 1024 <> 0 AS hit FROM frames)
    SELECT file_id, seg, count(*) FILTER (hit) AS hits, bool_and(hit) AS every_frame, bool_or(hit) AS any_frame FROM t GROUP BY ALL""",
)
def segment_predicate_count(spark, sf):
    hit = L.has_any(F.col("mask"), SPEECH)
    seg = F.floor(F.col("fli") / 20).alias("seg")
    return frames(spark, sf).groupBy("file_id", seg).agg(
        F.count_if(hit).alias("hits"), F.every(hit).alias("every_frame"), F.some(hit).alias("any_frame")
    )


@query("conv_frame_sample", "SELECT l_orderkey, l_linenumber, l_partkey * 160 AS s0, l_partkey * 160 + 255 AS s1 FROM lineitem")
def conv_frame_sample(spark, sf):
    f = F.col("l_partkey")
    one = [timeaxis.frame_to_sample(f, 256, 160).alias("s0"), timeaxis.frame_to_sample(f, 256, 160, end=True).alias("s1")]
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *one)


@query(
    "conv_sample_frame_end",
    """SELECT l_orderkey, l_linenumber, l_partkey // 160 AS f0,
       CASE WHEN l_partkey < 256 THEN 0 ELSE (l_partkey - 256) // 160 + 1 END AS f1 FROM lineitem""",
)
def conv_sample_frame_end(spark, sf):
    s = F.col("l_partkey")
    one = [timeaxis.sample_to_frame(s, 256, 160).alias("f0"), timeaxis.sample_to_frame(s, 256, 160, end=True).alias("f1")]
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *one)


@query("conv_ms_sample", "SELECT l_orderkey, l_linenumber, l_partkey * 44 AS s0, l_partkey * 44 + 43 AS s1, l_partkey // 44 AS ms FROM lineitem")
def conv_ms_sample(spark, sf):
    v = F.col("l_partkey")
    one = [timeaxis.ms_to_sample(v, 44100).alias("s0"), timeaxis.ms_to_sample(v, 44100, end=True).alias("s1"), timeaxis.sample_to_ms(v, 44100).alias("ms")]
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *one)


@query("sliding_row_count", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey < 400 THEN 0 ELSE (l_partkey - 400) // 160 + 1 END AS n FROM lineitem")
def sliding_row_count(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", timeaxis.row_count(F.col("l_partkey"), 400, 160).alias("n"))


@query(
    "math_scalars",
    """SELECT event_id, round(CASE WHEN value < 0 THEN 0 WHEN value < 50 THEN 1 / (1 + exp(13.81550955796377::DOUBLE * (1 - value / 50)))
       WHEN value < 120 THEN 1 / (1 + exp(-13.81551055796427::DOUBLE * (value - 50) / 70)) ELSE 1 END, 6) AS sig,
       round(CASE WHEN value > 0 THEN ln(value) ELSE -705 END, 6) AS lg,
       round(-0.5 * (ln(2 * pi() * 4) + (value - 50) * (value - 50) / 4), 6) AS gauss,
       round((value - 0) / 100 * 2 - 1, 6) AS scaled FROM events""",
)
def math_scalars(spark, sf):
    v = F.col("value")
    out = table(spark, sf, "events").select(
        "event_id",
        mathx.sigmoid(v, 0.0, 50.0, 120.0).alias("sig"),
        mathx.safe_log(v).alias("lg"),
        mathx.gauss_log_pdf(v, 50.0, 4.0).alias("gauss"),
        mathx.rescale(v, 0.0, 100.0, -1.0, 1.0).alias("scaled"),
    )
    return rounded(out, "sig", "lg", "gauss", "scaled")


@query("like_sets", r"SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^[A-M].*[^a-m]$')")
def like_sets(spark, sf):
    return table(spark, sf, "part").filter(strings.like(F.col("p_type"), "[A-M]%[^a-m]")).select("p_partkey")


@query(
    "string_parts",
    r"""SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS file_name, regexp_extract(url, '^(.*[/\\])[^/\\]*$', 1) AS directory,
        lower(url[1:8]) = 'https://' AS secure FROM pages""",
)
def string_parts(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", strings.file_name(u).alias("file_name"), strings.directory(u).alias("directory"), strings.same_prefix(u, F.lit("HTTPS://"), 8).alias("secure")
    )


RUNS = """, marked AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY file_id ORDER BY fli) IS DISTINCT FROM event_type
    AND fli > 0 THEN 1 ELSE 0 END AS c FROM frames),
  numbered AS (SELECT *, sum(c) OVER (PARTITION BY file_id ORDER BY fli) AS run_id FROM marked),
  runs AS (SELECT file_id, CAST(run_id AS BIGINT) AS run_id, event_type, min(fli) AS s, max(fli) AS e, count(*) AS n,
    avg(x) AS m, stddev_samp(x) AS sd FROM numbered GROUP BY file_id, run_id, event_type)"""


def event_runs(spark, sf):
    more = [F.first("event_type").alias("event_type"), F.avg("x").alias("m"), F.stddev_samp("x").alias("sd")]
    return R.runs(frames(spark, sf), F.col("event_type"), KEYS, more=more)


@query("runs_by_label", RUNS + ' SELECT file_id, run_id, event_type, s AS "start", e AS "end", n, round(m, 6) AS m, round(sd, 6) AS sd FROM runs')
def runs_by_label(spark, sf):
    return rounded(event_runs(spark, sf), "m", "sd")


@query(
    "flagship_run_profile",
    RUNS + """, best AS (SELECT file_id, event_type, count(*) AS runs, sum(n) AS frames, max(n) AS longest, avg(m) AS level FROM runs GROUP BY ALL)
    SELECT file_id, event_type, runs, CAST(frames AS BIGINT) AS frames, longest, round(level, 9) AS level,
      row_number() OVER (PARTITION BY file_id ORDER BY frames DESC, event_type) AS place FROM best""",
)
def flagship_run_profile(spark, sf):
    from pyspark.sql import Window

    r = event_runs(spark, sf).groupBy("file_id", "event_type").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("n").alias("frames"), F.max("n").alias("longest"), F.avg("m").alias("level")
    )
    place = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("frames"), "event_type")).cast("long")
    return rounded(r.withColumn("place", place), "level", digits=9)


@query(
    "runs_with_speaker_break",
    """, k AS (SELECT *, (mask & 1024 <> 0)::INT * 1000 + (event_type = 'click')::INT * 10 + (mask & 17 <> 0)::INT AS v FROM frames),
    marked AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY file_id ORDER BY fli) IS DISTINCT FROM v AND fli > 0 THEN 1 ELSE 0 END AS c FROM k),
    numbered AS (SELECT *, sum(c) OVER (PARTITION BY file_id ORDER BY fli) AS run_id FROM marked)
    SELECT file_id, CAST(run_id AS BIGINT) AS run_id, min(fli) AS "start", max(fli) AS "end", count(*) AS n
    FROM numbered WHERE mask & 1024 <> 0 GROUP BY file_id, run_id""",
)
def runs_with_speaker_break(spark, sf):
    speech = L.has_any(F.col("mask"), SPEECH)
    speaker = (F.col("event_type") == "click").cast("int") * 10 + L.has_any(F.col("mask"), 17).cast("int")
    return R.runs(frames(spark, sf), speech.cast("int") * 1000 + speaker, KEYS, wanted=speech)


@query(
    "boundary_segments",
    """, b AS (SELECT file_id, fli AS s, lead(fli) OVER (PARTITION BY file_id ORDER BY fli) - 1 AS e FROM frames WHERE event_type = 'signup'),
    z AS (SELECT file_id, max(fli) AS last FROM frames GROUP BY ALL)
    SELECT file_id, s AS "start", coalesce(e, last) AS "end" FROM b JOIN z USING (file_id)""",
)
def boundary_segments(spark, sf):
    return R.segments(frames(spark, sf), F.col("event_type") == "signup", KEYS)


@query(
    "scene_ordinal",
    """, t AS (SELECT event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY fli) AS BIGINT) AS scene
    FROM frames) SELECT * FROM t""",
)
def scene_ordinal(spark, sf):
    return R.ordinal(frames(spark, sf), F.col("event_type") == "signup", KEYS).select("event_id", "scene")


@query(
    "short_gap_relabel",
    """, k AS (SELECT *, CASE WHEN mask = 131072 THEN 1 WHEN mask & 1024 <> 0 THEN 2 ELSE 0 END AS v FROM frames),
    marked AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY file_id ORDER BY fli) IS DISTINCT FROM v AND fli > 0 THEN 1 ELSE 0 END AS c FROM k),
    numbered AS (SELECT *, sum(c) OVER (PARTITION BY file_id ORDER BY fli) AS r FROM marked),
    one AS (SELECT file_id, r, v, count(*) AS n FROM numbered GROUP BY ALL),
    ctx AS (SELECT *, lag(v) OVER (PARTITION BY file_id ORDER BY r) AS p, lead(v) OVER (PARTITION BY file_id ORDER BY r) AS q FROM one)
    SELECT event_id, CAST(CASE WHEN ctx.v = 1 AND n < 3 AND p = 2 AND q = 2 THEN 3076 ELSE mask END AS BIGINT) AS mask
    FROM numbered JOIN ctx USING (file_id, r)""",
)
def short_gap_relabel(spark, sf):
    f = frames(spark, sf)
    new = F.lit(L.MASK["pause"] | SPEECH | L.MASK["noisySpeech"])
    gap, around = F.col("mask") == L.MASK["silence"], L.has_any(F.col("mask"), SPEECH)
    return R.relabel_short_gaps(f, gap, around, 3, new, KEYS).select("event_id", F.col("mask").cast("long").alias("mask"))


@query(
    "short_run_tag",
    RUNS + ' SELECT file_id, run_id, n, n < 2 AS short FROM runs',
)
def short_run_tag(spark, sf):
    return event_runs(spark, sf).select("file_id", "run_id", "n", (F.col("n") < 2).alias("short"))


@query(
    "max_run_split",
    RUNS + """, cut AS (SELECT file_id, run_id, unnest(generate_series(s, e, 2)) AS p, e FROM runs)
    SELECT file_id, run_id, p AS "start", least(e, p + 1) AS "end" FROM cut""",
)
def max_run_split(spark, sf):
    return R.split_long(event_runs(spark, sf).select("file_id", "run_id", "start", "end"), 2)


@query(
    "neighbour_merge",
    """, i AS (SELECT file_id, fli * 3 AS s, fli * 3 + CAST(floor(x) AS BIGINT) % 6 AS e FROM frames WHERE mask <> 131072),
    m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS c FROM i),
    g AS (SELECT *, sum(c) OVER (PARTITION BY file_id ORDER BY s, e) AS k FROM m)
    SELECT file_id, min(s) AS "start", max(e) AS "end", count(*) AS parts FROM g GROUP BY file_id, k""",
)
def neighbour_merge(spark, sf):
    f = frames(spark, sf).filter(F.col("mask") != L.MASK["silence"])
    parts = f.select("file_id", (F.col("fli") * 3).alias("start"), (F.col("fli") * 3 + F.floor("x") % 6).alias("end"))
    return R.merge_neighbours(parts, KEYS)


@query(
    "detectability_min_lead",
    RUNS + """ SELECT file_id, run_id, least(n, lead(n, 1, 0) OVER (PARTITION BY file_id ORDER BY s)) AS detectability FROM runs""",
)
def detectability_min_lead(spark, sf):
    return R.detectability(event_runs(spark, sf), F.col("n"), KEYS).select("file_id", "run_id", "detectability")


@query(
    "change_at_run_start",
    """, t AS (SELECT event_id, mask & 1024 <> 0 AS h, coalesce(lag(mask & 1024 <> 0) OVER (PARTITION BY file_id ORDER BY fli), false) AS b FROM frames)
    SELECT event_id FROM t WHERE h AND NOT b""",
)
def change_at_run_start(spark, sf):
    return R.change_points(frames(spark, sf), L.has_any(F.col("mask"), SPEECH), KEYS).select("event_id")


@query(
    "asof_previous",
    """, t AS (SELECT event_id, max(CASE WHEN event_type = 'signup' THEN fli END) OVER (PARTITION BY file_id ORDER BY fli) AS previous FROM frames) SELECT * FROM t""",
)
def asof_previous(spark, sf):
    p = R.previous(F.when(F.col("event_type") == "signup", F.col("fli")), KEYS)
    return frames(spark, sf).select("event_id", p.alias("previous"))


@query(
    "asof_next",
    """, t AS (SELECT event_id, min(CASE WHEN event_type = 'signup' THEN fli END) OVER (PARTITION BY file_id ORDER BY fli
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS following FROM frames) SELECT * FROM t""",
)
def asof_next(spark, sf):
    p = R.following(F.when(F.col("event_type") == "signup", F.col("fli")), KEYS)
    return frames(spark, sf).select("event_id", p.alias("following"))


@query(
    "nearest_segment",
    """, t AS (SELECT event_id, fli,
      max(CASE WHEN event_type = 'signup' THEN fli END) OVER (PARTITION BY file_id ORDER BY fli) AS p,
      min(CASE WHEN event_type = 'signup' THEN fli END) OVER (PARTITION BY file_id ORDER BY fli ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM frames)
    SELECT event_id, CASE WHEN p IS NULL THEN q WHEN q IS NULL OR fli - p <= q - fli THEN p ELSE q END AS nearest FROM t""",
)
def nearest_segment(spark, sf):
    at = F.when(F.col("event_type") == "signup", F.col("fli"))
    p, q = R.previous(at, KEYS), R.following(at, KEYS)
    f = frames(spark, sf).select("event_id", "fli", p.alias("p"), q.alias("q"))
    near = F.when(F.col("p").isNull(), F.col("q")).when(F.col("q").isNull() | (F.col("fli") - F.col("p") <= F.col("q") - F.col("fli")), F.col("p")).otherwise(F.col("q"))
    return f.select("event_id", near.alias("nearest"))


@query(
    "pseudo_scenes",
    "WITH RECURSIVE " + FRAMES + """, s AS (SELECT file_id, fli, mask & 1024 <> 0 AS speech FROM frames),
    j AS (SELECT a.file_id, a.fli, CASE WHEN a.speech THEN min(b.fli) FILTER (NOT b.speech) ELSE a.fli END AS open, a.speech FROM s a JOIN s b ON a.file_id = b.file_id AND b.fli >= a.fli GROUP BY a.file_id, a.fli, a.speech),
    g AS (SELECT j.file_id, j.fli, CASE WHEN j.speech THEN j.open + coalesce(greatest((min(b.fli) - j.open) // 2, 2), 0) ELSE j.open END AS goal
      FROM j LEFT JOIN s b ON b.file_id = j.file_id AND b.speech AND b.fli > j.open GROUP BY j.file_id, j.fli, j.open, j.speech),
    w AS (SELECT file_id, CAST(0 AS BIGINT) AS scene, CAST(0 AS BIGINT) AS boundary FROM s WHERE fli = 0
      UNION ALL SELECT w.file_id, w.scene + 1, CAST(g.goal AS BIGINT) FROM w JOIN g ON g.file_id = w.file_id AND g.fli = w.boundary + 5
        WHERE EXISTS (SELECT 1 FROM s WHERE s.file_id = w.file_id AND s.fli = g.goal))
    SELECT * FROM w""",
)
def pseudo_scenes(spark, sf):
    return R.pseudo_scenes(frames(spark, sf), L.has_any(F.col("mask"), SPEECH), 5, KEYS, pause=2)


_W = "OVER (PARTITION BY file_id ORDER BY fli)"


@query(
    "delta_regression",
    f""", t AS (SELECT event_id, x, lag(x) {_W} AS p, {', '.join(f'lag(x, {k}) {_W} AS a{k}, lead(x, {k}) {_W} AS b{k}' for k in (1, 2, 3))} FROM frames)
    SELECT event_id, round(CASE WHEN a3 IS NOT NULL AND b3 IS NOT NULL THEN (b1 - a1) + 2 * (b2 - a2) + 3 * (b3 - a3) ELSE coalesce(x - p, x) END, 6) AS d FROM t""",
)
def delta_regression(spark, sf):
    return rounded(frames(spark, sf).select("event_id", W.delta("x", KEYS).alias("d")), "d")


@query("first_difference", f", t AS (SELECT event_id, round(coalesce(x - lag(x) {_W}, x), 6) AS d FROM frames) SELECT * FROM t")
def first_difference(spark, sf):
    return rounded(frames(spark, sf).select("event_id", W.difference("x", KEYS).alias("d")), "d")


@query("pre_emphasis", f", t AS (SELECT event_id, round(coalesce(x - 0.97 * lag(x) {_W}, x), 6) AS d FROM frames) SELECT * FROM t")
def pre_emphasis(spark, sf):
    return rounded(frames(spark, sf).select("event_id", W.difference("x", KEYS, weight=0.97).alias("d")), "d")


@query("cmn", ", t AS (SELECT event_id, round(x - avg(x) OVER (PARTITION BY file_id), 9) AS d FROM frames) SELECT * FROM t")
def cmn(spark, sf):
    return rounded(frames(spark, sf).select("event_id", W.mean_removed("x", KEYS).alias("d")), "d", digits=9)


@query(
    "adaptive_threshold",
    """, o AS (SELECT event_id, file_id, x, row_number() OVER (PARTITION BY file_id ORDER BY fli) - 1 AS k FROM frames),
    s AS (SELECT a.event_id, a.k, sum(b.x) AS s FROM o a JOIN o b ON a.file_id = b.file_id AND b.k <= a.k AND b.k > a.k - least(4, a.k) GROUP BY ALL)
    SELECT event_id, round(coalesce(1.2 * s / least(4, o.k), 0), 6) AS d FROM o LEFT JOIN s USING (event_id)""",
)
def adaptive_threshold(spark, sf):
    return rounded(frames(spark, sf).select("event_id", W.adaptive_threshold("x", KEYS).alias("d")), "d")


@query(
    "median_smooth",
    f""", t AS (SELECT event_id, x, lag(x) {_W} AS a, lead(x) {_W} AS c FROM frames)
    SELECT event_id, CASE WHEN a IS NULL OR c IS NULL THEN x ELSE list_sort([a, x, c])[2] END AS d FROM t""",
)
def median_smooth(spark, sf):
    return frames(spark, sf).select("event_id", W.median3("x", KEYS).alias("d"))


@query(
    "label_smoothing",
    f""", t AS (SELECT event_id, event_type AS l, lag(event_type) {_W} AS a, lead(event_type) {_W} AS c FROM frames)
    SELECT event_id, CASE WHEN l <> a AND l <> c AND l <> 'error' THEN a ELSE l END AS label FROM t""",
)
def label_smoothing(spark, sf):
    return frames(spark, sf).select("event_id", W.smoothed("event_type", KEYS, keep=["error"]).alias("label"))


@query("minmax_scale", ", t AS (SELECT event_id, min(x) OVER (PARTITION BY file_id) AS a, max(x) OVER (PARTITION BY file_id) AS b, x FROM frames) SELECT event_id, round(CASE WHEN b > a THEN (x - a) / (b - a) END, 6) AS d FROM t")
def minmax_scale(spark, sf):
    return rounded(frames(spark, sf).select("event_id", W.scaled("x", KEYS).alias("d")), "d")


@query("zscore", ", t AS (SELECT event_id, round((x - avg(x) OVER (PARTITION BY file_id)) / stddev_samp(x) OVER (PARTITION BY file_id), 6) AS d FROM frames) SELECT * FROM t")
def zscore(spark, sf):
    return rounded(frames(spark, sf).select("event_id", W.standardised("x", KEYS).alias("d")), "d")


@query(
    "subclip_mean_sd",
    """, t AS (SELECT file_id, fli // 10 AS clip, count(*) AS n, avg(x) AS m, stddev_samp(x) AS s FROM frames GROUP BY ALL)
    SELECT file_id, clip, n, round(m, 6) AS x_mean, round(s, 6) AS x_sd FROM t""",
)
def subclip_mean_sd(spark, sf):
    return rounded(W.subclips(frames(spark, sf), 10, ["x"], KEYS), "x_mean", "x_sd")
