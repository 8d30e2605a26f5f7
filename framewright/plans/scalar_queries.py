"""Scalar functions on columns: time units, mathematics, draws, strings, labels, vectors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from framewright.functions import labels as L
from framewright.functions import mathx, strings
from framewright.functions import timeaxis as T
from framewright.functions import vectors as V
from framewright.plans.base import frames, query, rounded, table


@query(
    "conv_ms_frames",
    """SELECT event_id, event_id * 100 // 16 AS ms, CAST(floor(event_id * 0.25::DOUBLE * 16) AS BIGINT) + 15 AS sample_of_part,
      event_id * 16 * 160 AS of_frame, event_id * 16 // 1600 AS of_ms FROM events""",
)
def conv_ms_frames(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id",
        T.sample_to_ms(e * 100, 16000).alias("ms"),
        T.ms_to_sample_fraction(e * F.lit(0.25), 16000, end=True).alias("sample_of_part"),
        T.frame_to_sample(e * 16, 400, 160).alias("of_frame"),
        T.ms_to_frame(e, 16000, 400, 1600).alias("of_ms"),
    )


@query(
    "conv_video",
    """SELECT event_id, CAST(round(event_id * 100 / 640.0::DOUBLE) AS BIGINT) AS a,
      CASE WHEN event_id * 100 < 640 THEN 0 ELSE CAST(round((event_id * 100 - 640.0::DOUBLE) / 640.0::DOUBLE) AS BIGINT) + 1 END AS b,
      CAST(round(event_id * 640.0::DOUBLE) AS BIGINT) AS c, CAST(round(event_id * 640.0::DOUBLE + 639) AS BIGINT) AS d FROM events""",
)
def conv_video(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id",
        T.sample_to_video_frame(e * 100, 16000, 25.0).alias("a"),
        T.sample_to_video_frame(e * 100, 16000, 25.0, end=True).alias("b"),
        T.video_frame_to_sample(e, 16000, 25.0).alias("c"),
        T.video_frame_to_sample(e, 16000, 25.0, end=True).alias("d"),
    )


@query(
    "conv_frequency",
    """SELECT event_id, least(greatest(CAST(round(value * 100 / 62.5::DOUBLE) AS BIGINT), 0), 128) AS bin,
      round(CASE WHEN value <> 0 THEN 1 / value END, 9) AS quefrency FROM events""",
)
def conv_frequency(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", T.frequency_to_bin(v * 100, 16000, 128).alias("bin"), F.round(T.frequency_to_quefrency(v), 9).alias("quefrency")
    )


@query(
    "math_more",
    """SELECT event_id, CAST(trunc(CASE WHEN value - 50 > 0 THEN value - 50 + 0.5 ELSE value - 50 - 0.5 END) AS BIGINT) AS away,
      round(log2(value + 1), 9) AS two, round(ln(value + 1), 9) AS e, CAST(CASE WHEN value - 50 < 0 THEN -1 ELSE 1 END AS BIGINT) AS sign,
      greatest(20.0::DOUBLE, least(value, 60.0::DOUBLE)) AS within, isfinite(value) AS finite, bit_count(event_id) <= 1 AS power,
      round(greatest(value / 10, 3.0::DOUBLE) + ln(1 + exp(-abs(value / 10 - 3.0::DOUBLE))), 6) AS sum_of_logs FROM events""",
)
def math_more(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id",
        mathx.round_half_away(v - 50).alias("away"),
        F.round(F.log2(v + 1), 9).alias("two"),
        F.round(F.ln(v + 1), 9).alias("e"),
        mathx.sign(v - 50).cast("long").alias("sign"),
        mathx.clamp(20.0, v, 60.0).alias("within"),
        mathx.is_finite(v).alias("finite"),
        mathx.is_power_of_two(F.col("event_id")).alias("power"),
        F.round(mathx.log_add(v / 10, F.lit(3.0)), 6).alias("sum_of_logs"),
    )


@query(
    "binomial",
    """SELECT s_suppkey, CASE WHEN k > n THEN 0.0::DOUBLE ELSE round((factorial(n) / (factorial(k) * factorial(greatest(n - k, 0))))::DOUBLE) END AS n_over_k
    FROM (SELECT s_suppkey, CAST(s_suppkey % 20 AS INT) AS n, CAST(s_suppkey % 9 AS INT) AS k FROM supplier)""",
)
def binomial(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select("s_suppkey", mathx.binomial(k % 20, k % 9).cast("double").alias("n_over_k"))


@query(
    "inverse_sigmoid",
    f"""SELECT event_id, round(CASE WHEN y <= 0.5 THEN 30 * (greatest(w, -1) + 1) + 10 ELSE 40 + 60 * least(w, 1) END, 6) AS x FROM (
      SELECT event_id, value / 100 AS y, -ln(1 / least(greatest(value / 100, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) - 1) / {math.log(1e6 - 1)!r}::DOUBLE AS w FROM events)""",
)
def inverse_sigmoid(spark, sf):
    x = mathx.inverse_sigmoid(F.col("value") / 100, 10.0, 40.0, 100.0)
    return table(spark, sf, "events").select("event_id", F.round(x, 6).alias("x"))


_U = "(('0x' || substr(md5('{salt}:' || event_id), 1, 8))::BIGINT / 4294967296::DOUBLE)"


@query(
    "draws",
    f"""SELECT event_id, round({_U.format(salt='')}, 9) AS uniform,
      round(5 + 2 * sqrt(-2 * ln(1 - {_U.format(salt='u')})) * cos(2 * pi() * {_U.format(salt='v')}), 6) AS normal,
      CAST(CASE WHEN {_U.format(salt='c')} < 0.5 THEN 0 WHEN {_U.format(salt='c')} < 0.75 THEN 1 ELSE 2 END AS BIGINT) AS class FROM events""",
)
def draws(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id",
        F.round(mathx.uniform(e), 9).alias("uniform"),
        F.round(mathx.normal(e, mean=5.0, sd=2.0), 6).alias("normal"),
        mathx.categorical([2.0, 1.0, 1.0], e, salt="c").cast("long").alias("class"),
    )


@query(
    "string_tokens",
    """SELECT c_custkey, trim('  ' || c_name || ' ') AS both, ltrim('  ' || c_name) AS l, rtrim(c_name || '  ') AS r, upper(c_name) AS up, lower(c_name) AS low,
      replace(c_name, '#', '_') AS swapped, split_part(c_name, '#', 1) AS first, TRY_CAST(split_part(c_name, '#', 2) AS BIGINT) AS number,
      substr(c_name, strpos(c_name, '#') + 1) AS comment, md5(c_name) AS checksum FROM customer""",
)
def string_tokens(spark, sf):
    n = F.col("c_name")
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("both"),
        F.ltrim(F.concat(F.lit("  "), n)).alias("l"),
        F.rtrim(F.concat(n, F.lit("  "))).alias("r"),
        F.upper(n).alias("up"),
        F.lower(n).alias("low"),
        strings.replaced(n, "#", "_").alias("swapped"),
        strings.token(n, "#", 1).alias("first"),
        strings.number_token(n, "#", 2, "bigint").alias("number"),
        strings.comment(n).alias("comment"),
        F.md5(n).alias("checksum"),
    )


@query(
    "string_lines",
    """SELECT item_id, CAST(CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + CASE WHEN t LIKE '%' || chr(10) THEN 0 ELSE 1 END END AS BIGINT) AS lines,
      trim(split_part(p, '=', 1)) AS key, trim(substr(p, strpos(p, '=') + 1)) AS value
    FROM (SELECT item_id, replace(text, '. ', chr(10)) AS t, 'item ' || item_id || ' = a=' || item_id AS p FROM benchmark)""",
)
def string_lines(spark, sf):
    pair = strings.key_value(F.concat(F.lit("item "), F.col("item_id"), F.lit(" = a="), F.col("item_id")))
    rows = table(spark, sf, "benchmark").select("item_id", F.replace("text", F.lit(". "), F.lit("\n")).alias("t"), pair.alias("p"))
    return rows.select("item_id", strings.line_count(F.col("t")).cast("long").alias("lines"), F.col("p.key").alias("key"), F.col("p.value").alias("value"))


@query(
    "label_relations",
    f""", t AS (SELECT event_id, mask & {L.OPPOSITE['speech']} <> 0 AS against_speech, mask & {L.OPPOSITE['silence']} <> 0 AS against_silence,
      mask & {sum(m for n, m in L.MASK.items() if L.PARENT.get(n) == 'speech')} <> 0 AS some_speech FROM frames) SELECT * FROM t""",
)
def label_relations(spark, sf):
    m = F.col("mask")
    return frames(spark, sf).select(
        "event_id", L.is_opposite(m, "speech").alias("against_speech"), L.is_opposite(m, "silence").alias("against_silence"), L.below(m, "speech").alias("some_speech")
    )


_AT = [f"embedding[{k}]::DOUBLE" for k in range(1, 9)]
_HANN = V.window("hann", 4)


@query(
    "vector_shapes",
    f"""SELECT vec_id, {_AT[2]} AS picked, {_AT[7]} AS back_first, {_AT[3]} AS turned_first, {_AT[2]} AS turned_last,
      round({' + '.join(f'{a} * {b}' for a, b in zip(_AT, _AT))}, 6) AS power,
      round({_AT[0]} * {_HANN[0]!r}::DOUBLE + 2 * {_AT[1]} * {_HANN[1]!r}::DOUBLE + 3 * {_AT[2]} + 7 * {_AT[6]} * {_HANN[2]!r}::DOUBLE + 8 * {_AT[7]} * {_HANN[3]!r}::DOUBLE, 6) AS tapered FROM embeddings""",
)
def vector_shapes(spark, sf):
    v = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    rows = table(spark, sf, "embeddings").select("vec_id", v.alias("v"))
    edge = V.edge_tapered(F.col("v"), "hann", 8, 0.25)
    at = lambda c, k: F.get(c, F.lit(k))
    turned = V.rotate(F.col("v"), 3)
    out = rows.select(
        "vec_id",
        at(V.select_columns(F.col("v"), [5, 2]), 1).alias("picked"),
        at(V.reverse(F.col("v")), 0).alias("back_first"),
        at(turned, 0).alias("turned_first"),
        at(turned, 7).alias("turned_last"),
        V.dot(F.col("v"), F.col("v")).alias("power"),
        V.dot(F.transform(edge, lambda x, i: F.when(i.isin(3, 4, 5), 0.0).otherwise(x)), F.array(*[F.lit(float(k)) for k in range(1, 9)])).alias("tapered"),
    )
    return rounded(out, "power", "tapered")


@query(
    "dct_round_trip",
    f"SELECT vec_id, {', '.join(f'round({a}, 6) AS x{k}' for k, a in enumerate(_AT))} FROM embeddings",
)
def dct_round_trip(spark, sf):
    """The inverse transform of the transform is the vector."""
    v = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    rows = table(spark, sf, "embeddings").select("vec_id", V.dct(v, 8).alias("d")).select("vec_id", V.idct(F.col("d"), 8).alias("w"))
    names = [f"x{k}" for k in range(8)]
    return rounded(rows.select("vec_id", *[F.get("w", F.lit(k)).alias(n) for k, n in enumerate(names)]), *names)


@query(
    "log_determinants",
    """SELECT label, round(ln(a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)), 6) AS log_det FROM (
      SELECT label, covar_samp(x, x) AS a, covar_samp(x, y) AS b, covar_samp(x, z) AS c, covar_samp(y, y) AS d, covar_samp(y, z) AS e, covar_samp(z, z) AS f
      FROM (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings) GROUP BY label)""",
)
def log_determinants(spark, sf):
    """Of the covariances of each class, from one mergeable aggregate."""
    from framewright.operators import models as M

    one = M.gaussian(table(spark, sf, "embeddings"), "embedding", ["label"], 3)
    return rounded(one.select("label", V.log_determinant(F.col("cov"), 3).alias("log_det")), "log_det")
