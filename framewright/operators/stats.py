"""Aggregations: moments, order statistics, modes, histograms, thresholds, densities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentiles(rows: DataFrame, x: str, wanted: dict[int, Column], keys: list[str], most: int = 10_000) -> DataFrame:
    """``keys, p, value``: for each p the value whose rank, from 1, is ``wanted[p]``, an
    expression of the row count ``_n``. Rows are counted in bins of their size first, which
    tells the bin of each rank; only the rows of those bins are ranked by value then. The
    bins found are broadcast if they are at most ``most``, and joined otherwise."""
    from framewright.functions.mathx import magnitude_bin

    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    kept = rows.filter(F.col(x).isNotNull()).select(*keys, F.col(x).alias("value"), magnitude_bin(F.col(x)).alias("_b"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    bins = kept.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_s"))
    bins = bins.withColumn("_n", F.sum("_s").over(w)).withColumn("_upto", F.sum("_s").over(w.orderBy("_b")))
    asked = F.array(*[F.struct(F.lit(p).alias("p"), r.cast("long").alias("rank")) for p, r in wanted.items()])
    bins = bins.withColumn("_q", F.filter(asked, lambda q: (q["rank"] <= F.col("_upto")) & (q["rank"] > F.col("_upto") - F.col("_s"))))
    found = bins.filter(F.size("_q") > 0).select(*named, F.col("_b").alias("_found"), "_q", (F.col("_upto") - F.col("_s")).alias("_before"))
    few = found.limit(most + 1).collect()
    if len(few) <= most:
        found = F.broadcast(rows.sparkSession.createDataFrame(few, found.schema))
    same = F.col("_b") == F.col("_found")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    counted = kept.join(found, same).groupBy(*keys, "_b", "value").agg(F.count(F.lit(1)).alias("_c"), F.first("_q").alias("_q"), F.first("_before").alias("_before"))
    inside = counted.withColumn("_u", F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("value")))
    hit = F.filter("_q", lambda q: (q["rank"] <= F.col("_u")) & (q["rank"] > F.col("_u") - F.col("_c")))
    return inside.select(*keys, F.explode(hit).alias("_h"), "value").select(*keys, F.col("_h.p").alias("p"), "value")


def nearest_rank(p: float) -> Column:
    return F.greatest(F.lit(1.0), F.round(F.col("_n") * (p / 100)))


def percentile(rows: DataFrame, x: str, p: float, keys: list[str]) -> DataFrame:
    """Nearest-rank percentile: the value of rank max(1, round(n * p / 100)), unlike
    interpolation."""
    return percentiles(rows, x, {0: nearest_rank(p)}, keys).drop("p")


def all_percentiles(rows: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """``keys, p, value`` for p from 0 to 100, by rank max(1, p * n div 100)."""
    return percentiles(rows, x, {p: F.greatest(F.lit(1), F.floor(F.col("_n") * p / 100)) for p in range(101)}, keys)


def without_outliers(rows: DataFrame, x: str, keys: list[str], fence: float = 1.5) -> DataFrame:
    """Rows whose value is within ``fence`` quartile distances (1.5: without mild outliers,
    3: without extreme ones) of the quartiles, which are nearest-rank."""
    from functools import reduce as fold

    q = percentiles(rows, x, {25: nearest_rank(25), 75: nearest_rank(75)}, keys)
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
    bounds = q.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(at(25).alias("_lo"), at(75).alias("_hi"))
    span = (F.col("_hi") - F.col("_lo")) * fence
    same = fold(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))
    near = F.col(x).between(F.col("_lo") - span, F.col("_hi") + span)
    return rows.join(bounds, same & near).select(*rows.columns)


def thinned_evenly(rows: DataFrame, pos: Column, percent: float) -> DataFrame:
    """That share of the rows, spread evenly over the axis; a filter, without a shuffle."""
    return rows.filter(F.floor((pos + 1) * (percent / 100)) > F.floor(pos * (percent / 100)))


def training_subset(rows: DataFrame, key: str, most: int, salt: str = "") -> DataFrame:
    """At most ``most`` rows, drawn by the hash of their key, so a lost task draws the same
    again. For learners that hold their training set; the bound is their parameter."""
    from framewright.functions.mathx import uniform

    return rows.orderBy(uniform(F.col(key), salt=salt), key).limit(most)


def pareto_radius(distances: DataFrame, d: str) -> DataFrame:
    """The radius of density estimation in one dimension: the 18th percentile of the
    distances of all pairs, the least distance above 0 if that is 0, 1 without any."""
    at = percentiles(distances, d, {18: nearest_rank(18)}, []).select(F.col("value").alias("_at"))
    least = distances.agg(F.min(F.when(F.col(d) > 0, F.col(d))).alias("_least"))  # one row
    joined = least.join(F.broadcast(at), how="left")  # one row
    return joined.select(F.coalesce(F.when(F.col("_at") > 0, F.col("_at")), F.col("_least"), F.lit(1.0)).cast("double").alias("radius"))


def mode(rows: DataFrame, value: str, keys: list[str], ignore=()) -> DataFrame:
    """The most frequent value, the lowest of ties."""
    kept = rows.filter(~F.col(value).isin(*ignore)) if ignore else rows
    counted = kept.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("n"), -F.col(value))).alias("mode"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return best.select(*keys, "mode", "n", (F.col("n") / F.col("total")).alias("share"))


def label_mode(frames: DataFrame, mask: str, bits: list[int], keys: list[str]) -> DataFrame:
    """The bit that most frames have, the lowest of ties, and its share of all set bits."""
    sums = [F.sum(F.getbit(F.col(mask), F.lit(b)).cast("long")).alias(f"b{b}") for b in bits]
    one = frames.groupBy(*keys).agg(*sums)
    most = F.greatest(*[F.col(f"b{b}") for b in bits])
    first = F.coalesce(*[F.when(F.col(f"b{b}") == most, F.lit(b)) for b in sorted(bits)])
    total = sum((F.col(f"b{b}") for b in bits[1:]), F.col(f"b{bits[0]}"))
    return one.select(*keys, first.alias("bit"), most.alias("n"), (most / total).alias("share"))


def covariances(rows: DataFrame, vector: str, dims: list[int], keys: list[str]) -> DataFrame:
    """Sample covariances of pairs of a vector's dimensions: ``i, j, cov`` for i <= j. One
    pass, one mergeable aggregate a pair."""
    pairs = [(i, j) for i in dims for j in dims if i <= j]
    at = lambda k: F.get(F.col(vector), F.lit(k)).cast("double")
    aggs = [F.covar_samp(at(i), at(j)).alias(f"c{i}_{j}") for i, j in pairs]
    wide = rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)
    long = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("cov")) for i, j in pairs])
    return wide.select(*keys, F.explode(long).alias("_p")).select(*keys, "_p.*")


def column_stats(rows: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    """Per dimension of a vector: n, mean, sample deviation, minimum and maximum."""
    parts = rows.select(*keys, F.posexplode(vector).alias("dim", "_x"))
    x = F.col("_x").cast("double")
    return parts.groupBy(*keys, "dim").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high")
    )


def histogram(rows: DataFrame, x: str, bins: int, keys: list[str]) -> DataFrame:
    """Equal-width bins from 0 with count and mean; the largest value is in the last bin. A
    mean is the same in whatever order its rows come: decimals are added, which is exact to
    18 places, after scaling by a power of two where a group's values are very large or small;
    and it is no less than its least value and no more than its largest."""
    bounds = rows.groupBy(*keys).agg(F.min(x).alias("_low"), F.max(x).alias("_high"))
    joined = rows.join(bounds, keys) if keys else rows.crossJoin(F.broadcast(bounds))  # one row
    place = F.floor((F.col(x) - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins)
    place = F.when(F.col("_high") > F.col("_low"), F.least(place, F.lit(bins - 1))).otherwise(F.lit(0))
    top = F.greatest(F.abs("_low"), F.abs("_high")).cast("double")
    scale = F.when((top == 0) | top.between(1e-3, 1e9), 1.0).otherwise(F.pow(F.lit(2.0), F.least(-F.floor(F.log2(top)), F.lit(1000))))
    mean = F.avg((F.col(x).cast("double") * scale).try_cast("decimal(28,18)")).cast("double") / F.max(scale)
    mean = F.least(F.greatest(mean, F.min(F.col(x).cast("double"))), F.max(F.col(x).cast("double")))
    return joined.groupBy(*keys, place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), mean.alias("mean"))


def otsu(bins: DataFrame, keys: list[str], total_bins: int) -> DataFrame:
    """The bin that best divides a histogram in two: the first maximum of
    (m * w - m_k)^2 / (w * (1 - w) + eps) over the cumulative weight w and mean m_k."""
    whole = Window.partitionBy(*keys)
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    p = F.col("n") / F.sum("n").over(whole)
    parts = bins.withColumn("_p", p)
    parts = parts.withColumn("_m", F.sum(F.col("_p") * (F.col("bin") + 1)).over(whole))
    parts = parts.withColumn("_w", F.sum("_p").over(upto)).withColumn("_k", F.sum(F.col("_p") * (F.col("bin") + 1)).over(upto))
    gap = F.col("_m") * F.col("_w") - F.col("_k")
    parts = parts.withColumn("_v", F.round(gap * gap / (F.col("_w") * (1 - F.col("_w")) + 1e-9), 9))
    best = parts.groupBy(*keys).agg(F.max_by("bin", F.struct(F.col("_v"), -F.col("bin"))).alias("threshold_bin"), F.max("_v").alias("variance"))
    return best


def pareto_density(rows: DataFrame, vector: str, key: str, radius: float, others: DataFrame, block: int = 4096) -> DataFrame:
    """The share of all rows within a radius of each of a stated set of query rows
    (``others``). The queries are broadcast in blocks of about ``block``."""
    from framewright.functions.vectors import squared_error
    from framewright.operators.joins import in_blocks

    n, done = rows.count(), []
    for part in in_blocks(others, key, block):
        asked = part.select(F.col(key).alias("query"), F.col(vector).alias("_q"))
        near = rows.join(F.broadcast(asked), squared_error(F.col(vector), F.col("_q")) <= radius * radius)
        done.append(near.groupBy("query").agg((F.count(F.lit(1)) / F.lit(n)).alias("density")))
    return reduce(DataFrame.union, done)


def snr(signal: Column, noise: Column) -> Column:
    """10 * log10 of the ratio of summed squares, 120 without noise; as an aggregate."""
    s, n = F.sum(signal * signal), F.sum(noise * noise)
    return F.when(n > 0, 10 * F.log10(s / n)).otherwise(F.lit(120.0))
