"""Join-shaped operators: intervals, owners, nearest rows, pairs and wildcards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.mathx import intersect, magnitude_bin
from framewright.functions.vectors import euclid, squared_error


def interval_join(a: DataFrame, b: DataFrame, keys: list[str], bucket: int, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of overlapping closed intervals with the ``overlap``'s length. Both sides are
    spread over buckets of the axis and meet by an equi-join, in their first common one;
    b's interval columns get the prefix ``b_``."""
    right = b.select(*[F.col(c).alias(c if c in keys else f"b_{c}") for c in b.columns])
    spread = lambda df, s, e: df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor(F.col(e) / bucket))))
    joined = spread(a, start, end).join(spread(right, f"b_{start}", f"b_{end}"), [*keys, "_bucket"])
    once = F.col("_bucket") == F.floor(F.greatest(start, f"b_{start}") / bucket)
    overlap = intersect(F.col(start), F.col(end), F.col(f"b_{start}"), F.col(f"b_{end}"))
    return joined.filter(once & (F.col(start) <= F.col(f"b_{end}")) & (F.col(f"b_{start}") <= F.col(end))).withColumn("overlap", overlap).drop("_bucket")


def owners(hypothesis: DataFrame, truth: DataFrame, keys: list[str], cluster: str, owner: str, bucket: int) -> DataFrame:
    """For each cluster the owner that covers most of it, the lowest of ties."""
    met = interval_join(hypothesis, truth, keys, bucket).groupBy(cluster, f"b_{owner}").agg(F.sum("overlap").alias("covered"))
    return met.groupBy(cluster).agg(
        F.max_by(f"b_{owner}", F.struct(F.col("covered"), -F.col(f"b_{owner}"))).alias("owner"), F.max("covered").alias("covered")
    )


def nearest(rows: DataFrame, templates: DataFrame, vector: str, key: str, name: str, most: int = 4096) -> DataFrame:
    """Each row with its nearest template by squared error, the first of ties. Templates are
    a stated set, gone through in blocks of about ``most``, which are broadcast; the minimum
    is taken within the row, so pairs are never shuffled."""
    best = F.array_min(
        F.transform("_t", lambda t: F.struct(F.round(squared_error(F.col(vector), t["v"]), 9).alias("d"), t["id"].alias("id")))
    )
    for k, block in enumerate(in_blocks(templates, key, most)):
        listed = block.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("id"), F.col(vector).alias("v")))).alias("_t"))
        rows = rows.join(F.broadcast(listed)).withColumn("_n", best).drop("_t")
        rows = rows.withColumn("_b", F.least("_b", "_n") if k else F.col("_n")).drop("_n")
    return rows.withColumn(name, F.col("_b.id")).withColumn("error", F.col("_b.d")).drop("_b")


def in_blocks(rows: DataFrame, key: str, most: int) -> list[DataFrame]:
    """``rows`` in as many parts as leave each about ``most`` rows; one of none at least."""
    count = max(1, -(-rows.count() // most))
    return [rows.filter(F.pmod(F.xxhash64(key), F.lit(count)) == k) for k in range(count)] if count > 1 else [rows]


def pairwise(rows: DataFrame, key: str, vector: str, most: int = 5000) -> DataFrame:
    """The upper triangle of the distances of a stated set of rows, in blocks of about
    ``most`` rows against all: ``a, b, d``."""
    a = rows.select(F.col(key).alias("a"), F.col(vector).alias("_va"))
    done = []
    for block in in_blocks(rows, key, most):
        b = block.select(F.col(key).alias("b"), F.col(vector).alias("_vb"))
        done.append(a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", euclid(F.col("_va"), F.col("_vb")).alias("d")))
    return reduce(DataFrame.union, done)


def distances_from(queries: DataFrame, rows: DataFrame, key: str, vector: str, most: int = 5000) -> DataFrame:
    """``a, b, d``: the distances of a stated set of queries ``a`` from all other rows ``b``,
    in broadcast blocks of about ``most`` queries. A pair of queries is there once, with the
    smaller one as ``a``."""
    marked = rows.join(queries.select(F.col(key).alias("b"), F.lit(True).alias("_too")), F.col(key) == F.col("b"), "left")
    every = marked.select(F.col(key).alias("b"), F.col(vector).alias("_vb"), F.coalesce("_too", F.lit(False)).alias("_too"))
    done = []
    for block in in_blocks(queries, key, most):
        a = F.broadcast(block.select(F.col(key).alias("a"), F.col(vector).alias("_va")))
        once = (F.col("a") < F.col("b")) | (F.col("a") > F.col("b")) & ~F.col("_too")
        done.append(every.join(a, once).select("a", "b", euclid(F.col("_va"), F.col("_vb")).alias("d")))
    return reduce(DataFrame.union, done)


def without_known(parts: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """Segments that are equal to none of ``known``."""
    return parts.join(known.select(*columns).distinct(), columns, "left_anti")


def wildcard(parts: DataFrame, rules: DataFrame, columns: list[str], most: int = 10_000) -> DataFrame:
    """Rules whose columns are equal to the row's or 0; each combination of wildcards is an
    equi-join of its own. Rules without any fixed column apply to all rows; their number is
    checked before they are broadcast."""
    out = None
    for k in range(2 ** len(columns)):
        fixed = [c for j, c in enumerate(columns) if not k >> j & 1]
        free = [c for c in columns if c not in fixed]
        own = rules
        for c in columns:
            own = own.filter(F.col(c) == 0 if c in free else F.col(c) != 0)
        own = own.drop(*free)
        if not fixed and own.count() > most:
            raise ValueError(f"more than {most} rules without a fixed column")
        joined = parts.join(own, fixed) if fixed else parts.join(F.broadcast(own))
        joined = joined.select(*parts.columns, *[c for c in rules.columns if c not in columns])
        out = joined if out is None else out.unionByName(joined)
    return out


def ids_of(rows: DataFrame, name: str, order: Column) -> DataFrame:
    """A dense id for each distinct name, by its first occurrence, from 0. ``order`` is a
    number; names are numbered inside bins of it, on top of the names of the bins before."""
    first = rows.groupBy(name).agg(F.min(order).alias("_o")).withColumn("_b", magnitude_bin(F.col("_o")))
    sizes = first.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))  # a row a bin
    before = sizes.select("_b", (F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy("_o", name)) - 1
    return first.withColumn("_r", own).join(before, "_b").select(name, (F.col("_before") + F.col("_r")).alias("id"))


def matched_boundaries(found: DataFrame, truth: DataFrame, keys: list[str], pos: str, within: int) -> DataFrame:
    """Change-detection matching: of the hypotheses within the tolerance of a true boundary
    the nearest is a hit (``tp``), the others and those far from all are false alarms
    (``fp``), and true boundaries without any are misses (``fn``); counts by file."""
    width = 2 * within + 1
    h = found.select(*keys, F.col(pos).alias("_h"))
    t = truth.select(*keys, F.col(pos).alias("_t"))
    near = (
        h.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_h") - within) / width), F.floor((F.col("_h") + within) / width))))
        .join(t.withColumn("_b", F.floor(F.col("_t") / width)), [*keys, "_b"])
        .filter(F.abs(F.col("_h") - F.col("_t")) <= within)
    )
    own = near.groupBy(*keys, "_h").agg(F.min_by("_t", F.struct(F.abs(F.col("_h") - F.col("_t")), F.col("_t"))).alias("_t"))
    hits = own.groupBy(*keys, "_t").agg(F.lit(1).alias("_tp"))
    a = hits.groupBy(*keys).agg(F.sum("_tp").alias("tp"))
    b = h.groupBy(*keys).agg(F.count(F.lit(1)).alias("_found"))
    c = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("_true"))
    out = b.join(c, keys, "full").join(a, keys, "left").na.fill(0)
    return out.select(*keys, F.col("tp"), (F.col("_found") - F.col("tp")).alias("fp"), (F.col("_true") - F.col("tp")).alias("fn"))
