"""Control of agglomerative clustering: when to go on merging, which partition to take, and
baselines. A partition table has a row for each step of a key's merging: ``step`` from 0,
``clusters``, and the global ``criterion`` that led to the step (null for step 0)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import mathx

RULES = ("criterion", "always", "never", "knowledge", "optimal", "tuned")


def goes_on(rule: str, criterion: Column, clusters: Column, speakers: Column, kind: str = "bic") -> Column:
    """Whether merging continues: ``criterion`` stops at a negative BIC and with any other
    kind makes all partitions, ``knowledge`` stops at the true number of speakers."""
    if rule not in RULES:
        raise ValueError(f"no rule {rule}")
    if rule == "criterion" and kind == "bic":
        return F.coalesce(criterion >= 0, F.lit(True))
    if rule == "knowledge":
        return clusters > speakers
    return F.lit(rule != "never")


def final_step(partitions: DataFrame, keys: list[str], kind: str = "last", threshold: float = 0.0, error: str = "error") -> DataFrame:
    """``keys, step, last``: the partition to take. ``last``: the last one; ``wcd``: that
    before the least criterion; ``icr``: the last whose criterion is under the threshold, or
    else the first; ``error``: that of the least error. Of ties, the first."""
    step, c = F.col("step"), F.col("criterion")
    chosen = {
        "last": F.max(step),
        "wcd": F.coalesce(F.min_by(step - 1, F.when(step > 0, F.struct(c, step))), F.lit(0)),
        "icr": F.coalesce(F.max(F.when((step > 0) & (c < threshold), step)), F.lit(0)),
        "error": F.min_by(step, F.struct(F.col(error), step)),
    }[kind]
    return partitions.groupBy(*keys).agg(chosen.cast("long").alias("step"), F.max(step).cast("long").alias("last"))


def tuned_penalty(partitions: DataFrame, keys: list[str], gain: str = "gain", cost: str = "cost", error: str = "error") -> DataFrame:
    """The penalty factor for which the criterion ``gain - factor * cost`` stops at the
    partition of least error among those it can stop at: ``keys, step, over``; any factor
    just over ``over`` does, and none is needed (null) for the last partition. A step can be
    stopped at if its successor's ratio is under all before."""
    w = Window.partitionBy(*keys).orderBy("step")
    ratio = F.when(F.col("step") > 0, F.col(gain) / F.col(cost))
    r = partitions.withColumn("_r", ratio)
    r = r.withColumn("_least", F.min("_r").over(w)).withColumn("_next", F.lead("_r").over(w)).withColumn("_last", F.lead("step").over(w).isNull())
    open_ = F.col("_last") | F.col("_least").isNull() | (F.col("_next") < F.col("_least"))
    best = F.min_by(F.struct("step", "_next"), F.when(open_, F.struct(F.col(error), F.col("step"))))
    return r.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.step").cast("long").alias("step"), F.col("_b._next").alias("over"))


def specific_step(final: Column, last: Column, specificity: float) -> Column:
    """A step moved towards fewer (over 0.5) or more clusters than the final one."""
    if specificity == 0.5:
        return final
    place = F.when(F.lit(specificity) < 0.5, final * (2 * specificity)).otherwise(final + (last - final) * (2 * specificity - 1))
    near = F.ceil(place) if specificity > 0.5 else F.floor(place)
    return F.greatest(F.lit(0), F.least(near, last)).cast("long")


def own_frames(frames: DataFrame, cluster: str, x: str, block: int = 4096) -> DataFrame:
    """Frames whose likeliest Gaussian, among those of all clusters, is that of their own
    cluster; a cluster without a spread is likeliest nowhere. The clusters' models are
    broadcast in blocks, and the best is kept in the row."""
    from framewright.operators.joins import in_blocks

    models = frames.groupBy(F.col(cluster).alias("_c")).agg(F.avg(x).alias("_m"), F.var_samp(x).alias("_v")).filter("_v > 0")
    out = frames
    for k, part in enumerate(in_blocks(models, "_c", block)):
        listed = part.agg(F.array_sort(F.collect_list(F.struct("_c", "_m", "_v"))).alias("_models"))  # one row of a block
        score = F.transform("_models", lambda m: F.struct(F.round(-mathx.gauss_log_pdf(F.col(x), m["_m"], m["_v"]), 9).alias("d"), m["_c"].alias("c")))
        out = out.join(F.broadcast(listed)).withColumn("_now", F.array_min(score)).drop("_models")
        out = out.withColumn("_best", F.least("_best", "_now") if k else F.col("_now")).drop("_now")
    return out.filter(F.col("_best.c") == F.col(cluster)).drop("_best")


def random_baseline(segments: DataFrame, key: str, owner: str, sizes: list[float], repeats: int) -> DataFrame:
    """The purity that clusters drawn at random, in proportion to ``sizes``, would have:
    ``repeat, purity`` for each of a stated number of draws."""
    drawn = segments.select(key, owner, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long"))).alias("repeat"))
    drawn = drawn.withColumn("_c", mathx.categorical(sizes, F.col(key), F.col("repeat"), salt="cluster"))
    one = drawn.groupBy("repeat", "_c", owner).agg(F.count(F.lit(1)).alias("_n"))
    top = one.groupBy("repeat", "_c").agg(F.max("_n").alias("_m"), F.sum("_n").alias("_a"))
    return top.groupBy("repeat").agg((F.sum("_m") / F.sum("_a")).alias("purity"))
