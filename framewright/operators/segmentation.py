"""Silence, voicing and change detection over frames, and the score of clusterings by merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import labels as L
from framewright.operators import stats


def silence_by_thresholds(frames: DataFrame, energy: str, crossings: str, energy_most: float = 37.442281, crossings_most: float = 1.710257) -> DataFrame:
    """Marks the frames under both thresholds, and no others, as silence, with a margin as
    ``p_silence``: half the smaller of the two features' margins, plus one half for silence.
    A feature's margin is its relative distance if below its threshold t, else t / feature."""

    def margin(feature: str, most: float) -> Column:
        return F.when(F.col(feature) < most, 1 - F.col(feature) / most).otherwise(F.lit(most) / F.col(feature))

    hit = (F.col(energy) < energy_most) & (F.col(crossings) < crossings_most)
    half = F.least(margin(energy, energy_most), margin(crossings, crossings_most)) / 2
    silence = F.when(hit, L.add_exclusive(F.col("mask"), "silence")).otherwise(L.remove(F.col("mask"), L.MASK["silence"]))
    return frames.withColumn("p_silence", F.when(hit, half + 0.5).otherwise(half)).withColumn("mask", silence)


def silence_by_otsu(frames: DataFrame, energy: str, keys: list[str], bins: int = 10) -> DataFrame:
    """Marks frames whose energy is in a bin up to the file's Otsu threshold as silence."""
    best = stats.otsu(stats.histogram(frames, energy, bins, keys), keys, bins)
    w = Window.partitionBy(*keys)
    low, high = F.min(energy).over(w), F.max(energy).over(w)
    placed = frames.withColumn("_bin", F.when(high > low, F.floor((F.col(energy) - low) / (high - low) * bins)).otherwise(F.lit(bins)))
    out = placed.join(best.select(*keys, "threshold_bin"), keys)
    hit = F.col("_bin") <= F.col("threshold_bin")
    return out.withColumn("mask", F.when(hit, L.add_exclusive(F.col("mask"), "silence")).otherwise(F.col("mask"))).drop("_bin", "threshold_bin")


def otsu_level(rows: DataFrame, x: str, keys: list[str], bins: int) -> DataFrame:
    """``keys, level``: the mean of the bin behind the best division of a histogram, or of
    the next lower bin with a mean above 0, or else of the next higher one."""
    h = stats.histogram(rows, x, bins, keys)
    joined = h.join(stats.otsu(h, keys, bins).withColumn("_t", F.col("threshold_bin") + 1).select(*keys, "_t"), keys)
    some = F.col("mean") > 0
    low = F.max_by("mean", F.when(some & (F.col("bin") <= F.col("_t")), F.col("bin")))
    high = F.min_by("mean", F.when(some & (F.col("bin") > F.col("_t")), F.col("bin")))
    return joined.groupBy(*keys).agg(F.coalesce(low, high).alias("level"))


def voicing_by_otsu(frames: DataFrame, features: list[str], keys: list[str], bins: int = 10) -> DataFrame:
    """Unvoiced speech among the pauses and silence of each file: frames over the Otsu level
    of any feature (energy, crossings) are unvoiced noisy speech, what stays silence is
    nothing else, and other speech but pauses is voiced. ``p_unvoiced`` is the relative
    distance to the last feature's level from above, feature / level below it; null for
    frames that were no candidates."""
    clean = frames.withColumn("mask", L.remove(F.col("mask"), L.MASK["voiced"] | L.MASK["unvoiced"]))
    asked = L.matches(F.col("mask"), L.MASK["pause"] | L.MASK["silence"], without=L.MASK["noise"])
    out, hit = clean.withColumn("_asked", asked), F.lit(False)
    for k, x in enumerate(features):
        level = otsu_level(out.filter("_asked"), x, keys, bins).withColumnRenamed("level", f"_l{k}")
        out = out.join(level, keys, "left")
        hit = hit | (F.col(x) > F.col(f"_l{k}"))
    x, level = F.col(features[-1]), F.col(f"_l{len(features) - 1}")
    out = out.withColumn("p_unvoiced", F.when(F.col("_asked"), F.when(x > level, 1 - level / x).otherwise(x / level)))
    unvoiced = F.col("mask")
    for name in ("speech", "noisySpeech", "unvoiced"):
        unvoiced = L.add_exclusive(unvoiced, name)
    new = F.when(F.col("_asked") & hit, unvoiced).otherwise(F.col("mask"))
    out = out.withColumn("mask", new)
    silent, spoken = L.has_any(F.col("mask"), L.MASK["silence"]), L.matches(F.col("mask"), L.MASK["speech"], without=L.MASK["unvoiced"] | L.MASK["pause"])
    out = out.withColumn("mask", F.when(silent, L.add_exclusive(F.col("mask"), "silence")).when(spoken, L.add_exclusive(F.col("mask"), "voiced")).otherwise(F.col("mask")))
    return out.select(*frames.columns, "p_unvoiced")


def voicing(frames: DataFrame, pitch: Column) -> DataFrame:
    """Speech frames with a pitch are voiced, others unvoiced."""
    speech = L.has_any(F.col("mask"), L.MASK["speech"])
    new = F.when(pitch > 0, L.add_exclusive(F.col("mask"), "voiced")).otherwise(L.add_exclusive(F.col("mask"), "unvoiced"))
    return frames.withColumn("mask", F.when(speech, new).otherwise(F.col("mask")))


def peaks_over_threshold(scores: DataFrame, score: str, keys: list[str], pos: str, alpha: float = 1.2, most: int = 4) -> DataFrame:
    """Changes: local maxima over alpha times the mean of the last scores before them."""
    w = Window.partitionBy(*keys).orderBy(pos)
    bound = F.avg(score).over(w.rowsBetween(-most, -1)) * alpha
    top = (F.col(score) > F.coalesce(F.lag(score).over(w), F.lit(float("-inf")))) & (F.col(score) >= F.coalesce(F.lead(score).over(w), F.lit(float("-inf"))))
    return scores.withColumn("_hit", top & (F.col(score) > bound)).filter("_hit").drop("_hit")


def segment_models(frames: DataFrame, boundary: Column, speech: Column, x: str, keys: list[str], pos: str, least: int) -> DataFrame:
    """One Gaussian for each speaker segment's speech frames, and whether it is too short."""
    w = Window.partitionBy(*keys).orderBy(pos)
    numbered = frames.withColumn("segment", F.sum(F.when(boundary, 1).otherwise(0)).over(w))
    own = numbered.filter(speech).groupBy(*keys, "segment").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.min(pos).alias("start"), F.max(pos).alias("end")
    )
    return own.withColumn("short", F.col("n") < least)


def merge_tree(spark, merges: list[tuple[int, int, float]], leaves: list[int]) -> DataFrame:
    """Members of each merge's result: ``step, leaf``; a step's cluster is the union of the
    two it merged."""
    now, rows = {leaf: [leaf] for leaf in leaves}, []
    for step, (a, b, _) in enumerate(merges):
        now[a] = now[a] + now.pop(b)
        rows += [(step, leaf) for leaf in now[a]]
    return spark.createDataFrame(rows, "step int, leaf long")
