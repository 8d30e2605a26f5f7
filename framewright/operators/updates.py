"""Updates of labels, speakers and probabilities on frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import labels as L


def set_where(frames: DataFrame, hit: Column, new: Column, mask: str = "mask") -> DataFrame:
    """A new mask where a predicate holds; ``updated`` tells where."""
    return frames.withColumn("updated", hit).withColumn(mask, F.when(F.col("updated"), new).otherwise(F.col(mask)))


def set_ranges(frames: DataFrame, ranges: DataFrame, keys: list[str], pos: str = "fli", bucket: int = 256, mask: str = "mask") -> DataFrame:
    """Adds the labels ``types`` of all closed ranges (``keys, start, end, types``) that
    cover a frame, without clearing any. Ranges are dealt to buckets of the axis, and their
    labels united before they meet the frames."""
    spread = ranges.select(*keys, "start", "end", "types", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))).alias("_b"))
    at = frames.select(*keys, F.col(pos).alias("_p")).withColumn("_b", F.floor(F.col("_p") / bucket))
    met = at.join(spread, [*keys, "_b"]).filter(F.col("_p").between(F.col("start"), F.col("end")))
    union = met.groupBy(*keys, F.col("_p").alias(pos)).agg(F.bit_or("types").alias("_types"))
    out = frames.join(union, [*keys, pos], "left")
    return out.withColumn(mask, F.col(mask).bitwiseOR(F.coalesce("_types", F.lit(0)))).drop("_types")


def set_speaker(frames: DataFrame, hit: Column, speaker: Column, column: str = "speaker") -> DataFrame:
    """A speaker on the frames that are hit and labelled speech."""
    return frames.withColumn(column, F.when(hit & L.has_any(F.col("mask"), L.MASK["speech"]), speaker).otherwise(F.col(column)))


def set_probability(frames: DataFrame, types: int, p: Column, column: str = "probabilities") -> DataFrame:
    """The probability of each label of ``types`` in a map by bit."""
    own = F.map_from_arrays(*[F.array(*x) for x in zip(*[(F.lit(b), p) for b in range(31) if types >> b & 1])])
    old = F.col(column)
    return frames.withColumn(column, F.map_zip_with(old, own, lambda k, a, b: F.coalesce(b, a)))


def homogeneous(frames: DataFrame, keys: list[str], speaker: str = "speaker") -> DataFrame:
    """Whether the speech frames of each segment have one speaker at most."""
    who = F.when(L.has_any(F.col("mask"), L.MASK["speech"]) & (F.col(speaker) != L.NO_SPEAKER), F.col(speaker))
    return frames.groupBy(*keys).agg((F.coalesce(F.min(who) == F.max(who), F.lit(True))).alias("homogeneous"))


def inconsistent(frames: DataFrame, mask: str = "mask") -> DataFrame:
    """Frames with labels that exclude each other, and those labels as ``problem``."""
    return frames.withColumn("problem", L.conflicts(F.col(mask))).filter("problem <> 0")
