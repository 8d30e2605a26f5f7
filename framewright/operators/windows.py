"""Ordered window computations on feature columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(keys: list[str], pos: str):
    return Window.partitionBy(*keys).orderBy(pos)


def delta(x: str, keys: list[str], pos: str = "fli", reach: int = 3) -> Column:
    """Sum of k * x[t + k] for k of -3 to 3; the plain difference near the ends, and the
    first row itself."""
    w = _by(keys, pos)
    inside = F.lag(x, reach).over(w).isNotNull() & F.lead(x, reach).over(w).isNotNull()
    slope = sum((F.lead(x, k).over(w) - F.lag(x, k).over(w)) * k for k in range(1, reach + 1))
    return F.when(inside, slope).otherwise(F.coalesce(F.col(x) - F.lag(x).over(w), F.col(x)))


def difference(x: str, keys: list[str], pos: str = "fli", weight: float = 1.0) -> Column:
    """x[t] - weight * x[t - 1]; the first row is kept. Pre-emphasis is this with 0.97."""
    return F.coalesce(F.col(x) - weight * F.lag(x).over(_by(keys, pos)), F.col(x))


def mean_removed(x: str, keys: list[str]) -> Column:
    return F.col(x) - F.avg(x).over(Window.partitionBy(*keys))


def standardised(x: str, keys: list[str]) -> Column:
    w = Window.partitionBy(*keys)
    return (F.col(x) - F.avg(x).over(w)) / F.stddev_samp(x).over(w)


def scaled(x: str, keys: list[str], factor: float = 1.0) -> Column:
    """(x - min) / (max - min), times a factor; null for a constant column."""
    w = Window.partitionBy(*keys)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high > low, (F.col(x) - low) / (high - low) * factor)


def adaptive_threshold(d: str, keys: list[str], pos: str = "fli", alpha: float = 1.2, most: int = 4) -> Column:
    """alpha times the mean of the last distances, at most ``most`` of them and none of a
    row's own index of 0: as many as rows come before; 0 for the first row."""
    by = _by(keys, pos)
    before = F.row_number().over(by) - 1
    total = F.sum(d).over(by.rowsBetween(1 - most, 0))
    first = F.first(d).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(before == 0, 0.0).when(before < most, (total - first) / before).otherwise(total / most) * alpha


def median3(x: str, keys: list[str], pos: str = "fli") -> Column:
    """Median of a value and its neighbours; the ends are kept."""
    w = _by(keys, pos)
    a, b, c = F.lag(x).over(w), F.col(x), F.lead(x).over(w)
    middle = F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
    return F.when(a.isNull() | c.isNull(), b).otherwise(middle)


def smoothed(label: str, keys: list[str], pos: str = "fli", keep=()) -> Column:
    """A label that differs from both neighbours takes its predecessor's; ``keep`` stay."""
    w = _by(keys, pos)
    before, after = F.lag(label).over(w), F.lead(label).over(w)
    odd = (F.col(label) != before) & (F.col(label) != after) & ~F.col(label).isin(*keep)
    return F.when(odd, before).otherwise(F.col(label))


def subclips(frames: DataFrame, length: int, columns: list[str], keys: list[str], pos: str = "fli") -> DataFrame:
    """Tumbling blocks of frames: mean and sample deviation of each column."""
    stats = []
    for c in columns:
        stats += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd")]
    return frames.groupBy(*keys, F.floor(F.col(pos) / length).alias("clip")).agg(F.count(F.lit(1)).alias("n"), *stats)


def framed(frames: DataFrame, x: str, size: int, step: int, keys: list[str], pos: str = "fli") -> DataFrame:
    """Sliding frames of a signal that lies one sample a row: each sample goes to the frames
    that it is in, and a frame is put together from its ``size`` samples. No file is
    collected as a whole."""
    first = F.greatest(F.lit(0), F.floor((F.col(pos) - size) / step) + 1)
    last = F.floor(F.col(pos) / step)
    rows = frames.select(*keys, F.col(pos).alias("_p"), F.col(x).alias("_x"), F.explode(F.sequence(first, last)).alias("frame"))
    grouped = rows.groupBy(*keys, "frame").agg(F.array_sort(F.collect_list(F.struct("_p", "_x"))).alias("_s"))
    full = grouped.filter(F.size("_s") == size)
    return full.select(*keys, "frame", F.transform("_s", lambda s: s["_x"]).alias("samples"))


def context(frames: DataFrame, x: str, length: int, keys: list[str], pos: str = "fli") -> DataFrame:
    """Trajectories: each row with the ``length - 1`` values that follow, whole ones only."""
    w = _by(keys, pos).rowsBetween(0, length - 1)
    return frames.withColumn("trajectory", F.collect_list(x).over(w)).filter(F.size("trajectory") == length)
