"""Stores of frames, clusters, models and matrices, and tables of labels and features by
shot. Parquet is the format of what is read again, delimited text that of what people read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions import labels as L
from framewright.operators.models import Mixture

MIXTURE = "model string, component int, weight double, mean array<double>, variance array<double>"


def cut_list(spark: SparkSession, cuts: list[int], frames: int) -> tuple[DataFrame, int]:
    """Shots of a list of last frames, ``shot, start, end``, and how many cuts are behind the
    end of the file; those are left out."""
    inside = sorted({c for c in cuts if 0 <= c < frames})
    starts = [0, *[c + 1 for c in inside if c + 1 < frames]]
    rows = [(k, s, (starts[k + 1] if k + 1 < len(starts) else frames) - 1) for k, s in enumerate(starts)] if frames else []
    return spark.createDataFrame(rows, "shot int, start long, end long"), sum(c >= frames for c in cuts)


def selected_samples(samples: DataFrame, frames: DataFrame, wanted: int, unwanted: int, size: int, step: int, keys: list[str], pos: str = "fli", sample: str = "sample") -> DataFrame:
    """Samples that lie in a frame with one of the wanted labels and none of the others. A
    sample is dealt to the frames that contain it, and each is kept once."""
    last = F.floor(F.col(sample) / step)
    first = F.greatest(F.lit(0), F.ceil((F.col(sample) - size + 1) / step))
    dealt = samples.withColumn("_f", F.explode(F.sequence(F.least(first, last), last)))
    kept = frames.filter(L.matches(F.col("mask"), wanted, without=unwanted)).select(*keys, F.col(pos).alias("_f"))
    return dealt.join(kept, [*keys, "_f"], "left_semi").drop("_f").dropDuplicates([*keys, sample])


def frame_list(frames: DataFrame, wanted: int, unwanted: int = 0, truth: str = "truth", mask: str = "mask", speaker: str = "speaker", true_speaker: str = "true_speaker") -> DataFrame:
    """The frames with wanted labels and their four label columns, masks by name."""
    kept = frames.filter(L.matches(F.col(mask), wanted, without=unwanted))
    others = [c for c in frames.columns if c not in (truth, mask, speaker, true_speaker)]
    return kept.select(*others, L.names(F.col(truth)).alias(truth), L.names(F.col(mask)).alias(mask), true_speaker, speaker)


def write_frames(frames: DataFrame, path: str) -> None:
    """All columns of a frame list, to go on from later."""
    frames.write.mode("overwrite").parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_clusters(members: DataFrame, path: str, number: int) -> None:
    """A partition's members in a folder for its number, which replaces that of before."""
    members.write.mode("overwrite").parquet(f"{path}/partition={number}")


def read_clusters(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """``partition`` and the members' columns of one or all stored partitions."""
    rows = spark.read.parquet(path)
    return rows if number is None else rows.filter(F.col("partition") == number)


def write_mixtures(spark: SparkSession, models: dict[str, Mixture], path: str) -> None:
    rows = [(n, k, m.weights[k], list(m.means[k]), list(m.variances[k])) for n, m in models.items() for k in range(len(m.weights))]
    spark.createDataFrame(rows, MIXTURE).coalesce(1).write.mode("overwrite").parquet(path)


def read_mixture(spark: SparkSession, path: str, model: str) -> Mixture:
    """One named model, of as many rows as it has components."""
    got = spark.read.schema(MIXTURE).parquet(path).filter(F.col("model") == model).orderBy("component").collect()
    if not got:
        raise ValueError(f"no model {model}")
    return Mixture(tuple(r["weight"] for r in got), tuple(tuple(r["mean"]) for r in got), tuple(tuple(r["variance"]) for r in got))


def heaviest_first(model: Mixture) -> Mixture:
    """The same mixture with its components by descending weight, the first of ties first."""
    order = sorted(range(len(model.weights)), key=lambda k: -model.weights[k])
    return Mixture(*(tuple(part[k] for k in order) for part in (model.weights, model.means, model.variances)))


def write_matrix(rows: DataFrame, path: str, row: str, values: str) -> None:
    """A matrix as text: the row's number and its values, parted by tabs."""
    text = F.concat_ws("\t", F.col(row).cast("string"), F.concat_ws("\t", F.transform(values, lambda v: v.cast("string"))))
    rows.select(text.alias("value")).write.mode("overwrite").text(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``row, v``; a value that is no number is null."""
    parts = F.split("value", "\t")
    numbers = F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda v: v.try_cast("double"))
    return spark.read.text(path).select(F.get(parts, F.lit(0)).cast("long").alias("row"), numbers.alias("v"))


def transposed(rows: DataFrame, row: str, values: str) -> DataFrame:
    """``row, v`` of the transposed matrix. A row of the result holds as many values as the
    matrix has rows, so the matrix is long in one direction only."""
    parts = rows.select(F.col(row).alias("_r"), F.posexplode(values).alias("row", "_v"))
    one = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("_r", "_v"))).alias("_a"))
    return one.select(F.col("row").cast("long").alias("row"), F.col("_a._v").alias("v"))


def by_shot(features: DataFrame, shot: Column, keys: list[str], dims: int, values: str = "feat") -> DataFrame:
    """Mean and deviation of each dimension of a feature in each shot, one column each."""
    at = lambda d: F.get(F.col(values), F.lit(d)).cast("double")
    stats = [g(at(d)).alias(f"{n}_{d}") for d in range(dims) for n, g in (("mean", F.avg), ("sd", F.stddev_samp))]
    return features.groupBy(*keys, shot.alias("shot")).agg(F.count(F.lit(1)).alias("frames"), *stats)


def by_frame(frames: DataFrame, names: list[str], keys: list[str], pos: str = "fli", speaker: str | None = None) -> DataFrame:
    """A 0/1 column for each named label and, if asked for, the speaker, by frame."""
    more = [speaker] if speaker else []
    return frames.select(*keys, pos, *[L.has_any(F.col("mask"), L.MASK[n]).cast("int").alias(n) for n in names], *more)


def write_table(rows: DataFrame, path: str) -> None:
    """Delimited text with a header, in as many files as the table has partitions."""
    rows.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def virtual_axis(files: DataFrame, order: str, length: str) -> DataFrame:
    """``start, end`` of each file on the axis of all files one behind the other. ``files`` is
    a list of files, not of samples; its running sum is one sorted partition."""
    upto = F.sum(length).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return files.withColumn("end", upto - 1).withColumn("start", F.col("end") - F.col(length) + 1)
