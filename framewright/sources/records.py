"""Feature records and result tables: Parquet in place of binary record files, and text
exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import labels as L

SCHEMA = "file_id bigint, feature string, seg_no int, frame bigint, frame_size int, frame_step int, feat array<double>"


def write_records(features: DataFrame, path: str, mode: str = "append") -> None:
    """Feature rows, in a folder for each feature, so that readers skip the others."""
    features.write.mode(mode).partitionBy("feature").parquet(path)


def read_records(spark: SparkSession, path: str, feature: str | None = None) -> DataFrame:
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows if feature is None else rows.filter(F.col("feature") == feature)


def row_counts(records: DataFrame) -> DataFrame:
    """Rows and width of each feature; -1 if its widths differ."""
    width = F.when(F.min(F.size("feat")) == F.max(F.size("feat")), F.max(F.size("feat"))).otherwise(-1)
    return records.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), width.alias("width"))


def combined(records: DataFrame, features: list[str]) -> DataFrame:
    """Horizontal concatenation by file and frame of several features, in their order; only
    frames that all of them have."""
    wide = records.filter(F.col("feature").isin(features)).groupBy("file_id", "frame").agg(
        *[F.first(F.when(F.col("feature") == f, F.col("feat")), ignorenulls=True).alias(f"_{k}") for k, f in enumerate(features)]
    )
    whole = F.concat(*[F.col(f"_{k}") for k in range(len(features))])
    return wide.select("file_id", "frame", whole.alias("feat")).filter("feat is not null")


def export_features(records: DataFrame, path: str) -> None:
    """``file_id, start, end`` in samples and the columns of a feature, as delimited text."""
    start = F.col("frame") * F.col("frame_step")
    values = F.concat_ws(" ", F.transform("feat", lambda v: v.cast("string")))
    rows = records.select("file_id", start.alias("start"), (start + F.col("frame_size") - 1).alias("end"), values.alias("values"))
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def analysis_columns(frames: DataFrame, mask: str = "mask") -> DataFrame:
    """A 0/1 column for each label, named by it."""
    return frames.select("*", *[L.has_any(F.col(mask), m).cast("int").alias(n) for n, m in L.MASK.items()])


def video_results(frames: DataFrame, keys: list[str], pos: str, per_video_frame: int, speaker: str = "speaker") -> DataFrame:
    """Per video frame: the labels that all of its frames have, and the speaker that most
    have, the lowest of ties."""
    slot = F.floor(F.col(pos) / per_video_frame).alias("video_frame")
    masks = frames.groupBy(*keys, slot).agg(F.bit_and("mask").alias("mask"))
    counted = frames.filter(F.col(speaker) != L.NO_SPEAKER).groupBy(*keys, slot, speaker).agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy(*keys, "video_frame").agg(F.max_by(speaker, F.struct(F.col("n"), -F.col(speaker))).alias(speaker))
    return masks.join(best, [*keys, "video_frame"], "left").na.fill(L.NO_SPEAKER, [speaker])


def segment_statistics(frames: DataFrame, segment: str, wanted: int, keys: list[str], step: int = 1) -> DataFrame:
    """Gross and net length of each segment, in samples: all frames, and those with the
    wanted labels."""
    hit = L.has_any(F.col("mask"), wanted)
    return frames.groupBy(*keys, segment).agg((F.count(F.lit(1)) * step).alias("gross"), (F.count_if(hit) * step).alias("net"))


def export_by_speaker(frames: DataFrame, path: str, speaker: str = "speaker") -> None:
    """Voiced speech frames, without pauses, in a folder for each speaker."""
    kept = L.matches(F.col("mask"), L.MASK["speech"] | L.MASK["voiced"], unite=True, without=L.MASK["pause"])
    frames.filter(kept & (F.col(speaker) != L.NO_SPEAKER)).write.mode("overwrite").partitionBy(speaker).parquet(path)


def write_report(scores: DataFrame, path: str) -> None:
    """Scores, which are few rows, as one text file with a header."""
    scores.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
