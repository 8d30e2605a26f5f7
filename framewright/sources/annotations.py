"""Text annotations: phone lists, scene, segment and cut lists, parameters, corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions.strings import comment, key_value


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and place in it; a file is read by one task, in order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def _in_file(order: str = "line_no"):
    return Window.partitionBy("file").orderBy(order)


def read_phones(spark: SparkSession, path: str, silence: str = "h#") -> DataFrame:
    """Phone files (``start end phone``, the end exclusive) as closed intervals; gaps before
    and between the phones are filled with silence: ``file, start, end, phone``."""
    parts = F.split(F.trim("line"), r"\s+")
    rows = _lines(spark, path).filter(F.size(parts) >= 3).select(
        "file", "line_no", parts[0].cast("long").alias("start"), (parts[1].cast("long") - 1).alias("end"), parts[2].alias("phone")
    )
    before = F.coalesce(F.lag("end").over(_in_file()), F.lit(-1))
    gaps = rows.withColumn("_b", before).filter(F.col("start") > F.col("_b") + 1)
    fill = gaps.select("file", (F.col("_b") + 1).alias("start"), (F.col("start") - 1).alias("end"), F.lit(silence).alias("phone"))
    return rows.select("file", "start", "end", "phone").unionByName(fill)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A list of signal paths, with the speaker's name and sex from the directory name:
    ``file, line_no, path, speaker, sex``."""
    rows = _lines(spark, path).filter(F.trim("line") != "")
    name = F.regexp_extract("line", r"([^/\\]+)[/\\][^/\\]*$", 1)
    return rows.select("file", "line_no", F.trim("line").alias("path"), name.alias("speaker"), F.lower(F.substring(name, 1, 1)).alias("sex"))


def offsets(files: DataFrame, order: str, length: str) -> DataFrame:
    """Start and end of each file on the axis of all, one after the other."""
    w = Window.orderBy(order)  # a row per file
    end = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return files.withColumn("start", end - F.col(length)).withColumn("end", end - 1)


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Video frames of scene changes; lines that don't begin with a digit are left out, and
    so are those that don't increase: ``file, video_frame, ordered``."""
    rows = _lines(spark, path).filter(F.col("line").rlike(r"^[0-9]"))
    frame = F.regexp_extract("line", r"^([0-9]+)", 1).cast("long")
    rows = rows.select("file", "line_no", frame.alias("video_frame"))
    most = F.max("video_frame").over(_in_file().rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("file", "video_frame", F.coalesce(F.col("video_frame") > most, F.lit(True)).alias("ordered"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """``boundary type #speaker`` lines: segments that end at the boundary, 0 for speech; the
    last named speaker holds on: ``file, start, end, speech, speaker, new_speaker``."""
    parts = F.split(F.trim(F.regexp_replace("line", "#.*$", "")), r"\s+")
    rows = _lines(spark, path).filter(F.col("line").rlike(r"^\s*[0-9]")).select(
        "file", "line_no", parts[0].cast("long").alias("end"), (F.get(parts, F.lit(1)) == "0").alias("speech"),
        F.when(F.trim(comment(F.col("line"))) != "", F.trim(comment(F.col("line")))).alias("named"),
    )
    w = _in_file()
    rows = rows.withColumn("start", F.coalesce(F.lag("end").over(w) + 1, F.lit(0)))
    rows = rows.withColumn("speaker", F.last("named", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("new_speaker", F.col("speaker").isNotNull() & ~F.lag("speaker").over(w).eqNullSafe(F.col("speaker")))
    return rows.select("file", "start", "end", "speech", "speaker", "new_speaker")


def read_cuts(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``start end length type`` lines of shots."""
    parts = F.split("line", "\t")
    rows = _lines(spark, path).filter(parts[0].rlike(r"^[0-9]+$"))
    return rows.select("file", parts[0].cast("long").alias("start"), F.get(parts, F.lit(1)).cast("long").alias("end"), F.get(parts, F.lit(3)).alias("type"))


def read_parameters(spark: SparkSession, path: str) -> dict[str, str]:
    """``key=value`` lines without comments; the last of a key holds."""
    rows = _lines(spark, path).filter(~F.col("line").rlike(r"^\s*[#;]")).select("line_no", key_value(F.col("line")).alias("p"))
    found = rows.filter("p is not null").select("line_no", "p.*").groupBy("key").agg(F.max_by("value", "line_no").alias("value"))
    return {r["key"]: r["value"] for r in found.collect()}


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """``scene segment file`` lines of explicit models; 0 stands for any scene or segment."""
    parts = F.split(F.trim("line"), r"\s+")
    rows = _lines(spark, path).filter(F.col("line").rlike(r"^\s*[0-9]+\s+[0-9]+\s+\S"))
    return rows.select(parts[0].cast("long").alias("scene"), parts[1].cast("long").alias("segment"), parts[2].alias("model"))


def read_labelled_files(spark: SparkSession, path: str) -> DataFrame:
    """Lists of signal files whose one label is the list's own name: ``path, label``."""
    name = F.regexp_extract("file", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    return _lines(spark, path).filter(F.trim("line") != "").select(F.trim("line").alias("path"), name.alias("label"))
