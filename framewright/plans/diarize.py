"""Who speaks when: the stages from frames to scored speaker clusters, as one plan.

speech segments between boundaries -> a model for each long enough segment ->
agglomerative clustering within each file -> speakers written back to the frames -> score.
Files are independent of each other, and all stages but the clustering are DataFrame
expressions; a file's segment models, not its frames, are held by one task for that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import labels as L
from framewright.operators import kernels, segmentation
from framewright.operators import runs as R
from framewright.operators import scores as S
from framewright.plans.base import frames, query


@dataclass(frozen=True)
class Parameters:
    """``least``: speech frames of a segment that gets a model; ``stop``: the distance over
    which clusters stay apart; ``linkage``: single, complete or average."""

    least: int = 3
    stop: float = 8.0
    linkage: str = "average"


def cluster_segments(models: DataFrame, keys: list[str], p: Parameters) -> DataFrame:
    """``keys, segment, speaker``: in each file the closest segment models are merged, by
    the distance of their means; a speaker is named by its first segment."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment").reset_index(drop=True)
        mean = pdf["mean"].to_numpy(dtype=float)
        name = np.arange(len(pdf))
        for i, j, _ in kernels.agglomerate(np.abs(np.subtract.outer(mean, mean)), p.linkage, p.stop):
            name[name == j] = i
        out = pdf[[*keys, "segment"]].copy()
        out["speaker"] = pdf["segment"].to_numpy()[name]
        return out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in models.select(*keys).schema.fields)
    return models.groupBy(*keys).applyInPandas(run, f"{fields}, segment bigint, speaker bigint")


def diarized(rows: DataFrame, boundary: Column, speech: Column, x: str, keys: list[str], pos: str, p: Parameters = Parameters()) -> DataFrame:
    """The frames with their ``segment``, ``speaker`` (-1 without) and speaker ``change``."""
    numbered = R.ordinal(rows, boundary, keys, pos, "segment")
    models = segmentation.segment_models(rows, boundary, speech, x, keys, pos, p.least).filter(~F.col("short"))
    speakers = cluster_segments(models.select(*keys, "segment", "mean"), keys, p)
    out = numbered.join(speakers, [*keys, "segment"], "left")
    out = out.withColumn("speaker", F.when(speech, F.col("speaker")).otherwise(F.lit(L.NO_SPEAKER))).na.fill(L.NO_SPEAKER, ["speaker"])
    before = R.previous(F.when(F.col("speaker") != L.NO_SPEAKER, F.col("segment")), keys, pos)
    return out.withColumn("last_segment", before)


@query("diarization")
def diarization(spark, sf):
    f = frames(spark, sf)
    speech = L.has_any(F.col("mask"), L.MASK["speech"])
    out = diarized(f, F.col("event_type") == "signup", speech, "x", ["file_id"], "fli")
    return out.groupBy("file_id", "speaker").agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("segment").alias("segments"))


@query("diarization_scores")
def diarization_scores(spark, sf):
    """Purities of the speakers against the event types of their frames."""
    f = frames(spark, sf)
    speech = L.has_any(F.col("mask"), L.MASK["speech"])
    out = diarized(f, F.col("event_type") == "signup", speech, "x", ["file_id"], "fli").filter("speaker <> -1")
    return S.clustering(S.confusion(out.withColumn("who", F.concat_ws("/", "file_id", "speaker")), "who", "event_type"))
