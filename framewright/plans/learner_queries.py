"""Boosted classifiers and the audio-type tree; training has no SQL counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import boosting as B
from framewright.operators import windows as W
from framewright.plans.base import frames, query, table

KEYS = ["file_id"]

#: Silence or sound, speech or not, and the kinds of both.
AUDIO_TYPES = B.Node(
    ("error",),
    ("click", "signup", "view", "purchase"),
    "silence",
    B.Node(
        ("click", "signup"),
        ("view", "purchase"),
        B.Node(("click",), ("signup",), "pureSpeech", "noisySpeech"),
        B.Node(("purchase",), ("view",), "music", "noise"),
    ),
)


def _classes(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", (F.col("label") % 4).cast("int").alias("y"), *[F.get("embedding", F.lit(d)).cast("double").alias(f"x{d}") for d in range(64)])


@query("adaboost_classes")
def adaboost_classes(spark, sf):
    """Stumps over all 64 dimensions that decide between four classes, and their votes."""
    rows = _classes(spark, sf)
    stumps = B.boosted(rows, [f"x{d}" for d in range(64)], "y", rounds=4, bins=32)
    return rows.select("vec_id", "y", B.voted(stumps, [0, 1, 2, 3]).alias("voted"))


@query("audio_types")
def audio_types(spark, sf):
    """The type of each clip of ten frames by a tree of classifiers over the clips' means and
    deviations, after the type that is most frequent in it."""
    f = frames(spark, sf)
    clips = W.subclips(f, 10, ["x"], KEYS).na.fill(0.0, ["x_sd"])
    most = f.groupBy(*KEYS, F.floor(F.col("fli") / 10).alias("clip"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    most = most.groupBy(*KEYS, "clip").agg(F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("event_type"))
    rows = clips.join(most, [*KEYS, "clip"])
    tree = B.grown(rows, ["x_mean", "x_sd"], "event_type", AUDIO_TYPES, rounds=3, bins=16)
    return rows.select(*KEYS, "clip", "event_type", B.classified(tree).alias("type"))
