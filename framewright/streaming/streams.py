"""Structured Streaming over event frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """The event files of a folder as a stream."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str, late: str = "10 minutes") -> DataFrame:
    """Count and mean of each event type in windows of event time."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def sliding(events: DataFrame, size: str, step: str, late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, step), "user_id")
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "user_id", "n", "mean")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events without a pause of ``gap``."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def growing_model(events: DataFrame, distance: float = 3.0, floor: float = 1.0, most: int = 16) -> DataFrame:
    """An incremental one-dimensional mixture for each user: a value within ``distance``
    deviations of a component updates it (count, mean, sum of squares), others open a new
    one, as long as there are fewer than ``most``. Emits the components of updated users."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, square = (list(x) for x in state.get) if state.exists else ([], [], [])
        for pdf in batches:
            for x in pdf.sort_values(["ts", "event_id"])["value"]:
                sd = [max(floor, np.sqrt(q / c)) for c, q in zip(n, square)]
                off = [abs(x - m) / s for m, s in zip(mean, sd)]
                k = int(np.argmin(off)) if off else -1
                if k < 0 or off[k] > distance and len(n) < most:
                    n.append(1), mean.append(float(x)), square.append(0.0)
                else:
                    n[k] += 1
                    d = x - mean[k]
                    mean[k] += d / n[k]
                    square[k] += d * (x - mean[k])
        state.update((n, mean, square))
        yield pd.DataFrame({"user_id": [key[0]] * len(n), "component": range(len(n)), "n": n, "mean": mean})

    return events.groupBy("user_id").applyInPandasWithState(
        update,
        "user_id long, component long, n long, mean double",
        "n array<long>, mean array<double>, square array<double>",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now into a table in memory, for tests and replays."""
    spark = stream.sparkSession
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
