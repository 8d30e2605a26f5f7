"""Replays of the events as a stream, run to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.plans.base import query, rounded
from framewright.streaming import streams
from framewright.workspace import fresh_dir


def replayed(stream: DataFrame, mode: str) -> DataFrame:
    """The stream's last complete result, or the updates of all batches, written as tables
    in the shared folder."""
    spark, folder = stream.sparkSession, fresh_dir(stream.sparkSession, "replay")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{'last' if mode == 'complete' else number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", fresh_dir(spark, "replay-state"))
    q = writer.foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(stream.schema).parquet(f"{folder}/*")


@query(
    "stream_tumbling",
    "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
)
def stream_tumbling(spark, sf):
    w = streams.tumbling(streams.read_events(spark, f"{sf}/events*.parquet"), "1 hour")
    return rounded(replayed(w, "complete").withColumn("start", F.col("start").cast("timestamp_ntz")), "mean")


@query(
    "stream_sliding",
    """SELECT to_timestamp(epoch(date_trunc('hour', ts)) + k * 1800 - 1800)::TIMESTAMP AS start, user_id, count(*) AS n, round(avg(value), 6) AS mean
    FROM events, range(0, 3) r(k) WHERE epoch(ts) >= epoch(date_trunc('hour', ts)) + k * 1800 - 1800
      AND epoch(ts) < epoch(date_trunc('hour', ts)) + k * 1800 + 1800 GROUP BY ALL""",
)
def stream_sliding(spark, sf):
    w = streams.sliding(streams.read_events(spark, f"{sf}/events*.parquet"), "1 hour", "30 minutes")
    return rounded(replayed(w, "complete").withColumn("start", F.col("start").cast("timestamp_ntz")), "mean")


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS c
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_sessions(spark, sf):
    w = streams.sessions(streams.read_events(spark, f"{sf}/events*.parquet"), "6 hours")
    out = replayed(w, "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("stream_growing_model")
def stream_growing_model(spark, sf):
    return replayed(streams.growing_model(streams.read_events(spark, f"{sf}/events*.parquet")), "update")
