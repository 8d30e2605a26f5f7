"""The registry of queries, and the frame tables that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from framewright.functions.labels import MASK

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = ("WITH " + FRAMES + sql) if sql.lstrip().startswith(",") else sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Event types as labels of a frame.
EVENT_MASK = {
    "view": MASK["noise"],
    "click": MASK["speech"] | MASK["pureSpeech"],
    "signup": MASK["speech"] | MASK["noisySpeech"] | MASK["voiced"],
    "purchase": MASK["music"],
    "error": MASK["silence"],
}

FRAMES = """frames AS (
  SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS fli,
         event_id, ts, value AS x, event_type,
         CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1026 WHEN 'signup' THEN 5124
                         WHEN 'purchase' THEN 16 ELSE 131072 END AS mask
  FROM events)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as frames: one file a user, one frame an event, in order of time."""
    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    mask: Column = F.lit(EVENT_MASK["error"])
    for kind in ("view", "click", "signup", "purchase"):
        mask = F.when(F.col("event_type") == kind, EVENT_MASK[kind]).otherwise(mask)
    return events.select(
        F.col("user_id").alias("file_id"),
        (F.row_number().over(order) - 1).cast("long").alias("fli"),
        "event_id",
        "ts",
        F.col("value").alias("x"),
        "event_type",
        mask.alias("mask"),
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded doubles: sums differ in their last digits with the order of the rows. Adding
    zero turns a negative zero into zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})
