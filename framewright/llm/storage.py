"""Tables that every executor can reach, in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from framewright.workspace import fresh_dir, shared_dir

__all__ = ["fresh_dir", "shared_dir", "written"]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage,
    and a lost executor costs a read, not a recomputation."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
