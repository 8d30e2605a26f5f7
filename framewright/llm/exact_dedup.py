"""Exact deduplication by 128-bit content hash with byte comparison.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``.
Rows are grouped by the MD5 of that normalised text *and* by the text itself, so Spark's
aggregate compares the bytes inside each hash group and a collision cannot merge two
texts. Copies are combined before the shuffle; the hash of a hot group therefore meets
one row per map task, not one per copy.

Defined results: a null text counts as empty; of equal texts the row with the most code
points in its original text stays, then the smallest id, a null id being the largest;
rows that repeat the id and text length of the row that stays are the same record: all are
marked as kept by ``exact_groups``, and ``drop_copies`` leaves one of them; an empty table
gives an empty result; further columns are ignored by the one and kept by the other,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: ``_md5, _sha, keep_id, keep_len, group_size``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.md5(normalised(F.col(text_col))).alias("_md5"),
        normalised(F.col(text_col)).alias("_norm"),
        F.struct(
            (-F.length(text)).alias("neg_len"),
            F.col(id_col).isNull().alias("no_id"),
            F.col(id_col).alias("id"),
        ).alias("_rank"),
    )
    return (
        rows.groupBy("_md5", "_norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min("_rank").alias("_best"))
        .select(
            "_md5",
            F.sha2("_norm", 256).alias("_sha"),
            F.col("_best.id").alias("keep_id"),
            (-F.col("_best.neg_len")).alias("keep_len"),
            "group_size",
        )
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``keep_id, group_size, kept, text_sha256``.

    The rows meet their class by its hashes only; no text is shuffled for that, and a hot
    class is a skewed equi-join that adaptive execution splits.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias(id_col),
        F.length(text).alias("_len"),
        F.md5(normalised(F.col(text_col))).alias("_md5"),
        F.sha2(normalised(F.col(text_col)), 256).alias("_sha"),
    )
    return rows.join(text_classes(docs, id_col, text_col), ["_md5", "_sha"]).select(
        F.col(id_col),
        "keep_id",
        "group_size",
        (F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("_len") == F.col("keep_len"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def _hashable(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, one row of each group of equal texts. The row's number
    among its repetitions needs no shuffle besides the join's, as it has the join's keys."""
    key = lambda md5, doc, length: [
        md5.alias("_m"), F.coalesce(doc.cast("string"), F.lit("")).alias("_i"), doc.isNull().alias("_no"), length.alias("_l")
    ]
    keep = text_classes(docs, id_col, text_col).select(*key(F.col("_md5"), F.col("keep_id"), F.col("keep_len")))
    own = key(F.md5(normalised(F.col(text_col))), F.col(id_col), F.length(F.coalesce(F.col(text_col), F.lit(""))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *own, F.xxhash64(*_hashable(docs)).alias("_h"))
    keys = ["_m", "_i", "_no", "_l"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))
    left = rows.join(keep, keys).withColumn("_nth", nth).filter("_nth = 1")
    return left.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def without_repeats(docs: DataFrame, id_col: str, text_col: str, gone: DataFrame) -> DataFrame:
    """``docs`` without the ids of ``gone(_gone)``, and one row of each id and text. Only
    rows that have their like are brought together."""
    key = [F.col(id_col).alias("_i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_x")]
    again = docs.select(*key).groupBy("_i", "_x").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c")
    same = F.col(id_col).eqNullSafe(F.col("_i")) & (key[1] == F.col("_x"))
    unlinked = F.col(id_col) == F.col("_gone")
    once = docs.join(gone, unlinked, "left_anti").join(again, same, "left_anti")
    order = Window.partitionBy(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).orderBy(F.xxhash64(*_hashable(docs)))
    more = docs.join(again, same, "left_semi").join(gone, unlinked, "left_anti").withColumn("_nth_of_like", F.row_number().over(order))
    return once.union(more.filter("_nth_of_like = 1").drop("_nth_of_like"))
