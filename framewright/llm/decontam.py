"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts are sequences of lower-case words (runs of letters and digits). A mask looks at some
positions of a window and ignores the others, so a substituted word under an ignored
position doesn't change the window's hash. Every window of every document and of every
benchmark item is hashed under each mask; equal hashes are hits. Around each hit the
document is aligned with the item word by word, and a stretch of 13 words of which 80 %
agree (of all words, for items of 8 to 12) confirms an overlap.

The two masks find every 13-word stretch with up to two substitutions, and every item of 8
to 12 words with one. An item of fewer than 8 words is found where all its words follow each
other. Equal items are one until the end.

The benchmark's windows are broadcast only while their number, counted first, is at most
``broadcast_rows``; beyond that the join on the hashes is an ordinary shuffled one. What is
kept of a hit is its diagonal, the shift between document and item; diagonals are distinct
before the document's words are looked at, and of these only the item's length around each.

Defined results: a null or empty text has no words and no overlap; null ids are returned as
null; rows are documents by id and text, so that each is judged by its own text, and repeated
rows change nothing; equal items are all reported; of several overlaps of a document with an
item the one with the most equal words is reported, then the first; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions that each mask looks at.
MASKS = ((0, 1, 2, 4, 6), (0, 3, 4, 5, 6))
SPAN = 7


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def seeds(hashed: DataFrame, masks: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """``hashed`` without its words' hashes ``_h``, a row for each window under each mask:
    the words before it, ``_at``, and its ``_seed``. Masks are (span, positions)."""
    kept = [c for c in hashed.columns if c != "_h"]
    at = hashed.select(*kept, "_h", F.size("_h").alias("_size"), F.explode(F.sequence(F.lit(1), F.size("_h"))).alias("_i"))

    def under(k: int, span: int, mask: tuple[int, ...]) -> Column:
        found = F.xxhash64(F.lit(k), *[F.get("_h", F.col("_i") + (p - 1)) for p in mask])
        return F.when((F.col("_i") > 0) & (F.col("_i") + (span - 1) <= F.col("_size")), found)  # no words: 1, 0

    # outside of lambda functions, so that the hashes are compiled
    found = at.select(*kept, (F.col("_i") - 1).alias("_at"), *[under(k, *m).alias(f"_s{k}") for k, m in enumerate(masks)])
    each = found.select(*kept, "_at", F.explode(F.array(*[f"_s{k}" for k in range(len(masks))])).alias("_seed"))
    return each.filter("_seed is not null")


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    stretch: int = 13,
    least: int = 8,
    percent: int = 80,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """One row per document and benchmark item that overlap: ids, ``doc_start, item_start``
    (words before the overlap), ``n_words`` and ``n_equal`` of the aligned stretch."""
    own = items.select(F.col(item_col).alias("_item"), word_list(F.col(item_text_col)).alias("_b")).filter(F.size("_b") > 0)
    own = own.withColumn("_class", F.md5(F.array_join("_b", " ")))
    classes = own.groupBy("_class").agg(F.first("_b").alias("_b"))
    short = sorted(r[0] for r in classes.filter(F.size("_b") < least).select(F.size("_b")).distinct().collect())  # at most 7
    masks = [(SPAN, m) for m in MASKS] + [(n, tuple(range(n))) for n in short]
    hashed = classes.select("_class", hashes(F.col("_b")).alias("_h"))
    wanted = seeds(hashed.filter(F.size("_h") >= least), masks[: len(MASKS)])
    for k, (n, mask) in enumerate(masks[len(MASKS) :], len(MASKS)):
        whole = F.xxhash64(F.lit(k), *[F.get("_h", F.lit(p)) for p in mask])
        wanted = wanted.union(hashed.filter(F.size("_h") == n).select("_class", F.lit(0).alias("_at"), whole.alias("_seed")))
    wanted = wanted.select("_class", F.col("_at").alias("_item_at"), F.col("_seed").alias("_wanted"))
    if wanted.count() <= broadcast_rows:
        wanted = F.broadcast(wanted)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_doc"), F.xxhash64(text).alias("_row"), hashes(word_list(text)).alias("_h"))
    hits = (
        seeds(rows, masks)
        .join(wanted, F.col("_seed") == F.col("_wanted"))
        .select("_doc", "_row", "_class", (F.col("_at") - F.col("_item_at")).alias("_shift"))
        .distinct()
    )
    # a document meets its text once for each item and each 256 diagonals that were hit
    pairs = hits.groupBy("_doc", "_row", "_class", F.floor(F.col("_shift") / 256)).agg(F.collect_list("_shift").alias("_shifts"))
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_own"), text.alias("_text"))
    met = (
        pairs.join(classes, "_class")
        .join(texts, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_own")))
        .select("_doc", "_row", "_class", "_shifts", "_b", word_list(F.col("_text")).alias("_a"))
    )
    a, b = F.col("_a"), F.col("_b")
    width = F.least(F.lit(stretch), F.size(b))
    needed = F.when(F.size(b) < least, F.size(b) * 100).otherwise(width * percent)
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y)

    def aligned(shift: Column) -> Column:
        """From the item's first word that lies inside the document: which words agree."""
        start = F.greatest(F.lit(0), -shift)
        n = F.greatest(F.lit(0), F.least(F.size(b), F.size(a) - shift) - start)
        same = F.zip_with(F.slice(b, start + 1, n), F.slice(a, start + shift + 1, n), lambda x, y: F.when(x == y, 1).otherwise(0))
        return F.struct(shift.alias("shift"), start.alias("start"), same.alias("same"))

    def good(one: Column) -> Column:
        """Where a stretch of enough equal words begins, from 1."""
        ones = one["same"]
        last = F.size(ones) - width + 1
        starts = F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        begins = F.filter(starts, lambda s: total(F.slice(ones, s, width)) * 100 >= needed)
        return F.struct(one["shift"].alias("shift"), one["start"].alias("start"), ones.alias("same"), begins.alias("begins"))

    def best(one: Column) -> Column:
        first, last = F.array_min(one["begins"]), F.array_max(one["begins"]) + width
        return F.struct(
            total(F.slice(one["same"], first, last - first)).alias("n_equal"),
            (-(one["start"] + one["shift"] + first - 1)).alias("neg_start"),
            (one["start"] + first - 1).alias("item_start"),
            (last - first).alias("n_words"),
        )

    # no filter before the aggregation: pushed down, it would split the text anew for each diagonal
    looked = F.filter(F.transform(F.transform("_shifts", aligned), good), lambda x: F.size(x["begins"]) > 0)
    return (
        met.select("_doc", "_row", "_class", F.array_max(F.transform(looked, best)).alias("_best"))
        .groupBy("_doc", "_row", "_class")
        .agg(F.max("_best").alias("_best"))
        .filter("_best is not null")
        .join(own.select("_item", "_class").distinct(), "_class")
        .select(
            F.col("_doc").alias(id_col),
            F.col("_item").alias(item_col),
            (-F.col("_best.neg_start")).cast("long").alias("doc_start"),
            F.col("_best.item_start").cast("long").alias("item_start"),
            F.col("_best.n_words").cast("long").alias("n_words"),
            F.col("_best.n_equal").cast("long").alias("n_equal"),
            F.col("_row").alias("text_hash"),
        )
    )


def without_benchmark(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", alone: int = 5, **options
) -> DataFrame:
    """``docs`` with all its columns, without the rows that overlap an item. A short item that
    is found whole counts from ``alone`` words on: fewer say nothing about a document."""
    found = overlaps(docs, items, id_col=id_col, text_col=text_col, **options).filter(F.col("n_words") >= alone)
    found = found.select(F.col(id_col).alias("_leaked"), F.col("text_hash").alias("_leaked_text")).distinct()
    same = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("_leaked_text")
    return docs.join(found, same & F.col(id_col).eqNullSafe(F.col("_leaked")), "left_anti")
