"""Evaluation: confusion matrices and detection, classification and clustering scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, hyp: str, gt: str, keys=()) -> DataFrame:
    """Long scatter matrix: ``hyp, gt, n``."""
    return rows.groupBy(*keys, F.col(hyp).alias("hyp"), F.col(gt).alias("gt")).agg(F.count(F.lit(1)).alias("n"))


def _ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def detection(counts: DataFrame, keys=()) -> DataFrame:
    """Scores of ``tp, fp, fn, tn``; defined where a denominator is zero. The false-alarm
    rate is fp / (tp + fn + fp)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    every = tp + fp + fn + tn
    empty = F.when(fp + fn > 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return counts.select(
        *keys,
        _ratio(tp, tp + fn, 1.0).alias("recall"),
        _ratio(tp, tp + fp, 1.0).alias("precision"),
        _ratio(fn, tp + fn, 0.0).alias("miss_rate"),
        _ratio(fp, tp + fn + fp, 0.0).alias("false_alarm_rate"),
        _ratio(fp + fn, every, 0.0).alias("error_rate"),
        _ratio(tn, tn + fp, 1.0).alias("specificity"),
        F.when(every > 0, (tp + tn) / every).otherwise(empty).alias("accuracy"),
    )


def counts(rows: DataFrame, hyp: Column, gt: Column, keys=()) -> DataFrame:
    """``tp, fp, fn, tn`` of boolean columns."""
    one = lambda c: F.count(F.when(c, 1))
    aggs = [one(hyp & gt).alias("tp"), one(hyp & ~gt).alias("fp"), one(~hyp & gt).alias("fn"), one(~hyp & ~gt).alias("tn")]
    return rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)


def flipped(found: DataFrame) -> DataFrame:
    """``tp, fp, fn, tn`` with the other class as the positive one."""
    return found.withColumnsRenamed({"tp": "_a", "fp": "_b"}).withColumnsRenamed({"tn": "tp", "fn": "fp"}).withColumnsRenamed({"_a": "tn", "_b": "fn"})


def voicing_scores(frames: DataFrame, hypothesis: str, truth: str, keys=()) -> DataFrame:
    """``tp, fp, fn, tn`` of voiced against unvoiced frames, of those that are speech in both
    masks and either in both."""
    from framewright.functions import labels as L

    either = L.MASK["voiced"] | L.MASK["unvoiced"]
    both = frames
    for c in (hypothesis, truth):
        both = both.filter(L.has_any(F.col(c), L.MASK["speech"]) & L.has_any(F.col(c), either))
    voiced = lambda c: L.has_any(F.col(c), L.MASK["voiced"])
    return counts(both, voiced(hypothesis), voiced(truth), keys)


def one_vs_rest(matrix: DataFrame) -> DataFrame:
    """``class, tp, fp, fn, tn`` for each class of a long matrix."""
    n = matrix.agg(F.sum("n").alias("all"))
    rows = matrix.groupBy(F.col("hyp").alias("class")).agg(F.sum("n").alias("r"), F.sum(F.when(F.col("hyp") == F.col("gt"), F.col("n")).otherwise(0)).alias("tp"))
    cols = matrix.groupBy(F.col("gt").alias("class")).agg(F.sum("n").alias("c"))
    both = rows.join(cols, "class", "full").na.fill(0).join(F.broadcast(n))  # one row
    tp, r, c = F.col("tp"), F.col("r"), F.col("c")
    return both.select("class", tp, (r - tp).alias("fp"), (c - tp).alias("fn"), (F.col("all") - r - c + tp).alias("tn"))


def classification(matrix: DataFrame) -> DataFrame:
    """Over all classes: average omission and commission, to which a class without rows adds
    nothing, misclassification and kappa."""
    m = one_vs_rest(matrix)
    tp, r, c = F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    n = F.max(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    one = m.agg(
        F.avg(F.when(c > 0, (c - tp) / c).otherwise(0.0)).alias("omission"),
        F.avg(F.when(r > 0, (r - tp) / r).otherwise(0.0)).alias("commission"),
        ((n - F.sum(tp)) / n).alias("misclassification"),
        (F.sum(tp) / n).alias("po"),
        (F.sum((r * c).cast("double")) / (n.cast("double") * n)).alias("pe"),
    )
    return one.select("omission", "commission", "misclassification", ((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def clustering(matrix: DataFrame, penalty: float = 0.5) -> DataFrame:
    """Of a long matrix (``hyp`` cluster, ``gt`` class): average cluster and class purity,
    their geometric mean, the un-normalised Rand index and the BBN metric."""
    rows = matrix.groupBy("hyp").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("q"))
    cols = matrix.groupBy("gt").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("q"))
    size, pure = F.col("t"), F.col("q") / (F.col("t") * F.col("t"))
    a = rows.agg(
        F.sum(size).alias("n"), F.count(F.lit(1)).alias("clusters"), F.sum(pure * size).alias("pr"),
        F.sum((0.5 - pure) * size * size).alias("rr"),
    )
    b = cols.agg(F.sum(pure * size).alias("pc"), F.sum(0.5 * size * size).alias("rc"))
    both = a.join(F.broadcast(b))  # one row each
    acp, asp = F.col("pr") / F.col("n"), F.col("pc") / F.col("n")
    return both.select(
        acp.alias("cluster_purity"), asp.alias("class_purity"), F.sqrt(acp * asp).alias("purity"),
        (F.col("rr") + F.col("rc")).alias("rand_index"), (F.col("pr") - penalty * F.col("clusters")).alias("bbn"),
    )


def error_rate(frames: DataFrame, gt: str, hyp: str, mapping: DataFrame, keep: Column) -> DataFrame:
    """Diarization error: the share of the frames to ``keep`` (outside collars) whose
    hypothesis maps to another speaker. ``mapping`` has ``hyp_id, gt_id``."""
    m = mapping.select(F.col("hyp_id").alias(hyp), F.col("gt_id").alias("_mapped"))
    joined = frames.filter(keep).join(m, hyp, "left")
    wrong = ~F.col("_mapped").eqNullSafe(F.col(gt))
    return joined.agg(F.count(F.lit(1)).alias("frames"), F.count(F.when(wrong, 1)).alias("wrong")).withColumn(
        "der", _ratio(F.col("wrong"), F.col("frames"), 0.0)
    )


def concordance(a: DataFrame, b: DataFrame, key: str, item: str, score: str) -> DataFrame:
    """The share of pairs of items of which two rankings of each row both put the first one
    strictly before the second, or both don't; the items of a row are few, and compared
    within the row."""
    one = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), F.col(score).alias("s")))).alias(name))
    both = one(a, "_a").join(one(b, "_b"), key)
    order = lambda x, i, j: F.get(x, i)["s"] < F.get(x, j)["s"]
    n = F.size("_a")
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.transform(
                F.filter(F.sequence(F.lit(0), n - 1), lambda j: j > i),
                lambda j: F.when(order(F.col("_a"), i, j) == order(F.col("_b"), i, j), 1).otherwise(0),
            ),
        )
    )
    agree = both.select(F.aggregate(pairs, F.lit(0), lambda s, v: s + v).alias("agree"), F.size(pairs).alias("pairs"))
    return agree.agg((F.sum("agree") / F.sum("pairs")).alias("concordance"))
