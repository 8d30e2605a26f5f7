"""Runs, boundaries and segments of a frame axis. ``keys`` name the files; ``pos`` is the
frame's number in its file. All are one window per file, streamed in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(keys: list[str], pos: str):
    return Window.partitionBy(*keys).orderBy(pos)


def with_run_id(frames: DataFrame, value: Column, keys: list[str], pos: str = "fli", name: str = "run_id") -> DataFrame:
    """Numbers the maximal runs of equal ``value`` in each file, from 0."""
    w = _by(keys, pos)
    change = F.when(F.lag(value).over(w).eqNullSafe(value) | (F.row_number().over(w) == 1), 0).otherwise(1)
    return frames.withColumn("_change", change).withColumn(name, F.sum("_change").over(w)).drop("_change")


def runs(frames: DataFrame, value: Column, keys: list[str], pos: str = "fli", wanted: Column | None = None, more=()) -> DataFrame:
    """One row per run: ``run_id, start, end, n`` and the aggregates ``more``. ``value`` may
    hold a speaker or boundary count too, so that runs break there; ``wanted`` keeps the runs
    of one kind, after all have been numbered."""
    marked = with_run_id(frames.withColumn("_v", value), F.col("_v"), keys, pos)
    if wanted is not None:
        marked = marked.filter(wanted)
    return marked.groupBy(*keys, "run_id").agg(
        F.min(pos).alias("start"), F.max(pos).alias("end"), F.count(F.lit(1)).alias("n"), *more
    )


def segments(frames: DataFrame, boundary: Column, keys: list[str], pos: str = "fli") -> DataFrame:
    """Segments between boundaries: ``start`` is a boundary, ``end`` the frame before the
    next, or the file's last."""
    last = F.max(pos).over(Window.partitionBy(*keys))
    found = frames.withColumn("_last", last).filter(boundary)
    end = F.coalesce(F.lead(pos).over(_by(keys, pos)) - 1, F.col("_last"))
    return found.select(*keys, F.col(pos).alias("start"), end.alias("end"))


def ordinal(frames: DataFrame, boundary: Column, keys: list[str], pos: str = "fli", name: str = "scene") -> DataFrame:
    """The 1-based number of the segment that each frame is in; 0 before the first boundary."""
    return frames.withColumn(name, F.sum(F.when(boundary, 1).otherwise(0)).over(_by(keys, pos)))


def relabel_short_gaps(frames: DataFrame, gap: Column, around: Column, most: int, new: Column, keys: list[str], pos: str = "fli", mask: str = "mask") -> DataFrame:
    """Gives the frames of a ``gap`` run of under ``most`` frames the mask ``new`` if the
    frames before and behind it are ``around``."""
    kind = F.when(gap, 1).when(around, 2).otherwise(0)
    marked = with_run_id(frames.withColumn("_k", kind), F.col("_k"), keys, pos)
    one = marked.groupBy(*keys, "run_id").agg(F.first("_k").alias("_k"), F.count(F.lit(1)).alias("_n"))
    w = _by(keys, "run_id")
    fits = (F.col("_k") == 1) & (F.col("_n") < most) & (F.lag("_k").over(w) == 2) & (F.lead("_k").over(w) == 2)
    short = one.withColumn("_short", fits).select(*keys, "run_id", "_short")
    out = marked.join(short, [*keys, "run_id"])
    return out.withColumn(mask, F.when(F.col("_short"), new).otherwise(F.col(mask))).drop("_k", "_short", "run_id")


def merge_neighbours(parts: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: int = 1) -> DataFrame:
    """Unites intervals that overlap or begin within ``gap`` behind the end of another."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = parts.withColumn("_new", F.when(F.col(start) <= reach + gap, 0).otherwise(1))
    fresh = fresh.withColumn("_group", F.sum("_new").over(w))
    return fresh.groupBy(*keys, "_group").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("parts")
    ).drop("_group")


def detectability(parts: DataFrame, length: Column, keys: list[str], start: str = "start") -> DataFrame:
    """For each segment the shorter of its own and its successor's length; 0 for the last."""
    return parts.withColumn("detectability", F.least(length, F.lead(length, 1, 0).over(_by(keys, start))))


def change_points(frames: DataFrame, hit: Column, keys: list[str], pos: str = "fli") -> DataFrame:
    """The first frame of each run of hits."""
    before = F.lag(hit, 1, False).over(_by(keys, pos))
    return frames.withColumn("_first", hit & ~before).filter("_first").drop("_first")


def previous(value: Column, keys: list[str], pos: str = "fli") -> Column:
    """The last value that is not null, up to and with this frame."""
    return F.last(value, ignorenulls=True).over(_by(keys, pos).rowsBetween(Window.unboundedPreceding, 0))


def following(value: Column, keys: list[str], pos: str = "fli") -> Column:
    """The first value that is not null, from this frame on. The axis is gone through from
    its end: a frame that only grows costs one step a row."""
    backwards = Window.partitionBy(*keys).orderBy(F.col(pos).desc())
    return F.last(value, ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, 0))


def split_long(run_table: DataFrame, most: int) -> DataFrame:
    """Cuts runs into pieces of at most ``most`` frames."""
    starts = F.sequence(F.col("start"), F.col("end"), F.lit(most).cast("long"))
    cut = run_table.withColumn("_s", F.explode(starts))
    return cut.withColumn("end", F.least(F.col("end"), F.col("_s") + most - 1)).withColumn("start", F.col("_s")).drop("_s")


def pseudo_scenes(frames: DataFrame, speech: Column, length: int, keys: list[str], pos: str = "fli", pause: int = 1) -> DataFrame:
    """Boundaries about every ``length`` frames, counted from the last one: ``keys, scene,
    boundary``. The first frame is a boundary. One that would fall on speech goes behind it,
    and on by half the way to the next speech, but by ``pause`` frames at least; after the
    last speech it stays right behind.

    Where a boundary at a frame would go to is an expression; the walk from one boundary to
    the next streams through the files in order, and holds no file."""
    import numpy as np
    import pandas as pd

    f = frames.select(*keys, F.col(pos).cast("long").alias("_pos"), speech.alias("_speech"))
    f = f.withColumn("_next", following(F.when(F.col("_speech"), F.col("_pos")), keys, "_pos"))
    free = F.when(~F.col("_speech"), F.struct(F.col("_pos").alias("open"), F.col("_next").alias("next")))
    f = f.withColumn("_free", following(free, keys, "_pos"))
    way = F.greatest(F.floor((F.col("_free.next") - F.col("_free.open")) / 2), F.lit(pause))
    to = F.when(~F.col("_speech"), F.col("_pos")).otherwise(F.col("_free.open") + F.coalesce(way, F.lit(0)))
    f = f.select(*keys, "_pos", to.cast("double").alias("_to"), (F.row_number().over(_by(keys, "_pos")) == 1).alias("_first"))

    def walk(batches):
        want, settled, scene = np.inf, True, 0
        for batch in batches:
            at, goal, first = batch["_pos"].to_numpy(), batch["_to"].to_numpy(dtype=float), batch["_first"].to_numpy()
            starts = np.unique(np.concatenate([[0], np.flatnonzero(first)])).tolist() if len(at) else []
            hits, scenes = [], []
            for i, j in zip(starts, [*starts[1:], len(at)]):
                if first[i]:
                    want, settled, scene = at[i], True, 0
                while want < np.inf and (r := i + int(np.searchsorted(at[i:j], want))) < j:
                    if settled or goal[r] == at[r]:
                        hits.append(r)
                        scenes.append(scene)
                        want, settled, scene = at[r] + length, False, scene + 1
                    else:
                        want, settled = (np.inf if np.isnan(goal[r]) else goal[r]), True
            out = batch.iloc[hits][[*keys, "_pos"]].rename(columns={"_pos": "boundary"})
            out.insert(len(keys), "scene", pd.Series(scenes, index=out.index, dtype="int64"))
            yield out

    fields = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in f.select(*keys).schema.fields)
    dealt = f.repartition(*keys).sortWithinPartitions(*keys, "_pos")
    return dealt.mapInPandas(walk, f"{fields}, scene bigint, boundary bigint")


def scene_window(frames: DataFrame, scene: str, first: int, last: int, selection: int = 0) -> DataFrame:
    """Frames of the scenes ``first`` to ``last``, of those whose bit is set in a
    ``selection`` that isn't 0."""
    chosen = F.col(scene).between(first, last)
    if selection:
        bit = F.getbit(F.lit(selection).cast("long"), F.least(F.col(scene), F.lit(62)).cast("int"))
        chosen &= (F.col(scene) < 63) & (bit == 1)
    return frames.filter(chosen)
