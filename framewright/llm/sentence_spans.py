"""Removal of repeated passages by sliding runs of sentences.

A sentence ends after a word that ends in a terminal mark (of any of the scripts below), or
at a line break. Characters of scripts that put no blanks between words are words of their
own. In every window of ``WINDOW`` words inside a sentence a cut is made after the word with
the smallest hash: so a long sentence is cut where its own words decide and not what is
around them, no piece has more than ``WINDOW`` words, and two passages that share words are
cut alike from the first window that lies in both to the last. Sentences and the parts of
long ones are called pieces.

Every run of several consecutive pieces is hashed to 128 bits, upper and lower case and white
space aside: from each piece on, and up to each piece, the shortest run of ``FEWEST`` pieces
that has ``least`` words or ``MOST`` pieces. Each piece of a text with one such run is in one.
A passage of over 50 words holds a run wherever it begins and ends, as 29 of its words lie in
pieces that are cut alike; if it begins and ends with sentences, it is made of runs.

The hashes are joined over the whole corpus: of equal runs the first, by document id and
position, stays, and all pieces that any other one covers are removed. Of the equal runs in
a slice of documents only the first can be the first of all. The others are covered already,
and are passed on as merged ranges under keys of their own: a run that a third of all
documents share meets its like as one row a slice, in a window that sorts and spills. What is
collected per document are ranges of its pieces.

Defined results: a null or empty text has no pieces; a text with fewer pieces than a run has
none, and stays; null ids come last in the order; rows with equal id and text are one
document, and are all cleaned alike; an empty table gives an empty result; further columns
are ignored by ``repeats`` and kept by ``cleaned``. A text is split as a whole, in about 80
bytes of memory for each of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a window, in each of which a sentence is cut; pieces of a run.
WINDOW, FEWEST, MOST = 12, 3, 6
#: Bytes of text that are split at once.
_SLICE = 1 << 20
#: Characters that are longer or shorter in lower case.
_ODD = re.compile("[%s]" % "".join(c for c in map(chr, range(128, 0xD800)) if len(c.lower().encode()) != len(c.encode())))
# Terminal marks, and marks that may follow them.
_ENDS = [m.encode() for m in ".!?…؟۔।॥።။།。！？．｡"]
_CLOSERS = np.isin(np.arange(256), list(b"\"')]}"))
_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_BREAK = np.isin(np.arange(256), list(b"\n\v\f\r"))
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64((salt * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lower(text: str) -> bytes:
    """Lower case in as many bytes."""
    return text.encode("utf-8", "replace").lower() if text.isascii() or _ODD.search(text) else text.lower().encode("utf-8", "replace")


def _alone(data: np.ndarray) -> np.ndarray:
    """Where a character begins that is a word of its own: of the scripts without blanks
    (Thai to Tibetan, Myanmar, Khmer, Han and Kana) and full-width marks."""
    after = np.append(data[1:], np.uint8(0))
    return (
        (data >= 0xE3) & (data <= 0xE9)
        | (data == 0xE2) & (after >= 0xBA)
        | (data == 0xE0) & (after >= 0xB8)
        | (data == 0xE1) & ((after >= 0x80) & (after <= 0x82) | (after >= 0x9E) & (after <= 0x9F))
        | (data == 0xEF) & (after >= 0xBC) & (after <= 0xBE)
        | (data == 0xF0) & (after >= 0xA0)
    )


def split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of some lower-case texts: for each its text, the byte of that text at which
    it begins, its words, and the two halves of its hash."""
    none = np.zeros(0, dtype=np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    base = np.cumsum([0] + [len(t) + 1 for t in texts])
    blank = _BLANK[data]
    inside = ~blank
    alone = _alone(data) if (data >= 0xE0).any() else np.zeros(len(data), dtype=bool)
    first = inside.copy()
    first[1:] &= blank[:-1]
    if alone.any():
        lead = inside & ((data & 0xC0) != 0x80)  # first bytes of characters
        leads = np.flatnonzero(lead)
        follows = np.zeros(len(data), dtype=bool)
        follows[leads[1:][alone[leads[:-1]]]] = True
        first |= (alone | follows) & lead
    starts = np.flatnonzero(first)
    if not len(starts):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    nexts = np.append(starts[1:], len(data))
    # a word ends at the blank after it, or at the next word
    spaces = np.flatnonzero(blank)
    ends = np.minimum(nexts, spaces[np.searchsorted(spaces, starts)])
    doc = np.searchsorted(base, starts, side="right") - 1
    # sentence ends
    last = ends - 1
    last = np.where(_CLOSERS[data[last]] & (last > starts), last - 1, last)
    final = np.zeros(len(starts), dtype=bool)
    for mark in _ENDS:
        hit = data[last] == mark[-1]
        for k in range(1, len(mark)):
            hit &= data[np.maximum(last - k, 0)] == mark[-1 - k]
        final |= hit
    breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
    final |= breaks[nexts] > breaks[ends]  # text ends are line breaks here
    final[-1] = True
    # cuts inside sentences
    cut = final.copy()
    n = len(starts)
    if n >= WINDOW:
        at = np.flatnonzero(inside)
        word = np.searchsorted(starts, at, side="right") - 1
        place = at - starts[word]
        powers = np.multiply.accumulate(np.full(int((ends - starts).max()), _POWER, dtype=np.uint64))
        order = _mix(np.add.reduceat(_BYTE[data[at]] * powers[place], np.searchsorted(at, starts)), 1)
        sentence = np.cumsum(final) - final
        best, where = order[: n - WINDOW + 1].copy(), np.arange(n - WINDOW + 1)
        for k in range(1, WINDOW):
            other = order[k : n - WINDOW + 1 + k]
            less = other <= best
            best = np.where(less, other, best)
            where = np.where(less, np.arange(k, n - WINDOW + 1 + k), where)
        whole = sentence[: n - WINDOW + 1] == sentence[WINDOW - 1 :]
        cut[where[whole]] = True
    closing = np.flatnonzero(cut)
    opening = np.concatenate([[0], closing[:-1] + 1])
    # hashes of the words with one blank between them
    keep = inside | np.append(inside[1:], False) & blank
    tidy = np.where(blank, np.uint8(32), data)[keep].tobytes()
    moved = np.concatenate([[0], np.cumsum(keep)])
    digest = xxhash.xxh3_128_digest
    spans = zip(moved[starts[opening]].tolist(), moved[ends[closing]].tolist())
    both = np.frombuffer(b"".join([digest(tidy[a:b]) for a, b in spans]), dtype="<u8").reshape(-1, 2)
    own = doc[opening]
    return own, starts[opening] - base[own], closing - opening + 1, both[:, 0], both[:, 1]


def find_runs(
    own: np.ndarray, words: np.ndarray, high: np.ndarray, low: np.ndarray, least: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each run's first piece, number of pieces, and the two halves of its hash."""
    n = len(own)
    upto = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(n)
    ends = np.maximum(at + FEWEST, np.minimum(at + MOST, np.searchsorted(upto, upto[:-1] + least)))
    begun = np.minimum(at + 1 - FEWEST, np.maximum(at + 1 - MOST, np.searchsorted(upto, upto[1:] - least, side="right") - 1))
    there = ends <= np.searchsorted(own, own, side="right")
    here = begun >= np.searchsorted(own, own, side="left")
    step = MOST + 1
    found = np.unique(np.concatenate([at[there] * step + (ends - at)[there], begun[here] * step + (at + 1 - begun)[here]]))
    at, size = found // step, found % step
    one = two = size.astype(np.uint64)
    for k in range(MOST):
        piece = np.minimum(at + k, n - 1)
        one = np.where(k < size, _mix(one ^ high[piece], 2 + 2 * k), one)
        two = np.where(k < size, _mix(two ^ low[piece], 3 + 2 * k), two)
    return at, size, one, two


def sentences(text: str | None) -> list[str]:
    """Pieces of the text, each with the white space that follows, in order and without a rest."""
    whole = (text or "").encode()
    begins = split([_lower(text or "")])[1].tolist()
    cuts = [0, *begins[1:], len(whole)] if whole else [0]
    return [whole[a:b].decode() for a, b in zip(cuts, cuts[1:])]


def runs(pieces: list[str], least: int) -> list[tuple[int, int, int, int]]:
    """(place, number of pieces, two 64-bit hashes) of each run."""
    place, _, words, high, low = split([_lower(p) for p in pieces])
    at, size, one, two = find_runs(np.zeros(len(place), np.int64), words, high, low, least)
    spans = place[at + size - 1] - place[at] + 1 if len(at) else size
    return list(zip(place[at].tolist(), spans.tolist(), one.tolist(), two.tolist()))


def _sliced(ids: list, rows: list[int], texts: list[str | None]) -> Iterator[tuple[list, list[int], list[bytes]]]:
    """Different documents, in order, at most about _SLICE bytes at once."""
    docs = sorted({(i is None, i or 0, r): (i, r, t) for i, r, t in zip(ids, rows, texts) if t}.items())
    held, size = [], 0
    for _, (i, r, t) in docs:
        held.append((i, r, _lower(t)))
        size += len(held[-1][2])
        if size >= _SLICE:
            yield tuple(map(list, zip(*held)))
            held, size = [], 0
    if held:
        yield tuple(map(list, zip(*held)))


def _compared(own, at, size, one, two) -> tuple[np.ndarray, ...]:
    """Of the runs of documents in order: the first of each hash, and the others' pieces as
    merged ranges (-size: they are covered), in columns document's number, place, size, hash."""
    order = np.lexsort((at, two, one))
    same = np.zeros(len(at), dtype=bool)
    same[1:] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    first, others = np.sort(order[~same]), np.sort(order[same])
    begins = np.searchsorted(own, own, side="left")
    rows = [(own[at[first]], at[first] - begins[at[first]], size[first], one[first], two[first])]
    if len(others):
        start, end = at[others], np.maximum.accumulate(at[others] + size[others])
        new = np.ones(len(others), dtype=bool)
        new[1:] = (start[1:] > end[:-1]) | (own[start[1:]] != own[start[:-1]])
        begin = np.flatnonzero(new)
        start, end = start[begin], end[np.append(begin[1:], len(others)) - 1]
        key = one[others][begin]
        rows.append((own[start], start - begins[start], start - end, _mix(key ^ start.astype(np.uint64), 40), _mix(key + start.astype(np.uint64), 41)))
    return tuple(np.concatenate(c) for c in zip(*rows))


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))


SPANS = "id bigint, row bigint, place int, size int, low bigint, high bigint"


def repeated_places(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """``id, row, ranges``: for each document the pieces that go, as place * 2^32 + number."""
    names = [c.split()[0] for c in SPANS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, rows, texts in _sliced(*(c.to_pylist() for c in batch.columns)):
                own, _, words, high, low = split(texts)
                doc, place, size, one, two = _compared(own, *find_runs(own, words, high, low, least))
                cols = [pa.array(ids, pa.int64()).take(pa.array(doc)), pa.array(np.array(rows, dtype=np.int64)[doc])]
                cols += [pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(x.astype(np.int64)) for x in (one, two)], names=names)

    source = docs.select(F.col(id_col).cast("long").alias("id"), _key(id_col, text_col).alias("row"), F.col(text_col).cast("string"))
    order = Window.partitionBy("low", "high").orderBy(F.col("id").isNull(), "id", "row", "place")
    ranked = source.mapInArrow(run, SPANS).withColumn("_rank", F.rank().over(order))
    later = ranked.filter("_rank > 1 or size < 0")
    span = F.shiftleft(F.col("place").cast("long"), 32) + F.abs("size")
    return later.groupBy("id", "row").agg(F.collect_list(span).alias("ranges"))


def _without(text: Column, ranges: Column) -> Column:
    """``n_sentences, n_removed, text`` after the pieces in the ranges are removed."""

    @F.pandas_udf("n_sentences long, n_removed long, text string")
    def remove(texts, ranges):
        import pandas as pd

        out, whole = [], [(t or "") for t in texts]
        at = 0
        while at < len(whole):
            end, size = at, 0
            while end < len(whole) and size < _SLICE:
                size += len(whole[end])
                end += 1
            own, begins, *_ = split([_lower(t) for t in whole[at:end]])
            cuts = np.searchsorted(own, np.arange(end - at + 1))
            for k in range(at, end):
                data, begin = whole[k].encode(), begins[cuts[k - at] : cuts[k - at + 1]]
                gone = np.zeros(len(begin) + 1, dtype=np.int64)
                given = np.zeros(0, np.int64) if ranges[k] is None else np.asarray(ranges[k], dtype=np.int64)
                np.add.at(gone, given >> 32, 1)
                np.add.at(gone, (given >> 32) + (given & 0xFFFFFFFF), -1)
                stays = np.cumsum(gone)[:-1] == 0
                edges = np.concatenate([[0], begin[1:], [len(data)]]).astype(np.int64)
                left = b"".join([data[edges[j] : edges[j + 1]] for j in np.flatnonzero(stays)]) if len(begin) else data
                out.append((len(begin), int((~stays).sum()), left.decode()))
            at = end
        return pd.DataFrame(out, columns=["n_sentences", "n_removed", "text"])

    return remove(text, ranges)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 15) -> DataFrame:
    """One row per document that loses sentences: id, ``n_sentences, n_removed`` and the
    ``text`` that is left."""
    places = repeated_places(docs, id_col, text_col, least)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), _key(id_col, text_col).alias("_row"), F.col(text_col).alias("_text"))
    same = (F.col("row") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_id"))
    done = places.join(rows, same).select("id", _without(F.col("_text"), F.col("ranges")).alias("_d"))
    return done.select(F.col("id").alias(id_col), "_d.n_sentences", "_d.n_removed", "_d.text")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 15) -> DataFrame:
    """``docs`` with all its columns and rows, repeated sentences removed from the text."""
    places = repeated_places(docs, id_col, text_col, least)
    places = places.select(F.col("id").alias("_sid"), F.col("row").alias("_srow"), F.col("ranges").alias("_sranges"))
    same = (_key(id_col, text_col) == F.col("_srow")) & F.col(id_col).cast("long").eqNullSafe(F.col("_sid"))
    joined = docs.join(places, same, "left")
    text = F.when(F.col("_sranges").isNull(), F.col(text_col)).otherwise(_without(F.col(text_col), F.col("_sranges"))["text"])
    return joined.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in docs.columns])
