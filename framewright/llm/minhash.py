"""Near-duplicate classes by circulant MinHash, with every link confirmed on full sets.

A document is the set of its distinct ``words``-word shingles. Two permutations of the
32-bit integers give all signature coordinates: the first scatters the shingles, the
second, shifted circularly by k, gives coordinate k as the smallest image of the set.
Bands of coordinates are hashed into buckets.

Documents with equal sets (by two 64-bit sums over the set and its size) form a class, and
only one representative of it is compared with others; every member's full set is compared
with the representative's, and one that differs is no member. Within a bucket no two members are
paired for all pairs:

1. every member is compared with the bucket's hub, a member drawn anew for each band, so a
   document meets up to as many hubs as there are bands; links are confirmed by the exact
   Jaccard similarity of the sets of words, and components are formed;
2. buckets whose members now lie in one component hold no further information. In the
   others, pairs from different components are compared too, if they can reach the
   threshold at all. The comparison with the hub has told what each member lacks of it, as a
   bit map, and what it has besides: two members share at most the hub's shingles that
   neither lacks, and of the others what the maps' union and the shingles that no other
   compared document has leave. Confirmed links are added and components formed again. The
   pairs of a large bucket are dealt out by blocks of its members.

A pair of similarity 0.8 misses all 36 bands of 5 coordinates with a probability under
1e-6; nothing else is lost, and nothing is capped.

Defined results: a text without words, or a null one, has size 0 and is linked with nothing;
a text with fewer words than a shingle has its whole sequence as one shingle; a row with a
null id is linked with nothing, has a null component and is kept; rows that share an id are
one document; of rows with equal id and text ``drop_near_duplicates`` leaves one; ties cannot arise, a component's smallest id
stands for it; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.exact_dedup import without_repeats
from framewright.llm.graph import components
from framewright.llm.storage import written

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_LOWER_BYTES = np.arange(256, dtype=np.uint8)
_LOWER_BYTES[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: 64-bit integers in a bit map of shingles.
LONGS = 8
#: Members of an open bucket that one block of its pairs has, about.
BLOCK = 512
#: Bytes of text that are hashed at once.
_SLICE = 1 << 21


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A permutation of the 64-bit integers."""
    x = x + np.uint64((salt * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix32(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def word_set(text: str | None, words: int) -> frozenset[tuple[str, ...]]:
    """A document's set of shingles, of the words themselves."""
    w = _WORD.findall((text or "").translate(_LOWER))
    if len(w) < words:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(zip(*(w[k:] for k in range(words))))


def shingle_hashes(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of some UTF-8 texts as 64-bit hashes: (text's number, hash),
    sorted by both."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = _LOWER_BYTES[data]
    inside = ~_BLANK[data]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    first = np.empty(len(at), dtype=bool)
    first[0] = True
    first[1:] = at[1:] != at[:-1] + 1
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _POWER, dtype=np.uint64))
    hashed = np.add.reduceat(_BYTE[data[at]] * powers[place], starts)
    hashed = mix64(hashed ^ mix64(lengths.astype(np.uint64), 1))
    doc = np.searchsorted(ends, at[starts], side="right")
    count = np.bincount(doc, minlength=len(texts))
    n = len(hashed)
    span = np.minimum(words, count)[doc]  # words in the shingle that starts here
    left = np.repeat(np.cumsum(count), count) - np.arange(n)  # words from here to the end
    out = mix64(span.astype(np.uint64), 2)
    for k in range(words):
        follow = np.minimum(np.arange(n) + k, n - 1)
        out = np.where(k < span, mix64(out ^ hashed[follow], 3), out)
    ok = left >= span
    doc, out = doc[ok], out[ok]
    order = np.lexsort((out, doc))
    doc, out = doc[order], out[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (out[1:] != out[:-1])
    return doc[new], out[new]


def band_keys(doc: np.ndarray, hashes: np.ndarray, n: int, bands: int, rows: int) -> np.ndarray:
    """Per text its band keys; texts without shingles get zeros."""
    keys = np.zeros((n, bands), dtype=np.uint64)
    have, starts = np.unique(doc, return_index=True)
    if len(have):
        scattered = mix32(((hashes >> np.uint64(32)) ^ hashes).astype(np.uint32))
        for b in range(bands):
            key = np.full(len(have), b, dtype=np.uint64)
            for r in range(rows):
                shift = np.uint32((b * rows + r) * 0x9E3779B1 & 0xFFFFFFFF)
                low = np.minimum.reduceat(mix32(scattered - shift), starts)
                key = mix64(key ^ low.astype(np.uint64), 4)
            keys[have, b] = key
    return keys


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
        ids.append(i)
        texts.append(t or b"")
        size += len(texts[-1])
        if size >= _SLICE:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """``id, n, f1, f2, bands`` per row: the set's size, its fingerprint and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _slices(batch):
                doc, hashes = shingle_hashes(texts, words)
                size = np.bincount(doc, minlength=len(texts))
                starts = np.cumsum(size) - size
                sums = []
                for salt in (5, 6):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes, salt))])
                    sums.append((total[starts + size] - total[starts]).astype(np.int64))
                keys = band_keys(doc, hashes, len(texts), bands, rows).astype(np.int64)
                flat = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, len(texts) * bands + 1, bands), pa.int32()), pa.array(keys.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(size), pa.array(sums[0]), pa.array(sums[1]), flat],
                    names=["id", "n", "f1", "f2", "bands"],
                )

    schema = "id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def _bits(shingles: frozenset) -> list[int]:
    """A bit map of the shingles in LONGS 64-bit integers: at most one bit for each."""
    bits = 0
    for s in shingles:
        bits |= 1 << (xxhash.xxh3_64_intdigest("\x00".join(s)) % (64 * LONGS))
    return [(bits >> (64 * k)) & (2**64 - 1) for k in range(LONGS)]


def _compared(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``pairs(u, v)`` with what their sets have in common: ``both`` shingles, whether they
    are ``linked``, and bit maps ``u0..`` and ``v0..`` of what only one of them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, frozenset()
        for batch in batches:
            u, v, at, bt = (batch.column(k).to_pylist() for k in range(4))
            both, linked, maps = [], [], []
            for y, a, b in zip(v, at, bt):
                if y != last:
                    last, own = y, word_set(b, words)
                other = word_set(a, words)
                n = len(own & other)
                both.append(n)
                linked.append(100 * n >= percent * (len(own) + len(other) - n))
                maps.append(_bits(other - own) + _bits(own - other))
            bits = np.array(maps, dtype=np.uint64).reshape(-1, 2 * LONGS).astype(np.int64)
            cols = [pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(both, pa.int64()), pa.array(linked, pa.bool_())]
            cols += [pa.array(bits[:, k]) for k in range(2 * LONGS)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    maps = [f"{x}{k}" for x in "uv" for k in range(LONGS)]
    names = ["u", "v", "both", "linked", *maps]
    schema = "u bigint, v bigint, both bigint, linked boolean, " + ", ".join(f"{m} bigint" for m in maps)
    rows = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("_a")), "u").join(
        texts.select(F.col("id").alias("v"), F.col("text").alias("_b")), "v"
    )
    return rows.select("u", "v", "_a", "_b").sortWithinPartitions("v").mapInArrow(run, schema)


def _unequal(members: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """``id, strange``: the members whose set isn't their representative's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, frozenset()
        for batch in batches:
            found = []
            for x, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if a != b:
                    if b != last:
                        last, own = b, word_set(b, words)
                    if word_set(a, words) != own:
                        found.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([True] * len(found), pa.bool_())], names=["id", "strange"])

    rows = members.join(texts.select("id", F.col("text").alias("_a")), "id")
    rows = rows.join(texts.select(F.col("id").alias("rep"), F.col("text").alias("_b")), "rep")
    return rows.select("id", "_a", "_b").mapInArrow(run, "id bigint, strange boolean").distinct()


def _lonely(texts: DataFrame, words: int) -> DataFrame:
    """``id, alone``: how many of a text's shingles no other of ``texts`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, own in _slices(batch):
                doc, hashes = shingle_hashes(own, words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.astype(np.int64)), pa.array(np.array(ids, dtype=np.int64)[doc])], names=["h", "id"]
                )

    rows = texts.select("id", "text").mapInArrow(run, "h bigint, id bigint")
    single = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).filter("c = 1")
    return single.groupBy("id").agg(F.count(F.lit(1)).alias("alone"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    bands: int = 36,
    rows: int = 5,
) -> DataFrame:
    """One row per input row: id, ``n_shingles, component_id, kept``."""
    sigs = written(signatures(docs, id_col, text_col, words, bands, rows), "signatures")
    # equal sets: one representative, the smallest id
    classes = written(
        sigs.filter("n > 0 and id is not null")
        .groupBy("f1", "f2", "n")
        .agg(F.min("id").alias("rep"), F.max("id").alias("_last"), F.first("bands").alias("bands")),
        "classes",
    )
    members = (
        sigs.join(classes.filter("rep < _last").select("f1", "f2", "n", "rep"), ["f1", "f2", "n"])
        .filter(F.col("id") != F.col("rep"))
        .select("id", "rep")
    )
    members = written(members.distinct(), "members")
    placed = classes.select("rep", "n", F.explode("bands").alias("key"))
    draw = F.struct(F.xxhash64("key", "rep").alias("d"), F.col("rep").alias("hub"), F.col("n").alias("hub_n"))
    hubs = placed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(draw).alias("h"))
    hubs = hubs.filter("c > 1").select("key", "h.hub", "h.hub_n")
    shared = written(placed.join(hubs, "key"), "buckets")  # members of buckets with company
    stars = written(
        shared.filter(F.col("rep") != F.col("hub"))
        .select(F.greatest("rep", "hub").alias("u"), F.least("rep", "hub").alias("v"))
        .distinct(),
        "stars",
    )
    wanted = shared.select(F.col("rep").alias("id")).union(members.select("id")).union(members.select("rep")).distinct()
    texts = written(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(
            wanted, "id", "left_semi"
        ),
        "texts",
    )
    strangers = written(_unequal(members, texts, words), "strangers")
    tested = written(_compared(stars, texts, words, percent), "tested")
    first = written(components(tested.filter("linked").select("u", "v")), "components")

    # buckets that still hold several components
    labelled = shared.join(first, F.col("rep") == F.col("node"), "left")
    labelled = labelled.select("key", "rep", "n", "hub", "hub_n", F.coalesce("root", "rep").alias("label"))
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")
    open_ = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), blocks).filter("lo < hi")
    rest = written(labelled.join(open_.select("key", "blocks"), "key"), "open")
    alone = _lonely(texts.join(rest.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), words)
    # what each member lacks of its hub, and what it has besides
    here, there = [f"u{k}" for k in range(LONGS)], [f"v{k}" for k in range(LONGS)]
    lost, extra = [f"l{k}" for k in range(LONGS)], [f"e{k}" for k in range(LONGS)]

    def seen_from(member: str, hub: str, own: list[str], other: list[str]) -> DataFrame:
        maps = [F.col(m).alias(x) for m, x in zip(other + own, lost + extra)]
        return tested.select(F.col(member).alias("_r"), F.col(hub).alias("_h"), "both", *maps)

    seen = seen_from("u", "v", here, there).union(seen_from("v", "u", there, here))
    rest = (
        rest.join(seen, (F.col("rep") == F.col("_r")) & (F.col("hub") == F.col("_h")), "left")
        .join(alone, F.col("rep") == F.col("id"), "left")
        .select(
            "key", "blocks", "rep", "n", "label", "hub_n",
            (F.col("n") - F.coalesce("both", "n")).alias("more"),
            F.coalesce("alone", F.lit(0)).alias("alone"),
            *[F.coalesce(x, F.lit(0)).alias(x) for x in lost + extra],
        )
    )
    rest = written(rest, "open")

    def either(maps: list[str]) -> Column:  # at least so many in the union
        return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a.{x}").bitwiseOR(F.col(f"b.{x}"))) for x in maps])

    shared_more = F.least(
        F.col("a.more") - F.col("a.alone"), F.col("b.more") - F.col("b.alone"), F.col("a.more") + F.col("b.more") - either(extra)
    )
    most = F.col("a.hub_n") - either(lost) + F.greatest(F.lit(0), shared_more)
    # each member once in its block, against all members in every block
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    everywhere = rest.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = (
        dealt.alias("a")
        .join(
            everywhere.alias("b"),
            (F.col("a.key") == F.col("b.key"))
            & (F.col("a.block") == F.col("b.block"))
            & (F.col("a.rep") > F.col("b.rep"))
            & (F.col("a.label") != F.col("b.label"))
            & (F.lit(100 + percent) * F.least(most, "a.n", "b.n") >= F.lit(percent) * (F.col("a.n") + F.col("b.n"))),
        )
        .select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))
        .distinct()
        .join(stars, ["u", "v"], "left_anti")
    )
    more = _compared(written(pairs, "pairs"), texts, words, percent).filter("linked").select("u", "v")
    found = components(first.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))

    labels = classes.select("f1", "f2", "n", "rep").join(found, F.col("rep") == F.col("node"), "left")
    labels = labels.select("f1", "f2", "n", F.coalesce("root", "rep").alias("label"))
    out = sigs.join(labels, ["f1", "f2", "n"], "left")
    out = out.join(strangers, "id", "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull() & F.col("strange").isNull(), F.col("label")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with all its columns, without the documents that another one stands for."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = found.filter("not kept").select(F.col(id_col).alias("_gone")).distinct()
    return without_repeats(docs, id_col, text_col, written(gone, "gone"))
