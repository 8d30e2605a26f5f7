"""Token ids in word-aligned Simple-8b files.

A 64-bit word has a 4-bit selector and 60 bits of data: the selector says how many ids of
how many bits follow. Ids of more than 60 bits are escaped: the word holds a zero, and the
block lists position and value. Blocks of 1024 ids are packed independently, and each has
its offset in the file's directory, so readers decode any block, and all words of many
blocks at once, with vector operations.

File: magic, the blocks (words, then escapes), the directory, its length and magic. The
directory has the blocks' offsets and counts, and the documents' ids and lengths. All
numbers are little-endian.

Defined results: a null or empty text is the end id alone; null ids come first and are
returned as null; rows that share an id are neighbours in the order of their texts; a table
without rows gives no files and an empty result; further columns are ignored. Files of lost
task attempts are never referred to.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.storage import fresh_dir, written

#: Fixed values of the coding: ids in a word, and bits of each, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1024
MAGIC = b"FWS8B001"
#: Blocks that are encoded together, and bytes of text.
_BLOCKS, _TEXT = 512, 1 << 22
_LIMIT = np.uint64(1) << np.uint64(60)
_WIDTHS = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)  # bits of each 16-bit number


def _widths(values: np.ndarray) -> np.ndarray:
    """The bits that each value takes, none for zero."""
    top, low = int(values.max()), np.uint64(0xFFFF)
    out = _WIDTHS.take((values & low).astype(np.int64))
    for shift in (16, 32, 48):
        if top >> shift:
            part = (values >> np.uint64(shift) & low).astype(np.int64)
            out = np.where(part > 0, _WIDTHS.take(part) + np.uint8(shift), out)
    return out


def encode_blocks(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words, escaped positions and escaped values for each block of the ids."""
    n = len(ids)
    if not n:
        return []
    blocks, full = -(-n // BLOCK), n // BLOCK
    values = np.zeros((blocks, BLOCK + int(COUNTS[0])), dtype=np.uint64)
    values[:full, :BLOCK] = ids[: full * BLOCK].reshape(full, BLOCK)
    values[full:, : n - full * BLOCK] = ids[full * BLOCK :]
    escaped = values >= _LIMIT
    escapes = [np.flatnonzero(row) for row in escaped] if escaped.any() else [np.zeros(0, np.int64)] * blocks
    kept = [values[k, at].copy() for k, at in enumerate(escapes)]
    values[escaped] = 0
    # the widest id from each place on, in ever longer windows; a selector that fits is
    # followed by selectors that fit, so counting them gives the one of the most ids
    best = np.full(values.shape, len(COUNTS) - 1, dtype=np.uint8)
    widest, size = _widths(values), 1
    for s in range(len(COUNTS) - 2, -1, -1):
        more = int(COUNTS[s]) - size
        widest, size = np.maximum(widest[:, :-more], widest[:, more:]), size + more
        best[:, :BLOCK] -= widest[:, :BLOCK] <= BITS[s]
    # all blocks advance together, a word at a time, until they are past their last place
    following = np.arange(values.size).reshape(values.shape)
    starts = following[:, 0].copy()
    following[:, :BLOCK] += COUNTS[best[:, :BLOCK]]
    at, seen = starts, []
    while (at < starts + BLOCK).any():
        seen.append(at)
        at = following.take(at)
    ends = starts + BLOCK
    ends[-1] = starts[-1] + n - (blocks - 1) * BLOCK
    places = np.stack(seen, axis=1)
    inside = places < ends[:, None]
    at, flat = places[inside], values.ravel()
    chosen = best.take(at)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.flatnonzero(np.bincount(chosen)):
        if BITS[s]:
            own = np.flatnonzero(chosen == s)
            first, packed = at[own], words[own]
            for k in range(COUNTS[s]):
                packed |= flat.take(first + k) << np.uint64(k * BITS[s])
            words[own] = packed
    cuts = np.concatenate([[0], np.cumsum(inside.sum(axis=1))])
    return [(words[cuts[k] : cuts[k + 1]], escapes[k], kept[k]) for k in range(blocks)]


def decode_words(words: np.ndarray, cuts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks: block k has the words ``cuts[k]:cuts[k + 1]`` and
    ``lengths[k]`` ids."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    before = np.cumsum(counts) - counts
    block = np.repeat(np.arange(len(lengths)), np.diff(cuts))
    inside = before - before[cuts[:-1]][block]  # place in the block
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), dtype=np.uint64)
    for s in np.unique(selectors):
        if BITS[s]:
            own = np.flatnonzero(selectors == s)
            mask = np.uint64((1 << int(BITS[s])) - 1)
            for k in range(COUNTS[s]):
                place = inside[own] + k
                ok = place < lengths[block[own]]
                value = (words[own] >> np.uint64(k * BITS[s])) & mask
                out[(starts[block[own]] + place)[ok]] = value[ok]
    return out


class Writer:
    """Writes one file; documents are added in order."""

    def __init__(self, stream):
        self._stream, self._held, self._size = stream, [], 0
        self._at = stream.write(MAGIC) or len(MAGIC)
        self._blocks: list[tuple[int, int, int, int]] = []  # offset, words, escapes, ids
        self._docs: list[tuple[int | None, int]] = []
        self.ids = 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.extend([doc], ids, [len(ids)])

    def extend(self, docs: list[int | None], ids: np.ndarray, lengths: Iterable[int]) -> None:
        """Adds documents whose ids follow one another."""
        self._docs += zip(docs, lengths)
        self._held.append(ids if getattr(ids, "dtype", None) == np.uint32 else np.asarray(ids, dtype=np.uint64))
        self._size += len(ids)
        self.ids += len(ids)
        if self._size >= _BLOCKS * BLOCK:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self._held) if self._held else np.zeros(0, np.uint32)
        cut = len(ids) if last else len(ids) - len(ids) % BLOCK
        for first in range(0, cut, _BLOCKS * BLOCK):
            some, out = ids[first : min(cut, first + _BLOCKS * BLOCK)], []
            for k, (words, places, values) in enumerate(encode_blocks(some)):
                out += [part.astype("<u8").tobytes() for part in (words, places, values) if len(part)]
                self._blocks.append((self._at, len(words), len(places), min(BLOCK, len(some) - k * BLOCK)))
                self._at += 8 * (len(words) + 2 * len(places))
            self._stream.write(b"".join(out))
        self._held, self._size = [ids[cut:].copy()], len(ids) - cut

    def close(self) -> None:
        self._flush(last=True)
        blocks = np.array(self._blocks, dtype="<i8").reshape(-1, 4)
        docs = json.dumps([d for d, _ in self._docs]).encode()
        sizes = np.array([n for _, n in self._docs], dtype="<i8").tobytes()
        head = np.array([len(blocks), len(self._docs), len(docs)], dtype="<i8").tobytes()
        data = head + blocks.tobytes() + sizes + docs
        self._stream.write(data + len(data).to_bytes(8, "little") + MAGIC)
        self._stream.close()


def read_documents(file, blocks_at_once: int = 1024) -> Iterator[tuple[int | None, list[np.ndarray]]]:
    """Each document's id and ids, the ids in pieces, from an open random-access file."""
    size = file.size()
    tail = file.read_at(16, size - 16)
    if tail[8:] != MAGIC or file.read_at(8, 0) != MAGIC:
        raise ValueError("not a Simple-8b file")
    n = int.from_bytes(tail[:8], "little")
    data = file.read_at(n, size - 16 - n)
    n_blocks, n_docs, n_names = np.frombuffer(data, "<i8", 3)
    blocks = np.frombuffer(data, "<i8", 4 * n_blocks, 24).reshape(-1, 4)
    sizes = np.frombuffer(data, "<i8", n_docs, 24 + 32 * n_blocks)
    names = json.loads(data[24 + 32 * n_blocks + 8 * n_docs :][:n_names])

    def pieces() -> Iterator[np.ndarray]:
        for first in range(0, n_blocks, blocks_at_once):
            own = blocks[first : first + blocks_at_once]
            start = int(own[0, 0])
            end = int(own[-1, 0] + 8 * (own[-1, 1] + 2 * own[-1, 2]))
            raw = np.frombuffer(file.read_at(end - start, start), dtype="<u8")
            at = (own[:, 0] - start) // 8
            cuts = np.concatenate([[0], np.cumsum(own[:, 1])])
            words = np.concatenate([raw[a : a + w] for a, w in zip(at, own[:, 1])])
            ids = decode_words(words, cuts, own[:, 3])
            begun = np.cumsum(own[:, 3]) - own[:, 3]
            for k in np.flatnonzero(own[:, 2]):
                a, e = at[k] + own[k, 1], own[k, 2]
                ids[begun[k] + raw[a : a + e].astype(np.int64)] = raw[a + e : a + 2 * e]
            yield ids

    source, rest = pieces(), np.zeros(0, dtype=np.uint64)
    for name, length in zip(names, sizes):
        left, parts = int(length), []
        while left:
            if not len(rest):
                rest = next(source)
            parts.append(rest[:left])
            rest, left = rest[left:], left - len(parts[-1])
        yield name, parts


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at least a row and otherwise little more than ``_TEXT`` bytes
    of text."""
    passed = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)) // _TEXT
    cuts = [0, *(np.flatnonzero(np.diff(passed)) + 1).tolist(), len(passed)]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if a < b)


def write_files(
    docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, pieces: int = 600_000
) -> DataFrame:
    """Writes the documents' ids in ascending order of document; returns a row per file:
    ``file, part, n_ids``, in the documents' order by ``part``. A worker keeps the ids of
    about ``pieces`` pieces of text."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from framewright.llm.bpe import encoder

        enc, writer = encoder(tokenizer, "words", pieces), None
        uri = f"{folder}/{uuid.uuid4().hex}.s8b"
        for batch in batches:
            for part in _parts(batch):
                if writer is None:
                    system, path = _system(uri)
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    writer = Writer(system.open_output_stream(path, compression=None))
                ids, lengths = enc.encode_words(part.column(1))
                ids = np.insert(ids, np.cumsum(lengths), np.uint32(end_id))
                writer.extend(part.column(0).to_pylist(), ids, (lengths + 1).tolist())
        if writer is not None:
            writer.close()
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([part]), pa.array([writer.ids])], names=["file", "part", "n_ids"])

    return written(rows.mapInArrow(run, "file string, part bigint, n_ids bigint"), "files")


def read_files(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: id, ``start, n_tokens, ids_crc32``. The ids before
    each file are summed on the driver; there is one number for each file."""
    spark = files.sparkSession
    known = sorted((r["part"], r["file"], r["n_ids"]) for r in files.collect())
    begun, rows = 0, []
    for _, file, n in known:
        rows.append((file, begun))
        begun += n
    listed = spark.createDataFrame(pa.table({"file": pa.array([r[0] for r in rows], pa.string()), "begun": pa.array([r[1] for r in rows], pa.int64())}))
    schema = f"{id_col} bigint, start bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(*(c.to_pylist() for c in batch.columns)):
                system, path = _system(uri)
                out = []

                def done() -> pa.RecordBatch:
                    cols = [pa.array(c, pa.int64()) for c in zip(*out)]
                    out.clear()
                    return pa.RecordBatch.from_arrays(cols, names=[id_col, "start", "n_tokens", "ids_crc32"])

                with system.open_input_file(path) as file:
                    for doc, pieces in read_documents(file):
                        crc, n = 0, 0
                        for ids in pieces:
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                            n += len(ids)
                        out.append((doc, start, n, crc))
                        start += n
                        if len(out) >= 10_000:
                            yield done()
                if out:
                    yield done()

    return listed.repartition(max(1, len(rows))).mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the documents' ids to files in the shared folder and reads them back."""
    return read_files(write_files(docs, fresh_dir(docs.sparkSession, "ids"), tokenizer, **options))
