"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A document costs ``linear * n + quadratic * n^2`` for its n tokens: the matrix products and
the attention inside it. Whole sequences are cut off long documents first; then the
remainders, most costly first, each go to the sequence of lowest cost that still has room
for all of it. If none has, the document is cut: the open sequence of lowest cost is filled
up, and what is left over is placed like a further document.

Packing happens where the documents lie, without a shuffle, in blocks of a bounded number
of tokens; a block's unfilled sequences pass their documents on to the next block. At the
end of a partition the last tokens are cut at powers of two, at which sequences need no
padding, so there is no padding at all.

Defined results: a null or empty text is the end id alone; repeated rows are packed like
any other rows; a null id is returned as null; an empty table gives an empty result;
further columns are ignored. Sequence ids are unique, not consecutive: the partition's
number times 2^32 plus a count, so they depend on how the input is split into partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "{id} bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, ids binary"
)

#: Rows whose texts are copied out of a batch at once.
PART = 500


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int]]]:
    """Places pieces of the given lengths (each under ``capacity``) into as few sequences
    as their sum allows: per sequence, a list of (piece, start in the piece, length). All
    sequences but the last are filled; that one has room for the rest of the sum only."""
    total = int(lengths.sum())
    count = -(-total // capacity)
    cost, room = np.zeros(count), np.full(count, capacity, dtype=np.int64)
    room[-1] = total - (count - 1) * capacity
    placed: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]

    def put(k: int, piece: int, start: int, n: int) -> None:
        placed[k].append((piece, start, n))
        cost[k] += linear * n + quadratic * n * n
        room[k] -= n

    for piece in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[piece])
        while left:
            open_ = room >= left
            n = left
            if not open_.any():
                open_ = room > 0
                k = int(np.argmin(np.where(open_, cost, np.inf)))
                n = int(room[k])
            else:
                k = int(np.argmin(np.where(open_, cost, np.inf)))
            put(k, int(piece), start, n)
            start, left = start + n, left - n
    return placed


class Packer:
    """Packs a stream of documents; holds at most about ``block`` tokens."""

    def __init__(self, capacity: int, linear: float, quadratic: float, block: int, first_id: int):
        self.capacity, self.linear, self.quadratic, self.block = capacity, linear, quadratic, block
        self.next_id = first_id
        self.rests: list[tuple[object, int, int, bytes]] = []  # id, start, doc_tokens, ids
        self.held = 0

    def _row(self, rest, start: int, n: int, offset: int) -> tuple:
        doc, at, doc_tokens, ids = rest
        own = ids[4 * start : 4 * (start + n)]
        return doc, at + start, n, zlib.crc32(own), doc_tokens, self.next_id, offset, own

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        n, c = len(ids) // 4, self.capacity
        for start in range(0, n - n % c, c):
            yield self._row((doc, 0, n, ids), start, c, 0)
            self.next_id += 1
        if n % c:
            self.rests.append((doc, n - n % c, n, ids[4 * (n - n % c) :]))
            self.held += n % c
        if self.held >= self.block:
            yield from self.pack(last=False)

    def pack(self, last: bool) -> Iterator[tuple]:
        rests, self.rests, self.held = self.rests, [], 0
        if not rests:
            return
        lengths = np.array([len(r[3]) // 4 for r in rests], dtype=np.int64)
        for parts in assign(lengths, self.capacity, self.linear, self.quadratic):
            filled = sum(n for _, _, n in parts)
            if filled < self.capacity and not last:
                for p, start, n in parts:
                    doc, at, doc_tokens, ids = rests[p]
                    self.rests.append((doc, at + start, doc_tokens, ids[4 * start : 4 * (start + n)]))
                    self.held += n
                continue
            target, offset, left = self.capacity, 0, filled
            for p, start, n in parts:
                while n:
                    if offset == 0 and left < self.capacity:
                        target = 1 << (left.bit_length() - 1)  # the largest power of two
                    take = min(n, target - offset)
                    yield self._row(rests[p], start, take, offset)
                    start, n, offset, left = start + take, n - take, offset + take, left - take
                    if offset == target:
                        self.next_id += 1
                        offset = 0


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 0,
    linear: float = 1.0,
    quadratic: float = 1 / 1024,
    block: int = 1 << 19,
    pieces: int = 1_200_000,
) -> DataFrame:
    """One row per piece: id, ``start, length, ids_crc32, doc_tokens, sequence_id, offset``
    and the piece's ``ids`` as little-endian unsigned 32-bit integers. A worker keeps the
    ids of about ``pieces`` pieces of text."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from framewright.llm.bpe import encoder

        enc = encoder(tokenizer, "bytes", pieces)
        packer = Packer(capacity, linear, quadratic, block, TaskContext.get().partitionId() << 32)
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows))
            rows.clear()
            types = [pa.int64()] * 7 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for batch in (b.slice(k, PART) for b in batches for k in range(0, len(b), PART)):
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(texts)):
                for row in packer.add(doc, ids + end):
                    rows.append(row)
                    size += len(row[-1])
                if size > 4_000_000:
                    yield flush()
                    size = 0
        rows.extend(packer.pack(last=True))
        if rows:
            yield flush()

    schema = SCHEMA.format(id=id_col)
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col)).mapInArrow(run, schema)
