"""WARC archives with a two-level capture index.

Archives hold one gzip member per record. The capture index sorts reversed-host URL keys
(``https://a.b.org/x`` is ``org,b,a)/x``) into compressed blocks of some hundred lines; a
sparse directory keeps the first key of each block. Level one, the bounds of the index
files, and level two, the directory at the end of each file, are binary-searched; then only
the blocks that can hold the key are read, and of the archives only the records' ranges.

Payloads are deduplicated: of equal payloads of at least ``min_bytes`` bytes the record with
the smallest page id is the response and the others are revisits of it.

A task writes files under names of its own attempt, and what it returns names them; files
of lost attempts are never referred to. Files go to a folder that all executors share,
through Arrow's file systems.

Defined results: a null html is an empty payload; a null url has an empty key; a null page
id is larger than any other; of rows that repeat a response's page id and payload one is the
response, and the others revisit it; a table without rows gives an empty index; further
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.storage import fresh_dir, written

CAPTURE = "key string, page_id bigint, digest string, record_type string, file string, offset bigint, length bigint"
SHARD = "shard string, first_key string, last_key string, blocks bigint"
_NAMES = [c.split()[0] for c in CAPTURE.split(", ")]
#: Parameters of the archives.
LEVEL, ROTATE, LINES, READ = 4, 1 << 28, 512, 4 << 20
DATE = "2024-01-01T00:00:00Z"


def url_key(url: Column) -> Column:
    """The sort key: host labels reversed, then path and query; schema and port are dropped."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1))
    path = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", "")
    path = F.regexp_replace(path, r"(?s)#.*$", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)
    return F.when(url == "", F.lit("")).otherwise(key)


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system, path


class _Output:
    """Files of one task attempt, opened as they are needed."""

    def __init__(self, folder: str, suffix: str):
        self._folder, self._suffix, self._stream, self.uri, self.at = folder, suffix, None, "", 0

    def write(self, data: bytes) -> tuple[str, int]:
        if self._stream is None or self.at > ROTATE:
            self.close()
            self.uri = f"{self._folder}/{uuid.uuid4().hex}.{self._suffix}"
            system, path = _open(self.uri)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            self._stream, self.at = system.open_output_stream(path, compression=None), 0
        at = self.at
        self._stream.write(data)
        self.at += len(data)
        return self.uri, at

    def close(self) -> None:
        if self._stream is not None:
            self._stream.close()
            self._stream = None


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def make_record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One record, a gzip member."""
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "urn:none")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_record_id(first, digest)}")
        head.append(f"X-Refers-To-Page-Id: {first}")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(LEVEL, wbits=31)
    return z.compress(raw) + z.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], int, bytes]:
    """A record's header fields, its payload's full length, and the payload it holds. Raises
    if a response's payload doesn't have the recorded length and digest."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    if fields["WARC-Type"] == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if len(payload) != length or f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return fields, length, payload


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0
) -> DataFrame:
    """Writes a record per row below ``folder``; returns the captures, written as a table."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    own = [F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("_i"), F.col(id_col).isNull().alias("_no"), F.sha1(html).alias("sha")]
    keyed = pages.select(F.col(id_col).cast("long").alias("page_id"), *own, F.octet_length(html).alias("size"))
    keyed = keyed.filter(F.col("size") >= min_bytes)
    firsts = keyed.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    copies = keyed.join(firsts.select("sha", "first"), "sha").select("_i", "_no", "sha", "first").distinct()
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), url_key(F.col(url_col)).alias("key"), html.alias("html"), *own
    )
    # the number among rows of equal id and payload has the join's keys: no further shuffle
    keys = ["_i", "_no", "sha"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("key", "url"))
    rows = rows.join(copies.withColumn("copy", F.lit(True)), keys, "left").withColumn("nth", nth)
    again = F.col("copy").isNotNull() & (~F.col("page_id").eqNullSafe(F.col("first")) | (F.col("nth") > 1))
    rows = rows.select("page_id", "url", "key", "html", "sha", "first", again.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Output(folder, "warc.gz")
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                member = make_record(r["page_id"], r["url"], r["html"].encode(), digest, r["first"], r["revisit"])
                uri, at = out.write(member)
                kind = "revisit" if r["revisit"] else "response"
                found.append((r["key"], r["page_id"], digest, kind, uri, at, len(member)))
            yield _batch(found)
        out.close()

    return written(rows.mapInArrow(run, CAPTURE), "captures")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    cols = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=_NAMES)


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Writes the sorted index below ``folder``; returns its level one, a row per file."""
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, lines, directory, last = _Output(folder, "idx"), [], [], ""
        uri = ""

        def flush() -> None:
            nonlocal uri
            data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
            uri, at = out.write(data)
            directory.append((lines[0][0], at, len(data)))
            lines.clear()

        def finish() -> pa.RecordBatch:
            data = zlib.compress(json.dumps(directory).encode())
            out.write(data + len(data).to_bytes(8, "little"))
            row = [[uri], [directory[0][0]], [last], [len(directory)]]
            directory.clear()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in row], names=[c.split()[0] for c in SHARD.split(", ")])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                lines.append(row)
                last = row[0]
                if len(lines) >= LINES:
                    flush()
                    if out.at > ROTATE // 4:
                        yield finish()
        if lines:
            flush()
        if directory:
            yield finish()

    return written(ordered.select(*_NAMES).mapInArrow(run, SHARD), "shards")


class _Shard:
    """One index file: its directory, and the block read last."""

    def __init__(self, uri: str):
        system, path = _open(uri)
        self._file = system.open_input_file(path)
        size = self._file.size()
        n = int.from_bytes(self._file.read_at(8, size - 8), "little")
        self.directory = json.loads(zlib.decompress(self._file.read_at(n, size - 8 - n)))
        self._first = [x[0] for x in self.directory]
        self._block = (-1, [])

    def block(self, k: int) -> list[list]:
        if self._block[0] != k:
            _, at, n = self.directory[k]
            text = zlib.decompress(self._file.read_at(n, at)).decode()
            self._block = (k, [json.loads(x) for x in text.split("\n")])
        return self._block[1]

    def find(self, key: str) -> Iterator[tuple]:  # a block at a time
        k = max(0, bisect_left(self._first, key) - 1)  # the key may begin inside the block before
        while k < len(self._first) and self._first[k] <= key:
            lines = self.block(k)
            keys = [x[0] for x in lines]
            for line in lines[bisect_left(keys, key) : bisect_right(keys, key)]:
                yield tuple(line)
            k += 1


def _placed(asked: DataFrame, shards: DataFrame) -> DataFrame:
    """``shard, key``: the index files whose bounds hold each key."""
    bounds = asked.sparkSession.sparkContext.broadcast(
        sorted((r["first_key"], r["last_key"], r["shard"]) for r in shards.select("first_key", "last_key", "shard").collect())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bounds.value
        lasts = [b[1] for b in known]
        for batch in batches:
            found: list[tuple[str, str]] = []
            for key in batch.column(0).to_pylist():
                k = bisect_left(lasts, key)
                while k < len(known) and known[k][0] <= key:
                    found.append((known[k][2], key))
                    k += 1
            cols = list(zip(*found)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["shard", "key"])

    return asked.mapInArrow(run, "shard string, key string")


def lookup(shards: DataFrame, keys: DataFrame, most_shards: int = 1_000_000) -> DataFrame:
    """The captures of all distinct ``key`` values of ``keys``.

    Level one has a row per index file; tasks hold ``most_shards`` of them at once, and more
    are gone through in blocks. Then each task looks up the keys of its own index files, so a
    key of very many captures is many tasks' work."""
    blocks = -(-shards.count() // most_shards)
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = keys.select("key").filter("key is not null").distinct()
    if not blocks:
        return keys.sparkSession.createDataFrame([], CAPTURE)
    own = F.pmod(F.xxhash64("shard"), F.lit(blocks))
    placed = reduce(DataFrame.union, [_placed(asked, shards.filter(own == k)) for k in range(blocks)])
    placed = placed.repartition(parts, "shard", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("shard", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            found = []
            for uri, key in zip(*(c.to_pylist() for c in batch.columns)):
                if uri != at:
                    at, shard = uri, _Shard(uri)
                for line in shard.find(key):
                    found.append(line)
                    if len(found) >= 10_000:
                        yield _batch(found)
                        found = []
            if found:
                yield _batch(found)

    return placed.mapInArrow(run, CAPTURE)


def read_records(captures: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the captures, read by range: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to`` and the stored ``payload`` if asked for.
    Records that lie close to each other in an archive are read at once."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    schema += ", payload binary" if payload else ""
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = captures.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, stream = None, None
        for batch in batches:
            spans = list(zip(*(c.to_pylist() for c in batch.columns)))
            i = 0
            while i < len(spans):
                j, start = i, spans[i][1]
                while j < len(spans) and spans[j][0] == spans[i][0] and spans[j][1] + spans[j][2] - start <= READ:
                    j += 1
                j = max(j, i + 1)
                if spans[i][0] != uri:
                    uri = spans[i][0]
                    system, path = _open(uri)
                    stream = system.open_input_file(path)
                data = stream.read_at(spans[j - 1][1] + spans[j - 1][2] - start, start)
                rows = []
                for _, at, n in spans[i:j]:
                    fields, length, body = parse_record(data[at - start : at - start + n])
                    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                    rows.append(
                        (
                            None if page is None else int(page),
                            length,
                            fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                            fields["WARC-Type"],
                            None if refers is None else int(refers),
                            body,
                        )[: 5 + payload]
                    )
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                names = [c.split()[0] for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                i = j

    return spread.select("file", "offset", "length").mapInArrow(run, schema)


def round_trip(pages: DataFrame, url_col: str = "url", payload: bool = False, **options) -> DataFrame:
    """Writes archives and index, looks up the key of every page, and reads its records."""
    folder = fresh_dir(pages.sparkSession, "warc")
    captures = write_archives(pages, folder, url_col=url_col, **options)
    shards = build_index(captures, f"{folder}-index")
    found = written(lookup(shards, pages.select(url_key(F.col(url_col)).alias("key"))), "found")
    return read_records(found, payload)
