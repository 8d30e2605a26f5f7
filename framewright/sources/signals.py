"""Sampled signals: RIFF-WAVE, NIST SPHERE and raw PCM files as rows, and back.

Files come through Spark's ``binaryFile`` reader, so any store that Spark reads will do. A
file is decoded as a whole by one task: ``path, sample_rate, channels, samples``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, format string, sample_rate int, channels int, samples array<smallint>"


def guess_format(path: Column) -> Column:
    """``wave``, ``nist``, ``raw`` or null, by the file's extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(ext.isin("wav", "wave"), "wave").when(ext.isin("nist", "sph"), "nist").when(ext.isin("raw", "pcm"), "raw")


def parse_wave(data: bytes) -> tuple[int, int, np.ndarray]:
    """Sample rate, channels and 16-bit samples of a RIFF-WAVE file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF-WAVE file")
    at, rate, channels = 12, 0, 1
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if kind not in (1, 0xFFFE) or bits != 16:
                raise ValueError("only 16-bit PCM is read")
        elif name == b"data":
            return rate, channels, np.frombuffer(body[: len(body) // 2 * 2], dtype="<i2")
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def parse_sphere(data: bytes) -> tuple[int, int, np.ndarray]:
    """Sample rate, channels and samples of a NIST SPHERE file; its header is a list of
    ``key -type value`` lines."""
    if not data.startswith(b"NIST_1A"):
        raise ValueError("not a SPHERE file")
    size = int(data.split(b"\n", 2)[1])
    fields = {}
    for line in data[:size].decode("latin-1").split("\n")[2:]:
        parts = line.split(None, 2)
        if parts and parts[0] == "end_head":
            break
        if len(parts) == 3:
            fields[parts[0]] = int(parts[2]) if parts[1] == "-i" else parts[2]
    order = ">i2" if fields.get("sample_byte_format", "01") == "10" else "<i2"
    body = data[size:]
    return int(fields["sample_rate"]), int(fields.get("channel_count", 1)), np.frombuffer(body[: len(body) // 2 * 2], dtype=order).astype("<i2")


def make_wave(samples: np.ndarray, rate: int, channels: int = 1) -> bytes:
    body = np.asarray(samples, dtype="<i2").tobytes()
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * 2, channels * 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body


def read_signals(spark: SparkSession, path: str, raw_rate: int = 8000) -> DataFrame:
    """The signals of all files under a path or pattern; others are left out."""
    files = spark.read.format("binaryFile").load(path).withColumn("format", guess_format(F.col("path"))).filter("format is not null")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for name, kind, data in zip(pdf["path"], pdf["format"], pdf["content"]):
                if kind == "raw":
                    rate, channels, x = raw_rate, 1, np.frombuffer(data[: len(data) // 2 * 2], dtype="<i2")
                else:
                    rate, channels, x = parse_wave(data) if kind == "wave" else parse_sphere(data)
                rows.append((name, kind, rate, channels, x))
            yield pd.DataFrame(rows, columns=["path", "format", "sample_rate", "channels", "samples"])

    return files.select("path", "format", "content").mapInPandas(decode, SCHEMA)


def to_mono(signals: DataFrame) -> DataFrame:
    """The mean of the channels, added up in wide integers."""
    n = F.col("channels")
    places = F.sequence(F.lit(0), F.floor(F.size("samples") / n).cast("int") - 1)
    mean = F.transform(places, lambda i: F.round(F.aggregate(F.slice("samples", i * n + 1, n), F.lit(0).cast("long"), lambda s, v: s + v) / n).cast("smallint"))
    return signals.withColumn("samples", F.when(n > 1, mean).otherwise(F.col("samples"))).withColumn("channels", F.lit(1))


def slice_samples(signals: DataFrame, start: int, end: int) -> DataFrame:
    """Samples start to end, both included."""
    return signals.withColumn("samples", F.slice("samples", start + 1, end - start + 1))


def as_rows(signals: DataFrame) -> DataFrame:
    """One row a sample: ``path, fli, x``."""
    return signals.select("path", F.posexplode("samples").alias("fli", "x")).withColumn("fli", F.col("fli").cast("long"))


def wave_files(signals: DataFrame) -> DataFrame:
    """``path, content`` of the signals as RIFF-WAVE, to be stored in any table."""

    @F.pandas_udf("binary")
    def make(samples: pd.Series, rate: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([make_wave(np.asarray(x), int(r), int(c)) for x, r, c in zip(samples, rate, channels)])

    return signals.select("path", make("samples", "sample_rate", "channels").alias("content"))


def mu_law(x: np.ndarray) -> np.ndarray:
    """16-bit samples to 8-bit mu-law codes."""
    x = np.clip(x.astype(int), -32635, 32635)
    sign, mag = np.where(x < 0, 0x80, 0), np.abs(x) + 132
    exponent = np.clip(np.floor(np.log2(mag)).astype(int) - 7, 0, 7)
    return (~(sign | exponent << 4 | mag >> (exponent + 3) & 15) & 0xFF).astype(np.uint8)


def mu_law_inverse(code: np.ndarray) -> np.ndarray:
    c = ~code.astype(int) & 0xFF
    mag = (((c & 15) << 3) + 132 << (c >> 4 & 7)) - 132
    return np.where(c & 0x80, -mag, mag).astype(np.int16)
