"""Language identification with a bit-sliced Bloom filter over character n-grams.

One filter serves all languages: every slot holds a mask with a bit per language, in as
many 64-bit words as they need, so the bitwise AND of an n-gram's k slots names all languages that contain it. A language's
score is the number of a text's n-grams that name it (a popcount over the masks), corrected
for the false positives that its own filling of the slots predicts.

Training takes a bounded sample: at most ``per_language`` distinct texts of each label. An
n-gram belongs to a language if it is at least ``share`` as frequent there as in the
language that has it most often; a language contributes its ``grams`` most frequent ones.
The filter has a fixed size, and so is broadcast with the code.

Defined results: a null text or one without a letter is ``und`` with score 0; a text whose
n-grams name no language, and any tie, gets the language with the most training texts, then
the first in alphabetical order; rows with a null id are never used for training; an empty
table, or one without labels, gives ``und``; repeated rows count once in training, and get
equal predictions; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Characters of a text that are hashed at once; bounds the memory for very long texts.
PART = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def _letters() -> np.ndarray:
    """For each code point of the basic plane its lower-case letter, or a space."""
    table = np.full(0x10000, 32, dtype=np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and (ch := chr(c)).isalpha():
            low = ch.lower()
            table[c] = ord(low[0])
    return table


_TABLE = _letters()


def gram_hashes(text: str, sizes: tuple[int, ...]) -> np.ndarray:
    """The 64-bit hashes of all n-grams of a text's words; a blank marks a word's edge."""
    code = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    code = np.where(code < 0x10000, _TABLE[np.minimum(code, 0xFFFF)], code)
    blank = code == 32
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])  # runs of other characters become one blank
    code = code[keep].astype(np.uint64)
    out = []
    for n in sizes:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ code[k : len(code) - n + 1 + k]) * _BASE
            h ^= h >> np.uint64(29)
        out.append(h * _MULT)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: tuple[int, ...]  # training texts
    slots: np.ndarray  # uint64 masks, a row per 64 languages
    rates: np.ndarray  # false-positive rate of each language
    hashes: int
    sizes: tuple[int, ...]

    def positions(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        m = np.uint64(self.slots.shape[-1] - 1)
        step = (grams >> np.uint64(32)) | np.uint64(1)
        for k in range(self.hashes):
            yield ((grams + np.uint64(k) * step) ^ (grams >> np.uint64(17 + 5 * k))) & m

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that contain it, a row per 64 languages."""
        found = np.full((*self.slots.shape[:-1], len(grams)), ~np.uint64(0), dtype=np.uint64)
        for at in self.positions(grams):
            found &= np.take(self.slots, at.astype(np.int64), axis=-1)
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        n, hits = 0, np.zeros(len(self.languages), dtype=np.int64)
        for at in range(0, len(text), PART):
            masks = self.masks(gram_hashes(text[at : at + PART + max(self.sizes) - 1], self.sizes))
            n += masks.shape[-1]
            hits += [np.count_nonzero(masks[k // 64] & np.uint64(1 << k % 64)) for k in range(len(self.languages))]
        true = np.maximum(0.0, (hits - n * self.rates) / (n * (1 - self.rates)))
        best = min(range(len(true)), key=lambda k: (-true[k], -self.weights[k], self.languages[k]))
        total = float(true.sum())
        return self.languages[best], float(true[best]) / total if total else 0.0


def train(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 1000,
    grams: int = 20_000,
    share: float = 0.25,
    sizes: tuple[int, ...] = (2, 3, 4),
    slots: int = 1 << 18,
    hashes: int = 3,
) -> Model:
    """Learns all labels from a sample of their rows that is bounded by ``per_language``."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    counts = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").collect()
    empty = Model((), (), np.zeros((1, 1), dtype=np.uint64), np.zeros(0), hashes, sizes)
    if not counts:
        return empty
    key = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col(id_col)), 1)
    # a first sieve to about 1.5 times the bound, so that the exact cut sees few rows
    limits = [
        F.when(F.col(lang_col) == r["lang"], F.lit(min(2**63 - 1, 3 * per_language * 2**62 // r["count"])))
        for r in counts
    ]
    sieved = rows.filter(key <= F.coalesce(*limits)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), key.alias("_key")
    )
    distinct = sieved.groupBy("lang", F.xxhash64("text").alias("_same")).agg(
        F.min("_key").alias("_key"), F.first("text").alias("text")
    )
    order = Window.partitionBy("lang").orderBy("_key", "_same")
    sample = distinct.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(gram_hashes(text, sizes))
            for lang, found in by.items():
                g, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n)], names=["lang", "g", "n"]
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([None], pa.int64()), pa.array([len(found)], pa.int64())],
                    names=["lang", "g", "n"],
                )

    tallied = sample.select("lang", "text").mapInArrow(count, "lang string, g bigint, n bigint")
    tallied = tallied.groupBy("lang", "g").agg(F.sum("n").alias("n"))
    top_n = Window.partitionBy("lang").orderBy(F.col("g").isNotNull(), F.desc("n"), "g")
    found = tallied.withColumn("_r", F.row_number().over(top_n)).filter(F.col("_r") <= 4 * grams + 1).toArrow()
    texts = {r["lang"]: r["n"] for r in found.filter(pc.field("g").is_null()).to_pylist()}
    got = found.filter(pc.field("g").is_valid()).to_pandas()
    langs = sorted(texts)
    got["p"] = got["n"] / got.groupby("lang")["n"].transform("sum")
    got = got[got["p"] >= share * got.groupby("g")["p"].transform("max")]
    got = got.sort_values(["lang", "n", "g"], ascending=[True, False, True]).groupby("lang").head(grams)
    bare = Model(tuple(langs), tuple(texts.get(x, 0) for x in langs), np.zeros((-(-len(langs) // 64), slots), dtype=np.uint64), np.zeros(len(langs)), hashes, sizes)
    for k, lang in enumerate(langs):
        own = got.loc[got["lang"] == lang, "g"].to_numpy().astype(np.uint64)
        for at in bare.positions(own):
            bare.slots[k // 64, at.astype(np.int64)] |= np.uint64(1 << k % 64)
    filled = np.array([np.count_nonzero(bare.slots[k // 64] & np.uint64(1 << k % 64)) / slots for k in range(len(langs))])
    return Model(bare.languages, bare.weights, bare.slots, filled**hashes, hashes, sizes)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts):
        import pandas as pd

        known = shared.value
        return pd.DataFrame([known.predict(t) for t in texts], columns=["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    found = docs.select(*[F.col(f"`{c}`") for c in kept], guess(F.col(text_col)).alias("_found"))
    return found.select(*[F.col(f"`{c}`") for c in kept], "_found.lang_pred", "_found.score")
