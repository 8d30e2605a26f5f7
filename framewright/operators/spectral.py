"""Kernels applied to framed signals in Arrow batches, and per-key sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators import kernels


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=float)


def extracted(framed: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], samples: str = "samples", name: str = "feat") -> DataFrame:
    """Each frame's feature vector: the kernel gets a batch of frames of equal length as a
    matrix and returns a matrix with a row for each."""
    kept = [c for c in framed.columns if c != samples]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = np.asarray(kernel(_matrix(batch.column(len(kept)))), dtype=float)
                rows = pa.array([list(r) for r in out], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], rows], names=[*kept, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in framed.select(*kept).schema.fields) + f", `{name}` array<double>"
    return framed.select(*kept, samples).mapInArrow(run, schema)


def mfcc(framed: DataFrame, rate: float, filters: int = 40, coefficients: int = 20, alpha: float = 0.97) -> DataFrame:
    return extracted(framed, lambda x: kernels.mfcc(x, rate, filters, coefficients, alpha))


def spectrum(framed: DataFrame) -> DataFrame:
    return extracted(framed, kernels.spectrum)


def lpc(framed: DataFrame, order: int) -> DataFrame:
    """Prediction coefficients without the leading 1, then the gain."""
    return extracted(framed, lambda x: np.array([np.append(a[1:], g) for a, g in (kernels.lpc(r, order) for r in x)]))


def lpc_cepstrum(framed: DataFrame, order: int, n: int) -> DataFrame:
    return extracted(framed, lambda x: np.array([kernels.lpc_cepstrum(*kernels.lpc(r, order), n) for r in x]))


def line_spectrum(framed: DataFrame, order: int) -> DataFrame:
    def one(frame: np.ndarray) -> np.ndarray:
        found = kernels.line_spectrum(kernels.lpc(frame, order)[0])[:order]
        return np.pad(found, (0, order - len(found)))

    return extracted(framed, lambda x: np.array([one(r) for r in x]))


def pitch(framed: DataFrame, rate: float, low: float = 60.0, high: float = 400.0) -> DataFrame:
    return extracted(framed, lambda x: np.array([[kernels.pitch(r, rate, low, high)] for r in x]))


def sequence_scores(a: DataFrame, b: DataFrame, key: str, order: str, vector: str, score: Callable[[np.ndarray, np.ndarray], float] = kernels.dtw) -> DataFrame:
    """A score of the two sequences of each key, such as dynamic time warping. A key's two
    sequences are held by one task."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_o")
        left, right = (pdf[pdf["_side"] == k]["_v"] for k in (0, 1))
        if left.empty or right.empty:
            return pd.DataFrame({key: pdf[key].iloc[:0], "score": []})
        return pd.DataFrame({key: [pdf[key].iloc[0]], "score": [score(np.stack(left.to_numpy()), np.stack(right.to_numpy()))]})

    kind = a.schema[key].dataType.simpleString()
    one = lambda df, side: df.select(key, F.col(order).alias("_o"), F.col(vector).alias("_v"), F.lit(side).alias("_side"))
    return one(a, 0).unionByName(one(b, 1)).groupBy(key).applyInPandas(run, f"`{key}` {kind}, score double")


def change_scores(frames: DataFrame, vector: str, keys: list[str], pos: str, length: int, step: int, penalty: float = 1.0) -> DataFrame:
    """Bayesian change scores between neighbouring windows of feature rows: ``keys, at,
    score``, positive where one Gaussian fits worse than two. Each window pair is assembled
    from its own rows, so a long file is spread over many tasks."""
    import pandas as pd

    first = F.greatest(F.lit(0), F.floor((F.col(pos) - 2 * length) / step) + 1)
    spread = frames.select(*keys, F.col(pos).alias("_p"), F.col(vector).alias("_v"), F.explode(F.sequence(first, F.floor(F.col(pos) / step))).alias("_w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_p")
        start = int(pdf["_w"].iloc[0]) * step
        x = np.stack(pdf["_v"].to_numpy()).astype(float)
        a, b = x[pdf["_p"] < start + length], x[pdf["_p"] >= start + length]
        out = pdf.iloc[:1][keys].copy()
        out["at"] = start + length
        out["score"] = kernels.delta_bic(a, b, penalty) if min(len(a), len(b)) > x.shape[1] else 0.0
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.select(*keys).schema.fields) + ", at bigint, score double"
    return spread.groupBy(*keys, "_w").applyInPandas(run, schema)
