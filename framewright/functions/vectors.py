"""Vector functions on array columns, as higher-order expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def squared_error(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(squared_error(a, b))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def select_columns(x: Column, keep: list[int]) -> Column:
    return F.array(*[F.get(x, F.lit(k)) for k in keep])


def rotate(x: Column, n: int) -> Column:
    """A cyclic shift to the left."""
    k = F.lit(n) % F.size(x)
    return F.concat(F.slice(x, k + 1, F.size(x) - k), F.slice(x, F.lit(1), k))


def window(kind: str, n: int) -> list[float]:
    """A window function's values; the denominators are n - 1."""
    if n == 1 or kind == "rectangle":
        return [1.0] * n
    t = [k / (n - 1) for k in range(n)]
    return {
        "hamming": [0.54 - 0.46 * math.cos(2 * math.pi * x) for x in t],
        "hann": [0.5 * (1 - math.cos(2 * math.pi * x)) for x in t],
        "bartlett": [1 - abs(2 * x - 1) for x in t],
    }[kind]


def tapered(x: Column, kind: str, n: int) -> Column:
    return F.zip_with(x, F.array(*[F.lit(v) for v in window(kind, n)]), lambda a, b: a * b)


def pre_emphasis(x: Column, alpha: float) -> Column:
    return F.transform(x, lambda v, i: F.when(i == 0, v).otherwise(v - alpha * F.get(x, i - 1)))


def sign_changes(x: Column) -> Column:
    """Changes between negative and other values."""
    neg = F.transform(x, lambda v: F.when(v < 0, 1).otherwise(0))
    pairs = F.zip_with(F.slice(neg, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(neg, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: F.abs(a - b))
    return F.aggregate(pairs, F.lit(0), lambda s, v: s + v)


def energy_db(x: Column, floor: float = -873.0) -> Column:
    """Short-time energy in decibel; the first sample doesn't count."""
    e = total(F.transform(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda v: v.cast("double") * v))
    return F.when(e > 0, 10 * F.log10(e)).otherwise(F.lit(floor))


def dct(x: Column, n: int) -> Column:
    """DCT-II with the scale sqrt(2 / n), the first coefficient over sqrt(2)."""
    rows = []
    for k in range(n):
        scale = math.sqrt(2 / n) * (1 / math.sqrt(2) if k == 0 else 1)
        basis = F.array(*[F.lit(scale * math.cos(math.pi * k * (t + 0.5) / n)) for t in range(n)])
        rows.append(dot(x, basis))
    return F.array(*rows)


def idct(x: Column, n: int) -> Column:
    rows = []
    for t in range(n):
        scale = [math.sqrt(2 / n) * (1 / math.sqrt(2) if k == 0 else 1) for k in range(n)]
        rows.append(dot(x, F.array(*[F.lit(scale[k] * math.cos(math.pi * k * (t + 0.5) / n)) for k in range(n)])))
    return F.array(*rows)


def power_spectrum(x: Column, n: int, bins: int) -> Column:
    """Powers at the first ``bins`` frequencies above zero, by cosine and sine sums; for
    short frames. Long ones go through ``operators.spectral``."""
    out = []
    for k in range(1, bins + 1):
        c = dot(x, F.array(*[F.lit(math.cos(2 * math.pi * k * t / n)) for t in range(n)]))
        s = dot(x, F.array(*[F.lit(math.sin(2 * math.pi * k * t / n)) for t in range(n)]))
        out.append(c * c + s * s)
    return F.array(*out)


def haar(x: Column, low: bool = True) -> Column:
    """One level of the Haar transform: half sums, or half differences, over sqrt(2)."""
    places = F.sequence(F.lit(0), F.floor(F.size(x) / 2).cast("int") - 1)
    r = math.sqrt(0.5)
    pair = lambda i: (F.get(x, 2 * i), F.get(x, 2 * i + 1))
    return F.transform(places, lambda i: (pair(i)[0] + pair(i)[1]) * r if low else (pair(i)[0] - pair(i)[1]) * r)


def normalised_correlation(a: Column, b: Column, lag: int, n: int) -> Column:
    """Of the first n - lag values of one frame with those from ``lag`` on of the other."""
    x, y = F.slice(a, 1, n - lag), F.slice(b, lag + 1, n - lag)
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def reverse(x: Column) -> Column:
    return F.reverse(x)


def edge_tapered(x: Column, kind: str, n: int, part: float) -> Column:
    """The window's rise over the first, and its fall over the last ``part`` of n values; the
    middle is kept."""
    edge = min(int(n * part), n // 2)
    shape = window(kind, 2 * edge)
    weights = shape[:edge] + [1.0] * (n - 2 * edge) + shape[edge:]
    return F.zip_with(x, F.array(*[F.lit(w) for w in weights]), lambda a, b: a * b)


def log_determinant(triangle: Column, size: int) -> Column:
    """Log determinant of a symmetric positive definite matrix of up to three rows, given
    as its upper triangle by rows; null if it isn't positive."""
    m = [F.get(triangle, F.lit(k)) for k in range(size * (size + 1) // 2)]
    if size == 1:
        det = m[0]
    elif size == 2:
        det = m[0] * m[2] - m[1] * m[1]
    elif size == 3:
        a, b, c, d, e, f = m
        det = a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)
    else:
        raise ValueError("larger matrices go through numpy")
    return F.when(det > 0, F.ln(det))
