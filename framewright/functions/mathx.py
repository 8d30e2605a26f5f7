"""Scalar mathematics with the guards of log-domain statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_ZERO, EXP_MOST = -705.0, 706.0


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(LOG_ZERO))


def safe_exp(x: Column) -> Column:
    return F.exp(F.least(x, F.lit(EXP_MOST)))


def log_add(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)) without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def sign(x: Column) -> Column:
    return F.when(x < 0, -1).otherwise(1)


def rescale(x: Column, low, high, new_low, new_high) -> Column:
    return (x - low) * ((new_high - new_low) / (high - low)) + new_low


def z_transform(x: Column, mean, sd) -> Column:
    return (x - mean) / sd


#: Where the logistic curve begins and ends for the usual eps of 1e-6.
EPS, BEGIN, END = 1e-6, -13.81550955796377, 13.81551055796427


def sigmoid(x: Column, zero_at: float, half_at: float, one_at: float, eps: float = EPS, p: float = 1.0) -> Column:
    """A curve that is 0 before ``zero_at``, a half at ``half_at`` and 1 from ``one_at`` on,
    logistic with slope ``p`` between; it falls if ``zero_at`` is the larger end."""
    begin, end = (BEGIN, END) if eps == EPS else (math.log(eps), -math.log(eps))
    left, right = min(zero_at, one_at), max(zero_at, one_at)
    scaled = F.when(x < half_at, rescale(x, left, half_at, begin, 0.0)).otherwise(rescale(x, half_at, right, 0.0, end))
    rising = F.when(x < left, 0.0).when(x >= right, 1.0).otherwise(1 / (1 + F.exp(-p * scaled)))
    return rising if zero_at < one_at else 1 - rising


def inverse_sigmoid(y: Column, zero_at: float, half_at: float, one_at: float, eps: float = EPS, p: float = 1.0) -> Column:
    """Where the curve has the value y, between its ends; straight lines for a slope of 0."""
    most = math.log(1 / eps - 1)
    if p == 0:
        part = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), 2 * y - 1))
    else:
        inside = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), y))
        part = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), -F.ln(1 / inside - 1) / (p * most)))
    return half_at + F.when(part < 0, part * (half_at - zero_at)).otherwise(part * (one_at - half_at))


def binomial(n: Column, k: Column) -> Column:
    """n over k."""
    few = F.least(k, n - k)
    terms = F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), few).cast("long"))
    product = F.aggregate(terms, F.lit(1.0), lambda s, i: s * (n - few + i) / i)
    return F.round(F.when(few > 0, product).when(few == 0, 1.0).otherwise(0.0))


def gauss_log_pdf(x: Column, mean, variance) -> Column:
    d = x - mean
    return -0.5 * (F.ln(F.lit(2 * math.pi) * variance) + d * d / variance)


def is_power_of_two(x: Column) -> Column:
    return F.bit_count(x) <= 1


def intersect(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length that two closed intervals share."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)


def round_half_away(x: Column) -> Column:
    """Cut after half a unit was added away from zero."""
    return F.when(x > 0, x + 0.5).otherwise(x - 0.5).cast("long")


def clamp(low, x: Column, high) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def uniform(*key: Column, salt: str = "") -> Column:
    """A draw from [0, 1) that is a function of the row's key and the salt. Unlike ``rand``
    it is the same in whatever partition the row is, and after a lost task has run again."""
    digest = F.md5(F.concat_ws(":", F.lit(salt), *[k.cast("string") for k in key]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2**32)


def normal(*key: Column, mean: float = 0.0, sd: float = 1.0, salt: str = "") -> Column:
    """A Gaussian draw, by Box and Muller, of two uniform ones."""
    u, v = uniform(*key, salt=salt + "u"), uniform(*key, salt=salt + "v")
    return mean + sd * F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * math.pi * v)


def categorical(weights: list[float], *key: Column, salt: str = "") -> Column:
    """The number of the class drawn with probabilities in proportion to ``weights``."""
    u, total = uniform(*key, salt=salt), sum(weights)
    upto, out = 1.0, F.lit(len(weights) - 1)
    for k in range(len(weights) - 1, 0, -1):
        upto -= weights[k] / total
        out = F.when(u < upto, F.lit(k - 1)).otherwise(out)
    return out


def magnitude_bin(x: Column, per_octave: int = 256) -> Column:
    """A whole number that never falls as x grows, with ``per_octave`` steps from a value to
    twice that value: the key by which running sums over all values become running sums
    inside one bin, on top of those of the bins before."""
    v, zero = x.cast("double"), 1100 * per_octave
    step = lambda y: F.floor(F.least(F.log2(y), F.lit(1025.0)) * per_octave) + zero
    return F.when(F.isnan(v), 2 * zero).when(v > 0, step(v)).when(v < 0, -step(-v)).otherwise(F.lit(0)).cast("long")
