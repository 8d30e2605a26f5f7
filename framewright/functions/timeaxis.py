"""Conversions between samples, milliseconds, audio frames and video frames. All times are
integers; an interval's end is part of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(a: Column, b) -> Column:
    return F.floor(a / b).cast("long")


def frame_to_sample(frame: Column, size: int, step: int, end: bool = False) -> Column:
    return frame * step + (size - 1 if end else 0)


def sample_to_frame(sample: Column, size: int, step: int, end: bool = False) -> Column:
    if not end:
        return _div(sample, step)
    return F.when(sample < size, F.lit(0).cast("long")).otherwise(_div(sample - size, step) + 1)


def ms_to_sample(ms: Column, rate: int, end: bool = False) -> Column:
    """With whole samples per millisecond; as an end, the last sample of the millisecond."""
    per = rate // 1000
    return ms * per + (per - 1 if end else 0)


def sample_to_ms(sample: Column, rate: int) -> Column:
    return _div(sample, rate // 1000)


def ms_to_frame(ms: Column, rate: int, size: int, step: int) -> Column:
    return sample_to_frame(ms_to_sample(ms, rate), size, step)


def sample_to_video_frame(sample: Column, rate: int, fps: float, end: bool = False) -> Column:
    """The video frame whose start (or end) is nearest; a video frame need not be a whole
    number of samples."""
    size = F.lit(rate / fps)
    if not end:
        return F.round(sample / size).cast("long")
    return F.when(sample < size, F.lit(0).cast("long")).otherwise(F.round((sample - size) / size).cast("long") + 1)


def video_frame_to_sample(frame: Column, rate: int, fps: float, end: bool = False) -> Column:
    size = F.lit(rate / fps)
    return F.round(frame * size + (size - 1 if end else F.lit(0.0))).cast("long")


def ms_to_sample_fraction(ms: Column, rate: int, end: bool = False) -> Column:
    """``ms_to_sample`` of fractions of a millisecond."""
    per = rate // 1000
    return F.floor(ms * per).cast("long") + (per - 1 if end else 0)


def frequency_to_quefrency(hz: Column) -> Column:
    """The reciprocal, which is its own inverse; null at zero."""
    return F.when(hz != 0, 1 / hz)


def row_count(n: Column, size: int, step: int) -> Column:
    """Rows of a sliding window over n samples."""
    return F.when(n < size, F.lit(0).cast("long")).otherwise(_div(n - size, step) + 1)


def frequency_to_bin(hz: Column, rate: int, bins: int) -> Column:
    return F.least(F.greatest(F.round(hz / F.lit(rate / 2 / bins)).cast("long"), F.lit(0)), F.lit(bins))
