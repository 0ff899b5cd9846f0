"""Frame and level functions over arrays of samples, and pitch-window functions.

Samples are squared as doubles.  Pitch windows are arrays in which null is an unvoiced window.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curalith.functions.text import decibels, let, semitones

FRAME_S = 0.02


def hop(rate: Column | int) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(FRAME_S) * rate).cast("int"))


def _power(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def rms(samples: Column) -> Column:
    return F.sqrt(_power(samples) / F.size(samples))


def frame_levels(samples: Column, step: Column) -> Column:
    """Level of each whole frame in dB; the last part of a frame is left out."""
    n = F.floor(F.size(samples) / step).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: decibels(rms(F.slice(samples, i * step + 1, step))))).otherwise(F.array().cast("array<double>"))


def peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))


def clipped_fraction(samples: Column, level: float = 0.999) -> Column:
    return F.size(F.filter(samples, lambda x: F.abs(x.cast("double")) >= level)).cast("double") / F.nullif(F.size(samples), F.lit(0))


def end_level(samples: Column, rate: Column | int, window_s: float = 0.03) -> Column:
    """Level of the last window against the peak in dB; -200 for silence."""
    n = F.greatest(F.lit(1), F.floor(F.lit(window_s) * rate).cast("int"))
    tail = F.slice(samples, -F.least(n, F.size(samples)), n)
    return F.when(peak(samples) > 0, decibels(rms(tail) / peak(samples))).otherwise(-200.0)


def voiced_edges(levels: Column, below: float = 40.0) -> Column:
    """first, last: places of the first and last frame louder than the loudest less ``below`` dB."""
    loud = lambda top: F.filter(F.transform(levels, lambda x, i: F.when(x > top - below, i)), lambda i: i.isNotNull())
    return let(let(F.array_max(levels), loud), lambda on: F.struct(F.array_min(on).alias("first"), F.array_max(on).alias("last")))


def percentile_of(values: Column, p: float) -> Column:
    """Percentile of an array with linear interpolation; null for an empty one."""

    def interpolated(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(p)
        a, b = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
        return F.when(F.size(s) > 0, a + (b - a) * (at - F.floor(at)))

    return let(F.array_sort(values), interpolated)


def median_of(values: Column) -> Column:
    return percentile_of(values, 0.5)


def noise_ratio(levels: Column, first: Column, last: Column) -> Column:
    """snr: 90th percentile of the speech frames less the median of at least five edge frames, else
    null; rough: the same less the 10th percentile of all frames."""
    edge = F.concat(F.slice(levels, F.lit(1), first), F.slice(levels, last + 2, F.size(levels)))
    speech = percentile_of(F.slice(levels, first + 1, last - first + 1), 0.9)
    return F.struct(F.when(F.size(edge) >= 5, speech - median_of(edge)).alias("snr"), (speech - percentile_of(levels, 0.1)).alias("rough"))


def downmixed(channels: Column) -> Column:
    """The mean of an array of channels, sample by sample."""
    mean = lambda all_: F.transform(F.get(all_, F.lit(0)), lambda _, i: F.aggregate(F.transform(all_, lambda c: F.get(c, i).cast("double")), F.lit(0.0), lambda a, v: a + v) / F.size(all_))
    return let(channels, mean)


def with_gaps(parts: Column, rate: int, gap_s: float = 0.12) -> Column:
    """Parts one after the other with silence between them."""
    gap = F.array_repeat(F.lit(0.0), int(gap_s * rate))
    return F.flatten(F.transform(parts, lambda p, i: F.when(i > 0, F.concat(gap, p)).otherwise(p)))


def opening(windows: Column) -> Column:
    """The median of the first two voiced windows."""
    return median_of(F.slice(F.filter(windows, lambda w: w.isNotNull()), 1, 2))


def pitch_drop(windows: Column) -> Column:
    """Largest drop below the opening in semitones; unvoiced windows count 0; null if none is voiced."""
    return let(opening(windows), lambda ref: F.when(ref.isNotNull(), F.array_max(F.transform(windows, lambda w: F.coalesce(semitones(ref, w), F.lit(0.0))))))


def take_floor(windows: Column, min_voiced: float, min_opening: float) -> Column:
    """The lowest window; 0 if too few are voiced or the opening is too low."""
    voiced = F.filter(windows, lambda w: w.isNotNull())
    bad = (F.size(windows) == 0) | (F.size(voiced) < min_voiced * F.size(windows)) | (F.coalesce(opening(windows), F.lit(0.0)) < min_opening)
    return F.when(bad, 0.0).otherwise(F.array_min(voiced))
