"""Column functions of waveforms: arrays of doubles, one sample an element."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def doubles(w: Column) -> Column:
    return F.transform(w, lambda x: x.cast("double"))


def amplitude(w: Column) -> Column:
    """The least sample."""
    return F.array_min(w)


def energy(w: Column) -> Column:
    """Root of the sum of squares, by the number of samples; null for an empty waveform."""
    return F.when(F.size(w) > 0, F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x)) / F.size(w))


def scaled(w: Column) -> Column:
    """Samples by the waveform's energy; null samples if that is zero."""
    return let(F.nullif(energy(w), F.lit(0.0)), lambda e: F.transform(w, lambda x: x / e))


def trough(w: Column) -> Column:
    """Place from 0 of the first least sample."""
    return (F.array_position(w, F.array_min(w)) - 1).cast("int")


def local_peaks(w: Column) -> Column:
    """Places of all strict local maxima, in order; a plateau counts at its middle (the place before it if that is between two),
    ends never."""
    none = F.lit(None).cast("int")

    def step(s: Column, i: Column) -> Column:
        here, back = F.get(w, i), F.get(w, i - 1)
        found = F.when((here < back) & s["up"].isNotNull(), F.array_append(s["at"], F.floor((s["up"] + i - 1) / 2).cast("int"))).otherwise(s["at"])
        return F.struct(F.when(here > back, i).when(here < back, none).otherwise(s["up"]).alias("up"), found.alias("at"))

    places = F.when(F.size(w) > 1, F.sequence(F.lit(1), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.struct(none.alias("up"), F.array().cast("array<int>").alias("at")), step, lambda s: s["at"])


def last_peak(w: Column, before: Column) -> Column:
    """Place of the last strict local maximum ahead of `before`; a plateau counts at its middle, ends never; else null.

    A rise opens a plateau, a fall closes it, and equal samples leave it open.
    """
    none = F.lit(None).cast("int")

    def step(s: Column, i: Column) -> Column:
        here, back = F.get(w, i), F.get(w, i - 1)
        middle = F.floor((s["up"] + i - 1) / 2).cast("int")
        closed = (here < back) & s["up"].isNotNull() & (middle < before)
        return F.struct(
            F.when(here > back, i).when(here < back, none).otherwise(s["up"]).alias("up"), F.when(closed, middle).otherwise(s["last"]).alias("last")
        )

    places = F.when(F.size(w) > 1, F.sequence(F.lit(1), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.struct(none.alias("up"), none.alias("last")), step, lambda s: s["last"])


def slope(w: Column) -> Column:
    """Slope from the last peak before the trough (else the greatest sample before it) to the trough; null if nothing is before."""

    def between(low: Column) -> Column:
        ahead = F.slice(w, F.lit(1), low)
        top = F.coalesce(last_peak(w, low), (F.array_position(ahead, F.array_max(ahead)) - 1).cast("int"))
        return F.when(low > 0, let(top, lambda t: (F.get(w, low) - F.get(w, t)) / (low - t)))

    return let(trough(w), between)


def every(w: Column, step: int = 10) -> Column:
    """Each step-th sample, the first included."""
    return F.filter(w, lambda x, i: i % step == 0)


def resampled(w: Column, fs: float, fs_new: float) -> Column:
    """Linear interpolation at fs_new; places after the last sample take its value."""
    n = F.floor(F.size(w) * F.lit(fs_new / fs)).cast("int")

    def at(j: Column) -> Column:
        x = j * F.lit(fs / fs_new)
        low = F.least(F.floor(x).cast("int"), F.size(w) - 1)
        high = F.least(low + 1, F.size(w) - 1)
        return F.get(w, low) + (F.get(w, high) - F.get(w, low)) * F.least(x - low, F.lit(1.0))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<double>"))


def haar(w: Column) -> Column:
    """Haar wavelet coefficients to full depth, coarsest first; an odd end is paired with itself."""
    root = math.sqrt(2)

    def level(s: Column, _: Column) -> Column:
        a = s["a"]
        half = F.sequence(F.lit(0), F.ceil(F.size(a) / 2).cast("int") - 1)
        pair = lambda sign: F.transform(half, lambda i: (F.get(a, 2 * i) + sign * F.coalesce(F.get(a, 2 * i + 1), F.get(a, 2 * i))) / root)
        return F.when(F.size(a) > 1, F.struct(pair(1).alias("a"), F.concat(pair(-1), s["d"]).alias("d"))).otherwise(s)

    depth = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size(w)))).cast("int"))
    start = F.struct(w.alias("a"), F.array().cast("array<double>").alias("d"))
    return F.when(F.size(w) > 0, F.aggregate(depth, start, level, lambda s: F.concat(s["a"], s["d"])))


def dejittered(w: Column, pre: int, post: int, fs: float = 1.0, factor: int = 10) -> Column:
    """The waveform at factor times the rate, cut from pre * factor before its trough to post * factor after it; null where it does not reach."""
    fine = resampled(w, fs, fs * factor)

    def cut(x: Column) -> Column:
        low = trough(x)
        inside = (low >= pre * factor) & (low + post * factor <= F.size(x))
        return F.when(inside, F.slice(x, low - pre * factor + 1, F.lit((pre + post) * factor)))

    return let(fine, cut)
