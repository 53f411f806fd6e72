"""Waveform functions against NumPy formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.functions import waveform as wf


def run(spark, waves, column):
    df = spark.createDataFrame([(i, [float(x) for x in w]) for i, w in enumerate(waves)], "i int, w array<double>")
    return [r.y for r in df.select("i", column.alias("y")).orderBy("i").collect()]


WAVES = [[0, 1, 3, 2, -5, 0], [5, 1, 2], [0, 2, 2, 0, -1], [0, 0, 0], [3, 2, 1, -1], [0, 1, 0, 4, 4, 4, 1, -9, 3]]


def test_slope(spark):
    got = run(spark, WAVES, wf.slope(F.col("w")))
    # a peak at 2; the greatest sample ahead; a plateau's middle; nothing ahead of the trough; a monotone fall; a plateau of three
    assert got == [(-5 - 3) / 2, (1 - 5) / 1, (-1 - 2) / 3, None, (-1 - 3) / 3, (-9 - 4) / 3]


def test_energy_and_scale(spark):
    for w, e in zip(WAVES, run(spark, WAVES, wf.energy(F.col("w"))), strict=True):
        assert e == pytest.approx(np.sqrt(np.square(w).sum()) / len(w))
    assert run(spark, WAVES, wf.scaled(F.col("w")))[3] == [None, None, None]


@pytest.mark.parametrize("n", [64, 15, 1, 2])
def test_haar(spark, n):
    w = np.random.default_rng(n).standard_normal(n)
    a, d = w, []
    while len(a) > 1:
        a = np.append(a, a[-1]) if len(a) % 2 else a
        d = [*((a[::2] - a[1::2]) / np.sqrt(2)), *d]
        a = (a[::2] + a[1::2]) / np.sqrt(2)
    got = run(spark, [w], wf.haar(F.col("w")))[0]
    assert np.allclose(got, [*a, *d])
    if n == 64:
        assert np.square(got).sum() == pytest.approx(np.square(w).sum())


def test_resample(spark):
    w = [0.0, 2.0, 4.0, 0.0]
    got = run(spark, [w], wf.resampled(F.col("w"), 1.0, 2.0))[0]
    assert got == [0, 1, 2, 3, 4, 2, 0, 0]


def test_dejitter(spark):
    w = [0.0] * 10
    w[4], w[5] = -4.0, -1.0
    got = run(spark, [w, [-1.0, *[0.0] * 9]], wf.dejittered(F.col("w"), 2, 3))
    assert len(got[0]) == 50 and got[0].index(min(got[0])) == 20 and min(got[0]) == -4 and got[1] is None
