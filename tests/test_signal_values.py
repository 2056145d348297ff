"""Speed, stretching, spectra and disturbances by plain loops over single samples."""

import cmath
import math

import numpy as np
import pytest

from tonelake.functions import text
from tonelake.operators import signal
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def waves(spark):
    rows = [("PARIS PARIS", 12.0), ("CQ DE TEST", 20.0), ("THE FOX", 31.0), ("E", 20.0)]
    df = spark.createDataFrame(rows, "t string, wpm double")
    made = [signal.render(df.where(F.col("t") == t).withColumn("events", text.timing_events(F.col("t"), w)), "events", hz=640.0, noise=0.01).first()["audio"] for t, w in rows]
    return [np.array(x, np.float32) for x in made] + [np.zeros(4000, np.float32), np.zeros(0, np.float32), np.ones(10, np.float32)]


def percentile(values, q):
    v = sorted(values)
    at = q / 100 * (len(v) - 1)
    low = math.floor(at)
    return v[low] + (at - low) * (v[min(low + 1, len(v) - 1)] - v[low])


def plain_speed(x):
    power = [math.sqrt(sum(float(v) ** 2 for v in x[k : k + 16]) / 16) for k in range(0, len(x) // 16 * 16, 16)]
    if not power or max(power) <= 0:
        return 20.0
    smooth = []
    for k in range(len(power)):
        near = sorted(power[max(0, k - 2) : k + 3])
        smooth.append(near[len(near) // 2] if len(near) % 2 else (near[len(near) // 2 - 1] + near[len(near) // 2]) / 2)
    floor, peak = percentile(smooth, 20), percentile(smooth, 95)
    if peak <= floor:
        return 20.0
    tones, run = [], 0
    for v in [*smooth, -1.0]:
        if v > floor + 0.35 * (peak - floor):
            run += 1
        else:
            tones += [run * 0.002] if run and run * 0.002 >= 0.6 / 80 else []
            run = 0
    dit = percentile(tones, 10) if tones else 0
    return min(80.0, max(3.0, 1.2 / dit)) if dit > 0 else 20.0


def test_speed_equals_a_loop(waves):
    for x in waves:
        assert math.isclose(signal.speed(x), plain_speed(x), rel_tol=1e-6)


def test_stretching_equals_a_loop(waves):
    for x in waves:
        for factor in (0.5, 0.995, 1.003, 1.7):
            got = signal.stretched(x, factor)
            if abs(factor - 1) < 0.01 or not len(x):
                assert np.array_equal(got, x)
                continue
            n = max(1, round(len(x) * factor))
            want = []
            for k in range(n):
                at = k * (len(x) - 1) / (n - 1) if n > 1 else 0.0
                low = min(int(at), len(x) - 1)
                want.append(x[low] + (at - low) * (x[min(low + 1, len(x) - 1)] - x[low]))
            assert len(got) == n and np.allclose(got, want, atol=1e-5)


def test_spectra_equal_a_loop(waves):
    """A few frames by the definition of the transform and of the triangles."""
    x = waves[1][:3000].astype(float)
    got = signal.log_mel_of(x)
    assert got.shape == (len(x) // 32 + 1, 64)
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** ((mel(200) + k * (mel(4000) - mel(200)) / 65) / 2595) - 1) for k in range(66)]
    at = lambda i: x[-i] if i < 0 else x[2 * (len(x) - 1) - i] if i >= len(x) else x[i]
    for t in (0, 1, 40, len(x) // 32):
        frame = [at(t * 32 - 128 + k) * (0.5 - 0.5 * math.cos(2 * math.pi * k / 256)) for k in range(256)]
        power = [abs(sum(v * cmath.exp(-2j * math.pi * f * k / 256) for k, v in enumerate(frame))) ** 2 for f in range(129)]
        for b in (0, 5, 33, 63):
            low, mid, high = edges[b : b + 3]
            weight = [max(0.0, min((f * 31.25 - low) / (mid - low), (high - f * 31.25) / (high - mid))) for f in range(129)]
            assert math.isclose(got[t, b], math.log1p(sum(p * w for p, w in zip(power, weight))), rel_tol=1e-4, abs_tol=1e-4)


def test_disturbances_are_drawn_by_the_key(spark, waves):
    """The same row gets the same sound on any partitioning, full scale, of its own length; shares of the kinds as stated."""
    rows = [(i, waves[3].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, audio array<float>")
    one, other = ({r["k"]: r["audio"] for r in signal.augment(df.repartition(n), "k", seed=5).collect()} for n in (1, 7))
    assert one == other and all(len(x) == len(waves[3]) and math.isclose(max(map(abs, x)), 1.0, rel_tol=1e-6) for x in one.values())
    assert len({tuple(x[:50]) for x in one.values()}) > 40
    again = {r["k"]: r["audio"] for r in signal.augment(df, "k", seed=6).collect()}
    assert sum(one[k] != again[k] for k in one) > 50
