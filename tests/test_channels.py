"""Rates, derivatives, splices, delays, snippets and groups of channels against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialloom.functions import kernels
from trialloom.operators import binning, resampling, sequential, signals
from trialloom.sources.groups import ChannelGroup


def even(spark, rows):
    return spark.createDataFrame([(k, i, float(v)) for k, vs in enumerate(rows) for i, v in enumerate(vs)], "trial_id int, bin int, v double")


def by_trial(df, value="v"):
    out = {}
    for r in df.collect():
        out.setdefault(r.trial_id, {})[r.bin] = r[value]
    return out


@pytest.mark.parametrize(("up", "down"), [(3, 2), (2, 5), (1, 4), (7, 3), (1, 1), (4, 2)])
def test_rational_rates(spark, up, down):
    """Constants stay, slow waves come out as they are, and what the slower rate cannot hold goes."""
    n = 240
    t = np.arange(n)
    slow = np.sin(2 * math.pi * 0.02 * t)
    fast = np.sin(2 * math.pi * 0.45 * t)
    got = by_trial(resampling.resample_rational(even(spark, [np.full(n, 3.5), slow, fast]), up, down))
    g = math.gcd(up, down)
    u, d = up // g, down // g
    bins = list(range(0, (n - 1) * u // d + 1))
    assert sorted(got[0]) == bins and all(v == pytest.approx(3.5) for v in got[0].values())
    inner = [b for b in bins if 30 < b * d / u < n - 30]
    assert max(abs(got[1][b] - math.sin(2 * math.pi * 0.02 * b * d / u)) for b in inner) < 0.01
    if d >= 2 * u:
        assert max(abs(got[2][b]) for b in inner) < 0.02


def test_rational_rate_is_a_convolution(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=40)
    taps = dict(kernels.lowpass(3, 4, half=2))
    got = by_trial(resampling.resample_rational(even(spark, [x]), 3, 4, list(taps.items())))[0]
    for m in range(0, 39 * 3 // 4 + 1):
        top = bottom = 0.0
        for k, w in taps.items():
            n, left = divmod(m * 4 - k, 3)
            if left == 0:
                top += w * x[min(39, max(0, n))]
                bottom += w
        assert got[m] == pytest.approx(top / bottom, abs=1e-12)


def test_interpolation_beyond_the_ends(spark):
    s = spark.createDataFrame([(0, 1.0, 10.0), (0, 3.0, 30.0), (0, 4.0, 20.0), (1, 2.0, 5.0)], "trial_id int, t double, v double")
    got = by_trial(binning.resample_interpolated(s, 1.0, beyond=2.0))
    assert got == {0: {-1: -10.0, 0: 0.0, 1: 10.0, 2: 20.0, 3: 30.0, 4: 20.0, 5: 10.0, 6: 0.0}, 1: {2: 5.0}}
    assert by_trial(binning.resample_interpolated(s, 1.0)) == {0: {1: 10.0, 2: 20.0, 3: 30.0, 4: 20.0}, 1: {2: 5.0}}


@pytest.mark.parametrize(("frame", "degree", "order"), [(5, 2, 1), (7, 3, 2), (5, 4, 0), (3, 1, 1)])
def test_derivatives_to_the_ends(spark, frame, degree, order):
    rng = np.random.default_rng(1)
    rows = [rng.normal(size=20), rng.normal(size=frame), rng.normal(size=frame - 1)]
    got = by_trial(resampling.differentiate(even(spark, rows), frame, degree, order, width=0.5))
    assert 2 not in got
    for k in (0, 1):
        x = rows[k]
        for i in range(len(x)):
            begin = max(0, min(i - frame // 2, len(x) - frame))
            fit = np.polynomial.Polynomial.fit(np.arange(frame) * 0.5, x[begin : begin + frame], degree).deriv(order) if order else np.polynomial.Polynomial.fit(np.arange(frame) * 0.5, x[begin : begin + frame], degree)
            assert got[k][i] == pytest.approx(fit((i - begin) * 0.5), abs=1e-8)


def test_splice_at_the_nearest_pair(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(3, 30, 2)), rng.normal(size=(3, 25, 2))
    frame = lambda x: spark.createDataFrame([(k, i, float(p), float(q)) for k in range(3) for i, (p, q) in enumerate(x[k])], "trial_id int, i int, p double, q double")
    got = signals.splice_nearest(frame(a), frame(b), ["trial_id"], ["p", "q"], (10, 25), (3, 15)).orderBy("trial_id", "i").collect()
    for k in range(3):
        best = min(((round(float(np.linalg.norm(a[k, i] - b[k, j])), 9), i, j) for i in range(10, 26) for j in range(3, 16)))
        _, i, j = best
        want = [*a[k, : i + 1].tolist(), *b[k, j + 1 :].tolist()]
        mine = [r for r in got if r.trial_id == k]
        assert [r.i for r in mine] == list(range(len(want))) and [[r.p, r.q] for r in mine] == want and {r.seam for r in mine} == {i}


def test_smooth_seam(spark):
    step = [0.0] * 20 + [10.0] * 20
    rows = [(0, i, v, 19) for i, v in enumerate(step)] + [(1, i, v, 3) for i, v in enumerate(step)]
    df = spark.createDataFrame(rows, "trial_id int, i int, v double, seam int")
    got = {(r.trial_id, r.i): r.v for r in signals.smooth_seam(df, ["trial_id"], ["v"], 6, 50.0).collect()}
    assert [got[1, i] for i in range(40)] == step  # too near to an end
    assert all(got[0, i] == pytest.approx(step[i], abs=1e-6) for i in range(40) if not 14 <= i <= 25)
    bridge = [got[0, i] for i in range(12, 28)]
    assert bridge == sorted(bridge) and max(np.abs(np.diff(bridge, 2))) < 0.3 * max(np.abs(np.diff(step, 2)))
    n, k = 16, 50.0
    own = np.ones(n)
    own[:2] = own[-2:] = 1e9 * (1 + k)
    bend = np.diff(np.eye(n), 2, axis=0)
    assert np.allclose(np.linalg.solve(np.diag(own) + k * bend.T @ bend, own * np.array(step[12:28])), bridge)


def test_delays_of_many_series(spark):
    rng = np.random.default_rng(3)
    base = np.convolve(rng.normal(size=140), np.hanning(9), "same")
    lags = rng.integers(-4, 5, size=12)
    rows = [(k, t, float(base[20 + t - lags[k]] + 0.05 * rng.normal())) for k in range(12) for t in range(80)] + [(99, t, 1.0) for t in range(80)]
    df = spark.createDataFrame(rows, "trial_id int, bin int, v double")
    got = {r.trial_id: r for r in signals.joint_delays(df, 10).collect()}
    offset = got[0].lag - lags[0]
    assert all(got[k].lag - lags[k] == offset and got[k].r > 0.95 for k in range(12))
    assert got[99].lag == 0 and got[99].r is None  # a constant has no delay
    together = by_trial(signals.undelayed(df, signals.joint_delays(df, 10)))
    assert all(abs(together[0][t] - together[5][t]) < 0.4 for t in range(10, 60))


def greedy(v, threshold, before, after, refractory):
    beyond = [x <= threshold if threshold < 0 else x >= threshold for x in v]
    peaks, i = [], 0
    while i < len(v):
        if beyond[i]:
            j = i
            while j < len(v) and beyond[j]:
                j += 1
            best = max(range(i, j), key=lambda p: (abs(v[p]), -p))
            peaks.append(best)
            i = j
        else:
            i += 1
    kept = []
    for p in sorted((p for p in peaks if p >= before and p + after <= len(v)), key=lambda p: (-abs(v[p]), p)):
        if all(abs(p - q) >= refractory for q in kept):
            kept.append(p)
    return sorted((p, v[p], v[p - before : p + after]) for p in kept)


@pytest.mark.parametrize("threshold", [1.0, -1.0])
def test_largest_snippets(spark, threshold):
    rng = random.Random(4)
    rows = [[round(rng.gauss(0, 1.2), 1) for _ in range(150)] for _ in range(6)]
    df = even(spark, rows).select("trial_id", F.col("bin").cast("double").alias("t"), "v")
    got = {}
    for r in sequential.largest_snippets(df, threshold, 2, 3, 7).collect():
        got.setdefault(r.trial_id, []).append((int(r.t), r.height, r.wave))
    for k, v in enumerate(rows):
        assert sorted(got[k]) == greedy(v, threshold, 2, 3, 7)


def test_channel_groups(spark):
    s = spark.createDataFrame([(1, "a", 0.0, 1.0), (1, "b", 0.0, 2.0), (1, "a", 10.0, 3.0), (1, "c", 10.0, 9.0), (1, "a", 20.0, 5.0), (1, "b", 20.0, 8.0)], "trial_id int, channel string, t double, v double")
    g = ChannelGroup.of(s, ["a", "b"])
    rows = lambda group: sorted((r.t, r["values"]) for r in group.frame.collect())
    assert rows(g) == [(0.0, [1.0, 2.0]), (10.0, [3.0, None]), (20.0, [5.0, 8.0])]
    assert rows(g.resampled(5.0)) == [(0.0, [1.0, 2.0]), (5.0, [2.0, None]), (10.0, [3.0, None]), (15.0, [4.0, None]), (20.0, [5.0, 8.0])]
    assert rows(g.take(["b"])) == [(0.0, [2.0]), (10.0, [None]), (20.0, [8.0])]
    assert g.without(["a"]).names == ("b",) and g.renamed({"a": "z"}).names == ("z", "b")
    assert rows(g.combined({"x": {"a": 2.0}, "y": {"a": 1.0, "b": -1.0}})) == [(0.0, [2.0, -1.0]), (10.0, [6.0, None]), (20.0, [10.0, -3.0])]
    assert rows(g.joined(ChannelGroup.of(s, ["c"]))) == [(0.0, [1.0, 2.0, None]), (10.0, [3.0, None, 9.0]), (20.0, [5.0, 8.0, None])]
    assert sorted(map(tuple, g.unpacked().collect())) == [(1, "a", 0.0, 1.0), (1, "a", 10.0, 3.0), (1, "a", 20.0, 5.0), (1, "b", 0.0, 2.0), (1, "b", 20.0, 8.0)]
    assert rows(g.filtered([0.5], [1.0, -0.5])) == [(0.0, [1.0, 2.0]), (10.0, [2.0, None]), (20.0, [3.5, 5.0])]
    back = ChannelGroup.of_tensor(g.tensor(), "trial_id", "tensor", ["a", "b"], 10.0)
    assert rows(back) == rows(g)


@pytest.mark.parametrize(("b", "a"), [([0.2, 0.1], [1.0, -0.9, 0.2]), ([0.5, 0.25, 0.25], [1.0]), ([1.0], [2.0, -1.0]), ([0.1, 0.0, 0.3], [1.0, -0.5, 0.3, -0.1])])
def test_blocks_filter_like_whole_trials(spark, b, a):
    rng = np.random.default_rng(5)
    rows = [(k, float(t), None if rng.random() < 0.05 else float(rng.normal())) for k, n in enumerate((100, 16, 3, 1, 33)) for t in range(n)]
    df = spark.createDataFrame(rows, "trial_id int, t double, v double").repartition(4)
    for settled in (True, False):
        for both in (True, False):
            want = {(r.trial_id, r.t): r.y for r in sequential.filter_series(df, b, a, settled, both).collect() if r.y is not None}
            got = {(r.trial_id, r.t): r.y for r in sequential.filter_long_series(df, b, a, settled, both, block=16).collect()}
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
