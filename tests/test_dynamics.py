"""Rotations, state decoders and demixed components, planted and against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialloom.operators import demixing, dynamics, randomise


def cube_of(spark, x):
    """x[cond, bin, basis] as a cube."""
    return spark.createDataFrame([(f"b{j}", c, t, float(x[c, t, j])) for c, t, j in np.ndindex(x.shape)], "basis string, cond int, bin int, mean double")


def test_planted_rotations_are_found(spark):
    rng = np.random.default_rng(0)
    turn = np.zeros((6, 6))
    for at, speed in ((0, 0.3), (2, 0.1)):
        turn[at, at + 1], turn[at + 1, at] = speed, -speed
    u = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    m = u @ turn @ u.T
    value, vector = np.linalg.eig(m)
    step = (vector @ np.diag(np.exp(value)) @ np.linalg.inv(vector)).real
    x = np.zeros((12, 40, 6))
    x[:, 0] = rng.normal(size=(12, 6)) @ u @ np.diag([3, 3, 2, 2, 0.01, 0.01]) @ u.T
    for t in range(1, 40):
        x[:, t] = x[:, t - 1] @ step
    bases = [f"b{j}" for j in range(6)]
    states = dynamics.states_in_time(cube_of(spark, x), bases, centre=False)
    weights, turns = dynamics.rotational_weights(states, bases, 4)
    speed = {r.dimension: r.frequency for r in weights.collect()}
    assert [round(speed[d], 1) for d in range(4)] == [0.3, 0.3, 0.1, 0.1]
    w = np.zeros((6, 4))
    for r in weights.collect():
        w[int(r.basis[1]), r.dimension] = r.w
    assert np.allclose(w.T @ w, np.eye(4), atol=1e-8)
    assert np.linalg.norm(w[:, :2].T @ u[:, :2], "nuc") > 1.99  # the fast plane
    got = np.zeros((6, 6))
    for r in turns.collect():
        got[int(r.i[1]), int(r.j[1])] = r.m
    assert np.allclose(got, -got.T, atol=1e-10)
    score = {(r.cond, r.bin, r.dimension): r.score for r in dynamics.along(states, weights, bases).collect()}
    for c in (0, 5):  # from the first axis towards the second
        angle = np.unwrap([np.arctan2(score[c, t, 1], score[c, t, 0]) for t in range(40)])
        assert np.allclose(np.diff(angle), 0.3, atol=0.02)


def test_skew_fit_is_the_best(spark):
    rng = np.random.default_rng(1)
    x, dx = rng.normal(size=(80, 4)), rng.normal(size=(80, 4))
    m = dynamics.skew_fit(x.T @ x, x.T @ dx)
    best = np.sum((dx - x @ m) ** 2)
    assert np.allclose(m, -m.T)
    for _ in range(50):
        e = rng.normal(size=(4, 4)) * 0.01
        assert np.sum((dx - x @ (m + e - e.T)) ** 2) > best


def test_missing_bases_and_gaps(spark):
    rows = [("a", 0, 0, 1.0), ("b", 0, 0, 2.0), ("a", 0, 1, 3.0), ("b", 0, 1, None), ("a", 0, 3, 5.0), ("b", 0, 3, 6.0), ("a", 0, 4, 7.0), ("b", 0, 4, 9.0)]
    states = dynamics.states_in_time(spark.createDataFrame(rows, "basis string, cond int, bin int, mean double"), ["a", "b"], centre=False)
    assert sorted((r.bin, r.x, r.dx) for r in states.collect()) == [(0, [1.0, 2.0], None), (3, [5.0, 6.0], [2.0, 3.0]), (4, [7.0, 9.0], None)]
    with pytest.raises(ValueError):
        dynamics.rotational_weights(states.where("bin = 0"), ["a", "b"])


def walk(rng, n, steps):
    a, h = np.array([[0.95, 0.2], [-0.1, 0.9]]), rng.normal(size=(3, 2))
    x = np.zeros((n, steps, 2))
    x[:, 0] = rng.normal(size=(n, 2))
    for t in range(1, steps):
        x[:, t] = x[:, t - 1] @ a.T + 0.1 * rng.normal(size=(n, 2))
    return a, h, x, x @ h.T + 0.5 * rng.normal(size=(n, steps, 3))


def test_states_are_decoded(spark):
    rng = np.random.default_rng(2)
    a, h, x, z = walk(rng, 60, 50)
    lengths = rng.integers(1, 51, size=60)
    rows = [(k, t, x[k, t].tolist(), z[k, t].tolist()) for k in range(60) for t in range(lengths[k])]
    df = spark.createDataFrame(rows, "trial_id int, bin int, x array<double>, z array<double>").repartition(5)
    decoder = dynamics.fit_decoder(df.where("trial_id < 40"))
    assert np.abs(decoder.a - a).max() < 0.06 and np.abs(decoder.h - h).max() < 0.15
    assert np.allclose(decoder.w, 0.01 * np.eye(2), atol=0.003) and np.allclose(decoder.q, 0.25 * np.eye(3), atol=0.05)
    got = {(r.trial_id, r.bin): r.estimate for r in dynamics.decode(df.where("trial_id >= 40"), decoder).collect()}
    assert len(got) == lengths[40:].sum()
    miss = raw = 0.0
    for k in range(40, 60):  # each trial by itself, step by step
        state, p = x[k, 0], np.zeros((2, 2))
        for t in range(lengths[k]):
            if t:
                ahead, pm = decoder.a @ state, decoder.a @ p @ decoder.a.T + decoder.w
                gain = pm @ decoder.h.T @ np.linalg.inv(decoder.h @ pm @ decoder.h.T + decoder.q)
                state, p = ahead + gain @ (z[k, t] - decoder.h @ ahead), pm - gain @ decoder.h @ pm
            assert np.allclose(got[k, t], state, atol=1e-9)
            miss += np.sum((state - x[k, t]) ** 2)
            raw += np.sum((np.linalg.pinv(h) @ z[k, t] - x[k, t]) ** 2)
    assert miss < 0.5 * raw  # better than what each observation says by itself


def mixed(spark, noise, folds=5, n=40, seed=3):
    """Trials of 8 bases whose first two directions carry two axes."""
    rng = np.random.default_rng(seed)
    u = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    rows = []
    for i in range(n):
        for a in range(3):
            for b in range(2):
                v = 3.0 * (a - 1) * u[0] + 2.0 * (2 * b - 1) * u[1] + noise * rng.normal(size=8)
                rows += [(i * 6 + a * 2 + b, i % folds, a, b, j, float(v[j])) for j in range(8)]
    return u, spark.createDataFrame(rows, "trial_id int, fold int, a int, b int, basis int, v double")


def test_demixed_components_read_their_axis(spark):
    u, trials = mixed(spark, 0.3)
    cube = trials.groupBy("a", "b", "basis").agg(F.avg("v").alias("mean"))
    decoder, encoder, shares = demixing.demixed_components(cube, ["a", "b"], list(range(8)), 1, 0.01)
    d = np.zeros((3, 8))
    terms = {}
    for r in decoder.collect():
        d[r.dimension, r.basis] = r.w
        terms[r.dimension] = r.term
    assert terms == {0: "a", 1: "b", 2: "a:b"}
    assert abs(d[0] @ u[0]) / np.linalg.norm(d[0]) > 0.9 and abs(d[1] @ u[1]) / np.linalg.norm(d[1]) > 0.9
    share = {(r.term, r.of_term): r.share for r in shares.collect()}
    assert share["a", "a"] > 0.98 and share["b", "b"] > 0.98
    explained = {r.term: r.explained for r in shares.collect()}
    assert 0.55 < explained["a"] < 0.65 and 0.35 < explained["b"] < 0.45  # variances 6 and 4
    assert encoder.count() == 24


def test_ridge_by_unseen_trials(spark):
    """With few noisy trials a ridge beats an enormous one; errors equal those of a plain version."""
    _, trials = mixed(spark, 2.0, folds=4, n=8)
    ridges = [0.0, 30.0, 1e6]
    got = {r.ridge: r.error for r in demixing.cross_validated_demixing(trials, ["a", "b"], list(range(8)), ridges, 1).collect()}
    v = np.zeros((4, 2, 3, 2, 8))
    seen = np.zeros((4, 3, 2), dtype=int)
    for r in trials.orderBy("trial_id", "basis").collect():
        v[r.fold, seen[r.fold, r.a, r.b], r.a, r.b, r.basis] = r.v
        if r.basis == 7:
            seen[r.fold, r.a, r.b] += 1
    for ridge in ridges:
        miss = size = 0.0
        for f in range(4):
            x = np.concatenate([v[o] for o in range(4) if o != f]).mean(axis=0).reshape(6, 8)
            y = v[f].mean(axis=0).reshape(6, 8)
            x, y = x - x.mean(axis=0), y - y.mean(axis=0)
            cells = x.reshape(3, 2, 8)
            ta, tb = np.repeat(cells.mean(axis=1, keepdims=True), 2, axis=1), np.repeat(cells.mean(axis=0, keepdims=True), 3, axis=0)
            for t in (ta, tb, cells - ta - tb):
                t = t.reshape(6, 8)
                b = t.T @ x @ np.linalg.pinv(x.T @ x + ridge * np.eye(8), rcond=1e-10)
                p, _, _ = np.linalg.svd(b @ x.T, full_matrices=False)
                b = p[:, :1] @ p[:, :1].T @ b
                miss += np.sum((t.T - b @ y.T) ** 2)
                size += np.sum(t**2)
        assert got[ridge] == pytest.approx(miss / size, rel=1e-6)
    assert got[30.0] < got[1e6]
    errors = spark.createDataFrame(list(got.items()), "ridge double, error double")
    assert demixing.best_ridge(errors) == min(got, key=got.get)


def test_regression_between_populations(spark):
    rng = np.random.default_rng(6)
    x, w = rng.normal(size=(30, 4)), rng.normal(size=(4, 3))
    y = x @ w + 7.0
    frame = lambda m: spark.createDataFrame([(c, j, float(v)) for (c, j), v in np.ndenumerate(m)] + [(99, 0, 1.0)], "cond int, basis int, mean double")
    got = np.zeros((4, 3))
    for r in demixing.regression_weights(frame(x), [0, 1, 2, 3], frame(y), [0, 1, 2], ["cond"]).collect():
        got[r.basis, r.dimension] = r.w
    assert np.allclose(got, w, atol=1e-9)  # the condition that lacks bases does not count


def test_signal_is_what_noise_leaves(spark):
    _, trials = mixed(spark, 1.0, n=60)
    rows = trials.withColumn("cond", F.col("a") * 2 + F.col("b"))
    cube = rows.groupBy("basis", "cond").agg(F.avg("v").alias("mean"))
    noise = randomise.pair_differences(rows, ["cond", "basis"], "v", 5)
    weights = spark.createDataFrame([(j, j, 1.0) for j in range(8)], "basis int, dimension int, w double")
    got = demixing.signal_variance(cube, noise, weights).orderBy("dimension").collect()
    total = sum(r.total for r in got)
    assert all(r.signal == pytest.approx(max(0.0, r.total - r.noise)) for r in got)
    shares = [r.share for r in got]
    assert shares == sorted(shares) and shares[-1] == pytest.approx(sum(r.signal for r in got) / total)
    # six conditions of 60 trials at deviation 1: noise of 6 / 60 in each basis
    assert 0.3 < sum(r.noise for r in got) / (8 * 6 / 60) < 3
    less = demixing.signal_variance(cube, noise.where("cond <> 3"), weights).collect()
    assert all(r.noise is not None for r in less)
