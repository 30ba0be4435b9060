"""Points against ranges inside a trial, and many sources under many alignments."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialloom.operators import binning, series, timecourse, windows
from trialloom.operators.joins import band_join


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def random_points(spark):
    rng = random.Random(4)
    pts = [(rng.randrange(3), round(rng.uniform(-20, 20), 1)) for _ in range(300)] + [(0, None), (None, 1.0)]
    marks = [(rng.randrange(4), i, round(rng.uniform(-20, 20), 1)) for i in range(60)] + [(1, 90, None), (None, 91, 1.0)]
    return pts, marks, frame(spark, pts, "trial_id int, t double"), frame(spark, marks, "trial_id int, occ int, t double")


@pytest.mark.parametrize(("before", "after"), [(-2.0, 3.0), (0.0, 0.0), (1.0, 4.0), (3.0, 1.0), (-30.0, 60.0)])
def test_triggered_counts(random_points, before, after):
    pts, marks, p, m = random_points
    want = {(k, o): sum(1 for j, x in pts if k is not None and j == k and x is not None and t is not None and t + before <= x <= t + after) for k, o, t in marks}
    got = {(r.trial_id, r.occ): r.n for r in series.triggered_counts(p, m, before, after).collect()}
    assert got == want


def test_band_join(random_points, spark):
    pts, marks, p, m = random_points
    spans = m.select("trial_id", "occ", (F.col("t") - 1).alias("lo"), (F.col("t") + F.col("occ") % 7).alias("hi"))
    want = sorted((j, o, x) for k, o, t in marks for j, x in pts if k is not None and j == k and x is not None and t is not None and t - 1 <= x <= t + o % 7)
    for width in (0.5, 3.0, 100.0):
        assert sorted((r.trial_id, r.occ, r.t) for r in band_join(p, spans, width).collect()) == want


def test_correlogram_and_blanks(random_points, spark):
    pts, marks, p, m = random_points
    want = {}
    for k, _, t in marks:
        for j, x in pts:
            if k is not None and j == k and x is not None and t is not None and abs(x - t) <= 5.0:
                want[int((x - t) // 0.5)] = want.get(int((x - t) // 0.5), 0) + 1
    assert {r.bin: r.n for r in series.cross_correlogram(m, p, 0.5, 5.0).collect()} == want
    blanks = m.where("occ < 9").select("trial_id", F.col("t").alias("t0"), (F.col("t") + F.col("occ") - 2).alias("t1"))
    spans = [(r.trial_id, r.t0, r.t1) for r in blanks.collect()]
    hit = lambda j, x: any(j is not None and j == k and x is not None and a is not None and a <= x <= z for k, a, z in spans)
    left = sorted(((j, x) for j, x in pts if not hit(j, x)), key=repr)
    assert sorted(((r.trial_id, r.t) for r in series.outside_intervals(p, blanks).collect()), key=repr) == left
    s = p.withColumn("v", F.lit(1.0))
    assert sorted(((r.trial_id, r.t) for r in series.blank_samples(s, blanks).where("v is not null").collect()), key=repr) == left


def test_a_trial_with_a_million_points(spark):
    p = spark.range(1_000_000).select(F.lit(1).alias("trial_id"), (F.col("id") * 0.5).alias("t"))
    m = spark.range(100_000).select(F.lit(1).alias("trial_id"), F.col("id").alias("occ"), (F.col("id") * 5.0 + 0.25).alias("t"))
    start = time.monotonic()
    assert series.triggered_counts(p, m, -10.0, 10.0).agg(F.sum("n")).first()[0] == 100_000 * 40 - (19 + 9) - (11 + 1)  # two windows at each end are cut
    assert series.cross_correlogram(m.limit(20_000), p, 1.0, 5.0).agg(F.sum("n")).first()[0] > 300_000
    blanks = m.select("trial_id", F.col("t").alias("t0"), (F.col("t") + 1).alias("t1"))
    assert series.outside_intervals(p, blanks).count() == 800_000
    assert time.monotonic() - start < 60
    plan = series.triggered_counts(p, m, -10.0, 10.0)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_lock_out_equals_a_loop(spark):
    rng = np.random.default_rng(3)
    times = {k: np.sort(rng.uniform(0, 2000 / (k + 1), 700)).round(2) for k in range(4)}
    df = frame(spark, [(k, float(t)) for k, ts in times.items() for t in ts] + [(0, None)], "trial_id int, t double")
    want = []
    for k, ts in times.items():
        last = -np.inf
        for t in ts:
            if t - last >= 3.0:
                want.append((k, float(t)))
                last = t
    assert sorted((r.trial_id, r.t) for r in series.lock_out(df, 3.0).collect()) == want


def test_nearest_sample_of_a_point_window(spark):
    s = frame(spark, [(1, 1.0), (1, 4.0), (1, 6.0), (2, 9.0), (3, 1.0), (3, 2.0)], "trial_id int, t double")
    al = frame(spark, [(1, 0.0, 5.0, 5.0, True), (2, 0.0, 5.0, 5.0, True), (3, 0.0, 1.0, 2.0, True)], "trial_id int, zero double, start double, stop double, valid boolean")
    got = sorted((r.trial_id, r.t) for r in windows.in_window(s, al, delta=1.0).collect())
    assert got == [(1, 4.0), (3, 1.0), (3, 2.0)]  # of two as near the earlier one; nothing within two deltas in trial 2
    assert sorted((r.trial_id, r.t) for r in windows.in_window(s, al).collect()) == [(3, 1.0), (3, 2.0)]


def test_counts_by_basis_equal_single_counts(spark):
    rng = random.Random(8)
    tr = frame(spark, [(k, 0.0, 100.0) for k in range(6)], "trial_id int, t_start double, t_end double")
    ev = frame(spark, [(k, e, 1, float(rng.randint(10, 60))) for k in range(6) for e in ("go", "stop") if rng.random() < 0.9], "trial_id int, event string, occ int, t double")
    pts = frame(spark, [(rng.choice("abc"), rng.randrange(6), rng.uniform(0, 100)) for _ in range(400)], "basis string, trial_id int, t double")
    al = windows.align_all(tr, ev, ["go-20:go+20 @ go", "stop-5:stop+30 @ stop"])
    bases = ["a", "b", "d"]  # d has no point, c is not asked for
    got = sorted((r.align_id, r.basis, r.trial_id, r.bin, r.n) for r in binning.counts_by_basis(pts, al, bases, 5.0).collect())
    want = []
    for i, w in enumerate(["go-20:go+20 @ go", "stop-5:stop+30 @ stop"]):
        one = windows.align(tr, ev, w)
        assert sorted(map(str, one.collect())) == sorted(map(str, al.where(F.col("align_id") == i).drop("align_id").collect()))
        for b in bases:
            want += [(i, b, r.trial_id, r.bin, r.n) for r in binning.binned_counts(pts.where(F.col("basis") == b).drop("basis"), one, 5.0).collect()]
    assert got == sorted(want)

    def exchanges(names):
        plan = binning.counts_by_basis(pts, al, names, 5.0)._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning"), plan.count("Join")

    assert exchanges(["a"]) == exchanges([f"b{i}" for i in range(50)])


def test_end_to_end(spark):
    cube = frame(spark, [(0, -2), (0, 3), (1, 5), (1, 6), (2, -1)], "align_id int, bin int")
    got = sorted((r.align_id, r.bin, r.place) for r in timecourse.end_to_end(cube, 2).collect())
    assert got == [(0, -2, 0), (0, 3, 5), (1, 5, 8), (1, 6, 9), (2, -1, 12)]
