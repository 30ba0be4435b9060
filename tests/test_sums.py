"""Means over trials from sums of points and grids, against the rows of every trial and bin."""

import random

import pytest
from pyspark.sql import functions as F

from trialloom.functions import kernels
from trialloom.functions.stats import mean_sem
from trialloom.operators import binning, windows

AROUND = ["go-20:go+20 @ go", "stop-5:stop+30 @ stop"]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(12)
    tr = spark.createDataFrame([(k, 0.0, 100.0) for k in range(24)], "trial_id int, t_start double, t_end double")
    ev = spark.createDataFrame([(k, e, 1, float(rng.randint(1, 99))) for k in range(24) for e in ("go", "stop") if rng.random() < 0.9], "trial_id int, event string, occ int, t double")
    pts = [(rng.choice("abc"), rng.randrange(25), float(rng.randrange(101))) for _ in range(900)] + [("a", 3, None), ("b", None, 5.0)]
    # some trials are in two conditions, one twice in the same, one in none, some in one that is missing
    groups = [(k, k % 3) for k in range(22)] + [(k, 1) for k in range(0, 22, 6)] + [(4, 1), (7, None), (8, None)]
    return tr, ev, spark.createDataFrame(pts, "basis string, trial_id int, t double"), spark.createDataFrame(groups, "trial_id int, cond int")


def rows(df, *keys):
    return {tuple(r[k] for k in keys): tuple(pytest.approx(r[c], abs=1e-7) for c in df.columns if c not in keys) for r in df.collect()}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_kernels_see_sums_by_condition(data):
    tr, ev, pts, groups = data
    al = windows.align(tr, ev, AROUND[0])
    taps = {"bell": kernels.gaussian(1.0, 1.0, reach=2.0), "late": kernels.growth_decay(1.0, 1.0, 1.0), "self": kernels.identity(), "ahead": [(-2, 0.5), (-1, 0.5)]}
    got = binning.kernel_means(pts, al, groups, 5.0, taps, "acausal")
    for name, t in taps.items():
        want = binning.smooth(binning.binned_counts(pts, al, 5.0, "acausal"), t, 5.0).join(groups, "trial_id").groupBy("cond", "bin").agg(F.avg("rate").alias("mean"), F.count("rate").alias("n"))
        one = rows(got.where(F.col("kernel") == name).drop("kernel"), "cond", "bin")
        assert one == rows(want, "cond", "bin") and one
    assert exchanges(got) == exchanges(binning.kernel_means(pts, al, groups, 5.0, {"self": taps["self"]}, "acausal"))


def test_smoothed_means_count_zeros(data):
    tr, ev, pts, groups = data
    for mode, window in (("causal", "go-20:go+20 @ go, pad 5:5"), ("acausal", AROUND[1]), ("centered", AROUND[0])):
        al = windows.align(tr, ev, window)
        rates = binning.smooth(binning.binned_counts(pts, al, 5.0, mode), [(-1, 0.25), (0, 0.5), (1, 0.25)], 5.0)
        want = rates.join(groups, "trial_id").groupBy("cond", "bin").agg(*mean_sem("rate", 3))
        got = binning.psth(pts, al, groups, 5.0, [(-1, 0.25), (0, 0.5), (1, 0.25)], min_count=3, mode=mode)
        assert got.columns == want.columns and rows(got, "cond", "bin") == rows(want, "cond", "bin")


@pytest.fixture(scope="module")
def dense(data):
    """The aligned windows, and by alignment, basis, trial and bin the counts of all bins."""
    tr, ev, pts, groups = data
    al = windows.align_all(tr, ev, AROUND)
    counts = {(r.align_id, r.basis, r.trial_id, r.bin): r.n for r in binning.counts_by_basis(pts, al, ["a", "b", "d"], 5.0, "acausal").collect()}
    return al, counts, [(r.trial_id, r.cond) for r in groups.collect()]


def test_population_from_sums(data, dense):
    _, _, pts, groups = data
    al, counts, members = dense
    cells, ends = {}, {}
    for (a, b, k, x), n in counts.items():
        for _, c in (m for m in members if m[0] == k):
            cells.setdefault((a, b, c, x), []).append(n)
    for a, k in {(a, k) for a, _, k, _ in counts}:
        bins = [x for i, _, j, x in counts if (i, j) == (a, k)]
        for _, c in (m for m in members if m[0] == k):
            ends.setdefault((a, c), []).append((min(bins), max(bins)))
    inside = lambda a, c, x: sorted(e[0] for e in ends[a, c])[:4][-1] <= x <= sorted((e[1] for e in ends[a, c]), reverse=True)[:4][-1]
    want = {k: (sum(v) / len(v), len(v)) for k, v in cells.items() if inside(k[0], k[2], k[3])}
    got = binning.rate_means(pts, al, groups, 5.0, bases=["a", "b", "d"], mode="acausal", least=4)
    assert {(r.align_id, r.basis, r.cond, r.bin): (pytest.approx(r["mean"]), r.n) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(concat" not in plan and "collect_list" not in plan  # no trial is made into rows of all its bins


def test_changes_from_baseline_from_sums(data, dense):
    _, _, pts, groups = data
    al, counts, members = dense
    taps = [(-1, 0.25), (0, 0.5), (1, 0.25)]
    rate = {(a, b, k, x): sum(w * counts[a, b, k, x - d] for d, w in taps) * 2.0 for a, b, k, x in counts if all((a, b, k, x - d) in counts for d, _ in taps)}
    before = {}
    for (a, b, k, x), r in rate.items():
        if a == 0 and -3 <= x <= -1:
            before.setdefault((b, k), []).append(r)
    want = {}
    for (a, b, k, x), r in rate.items():
        for _, c in (m for m in members if m[0] == k):
            cell = want.setdefault((a, b, c, x), [])
            if (b, k) in before:
                cell.append(r - sum(before[b, k]) / len(before[b, k]))
    got = binning.rate_changes(pts, al, groups, 5.0, taps, 2.0, ["a", "b", "d"], (0, -3, -1), "acausal").collect()
    assert {(r.align_id, r.basis, r.cond, r.bin): (r.change if r.change is None else pytest.approx(r.change), r.n) for r in got} == {k: (sum(v) / len(v) if v else None, len(v)) for k, v in want.items()}


def test_functions_of_arrays(spark):
    import numpy as np

    from trialloom.operators import conditions

    df = spark.createDataFrame([(1, "a", 1.0, 2), (1, "a", None, 3), (2, "a", 5.0, None), (3, None, None, 1), (1, "b", 4.0, 1)], "k int, s string, v double, w int")

    def fn(v, w):
        assert isinstance(v, np.ndarray) and v.dtype == float and len(v) == len(w)
        return float(np.nansum(v * w)) if (~np.isnan(v)).any() else None

    got = conditions.map_arrays(df, ["k", "s"], ["v", "w"], fn, "x")
    assert {(r.k, r.s): r.x for r in got.collect()} == {(1, "a"): 2.0, (2, "a"): 0.0, (3, None): None, (1, "b"): 4.0}
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()  # no call of Python for each group


def test_distributions_meet_conditions_before_the_union(data):
    tr, ev, pts, groups = data
    al = windows.align(tr, ev, AROUND[0])
    found = windows.marks(tr, ev, al, "stop")
    spans = windows.mark_intervals(pts.where("basis = 'a'").groupBy("trial_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1")), al)
    got = windows.distributions(al, groups, found, spans)
    rows_ = {(r.kind, r.cond): (r.n, r.low, r.high) for r in got.where("cond is not null").collect()}
    of = {c: {r.trial_id for r in groups.where(F.col("cond") == c).collect()} for c in (0, 2)}
    for c, trials in of.items():
        marks = [r.t for r in found.collect() if r.trial_id in trials]
        lengths = [r.t1 - r.t0 for r in spans.collect() if r.trial_id in trials]
        assert rows_.get(("mark", c), (0, None, None))[0] == len(marks)
        assert rows_["interval length", c] == (len(lengths), min(lengths), max(lengths))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Join")  # the union's rows are added up as they come, not sorted by trial


@pytest.mark.parametrize("name", ["rotational_components", "components_over_time"])
def test_components_read_the_events_once(spark, name):
    from trialloom.plans import registry

    got = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert not [f for f in got.inputFiles() if "events" in f]  # only the cube, which is a few rows
