import math

import pytest
from pyspark.sql import functions as F

from trialloom.functions import kernels, stats
from trialloom.operators import conditions as C
from trialloom.operators import population, randomise, sequential, series
from trialloom.sources import tables


def test_mean_sem_skips_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", None), ("a", 3.0), ("b", 5.0), ("c", None)], "g string, x double")
    got = {r.g: r for r in df.groupBy("g").agg(*stats.mean_sem("x")).collect()}
    assert (got["a"].mean, got["a"].n, got["a"].sem) == (2.0, 2, pytest.approx(1.0))
    assert got["b"].mean == 5 and got["b"].sem is None and got["c"].mean is None and got["c"].n == 0
    strict = {r.g: r for r in df.groupBy("g").agg(*stats.mean_sem("x", 2, 0.6)).collect()}
    assert strict["a"].mean is None and strict["b"].mean is None


def test_hazen(spark):
    df = spark.createDataFrame([(float(i),) for i in (4, 2, 3, 1)], "x double")
    got = df.agg(*[stats.hazen_quantile("x", p).alias(f"q{i}") for i, p in enumerate((0, 0.25, 0.5, 1))]).head()
    assert tuple(got) == (1.0, 1.5, 2.5, 4.0)
    df = df.withColumn("trial_id", F.lit(1))
    assert C.quantile_edges(df, "x", 4) == [1.0, 1.5, 2.5, 3.5, 4.0]
    assert C.quantile_edges(df.where("false"), "x", 4) == []


def test_kernels():
    for taps in (kernels.gaussian(), kernels.half_gaussian(), kernels.exponential(), kernels.growth_decay(), kernels.boxcar(5)):
        assert sum(w for _, w in taps) == pytest.approx(1)
    assert min(k for k, _ in kernels.exponential()) == 0 and min(k for k, _ in kernels.gaussian()) == -60
    taps = kernels.savitzky_golay(5, 2, 1)
    assert sum(w * (10 - k) for k, w in taps) == pytest.approx(1) and sum(w * (10 - k) ** 2 for k, w in taps) == pytest.approx(20)


def test_closed_bins_and_lists(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, None), (5, 2.0000005), (6, 2.000002)], "trial_id long, x double")
    got = sorted((r.trial_id, r.bin) for r in C.bin_membership(df, "x", [1.0, 2.0, 3.0]).collect())
    assert got == [(1, 0), (2, 0), (2, 1), (3, 1), (5, 1), (6, 1)]
    assert [r.b for r in df.orderBy("trial_id").select(C.first_bin("x", [1.0, 2.0, 3.0]).alias("b")).collect()] == [0, 0, 1, None, 1, 1]
    assert [r.trial_id for r in df.where(C.in_list(F.col("x"), [2.0])).orderBy("trial_id").collect()] == [2, 5]
    assert [r.trial_id for r in df.where(C.in_list(F.col("x"), [None])).collect()] == [4]
    assert [r.trial_id for r in df.where(C.outside_range(F.col("x"), 1, 3)).orderBy("trial_id").collect()] == [1, 3]


def test_cube_keeps_empty_cells(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "a", None)], "trial_id long, p string, q int")
    cube = C.cube({"p": t.select("p"), "q": t.select("q")})
    assert {(r.p, r.q): r.cond for r in cube.collect()} == {("a", 1): 0, ("b", 1): 1, ("a", 2): 2, ("b", 2): 3, ("a", None): 4, ("b", None): 5}
    n = C.by_condition(cube, C.members(t, cube, ["p", "q"]).groupBy("cond").agg(F.count("*").alias("n")))
    assert sorted(r.n for r in n.collect()) == [0, 0, 0, 1, 1, 1]


def test_intervals(spark):
    iv = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 3.0), (1, 3.0, 4.0), (1, 10.0, 11.0), (1, 5.0, 9.0), (1, 6.0, 7.0), (2, 0.0, 1.0)], "trial_id long, t0 double, t1 double")
    got = sorted((r.trial_id, r.t0, r.t1) for r in series.merge_intervals(iv).collect())
    assert got == [(1, 0, 4), (1, 5, 9), (1, 10, 11), (2, 0, 1)]
    pts = spark.createDataFrame([(1, 4.0), (1, 4.5), (2, 1.0), (2, 1.1), (3, 0.0)], "trial_id long, t double")
    assert sorted((r.trial_id, r.t) for r in series.outside_intervals(pts, iv).collect()) == [(1, 4.5), (2, 1.1), (3, 0.0)]


def test_crossings_and_lock_out(spark):
    s = spark.createDataFrame([(1, float(t), v) for t, v in enumerate([5.0, 0.0, 6.0, 1.0, 7.0, 8.0, -6.0])], "trial_id long, t double, v double")
    assert [r.t for r in series.crossings(s, 5.0).orderBy("t").collect()] == [1.0, 3.0]
    assert [r.t for r in series.crossings(s, -5.0).collect()] == [5.0]
    assert sorted(r.t for r in series.lock_out(s, 2.5).collect()) == [0.0, 3.0, 6.0]
    snip = sequential.snippets(s, 5.0, 1, 2, 2).collect()
    assert [(r.t, r.wave) for r in snip] == [(1.0, [5.0, 0.0, 6.0]), (3.0, [6.0, 1.0, 7.0])]


def test_filter_has_no_step_at_its_start(spark):
    s = spark.createDataFrame([(1, float(t), 3.0) for t in range(5)] + [(2, 0.0, None)], "trial_id long, t double, v double")
    got = sequential.filter_series(s, [0.2], [1.0, -0.8], both_ways=True).collect()
    assert all(r.y == pytest.approx(3.0) for r in got if r.trial_id == 1) and [r.y for r in got if r.trial_id == 2] == [None]


def test_shuffle_keeps_counts(spark):
    t = spark.createDataFrame([(i, i % 3 if i % 7 else 0) for i in range(200)], "trial_id long, cond int")
    a = {r.trial_id: r.cond for r in randomise.shuffle_labels(t, 1).collect()}
    b = {r.trial_id: r.cond for r in randomise.shuffle_labels(t, 1).collect()}
    old = {r.trial_id: r.cond for r in t.collect()}
    assert a == b and a != old and sorted(a.values()) == sorted(old.values()) and set(a) == set(old)
    boot = randomise.bootstrap(t, 2, 5).groupBy("draw", "cond").count().collect()
    sizes = {r.cond: r["count"] for r in t.groupBy("cond").count().collect()}
    assert all(r["count"] == sizes[r.cond] for r in boot) and len(boot) == 6


def test_components_explain_variance(spark):
    rows = [(c, [math.sin(c + i) + 0.01 * i * c for i in range(6)]) for c in range(5) for _ in range(2)]
    cube = population.population(spark.createDataFrame(rows, "label int, embedding array<double>"), "label", "embedding")
    got = population.principal_components(cube, 3).collect()
    share = sorted({(r.dimension, round(r.explained, 9)) for r in got})
    assert len(share) == 3 and share[0][1] >= share[1][1] >= share[2][1] and 0.99 < sum(x for _, x in share) <= 1.0000001


def test_save_and_load(spark, tmp_path):
    t = spark.createDataFrame([(i, i % 2, float(i)) for i in range(20)], "trial_id long, tag int, x double")
    tables.save({"trials": t, "extra": t.select("trial_id", (F.col("x") * 2).alias("y"))}, str(tmp_path), {"trials": "tag"}, 5)
    got = tables.load(spark, str(tmp_path), ["trials", "extra"], F.col("tag") == 1, 3)
    assert sorted((r.trial_id, r.y) for r in got.collect()) == [(1, 2.0), (3, 6.0), (5, 10.0)]
    assert tables.count(spark, str(tmp_path), "extra") == 20


def test_resample_to_grid(spark):
    from trialloom.operators import binning

    s = spark.createDataFrame([(1, 0.0, 0.0), (1, 2.5, 5.0), (1, 4.0, 2.0), (2, 3.0, 7.0), (3, 3.5, 1.0)], "trial_id long, t double, v double")
    got = sorted((r.trial_id, r.bin, r.v) for r in binning.resample_interpolated(s, 1.0).collect())
    assert got == [(1, 0, 0.0), (1, 1, 2.0), (1, 2, 4.0), (1, 3, 4.0), (1, 4, 2.0), (2, 3, 7.0)]


def test_positions_and_quantiles_are_exact_whatever_the_cuts(spark):
    import random

    from trialloom.operators import ranking

    rng = random.Random(4)
    rows = [(i * 7 % 1009, "abc"[min(2, i % 7)], float(rng.choice([rng.randint(0, 30), rng.random() * 100]))) for i in range(1009)]
    rows += [(2000, "a", None), (2001, "d", 5.0), (2002, "a", float("nan"))]
    df = spark.createDataFrame(rows, "trial_id long, g string, x double")
    for size in (10, 300, 10**6):
        got = {r.trial_id: r.i for r in ranking.numbered(df, ["g"], "trial_id", size).collect()}
        for g in "abcd":
            ids = sorted(r[0] for r in rows if r[1] == g)
            assert [got[i] for i in ids] == list(range(len(ids)))

    def hazen(values, p):
        v, n = sorted(values), len(values)
        r = max(1.0, min(float(n), p * n + 0.5))
        return v[int(r) - 1] + (r - int(r)) * (v[min(n, int(r) + 1) - 1] - v[int(r) - 1])

    ps = [0.0, 0.1, 0.5, 0.77, 1.0]
    for accuracy in (20, 100, 100_000):
        got = {(r.g, r.p): r.x for r in ranking.hazen_quantiles(df, ["g"], "x", ps, accuracy).collect()}
        assert len(got) == 4 * len(ps)
        for (g, p), x in got.items():
            assert x == pytest.approx(hazen([r[2] for r in rows if r[1] == g and r[2] is not None and r[2] == r[2]], p)), (accuracy, g, p)


def test_filter_by_blocks_is_the_recursion(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    for b, a in (([0.2], [1.0, -0.8]), ([0.1, 0.2, 0.1], [2.0, -1.1, 0.5]), ([1.0, 1.0], [1.0]), ([0.5], [1.0, 0.0, 0.3, -0.2])):
        for n in (0, 1, 5, 127, 128, 129, 700):
            x = rng.normal(size=n)
            y = np.zeros(n)
            for i in range(n):
                y[i] = sum(b[k] * x[i - k] for k in range(len(b)) if i >= k) / a[0] - sum(a[k] * y[i - k] for k in range(1, len(a)) if i >= k) / a[0]
            assert np.allclose(sequential.recurse(b, a, x, settled=False), y)
    assert np.allclose(sequential.recurse([0.2], [1.0, -0.8], np.full(300, 3.0), settled=True), 3.0)


def test_as_of_passes_over_missing_values(spark):
    left = spark.createDataFrame([(1, 5.0), (1, 0.5), (2, 1.0)], "trial_id long, t double")
    right = spark.createDataFrame([(1, 1.0, 10.0), (1, 5.0, None), (1, 6.0, 60.0), (2, 1.0, 7.0)], "trial_id long, t double, v double")
    assert sorted((r.trial_id, r.t, r.v) for r in series.as_of(left, right).collect()) == [(1, 0.5, None), (1, 5.0, 10.0), (2, 1.0, 7.0)]


def test_lock_out_of_many_points(spark):
    df = spark.range(200_000).select(F.lit(1).alias("trial_id"), F.col("id").cast("double").alias("t"))
    assert series.lock_out(df, 2.5).count() == 66_667


def test_butterworth_gains():
    import cmath

    from trialloom.functions.filters import butterworth

    for order in (1, 2, 3, 4):
        for kind in ("low", "high"):
            b, a = butterworth(order, 5.0, 50.0, kind)

            def gain(f):
                z = cmath.exp(-2j * math.pi * f / 50)
                return abs(sum(x * z**i for i, x in enumerate(b)) / sum(x * z**i for i, x in enumerate(a)))

            assert gain(5.0) == pytest.approx(math.sqrt(0.5)) and gain(0.0 if kind == "low" else 25.0) == pytest.approx(1)
            assert gain(20.0 if kind == "low" else 1.0) < 0.3


def test_sources_keep_their_contract(spark):
    src = tables.TrialSource("days", {"x": "double", "note": "string"}, notes={"x": {"units": "mV"}})
    df = spark.createDataFrame([(1, 0.0, 5.0, "3")], "trial_id long, t_start double, t_end double, x string")
    got = src.read(df)
    assert got.head().x == 3.0 and got.head().note is None and got.schema["x"].metadata["units"] == "mV"
    with pytest.raises(ValueError, match="end before"):
        src.read(df.withColumn("t_end", F.lit(-1.0)))
    with pytest.raises(ValueError, match="missing"):
        src.read(df.drop("t_end"))
    with pytest.raises(ValueError, match="different types"):
        tables.append_same(df, df.withColumn("x", F.lit(1)))


def test_virtual_channels_and_interpolation(spark):
    from trialloom.operators import catalog

    df = spark.createDataFrame([(1, 2.0)], "trial_id long, x double")
    made = catalog.VirtualChannels().define("y", F.col("x") * 2).define("z", F.col("y") + 1, ["y"])
    assert made.read(df, ["z"]).columns == ["trial_id", "x", "z"] and made.read(df, ["z"]).head().z == 5
    assert made.read(df, ["x"]).columns == ["trial_id", "x"]
    with pytest.raises(ValueError):
        made.define("w", F.col("v"), ["v"])
    right = spark.createDataFrame([(1, 0.0, 0.0), (1, 4.0, 8.0), (1, 6.0, None)], "trial_id long, t double, v double")
    left = spark.createDataFrame([(1, t) for t in (-1.0, 0.0, 1.0, 4.0, 5.0)], "trial_id long, t double")
    assert [r.v for r in series.interpolated_lookup(left, right).orderBy("t").collect()] == [None, 0.0, 2.0, 8.0, None]


def test_joined_validity_takes_the_first_cause(spark):
    t = spark.createDataFrame([(i, i != 1, i != 2) for i in range(6)] + [(9, None, None)], "trial_id long, manual_valid boolean, temporary_valid boolean")
    al = spark.createDataFrame([(i, i != 4, "too short" if i == 4 else None) for i in (1, 2, 3, 4, 5, 9)], "trial_id long, valid boolean, cause string")
    got = {r.trial_id: r.cause for r in C.combined_validity(t, t.where("trial_id <> 3"), [al]).collect()}
    assert got == {0: "alignment 0: not aligned", 1: "manual", 2: "temporary", 3: "no condition", 4: "alignment 0: too short", 5: None, 9: None}


def test_trials_as_one_object(spark):
    from trialloom.api import Trials

    t = spark.createDataFrame([(i, 0.0, 100.0, "ab"[i % 2], float(i)) for i in range(8)], "trial_id long, t_start double, t_end double, side string, x double")
    ev = spark.createDataFrame([(i, "go", 1, 50.0) for i in range(7)], "trial_id long, event string, occ int, t double")
    td = Trials(t, ev).align("go-20:go+20 @ go").keep(F.col("x") != 2, "two").group_by("side")
    assert {r.trial_id: r.cause for r in td.validity().collect() if not r.valid} == {2: "two", 7: "missing zero event"}
    assert {r.cond: (r.n, r["mean"]) for r in td.means("x").collect()} == {0: (3, pytest.approx(10 / 3)), 1: (3, 3.0)}
    pts = spark.createDataFrame([(i, 50.0 + i) for i in range(8)], "trial_id long, t double")
    got = td.psth(pts, 10.0, kernels.identity(), mode="acausal").collect()
    assert {(r.cond, r.bin): round(r["mean"], 6) for r in got if r["mean"]} == {(0, 0): 100.0, (1, 0): 100.0}
    assert td.shuffled(3).members().groupBy("cond").count().where("count = 3").count() == 2
    assert td.resampled(4, 1).count() == 24
    series_ = td.series_means(pts.withColumn("v", F.col("t")), 10.0, "acausal", baseline=(0, 0)).collect()
    assert all(r["mean"] == 0 for r in series_)


def test_demixed_components_read_out_their_term(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.normal(size=6), rng.normal(size=6)
    cells = [(n, i * 4 + j, i, j, float(a[n] * (i - 1) + b[n] * (j - 1.5))) for n in range(6) for i in range(3) for j in range(4)]
    df = spark.createDataFrame(cells, "basis int, cond int, i int, j int, mean double")
    from trialloom.operators import contrasts

    term = contrasts.effects(df, ["i", "j"], "mean", ["basis"]).where("term = 'i'").selectExpr("basis", "i * 4 + j as cond", "effect as z")
    decoder, encoder = population.demixed_weights(df, term, 1)
    scores = {r.cond: r["mean"] for r in population.project(df.withColumn("sem", F.lit(0.0)), decoder).collect()}
    for i in range(3):  # the component does not change with j
        assert np.ptp([scores[i * 4 + j] for j in range(4)]) < 1e-6
    e = {r.basis: r.w for r in encoder.collect()}
    assert abs(np.dot([e[n] for n in range(6)], a)) / np.linalg.norm(a) > 1 - 1e-6
    shares = {r.term: r.share for r in contrasts.variance_by_term(contrasts.effects(df.where("basis = 0"), ["i", "j"], "mean")).collect()}
    assert sum(shares.values()) == pytest.approx(1) and shares["i:j"] < 1e-9
