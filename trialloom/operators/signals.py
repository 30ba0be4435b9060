"""Operators on values of series and on several channels at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _by_time(*more: str):
    return W.partitionBy("trial_id", *more).orderBy("t")


def clip(x: Column, lo: float, hi: float, missing: bool = False) -> Column:
    """Values beyond the limits become the limit, or NULL."""
    return F.when(x.between(lo, hi), x) if missing else F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def hysteresis(samples: DataFrame, low: float, high: float) -> DataFrame:
    """on: true from a sample at high or above until one below low; in between the last state holds."""
    state = F.when(F.col("v") >= high, True).when(F.col("v") < low, False)
    held = F.last(state, ignorenulls=True).over(_by_time().rowsBetween(W.unboundedPreceding, 0))
    return samples.withColumn("on", F.coalesce(held, F.lit(False)))


def runs(states: DataFrame) -> DataFrame:
    """trial_id, t0, t1, n of each stretch of samples with on = true."""
    w = _by_time()
    new = F.when(F.col("on") != F.coalesce(F.lag("on").over(w), ~F.col("on")), 1).otherwise(0)
    numbered = states.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.where("on").groupBy("trial_id", "_run").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n")).drop("_run")


def common_times(samples: DataFrame, names: list[str]) -> DataFrame:
    """trial_id, t and a column for each channel of samples(trial_id, channel, t, v): at every
    time of any of them, the channel's latest value."""
    wide = samples.where(F.col("channel").isin(names)).groupBy("trial_id", "t").pivot("channel", names).agg(F.first("v"))
    w = _by_time().rowsBetween(W.unboundedPreceding, 0)
    return wide.select("trial_id", "t", *[F.last(n, ignorenulls=True).over(w).alias(n) for n in names])


def mean_waveform(waves: DataFrame, by: list[str], wave: str = "wave") -> DataFrame:
    """Mean and deviation at each sample of the waveforms of a group; shorter ones count where they are."""
    long = waves.select(*by, F.posexplode(wave).alias("i", "v"))
    return long.groupBy(*by, "i").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count("v").alias("n"))


def common_waveforms(waves: DataFrame, first: str = "first", wave: str = "wave") -> DataFrame:
    """waves with all waveforms on one sample index: from the smallest first sample to the last one of
    any, missing where a waveform has none. first is the index of a waveform's first sample."""
    ends = waves.agg(F.min(first).alias("_lo"), F.max(F.col(first) + F.size(wave) - 1).alias("_hi"))  # one row
    place = lambda i: F.when(i >= F.col(first), F.get(wave, (i - F.col(first)).cast("int")))
    rows = waves.crossJoin(F.broadcast(ends)).where("_lo is not null")
    return rows.withColumn(wave, F.transform(F.sequence("_lo", "_hi"), place)).withColumn(first, F.col("_lo")).drop("_lo", "_hi")


def combine(x: str, weights: list[float]) -> Column:
    """The weighted sum of an array's elements."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    return F.aggregate(F.zip_with(F.col(x).cast("array<double>"), w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def overwrite(old: DataFrame, new: DataFrame, windows: DataFrame) -> DataFrame:
    """old without its samples in the closed window(trial_id, t0, t1) of their trial, and new's inside it."""
    w = windows.select("trial_id", "t0", "t1")
    outside = old.join(w, "trial_id", "left").where("t0 is null or t < t0 or t > t1").drop("t0", "t1")
    inside = new.join(w, "trial_id").where("t >= t0 and t <= t1").drop("t0", "t1")
    return outside.unionByName(inside)


def best_lag(a: DataFrame, b: DataFrame, by: list[str], most: int) -> DataFrame:
    """by, lag, r: the shift of b(by, i, v) against a for which they correlate best; ties take the smallest."""
    x = a.select(*by, "i", F.col("v").alias("x"))
    y = b.select(*by, F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"), F.col("i").alias("j"), F.col("v").alias("y")).withColumn("i", F.col("j") + F.col("lag")).drop("j")
    r = x.join(y, [*by, "i"]).groupBy(*by, "lag").agg(F.round(F.corr("x", "y"), 9).alias("r")).where("r is not null and not isnan(r)")
    return r.groupBy(*by).agg(F.max(F.struct("r", (-F.col("lag")).alias("m"))).alias("b")).select(*by, (-F.col("b.m")).alias("lag"), F.col("b.r").alias("r"))


def shared_artifacts(points: DataFrame, width: float, least: int) -> DataFrame:
    """points(trial_id, unit, t) that share their bin of width with points of least units or more."""
    binned = points.withColumn("bin", F.floor(F.col("t") / width))
    many = binned.groupBy("trial_id", "bin").agg(F.countDistinct("unit").alias("units")).where(F.col("units") >= least)
    return binned.join(many.select("trial_id", "bin"), ["trial_id", "bin"], "left_semi").drop("bin")


def density(histogram: DataFrame, at: list[float], bandwidth: float) -> DataFrame:
    """x, density: a Gaussian kernel estimate from a histogram(edge, n), at some places."""
    z = (F.col("x") - F.col("edge")) / bandwidth
    rows = histogram.withColumn("x", F.explode(F.array(*[F.lit(float(x)) for x in at])))
    weight = F.sum(F.col("n") * F.exp(-z * z / 2)) / F.sum("n")
    return rows.groupBy("x").agg((weight / (bandwidth * (2 * 3.141592653589793) ** 0.5)).alias("density"))


def ratio_sem(x: str, y: str) -> list[Column]:
    """ratio of means and its error by the delta method."""
    mx, my, n = F.avg(x), F.avg(y), F.count("*")
    var = F.var_samp(x) / (my * my) - 2 * mx * F.covar_samp(x, y) / (my * my * my) + mx * mx * F.var_samp(y) / (my * my * my * my)
    return [F.try_divide(mx, my).alias("ratio"), F.sqrt(var / n).alias("sem")]


def interpolated_times(samples: DataFrame, names: list[str]) -> DataFrame:
    """trial_id, t and a column for each channel of samples(trial_id, channel, t, v): at every time of
    any of them, the channel's value by interpolation between its own samples."""
    from trialloom.operators.series import interpolated_lookup

    rows = samples.where(F.col("channel").isin(names))
    out = rows.select("trial_id", "t").distinct()
    times = out
    for n in names:
        own = interpolated_lookup(times, rows.where(F.col("channel") == n)).withColumnRenamed("v", n)
        out = out.join(own, ["trial_id", "t"])
    return out


def shifted(b: DataFrame, lags: DataFrame, by: list[str]) -> DataFrame:
    """b(by, i, v) moved by its lag, as best_lag finds it."""
    return b.join(lags.select(*by, "lag"), by).withColumn("i", F.col("i") + F.col("lag")).drop("lag")


def splice(a: DataFrame, b: DataFrame, by: list[str], dims: list[str]) -> DataFrame:
    """by, i, dims: the series a(by, i, dims) up to where b comes nearest to it at the same i, and b
    from there on; of places as near, the first. Without any shared i there is no row."""
    y = b.select(*by, "i", *[F.col(d).alias(f"_{d}") for d in dims])
    gap = F.sqrt(sum(((F.col(d) - F.col(f"_{d}")) * (F.col(d) - F.col(f"_{d}")) for d in dims), F.lit(0.0)))
    at = a.join(y, [*by, "i"]).groupBy(*by).agg(F.min(F.struct(F.round(gap, 9).alias("g"), F.col("i"))).alias("_at")).select(*by, F.col("_at.i").alias("_i"))
    before = a.join(at, by).where(F.col("i") < F.col("_i")).select(*by, "i", *dims)
    return before.unionByName(b.join(at, by).where(F.col("i") >= F.col("_i")).select(*by, "i", *dims))


def splice_nearest(a: DataFrame, b: DataFrame, by: list[str], dims: list[str], within_a: tuple[int, int], within_b: tuple[int, int]) -> DataFrame:
    """by, i, dims, seam: a(by, i, dims) up to the place and b from the place on at which, of all pairs of
    places in the two windows (first and last i), they are nearest; b is moved so that its part
    follows. seam is the last i of a's part. Of pairs as near, the earliest in a and then in b."""
    state = F.array(*[F.col(d).cast("double") for d in dims])
    ends = b.where(F.col("i").between(*within_b)).groupBy(*by).agg(F.collect_list(F.struct("i", state.alias("x"))).alias("_b"))
    starts = a.where(F.col("i").between(*within_a)).select(*by, "i", state.alias("_x"))
    gap = lambda x: F.aggregate(F.zip_with("_x", x, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d)
    best = F.array_min(F.transform("_b", lambda y: F.struct(F.round(F.sqrt(gap(y["x"])), 9).alias("g"), F.col("i").alias("i"), y["i"].alias("j"))))
    seam = starts.join(ends, by).groupBy(*by).agg(F.min(best).alias("_s")).select(*by, F.col("_s.i").alias("seam"), F.col("_s.j").alias("_j"))
    before = a.join(seam, by).where(F.col("i") <= F.col("seam")).select(*by, "i", *dims, "seam")
    after = b.join(seam, by).where(F.col("i") > F.col("_j")).withColumn("i", F.col("seam") + F.col("i") - F.col("_j"))
    return before.unionByName(after.select(*by, "i", *dims, "seam"))


def seam_matrix(n: int, stiffness: float, hold: int = 2) -> list[list[float]]:
    """What n samples become when the squares of their changes and, times stiffness, of their second
    differences are made least together; hold samples at each end stay where they are."""
    import numpy as np

    bend = np.diff(np.eye(n), 2, axis=0)
    own = np.ones(n)
    own[:hold] = own[n - hold :] = 1e9 * (1 + stiffness)
    return np.linalg.solve(np.diag(own) + stiffness * bend.T @ bend, np.diag(own)).tolist()


def smooth_seam(series: DataFrame, by: list[str], dims: list[str], reach: int, stiffness: float) -> DataFrame:
    """series(by, i, dims, seam) with a bridge in place of the reach samples to each side of the seam (the
    seam's own among those before): a discrete smoothing spline that meets what is outside.

    Two samples more on each side hold its ends. A seam nearer than that to an end of its
    series stays as it is.
    """
    n = 2 * reach + 4
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in seam_matrix(n, stiffness)])
    place = (F.col("i") - F.col("seam") + reach + 1).cast("int")  # from 0 within the bridge
    near = series.where((place >= 0) & (place < n))
    wide = near.groupBy(*by).agg(*[F.transform(F.array_sort(F.collect_list(F.struct("i", F.col(d).cast("double").alias("v")))), lambda s: s["v"]).alias(f"_{d}") for d in dims], F.count("*").alias("_n"))
    rows = series.join(wide, by, "left")
    bridge = (F.col("_n") == n) & (place >= 0) & (place < n)
    dot = lambda d: F.aggregate(F.zip_with(F.get(table, place), f"_{d}", lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    return rows.select(*by, "i", *[F.when(F.coalesce(bridge, F.lit(False)), dot(d)).otherwise(F.col(d)).alias(d) for d in dims], "seam")


def joint_delays(series: DataFrame, most: int, rounds: int = 10) -> DataFrame:
    """trial_id, lag, r: how far each even series(trial_id, bin, v) lies behind what all have in common.

    What is common is the mean over trials of the series moved back by their lags, at first none.
    Each trial then takes the lag of at most most bins at which its correlation with that mean is
    highest (of equal ones the smallest), until no lag changes or rounds are over. r is the
    last correlation. Trials are arrays in their own row; the mean, as long as a trial, is one
    row that goes to all of them.
    """
    from trialloom.sources.tables import written

    values = series.where("v is not null").select("trial_id", "bin", F.col("v").cast("double").alias("v"))
    lags = values.select("trial_id").distinct().withColumn("lag", F.lit(0))
    for _ in range(rounds):
        moved = values.join(lags, "trial_id").withColumn("bin", F.col("bin") - F.col("lag"))
        mean = moved.groupBy("bin").agg(F.avg("v").alias("m"))
        pairs = values.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("bin", F.col("bin") - F.col("lag")).join(mean, "bin")  # which has as many rows as a trial has bins
        r = F.coalesce(F.round(F.try_divide(F.covar_pop("v", "m"), F.stddev_pop("v") * F.stddev_pop("m")), 9), F.lit(-2.0))  # a constant has none
        scored = pairs.groupBy("trial_id", "lag").agg(r.alias("r"))
        best = scored.groupBy("trial_id").agg(F.max(F.struct("r", (-F.abs("lag")).alias("near"), (-F.col("lag")).alias("lag"))).alias("b"))
        new = written(best.join(lags.withColumnRenamed("lag", "old"), "trial_id").select("trial_id", (-F.col("b.lag")).alias("lag"), F.when(F.col("b.r") > -2, F.col("b.r")).alias("r"), "old"))
        done = new.where("lag <> old").isEmpty()
        lags = new.select("trial_id", "lag")
        if done:
            break
    return new.select("trial_id", "lag", "r")


def undelayed(series: DataFrame, lags: DataFrame) -> DataFrame:
    """series(trial_id, bin, v) with each trial moved back by its lag."""
    return series.join(lags.select("trial_id", "lag"), "trial_id").withColumn("bin", F.col("bin") - F.col("lag")).drop("lag")
