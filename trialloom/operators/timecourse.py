"""Series by condition and time: slices on a common grid, baselines, means over trials."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.functions.stats import clean, mean_sem
from trialloom.operators.binning import resample_average, resample_interpolated
from trialloom.operators.ranking import hazen_quantiles
from trialloom.operators.windows import in_window


def on_grid(samples: DataFrame, aligned: DataFrame, width: float, mode: str = "causal", interpolate: bool = False) -> DataFrame:
    """trial_id, bin, v: the aligned slice of each trial on a grid of width around its zero, by the
    mean of each bin or by interpolation at the grid's points."""
    inside = in_window(samples.select("trial_id", "t", "v"), aligned)
    return resample_interpolated(inside, width) if interpolate else resample_average(inside, width, mode)


def trial_baseline(series: DataFrame, first: int, last: int) -> DataFrame:
    """trial_id, baseline: each trial's mean over the bins first .. last."""
    return series.where(F.col("bin").between(first, last)).groupBy("trial_id").agg(F.avg("v").alias("baseline"))


def condition_baseline(series: DataFrame, groups: DataFrame, first: int, last: int) -> DataFrame:
    """trial_id, baseline: over the bins first .. last the mean of the means of a condition's trials."""
    within = trial_baseline(series, first, last).join(groups.select("trial_id", "cond"), "trial_id")
    means = within.groupBy("cond").agg(F.avg("baseline").alias("baseline"))
    return groups.select("trial_id", "cond").join(means, "cond").select("trial_id", "baseline")


def subtract_baseline(series: DataFrame, baseline: DataFrame | Column | float) -> DataFrame:
    """series with v less a baseline: a table(trial_id, baseline), a column of series or a number.
    Trials without a baseline have none of their values left."""
    if isinstance(baseline, DataFrame):
        joined = series.join(baseline.select("trial_id", "baseline"), "trial_id", "left")
        return joined.withColumn("v", F.col("v") - F.col("baseline")).drop("baseline")
    return series.withColumn("v", F.col("v") - (baseline if isinstance(baseline, Column) else F.lit(float(baseline))))


def group_means(series: DataFrame, groups: DataFrame, min_count: int = 1, by: list[str] | None = None) -> DataFrame:
    """cond, bin, mean, sem, std, n over the trials of each condition (and by, such as a basis)."""
    rows = series.join(groups.select("trial_id", "cond"), "trial_id")
    return rows.groupBy(*(by or []), "cond", "bin").agg(*mean_sem("v", min_count))


def time_then_trial_means(samples: DataFrame, groups: DataFrame, min_count: int = 1) -> DataFrame:
    """cond, mean, sem, std, n: each trial's mean over time, then over the trials of a condition."""
    within = samples.groupBy("trial_id").agg(F.avg(clean("v")).alias("v")).join(groups.select("trial_id", "cond"), "trial_id")
    return within.groupBy("cond").agg(*mean_sem("v", min_count))


def signal_to_noise(cells: DataFrame, by: list[str] | None = None, reach: float = 0.95, noise: float = 0.9) -> DataFrame:
    """*by, snr: the span of the means of cells(mean, sem) over the size of their errors, by exact quantiles:
    reach less what it leaves over for the means, noise for the errors. Cells without an error do not count."""
    keys, known = by or [], cells.where("sem > 0")
    means = hazen_quantiles(known, keys, "mean", [1 - reach, reach]).groupBy(*keys).agg((F.max("x") - F.min("x")).alias("_span"))
    errors = hazen_quantiles(known, keys, "sem", [noise]).select(*keys, F.col("x").alias("_noise"))
    both = means.join(errors, keys) if keys else means.crossJoin(errors)  # a row each
    return both.select(*keys, F.try_divide("_span", "_noise").alias("snr"))


def tuning_depth(cells: DataFrame, by: list[str], cond: str = "cond", value: str = "mean") -> DataFrame:
    """*by, n, lowest, highest, depth: the conditions with the lowest and highest mean, and how far these lie apart."""
    return cells.groupBy(*by).agg(F.count("*").alias("n"), F.min_by(cond, value).alias("lowest"), F.max_by(cond, value).alias("highest"), (F.max(value) - F.min(value)).alias("depth"))


def regrouped(cube: DataFrame, conditions: dict[int, int], by: list[str]) -> DataFrame:
    """*by, cond, mean, sem, n of a cube whose conditions are merged as conditions says (old to new; others
    go): as if their trials had been one condition's. by names the cube's other keys."""
    mapping = F.create_map(*[F.lit(x) for pair in conditions.items() for x in pair])
    rows = cube.withColumn("cond", F.try_element_at(mapping, F.col("cond"))).where("cond is not null and n > 0")
    n, mean = F.col("n"), F.col("mean")
    # squares of the trials' deviations: within a condition n (n - 1) sem^2, and of its mean from the mean of all
    sums = rows.groupBy(*by, "cond").agg(F.sum(n).alias("n"), F.sum(n * mean).alias("_s"), F.sum(n * mean * mean + n * (n - 1) * F.coalesce(F.col("sem") * F.col("sem"), F.lit(0.0))).alias("_q"))
    spread = F.greatest(F.lit(0.0), F.col("_q") - F.col("_s") * F.col("_s") / F.col("n"))
    return sums.select(*by, "cond", (F.col("_s") / F.col("n")).alias("mean"), F.sqrt(F.try_divide(spread, F.col("n") * (F.col("n") - 1))).alias("sem"), "n")


def valid_bases(cubes: list[DataFrame]) -> DataFrame:
    """basis: those that in each of the cubes(basis, mean, ...) have a mean somewhere."""
    found = [c.where("mean is not null").select("basis").distinct() for c in cubes]
    return reduce(lambda a, b: a.join(b, "basis", "left_semi"), found)


def population(sources: dict[str, DataFrame]) -> DataFrame:
    """basis, trial_id, bin, v: the series(trial_id, bin, v) of several tables as one. Sources that
    lie in one table need no union: binning.counts_by_basis takes them by name."""
    out = None
    for basis, series in sources.items():
        part = series.select(F.lit(basis).alias("basis"), "trial_id", "bin", F.col("v").cast("double").alias("v"))
        out = part if out is None else out.unionByName(part)
    return out


def valid_windows(series: DataFrame, groups: DataFrame, least: int, by: list[str] | None = None) -> DataFrame:
    """by, cond, first, last: the bins for which, in every basis, least trials of a condition have data.

    A basis has data from the least-th smallest first bin of its trials to the least-th
    largest last one; a condition's window is what all bases share (for each of by, such as align_id).
    """
    from trialloom.operators.population import common_window

    keys = by or []
    spans = series.where("v is not null").groupBy(*keys, "basis", "trial_id").agg(F.min("bin").alias("t0"), F.max("bin").alias("t1"))
    windows = common_window(spans.join(groups.select("trial_id", "cond"), "trial_id"), [*keys, "basis", "cond"], least)
    return windows.groupBy(*keys, "cond").agg(F.max("t_min").alias("first"), F.min("t_max").alias("last"))


def population_means(series: DataFrame, groups: DataFrame, least: int = 1, by: list[str] | None = None) -> DataFrame:
    """by, basis, cond, bin, mean, sem, std, n inside each condition's valid window."""
    keys = by or []
    cube = group_means(series, groups, least, [*keys, "basis"])
    inside = (F.col("bin") >= F.col("first")) & (F.col("bin") <= F.col("last"))
    return cube.join(valid_windows(series, groups, least, keys), [*keys, "cond"]).where(inside).drop("first", "last")


def end_to_end(cube: DataFrame, gap: int = 0) -> DataFrame:
    """cube(align_id, bin, ...) with place: its bins on one axis where each alignment begins gap bins
    after the last bin of the one before it, from 0."""
    spans = cube.groupBy("align_id").agg(F.min("bin").alias("_lo"), F.max("bin").alias("_hi"))
    before = F.sum(F.col("_hi") - F.col("_lo") + 1 + gap).over(W.orderBy("align_id").rowsBetween(W.unboundedPreceding, -1))  # a row an alignment
    offsets = spans.select("align_id", (F.coalesce(before, F.lit(0)) - F.col("_lo")).alias("_offset"))
    return cube.join(F.broadcast(offsets), "align_id").withColumn("place", F.col("bin") + F.col("_offset")).drop("_offset")


def complete_rows(cube: DataFrame, bases: int) -> DataFrame:
    """The rows of the times of a condition at which all bases have a mean."""
    full = cube.where("mean is not null").groupBy("cond", "bin").agg(F.count("*").alias("_n")).where(F.col("_n") == bases)
    return cube.join(full.drop("_n"), ["cond", "bin"], "left_semi")


def matrix(cube: DataFrame, bases: list[str], value: str = "mean") -> DataFrame:
    """cond, bin and a column for each basis."""
    return cube.groupBy("cond", "bin").pivot("basis", bases).agg(F.first(value))


def nearest_distances(cube: DataFrame, bases: list[str]) -> DataFrame:
    """cond_a, cond_b, bin, distance, nearest: for each time of cond_a how far the state of cond_b is
    at the same time, and how far the nearest state of cond_b at any time.

    A condition at a time is one array with a value for each basis (the names of sources, in
    order); rows that lack one are left out. Times of two conditions meet as arrays, one row
    for each pair of conditions and time.
    """
    states = matrix(cube, bases).select("cond", "bin", F.array(*bases).alias("x")).where(~F.exists("x", lambda v: v.isNull()))
    path = states.groupBy(F.col("cond").alias("cond_b")).agg(F.collect_list(F.struct("bin", "x")).alias("path"))
    pairs = states.withColumnRenamed("cond", "cond_a").join(path, F.col("cond_a") != F.col("cond_b"))
    # arrays of the bases' differences, squared and summed, one for each time of the other condition
    gaps = F.transform("path", lambda p: F.struct(p["bin"].alias("bin"), F.sqrt(F.aggregate(F.zip_with("x", p["x"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)).alias("d")))
    same = F.get(F.filter("gaps", lambda g: g["bin"] == F.col("bin")), F.lit(0))["d"]
    return pairs.withColumn("gaps", gaps).select("cond_a", "cond_b", "bin", same.alias("distance"), F.array_min(F.transform("gaps", lambda g: g["d"])).alias("nearest"))
