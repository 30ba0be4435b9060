"""Counts, rates and resampled series on common grids of bins.

A bin has an integer label b; its label time is b * width. By mode it covers, relative to
that time, [-width, 0) (causal), [0, width) (acausal) or [-width / 2, width / 2)
(centered); only the very last bin of a grid is closed on the right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.functions.kernels import Taps
from trialloom.functions.stats import ceil_tol, floor_tol
from trialloom.operators.windows import in_window

# Where a bin begins relative to its label, in bins.
OFFSET = {"causal": -1.0, "acausal": 0.0, "centered": -0.5}


def bin_limits(aligned: DataFrame, width: float) -> DataFrame:
    """trial_id, zero, s, e, b0, b1: window relative to zero and its own first and last labels (for
    each align_id, if there is one)."""
    which = ["align_id"] if "align_id" in aligned.columns else []
    rows = aligned.where("zero is not null").select("trial_id", *which, "zero", "valid", "start_pad", "stop_pad", (F.col("start") - F.col("zero")).alias("s"), (F.col("stop") - F.col("zero")).alias("e"))
    return rows.withColumns({"b0": ceil_tol(F.col("s") / width, 1e-3).cast("long"), "b1": floor_tol(F.col("e") / width, 1e-3).cast("long")})


def common_grid(aligned: DataFrame, width: float) -> DataFrame:
    """first and last label over all trials with a window."""
    return bin_limits(aligned, width).agg(F.min("b0").alias("first"), F.max("b1").alias("last"))


def binned_counts(points: DataFrame, aligned: DataFrame, width: float, mode: str = "causal") -> DataFrame:
    """trial_id, bin, n for every bin that lies in its trial's window; 0 where no point falls.

    Points come from the padded window: a causal bin at the window's start needs a pad of
    width before it, an acausal one at its stop a pad after it. The grid of a trial is a
    sequence of its own bins, so no trial meets the bins of another. Trials and their points
    meet once, by trial; a bin is counted once for the grid and once for each point.
    """
    times = points.where(F.col("t").isNotNull()).groupBy("trial_id").agg(F.collect_list(F.col("t").cast("double")).alias("ts"))
    rows = _inner_bins(aligned, width).join(times, "trial_id", "left")
    return rows.select("trial_id", F.explode(_bins_met(width, mode)).alias("bin")).groupBy("trial_id", "bin").agg((F.count("*") - 1).alias("n"))


def _inner_bins(aligned: DataFrame, width: float) -> DataFrame:
    """Valid windows with lo and hi: a bin counts if its edges lie in the window moved by the mode's offset."""
    limits = bin_limits(aligned.where("valid"), width)
    return limits.withColumns({"lo": ceil_tol(F.col("s") / width).cast("long"), "hi": floor_tol(F.col("e") / width).cast("long")}).where("hi >= lo")


def _bins_met(width: float, mode: str) -> Column:
    """Of rows(zero, start_pad, stop_pad, lo, hi, ts) every bin of the grid once, and the bin of each point."""
    inside = F.filter("ts", lambda t: t.between(F.col("start_pad"), F.col("stop_pad")))
    labels = F.filter(F.transform(inside, lambda t: _label(t - F.col("zero"), width, mode)), lambda b: b.between(F.col("lo"), F.col("hi")))
    return F.concat(F.sequence("lo", "hi"), F.coalesce(labels, F.array().cast("array<bigint>")))


def _label(t: Column, width: float, mode: str, hi: str = "hi") -> Column:
    """The bin of a time relative to zero in a grid that ends with hi."""
    off = OFFSET[mode]
    last = F.abs(t - (F.col(hi) + 1 + off) * width) < 1e-9  # on the closing edge of the last bin
    return F.when(last, F.col(hi)).otherwise(F.floor(t / width - off).cast("long"))


def grids(aligned: DataFrame, groups: DataFrame, width: float) -> DataFrame:
    """trial_id, cond, m, zero, start_pad, stop_pad, lo, hi (for each align_id, if there is one): the first and
    last bin of each valid window, by the conditions of its trial; m, how often the trial is in one."""
    times = groups.groupBy("trial_id", "cond").agg(F.count("*").alias("m"))
    return _inner_bins(aligned, width).drop("s", "e", "b0", "b1", "valid").join(times, "trial_id")


def points_in_grids(points: DataFrame, spans: DataFrame, width: float, mode: str = "causal") -> DataFrame:
    """points(trial_id, t, ...) with the grids() of their trial and bin, where they fall into one of its bins."""
    rows = points.withColumn("t", F.col("t").cast("double")).join(spans, "trial_id").where(F.col("t").between(F.col("start_pad"), F.col("stop_pad")))
    return rows.withColumn("bin", _label(F.col("t") - F.col("zero"), width, mode)).where("bin between lo and hi")


def _valid_grids(sizes: DataFrame, least: int, keys: list[str]) -> DataFrame:
    """sizes(*keys, lo, hi, m) cut to the bins for which least trials have data: from the least-th smallest
    lo to the least-th largest hi (of all, where there are fewer)."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys)  # a row for each pair of lo and hi
    upto = sizes.withColumns({"_a": F.sum("m").over(w.orderBy("lo")), "_z": F.sum("m").over(w.orderBy(F.desc("hi")))})
    first = F.coalesce(F.min(F.when(F.col("_a") >= least, F.col("lo"))).over(w), F.max("lo").over(w))
    last = F.coalesce(F.max(F.when(F.col("_z") >= least, F.col("hi"))).over(w), F.min("hi").over(w))
    cut = upto.withColumns({"_first": first, "_last": last})
    return cut.select(*keys, F.greatest("lo", "_first").alias("lo"), F.least("hi", "_last").alias("hi"), "m").where("hi >= lo")


def rate_means(points: DataFrame, aligned: DataFrame, groups: DataFrame, width: float, taps: Taps | None = None, scale: float = 1.0, bases: list[str] | None = None, mode: str = "causal", min_count: int = 1, least: int = 0) -> DataFrame:
    """cond, bin, mean, sem, std, n over the trials of each condition (for each align_id, if there is one, and of bases,
    names in points' column basis) of counts through a kernel, times scale, where all of the kernel's bins are there.

    Zeros are counted, not made: only bins that a point reaches are rows of a trial, with their sums and
    squares, and how many trials have a bin follows from their grids, summed by condition and grid.
    least keeps the bins for which so many trials of a condition have data.
    """
    which = ["align_id"] if "align_id" in aligned.columns else []
    named = ["basis"] if bases is not None else []
    reach = [k for k, _ in taps or [(0, 1.0)]]
    spans = grids(aligned, groups, width)
    found = points.where(F.col("basis").isin(bases)) if named else points
    met = points_in_grids(found.select("trial_id", "t", *named), spans, width, mode)
    trial = [*which, *named, "cond", "trial_id", "m", "lo", "hi"]
    rates = met.groupBy(*trial, "bin").agg(F.count("*").cast("double").alias("x"))
    full = {"lo": F.col("lo") + max(reach), "hi": F.col("hi") + min(reach)}
    if taps is not None:
        kernel = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in taps])
        sent = rates.select("*", F.inline(kernel)).select(*trial, (F.col("bin") + F.col("k")).alias("bin"), (F.col("x") * F.col("w")).alias("x"))
        rates = sent.where(F.col("bin").between(full["lo"], full["hi"])).groupBy(*trial, "bin").agg(F.sum("x").alias("x"))
    keys = [*which, "cond"]
    sizes = spans.withColumns(full).where("hi >= lo").groupBy(*keys, "lo", "hi").agg(F.sum("m").alias("m"))
    there = _valid_grids(sizes, least, keys) if least else sizes
    if named:
        there = there.withColumn("basis", F.explode(F.array(*[F.lit(b) for b in bases])))
    none = F.lit(0.0)
    cells = there.select(*keys, *named, F.explode(F.sequence("lo", "hi")).alias("bin"), F.col("m").alias("n"), none.alias("s"), none.alias("q"))
    m, x = F.col("m"), F.col("x") * scale
    sums = rates.select(*keys, *named, "bin", F.lit(0).cast("long").alias("n"), (m * x).alias("s"), (m * x * x).alias("q"))
    rows = cells.unionByName(sums).groupBy(*which, *named, "cond", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).where("n > 0")
    n, enough = F.col("n"), F.col("n") >= min_count
    std = F.when(enough & (n > 1), F.sqrt(F.greatest(none, F.col("q") - F.col("s") * F.col("s") / n) / (n - 1)))
    return rows.select(*which, *named, "cond", "bin", F.when(enough, F.col("s") / n).alias("mean"), (std / F.sqrt(n)).alias("sem"), std.alias("std"), "n")


def kernel_means(points: DataFrame, aligned: DataFrame, groups: DataFrame, width: float, kernels: dict[str, Taps], mode: str = "causal", units_per_second: float = 1000.0) -> DataFrame:
    """kernel, cond, bin, mean, n over the trials of each condition of rates through each of several kernels.

    The mean of what a kernel makes of trials with the same grid is what it makes of their sum, so points
    and trials are summed by condition and grid first, once, and the kernels only see those sums.
    """
    spans = grids(aligned, groups, width)
    keys = ["cond", "lo", "hi"]
    counts = points_in_grids(points.select("trial_id", "t"), spans, width, mode).groupBy(*keys, "bin").agg(F.sum("m").alias("x"))
    sizes = spans.groupBy(*keys).agg(F.sum("m").alias("m"))
    taps = F.array(*[F.struct(F.lit(name).alias("kernel"), F.lit(k).alias("k"), F.lit(w).alias("w"), F.lit(min(t)[0]).alias("a"), F.lit(max(t)[0]).alias("z")) for name, t in kernels.items() for k, w in t])
    ends = F.array(*[F.struct(F.lit(name).alias("kernel"), F.lit(min(t)[0]).alias("a"), F.lit(max(t)[0]).alias("z")) for name, t in kernels.items()])
    full = [F.col("lo") + F.col("z"), F.col("hi") + F.col("a")]
    sent = counts.select("*", F.inline(taps)).withColumn("bin", F.col("bin") + F.col("k")).where(F.col("bin").between(*full))
    there = sizes.select("*", F.inline(ends)).where(full[0] <= full[1]).select("kernel", "cond", "m", F.explode(F.sequence(*full)).alias("bin"))
    sums = sent.select("kernel", "cond", "bin", (F.col("x") * F.col("w")).alias("x"), F.lit(0).cast("long").alias("n"))
    rows = sums.unionByName(there.select("kernel", "cond", "bin", F.lit(0.0).alias("x"), F.col("m").alias("n")))
    added = rows.groupBy("kernel", "cond", "bin").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return added.select("kernel", "cond", "bin", (F.col("x") / F.col("n") * units_per_second / width).alias("mean"), "n")


def counts_by_basis(points: DataFrame, aligned: DataFrame, bases: list[str], width: float, mode: str = "causal") -> DataFrame:
    """align_id, basis, trial_id, bin, n: binned counts of many sources under many alignments.

    points(basis, trial_id, t); aligned as of align_all. Points are gathered by trial and basis
    and meet the windows of their trial once, whatever the number of bases and alignments; a
    basis that has no point in a trial has zeros there. Bases are names of sources, not data.
    """
    wanted = points.where(F.col("t").isNotNull() & F.col("basis").isin(bases)).select("trial_id", "basis", F.col("t").cast("double").alias("t"))
    lists = wanted.repartition("trial_id").groupBy("trial_id", "basis").agg(F.collect_list("t").alias("ts"))
    found = lists.groupBy("trial_id").agg(F.collect_list(F.struct("basis", "ts")).alias("found"))
    rows = _inner_bins(aligned, width).join(found, "trial_id", "left")
    there = F.coalesce("found", F.array().cast("array<struct<basis:string,ts:array<double>>>"))
    absent = F.transform(F.array_except(F.array(*[F.lit(b) for b in bases]), F.transform(there, lambda x: x["basis"])), lambda b: F.struct(b.alias("basis"), F.array().cast("array<double>").alias("ts")))
    each = rows.withColumn("_b", F.explode(F.concat(there, absent))).select("*", "_b.basis", "_b.ts")
    binned = each.select("align_id", "basis", "trial_id", F.explode(_bins_met(width, mode)).alias("bin"))
    return binned.groupBy("align_id", "basis", "trial_id", "bin").agg((F.count("*") - 1).alias("n"))


def smooth(counts: DataFrame, taps: Taps, width: float, units_per_second: float = 1000.0, by: list[str] | None = None) -> DataFrame:
    """by, trial_id, bin, rate: counts through a kernel where all of its bins are there, per second.

    Each count is sent to the bins that its taps reach: one explode of len(taps) and one sum.
    """
    kernel = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in taps])
    keys = [*(by or []), "trial_id"]
    sent = counts.withColumn("tap", F.explode(kernel)).select(*keys, (F.col("bin") + F.col("tap.k")).alias("bin"), (F.col("n") * F.col("tap.w")).alias("x"))
    full = sent.groupBy(*keys, "bin").agg(F.sum("x").alias("x"), F.count("*").alias("taps")).where(F.col("taps") == len(taps))
    return full.select(*keys, "bin", (F.col("x") * units_per_second / width).alias("rate"))


def rate_changes(points: DataFrame, aligned: DataFrame, groups: DataFrame, width: float, taps: Taps, scale: float, bases: list[str], baseline: tuple[int, int, int], mode: str = "causal") -> DataFrame:
    """align_id, basis, cond, bin, change, n: counts through a kernel, times scale, less each trial's own mean over
    baseline, the bins first .. last of an alignment (align_id, first, last), over the trials that have one.

    aligned is as of align_all. Both are sums over points: one adds its taps to the bins around it and
    takes its part in the baseline from all bins of its trial's grid, which are summed by condition and grid.
    """
    from pyspark.sql import Window as W

    which, first, last = baseline
    reach = [k for k, _ in taps]
    spans = grids(aligned, groups, width).withColumns({"a": F.col("lo") + max(reach), "z": F.col("hi") + min(reach)})
    cut = F.struct("zero", "start_pad", "stop_pad", "lo", "hi", F.greatest("a", F.lit(first)).alias("a"), F.least("z", F.lit(last)).alias("z"))
    base = F.max(F.when((F.col("align_id") == which) & (F.least("z", F.lit(last)) >= F.greatest("a", F.lit(first))), cut))
    spans = spans.withColumn("base", base.over(W.partitionBy("trial_id", "cond"))).where("z >= a")  # a row an alignment

    def weight(at: Column, a: str, z: str) -> list[Column]:
        return [F.when((at + k).between(F.col(a), F.col(z)), F.lit(w)).otherwise(0.0) for k, w in taps]

    def inside(at: str) -> Column:  # the bin of a point in a grid, missing outside of it
        label = _label(F.col("t") - F.col(f"{at}zero"), width, mode, f"{at}hi")
        return F.when(F.col("t").between(F.col(f"{at}start_pad"), F.col(f"{at}stop_pad")) & label.between(F.col(f"{at}lo"), F.col(f"{at}hi")), label)

    rows = points.where(F.col("basis").isin(bases)).select("trial_id", "basis", F.col("t").cast("double").alias("t")).join(spans.where("base is not null"), "trial_id")
    rows = rows.withColumns({"bin": inside(""), "before": inside("base.")}).where("bin is not null or before is not null")
    own = [F.struct((F.col("bin") + k).alias("at"), w.alias("x")) for (k, _), w in zip(taps, weight(F.col("bin"), "a", "z"), strict=True)]
    share = sum(weight(F.col("before"), "base.a", "base.z"), F.lit(0.0)) / (F.col("base.z") - F.col("base.a") + 1)
    parts = F.filter(F.array(*own, F.struct(F.lit(None).cast("long").alias("at"), (-share).alias("x"))), lambda p: p["x"] != 0)
    sent = rows.select("align_id", "basis", "cond", "a", "z", "m", F.inline(parts)).groupBy("align_id", "basis", "cond", "a", "z", "at").agg(F.sum(F.col("m") * F.col("x")).alias("x"))
    everywhere = F.when(F.col("at").isNull(), F.sequence("a", "z")).otherwise(F.array("at"))
    sums = sent.select("align_id", "basis", "cond", F.explode(everywhere).alias("bin"), "x", F.lit(0).cast("long").alias("n"))
    sizes = spans.groupBy("align_id", "cond", "a", "z").agg(F.sum(F.when(F.col("base").isNotNull(), F.col("m")).otherwise(0)).alias("n"))
    cells = sizes.withColumn("basis", F.explode(F.array(*[F.lit(b) for b in bases]))).select("align_id", "basis", "cond", F.explode(F.sequence("a", "z")).alias("bin"), F.lit(0.0).alias("x"), "n")
    added = sums.unionByName(cells).groupBy("align_id", "basis", "cond", "bin").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return added.select("align_id", "basis", "cond", "bin", (F.try_divide("x", "n") * scale).alias("change"), "n")


def mean_rate(points: DataFrame, aligned: DataFrame, units_per_second: float = 1000.0) -> DataFrame:
    """trial_id, n, duration, rate: points in the window over its length; NULL for no length."""
    n = in_window(points, aligned).groupBy("trial_id").agg(F.count("*").alias("n"))
    span = aligned.select("trial_id", "valid", F.greatest(F.col("stop") - F.col("start"), F.lit(0.0)).alias("duration"))
    rows = span.join(n, "trial_id", "left").withColumn("n", F.when(F.col("valid"), F.coalesce("n", F.lit(0))))
    return rows.select("trial_id", "n", "duration", (F.try_divide(F.col("n"), F.col("duration")) * units_per_second).alias("rate"))


def counts_in_windows(points: DataFrame, aligned: DataFrame) -> DataFrame:
    """align_id, trial_id, n for every valid window of every alignment: the points(trial_id, t) in it,
    whatever their source."""
    n = in_window(points.select("trial_id", "t"), aligned).groupBy("align_id", "trial_id").agg(F.count("*").alias("n"))
    return aligned.where("valid").select("align_id", "trial_id").join(n, ["align_id", "trial_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def psth(points: DataFrame, aligned: DataFrame, groups: DataFrame, width: float, taps: Taps, units_per_second: float = 1000.0, min_count: int = 1, mode: str = "causal") -> DataFrame:
    """cond, bin, mean, sem, std, n: align, bin, smooth, average over the trials of a condition.

    groups(trial_id, cond) is a membership table; a trial may be in several conditions.
    """
    return rate_means(points, aligned, groups, width, taps, units_per_second / width, mode=mode, min_count=min_count)


def resample_average(samples: DataFrame, width: float, mode: str = "causal") -> DataFrame:
    """trial_id, bin, v: mean of the samples in each bin."""
    label = F.floor(F.col("t") / width - OFFSET[mode]).cast("long")
    return samples.groupBy("trial_id", label.alias("bin")).agg(F.avg(F.when(~F.isnan("v"), F.col("v"))).alias("v"))


def resample_interpolated(samples: DataFrame, width: float, beyond: float = 0.0) -> DataFrame:
    """trial_id, bin, v: linear interpolation of each trial's samples at multiples of width.

    Each sample and its successor bracket the grid points between them, so a trial's grid
    comes from its own samples with one window and no search. Points up to beyond before the
    first and after the last sample lie on the line through the two samples next to them.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("trial_id").orderBy("t")
    pairs = samples.where("v is not null and not isnan(v)").withColumns({"t1": F.lead("t").over(w), "v1": F.lead("v").over(w)})
    lo, hi = F.ceil(F.col("t") / width).cast("long"), F.floor(F.col("t1") / width).cast("long")
    hi = F.when(F.col("t1") == F.floor(F.col("t1") / width) * width, hi - 1).otherwise(hi)  # the next pair has its own end
    alone = F.when(F.col("t") == lo * width, lo).otherwise(lo - 1)
    if beyond:
        pairs = pairs.withColumns({"_first": F.lag("t").over(w).isNull(), "_last": F.lead("t1").over(w).isNull()})
        lo = F.when(F.col("_first") & F.col("t1").isNotNull(), F.ceil((F.col("t") - beyond) / width).cast("long")).otherwise(lo)
        hi = F.when(F.col("_last"), F.floor((F.col("t1") + beyond) / width).cast("long")).otherwise(hi)
        alone = F.when(F.lag("t").over(w).isNull(), alone).otherwise(lo - 1)  # the last sample's point is on the line before it
    spans = pairs.withColumns({"lo": lo, "hi": F.when(F.col("t1").isNull(), alone).otherwise(hi)}).where("hi >= lo")
    points = spans.withColumn("bin", F.explode(F.sequence("lo", "hi")))
    x = F.col("v") + F.coalesce((F.col("v1") - F.col("v")) * (F.col("bin") * width - F.col("t")) / (F.col("t1") - F.col("t")), F.lit(0.0))
    return points.select("trial_id", "bin", x.alias("v"))


def resample_nearest(samples: DataFrame, width: float) -> DataFrame:
    """trial_id, bin, v: at multiples of width between a trial's samples the value of the nearest
    sample, of two as near the earlier one."""
    return _between(samples, width, lambda t, t1, v, v1, at: F.when(t1.isNotNull() & (t1 - at < at - t), v1).otherwise(v))


def resample_repeated(samples: DataFrame, width: float) -> DataFrame:
    """trial_id, bin, v: at multiples of width the value of the last sample before or there."""
    return _between(samples, width, lambda t, t1, v, v1, at: v)


def _between(samples: DataFrame, width: float, value) -> DataFrame:
    """value(t, t1, v, v1, at) for the grid points at that a sample(t, v) and its successor(t1, v1) bracket."""
    from pyspark.sql import Window as W

    w = W.partitionBy("trial_id").orderBy("t")
    pairs = samples.where("v is not null and not isnan(v)").withColumns({"t1": F.lead("t").over(w), "v1": F.lead("v").over(w)})
    lo, hi = F.ceil(F.col("t") / width).cast("long"), F.ceil(F.col("t1") / width).cast("long") - 1
    alone = F.when(F.col("t") == lo * width, lo).otherwise(lo - 1)
    spans = pairs.withColumns({"lo": lo, "hi": F.when(F.col("t1").isNull(), alone).otherwise(hi)}).where("hi >= lo")
    points = spans.withColumn("bin", F.explode(F.sequence("lo", "hi")))
    return points.select("trial_id", "bin", value(F.col("t"), F.col("t1"), F.col("v"), F.col("v1"), F.col("bin") * width).alias("v"))


def decimate(series: DataFrame, factor: int, taps: Taps | None = None) -> DataFrame:
    """trial_id, bin, v: every factor-th bin of an even series(trial_id, bin, v) after a low pass that
    takes out what the coarser grid cannot hold (by default a bell of half the factor); bins near
    the ends, where the kernel has not all of its bins, are left out."""
    from trialloom.functions.kernels import gaussian

    taps = taps or gaussian(factor / 2, 1.0)
    smoothed = smooth(series.select("trial_id", "bin", F.col("v").alias("n")), taps, 1.0, 1.0)
    return smoothed.where(F.pmod("bin", F.lit(factor)) == 0).select("trial_id", (F.col("bin") / factor).cast("long").alias("bin"), F.col("rate").alias("v"))
