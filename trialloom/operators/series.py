"""Operators along a trial: occurrences, intervals, crossings, histories, correlograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.operators.joins import band_join
from trialloom.operators.ranking import hazen_quantiles, numbered


def _by_time():
    return W.partitionBy("trial_id").orderBy("t")


def occurrences(events: DataFrame, first: int = 1, last: int = 1, from_end: bool = False) -> DataFrame:
    """Occurrences first .. last of each event of a trial, counted from either end."""
    w = W.partitionBy("trial_id", "event").orderBy(F.col("occ").desc() if from_end else F.col("occ").asc())
    return events.withColumn("nth", F.row_number().over(w)).where(F.col("nth").between(first, last))


def event_summary(trials: DataFrame, events: DataFrame, event: str) -> DataFrame:
    """trial_id, n, has, first, last of an event in every trial."""
    found = events.where(F.col("event") == event).groupBy("trial_id").agg(F.count("t").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))
    rows = trials.select("trial_id").join(found, "trial_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("trial_id", "n", (F.col("n") > 0).alias("has"), "first", "last")


def previous(trials: DataFrame, column: str, n: int, valid: Column, within: list[str]) -> Column:
    """The value n trials before within a stored order, NULL where this or that trial is invalid."""
    *groups, order = within
    w = W.partitionBy(*groups).orderBy(order)
    return F.when(valid, F.lag(F.when(valid, F.col(column)), n).over(w))


def intervals_between(events: DataFrame) -> DataFrame:
    """trial_id, t, gap to the preceding point of the trial."""
    return events.select("trial_id", "t", (F.col("t") - F.lag("t").over(_by_time())).alias("gap")).where("gap is not null")


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Union of overlapping or touching intervals(trial_id, t0, t1) of a trial; chains too."""
    w = W.partitionBy("trial_id").orderBy("t0", "t1")
    reach = F.max("t1").over(w.rowsBetween(W.unboundedPreceding, -1))
    starts = intervals.where("t0 <= t1").withColumn("new", F.when(reach.isNull() | (F.col("t0") > reach), 1).otherwise(0))
    numbered = starts.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("trial_id", "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("island")


def clip_intervals(intervals: DataFrame, aligned: DataFrame) -> DataFrame:
    """Intervals that meet their trial's window, cut to it."""
    joined = intervals.join(aligned.where("valid").select("trial_id", "start", "stop"), "trial_id").where("t0 <= stop and t1 >= start")
    return joined.select("trial_id", F.greatest("t0", "start").alias("t0"), F.least("t1", "stop").alias("t1"))


def _covered(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points(trial_id, t, ...) and whether one of their trial's closed spans(trial_id, t0, t1) holds them, as _in.

    One window over both: a span holds a point if the latest end of those begun by then is not before it.
    """
    begun = spans.where("trial_id is not null and t0 is not null").select("trial_id", F.col("t0").alias("_at"), F.lit(0).alias("_side"), F.col("t1").alias("_end"))
    both = points.select("trial_id", F.col("t").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(begun.schema["_end"].dataType).alias("_end"), F.struct("*").alias("_row")).unionByName(begun, allowMissingColumns=True)
    w = W.partitionBy("trial_id").orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    hit = F.coalesce(F.max("_end").over(w) >= F.col("_at"), F.lit(False))
    return both.withColumn("_in", hit).where("_side = 1").select("_row.*", "_in")


def outside_intervals(points: DataFrame, blanks: DataFrame) -> DataFrame:
    """Points in no closed blank interval(trial_id, t0, t1) of their trial: a range anti join."""
    return _covered(points, blanks).where("not _in").drop("_in")


def triggered_counts(points: DataFrame, triggers: DataFrame, before: float, after: float) -> DataFrame:
    """trial_id, occ, n: points within [trigger + before, trigger + after], 0 if there are none.

    Time is cut into bands as long as a window, so a window meets two. In each band a running
    count of the points stands at both ends of a window; the difference is what it holds.
    No point meets a trigger, however many there are of both.
    """
    width = float(after - before) or 1.0
    marks = triggers.select("trial_id", "occ", (F.col("t") + before).alias("lo"), (F.col("t") + after).alias("hi"))
    ends = F.array(F.struct(F.col("lo").alias("at"), F.lit(0).alias("side"), F.lit(-1).alias("sign")), F.struct(F.col("hi").alias("at"), F.lit(2).alias("side"), F.lit(1).alias("sign")))
    cut = marks.withColumn("band", F.explode_outer(F.when(F.lit(after >= before), F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)))))
    probes = cut.select("trial_id", "band", "occ", F.explode(ends).alias("e")).select("trial_id", "band", "occ", "e.at", "e.side", "e.sign")
    counted = points.where("trial_id is not null and t is not null").select("trial_id", F.floor(F.col("t") / width).alias("band"), F.col("t").alias("at"), F.lit(1).alias("side"))
    both = counted.unionByName(probes, allowMissingColumns=True)
    so_far = F.count(F.when(F.col("side") == 1, 1)).over(W.partitionBy("trial_id", "band").orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("n", so_far).where("side <> 1").groupBy("trial_id", "occ").agg(F.sum(F.col("n") * F.col("sign")).alias("n"))


def cross_correlogram(a: DataFrame, b: DataFrame, width: float, reach: float) -> DataFrame:
    """lag bin, n: differences b.t - a.t of points in the same trial up to reach."""
    around = a.select("trial_id", F.col("t").alias("ta"), (F.col("t") - reach).alias("lo"), (F.col("t") + reach).alias("hi"))
    # a little wider, as the ends are rounded; the lag itself decides
    wider = around.withColumns({"lo": F.col("lo") - 1e-9 * F.abs("lo"), "hi": F.col("hi") + 1e-9 * F.abs("hi")})
    lag = F.col("t") - F.col("ta")
    pairs = band_join(b.select("trial_id", "t"), wider, float(reach) or 1.0).where(F.abs(lag) <= reach)
    return pairs.groupBy(F.floor(lag / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def as_of(left: DataFrame, right: DataFrame) -> DataFrame:
    """left(trial_id, t) with v of the latest right(trial_id, t, v) at or before t whose v is known:
    rows of right without a value are passed over.

    Both sides go through one window over their union; there is no join of rows by range.
    """
    both = left.select("trial_id", "t", F.lit(None).cast("double").alias("v"), F.lit(1).alias("side")).unionByName(right.select("trial_id", "t", F.col("v").cast("double").alias("v"), F.lit(0).alias("side")))
    w = W.partitionBy("trial_id").orderBy("t", "side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("v", F.last("v", ignorenulls=True).over(w)).where("side = 1").drop("side")


def crossings(samples: DataFrame, threshold: float) -> DataFrame:
    """Samples(trial_id, t, v) right before the series first lies beyond the threshold.

    A negative threshold is crossed downwards.
    """
    beyond = F.col("v") <= threshold if threshold < 0 else F.col("v") >= threshold
    marked = samples.withColumn("on", beyond).withColumn("next", F.lead("on").over(_by_time()))
    return marked.where("not on and next").select("trial_id", "t", "v")


#: Points that one step of lock_out's fold takes.
_STEP = 256


def lock_out(points: DataFrame, period: float) -> DataFrame:
    """trial_id, t: the first point of a trial and then each that comes period or more after the last kept one.

    A point that comes period or more after its predecessor is always kept, so trials fall
    into stretches between such points. Inside a stretch a fold carries the last kept point
    and, for a few points at a time, the kept ones; it takes time in proportion to the points.
    """
    times = points.where(F.col("t").isNotNull()).select("trial_id", F.col("t").cast("double").alias("t"))
    marked = times.withColumn("head", F.coalesce(F.col("t") - F.lag("t").over(_by_time()) >= period, F.lit(True)))
    cut = marked.withColumn("stretch", F.sum(F.col("head").cast("long")).over(_by_time().rowsBetween(W.unboundedPreceding, 0)))
    rows = cut.groupBy("trial_id", "stretch").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def kept(last, ts):
        start = F.struct(last.alias("last"), F.array().cast("array<double>").alias("kept"))
        return F.aggregate(ts, start, lambda acc, t: F.when(t - acc["last"] >= period, F.struct(t.alias("last"), F.array_append(acc["kept"], t).alias("kept"))).otherwise(acc))

    def step(acc, i):
        inner = kept(acc["last"], F.slice("ts", i * _STEP + 1, _STEP))
        return F.get(F.transform(F.array(inner), lambda x: F.struct(x["last"].alias("last"), F.array_append(acc["kept"], x["kept"]).alias("kept"))), F.lit(0))

    start = F.struct(F.lit(float("-inf")).alias("last"), F.array().cast("array<array<double>>").alias("kept"))
    folded = F.aggregate(F.sequence(F.lit(0), F.floor((F.size("ts") - 1) / _STEP).cast("int")), start, step)
    return rows.select("trial_id", F.explode(F.flatten(folded["kept"])).alias("t"))


def fill_edges(samples: DataFrame) -> DataFrame:
    """NULL values take the last known value of the trial, or the first where none precedes."""
    ahead = W.partitionBy("trial_id").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy("trial_id").orderBy("t").rowsBetween(0, W.unboundedFollowing)
    return samples.withColumn("v", F.coalesce(F.last("v", ignorenulls=True).over(ahead), F.first("v", ignorenulls=True).over(back)))


def running_extremes(samples: DataFrame) -> DataFrame:
    w = _by_time().rowsBetween(W.unboundedPreceding, 0)
    return samples.withColumns({"high": F.max("v").over(w), "low": F.min("v").over(w)})


def sampling_period(samples: DataFrame) -> DataFrame:
    """period: the median over trials of the median step of a trial."""
    steps = samples.select("trial_id", (F.col("t") - F.lag("t").over(_by_time())).alias("dt")).where("dt is not null")
    return hazen_quantiles(steps.groupBy("trial_id").agg(F.median("dt").alias("dt")), [], "dt", [0.5]).select(F.col("x").alias("period"))


def move_across(points: DataFrame, starts: DataFrame, copy: bool = False) -> DataFrame:
    """Points after the new end of their trial go to the next trial (trial_id + 1), if there is one.

    starts(trial_id, new_end, length): new_end in the trial's time, and its length so far. With
    copy they stay in their own trial as well.
    """
    nxt = starts.select((F.col("trial_id") - 1).alias("trial_id"), F.lit(True).alias("has_next"))
    rows = points.join(starts, "trial_id").join(nxt, "trial_id", "left")
    moves = F.coalesce(F.col("has_next"), F.lit(False)) & (F.col("t") > F.col("new_end"))
    return _moved(rows, moves, F.col("trial_id") + 1, F.col("t") - F.col("length"), copy)


def move_back(points: DataFrame, begins: DataFrame, copy: bool = False) -> DataFrame:
    """Points before the new start of their trial go to the trial before (trial_id - 1), if there is one.

    begins(trial_id, new_start, length): new_start in the trial's time, and its length so far. With
    copy they stay in their own trial as well.
    """
    before = begins.select((F.col("trial_id") + 1).alias("trial_id"), F.col("length").alias("_before"))
    rows = points.join(begins.drop("length"), "trial_id").join(before, "trial_id", "left")
    moves = F.col("_before").isNotNull() & (F.col("t") < F.col("new_start"))
    return _moved(rows, moves, F.col("trial_id") - 1, F.col("t") + F.col("_before"), copy)


def _moved(rows: DataFrame, moves: Column, to: Column, at: Column, copy: bool) -> DataFrame:
    stay = F.struct("trial_id", "t")
    gone = F.struct(to.alias("trial_id"), at.alias("t"))
    both = F.array(stay, gone) if copy else F.array(gone)
    return rows.select(F.explode(F.when(moves, both).otherwise(F.array(stay))).alias("p")).select("p.trial_id", "p.t")


def splice_events(trials: DataFrame, forward: bool = True, event: str = "TrialSplice") -> DataFrame:
    """trial_id, event, occ, t: where a trial that took over its neighbour's points was joined to them, in its
    own time. trials(trial_id, length); forward: what came from the trial before lies ahead of 0,
    else what came from the trial after lies beyond the trial's length."""
    step = 1 if forward else -1
    other = trials.select((F.col("trial_id") + step).alias("trial_id"))
    rows = trials.join(other, "trial_id", "left_semi")
    return rows.select("trial_id", F.lit(event).alias("event"), F.lit(1).alias("occ"), (F.lit(0.0) if forward else F.col("length").cast("double")).alias("t"))


def ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """df with rank, that of a value in its group, from 1; ties share the smallest, missing values come last."""
    return numbered(df, by, value, ties=True).withColumn("rank", (F.col("i") + 1).cast("int")).drop("i")


def nth_true(states: DataFrame, n: int, from_end: bool = False) -> DataFrame:
    """trial_id, t of the n-th sample of states(trial_id, t, on) that is on, where there are so many."""
    w = W.partitionBy("trial_id").orderBy(F.desc("t") if from_end else F.asc("t"))
    return states.where("on").withColumn("_n", F.row_number().over(w)).where(F.col("_n") == n).select("trial_id", "t")


def one_per_time(samples: DataFrame) -> DataFrame:
    """trial_id, t, v: samples at the same time of a trial as one, their mean."""
    return samples.groupBy("trial_id", "t").agg(F.avg("v").alias("v"))


def smoothed(samples: DataFrame, n: int) -> DataFrame:
    """v as the mean of the n samples around each (fewer at the ends), n odd."""
    w = _by_time().rowsBetween(-(n // 2), n // 2)
    return samples.withColumn("v", F.avg("v").over(w))


def interpolated_lookup(left: DataFrame, right: DataFrame) -> DataFrame:
    """left(trial_id, t) with v of right(trial_id, t, v) at that time, linear between its neighbours;
    NULL before the first and after the last. One window over both, as in as_of."""
    known = right.where("v is not null").select("trial_id", "t", F.col("v").cast("double").alias("v"), F.lit(0).alias("side"))
    both = left.select("trial_id", "t", F.lit(None).cast("double").alias("v"), F.lit(1).alias("side")).unionByName(known)
    sample = F.when(F.col("side") == 0, F.struct("t", "v"))
    back = F.last(sample, ignorenulls=True).over(W.partitionBy("trial_id").orderBy("t", "side").rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first(sample, ignorenulls=True).over(W.partitionBy("trial_id").orderBy("t", F.desc("side")).rowsBetween(0, W.unboundedFollowing))
    rows = both.withColumns({"a": back, "b": ahead}).where("side = 1")
    a, b = F.col("a"), F.col("b")
    between = a["v"] + F.coalesce((b["v"] - a["v"]) * (F.col("t") - a["t"]) / F.nullif(b["t"] - a["t"], F.lit(0)), F.lit(0.0))
    return rows.select("trial_id", "t", F.when(a.isNotNull() & b.isNotNull(), between).alias("v"))


def blank_samples(samples: DataFrame, blanks: DataFrame, pad: float = 0.0) -> DataFrame:
    """samples whose v is missing inside closed blanks(trial_id, t0, t1) of their trial, widened by pad."""
    wider = blanks.select("trial_id", (F.col("t0") - pad).alias("t0"), (F.col("t1") + pad).alias("t1"))
    return _covered(samples, wider).withColumn("v", F.when(~F.col("_in"), F.col("v"))).drop("_in")
