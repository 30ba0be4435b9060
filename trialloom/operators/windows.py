"""Alignment: one row for each trial that says which stretch of it is looked at."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.functions.alignment import TRIAL_END, TRIAL_START, Alignment, EventRef, parse


def _times(name: str) -> Column:
    """All times of an event in stored order, as an aggregate over the events of a trial."""
    mine = F.when((F.col("event") == name) & F.col("t").isNotNull() & ~F.isnan("t"), F.struct("occ", "t"))
    return F.transform(F.array_sort(F.collect_list(mine)), lambda x: x["t"])


def _position(text: str, n: Column, default: int | None) -> Column:
    """A 1-based position from n, end or end-n."""
    if not text:
        return F.lit(default) if default else n
    m = re.fullmatch(r"end(?:-(\d+))?", text)
    return n - int(m[1] or 0) if m else F.lit(int(text))


def _pick(ref: EventRef, times: Column) -> Column:
    """Times of ref as an array: one for a plain index, a slice for a range."""
    n = F.size(times)
    if ":" in ref.index:
        first, last = ref.index.split(":")
        a, b = F.greatest(_position(first, n, 1), F.lit(1)), F.least(_position(last, n, None), n)
        part = F.when(b >= a, F.slice(times, a, F.greatest(b - a + 1, F.lit(0)))).otherwise(F.array().cast("array<double>"))
    else:
        at = _position(ref.index, n, 1)
        part = F.when((at >= 1) & (at <= n), F.slice(times, F.greatest(at, F.lit(1)), 1)).otherwise(F.array().cast("array<double>"))
    return F.transform(part, lambda x: x + F.lit(ref.offset))


def align(trials: DataFrame, events: DataFrame, window: str | Alignment, delta: float = 1.0, rounding: bool = True, outside: str = "truncate", min_duration: float = 0.0) -> DataFrame:
    """trial_id, zero, start, stop, start_pad, stop_pad, valid, cause for every trial.

    trials(trial_id, t_start, t_end); events(trial_id, event, occ, t). The events named by the
    window meet their trial in one aggregation. Start and stop fall on the grid of delta
    through zero. outside says what happens to a window that leaves its trial: truncate,
    invalidate or ignore. Padding widens the window and, where truncated, moves it inward.
    """
    return _aligned(trials, events, [window], delta, rounding, outside, min_duration).drop("align_id")


def align_all(trials: DataFrame, events: DataFrame, windows: list[str | Alignment], delta: float = 1.0, rounding: bool = True, outside: str = "truncate", min_duration: float = 0.0) -> DataFrame:
    """Several alignments at once, told apart by align_id, from 0 in their order: the events of all
    of them meet their trial once."""
    return _aligned(trials, events, windows, delta, rounding, outside, min_duration)


def _aligned(trials: DataFrame, events: DataFrame, windows: list[str | Alignment], delta: float, rounding: bool, outside: str, min_duration: float) -> DataFrame:
    specs = [parse(w) if isinstance(w, str) else w for w in windows]
    refs = [r for spec in specs for r in (spec.start, spec.stop, spec.zero, *spec.truncate_after, *spec.truncate_before, *spec.invalidate)]
    mine = {r.name: F.when((F.col("event") == r.name) & ~F.isnan("t"), F.col("t")) for r in refs}
    # the first and the last occurrence are plain aggregates; other indices need the times in order
    sums, plain, listed = [], {}, {}
    for r in refs:
        if r.name in (TRIAL_START, TRIAL_END):
            plain[r.name, r.index] = F.col("t_start" if r.name == TRIAL_START else "t_end")
        elif r.index in ("1", "end") and (r.name, r.index) not in plain:
            rank = F.when(mine[r.name].isNotNull(), F.col("occ"))
            sums.append((F.min_by if r.index == "1" else F.max_by)(mine[r.name], rank).alias(f"e{len(sums)}"))
            plain[r.name, r.index] = F.col(f"e{len(sums) - 1}")
        elif (r.name, r.index) not in plain and r.name not in listed:
            sums.append(_times(r.name).alias(f"e{len(sums)}"))
            listed[r.name] = F.coalesce(F.col(f"e{len(sums) - 1}"), F.array().cast("array<double>"))
    rows = trials.select("trial_id", "t_start", "t_end")
    if sums:
        found = events.where(F.col("event").isin(sorted(mine))).groupBy("trial_id").agg(*sums)
        rows = rows.join(found, "trial_id", "left")

    def many(ref: EventRef) -> Column:
        if (ref.name, ref.index) in plain:
            t = plain[ref.name, ref.index]
            return F.when(t.isNotNull(), F.array(t + F.lit(ref.offset))).otherwise(F.array().cast("array<double>"))
        return _pick(ref, listed[ref.name])

    def one(ref: EventRef) -> Column:
        if (ref.name, ref.index) in plain:
            return plain[ref.name, ref.index] + F.lit(ref.offset)
        return F.get(_pick(ref, listed[ref.name]), F.lit(0))

    out = []
    for i, spec in enumerate(specs):
        rows = _bounds(rows, spec, f"_{i}", one, many, delta, rounding, outside, min_duration)
        valid = F.col(f"cause_{i}").isNull()
        times = [F.when(valid, F.col(f"{c}_{i}")).alias(c) for c in ("zero", "start", "stop", "start_pad", "stop_pad")]
        out.append(F.struct(F.lit(i).alias("align_id"), *times, valid.alias("valid"), F.col(f"cause_{i}").alias("cause")))
    if len(out) == 1:
        return rows.select("trial_id", out[0].alias("a")).select("trial_id", "a.*")
    return rows.select("trial_id", F.explode(F.array(*out)).alias("a")).select("trial_id", "a.*")


def _bounds(rows: DataFrame, spec: Alignment, suffix: str, one, many, delta: float, rounding: bool, outside: str, min_duration: float) -> DataFrame:
    """rows with zero, start, stop, start_pad, stop_pad and cause of one alignment, names with a suffix."""
    zero, start, stop, start_pad, stop_pad, cause = (f"{n}{suffix}" for n in ("zero", "start", "stop", "start_pad", "stop_pad", "cause"))

    def snap(x: Column) -> Column:
        return F.round((x - F.col(zero)) / delta) * delta + F.col(zero) if rounding else x

    pre, post = F.lit(spec.pre), F.lit(spec.post)
    rows = rows.withColumn(zero, one(spec.zero)).withColumns({start_pad: snap(one(spec.start)) - pre, stop_pad: snap(one(spec.stop)) + post})
    for ref in spec.truncate_after:
        rows = rows.withColumn(stop_pad, F.least(stop_pad, F.array_min(F.filter(many(ref), lambda x: x >= F.col(start_pad)))))
    for ref in spec.truncate_before:
        rows = rows.withColumn(start_pad, F.greatest(start_pad, F.array_max(F.filter(many(ref), lambda x: x <= F.col(stop_pad)))))
    causes = [
        (F.col(zero).isNull(), "missing zero event"),
        (F.col(start_pad).isNull(), "missing start event"),
        (F.col(stop_pad).isNull(), "missing stop event"),
        (F.col(start_pad) + pre > F.col(stop_pad) - post, "start after stop"),
    ]
    for ref in spec.invalidate:
        hit = F.exists(many(ref), lambda x: (x >= F.col(start_pad)) & (x <= F.col(stop_pad)))
        causes.append((hit, f"overlaps {ref.name}"))
    off = (F.col(start_pad) < F.col("t_start")) | (F.col(stop_pad) > F.col("t_end"))
    if outside == "invalidate":
        causes.append((off, "outside trial"))
    rows = rows.withColumn(cause, F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(text)) for c, text in causes]))
    if outside == "truncate":
        rows = rows.withColumns({start_pad: F.greatest(start_pad, "t_start"), stop_pad: F.least(stop_pad, "t_end")})
    rows = rows.withColumns({start: F.col(start_pad) + pre, stop: F.col(stop_pad) - post})
    late = F.when(F.col(start) > F.col(stop), "outside trial").when(F.col(stop) - F.col(start) < min_duration, "too short")
    return rows.withColumn(cause, F.coalesce(cause, late))


def marks(trials: DataFrame, events: DataFrame, aligned: DataFrame, event: str) -> DataFrame:
    """trial_id, occ, t of the event's occurrences inside each valid window, relative to zero."""
    inside = events.where(F.col("event") == event).join(aligned.where("valid"), "trial_id").where("t >= start and t <= stop")
    return inside.select("trial_id", "occ", (F.col("t") - F.col("zero")).alias("t"))


def in_window(points: DataFrame, aligned: DataFrame, tolerance: float = 0.0, padded: bool = False, delta: float | None = None) -> DataFrame:
    """points(trial_id, t, ...) inside the closed window of their trial, t relative to zero.

    The join is on trial_id with the range as a condition on top; a trial has one window (for
    each align_id, which is kept). With delta a window that is a point, start = stop, takes the
    sample nearest to it within two deltas, of two as near the earlier one.
    """
    lo, hi = ("start_pad", "stop_pad") if padded else ("start", "stop")
    which = ["align_id"] if "align_id" in aligned.columns else []
    joined = points.join(aligned.where("valid").select("trial_id", *which, "zero", lo, hi), "trial_id")
    inside = (F.col("t") >= F.col(lo) - tolerance) & (F.col("t") <= F.col(hi) + tolerance)
    if delta is not None:
        off = F.abs(F.col("t") - F.col(lo))
        near = F.when((F.col(lo) == F.col(hi)) & (off <= 2 * delta), F.struct(off.alias("d"), F.col("t").alias("t")))
        joined = joined.withColumn("_near", F.min(near).over(W.partitionBy("trial_id", *which)))
        inside = F.when(F.col(lo) == F.col(hi), F.col("t") == F.col("_near.t")).otherwise(inside)
        return joined.where(inside).withColumn("t", F.col("t") - F.col("zero")).drop("zero", lo, hi, "_near")
    return joined.where(inside).withColumn("t", F.col("t") - F.col("zero")).drop("zero", lo, hi)


def nearest_sample(samples: DataFrame, aligned: DataFrame) -> DataFrame:
    """trial_id, t, v of the sample closest to zero in each valid trial; ties take the first."""
    joined = samples.join(aligned.where("valid").select("trial_id", "zero"), "trial_id").where("v is not null")
    best = F.min(F.struct(F.abs(F.col("t") - F.col("zero")).alias("d"), F.col("t").alias("t"), F.col("v").alias("v")))
    return joined.groupBy("trial_id").agg(best.alias("b"), F.first("zero").alias("zero")).select("trial_id", (F.col("b.t") - F.col("zero")).alias("t"), "b.v")


def trim(samples: DataFrame, aligned: DataFrame) -> DataFrame:
    """samples inside the window of their trial, times as they were: what lies outside is gone for good."""
    joined = samples.join(aligned.where("valid").select("trial_id", "start", "stop"), "trial_id")
    return joined.where("t >= start and t <= stop").drop("start", "stop")


def mark_intervals(intervals: DataFrame, aligned: DataFrame) -> DataFrame:
    """trial_id, t0, t1 of the intervals that meet their trial's window, cut to it, relative to zero."""
    joined = intervals.join(aligned.where("valid").select("trial_id", "zero", "start", "stop"), "trial_id").where("t0 <= stop and t1 >= start")
    return joined.select("trial_id", (F.greatest("t0", "start") - F.col("zero")).alias("t0"), (F.least("t1", "stop") - F.col("zero")).alias("t1"))


def distributions(aligned: DataFrame, groups: DataFrame, found: DataFrame | None = None, intervals: DataFrame | None = None) -> DataFrame:
    """kind, cond, n, s, s2, low, high: by condition, and over all with cond missing, how windows start and
    stop relative to zero, where marks lie and when intervals begin and how long they are.

    found(trial_id, t) is as of marks(), intervals(trial_id, t0, t1) as of mark_intervals(). Sums and
    extremes, so that sessions merge (merged_distributions).
    """
    found_in = groups.select("trial_id", "cond")

    def part(df: DataFrame, **kinds: Column) -> DataFrame:  # joined before the union, whose rows have lost their order by trial
        each = [F.struct(F.lit(k.replace("_", " ")).alias("kind"), x.alias("x")) for k, x in kinds.items()]
        return df.join(found_in, "trial_id").select("cond", F.inline(F.array(*each)))

    parts = [part(aligned.where("valid"), start=F.col("start") - F.col("zero"), stop=F.col("stop") - F.col("zero"))]
    if found is not None:
        parts.append(part(found, mark=F.col("t")))
    if intervals is not None:
        parts.append(part(intervals, interval_start=F.col("t0"), interval_length=F.col("t1") - F.col("t0")))
    rows = reduce(DataFrame.unionByName, parts).where("x is not null")
    x = F.col("x")
    sums = [F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(x * x).alias("s2"), F.min("x").alias("low"), F.max("x").alias("high")]
    return rows.groupingSets([["kind", "cond"], ["kind"]], "kind", "cond").agg(*sums)


def merged_distributions(parts: list[DataFrame]) -> DataFrame:
    """kind, cond, n, mean, std, low, high of the distributions of several sessions together."""
    all_ = reduce(DataFrame.unionByName, parts).groupBy("kind", "cond")
    sums = all_.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"), F.min("low").alias("low"), F.max("high").alias("high"))
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("s2") - F.col("n") * mean * mean, F.col("n") - 1)))
    return sums.select("kind", "cond", "n", mean.alias("mean"), std.alias("std"), "low", "high")
