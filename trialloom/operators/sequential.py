"""Operators that need the samples of one trial in order: recursive filters, snippets.

A trial bounds what one task holds; trials spread over tasks by trial_id.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Samples that a filter takes at once.
BLOCK = 128


@functools.lru_cache(maxsize=16)
def _block_response(a: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """What a block of y[n] + a1 y[n-1] + ... = u[n] adds up to: (from its u, from the outputs before)."""
    m = len(a) - 1
    def free(u: np.ndarray, past: np.ndarray) -> np.ndarray:
        y = np.concatenate([past[::-1], np.zeros(BLOCK)])
        for i in range(BLOCK):
            y[m + i] = u[i] - np.dot(a[1:], y[i : m + i][::-1])
        return y[m:]

    h = free(np.eye(1, BLOCK)[0], np.zeros(m))
    index = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    ahead = np.where(index >= 0, h[np.abs(index)], 0.0)
    return ahead, np.stack([free(np.zeros(BLOCK), e) for e in np.eye(m)], axis=1) if m else np.zeros((BLOCK, 0))


def recurse(b: list[float], a: list[float], x: np.ndarray, settled: bool) -> np.ndarray:
    """y[n] = sum b x - sum a y; settled starts as if the first sample had stood forever.

    The samples go block by block: a block's outputs are a product of its inputs with the
    filter's response, and of the outputs before it with theirs.
    """
    b, a = np.asarray(b, dtype=float) / a[0], np.asarray(a, dtype=float) / a[0]
    if not len(x):
        return np.zeros(0)
    first = float(x[0]) if settled else 0.0
    m = len(a) - 1
    u = np.convolve(np.concatenate([np.full(len(b) - 1, first), x]), b)[len(b) - 1 : len(b) - 1 + len(x)]
    past = np.full(m, b.sum() / a.sum() * first if settled else 0.0)  # the latest output comes first
    ahead, before = _block_response(tuple(a))
    out = np.empty(len(x))
    for at in range(0, len(x), BLOCK):
        n = min(BLOCK, len(x) - at)
        out[at : at + n] = ahead[:n, :n] @ u[at : at + n] + before[:n] @ past
        past = np.concatenate([out[at : at + n][::-1], past])[:m]
    return out


def _by_trial(samples: DataFrame) -> DataFrame:
    """trial_id, ts, vs: the samples of each trial as arrays in order of time."""
    rows = samples.groupBy("trial_id").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("s"))
    return rows.select("trial_id", F.col("s.t").alias("ts"), F.col("s.v").alias("vs"))


def filter_series(samples: DataFrame, b: list[float], a: list[float], settled: bool = True, both_ways: bool = False) -> DataFrame:
    """trial_id, t, y: a recursive filter along each trial; missing samples are passed over.

    both_ways runs it forward and backward, which removes the phase shift.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for vs in frame["vs"]:
                v = np.array([np.nan if x is None else x for x in vs], dtype=float)
                known = ~np.isnan(v)
                y = np.full(len(v), np.nan)
                if known.any():
                    x = recurse(b, a, v[known], settled)
                    y[known] = recurse(b, a, x[::-1], settled)[::-1] if both_ways else x
                out.append(y)
            yield pd.DataFrame({"trial_id": frame["trial_id"], "ts": frame["ts"], "ys": out})

    filtered = _by_trial(samples).mapInPandas(run, "trial_id long, ts array<double>, ys array<double>")
    return filtered.select("trial_id", F.explode(F.arrays_zip("ts", "ys")).alias("s")).select("trial_id", F.col("s.ts").alias("t"), F.nanvl("s.ys", F.lit(None)).alias("y"))


#: Samples of one row where a trial is cut into blocks.
LONG = 1 << 16


def filter_long_series(samples: DataFrame, b: list[float], a: list[float], settled: bool = True, both_ways: bool = False, block: int = LONG) -> DataFrame:
    """trial_id, t, y: filter_series for trials of any length, times of a trial being distinct.

    A trial's known samples are numbered without ordering it in one task and cut into blocks, which are
    filtered as if nothing had been before them. What was before adds to a block's outputs by the
    filter's last outputs alone: these follow from block to block by a small product, so only they,
    a few numbers a block, are gone through in order. Missing samples have no row.
    """
    from trialloom.operators.ranking import numbered
    from trialloom.sources.tables import written

    out = samples.where("v is not null and not isnan(v)").select("trial_id", F.col("t").cast("double").alias("t"), F.col("v").cast("double").alias("v"))
    for order in ("t", "-t") if both_ways else ("t",):
        out = _filtered_blocks(written(numbered(out, ["trial_id"], order)), b, a, settled, block).withColumnRenamed("y", "v")
    return out.withColumnRenamed("v", "y")


def _filtered_blocks(rows: DataFrame, b: list[float], a: list[float], settled: bool, block: int) -> DataFrame:
    """trial_id, t, y of rows(trial_id, i, t, v), i counting the samples of a trial from 0."""
    from trialloom.sources.tables import written

    kind = rows.schema["trial_id"].dataType.simpleString()
    nb, na = np.asarray(b, dtype=float) / a[0], np.asarray(a, dtype=float) / a[0]
    m, reach = len(na) - 1, len(nb) - 1
    k = F.floor(F.col("i") / block)
    own = F.struct(k.alias("k"), (F.col("i") - k * block).alias("p"))
    # the last samples of a block count for the next one's inputs too
    also = F.struct((k + 1).alias("k"), (F.col("i") - (k + 1) * block).alias("p"))
    dealt = rows.select("trial_id", "t", "v", F.explode(F.when(F.col("i") - k * block >= block - reach, F.array(own, also)).otherwise(F.array(own))).alias("at"))
    cut = dealt.groupBy("trial_id", "at.k").agg(F.array_sort(F.collect_list(F.struct("at.p", "t", "v"))).alias("s"))

    def alone(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ts, ys, ends, firsts = [], [], [], []
            for block_, entries in zip(frame["k"], frame["s"], strict=True):
                place, v = np.array([e["p"] for e in entries]), np.array([e["v"] for e in entries])
                mine, x = place >= 0, v
                if block_ == 0:
                    x = np.concatenate([np.full(reach, v[0] if settled else 0.0), v])
                u = np.convolve(x, nb)[reach : len(x)] if mine.any() else np.zeros(0)
                y = recurse([1.0], na.tolist(), u, False)
                ts.append(np.array([e["t"] for e in entries])[mine])
                ys.append(y)
                ends.append(y[::-1][:m])  # the latest comes first
                firsts.append(float(v[0]) if block_ == 0 and settled else 0.0)
            yield pd.DataFrame({"trial_id": frame["trial_id"], "k": frame["k"], "ts": ts, "ys": ys, "end": ends, "first": firsts})

    blocks = written(cut.mapInPandas(alone, f"trial_id {kind}, k bigint, ts array<double>, ys array<double>, end array<double>, first double").where(F.size("ts") > 0))
    heads = blocks.groupBy("trial_id").agg(F.array_sort(F.collect_list(F.struct("k", "end", "first"))).alias("s"))

    def before(n: int) -> np.ndarray:
        """What n outputs are by each of the m outputs before them."""
        out = np.zeros((n, m))
        for j, e in enumerate(np.eye(m)):
            past = list(e)
            for i in range(n):
                y = -float(np.dot(na[1:], past))
                out[i, j] = y
                past = [y, *past[:-1]]
        return out

    def carried(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ahead = before(block)[::-1][:m] if m else np.zeros((0, 0))
        for frame in frames:
            ids, ks, pasts = [], [], []
            for trial, entries in zip(frame["trial_id"], frame["s"], strict=True):
                past = np.full(m, nb.sum() / na.sum() * entries[0]["first"])
                for e in entries:
                    ids.append(trial)
                    ks.append(e["k"])
                    pasts.append(past)
                    if len(e["end"]) == m:  # all blocks but perhaps the last, which nothing follows
                        past = np.asarray(e["end"]) + ahead @ past
            yield pd.DataFrame({"trial_id": ids, "k": ks, "past": pasts})

    pasts = heads.mapInPandas(carried, f"trial_id {kind}, k bigint, past array<double>")

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        response = before(block) if m else np.zeros((block, 0))
        for frame in frames:
            ys = [np.asarray(y) + response[: len(y)] @ np.asarray(p) for y, p in zip(frame["ys"], frame["past"], strict=True)]
            yield pd.DataFrame({"trial_id": frame["trial_id"], "ts": frame["ts"], "ys": ys})

    done = blocks.select("trial_id", "k", "ts", "ys").join(pasts, ["trial_id", "k"]).select("trial_id", "ts", "ys", "past").mapInPandas(whole, f"trial_id {kind}, ts array<double>, ys array<double>")
    return done.select("trial_id", F.explode(F.arrays_zip("ts", "ys")).alias("s")).select("trial_id", F.col("s.ts").alias("t"), F.col("s.ys").alias("y"))


def snippets(samples: DataFrame, threshold: float, before: int, after: int, refractory: int) -> DataFrame:
    """trial_id, t, wave: samples around each crossing, from left to right; a crossing within
    refractory samples of the last kept one, or without room for its snippet, is left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for trial, ts, vs in zip(frame["trial_id"], frame["ts"], frame["vs"], strict=True):
                v, last = np.asarray(vs, dtype=float), -np.inf
                beyond = v <= threshold if threshold < 0 else v >= threshold
                for i in np.flatnonzero(~beyond[:-1] & beyond[1:]):
                    if i - last >= refractory and i - before >= 0 and i + after <= len(v):
                        rows.append((trial, ts[i], v[i - before : i + after]))
                        last = i
            yield pd.DataFrame(rows, columns=["trial_id", "t", "wave"])

    return _by_trial(samples).mapInPandas(run, "trial_id long, t double, wave array<double>")


def largest_snippets(samples: DataFrame, threshold: float, before: int, after: int, refractory: int) -> DataFrame:
    """trial_id, t, height, wave: samples around the peaks beyond a threshold, the highest first.

    A peak is the extreme sample of each stretch beyond the threshold (of equal ones the
    first). From the highest down, a peak is left out if one that was kept lies within less
    than refractory samples (of equal heights the earlier counts as higher). Peaks without
    room for their snippet, before samples ahead and after from the peak on, are left out first.

    Peaks further apart than refractory never meet, so trials fall into stretches of near
    peaks, and only these are gone through in order.
    """
    w = W.partitionBy("trial_id").orderBy("t")
    every = samples.select("trial_id", "t", F.col("v").cast("double").alias("v"))
    rows = every.withColumns({
        "i": F.row_number().over(w), "n": F.count("*").over(W.partitionBy("trial_id")),
        "wave": F.collect_list("v").over(w.rowsBetween(-before, after - 1)),
        "on": F.coalesce(F.col("v") <= threshold if threshold < 0 else F.col("v") >= threshold, F.lit(False)),
    })
    begins = F.col("on") & ~F.coalesce(F.lag("on").over(w), F.lit(False))
    runs = rows.withColumn("run", F.sum(begins.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("on")
    height = -F.col("v") if threshold < 0 else F.col("v")
    first = F.max(F.struct(height.alias("height"), (-F.col("i")).alias("back"), "t", "wave", "n"))
    peaks = runs.groupBy("trial_id", "run").agg(first.alias("p")).select("trial_id", "p.height", (-F.col("p.back")).alias("i"), "p.t", "p.wave", "p.n")
    peaks = peaks.where((F.col("i") > before) & (F.col("i") + after - 1 <= F.col("n")))
    apart = F.coalesce(F.col("i") - F.lag("i").over(W.partitionBy("trial_id").orderBy("i")) >= refractory, F.lit(True))
    stretches = peaks.withColumn("far", apart.cast("int")).withColumn("part", F.sum("far").over(W.partitionBy("trial_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    entry = F.struct((-F.col("height")).alias("low"), "i", "t", "height", "wave")
    near = stretches.groupBy("trial_id", "part").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    none = F.filter("all", lambda x: F.lit(False))
    kept = F.aggregate("all", none, lambda k, x: F.when(F.exists(k, lambda y: F.abs(y["i"] - x["i"]) < refractory), k).otherwise(F.array_append(k, x)))
    return near.select("trial_id", F.explode(kept).alias("k")).select("trial_id", "k.t", F.when(F.lit(threshold < 0), -F.col("k.height")).otherwise(F.col("k.height")).alias("height"), "k.wave")
