"""How a population moves in time: rotations of its state, and a linear Gaussian decoder of states.

States are rows with arrays. Tasks add up products of arrays for themselves, so the driver
sees matrices as large as the arrays are long, squared, and never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.operators.timecourse import matrix


def moments(df: DataFrame, left: str, right: str, by: str | None = None) -> dict:
    """Of each value of by (None without) the sum over rows of left[i] * right[j], as a matrix.

    Rows whose arrays are missing, or hold a missing value, are left out.
    """
    whole = F.col(left).isNotNull() & F.col(right).isNotNull() & ~F.exists(left, lambda x: x.isNull()) & ~F.exists(right, lambda x: x.isNull())
    rows = df.where(whole).select((F.col(by) if by else F.lit(0)).cast("string").alias("k"), F.col(left).cast("array<double>").alias("a"), F.col(right).cast("array<double>").alias("b"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for k, part in frame.groupby("k"):
                found = np.stack(part["a"].to_numpy()).T @ np.stack(part["b"].to_numpy())
                sums[k] = sums[k] + found if k in sums else found
        for k, m in sums.items():
            i, j = np.indices(m.shape).reshape(2, -1)
            yield pd.DataFrame({"k": k, "i": i, "j": j, "s": m.ravel()})

    added = rows.mapInPandas(run, "k string, i int, j int, s double").groupBy("k", "i", "j").agg(F.sum("s").alias("s")).collect()
    out: dict[str, np.ndarray] = {}
    shape = (1 + max((r.i for r in added), default=-1), 1 + max((r.j for r in added), default=-1))
    for r in added:
        out.setdefault(r.k, np.zeros(shape))[r.i, r.j] = r.s
    return out if by else out.get("0", np.zeros(shape))


def states_in_time(cube: DataFrame, bases: list[str], centre: bool = True) -> DataFrame:
    """cond, bin, x, dx: the state of the population as an array over bases, and how it changes to
    the next bin (missing at the last); times at which a basis has no mean are left out.

    centre takes the mean over conditions at each time off, so that what all conditions do
    alike is no movement.
    """
    rows = matrix(cube, bases).dropna(subset=bases).select("cond", "bin", *[F.col(b).cast("double").alias(b) for b in bases])
    if centre:
        rows = rows.withColumns({b: F.col(b) - F.avg(b).over(W.partitionBy("bin")) for b in bases})
    rows = rows.select("cond", "bin", F.array(*bases).alias("x"))
    in_time = W.partitionBy("cond").orderBy("bin")
    later = rows.withColumn("_next", F.when(F.lead("bin").over(in_time) == F.col("bin") + 1, F.lead("x").over(in_time)))
    change = F.when(F.col("_next").isNotNull(), F.zip_with("_next", "x", lambda a, b: a - b))
    return later.select("cond", "bin", "x", change.alias("dx"))


def skew_fit(s: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The M with M = -M' for which the rows of dX are nearest to those of X M, by s = X'X and d = X'dX.

    Where the change of M vanishes, s M + M s = d - d'. In the directions of s this falls
    apart into one equation an entry.
    """
    value, u = np.linalg.eigh(s)
    right = u.T @ (d - d.T) @ u
    both = value[:, None] + value[None, :]
    m = np.divide(right, both, out=np.zeros_like(right), where=both > 1e-12 * max(1e-300, value.max()))
    return u @ m @ u.T


def rotation_planes(m: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns that span the planes in which m turns, fastest first, frequency of each).

    A plane's first axis is that of its larger variance under s, its largest weight is positive,
    and m turns it towards the second. Directions that do not turn come last, at frequency 0.
    """
    value, vector = np.linalg.eig(m)
    turning = sorted((i for i in range(len(value)) if value[i].imag > 1e-10), key=lambda i: -value[i].imag)
    columns, speed = [], []
    for i in turning:
        plane, _ = np.linalg.qr(np.stack([vector[:, i].real, vector[:, i].imag], axis=1))
        _, turn = np.linalg.eigh(plane.T @ s @ plane)
        first, second = (plane @ turn[:, ::-1]).T
        first = first * np.sign(first[np.abs(first).argmax()])
        if first @ m @ second < 0:  # rows move as x m
            second = -second
        columns += [first, second]
        speed += [value[i].imag] * 2
    rest = len(m) - len(columns)
    if rest:
        turned = np.stack(columns, axis=1) if columns else np.zeros((len(m), 0))
        left = np.linalg.svd(np.eye(len(m)) - turned @ turned.T)[0][:, :rest]
        columns += [c * np.sign(c[np.abs(c).argmax()]) for c in left.T]
        speed += [0.0] * rest
    return np.stack(columns, axis=1), np.array(speed)


def rotational_weights(states: DataFrame, bases: list[str], k: int = 6) -> tuple[DataFrame, DataFrame]:
    """(weights(basis, dimension, w, frequency), generator(i, j, m)) of states_in_time().

    The states' k directions of largest variance are kept; in them the movement from bin to bin is
    fitted by a pure rotation. Pairs of dimensions are its planes, fastest first; frequency
    is in radians a bin. generator is the fitted rotation between bases.
    """
    both = moments(states.where("dx is not null").withColumn("both", F.concat("x", "dx")), "x", "both")  # one pass for X'X and X'dX
    if not len(both):
        raise ValueError("no two times in a row at which all bases have a value")
    s, d = both[:, : len(bases)], both[:, len(bases) :]
    value, vector = np.linalg.eigh(s)
    v = vector[:, np.argsort(-value)[: min(k, len(bases))]]
    m = skew_fit(v.T @ s @ v, v.T @ d @ v)
    planes, speed = rotation_planes(m, v.T @ s @ v)
    w, whole = v @ planes, v @ m @ v.T
    spark = states.sparkSession
    weights = [(b, int(j), float(w[i, j]), float(speed[j])) for i, b in enumerate(bases) for j in range(w.shape[1])]
    turns = [(a, b, float(whole[i, j])) for i, a in enumerate(bases) for j, b in enumerate(bases)]
    return spark.createDataFrame(weights, "basis string, dimension int, w double, frequency double"), spark.createDataFrame(turns, "i string, j string, m double")


def along(states: DataFrame, weights: DataFrame, bases: list[str]) -> DataFrame:
    """cond, bin, dimension, score: states along the directions of weights(basis, dimension, w)."""
    columns = {r.dimension: r.w for r in weights.groupBy("dimension").agg(F.map_from_entries(F.collect_list(F.struct("basis", "w"))).alias("w")).collect()}  # a row a dimension
    scores = [F.struct(F.lit(d).alias("dimension"), F.aggregate(F.zip_with("x", F.array(*[F.lit(w[b]) for b in bases]), lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y).alias("score")) for d, w in sorted(columns.items())]
    return states.select("cond", "bin", F.inline(F.array(*scores)))


@dataclass(frozen=True)
class StateDecoder:
    """A state that moves by a and w (how, and with what covariance) and is seen through h and q."""

    a: np.ndarray
    w: np.ndarray
    h: np.ndarray
    q: np.ndarray

    def gains(self, steps: int) -> list[np.ndarray]:
        """What share of a surprise goes into the state at each step, from a state known exactly."""
        p, out = np.zeros_like(self.a), []
        for _ in range(steps):
            ahead = self.a @ p @ self.a.T + self.w
            gain = np.linalg.solve((self.h @ ahead @ self.h.T + self.q).T, (ahead @ self.h.T).T).T
            p = (np.eye(len(self.a)) - gain @ self.h) @ ahead
            out.append(gain)
        return out


def fit_decoder(series: DataFrame, scale: float = 1.0) -> StateDecoder:
    """The decoder of series(trial_id, bin, x, z): states x and observations z as arrays, all of them
    known. Least squares by sums over rows; scale divides the covariance of the movement, so
    more of it trusts the observations less."""
    w = W.partitionBy("trial_id").orderBy("bin")
    later = F.when(F.lead("bin").over(w) == F.col("bin") + 1, F.lead("x").over(w))
    rows = series.select("x", "z", later.alias("next"))
    one = F.array(F.lit(1.0))
    # products of all that a row holds; a missing next state counts as 0 and is told by the second one
    known = F.col("next").isNotNull()
    zeros = F.transform("x", lambda v: F.lit(0.0))
    row = F.concat("x", "z", F.coalesce("next", zeros), F.when(known, F.col("x")).otherwise(zeros), one, F.array(known.cast("double")))
    k = len(series.select("x").first().x)
    m = moments(rows.select(row.alias("v")), "v", "v")
    n, n1 = m[-2, -2], m[-1, -1]
    seen, step = slice(k, len(m) - 2 * k - 2), slice(len(m) - 2 * k - 2, len(m) - k - 2)
    before = slice(len(m) - k - 2, len(m) - 2)
    xx, zx, zz = m[:k, :k], m[seen, :k], m[seen, seen]
    x1, x21, x2 = m[before, before], m[step, before], m[step, step]
    a = np.linalg.solve(x1.T, x21.T).T
    h = np.linalg.solve(xx.T, zx.T).T
    return StateDecoder(a, (x2 - a @ x21.T - x21 @ a.T + a @ x1 @ a.T) / n1 / scale, h, (zz - h @ zx.T - zx @ h.T + h @ xx @ h.T) / n)


def decode(series: DataFrame, decoder: StateDecoder, start: Column | None = None) -> DataFrame:
    """trial_id, bin, estimate: each trial's states from its observations z and its first state.

    The first bin's estimate is start (x, unless given); each later one moves on and is corrected by
    what is seen then. Bins follow one another as the rows do. A trial's rows are one array, and
    the trials of a batch take each step together.
    """
    first = F.coalesce(start, F.col("x")) if start is not None else F.col("x")
    rows = series.select("trial_id", F.struct(F.col("bin").cast("long").alias("bin"), F.col("z").cast("array<double>").alias("z"), first.cast("array<double>").alias("x")).alias("s"))
    trials = rows.groupBy("trial_id").agg(F.array_sort(F.collect_list("s")).alias("s")).select("trial_id", F.col("s.bin").alias("bin"), F.col("s.z").alias("z"), F.col("s.x")[0].alias("x"))
    kind = series.schema["trial_id"].dataType.simpleString()
    a, h = decoder.a, decoder.h

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gains: list[np.ndarray] = []
        for frame in frames:
            order = np.argsort([-len(b) for b in frame["bin"]], kind="stable")  # those that go on the longest come first
            frame = frame.iloc[order]
            lengths = np.array([len(b) for b in frame["bin"]])
            if not len(lengths):
                continue
            if len(gains) < lengths[0]:
                gains = decoder.gains(int(lengths[0]))
            state = np.stack(frame["x"].to_numpy()).astype(float)
            out = [[x] for x in state]
            for t in range(1, int(lengths[0])):
                n = int((lengths > t).sum())
                z = np.stack([row[t] for row in frame["z"].iloc[:n]]).astype(float)
                ahead = state[:n] @ a.T
                state = ahead + (z - ahead @ h.T) @ gains[t - 1].T
                for i in range(n):
                    out[i].append(state[i])
            yield pd.DataFrame({"trial_id": frame["trial_id"], "bin": frame["bin"], "estimate": [[e.tolist() for e in o] for o in out]})

    found = trials.mapInPandas(run, f"trial_id {kind}, bin array<bigint>, estimate array<array<double>>")
    return found.select("trial_id", F.explode(F.arrays_zip("bin", "estimate")).alias("s")).select("trial_id", "s.bin", "s.estimate")
