"""Contrasts between conditions along axes of a cube."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def consecutive(cells: DataFrame, axis: str, by: list[str], value: str) -> DataFrame:
    """step: value less the one before along the axis."""
    return cells.withColumn("step", F.col(value) - F.lag(value).over(W.partitionBy(*by).orderBy(axis)))


def subtract_mean(cells: DataFrame, by: list[str], value: str) -> DataFrame:
    """centred: value less the unweighted mean over the conditions along the axis."""
    return cells.withColumn("centred", F.col(value) - F.avg(value).over(W.partitionBy(*by)))


def difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """diff and sem of two condition series (mean, sem) on the union of their grids."""
    x = a.select(*on, F.col("mean").alias("ma"), F.col("sem").alias("sa"))
    y = b.select(*on, F.col("mean").alias("mb"), F.col("sem").alias("sb"))
    return x.join(y, on, "full").select(*on, (F.col("ma") - F.col("mb")).alias("diff"), F.sqrt(F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb")).alias("sem"))


def marginalise(cells: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """main_a, main_b and interaction: averages over cells, by inclusion and exclusion."""
    over = lambda *by: F.avg(value).over(W.partitionBy(*by))
    total = cells.agg(F.avg(value).alias("_all"))
    rows = cells.withColumns({"_a": over(a), "_b": over(b)}).crossJoin(F.broadcast(total))  # one row
    return rows.select(
        a,
        b,
        (F.col("_a") - F.col("_all")).alias("main_a"),
        (F.col("_b") - F.col("_all")).alias("main_b"),
        (F.col(value) - F.col("_a") - F.col("_b") + F.col("_all")).alias("interaction"),
    )


def linear_fit(df: DataFrame, x: str, y: str, by: list[str], ridge: float = 0.0) -> DataFrame:
    """slope and intercept of y on x in each group; ridge shrinks the slope (added to the variance)."""
    slope = F.try_divide(F.covar_pop(x, y), F.var_pop(x) + ridge)
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"))


def compare(df: DataFrame, by: list[str], cond: str, one: object, two: object, value: str, z: float = 1.959963984540054) -> DataFrame:
    """*by, diff, low, high, hedges_g of two conditions: the difference of means with its interval
    (z errors by Welch to both sides) and in pooled deviations, corrected for small samples."""
    side = lambda v: F.when(F.col(cond) == v, F.col(value))
    parts = {f"{n}{i}": f(side(v)) for i, v in enumerate((one, two)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))}
    r = df.groupBy(*by).agg(*[x.alias(n) for n, x in parts.items()]).where("n0 > 1 and n1 > 1")
    diff, free = F.col("m0") - F.col("m1"), F.col("n0") + F.col("n1") - 2
    error = F.sqrt(F.col("v0") / F.col("n0") + F.col("v1") / F.col("n1"))
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / free)
    g = F.try_divide(diff, pooled) * (1 - 3 / (4 * free - 1))
    return r.select(*by, diff.alias("diff"), (diff - z * error).alias("low"), (diff + z * error).alias("high"), g.alias("hedges_g"))


def cross_validated_ridge(df: DataFrame, fold: Column, xs: list[str], y: str, ridges: list[float], folds: int) -> DataFrame:
    """ridge, error: for each ridge the mean squared error of rows that the fit has not seen.

    One aggregation gives the moments of each fold; fits and errors follow from sums of
    those, matrices of as many rows as there are xs and two.
    """
    import numpy as np

    names = [F.lit(1.0), *[F.col(x).cast("double") for x in xs], F.col(y).cast("double")]
    k = len(names)
    sums = [F.sum(names[i] * names[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
    rows = df.groupBy(fold.alias("fold")).agg(*sums).collect()  # a row for each fold
    moment = {r["fold"]: np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) for r in rows}
    total, out = sum(moment.values()), []
    for ridge in ridges:
        error = 0.0
        for m in moment.values():
            seen = total - m
            penalty = np.diag([0.0] + [ridge] * len(xs))
            w = np.append(np.linalg.solve(seen[:-1, :-1] + penalty, seen[:-1, -1]), -1.0)
            error += float(w @ m @ w)
        out.append((float(ridge), float(error / total[0, 0])))
    return df.sparkSession.createDataFrame(out, "ridge double, error double")


def effects(cells: DataFrame, axes: list[str], value: str, by: list[str] | None = None) -> DataFrame:
    """*by, *axes, term, effect: what each set of axes adds in each cell beyond its subsets.

    Means over cells, by inclusion and exclusion: the effect of a set is the sum over its
    subsets of the mean that keeps those axes, with alternating signs. term joins the
    set's axes with ":". The effects of a cell add up to its value less the mean of all.
    """
    by = by or []
    subsets = [s for n in range(len(axes) + 1) for s in combinations(axes, n)]
    rows = cells
    for i, s in enumerate(subsets):
        keys = [*by, *s] or [F.lit(0)]
        rows = rows.withColumn(f"_m{i}", F.avg(value).over(W.partitionBy(*keys)) if by or s else F.lit(None).cast("double"))
    if not by:  # one mean of all cells, which needs no window
        total = cells.agg(F.avg(value).alias("_all"))
        rows = rows.crossJoin(total).withColumn("_m0", F.col("_all"))
    terms = []
    for s in subsets[1:]:
        parts = [(-1) ** (len(s) - len(t)) * F.col(f"_m{i}") for i, t in enumerate(subsets) if set(t) <= set(s)]
        terms.append(F.struct(F.lit(":".join(s)).alias("term"), sum(parts[1:], parts[0]).alias("effect")))
    return rows.select(*by, *axes, F.inline(F.array(*terms)))


def variance_by_term(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """*by, term, variance, share: mean squares of effects() and their part of all terms' sum."""
    by = by or []
    v = found.groupBy(*by, "term").agg((F.avg(F.col("effect") * F.col("effect"))).alias("variance"))
    if by:
        return v.withColumn("share", F.try_divide("variance", F.sum("variance").over(W.partitionBy(*by))))
    return v.crossJoin(v.agg(F.sum("variance").alias("_t"))).withColumn("share", F.try_divide("variance", "_t")).drop("_t")
