"""Population cubes (basis, cond, mean, sem, n) and linear maps over them.

Cubes have one row for each basis and condition. Linear algebra on the driver only ever
sees a matrix of bases x bases, built as an aggregation; projections are joins with a
table of weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.functions.stats import mean_sem


def population(df: DataFrame, cond: str, values: str) -> DataFrame:
    """A cube from rows with an array of one value for each basis."""
    long = df.select(F.col(cond).alias("cond"), F.posexplode(values).alias("basis", "v")).withColumn("v", F.col("v").cast("double"))
    mean, sem, _, n = mean_sem("v")
    return long.groupBy("basis", "cond").agg(mean, sem, n)


def basis_statistics(cube: DataFrame) -> DataFrame:
    low, high = F.min("mean"), F.max("mean")
    return cube.groupBy("basis").agg(low.alias("low"), high.alias("high"), (high - low).alias("range"), F.var_pop("mean").alias("variance"))


def normalise(cube: DataFrame) -> DataFrame:
    """z: each basis centred over conditions and divided by its deviation; NULL without any."""
    w = W.partitionBy("basis")
    return cube.withColumn("z", F.try_divide(F.col("mean") - F.avg("mean").over(w), F.stddev_pop("mean").over(w)))


def project(cube: DataFrame, weights: DataFrame) -> DataFrame:
    """dimension, cond, mean, sem: weighted sums over bases; errors add in quadrature."""
    joined = cube.join(weights, "basis")
    return joined.groupBy("dimension", "cond").agg(F.sum(F.col("w") * F.col("mean")).alias("mean"), F.sqrt(F.sum(F.col("w") * F.col("w") * F.col("sem") * F.col("sem"))).alias("sem"))


def _centred(cube: DataFrame) -> DataFrame:
    return cube.select("basis", "cond", (F.col("mean") - F.avg("mean").over(W.partitionBy("basis"))).alias("z"))


def gram(cube: DataFrame) -> DataFrame:
    """i, j, g with i <= j: sums over conditions of products of centred bases."""
    z = _centred(cube)
    a, b = z.select(F.col("basis").alias("i"), "cond", F.col("z").alias("za")), z.select(F.col("basis").alias("j"), "cond", F.col("z").alias("zb"))
    return a.join(b, "cond").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("za") * F.col("zb")).alias("g"))


def component_weights(cube: DataFrame, k: int) -> DataFrame:
    """basis, dimension, w, explained: the first k directions of largest variance of the centred
    conditions, and the share of variance of each. The sign makes each one's largest weight positive."""
    import numpy as np

    rows = gram(cube).collect()  # bases x bases
    names = sorted({r.i for r in rows})
    at = {n: x for x, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[at[r.i], at[r.j]] = m[at[r.j], at[r.i]] = r.g
    value, vector = np.linalg.eigh(m)
    order = np.argsort(-value)[:k]
    share = value[order] / max(value.sum(), 1e-300)
    vector = vector[:, order]
    vector *= np.sign(vector[np.abs(vector).argmax(axis=0), range(vector.shape[1])])
    weights = [(n, d, float(vector[at[n], d]), float(share[d])) for n in names for d in range(vector.shape[1])]
    return cube.sparkSession.createDataFrame(weights, f"basis {cube.schema['basis'].dataType.simpleString()}, dimension int, w double, explained double")


def complete_over_time(cube: DataFrame, bases: list) -> DataFrame:
    """basis, cond, mean of a cube(basis, cond, bin, mean) whose cond is the pair of condition and bin, at
    pairs at which all bases have a mean: what components are taken of when time counts."""
    from trialloom.operators.timecourse import complete_rows

    rows = complete_rows(cube.where(F.col("basis").isin(bases)), len(bases))
    return rows.select("basis", F.struct("cond", "bin").alias("cond"), "mean")


def scores(cube: DataFrame, weights: DataFrame) -> DataFrame:
    """dimension, cond, score, explained: centred conditions along the directions of component_weights."""
    return _centred(cube).join(weights, "basis").groupBy("dimension", "cond").agg(F.sum(F.col("w") * F.col("z")).alias("score"), F.max("explained").alias("explained"))


def principal_components(cube: DataFrame, k: int) -> DataFrame:
    """dimension, cond, score, explained of the first k components."""
    return scores(cube, component_weights(cube, k))


def distances(cube: DataFrame) -> DataFrame:
    """cond_a, cond_b, distance for each pair of conditions."""
    a, b = cube.select("basis", F.col("cond").alias("cond_a"), F.col("mean").alias("x")), cube.select("basis", F.col("cond").alias("cond_b"), F.col("mean").alias("y"))
    return a.join(b, "basis").where("cond_a < cond_b").groupBy("cond_a", "cond_b").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("distance"))


def common_window(spans: DataFrame, by: list[str], least: int) -> DataFrame:
    """t_min, t_max: the least-th smallest start and the least-th largest end of a group's trials."""
    w = W.partitionBy(*by)
    # a rank with a limit is cut before the shuffle, so a group never sends more than least rows a task
    first = spans.withColumn("_r", F.row_number().over(w.orderBy("t0"))).where(F.col("_r") <= least)
    last = spans.withColumn("_r", F.row_number().over(w.orderBy(F.desc("t1")))).where(F.col("_r") <= least)
    return first.groupBy(*by).agg(F.max("t0").alias("t_min")).join(last.groupBy(*by).agg(F.min("t1").alias("t_max")), by)


def variance_explained(cube: DataFrame, direction: DataFrame) -> DataFrame:
    """total variance of the centred cube, and the share that one direction(basis, w) of unit
    length explains: one less what its reconstruction leaves over, never below 0."""
    z = _centred(cube).join(F.broadcast(direction), "basis")  # a weight for each basis
    score = F.sum(F.col("w") * F.col("z")).over(W.partitionBy("cond"))
    left = z.withColumn("e", F.col("z") - F.col("w") * score)
    return left.agg(F.sum(F.col("z") * F.col("z")).alias("total"), F.greatest(F.lit(0.0), 1 - F.sum(F.col("e") * F.col("e")) / F.sum(F.col("z") * F.col("z"))).alias("explained"))


def resampled_cubes(values: DataFrame, draws: DataFrame, renormalise: bool = True) -> DataFrame:
    """draw, basis, cond, mean of values(trial_id, basis, v) over draws(draw, cond, trial_id).

    Means of resamples vary more than the originals; renormalise scales each draw's basis
    about its mean over conditions to the variance that the first draw has there.
    """
    cube = draws.join(values, "trial_id").groupBy("draw", "basis", "cond").agg(F.avg("v").alias("mean"))
    if not renormalise:
        return cube
    w = W.partitionBy("draw", "basis")
    spread = cube.where("draw = 0").groupBy("basis").agg(F.stddev_pop("mean").alias("_s0"))
    rows = cube.withColumns({"_m": F.avg("mean").over(w), "_s": F.stddev_pop("mean").over(w)}).join(spread, "basis")
    scaled = F.col("_m") + (F.col("mean") - F.col("_m")) * F.coalesce(F.try_divide("_s0", "_s"), F.lit(1.0))
    return rows.select("draw", "basis", "cond", scaled.alias("mean"))


def translation(cube: DataFrame) -> DataFrame:
    """basis, offset, norm such that (mean + offset) * norm is centred and of unit deviation over conditions."""
    return cube.groupBy("basis").agg((-F.avg("mean")).alias("offset"), F.coalesce(F.try_divide(F.lit(1.0), F.stddev_pop("mean")), F.lit(1.0)).alias("norm"))


def apply_translation(cube: DataFrame, by: DataFrame, inverse: bool = False) -> DataFrame:
    """cube with mean and sem under a translation, or under its inverse."""
    rows = cube.join(by, "basis")
    mean = F.col("mean") / F.col("norm") - F.col("offset") if inverse else (F.col("mean") + F.col("offset")) * F.col("norm")
    sem = F.col("sem") / F.abs("norm") if inverse else F.col("sem") * F.abs("norm")
    return rows.withColumns({"mean": mean, "sem": sem}).drop("offset", "norm")


def compose(first: DataFrame, then: DataFrame) -> DataFrame:
    """The translation that does first and then the other."""
    b = then.select("basis", F.col("offset").alias("_o"), F.col("norm").alias("_n"))
    return first.join(b, "basis").select("basis", (F.col("offset") + F.col("_o") / F.col("norm")).alias("offset"), (F.col("norm") * F.col("_n")).alias("norm"))


def reconstruct(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """basis, cond, mean: weighted sums over dimensions, which take scores(dimension, cond, score) back
    to bases by an encoder's weights(basis, dimension, w)."""
    return scores.join(weights, "dimension").groupBy("basis", "cond").agg(F.sum(F.col("w") * F.col("score")).alias("mean"))


def targeted_weights(cube: DataFrame, regressors: DataFrame) -> DataFrame:
    """basis, dimension, w: how much each basis changes with each regressor(cond, dimension, x), one at a
    time, scaled to unit length over bases; a projection targeted at what the regressors vary."""
    rows = cube.join(regressors, "cond").groupBy("basis", "dimension").agg(F.try_divide(F.covar_pop("x", "mean"), F.var_pop("x")).alias("b"))
    length = F.sqrt(F.sum(F.col("b") * F.col("b")).over(W.partitionBy("dimension")))
    return rows.select("basis", "dimension", F.try_divide("b", length).alias("w"))


def cross_gram(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, g: sums over conditions of products of a's basis i and b's basis j, of (basis, cond, z)."""
    x = a.select(F.col("basis").alias("i"), "cond", F.col("z").alias("za"))
    y = b.select(F.col("basis").alias("j"), "cond", F.col("z").alias("zb"))
    return x.join(y, "cond").groupBy("i", "j").agg(F.sum(F.col("za") * F.col("zb")).alias("g"))


def demixed_weights(cube: DataFrame, marginal: DataFrame, k: int, ridge: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(decoder(basis, dimension, w), encoder(basis, dimension, w)) of k components that read one
    marginalisation out of the whole population.

    cube(basis, cond, mean) is centred; marginal(basis, cond, z) is one term's effects. The
    regression of the term on the population with a ridge, cut to rank k by what it
    predicts, is the encoder times the decoder. The driver sees bases x bases only.
    """
    import numpy as np

    whole = _centred(cube)
    names = sorted(r.basis for r in cube.select("basis").distinct().collect())
    at = {n: i for i, n in enumerate(names)}
    g, h = np.zeros((len(names),) * 2), np.zeros((len(names),) * 2)
    for table, m in ((cross_gram(whole, whole), g), (cross_gram(marginal, whole), h)):
        for r in table.collect():
            m[at[r.i], at[r.j]] = r.g
    b = np.linalg.lstsq((g + ridge * np.eye(len(g))).T, h.T, rcond=None)[0].T
    value, vector = np.linalg.eigh(b @ g @ b.T)
    u = vector[:, np.argsort(-value)[:k]]
    u = u * np.sign(u[np.abs(u).argmax(axis=0), range(u.shape[1])])
    rows = [[(int(n), d, float(w[at[n], d])) for n in names for d in range(u.shape[1])] for w in ((u.T @ b).T, u)]
    return tuple(cube.sparkSession.createDataFrame(r, "basis int, dimension int, w double") for r in rows)


def over_conditions(cube: DataFrame) -> DataFrame:
    """basis, any_positive, all_positive, highest, lowest: of each basis whether its mean is positive in any
    and in all conditions, and the conditions of its extremes (the first of equals)."""
    up, first = F.col("mean") > 0, -F.col("cond")
    return cube.groupBy("basis").agg(
        F.bool_or(up).alias("any_positive"), F.bool_and(up).alias("all_positive"),
        (-F.max(F.struct("mean", first.alias("c")))["c"]).alias("highest"), F.min(F.struct("mean", "cond"))["cond"].alias("lowest"),
    )
