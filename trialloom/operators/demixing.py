"""Components that read each marginalisation out of a population: ridge by cross-validation, shares
of variance by component and term, and what of it is signal.

Cubes are rows(cond, basis, mean) with the axes of cond; matrices of bases x bases reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.operators.contrasts import effects
from trialloom.operators.dynamics import moments


def _arrays(rows: DataFrame, keys: list[str], bases: list, value: str) -> DataFrame:
    """keys and x: the values of all bases as one array; keys without all of them are left out."""
    found = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("basis", value))).alias("m"))
    wide = found.select(*keys, F.transform(F.array(*[F.lit(b) for b in bases]), lambda b: F.element_at("m", b)).alias("x"))
    return wide.where(~F.exists("x", lambda v: v.isNull()))


def centred(cube: DataFrame, axes: list[str]) -> DataFrame:
    """cube(*axes, basis, mean) less each basis's mean over conditions."""
    return cube.select(*axes, "basis", (F.col("mean") - F.avg("mean").over(W.partitionBy("basis"))).alias("mean"))


def reduced_regression(g: np.ndarray, h: np.ndarray, k: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """(decoder, encoder): the k columns d and f for which f d' X comes nearest to the term, by
    g = X X' and h = term X', with a ridge on the regression. Directions in which X does not
    vary weigh nothing."""
    b = np.linalg.lstsq((g + ridge * np.eye(len(g))).T, h.T, rcond=1e-10)[0].T
    value, vector = np.linalg.eigh(b @ g @ b.T)
    u = vector[:, np.argsort(-value)[:k]]
    u = u * np.where(u[np.abs(u).argmax(axis=0), range(u.shape[1])] < 0, -1.0, 1.0)
    return b.T @ u, u


def term_moments(cube: DataFrame, axes: list[str], bases: list) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """g = X X' of the centred cube, and of each term h = T X' and t = T T'. Terms are the effects of
    sets of axes, named as in contrasts.effects."""
    whole = _arrays(centred(cube, axes), axes, bases, "mean")
    terms = _arrays(effects(cube.select(*axes, "basis", "mean"), axes, "mean", ["basis"]), [*axes, "term"], bases, "effect")
    both = terms.withColumnRenamed("x", "t").join(whole, axes).withColumn("tx", F.concat("t", "x"))
    found, n = moments(both, "tx", "tx", "term"), len(bases)  # one pass: T T', T X' and X X' of each term
    return next(iter(found.values()))[n:, n:], {k: m[:n, n:] for k, m in found.items()}, {k: m[:n, :n] for k, m in found.items()}


def demixed_components(cube: DataFrame, axes: list[str], bases: list, k: int, ridge: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decoder, encoder, shares) of k components for every term, all of one population.

    decoder and encoder are (basis, term, dimension, w); dimensions count through all terms by
    the variance they explain. shares(term, dimension, explained, of_term, share) says what part of the
    population's variance a component explains alone, and how the variance of its score
    falls on each term (of_term).
    """
    g, h, t = term_moments(cube, axes, bases)
    total = np.trace(g)
    parts = []
    for term in sorted(h):
        decoder, encoder = reduced_regression(g, h[term], k, ridge)
        for d, f in zip(decoder.T, encoder.T, strict=True):
            explained = (2 * d @ g @ f - (f @ f) * (d @ g @ d)) / max(total, 1e-300)  # one less what f d'X leaves over
            spread = {o: float(d @ t[o] @ d) for o in sorted(t)}
            parts.append((explained, term, d, f, spread))
    parts.sort(key=lambda p: (-p[0], p[1]))
    spark = cube.sparkSession
    kind = cube.schema["basis"].dataType.simpleString()
    tables = [spark.createDataFrame([(b, p[1], i, float(p[at][j])) for i, p in enumerate(parts) for j, b in enumerate(bases)], f"basis {kind}, term string, dimension int, w double") for at in (2, 3)]
    shares = [(p[1], i, float(p[0]), o, v / max(sum(p[4].values()), 1e-300)) for i, p in enumerate(parts) for o, v in p[4].items()]
    return (*tables, spark.createDataFrame(shares, "term string, dimension int, explained double, of_term string, share double"))


def cross_validated_demixing(trials: DataFrame, axes: list[str], bases: list, ridges: list[float], k: int) -> DataFrame:
    """ridge, error: how far what the decoders read from unseen trials is from the terms of the seen ones.

    trials(fold, *axes, basis, v). For each fold the components are fitted to the means over the
    other folds' trials and applied to the means over its own; the squared distances
    from the seen trials' terms are summed over folds and terms and divided by the terms'
    own squares. Folds without a trial of each condition and basis are left out.
    """
    sums = trials.groupBy("fold", *axes, "basis").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    all_ = F.sum("s").over(W.partitionBy(*axes, "basis")), F.sum("n").over(W.partitionBy(*axes, "basis"))
    cells = sums.select("fold", *axes, "basis", F.try_divide("s", "n").alias("unseen"), F.try_divide(all_[0] - F.col("s"), all_[1] - F.col("n")).alias("seen"))
    conditions = cells.select(*axes).distinct().count()
    keys = ["fold", *axes]
    off = lambda c: (F.col(c) - F.avg(c).over(W.partitionBy("fold", "basis"))).alias(c)
    middle = cells.select(*keys, "basis", off("seen"), off("unseen"))
    seen, unseen = _arrays(middle, keys, bases, "seen"), _arrays(middle, keys, bases, "unseen").withColumnRenamed("x", "y")
    whole = seen.join(unseen, keys)
    full = whole.groupBy("fold").agg(F.count("*").alias("n")).where(F.col("n") == conditions).select("fold")
    whole = whole.join(full, "fold", "left_semi")
    terms = _arrays(effects(middle, axes, "seen", ["fold", "basis"]), [*keys, "term"], bases, "effect").withColumnRenamed("x", "t")
    both = terms.join(whole, keys).select(F.concat_ws("|", F.col("fold").cast("string"), "term").alias("k"), F.concat("t", "x", "y").alias("v"))
    found, n, out = moments(both, "v", "v", "k"), len(bases), []  # one pass for all products
    for ridge in ridges:
        miss = size = 0.0
        for _, m in sorted(found.items()):
            tt, tx, ty = m[:n, :n], m[:n, n : 2 * n], m[:n, 2 * n :]
            decoder, encoder = reduced_regression(m[n : 2 * n, n : 2 * n], tx, k, ridge)
            b = encoder @ decoder.T
            miss += np.trace(tt) - 2 * np.trace(b @ ty.T) + np.trace(b @ m[2 * n :, 2 * n :] @ b.T)
            size += np.trace(tt)
        out.append((float(ridge), float(miss / max(size, 1e-300))))
    return trials.sparkSession.createDataFrame(out, "ridge double, error double")


def regression_weights(a: DataFrame, bases_a: list, b: DataFrame, bases_b: list, keys: list[str], ridge: float = 0.0) -> DataFrame:
    """basis, dimension, w: how each basis of population b (the dimensions) is read from those of a.

    Cubes are rows(*keys, basis, mean); the keys at which both have all their bases are used,
    centred over them. Directions in which a does not vary weigh nothing.
    """
    x, y = _arrays(a, keys, bases_a, "mean"), _arrays(b, keys, bases_b, "mean").withColumnRenamed("x", "y")
    row = F.concat("x", "y", F.array(F.lit(1.0)))
    m, n = moments(x.join(y, keys).select(row.alias("v")), "v", "v"), len(bases_a)
    if not len(m):
        raise ValueError("no key at which both populations have all their bases")
    m = m[:-1, :-1] - np.outer(m[:-1, -1], m[-1, :-1]) / m[-1, -1]  # about the means
    w = np.linalg.lstsq(m[:n, :n] + ridge * np.eye(n), m[:n, n:], rcond=1e-10)[0]
    kinds = [d.schema["basis"].dataType.simpleString() for d in (a, b)]
    rows = [(p, q, float(w[i, j])) for i, p in enumerate(bases_a) for j, q in enumerate(bases_b)]
    return a.sparkSession.createDataFrame(rows, f"basis {kinds[0]}, dimension {kinds[1]}, w double")


def best_ridge(errors: DataFrame) -> float:
    """The ridge of the smallest error, of equal ones the largest."""
    return errors.agg(F.min_by("ridge", F.struct("error", -F.col("ridge")))).first()[0]


def signal_variance(cube: DataFrame, noise: DataFrame, weights: DataFrame) -> DataFrame:
    """dimension, total, noise, signal, share: of each component's variance over conditions what is noise.

    cube(basis, cond, mean); noise(basis, cond, diff) holds differences of paired trials scaled to
    the noise of a mean (randomise.pair_differences); both go through the same
    weights(basis, dimension, w). signal is total less noise, never below 0; share is the signal's
    part of all components' total up to here and never falls from one component to the next.
    """
    middle = cube.select("basis", "cond", (F.col("mean") - F.avg("mean").over(W.partitionBy("basis"))).alias("z"))
    both = middle.join(noise.select("basis", "cond", "diff"), ["basis", "cond"], "left").join(weights.select("basis", "dimension", "w"), "basis")
    scores = both.groupBy("dimension", "cond").agg(F.sum(F.col("w") * F.col("z")).alias("z"), F.sum(F.col("w") * F.col("diff")).alias("e"), F.count("*").alias("n"), F.count("diff").alias("m"))
    # a condition without noise in some basis has none at all; the others stand for it
    noisy = F.when(F.col("n") == F.col("m"), F.col("e") * F.col("e"))
    sums = scores.groupBy("dimension").agg(F.sum(F.col("z") * F.col("z")).alias("total"), (F.avg(noisy) * F.count("*")).alias("noise"))
    signal = F.greatest(F.lit(0.0), F.col("total") - F.coalesce("noise", F.lit(0.0)))
    so_far = W.orderBy("dimension").rowsBetween(W.unboundedPreceding, 0)  # a row a component
    every = sums.agg(F.sum("total").alias("_all"))
    rows = sums.withColumn("signal", signal).crossJoin(every)
    return rows.select("dimension", "total", "noise", "signal", F.try_divide(F.sum("signal").over(so_far), F.col("_all")).alias("share"))
