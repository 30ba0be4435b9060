"""Grouping trials into conditions: value lists, bins, membership and cubes of axes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.functions.stats import near
from trialloom.operators.ranking import hazen_quantiles, numbered, stretches


def in_list(x: Column, values: list, tol: float = 1e-6) -> Column:
    """Membership in a list: numbers within a tolerance; NULL only if the list holds None."""
    hits = [x.isNull() if v is None else near(x, F.lit(float(v)), tol) if isinstance(v, int | float) else x == v for v in values]
    return F.coalesce(reduce(lambda a, b: a | b, hits, F.lit(False)), F.lit(False))


def in_range(x: Column, lo: float, hi: float) -> Column:
    """Closed range."""
    return F.coalesce(x.between(lo, hi), F.lit(False))


def outside_range(x: Column, lo: float, hi: float) -> Column:
    """Outside of a range; both ends belong to the outside."""
    return F.coalesce((x <= lo) | (x >= hi), F.lit(False))


def bin_membership(trials: DataFrame, attribute: str, edges: list[float]) -> DataFrame:
    """trial_id, bin (from 0): bins are closed on both sides, so an inner edge is in two."""
    bins = F.array(*[F.when(F.col(attribute).between(a, b), F.lit(i)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])
    return trials.select("trial_id", F.explode(F.filter(bins, lambda b: b.isNotNull())).alias("bin"))


def first_bin(attribute: str, edges: list[float]) -> Column:
    """The first closed bin that holds the value."""
    return F.coalesce(*[F.when(F.col(attribute).between(a, b), F.lit(i)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def uniform_edges(trials: DataFrame, attribute: str, n: int) -> list[float]:
    r = trials.agg(F.min(attribute).alias("a"), F.max(attribute).alias("b")).head()
    return [] if r.a is None else [r.a + (r.b - r.a) * i / n for i in range(n)] + [float(r.b)]


def quantile_edges(trials: DataFrame, attribute: str, n: int) -> list[float]:
    """Hazen quantiles 0, 1/n, ..., 1 of all values; only these reach the driver."""
    rows = hazen_quantiles(trials, [], attribute, [i / n for i in range(n + 1)]).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.p)]


def cube(axes: dict[str, DataFrame]) -> DataFrame:
    """Every combination of the axes' values with cond, its index; the first axis runs fastest.

    axes are small dimension tables: one column each, named as the axis.
    """
    out, size = None, 1
    index = F.lit(0)
    for name, values in axes.items():
        ordered = values.select(name).distinct().withColumn(f"_{name}", F.row_number().over(W.orderBy(F.col(name).asc_nulls_last())) - 1)
        n = ordered.count()
        index = index + F.col(f"_{name}") * size
        size *= n
        out = ordered if out is None else out.crossJoin(ordered)  # value lists, not data
    return out.withColumn("cond", index).drop(*[f"_{a}" for a in axes])


def members(trials: DataFrame, conditions: DataFrame, attributes: list[str]) -> DataFrame:
    """trial_id, cond: trials whose attributes equal a condition's (NULL equals NULL)."""
    cells = conditions.select("cond", *[F.col(a).alias(f"_{a}") for a in attributes])
    same = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(f"_{a}")) for a in attributes])
    return trials.select("trial_id", *attributes).join(cells, same).select("trial_id", "cond")


def by_condition(conditions: DataFrame, grouped: DataFrame) -> DataFrame:
    """Aggregates for every cell of a cube, empty ones too (n = 0)."""
    out = conditions.join(grouped, "cond", "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0))) if "n" in grouped.columns else out


def top_per_group(trials: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n trials of each group in an order."""
    return trials.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def set_invalid(trials: DataFrame, valid: Column, cause: str) -> DataFrame:
    """Marks rows invalid with a cause; rows stay, an earlier cause wins."""
    known = trials if "cause" in trials.columns else trials.withColumn("cause", F.lit(None).cast("string"))
    return known.withColumn("cause", F.coalesce("cause", F.when(~F.coalesce(valid, F.lit(False)), F.lit(cause))))


def reset_invalid(trials: DataFrame, causes: list[str] | None = None) -> DataFrame:
    """Trials valid again that were marked invalid for one of causes, or for any."""
    if "cause" not in trials.columns:
        return trials.withColumn("cause", F.lit(None).cast("string"))
    return trials.withColumn("cause", F.when(~F.col("cause").isin(causes), F.col("cause")) if causes else F.lit(None).cast("string"))


def distinct_with_tolerance(df: DataFrame, column: str, tol: float = 1e-6) -> DataFrame:
    """Sorted distinct numbers; a value within tol * max|x| of its predecessor is the same.

    A value's predecessor is in its own stretch of values, or the last of the stretch before.
    """
    values = df.select(F.col(column).cast("double").alias("x")).where("x is not null").distinct()
    top = values.agg(F.max(F.abs("x")).alias("top"))
    cut = stretches(values, [], "x")
    ends = cut.groupBy("_part").agg(F.max("x").alias("_end"))  # a row a stretch
    ends = ends.select("_part", F.lag("_end").over(W.orderBy("_part")).alias("_end"))
    within = F.lag("x").over(W.partitionBy("_part").orderBy("x"))
    steps = cut.withColumn("_ahead", within).join(ends, "_part").crossJoin(F.broadcast(top))
    gap = F.col("x") - F.coalesce("_ahead", "_end")
    return steps.where(gap.isNull() | (gap > tol * F.col("top"))).select("x")


def suppress(membership: DataFrame, conditions: list[int]) -> DataFrame:
    """Membership without some conditions."""
    return membership.where(~F.col("cond").isin(conditions)) if conditions else membership


def values_only_in(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column that a has and b has not."""
    return a.select(column).distinct().join(b.select(column).distinct(), column, "left_anti")


def combined_validity(trials: DataFrame, membership: DataFrame, alignments: list[DataFrame]) -> DataFrame:
    """trial_id, valid, cause: a trial is valid if it is so by hand, for the time being, by being in
    a condition and under every alignment; the first of these that fails is the cause.

    trials(trial_id, manual_valid, temporary_valid): NULL counts as valid. alignments are
    tables as windows.align makes them.
    """
    flag = lambda c: ~F.coalesce(F.col(c), F.lit(True))
    rows = trials.select("trial_id", "manual_valid", "temporary_valid")
    rows = rows.join(membership.select("trial_id").distinct().withColumn("_in", F.lit(True)), "trial_id", "left")
    causes = [F.when(flag("manual_valid"), F.lit("manual")), F.when(flag("temporary_valid"), F.lit("temporary")), F.when(F.col("_in").isNull(), F.lit("no condition"))]
    for i, a in enumerate(alignments):
        rows = rows.join(a.select("trial_id", F.col("valid").alias(f"_v{i}"), F.col("cause").alias(f"_c{i}")), "trial_id", "left")
        wrong = ~F.coalesce(F.col(f"_v{i}"), F.lit(False))
        causes.append(F.when(wrong, F.concat(F.lit(f"alignment {i}: "), F.coalesce(f"_c{i}", F.lit("not aligned")))))
    return rows.withColumn("cause", F.coalesce(*causes)).select("trial_id", F.col("cause").isNull().alias("valid"), "cause")


def sorted_within(trials: DataFrame, group: str, by: list[str], key: str = "trial_id") -> DataFrame:
    """trials with rank, from 1, inside their group by several attributes; "-name" is descending,
    missing values come last, and key settles ties."""
    return numbered(trials, [group], [*by, key]).withColumn("rank", (F.col("i") + 1).cast("int")).drop("i")


def random_per_group(trials: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    """n trials of each group, drawn without replacement by a hash of seed and trial."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("trial_id").cast("string")))
    return trials.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(key, "trial_id"))).where(F.col("rank") <= n)


def permute_axes(conditions: DataFrame, axes: list[str]) -> DataFrame:
    """The cells of a cube numbered anew, the first of axes running fastest."""
    values = {a: conditions.select(a) for a in axes}
    new = cube(values)
    same = reduce(lambda a, b: a & b, [F.col(f"c.{a}").eqNullSafe(F.col(f"n.{a}")) for a in axes])
    rest = [c for c in conditions.columns if c not in ("cond", *axes)]
    return conditions.alias("c").join(new.alias("n"), same).select(F.col("n.cond").alias("cond"), F.col("c.cond").alias("was"), *[f"c.{x}" for x in (*axes, *rest)])


def flatten_axes(conditions: DataFrame, axes: list[str], name: str, separator: str = " ") -> DataFrame:
    """Several axes of a cube as one, named name: its values say axis=value for each."""
    parts = [F.concat(F.lit(f"{a}="), F.coalesce(F.col(a).cast("string"), F.lit("missing"))) for a in axes]
    return conditions.withColumn(name, F.concat_ws(separator, *parts)).drop(*axes)


def slice_cube(conditions: DataFrame, keep: dict[str, list]) -> DataFrame:
    """The cells of a cube whose values on some axes are among those given."""
    return reduce(lambda d, item: d.where(in_list(F.col(item[0]), item[1])), keep.items(), conditions)


def gather(membership: DataFrame, order: str = "trial_id") -> DataFrame:
    """cond, n, trials: the trials of each condition as a list in order. For conditions of bounded
    size; larger ones stay rows."""
    rows = membership.groupBy("cond").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("trial_id").alias("x")))).alias("l"))
    return rows.select("cond", F.size("l").alias("n"), F.transform("l", lambda s: s["x"]).alias("trials"))


def map_groups(df: DataFrame, by: list[str], fn, schema: str) -> DataFrame:
    """fn(frame) -> frame for the rows of each group, which must fit a task. A frame is made
    for each: for many small groups map_arrays is faster, and what columns can express is better left to groupBy."""
    return df.groupBy(*by).applyInPandas(fn, schema)


def map_arrays(df: DataFrame, by: list[str], values: list[str], fn, name: str) -> DataFrame:
    """*by, name: fn(array, ...) -> number of each group's values, arrays of doubles in the same order, missing
    ones NaN. Many groups are one Arrow batch, so a group costs what fn does; a group must fit a task."""
    import pandas as pd

    lists = df.groupBy(*by).agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in values])).alias("_rows"))
    arrays = lists.select(*by, *[F.col("_rows").getField(c).alias(f"_{i}") for i, c in enumerate(values)])

    def run(frames):
        for frame in frames:
            found = [fn(*group) for group in zip(*[frame[f"_{i}"] for i in range(len(values))], strict=True)]
            yield frame[by].assign(**{name: pd.Series(found, index=frame.index, dtype="float64")})

    return arrays.mapInPandas(run, ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by], f"`{name}` double"]))


def first_subscript(membership: DataFrame) -> DataFrame:
    """trial_id, cond, conditions: of membership(trial_id, cond, weight) the condition with the largest
    weight, the first of equals, and how many a trial is in."""
    best = F.max(F.struct(F.col("weight"), (-F.col("cond")).alias("_c"))).alias("b")
    return membership.groupBy("trial_id").agg(best, F.count("*").alias("conditions")).select("trial_id", (-F.col("b._c")).alias("cond"), "conditions")


def weighted_means(values: DataFrame, membership: DataFrame, value: str) -> DataFrame:
    """cond, mean, weight: means over membership(trial_id, cond, weight), in which trials may repeat."""
    from trialloom.functions.stats import weighted_mean

    rows = values.select("trial_id", value).join(membership, "trial_id")
    return rows.groupBy("cond").agg(weighted_mean(value, "weight").alias("mean"), F.sum(F.when(F.col(value).isNotNull(), F.col("weight"))).alias("weight"))


def merged_values(df: DataFrame, attribute: str, lists: dict[str, list]) -> DataFrame:
    """attribute replaced by the name of the value list that holds it; other rows go."""
    name = F.coalesce(*[F.when(in_list(F.col(attribute), values), F.lit(n)) for n, values in lists.items()])
    return df.withColumn(attribute, name).where(F.col(attribute).isNotNull())


def values_in_both(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column that both have."""
    return a.select(column).distinct().join(b.select(column).distinct(), column, "left_semi")


def union_axis(parts: dict[str, DataFrame], axis: str) -> DataFrame:
    """Tables one below the other along a new axis that names them; columns that one lacks are missing there."""
    tagged = [df.withColumn(axis, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
