"""Exact positions and order statistics of large groups, without a task that orders a group.

Approximate percentiles say where to cut; counts of what lies between the cuts make the
result exact, whatever the approximation was.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.functions.stats import clean

#: Rows of the table that one task orders, stretches that a table is cut into at most (beyond ROWS *
#: CUTS rows stretches grow), and keys that are drawn for each cut.
ROWS, CUTS, DRAWN = 1_000_000, 16_384, 64


def _keys(order: str | list[str]) -> list[tuple[str, bool]]:
    """(column, descending) of each key; "-name" is descending."""
    return [(c.removeprefix("-"), c.startswith("-")) for c in ([order] if isinstance(order, str) else order)]


def ordering(order: str | list[str]) -> list[Column]:
    """Sort keys, missing values last."""
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in _keys(order)]


def _before(cut: Column, keys: list[tuple[str, bool]]) -> Column:
    """Whether a cut comes strictly before the row, key by key, missing values last."""
    out = F.lit(False)
    for name, down in reversed(keys):
        mine, its = F.col(name), cut[name]
        less = (its > mine) if down else (its < mine)
        less = F.when(its.isNull(), F.lit(False)).when(mine.isNull(), F.lit(True)).otherwise(less)
        out = less | (its.eqNullSafe(mine) & out)
    return out


def stretches(df: DataFrame, by: list[str], order: str | list[str], rows: int = ROWS, cuts: int = CUTS) -> DataFrame:
    """df with _part: stretches of about rows rows in the order of by and order, ties in one stretch.

    A small draw of keys says where to cut, so a group that holds most rows gets most cuts.
    Where they fall changes no result, only how even the stretches are. A row finds its
    stretch by halving.
    """
    total = df.count()
    parts = min(cuts, max(1, math.ceil(total / rows)))
    if parts == 1:
        return df.withColumn("_part", F.lit(0))
    keys = [*_keys(by), *_keys(order)]
    names = list(dict.fromkeys(c for c, _ in keys))
    drawn = df.select(*names).sample(min(1.0, DRAWN * parts / total), seed=1)
    found = drawn.orderBy(*ordering(by), *ordering(order)).collect()  # at most about DRAWN * CUTS keys
    chosen = [found[k * len(found) // parts] for k in range(1, parts)] if found else []
    table = F.array(*[F.struct(*[F.lit(r[n]).cast(df.schema[n].dataType).alias(n) for n in names]) for r in chosen])
    steps = max(1, len(chosen)).bit_length()
    last = F.lit(len(chosen))

    def halve(at: Column, step: Column) -> Column:
        ahead = at + step
        inside = F.get(table, F.least(ahead, last) - 1)
        return F.when((ahead <= last) & _before(inside, keys), ahead).otherwise(at)

    return df.withColumn("_part", F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(steps))]), F.lit(0), halve) if chosen else F.lit(0))


def numbered(df: DataFrame, by: list[str], order: str | list[str], rows: int = ROWS, ties: bool = False) -> DataFrame:
    """df with i, each row's position (from 0) in its group by order ("-name" is descending, missing
    values come last), which tells rows apart; with ties, equal keys share their first position.

    A row's position is its rank within its group and stretch after the counts of the
    stretches before, so no task orders a group.
    """
    keyed = stretches(df, by, order, rows)
    w = W.partitionBy(*by, "_part").orderBy(*ordering(order))
    ranked = keyed.withColumn("_rank", (F.rank() if ties else F.row_number()).over(w) - 1)
    counts = keyed.groupBy(*by, "_part").agg(F.count("*").alias("_n"))  # at most CUTS rows more than groups
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(*by).orderBy("_part")) - F.col("_n")).drop("_n")
    before = before.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_at"), "_before")
    same = F.col("_part") == F.col("_at")
    for i, c in enumerate(by):  # a missing group is one too
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return ranked.join(before, same).withColumn("i", F.col("_before") + F.col("_rank")).drop("_part", "_rank", "_before", "_at", *[f"_by{i}" for i in range(len(by))])


def hazen_quantiles(df: DataFrame, by: list[str], value: str, ps: list[float], accuracy: int = 100_000) -> DataFrame:
    """*by, p, x: Hazen quantiles of each group, exact; missing values are passed over.

    An approximate percentile on either side of a wanted rank gives a stretch that holds
    it, about one 16,000th of the group; only that is ordered, by distinct values.
    """
    k, margin = len(ps), 3 / accuracy
    rows = df.select(*by, clean(F.col(value).cast("double")).alias("x")).where("x is not null")
    at = lambda side: F.percentile_approx("x", [min(1.0, max(0.0, p + side * margin)) for p in ps], accuracy)
    ends = rows.groupBy(*by).agg(F.count("*").alias("total"), at(-1).alias("lo"), at(1).alias("hi")).where("total > 0")
    joined = rows.join(ends, by) if by else rows.crossJoin(ends)  # one row
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    outer = []
    for i in range(k):
        outer.append(F.struct(F.count(F.when(x < lo[i], 1)).alias("below"), F.max(F.when(x < lo[i], x)).alias("prev"), F.min(F.when(x > hi[i], x)).alias("next")))
    stats = joined.groupBy(*by, "total").agg(F.array(*outer).alias("o")).select(*by, "total", F.posexplode("o").alias("i", "o"))
    held = F.filter(F.array(*[F.lit(i) for i in range(k)]), lambda i: (x >= F.get(lo, i)) & (x <= F.get(hi, i)))
    inside = joined.select(*by, "x", F.explode(held).alias("i")).groupBy(*by, "i", "x").agg(F.count("*").alias("n"))
    inside = inside.withColumn("last", F.sum("n").over(W.partitionBy(*by, "i").orderBy("x")))
    p = F.get(F.array(*[F.lit(float(q)) for q in ps]), F.col("i"))
    rank = F.greatest(F.lit(1.0), F.least(F.col("total").cast("double"), p * F.col("total") + 0.5))
    wanted = stats.withColumns({"p": p, "rank": rank}).withColumns({"r0": F.floor("rank"), "r1": F.least(F.floor("rank") + 1, F.col("total"))})
    both = wanted.join(inside, [*by, "i"], "left")
    first = F.col("o.below") + F.col("last") - F.col("n")
    of = lambda r: F.max(F.when((first < F.col(r)) & (F.col(r) <= F.col("o.below") + F.col("last")), x))
    found = both.groupBy(*by, "i", "p", "rank", "r0", "r1", "o").agg(of("r0").alias("v0"), of("r1").alias("v1"))
    outside = lambda r: F.when(F.col(r) <= F.col("o.below"), F.col("o.prev")).otherwise(F.col("o.next"))
    v0, v1 = F.coalesce("v0", outside("r0")), F.coalesce("v1", outside("r1"))
    return found.select(*by, "p", (v0 + (F.col("rank") - F.col("r0")) * (v1 - v0)).alias("x"))
