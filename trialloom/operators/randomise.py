"""Shuffles and resamples that come out alike on every run: hashes of seed and trial decide."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.operators.joins import band_join
from trialloom.operators.ranking import ROWS, numbered


def draw_key(seed: int | Column, *parts: Column | str) -> Column:
    """md5 of seed and parts, joined by colons."""
    first = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.md5(F.concat_ws(":", first, *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


def draw_number(key: Column) -> Column:
    """The first 8 hex digits as a number."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def shuffle_labels(trials: DataFrame, seed: int) -> DataFrame:
    """trial_id, cond: conditions dealt out at random, each as often as before.

    Trials get a random position: the first digits of a hash decide which bucket a trial is
    in, as many as there are trials for, the rest its place there; bucket counts say where a
    bucket begins. Positions then fall into the ranges that the conditions' counts cut, so
    no task orders all trials.
    """
    keyed, total = trials.withColumn("key", draw_key(seed, "trial_id")), trials.count()
    digits = max(2, math.ceil(math.log(max(1, total / ROWS), 16)))
    bucket = F.substring("key", 1, digits)
    counts = keyed.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("m"))
    begins = counts.select("bucket", (F.sum("m").over(W.orderBy("bucket")) - F.col("m")).alias("begin"))  # one row for about ROWS trials
    rank = F.row_number().over(W.partitionBy("bucket").orderBy("key", "trial_id"))
    placed = keyed.withColumn("bucket", bucket).withColumn("rank", rank).join(begins, "bucket").withColumn("r", F.col("begin") + F.col("rank"))
    sizes = trials.groupBy("cond").agg(F.count("*").alias("n"))
    ends = sizes.select("cond", F.sum("n").over(W.orderBy("cond")).alias("hi"), "n").select("cond", "hi", (F.col("hi") - F.col("n")).alias("lo"))
    # positions in bands, about ten thousand, so that no trial meets all conditions
    ranges = ends.select("cond", (F.col("lo") + 1).alias("lo"), "hi")
    return band_join(placed.select("trial_id", F.col("r").alias("t")), ranges, max(1000, total // 10_000), by=[]).select("trial_id", "cond")


def bootstrap(trials: DataFrame, draws: int, seed: int) -> DataFrame:
    """draw, cond, trial_id: for each draw as many trials of a condition as it has, with
    replacement. Draw d uses seed + d."""
    sizes = trials.groupBy("cond").agg(F.count("*").alias("n"))
    o = numbered(trials.select("trial_id", "cond"), ["cond"], "trial_id").join(sizes, "cond")
    each = o.select("cond", "i", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    pick = draw_number(draw_key(F.col("draw") + seed, "cond", "i")) % F.col("n")
    return each.select("draw", "cond", pick.alias("i")).join(o.select("cond", "i", "trial_id"), ["cond", "i"]).select("draw", "cond", "trial_id")


def leave_one_out(trials: DataFrame, group: str, value: str) -> DataFrame:
    """others: the mean of the group without the trial itself."""
    sums = trials.groupBy(group).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    rows = trials.join(sums, group).where("_n > 1")
    return rows.withColumn("others", (F.col("_s") - F.col(value)) / (F.col("_n") - 1)).drop("_s", "_n")


def pair_differences(trials: DataFrame, group: str | list[str], value: str, seed: int) -> DataFrame:
    """*group, diff: the difference of two trials of a group, drawn by hash, over the root of
    twice the group's size; an estimate of the noise of its mean."""
    keys = [group] if isinstance(group, str) else group
    order = F.struct(draw_key(seed, "trial_id").alias("k"), F.col("trial_id"), F.col(value).alias("v"))
    two = trials.groupBy(*keys).agg(F.min(order).alias("a"), F.max(order).alias("b"), F.count("*").alias("n")).where("n > 1")
    return two.select(*keys, ((F.col("a.v") - F.col("b.v")) / F.sqrt(2.0 * F.col("n"))).alias("diff"))


def shuffle_within(trials: DataFrame, slices: str, seed: int) -> DataFrame:
    """trial_id, slices, cond: conditions dealt out at random among the trials of each slice, each as
    often there as before. Positions come from hash buckets, as in shuffle_labels."""
    keyed = trials.withColumn("key", draw_key(seed, "trial_id"))
    digits = max(2, math.ceil(math.log(max(1, trials.count() / ROWS), 16)))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, digits))
    counts = keyed.groupBy(slices, "bucket").agg(F.count("*").alias("m"))
    begins = counts.select(slices, "bucket", (F.sum("m").over(W.partitionBy(slices).orderBy("bucket")) - F.col("m")).alias("begin"))
    rank = F.row_number().over(W.partitionBy(slices, "bucket").orderBy("key", "trial_id"))
    placed = keyed.drop("cond").withColumn("rank", rank).join(begins, [slices, "bucket"]).withColumn("r", F.col("begin") + F.col("rank"))
    sizes = trials.groupBy(slices, "cond").agg(F.count("*").alias("n"))
    ends = sizes.withColumn("hi", F.sum("n").over(W.partitionBy(slices).orderBy("cond"))).withColumn("lo", F.col("hi") - F.col("n"))
    return placed.join(ends, slices).where("r > lo and r <= hi").select("trial_id", slices, "cond")


def bootstrap_from(trials: DataFrame, source: dict[int, int], draws: int, seed: int) -> DataFrame:
    """draw, cond, trial_id: for each draw as many trials as a condition has, taken with replacement
    from the condition that source names for it (itself if none)."""
    mapping = F.create_map(*[F.lit(x) for pair in source.items() for x in pair]) if source else None
    other = F.coalesce(F.try_element_at(mapping, F.col("cond").cast("int")), F.col("cond").cast("int")) if source else F.col("cond")
    sizes = trials.groupBy("cond").agg(F.count("*").alias("n"))
    own = numbered(trials.select("trial_id", "cond"), ["cond"], "trial_id")
    pools = sizes.select(F.col("cond").alias("pool"), F.col("n").alias("size"))
    each = own.select("cond", "i", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"), other.cast(trials.schema["cond"].dataType).alias("pool")).join(pools, "pool")
    pick = (draw_number(draw_key(F.col("draw") + seed, "cond", "i")) % F.col("size")).alias("i")
    drawn = each.select("draw", "cond", "pool", pick)
    return drawn.join(own.select(F.col("cond").alias("pool"), "i", "trial_id"), ["pool", "i"]).select("draw", "cond", "trial_id")
