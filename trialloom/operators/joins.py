"""Joins that keep one of several matches, and joins by range inside a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """left with the first of its matches in right by order, and matches, how many there were.

    Matches are reduced by a sum and a minimum before the join, so a key with many of them
    never meets left as many rows.
    """
    values = [c for c in right.columns if c not in on]
    ordered = order + [c for c in values if c not in order]
    best = right.groupBy(*on).agg(F.min(F.struct(*ordered)).alias("_best"), F.count("*").alias("_n"))
    return left.join(best, on, "left").select(*left.columns, *[F.col(f"_best.{c}").alias(c) for c in values], F.coalesce("_n", F.lit(0)).alias("matches"))


def band_join(points: DataFrame, spans: DataFrame, width: float, by: list[str] | None = None) -> DataFrame:
    """points(by, t, ...) with the spans(by, lo, hi, ...) of their key whose closed range holds t.

    Time is cut into bands of width: a point lies in one, a span in those it meets (two, where
    it is no longer than width). Rows meet by key and band, and the range is tested then, so a
    key's rows spread over as many tasks as it has bands, and what is compared is near.
    """
    keys = ["trial_id"] if by is None else by
    near = points.withColumn("_band", F.floor(F.col("t") / width))
    cut = spans.where("lo <= hi").withColumn("_band", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    return near.join(cut, [*keys, "_band"]).where("t >= lo and t <= hi").drop("_band")
