"""Mergeable histograms of fixed width: a table of left edges and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str, width: float, by: list[str] | None = None) -> DataFrame:
    edge = F.floor(F.col(value) / width) * width
    return df.where(F.col(value).isNotNull()).groupBy(*(by or []), edge.cast("double").alias("edge")).agg(F.count("*").alias("n"))


def merge(histograms: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of equal edges add up; histograms must share their width."""
    return histograms.groupBy(*(by or []), "edge").agg(F.sum("n").alias("n"))


def summary(h: DataFrame) -> DataFrame:
    """low, high, mean and median of the left edges. A histogram's bins are few."""
    every = W.orderBy("edge")
    c = h.select("edge", "n", F.sum("n").over(every).alias("upto"), F.sum("n").over(W.partitionBy()).alias("total"))
    return c.agg(
        F.min("edge").alias("low"),
        F.max("edge").alias("high"),
        F.round(F.sum(F.col("edge") * F.col("n")) / F.max("total"), 6).alias("mean"),
        F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.col("edge"))).alias("median"),
    )


def extremes(h: DataFrame, by: list[str]) -> DataFrame:
    """low, high, mean, std and n of each merged histogram, from its bins' left edges and, where it has
    them (columns least and most), true extremes."""
    n, e = F.sum("n"), F.col("edge")
    mean = F.sum(e * F.col("n")) / n
    std = F.sqrt(F.greatest(F.lit(0.0), (F.sum(e * e * F.col("n")) - mean * mean * n) / (n - 1)))
    low = F.min("least") if "least" in h.columns else F.min("edge")
    high = F.max("most") if "most" in h.columns else F.max("edge")
    return h.groupBy(*by).agg(low.alias("low"), high.alias("high"), mean.alias("mean"), F.when(n > 1, std).alias("std"), n.alias("n"))


def histogram_with_extremes(df: DataFrame, value: str, width: float, by: list[str] | None = None) -> DataFrame:
    """A histogram whose bins also know their least and most value; merge_with_extremes keeps them."""
    edge = F.floor(F.col(value) / width) * width
    rows = df.where(F.col(value).isNotNull()).groupBy(*(by or []), edge.cast("double").alias("edge"))
    return rows.agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))


def merge_with_extremes(histograms: DataFrame, by: list[str] | None = None) -> DataFrame:
    return histograms.groupBy(*(by or []), "edge").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
