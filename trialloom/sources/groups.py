"""Channels that are sampled together as one array column, with names for its places."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.operators.sequential import recurse


@dataclass(frozen=True)
class ChannelGroup:
    """frame(trial_id, t, values): values has a number, or nothing, for each of names.

    All channels of a group go through a step in one pass, as they share rows.
    """

    frame: DataFrame
    names: tuple[str, ...]

    @staticmethod
    def of(samples: DataFrame, names: list[str]) -> ChannelGroup:
        """From samples(trial_id, channel, t, v): times at which one of names has a sample; of two
        samples of a channel at the same time the smaller."""
        one = [F.min(F.when(F.col("channel") == n, F.col("v").cast("double"))) for n in names]
        rows = samples.where(F.col("channel").isin(list(names))).groupBy("trial_id", "t").agg(F.array(*one).alias("values"))
        return ChannelGroup(rows, tuple(names))

    @staticmethod
    def of_tensor(df: DataFrame, id_col: str, tensor: str, names: list[str], period: float = 1.0, start: float = 0.0) -> ChannelGroup:
        """From trials with an array over times of arrays over channels."""
        rows = df.select(F.col(id_col).alias("trial_id"), F.posexplode(tensor).alias("i", "values"))
        return ChannelGroup(rows.select("trial_id", (F.lit(start) + F.col("i") * period).alias("t"), F.col("values").cast("array<double>").alias("values")), tuple(names))

    def tensor(self) -> DataFrame:
        """trial_id, ts, tensor: each trial as one array over times of arrays over channels."""
        s = F.array_sort(F.collect_list(F.struct("t", "values")))
        return self.frame.groupBy("trial_id").agg(s.alias("s")).select("trial_id", F.col("s.t").alias("ts"), F.col("s.values").alias("tensor"))

    def value(self, name: str) -> Column:
        return F.get("values", F.lit(self.names.index(name)))

    def take(self, names: list[str]) -> ChannelGroup:
        """Some channels, in that order."""
        return ChannelGroup(self.frame.withColumn("values", F.array(*[self.value(n) for n in names])), tuple(names))

    def without(self, names: list[str]) -> ChannelGroup:
        return self.take([n for n in self.names if n not in names])

    def renamed(self, names: dict[str, str]) -> ChannelGroup:
        return replace(self, names=tuple(names.get(n, n) for n in self.names))

    def combined(self, weights: dict[str, dict[str, float]]) -> ChannelGroup:
        """New channels as weighted sums of those there are; missing where one that counts is missing."""
        sums = [sum((self.value(n) * w for n, w in parts.items()), F.lit(0.0)) for parts in weights.values()]
        return ChannelGroup(self.frame.withColumn("values", F.array(*sums)), tuple(weights))

    def joined(self, other: ChannelGroup) -> ChannelGroup:
        """Both groups' channels, at all times of either."""
        none = [F.array(*[F.lit(None).cast("double") for _ in g.names]) for g in (self, other)]
        rows = self.frame.join(other.frame.withColumnRenamed("values", "_other"), ["trial_id", "t"], "full")
        return ChannelGroup(rows.select("trial_id", "t", F.concat(F.coalesce("values", none[0]), F.coalesce("_other", none[1])).alias("values")), self.names + other.names)

    def unpacked(self) -> DataFrame:
        """trial_id, channel, t, v: a row for each value there is."""
        parts = F.transform(F.sequence(F.lit(0), F.lit(len(self.names) - 1)), lambda i: F.struct(F.get(F.array(*[F.lit(n) for n in self.names]), i).alias("channel"), F.get("values", i).alias("v")))
        return self.frame.select("trial_id", "t", F.inline(parts)).where("v is not null").select("trial_id", "channel", "t", "v")

    def resampled(self, width: float) -> ChannelGroup:
        """All channels at multiples of width by linear interpolation between a trial's rows; missing
        where a channel is missing in one of the two rows around."""
        w = W.partitionBy("trial_id").orderBy("t")
        pairs = self.frame.withColumns({"t1": F.lead("t").over(w), "next": F.lead("values").over(w)})
        lo, hi = F.ceil(F.col("t") / width).cast("long"), F.ceil(F.col("t1") / width).cast("long") - 1
        alone = F.when(F.col("t") == lo * width, lo).otherwise(lo - 1)
        spans = pairs.withColumns({"_lo": lo, "_hi": F.when(F.col("t1").isNull(), alone).otherwise(hi)}).where("_lo <= _hi")
        at = spans.withColumn("_b", F.explode(F.transform(F.sequence("_lo", "_hi"), lambda b: b * F.lit(float(width)))))
        share = (F.col("_b") - F.col("t")) / (F.col("t1") - F.col("t"))
        values = F.when(F.col("_b") == F.col("t"), F.col("values")).otherwise(F.zip_with("values", "next", lambda a, b: a + (b - a) * share))
        found = at.select("trial_id", "_b", values.alias("_v"))  # named anew only then, as values reads t
        return replace(self, frame=found.select("trial_id", F.col("_b").alias("t"), F.col("_v").alias("values")))

    def filtered(self, b: list[float], a: list[float], settled: bool = True) -> ChannelGroup:
        """All channels through a recursive filter along their trial; missing samples are passed over."""
        kind = self.frame.schema["trial_id"].dataType.simpleString()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for rows in frame["tensor"]:
                    x = np.array([[np.nan if v is None else v for v in row] for row in rows], dtype=float)
                    y = np.full(x.shape, np.nan)
                    for c in range(x.shape[1]):
                        known = ~np.isnan(x[:, c])
                        y[known, c] = recurse(b, a, x[known, c], settled)
                    out.append([[None if np.isnan(v) else float(v) for v in row] for row in y])
                yield pd.DataFrame({"trial_id": frame["trial_id"], "ts": frame["ts"], "tensor": out})

        found = self.tensor().mapInPandas(run, f"trial_id {kind}, ts array<double>, tensor array<array<double>>")
        rows = found.select("trial_id", F.explode(F.arrays_zip("ts", "tensor")).alias("s"))
        return replace(self, frame=rows.select("trial_id", F.col("s.ts").alias("t"), F.col("s.tensor").alias("values")))

    def means(self, groups: DataFrame) -> DataFrame:
        """cond, t, channel, mean, n over the trials of each condition, for series on a common grid."""
        rows = self.unpacked().join(groups.select("trial_id", "cond"), "trial_id")
        return rows.groupBy("cond", "t", "channel").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))
