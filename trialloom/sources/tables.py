"""Reading and writing trial data as Parquet tables."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Where it names
    none, local sessions take a temporary one for good; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="trialloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: what loops go on from, as it cuts lineage and
    survives lost executors. The folder's owner clears it."""
    path = f"{shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_trials(spark: SparkSession, durations: list[float]) -> DataFrame:
    """Trials 1 .. n that hold nothing but their start and stop."""
    return spark.createDataFrame([(i, 0.0, float(d)) for i, d in enumerate(durations, 1)], "trial_id long, t_start double, t_end double")


def trials_of_durations(df: DataFrame, duration: str, order: list[str]) -> DataFrame:
    """Trials 1 .. n, in that order ("-name" is descending; it tells rows apart), that hold nothing but
    their start and stop, of lengths that a table has."""
    from trialloom.operators.ranking import numbered

    rows = numbered(df.select(*dict.fromkeys([duration, *(c.removeprefix("-") for c in order)])), [], order)
    return rows.select((F.col("i") + 1).alias("trial_id"), F.lit(0.0).alias("t_start"), F.col(duration).cast("double").alias("t_end"))


def samples_from_arrays(df: DataFrame, id_col: str, array_col: str, period: float = 1.0, start: float = 0.0) -> DataFrame:
    """trial_id, i, t, v from one array of evenly spaced samples a row."""
    rows = df.select(F.col(id_col).alias("trial_id"), F.posexplode(array_col).alias("i", "v"))
    return rows.select("trial_id", "i", (F.lit(start) + F.col("i") * period).alias("t"), F.col("v").cast("double").alias("v"))


def append_trials(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both; columns that one side lacks are missing values there."""
    return old.unionByName(new, allowMissingColumns=True)


def sessionise(events: DataFrame, starts: Column, by: str, order: list[str]) -> DataFrame:
    """events with session, the number of start markers so far; rows before the first have 0."""
    from pyspark.sql import Window as W

    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("session", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def assign_to_trials(points: DataFrame, trials: DataFrame, by: str) -> DataFrame:
    """Points(by, t) inside a trial(by, trial_id, t_start, t_end), their time counted from its start."""
    inside = points.join(trials.select(by, "trial_id", "t_start", "t_end"), by).where("t >= t_start and t <= t_end")
    return inside.withColumn("t", F.col("t") - F.col("t_start")).drop("t_start", "t_end")


def save(tables: dict[str, DataFrame], path: str, partition_by: dict[str, str] | None = None, rows_per_file: int = 1_000_000) -> None:
    """Each named set of channels as a Parquet table of its own, keyed by trial_id."""
    for name, df in tables.items():
        out = df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
        if partition_by and name in partition_by:
            out = out.partitionBy(partition_by[name])
        out.parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, sets: list[str], where: Column | None = None, max_trials: int | None = None) -> DataFrame:
    """The first set's trials (where holds; at most max_trials) with the other sets' columns.

    Sets that are not asked for are not read; where reaches the scan of the first set.
    """
    out = spark.read.parquet(f"{path}/{sets[0]}")
    out = out.where(where) if where is not None else out
    out = out.orderBy("trial_id").limit(max_trials) if max_trials else out
    for name in sets[1:]:
        out = out.join(spark.read.parquet(f"{path}/{name}"), "trial_id", "left")
    return out


def count(spark: SparkSession, path: str, name: str) -> int:
    """Rows of a set, from file footers alone."""
    return spark.read.parquet(f"{path}/{name}").count()


@dataclass(frozen=True)
class TrialSource:
    """What a data set of trials states: its name, its unit of time, and the channels of its trials
    table with their types; trial_id, t_start and t_end are always among them."""

    name: str
    channels: dict[str, str]
    time_unit: str = "ms"
    notes: dict[str, dict] = field(default_factory=dict)

    def schema(self) -> dict[str, str]:
        return {"trial_id": "long", "t_start": "double", "t_end": "double", **self.channels}

    def read(self, df: DataFrame) -> DataFrame:
        """The trials of df under this contract: required columns must be there, types are cast, trials
        that end before they start raise ValueError, notes go with the columns."""
        from trialloom.operators.catalog import conform, described

        out = conform(df, self.schema(), {"trial_id", "t_start", "t_end"})
        wrong = out.where("trial_id is null or t_start is null or t_end < t_start").limit(1).count()
        if wrong:
            raise ValueError(f"{self.name}: trials without an id or start, or that end before they start")
        return described(out, {c: {"dataset": self.name, "time_unit": self.time_unit, **self.notes.get(c, {})} for c in out.columns})


def partitions(spark: SparkSession, path: str, name: str, by: str) -> DataFrame:
    """by, n: the partitions of a set that save() wrote partitioned by a column, with their rows."""
    return spark.read.parquet(f"{path}/{name}").groupBy(by).agg(F.count("*").alias("n"))


def borrowed(spark: SparkSession, trials: DataFrame, path: str, name: str) -> DataFrame:
    """trials with the set of another data set, which stays where it is and is joined by trial."""
    return trials.join(spark.read.parquet(f"{path}/{name}"), "trial_id", "left")


def sessions_between(events: DataFrame, starts: Column, ends: Column, by: str, order: list[str]) -> DataFrame:
    """events with session, counted by start markers, up to and with the next end marker; what lies
    after an end and before the next start belongs to none and goes."""
    from pyspark.sql import Window as W

    numbered = sessionise(events, starts, by, order)
    inside = W.partitionBy(by, "session").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.when(ends, 1).otherwise(0)).over(inside), F.lit(0))
    return numbered.withColumn("_ended", ended).where("session > 0 and _ended = 0").drop("_ended")


def spikes_from_clusters(spikes: DataFrame, clusters: DataFrame, groups: list[str], per_ms: float = 1.0) -> DataFrame:
    """cluster, t (ms) of spikes(cluster, sample) whose cluster(cluster, quality) is of one of groups."""
    good = clusters.where(F.col("quality").isin(groups)).select("cluster")
    return spikes.join(good, "cluster", "left_semi").select("cluster", (F.col("sample") / F.lit(per_ms)).alias("t"))


def count_vectors(counts: DataFrame, bases: list[str]) -> DataFrame:
    """trial_id, bin and a column of counts for each basis of counts(trial_id, basis, bin, n), 0 where
    there is no row: what models of latent factors take in."""
    wide = counts.where(F.col("basis").isin(bases)).groupBy("trial_id", "bin").pivot("basis", bases).agg(F.sum("n"))
    return wide.select("trial_id", "bin", *[F.coalesce(b, F.lit(0)).alias(b) for b in bases])


def rates_from_vectors(vectors: DataFrame, bases: list[str]) -> DataFrame:
    """trial_id, basis, bin, v: the inverse of count_vectors, for what a model of latent factors gives back
    in place of counts; missing values have no row."""
    return vectors.unpivot(["trial_id", "bin"], list(bases), "basis", "v").where("v is not null").select("trial_id", "basis", "bin", F.col("v").cast("double").alias("v"))


def relabelled_points(points: DataFrame, labels: DataFrame, by: list[str], label: str = "unit") -> DataFrame:
    """points with label as labels(by, label) say, which a sorter gave back; points that it left out have none."""
    return points.drop(label).join(labels.select(*by, label), by, "left")


def append_same(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both, whose shared columns must have equal types; otherwise ValueError."""
    types = dict(old.dtypes)
    unlike = sorted(c for c, t in new.dtypes if types.get(c, t) != t)
    if unlike:
        raise ValueError(f"columns of different types: {', '.join(unlike)}")
    return append_trials(old, new)
