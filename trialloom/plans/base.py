"""How the driver's tables play trials: a trial is one user's day, its events the day's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.sources.tables import read_table

DAY = 86_400_000.0

#: The same as events_long() and trials() below.
EV = """ev AS (
  SELECT user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS trial_id, user_id,
         CAST(epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS DOUBLE) / 1000 AS t, event_type AS event, value AS v,
         event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY ts, event_id) AS occ
  FROM events)"""
TR = """tr AS (
  SELECT trial_id, min(user_id) AS user_id, CAST(0 AS DOUBLE) AS t_start, CAST(86400000 AS DOUBLE) AS t_end,
         count(*) AS n_events, min(k) AS k, min_by(event, t) AS first_event, min(user_id) % 3 AS cond
  FROM ev GROUP BY trial_id)"""
BOTH = f"WITH {EV}, {TR}"


def events_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial_id, user_id, event_id, t (ms since midnight), event, v, k, occ (from 1, by time)."""
    ts = F.col("ts")
    micros = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1_000_000 + (F.expr("extract(SECOND FROM ts)") * 1_000_000).cast("long")
    rows = read_table(spark, sf_dir, "events").select(
        (F.col("user_id") * 100_000 + F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))).alias("trial_id"),
        "user_id",
        "event_id",
        (micros.cast("double") / 1000).alias("t"),
        F.col("event_type").alias("event"),
        F.col("value").alias("v"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    return rows.withColumn("occ", F.row_number().over(W.partitionBy("trial_id", "event").orderBy("t", "event_id")))


def trials(events: DataFrame) -> DataFrame:
    """trial_id, user_id, t_start, t_end, n_events, k, first_event, cond (user_id mod 3)."""
    rows = events.groupBy("trial_id").agg(F.min("user_id").alias("user_id"), F.count("*").alias("n_events"), F.min("k").alias("k"), F.min_by("event", "t").alias("first_event"))
    return rows.withColumns({"t_start": F.lit(0.0), "t_end": F.lit(DAY), "cond": F.col("user_id") % 3})


def points(events: DataFrame, event: str) -> DataFrame:
    return events.where(F.col("event") == event).select("trial_id", "t", "occ")


def samples(events: DataFrame) -> DataFrame:
    """The events' values as an irregular series."""
    return events.select("trial_id", "t", "v")
