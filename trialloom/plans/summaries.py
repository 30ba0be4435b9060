"""Queries on catalogs of channels, suppressed conditions and summaries of alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.operators import catalog, randomise, windows
from trialloom.operators import conditions as C
from trialloom.plans.alignment import AROUND, CLICKS
from trialloom.plans.base import BOTH, events_long, trials
from trialloom.plans.registry import query


@query("SELECT * FROM (VALUES ('vec_id', 'param', 'bigint'), ('embedding', 'series', 'float'), ('label', 'param', 'int')) AS x(channel, kind, element)")
def inferred_channels(spark, sf_dir):
    """Channels of a table by their types."""
    return catalog.infer(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal, TRY_CAST(c_mktsegment AS INTEGER) AS c_mktsegment, CAST(NULL AS VARCHAR) AS subject FROM customer")
def conformed_schema(spark, sf_dir):
    """A table brought to a schema: casts that fail and columns that lack are missing values."""
    schema = {"c_custkey": "long", "c_acctbal": "double", "c_mktsegment": "int", "subject": "string"}
    return catalog.conform(spark.read.parquet(f"{sf_dir}/customer.parquet"), schema, {"c_custkey"})


@query(f"{BOTH}, o AS (SELECT trial_id, list(round(t, 3) ORDER BY t) AS ts FROM ev GROUP BY 1) SELECT trial_id, ts[1] AS first, ts[len(ts)] AS last, len(ts) AS n FROM o")
def ordered_series(spark, sf_dir):
    """Arrays of samples brought into order of time."""
    ev = events_long(spark, sf_dir)
    rows = ev.groupBy("trial_id").agg(F.collect_list("t").alias("ts"), F.collect_list("v").alias("vs"))
    got = catalog.in_order(rows, "ts", "vs")
    return got.select("trial_id", F.round(F.get("ts", F.lit(0)), 3).alias("first"), F.round(F.try_element_at("ts", F.lit(-1)), 3).alias("last"), F.size("ts").alias("n"))


@query(f"{BOTH} SELECT cond, count(*) AS n FROM tr WHERE cond NOT IN (1) GROUP BY 1")
def suppressed_conditions(spark, sf_dir):
    tr = trials(events_long(spark, sf_dir))
    return C.suppress(tr, [1]).groupBy("cond").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def values_only_in(spark, sf_dir):
    p, li = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem"))
    return C.values_only_in(p, li.where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query(f"""{CLICKS} SELECT cond, CAST(floor((start - zero) / 1800000) AS BIGINT) AS bin, count(*) AS n, round(min(stop - zero), 3) AS least_stop, round(max(stop - zero), 3) AS most_stop
FROM al JOIN tr USING (trial_id) GROUP BY GROUPING SETS ((1, 2), (2))""")
def alignment_summary(spark, sf_dir):
    """Where windows begin and end relative to zero, by condition and over all."""
    ev = events_long(spark, sf_dir)
    tr = trials(ev)
    al = windows.align(tr, ev, AROUND).where("valid").join(tr.select("trial_id", "cond"), "trial_id")
    rows = al.select("cond", F.floor((F.col("start") - F.col("zero")) / 1_800_000).alias("bin"), (F.col("stop") - F.col("zero")).alias("stop"))
    return rows.groupingSets([["cond", "bin"], ["bin"]], "cond", "bin").agg(F.count("*").alias("n"), F.round(F.min("stop"), 3).alias("least_stop"), F.round(F.max("stop"), 3).alias("most_stop"))


@query(f"""{BOTH}, k AS (SELECT cond, n_events, md5('4:' || trial_id) AS m FROM tr), x AS (SELECT cond, arg_min(n_events, m) AS a, arg_max(n_events, m) AS b, count(*) AS n FROM k GROUP BY 1) SELECT cond, round((a - b) / sqrt(2.0 * n), 6) AS diff FROM x""")
def noise_by_pairs(spark, sf_dir):
    """Noise of each condition's mean from two trials drawn by hash."""
    tr = trials(events_long(spark, sf_dir))
    return randomise.pair_differences(tr, "cond", "n_events", 4).select("cond", F.round("diff", 6).alias("diff"))
