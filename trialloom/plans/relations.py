"""Queries on catalogs, joins, unions and schema changes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trialloom.operators import catalog, joins
from trialloom.plans.base import BOTH, events_long, trials
from trialloom.plans.registry import query
from trialloom.sources import tables


@query("SELECT event_type AS channel, 'event' AS kind, count(*) AS n FROM events WHERE regexp_matches(event_type, '^(c|p)') GROUP BY 1")
def catalog_channels(spark, sf_dir):
    """Channels whose names match a pattern."""
    return catalog.channels(events_long(spark, sf_dir), pattern="^(c|p)")


@query("SELECT 'src' || (l_suppkey % 4) || '_' || (l_suppkey % 3) AS name, l_suppkey % 4 AS electrode, l_suppkey % 3 AS unit, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def structured_names(spark, sf_dir):
    """Electrode and unit parsed from structured channel names."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    named = li.select(F.concat(F.lit("src"), F.col("l_suppkey") % 4, F.lit("_"), F.col("l_suppkey") % 3).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return catalog.parse_names(named).select("name", "electrode", "unit", "n")


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_quantity * 0.5 - 3, 6) AS DOUBLE) AS scaled FROM lineitem")
def affine_scaling(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", F.round(catalog.scale(F.col("l_quantity"), (0.0, 2.0), (-3.0, -2.0)), 6).alias("scaled"))


@query("SELECT CASE l_returnflag WHEN 'A' THEN 'X' WHEN 'R' THEN 'X' ELSE l_returnflag END AS unit, count(*) AS n FROM lineitem GROUP BY 1")
def relabelled_units(spark, sf_dir):
    """Units that a table maps to one name are joined."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_returnflag", "unit")
    return catalog.relabel(li, {"A": "X", "R": "X"}).groupBy("unit").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem)
SELECT o_orderkey, l_extendedprice AS price, coalesce(c, 0) AS matches FROM orders LEFT JOIN m ON o_orderkey = l_orderkey AND r = 1""")
def first_match_join(spark, sf_dir):
    """Each order with its first line, and how many there were to choose from."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    got = joins.first_match(o.select("o_orderkey"), li, ["o_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return got.select("o_orderkey", F.col("l_extendedprice").alias("price"), "matches")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(spark, sf_dir):
    """Customers that stay because another table has them."""
    c, n, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "orders"))
    big = o.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(big, "c_custkey", "left_semi").join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", "n_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join(spark, sf_dir):
    c, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    return c.join(o.where("o_totalprice > 400000"), c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("SELECT s_suppkey AS id, s_acctbal AS balance, 'supplier' AS origin, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, 'customer', c_mktsegment FROM customer")
def append_trials(spark, sf_dir):
    """Rows of two sources with a tag; a column that one lacks is missing there."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("origin"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("origin"), F.col("c_mktsegment").alias("segment"))
    return tables.append_trials(s, c)


@query(f"{BOTH} SELECT trial_id, user_id, n_events, first_event FROM tr")
def trial_table(spark, sf_dir):
    """Trials with their parameters from a stream of events."""
    return trials(events_long(spark, sf_dir)).select("trial_id", "user_id", "n_events", "first_event")


@query(f"""{BOTH}, h AS (SELECT user_id, trial_id, t_start + 28800000 AS a, t_start + 61200000 AS b FROM tr) SELECT h.trial_id, event_id, round(t - a, 3) AS t FROM h JOIN ev ON ev.trial_id = h.trial_id AND t BETWEEN a AND b""")
def assigned_to_trials(spark, sf_dir):
    """Events inside working hours, timed from their begin."""
    ev = events_long(spark, sf_dir)
    hours = trials(ev).select(F.col("trial_id").alias("day"), "trial_id", F.lit(28_800_000.0).alias("t_start"), F.lit(61_200_000.0).alias("t_end"))
    got = tables.assign_to_trials(ev.select(F.col("trial_id").alias("day"), "event_id", "t"), hours, "day")
    return got.select("trial_id", "event_id", F.round("t", 3).alias("t"))


@query("SELECT vec_id AS trial_id, i - 1 AS i, (i - 1) * 2.0 + 10.0 AS t, round(CAST(embedding[i] AS DOUBLE), 6) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)")
def tensor_to_samples(spark, sf_dir):
    """A dense table of arrays as long samples."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return tables.samples_from_arrays(e, "vec_id", "embedding", 2.0, 10.0).select("trial_id", "i", "t", F.round("v", 6).alias("v"))


@query("""WITH d AS (SELECT DISTINCT o_totalprice AS x FROM orders), g AS (SELECT x, x - lag(x) OVER (ORDER BY x) AS gap, max(abs(x)) OVER () AS top FROM d) SELECT x FROM g WHERE gap IS NULL OR gap > 0.0002 * top""")
def distinct_with_tolerance(spark, sf_dir):
    """Prices that differ from the next smaller one by more than a five thousandth of the largest."""
    from trialloom.operators.conditions import distinct_with_tolerance as distinct

    return distinct(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_totalprice", 0.0002)


@query(f"{BOTH} SELECT trial_id, count(*) AS n FROM ev WHERE cast(user_id AS BIGINT) % 2 = 0 GROUP BY 1")
def saved_and_loaded(spark, sf_dir):
    """Trials saved as sets of channels and read back, one set and some trials only."""
    ev = events_long(spark, sf_dir)
    path = f"{tables.shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    tables.save({"trials": trials(ev), "counts": ev.groupBy("trial_id").agg(F.count("*").alias("n"))}, path)
    return tables.load(spark, path, ["trials", "counts"], F.col("user_id") % 2 == 0).select("trial_id", "n")
