"""Queries on values of series and on several channels at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.functions import stats
from trialloom.operators import contrasts, histograms, population, randomise, signals, timecourse
from trialloom.plans.base import BOTH, events_long, samples, trials
from trialloom.plans.registry import query


@query("SELECT l_orderkey, l_linenumber, greatest(1000.0, least(50000.0, l_extendedprice)) AS held, CASE WHEN l_extendedprice BETWEEN 1000 AND 50000 THEN l_extendedprice END AS kept FROM lineitem")
def clipped_values(spark, sf_dir):
    x = F.col("l_extendedprice")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", signals.clip(x, 1000.0, 50_000.0).alias("held"), signals.clip(x, 1000.0, 50_000.0, True).alias("kept"))


_STATE = f"""{BOTH}, s AS (SELECT trial_id, t, coalesce(last_value(CASE WHEN v >= 60 THEN true WHEN v < 30 THEN false END IGNORE NULLS) OVER (PARTITION BY trial_id ORDER BY t ROWS UNBOUNDED PRECEDING), false) AS up FROM ev)"""


@query(f"{_STATE} SELECT trial_id, round(t, 3) AS t, up AS on_state FROM s")
def hysteresis(spark, sf_dir):
    """A state that rises at 60 and falls below 30."""
    return signals.hysteresis(samples(events_long(spark, sf_dir)), 30.0, 60.0).select("trial_id", F.round("t", 3).alias("t"), F.col("on").alias("on_state"))


@query(f"""{_STATE}, m AS (SELECT *, CASE WHEN up IS DISTINCT FROM lag(up) OVER (PARTITION BY trial_id ORDER BY t) THEN 1 ELSE 0 END AS n FROM s), r AS (SELECT *, sum(n) OVER (PARTITION BY trial_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT trial_id, round(min(t), 3) AS t0, round(max(t), 3) AS t1, count(*) AS n FROM r WHERE up GROUP BY trial_id, run""")
def state_runs(spark, sf_dir):
    """Stretches in which the state is on."""
    got = signals.runs(signals.hysteresis(samples(events_long(spark, sf_dir)), 30.0, 60.0))
    return got.select("trial_id", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"), "n")


@query(f"""{BOTH}, w AS (SELECT trial_id, t, CASE WHEN event = 'view' THEN v END AS a, CASE WHEN event = 'click' THEN v END AS b FROM ev WHERE event IN ('view', 'click'))
SELECT trial_id, round(t, 3) AS t, last_value(a IGNORE NULLS) OVER x AS "view", last_value(b IGNORE NULLS) OVER x AS click FROM w WINDOW x AS (PARTITION BY trial_id ORDER BY t ROWS UNBOUNDED PRECEDING)""")
def channels_side_by_side(spark, sf_dir):
    """Two channels at the times of either."""
    s = events_long(spark, sf_dir).select("trial_id", F.col("event").alias("channel"), "t", "v")
    return signals.common_times(s, ["view", "click"]).select("trial_id", F.round("t", 3).alias("t"), "view", "click")


@query("""WITH x AS (SELECT label, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)) SELECT label, i, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(v) AS n FROM x GROUP BY 1, 2""")
def mean_waveforms(spark, sf_dir):
    """Mean waveform of every label."""
    got = signals.mean_waveform(spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("embedding", F.col("embedding").cast("array<double>")), ["label"], "embedding")
    return got.select("label", "i", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 0.5 - CAST(embedding[2] AS DOUBLE) * 0.25 + CAST(embedding[3] AS DOUBLE), 6) AS x FROM embeddings")
def linear_combination(spark, sf_dir):
    """A weighted sum of the first three of a group of channels."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("three", F.slice("embedding", 1, 3))
    return e.select("vec_id", F.round(signals.combine("three", [0.5, -0.25, 1.0]), 6).alias("x"))


@query(f"""{BOTH} SELECT trial_id, round(t, 3) AS t, v FROM ev WHERE event <> 'error' AND NOT (t BETWEEN 36000000 AND 50400000) UNION ALL SELECT trial_id, round(t, 3), -v FROM ev WHERE event = 'error' AND t BETWEEN 36000000 AND 50400000""")
def overwritten_window(spark, sf_dir):
    """Samples between ten and two are replaced by another series."""
    ev = events_long(spark, sf_dir)
    w = trials(ev).select("trial_id", F.lit(36_000_000.0).alias("t0"), F.lit(50_400_000.0).alias("t1"))
    new = ev.where("event = 'error'").select("trial_id", "t", (-F.col("v")).alias("v"))
    return signals.overwrite(samples(ev.where("event <> 'error'")), new, w).select("trial_id", F.round("t", 3).alias("t"), "v")


@query("""WITH x AS (SELECT label, vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)), m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY 1, 2),
l AS (SELECT a.label, lag, round(corr(a.v, b.v), 9) AS r FROM m a, m b, (SELECT unnest(range(-4, 5)) AS lag) WHERE a.label = b.label AND a.i = b.i + lag + 2 AND b.i + 2 BETWEEN 3 AND 66 GROUP BY 1, 2)
SELECT label, arg_max(lag, struct_pack(r := r, m := -lag)) AS lag, round(max(r), 6) AS r FROM l GROUP BY label""")
def lag_search(spark, sf_dir):
    """The shift that brings a copy of each mean waveform, moved by two, back into place."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("embedding", F.col("embedding").cast("array<double>"))
    m = signals.mean_waveform(e, ["label"], "embedding").select("label", "i", F.col("mean").alias("v"))
    got = signals.best_lag(m, m.withColumn("i", F.col("i") + 2), ["label"], 4)
    return got.select("label", "lag", F.round("r", 6).alias("r"))


@query(f"""{BOTH}, p AS (SELECT trial_id, event AS unit, t, event_id, CAST(floor(t / 3600000) AS BIGINT) AS bin FROM ev), m AS (SELECT trial_id, bin FROM p GROUP BY 1, 2 HAVING count(DISTINCT unit) >= 2) SELECT event_id FROM p JOIN m USING (trial_id, bin)""")
def shared_artifacts(spark, sf_dir):
    """Points within the same hour as points of another unit."""
    p = events_long(spark, sf_dir).select("trial_id", F.col("event").alias("unit"), "t", "event_id")
    return signals.shared_artifacts(p, 3_600_000.0, 2).select("event_id")


@query("""WITH h AS (SELECT floor(o_totalprice / 5000) * 5000 AS edge, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT unnest([50000.0, 150000.0, 250000.0]) AS x)
SELECT CAST(x AS DOUBLE) AS x, round(1e6 * sum(n * exp(-((x - edge) / 20000) * ((x - edge) / 20000) / 2)) / sum(n) / (20000 * sqrt(2 * pi())), 6) AS density FROM h, x GROUP BY x""")
def density_estimate(spark, sf_dir):
    """Kernel density of prices from their histogram, per million."""
    h = histograms.histogram(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_totalprice", 5000.0)
    return signals.density(h, [50_000.0, 150_000.0, 250_000.0], 20_000.0).select("x", F.round(F.col("density") * 1e6, 6).alias("density"))


@query("""WITH g AS (SELECT l_returnflag AS flag, l_extendedprice AS x, l_quantity AS y FROM lineitem)
SELECT flag, round(avg(x) / avg(y), 6) AS ratio, round(sqrt((var_samp(x) / (avg(y) * avg(y)) - 2 * avg(x) * covar_samp(x, y) / (avg(y) * avg(y) * avg(y)) + avg(x) * avg(x) * var_samp(y) / (avg(y) * avg(y) * avg(y) * avg(y))) / count(*)), 6) AS sem FROM g GROUP BY flag""")
def ratio_error(spark, sf_dir):
    """A ratio of means with its error by the delta method."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    got = li.groupBy(F.col("l_returnflag").alias("flag")).agg(*signals.ratio_sem("l_extendedprice", "l_quantity"))
    return got.select("flag", F.round("ratio", 6).alias("ratio"), F.round("sem", 6).alias("sem"))


@query(f"""{BOTH}, o AS (SELECT trial_id, cond, row_number() OVER (PARTITION BY cond ORDER BY trial_id) - 1 AS i, count(*) OVER (PARTITION BY cond) AS n FROM tr),
d AS (SELECT draw, cond, CAST(('0x' || substr(md5((1 + draw) || ':' || cond || ':' || i), 1, 8)) AS BIGINT) % n AS j FROM o, (SELECT unnest(range(0, 20)) AS draw)),
m AS (SELECT d.draw, d.cond, avg(t.n_events) AS m FROM d JOIN o ON o.cond = d.cond AND o.i = d.j JOIN tr t ON t.trial_id = o.trial_id GROUP BY 1, 2),
k AS (SELECT cond, m, row_number() OVER (PARTITION BY cond ORDER BY m) AS k FROM m)
SELECT cond, round(max(CASE WHEN k = 1 THEN m END) * 0.5 + max(CASE WHEN k = 2 THEN m END) * 0.5, 6) AS low, round(max(CASE WHEN k = 19 THEN m END) * 0.5 + max(CASE WHEN k = 20 THEN m END) * 0.5, 6) AS high FROM k GROUP BY cond""")
def bootstrap_band(spark, sf_dir):
    """The band from the 5th to the 95th hundredth of twenty resampled means."""
    tr = trials(events_long(spark, sf_dir))
    draws = randomise.bootstrap(tr.select("trial_id", "cond"), 20, 1).join(tr.select("trial_id", "n_events"), "trial_id")
    m = draws.groupBy("draw", "cond").agg(F.avg("n_events").alias("m"))
    return m.groupBy("cond").agg(F.round(stats.hazen_quantile("m", 0.05), 6).alias("low"), F.round(stats.hazen_quantile("m", 0.95), 6).alias("high"))


@query("""WITH x AS (SELECT label AS cond, i - 1 AS basis, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2), z AS (SELECT cond, basis, m - avg(m) OVER (PARTITION BY basis) AS z FROM x),
p AS (SELECT cond, sum(z) / 8 AS s FROM z GROUP BY cond), r AS (SELECT z.cond, z.z, z.z - p.s / 8 AS e FROM z JOIN p USING (cond)) SELECT round(sum(z * z), 6) AS total, round(1 - sum(e * e) / sum(z * z), 6) AS explained FROM r""")
def variance_explained(spark, sf_dir):
    """The share of variance along one direction, by what its reconstruction leaves over."""
    cube = population.population(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "label", "embedding")
    return population.variance_explained(cube, cube.select("basis").distinct().withColumn("w", F.lit(1 / 8))).select(F.round("total", 6).alias("total"), F.round("explained", 6).alias("explained"))


@query(f"""{BOTH}, m AS (SELECT cond, k % 6 AS t, avg(n_events) AS x FROM tr GROUP BY 1, 2) SELECT t, count(*) AS n, min_by(cond, x) AS lowest, max_by(cond, x) AS highest, round(max(x) - min(x), 6) AS depth FROM m GROUP BY t""")
def tuning_depth(spark, sf_dir):
    """At each time the conditions with the lowest and highest mean, and how far they lie apart."""
    m = trials(events_long(spark, sf_dir)).withColumn("t", F.col("k") % 6).groupBy("cond", "t").agg(F.avg("n_events").alias("mean"))
    return timecourse.tuning_depth(m, ["t"]).select("t", "n", "lowest", "highest", F.round("depth", 6).alias("depth"))


@query("""SELECT CAST(o_orderstatus AS VARCHAR) AS o_orderstatus, round(regr_slope(o_totalprice, o_custkey), 6) AS slope, round(regr_intercept(o_totalprice, o_custkey), 4) AS intercept FROM orders GROUP BY 1""")
def linear_fit(spark, sf_dir):
    """A straight line for each condition."""
    return contrasts.linear_fit(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", "o_totalprice", ["o_orderstatus"]).select("o_orderstatus", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))
