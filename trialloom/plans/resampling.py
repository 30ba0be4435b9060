"""Queries that resample, filter and look up series, work on arrays, and read and write sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trialloom.functions import arrays, filters
from trialloom.operators import binning, histograms, sequential, series, signals
from trialloom.plans.base import BOTH, events_long, points, samples, trials
from trialloom.plans.registry import query
from trialloom.sources import tables


def _embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _even(spark, sf_dir):
    rows = tables.samples_from_arrays(_embeddings(spark, sf_dir), "vec_id", "embedding")
    return rows.select("trial_id", F.col("i").cast("long").alias("bin"), "t", "v")


_EVEN = "x AS (SELECT vec_id AS trial_id, i - 1 AS bin, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"
_PAIRS = f"""{BOTH}, p AS (SELECT trial_id, t, v, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM ev WINDOW w AS (PARTITION BY trial_id ORDER BY t)), g AS (SELECT trial_id, unnest(range(0, 25)) AS bin FROM tr),
q AS (SELECT g.trial_id, bin, t, v, t1, v1 FROM g JOIN p ON p.trial_id = g.trial_id AND bin * 3600000.0 >= t AND (bin * 3600000.0 < t1 OR (t1 IS NULL AND bin * 3600000.0 = t)))"""


@query(f"{_PAIRS} SELECT trial_id, bin, CASE WHEN t1 - bin * 3600000.0 < bin * 3600000.0 - t THEN v1 ELSE v END AS v FROM q")
def resampled_nearest(spark, sf_dir):
    """At full hours the value of the nearest sample."""
    return binning.resample_nearest(samples(events_long(spark, sf_dir)), 3_600_000.0)


@query(f"{_PAIRS} SELECT trial_id, bin, v FROM q")
def resampled_repeated(spark, sf_dir):
    """At full hours the value of the last sample."""
    return binning.resample_repeated(samples(events_long(spark, sf_dir)), 3_600_000.0)


@query(f"""WITH {_EVEN}, k AS (SELECT k, exp(-k * k / 8.0) AS w FROM (SELECT unnest(range(-6, 7)) AS k)), n AS (SELECT k, w / (SELECT sum(w) FROM k) AS w FROM k)
SELECT trial_id, CAST((bin + k) / 4 AS BIGINT) AS bin, round(sum(v * w), 6) AS v FROM x, n WHERE (bin + k) % 4 = 0 GROUP BY trial_id, bin + k HAVING count(*) = 13""")
def decimated(spark, sf_dir):
    """Every fourth sample after a low pass."""
    return binning.decimate(_even(spark, sf_dir), 4).select("trial_id", "bin", F.round("v", 6).alias("v"))


@query(f"""WITH RECURSIVE {_EVEN}, f AS (SELECT trial_id, bin, v AS x, v AS y FROM x WHERE bin = 0 UNION ALL SELECT x.trial_id, x.bin, x.v, 0.8 * f.y + 0.2 * x.v FROM f JOIN x ON x.trial_id = f.trial_id AND x.bin = f.bin + 1),
r AS (SELECT trial_id, bin, y FROM f WHERE bin = 63 UNION ALL SELECT f.trial_id, f.bin, 0.8 * r.y + 0.2 * f.y FROM r JOIN f ON f.trial_id = r.trial_id AND f.bin = r.bin - 1) SELECT trial_id, bin, round(y, 5) AS y FROM r""")
def zero_phase_filter(spark, sf_dir):
    """A low pass forward and backward, which shifts nothing."""
    out = sequential.filter_series(_even(spark, sf_dir), [0.2], [1.0, -0.8], settled=True, both_ways=True)
    return out.select("trial_id", F.col("t").cast("long").alias("bin"), F.round("y", 5).alias("y"))


@query(f"""WITH RECURSIVE {_EVEN}, f AS (SELECT trial_id, bin, v AS x, v AS y, v AS y1 FROM x WHERE bin = 0 UNION ALL SELECT x.trial_id, x.bin, x.v, 0.9 * f.y - 0.2 * f.y1 + 0.2 * x.v + 0.1 * f.x, f.y FROM f JOIN x ON x.trial_id = f.trial_id AND x.bin = f.bin + 1)
SELECT trial_id, bin, round(y, 5) AS y FROM f""")
def long_filter(spark, sf_dir):
    """A resonant filter along series that are cut into blocks of 20 samples, its last outputs carried on."""
    out = sequential.filter_long_series(_even(spark, sf_dir).select("trial_id", "t", "v"), [0.2, 0.1], [1.0, -0.9, 0.2], block=20)
    return out.select("trial_id", F.col("t").cast("long").alias("bin"), F.round("y", 5).alias("y"))


@query(f"""WITH RECURSIVE {_EVEN}, c AS (SELECT w * w / (1 + sqrt(2) * w + w * w) AS g, 2 * (w * w - 1) / (1 + sqrt(2) * w + w * w) AS a1, (1 - sqrt(2) * w + w * w) / (1 + sqrt(2) * w + w * w) AS a2 FROM (SELECT tan(pi() * 5 / 50) AS w)),
u AS (SELECT trial_id, bin, g * (v + 2 * coalesce(lag(v) OVER o, 0) + coalesce(lag(v, 2) OVER o, 0)) AS u FROM x, c WINDOW o AS (PARTITION BY trial_id ORDER BY bin)),
f AS (SELECT trial_id, bin, u AS y, CAST(0 AS DOUBLE) AS y1 FROM u WHERE bin = 0 UNION ALL SELECT u.trial_id, u.bin, u.u - c.a1 * f.y - c.a2 * f.y1, f.y FROM f JOIN u ON u.trial_id = f.trial_id AND u.bin = f.bin + 1, c) SELECT trial_id, bin, round(y, 5) AS y FROM f""")
def butterworth_filter(spark, sf_dir):
    """A Butterworth low pass of second order at a tenth of the rate, from rest."""
    out = sequential.filter_series(_even(spark, sf_dir), *filters.butterworth(2, 5.0, 50.0), settled=False)
    return out.select("trial_id", F.col("t").cast("long").alias("bin"), F.round("y", 5).alias("y"))


@query(f"""{BOTH}, v AS (SELECT trial_id, t, v, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM ev WHERE event = 'view' WINDOW w AS (PARTITION BY trial_id ORDER BY t)),
q AS (SELECT trial_id, t FROM ev WHERE event = 'purchase') SELECT q.trial_id, round(q.t, 3) AS t, round(max(v.v + (v1 - v.v) * (q.t - v.t) / (t1 - v.t)), 6) AS v FROM q LEFT JOIN v ON v.trial_id = q.trial_id AND q.t >= v.t AND q.t <= t1 GROUP BY 1, 2""")
def interpolated_lookup(spark, sf_dir):
    """What views' values are at purchases, between the views before and after."""
    ev = events_long(spark, sf_dir)
    got = series.interpolated_lookup(points(ev, "purchase"), samples(ev.where("event = 'view'")))
    return got.select("trial_id", F.round("t", 3).alias("t"), F.round("v", 6).alias("v"))


@query(f"""{BOTH}, tt AS (SELECT trial_id, t FROM ev WHERE event IN ('view', 'click')), a AS (SELECT trial_id, event, t, v, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM ev WHERE event IN ('view', 'click') WINDOW w AS (PARTITION BY trial_id, event ORDER BY t)),
j AS (SELECT tt.trial_id, tt.t, event, CASE WHEN tt.t = a.t THEN a.v ELSE a.v + (v1 - a.v) * (tt.t - a.t) / (t1 - a.t) END AS v FROM tt JOIN a ON a.trial_id = tt.trial_id AND (tt.t = a.t OR (tt.t > a.t AND tt.t < t1)))
SELECT tt.trial_id, round(tt.t, 3) AS t, round(max(v) FILTER (event = 'view'), 6) AS "view", round(max(v) FILTER (event = 'click'), 6) AS click FROM tt LEFT JOIN j ON j.trial_id = tt.trial_id AND j.t = tt.t GROUP BY tt.trial_id, tt.t""")
def channels_interpolated(spark, sf_dir):
    """Two channels at the times of either, between their own samples."""
    s = events_long(spark, sf_dir).select("trial_id", F.col("event").alias("channel"), "t", "v")
    got = signals.interpolated_times(s, ["view", "click"])
    return got.select("trial_id", F.round("t", 3).alias("t"), F.round("view", 6).alias("view"), F.round("click", 6).alias("click"))


@query(f"{BOTH} SELECT trial_id, floor(t / 3600000) AS hour, round(avg(v), 6) AS v FROM ev GROUP BY 1, 2")
def one_per_time(spark, sf_dir):
    """Samples of the same hour as one."""
    s = samples(events_long(spark, sf_dir)).withColumn("t", F.floor(F.col("t") / 3_600_000).cast("double"))
    return series.one_per_time(s).select("trial_id", F.col("t").alias("hour"), F.round("v", 6).alias("v"))


@query(f"{BOTH} SELECT event_id, round(avg(v) OVER (PARTITION BY trial_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS v FROM ev")
def smoothed_series(spark, sf_dir):
    """Means of three neighbouring samples."""
    return series.smoothed(events_long(spark, sf_dir), 3).select("event_id", F.round("v", 6).alias("v"))


@query(f"{BOTH}, b AS (SELECT trial_id, t - 600000 AS t0, t + 600000 AS t1 FROM ev WHERE event = 'error') SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.trial_id = ev.trial_id AND ev.t BETWEEN t0 - 60000 AND t1 + 60000) THEN NULL ELSE v END AS v FROM ev")
def blanked_samples(spark, sf_dir):
    """No values within eleven minutes of an error."""
    ev = events_long(spark, sf_dir)
    blanks = points(ev, "error").select("trial_id", (F.col("t") - 600_000).alias("t0"), (F.col("t") + 600_000).alias("t1"))
    return series.blank_samples(ev.select("trial_id", "event_id", "t", "v"), blanks, 60_000).select("event_id", "v")


@query(f"""WITH {_EVEN}, a AS (SELECT trial_id, bin AS i, v FROM x WHERE bin < 40), b AS (SELECT trial_id - 1 AS trial_id, bin AS i, v FROM x WHERE bin >= 20),
g AS (SELECT trial_id, arg_min(i, struct_pack(d := round(abs(a.v - b.v), 9), i := i)) AS place FROM a JOIN b USING (trial_id, i) GROUP BY 1)
SELECT trial_id, i, v FROM a JOIN g USING (trial_id) WHERE i < place UNION ALL SELECT trial_id, i, v FROM b JOIN g USING (trial_id) WHERE i >= place""")
def spliced_series(spark, sf_dir):
    """One series up to where the next comes nearest, and that from there on."""
    rows = _even(spark, sf_dir).withColumnRenamed("bin", "i").drop("t")
    return signals.splice(rows.where("i < 40"), rows.where("i >= 20").withColumn("trial_id", F.col("trial_id") - 1), ["trial_id"], ["v"])


@query("""WITH h AS (SELECT o_custkey % 7 AS site, o_orderstatus, floor(o_totalprice / 500) * 500 AS edge, count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1, 2, 3)
SELECT o_orderstatus, min(least) AS low, max(most) AS high, round(sum(edge * n) / sum(n), 4) AS mean, round(sqrt((sum(edge * edge * n) - sum(edge * n) * sum(edge * n) / sum(n)) / (sum(n) - 1)), 3) AS std, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1""")
def histogram_extremes(spark, sf_dir):
    """Histograms of several sites merged for each status, with true extremes and the deviation of the bins."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("site", F.col("o_custkey") % 7)
    h = histograms.merge_with_extremes(histograms.histogram_with_extremes(o, "o_totalprice", 500.0, ["site", "o_orderstatus"]), ["o_orderstatus"])
    return histograms.extremes(h, ["o_orderstatus"]).select("o_orderstatus", "low", "high", F.round("mean", 4).alias("mean"), F.round("std", 3).alias("std"), "n")


@query("""SELECT vec_id, len(embedding[1:5]) AS five, round(CAST(embedding[3] AS DOUBLE) + CAST(embedding[1] AS DOUBLE), 6) AS picked, CAST(ceil(len(embedding) / 10.0) AS BIGINT) AS parts, len(list_filter(embedding, lambda x: x > 0)) AS positive,
round(list_sum(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x > 0)), 6) AS inflated, 2 * len(embedding) AS twice FROM embeddings""")
def array_shapes(spark, sf_dir):
    """Arrays cut, picked, split, masked, inflated and repeated."""
    x = F.col("embedding")
    mask = F.transform(x, lambda v: v > 0)
    back = arrays.inflated(arrays.masked(x, mask), mask)
    total = F.aggregate(back, F.lit(0.0), lambda s, v: s + F.coalesce(v.cast("double"), F.lit(0.0)))
    pick = arrays.picked(x, [2, 0])
    return _embeddings(spark, sf_dir).select(
        "vec_id", F.size(arrays.padded(x, 5)).alias("five"), F.round(pick[0].cast("double") + pick[1].cast("double"), 6).alias("picked"), F.size(arrays.split(x, 10)).alias("parts"),
        F.size(arrays.masked(x, mask)).alias("positive"), F.round(total, 6).alias("inflated"), F.size(arrays.repeated(x, 2)).alias("twice"),
    )


@query(f"""{BOTH}, s AS (SELECT user_id, event_id, event, trial_id, t, sum(CASE WHEN event = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY trial_id, t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM ev),
e AS (SELECT *, max(CASE WHEN event = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, session ORDER BY trial_id, t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over FROM s)
SELECT user_id, session, count(*) AS n FROM e WHERE session > 0 AND coalesce(over, 0) = 0 GROUP BY 1, 2""")
def sessions_between(spark, sf_dir):
    """A user's events from a signup to the first purchase after it."""
    ev = events_long(spark, sf_dir)
    got = tables.sessions_between(ev, F.col("event") == "signup", F.col("event") == "purchase", "user_id", ["trial_id", "t", "event_id"])
    return got.groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("SELECT l_partkey AS cluster, round(l_extendedprice / 30, 6) AS t FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 3 IN (0, 1))")
def sorted_clusters(spark, sf_dir):
    """Points of clusters that were judged good, from samples to milliseconds."""
    spikes = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("cluster"), F.col("l_extendedprice").alias("sample"))
    quality = F.element_at(F.array(F.lit("good"), F.lit("mua"), F.lit("noise")), (F.col("p_partkey") % 3 + 1).cast("int"))
    clusters = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("cluster"), quality.alias("quality"))
    got = tables.spikes_from_clusters(spikes, clusters, ["good", "mua"], 30.0)
    return got.select("cluster", F.round("t", 6).alias("t"))


@query(f"{BOTH} SELECT trial_id, CAST(floor(t / 14400000) AS BIGINT) AS bin, count(*) FILTER (event = 'view') AS \"view\", count(*) FILTER (event = 'click') AS click FROM ev WHERE event IN ('view', 'click') GROUP BY 1, 2")
def count_vectors(spark, sf_dir):
    """Counts of two kinds of events side by side, as models of latent factors take them in."""
    ev = events_long(spark, sf_dir)
    counts = ev.groupBy("trial_id", F.col("event").alias("basis"), F.floor(F.col("t") / 14_400_000).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return tables.count_vectors(counts, ["view", "click"])


@query(f"{BOTH} SELECT unit, count(*) AS n FROM (SELECT CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 4 END AS unit FROM ev) GROUP BY 1")
def relabelled_points(spark, sf_dir):
    """Labels that a sorter gave back, joined to the points that it had."""
    ev = events_long(spark, sf_dir)
    labels = ev.where("event_id % 5 <> 0").select("event_id", (F.col("event_id") % 4).alias("unit"))
    return tables.relabelled_points(ev.select("event_id", "trial_id", "t"), labels, ["event_id"]).groupBy("unit").agg(F.count("*").alias("n"))


@query(f"{BOTH} SELECT cond, count(*) AS n, CAST(sum(n_events) AS BIGINT) AS events FROM tr WHERE cond <> 0 GROUP BY 1")
def partitioned_set(spark, sf_dir):
    """Trials saved by condition, whose partitions are listed; a set of another data set is borrowed."""
    tr = trials(events_long(spark, sf_dir))
    path = f"{tables.shared_dir(spark)}/partitioned-{uuid.uuid4().hex}"
    source = tables.TrialSource("days", {"cond": "long", "user_id": "long"})
    tables.save({"trials": source.read(tr), "counts": tr.select("trial_id", "n_events")}, path, {"trials": "cond"})
    held = tables.partitions(spark, path, "trials", "cond").where("cond <> 0")
    events = tables.borrowed(spark, spark.read.parquet(f"{path}/trials"), path, "counts").groupBy("cond").agg(F.sum("n_events").alias("events"))
    return held.join(events, "cond").select(F.col("cond").cast("long").alias("cond"), "n", "events")
