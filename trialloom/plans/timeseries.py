"""Queries on the order of points and samples along a trial."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.functions import kernels
from trialloom.operators import binning, sequential, series, timecourse
from trialloom.plans.base import BOTH, events_long, points, samples, trials
from trialloom.plans.registry import query


@query(f"{BOTH} SELECT trial_id, event, occ, round(t, 3) AS t FROM ev WHERE occ BETWEEN 2 AND 3")
def nth_events(spark, sf_dir):
    """Second and third occurrence of every event of a trial."""
    return series.occurrences(events_long(spark, sf_dir), 2, 3).select("trial_id", "event", "occ", F.round("t", 3).alias("t"))


@query(f"""{BOTH} SELECT tr.trial_id, count(c.t) AS n, count(c.t) > 0 AS has, round(min(c.t), 3) AS first, round(max(c.t), 3) AS last
FROM tr LEFT JOIN ev c ON c.trial_id = tr.trial_id AND c.event = 'click' GROUP BY 1""")
def event_summary(spark, sf_dir):
    """Count, existence, first and last click of every trial."""
    ev = events_long(spark, sf_dir)
    return series.event_summary(trials(ev), ev, "click").select("trial_id", "n", "has", F.round("first", 3).alias("first"), F.round("last", 3).alias("last"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN lag(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS price_back FROM orders""")
def n_back(spark, sf_dir):
    """The price two orders of the customer earlier, NULL where this or that order is pending."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", series.previous(orders, "o_totalprice", 2, F.col("o_orderstatus") != "P", ["o_custkey", "o_orderkey"]).alias("price_back"))


@query(f"{BOTH}, g AS (SELECT t - lag(t) OVER (PARTITION BY trial_id ORDER BY t) AS gap FROM ev) SELECT CAST(floor(gap / 1800000) AS BIGINT) AS bin, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1")
def isi_histogram(spark, sf_dir):
    """Gaps between events of a trial in bins of half an hour."""
    gaps = series.intervals_between(events_long(spark, sf_dir))
    return gaps.groupBy(F.floor(F.col("gap") / 1_800_000).alias("bin")).agg(F.count("*").alias("n"))


_SPANS = f"{BOTH}, iv AS (SELECT trial_id, t AS t0, t + 3600000.0 * (1 + k % 3) AS t1 FROM ev WHERE event IN ('view', 'click'))"


def _spans(ev):
    return ev.where("event in ('view', 'click')").select("trial_id", F.col("t").alias("t0"), (F.col("t") + 3_600_000.0 * (1 + F.col("k") % 3)).alias("t1"))


_MERGED = f"""{_SPANS}, mk AS (SELECT *, CASE WHEN t0 > max(t1) OVER (PARTITION BY trial_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM iv),
isl AS (SELECT *, sum(new) OVER (PARTITION BY trial_id ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS i FROM mk),
mg AS (SELECT trial_id, min(t0) AS t0, max(t1) AS t1 FROM isl GROUP BY trial_id, i)"""


@query(f"{_MERGED} SELECT trial_id, round(t0, 3) AS t0, round(t1, 3) AS t1 FROM mg")
def merged_intervals(spark, sf_dir):
    """Overlapping intervals of a trial become one."""
    return series.merge_intervals(_spans(events_long(spark, sf_dir))).select("trial_id", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"))


@query(f"{_MERGED} SELECT trial_id, event_id FROM ev WHERE event = 'purchase' AND NOT EXISTS (SELECT 1 FROM iv WHERE iv.trial_id = ev.trial_id AND ev.t BETWEEN t0 AND t1)")
def blanked_points(spark, sf_dir):
    """Purchases outside of all intervals."""
    ev = events_long(spark, sf_dir)
    return series.outside_intervals(ev.where("event = 'purchase'"), series.merge_intervals(_spans(ev))).select("trial_id", "event_id")


@query(f"{_SPANS} SELECT trial_id, round(greatest(t0, 21600000.0), 3) AS t0, round(least(t1, 64800000.0), 3) AS t1 FROM iv WHERE t0 <= 64800000 AND t1 >= 21600000")
def clipped_intervals(spark, sf_dir):
    """Intervals cut to six in the morning till six at night."""
    ev = events_long(spark, sf_dir)
    window = trials(ev).select("trial_id", F.lit(21_600_000.0).alias("start"), F.lit(64_800_000.0).alias("stop"), F.lit(True).alias("valid"))
    return series.clip_intervals(_spans(ev), window).select("trial_id", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"))


@query(f"""{BOTH} SELECT CAST(floor((b.t - a.t) / 900000) AS BIGINT) AS bin, count(*) AS n FROM ev a JOIN ev b ON a.trial_id = b.trial_id
WHERE a.event = 'view' AND b.event = 'click' AND abs(b.t - a.t) <= 14400000 GROUP BY 1""")
def cross_correlogram(spark, sf_dir):
    """Clicks about views, four hours to both sides."""
    ev = events_long(spark, sf_dir)
    return series.cross_correlogram(points(ev, "view"), points(ev, "click"), 900_000.0, 14_400_000.0)


@query(f"""{BOTH} SELECT a.trial_id, round(a.t, 3) AS t, (SELECT max_by(v, b.t) FROM ev b WHERE b.trial_id = a.trial_id AND b.event = 'view' AND b.t <= a.t) AS v FROM ev a WHERE a.event = 'purchase'""")
def as_of_join(spark, sf_dir):
    """The value of the latest view before each purchase."""
    ev = events_long(spark, sf_dir)
    got = series.as_of(points(ev, "purchase"), samples(ev.where("event = 'view'")))
    return got.select("trial_id", F.round("t", 3).alias("t"), "v")


@query(f"""{BOTH}, s AS (SELECT *, v >= 60 AS up, lead(v >= 60) OVER (PARTITION BY trial_id ORDER BY t) AS nxt FROM ev) SELECT trial_id, round(t, 3) AS t, v FROM s WHERE NOT up AND nxt""")
def threshold_crossings(spark, sf_dir):
    """The samples before the series rises to 60."""
    return series.crossings(samples(events_long(spark, sf_dir)), 60.0).select("trial_id", F.round("t", 3).alias("t"), "v")


@query(f"""WITH RECURSIVE {_SPANS[5:].split(', iv AS')[0]}, o AS (SELECT trial_id, t, row_number() OVER (PARTITION BY trial_id ORDER BY t) AS i FROM ev),
r AS (SELECT trial_id, t, i, t AS kept, true AS keep FROM o WHERE i = 1 UNION ALL
  SELECT o.trial_id, o.t, o.i, CASE WHEN o.t - r.kept >= 7200000 THEN o.t ELSE r.kept END, o.t - r.kept >= 7200000 FROM r JOIN o ON o.trial_id = r.trial_id AND o.i = r.i + 1)
SELECT trial_id, round(t, 3) AS t FROM r WHERE keep""")
def lock_out(spark, sf_dir):
    """Events at least two hours after the last kept one of their trial."""
    return series.lock_out(events_long(spark, sf_dir).select("trial_id", "t"), 7_200_000.0).select("trial_id", F.round("t", 3).alias("t"))


@query(f"""{BOTH}, m AS (SELECT trial_id, t, CASE WHEN event = 'error' THEN NULL ELSE v END AS v FROM ev)
SELECT trial_id, round(t, 3) AS t, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY trial_id ORDER BY t ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY trial_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM m""")
def filled_edges(spark, sf_dir):
    """Values with errors' own left out and filled from their neighbours."""
    ev = events_long(spark, sf_dir)
    return series.fill_edges(ev.select("trial_id", "t", F.when(F.col("event") != "error", F.col("v")).alias("v"))).select("trial_id", F.round("t", 3).alias("t"), "v")


@query(f"{BOTH} SELECT event_id, max(v) OVER w AS high, min(v) OVER w AS low FROM ev WINDOW w AS (PARTITION BY trial_id ORDER BY t ROWS UNBOUNDED PRECEDING)")
def running_extremes(spark, sf_dir):
    return series.running_extremes(events_long(spark, sf_dir)).select("event_id", "high", "low")


@query(f"{BOTH}, d AS (SELECT trial_id, t - lag(t) OVER (PARTITION BY trial_id ORDER BY t) AS dt FROM ev), m AS (SELECT median(dt) AS dt FROM d WHERE dt IS NOT NULL GROUP BY trial_id) SELECT round(median(dt), 3) AS period FROM m")
def sampling_period(spark, sf_dir):
    return series.sampling_period(samples(events_long(spark, sf_dir))).select(F.round("period", 3).alias("period"))


@query(f"{BOTH} SELECT trial_id, CAST(floor(t / 7200000 + 0.5) AS BIGINT) AS bin, round(avg(v), 6) AS v FROM ev GROUP BY 1, 2")
def resampled_average(spark, sf_dir):
    return binning.resample_average(samples(events_long(spark, sf_dir)), 7_200_000.0, "centered").select("trial_id", "bin", F.round("v", 6).alias("v"))


@query(f"""{BOTH}, p AS (SELECT trial_id, t, v, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM ev WINDOW w AS (PARTITION BY trial_id ORDER BY t)),
g AS (SELECT trial_id, unnest(range(0, 25)) AS bin FROM tr)
SELECT g.trial_id, bin, round(v + (v1 - v) * (bin * 3600000.0 - t) / (t1 - t), 6) AS v FROM g JOIN p ON p.trial_id = g.trial_id AND bin * 3600000.0 >= t AND bin * 3600000.0 < t1""")
def resampled_interpolated(spark, sf_dir):
    """Values at full hours between the samples around them."""
    return binning.resample_interpolated(samples(events_long(spark, sf_dir)), 3_600_000.0).select("trial_id", "bin", F.round("v", 6).alias("v"))


_TAPS = kernels.savitzky_golay(5, 2, 1)


# the derivative of a parabola fitted to five samples is (-2, -1, 0, 1, 2) / 10 of them
@query("""WITH x AS (SELECT vec_id, CAST(embedding[i] AS DOUBLE) AS v, i - 1 AS i FROM embeddings, (SELECT unnest(range(1, 65)) AS i)), taps(k, w) AS (VALUES (-2, 0.2), (-1, 0.1), (0, 0.0), (1, -0.1), (2, -0.2))
SELECT vec_id AS trial_id, i + k AS i, round(sum(v * w), 6) AS dv FROM x, taps GROUP BY vec_id, i + k HAVING count(*) = 5""")
def savitzky_golay(spark, sf_dir):
    """Smoothed derivative of each embedding read as a series, where the whole frame is there."""
    from trialloom.sources.tables import samples_from_arrays

    s = samples_from_arrays(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    got = binning.smooth(s.select("trial_id", F.col("i").alias("bin"), F.col("v").alias("n")), _TAPS, 1.0, 1.0)
    return got.select("trial_id", F.col("bin").alias("i"), F.round("rate", 6).alias("dv"))


@query(f"""{BOTH}, nx AS (SELECT DISTINCT trial_id - 1 AS trial_id, true AS has FROM tr)
SELECT CASE WHEN has AND t > 72000000 THEN ev.trial_id + 1 ELSE ev.trial_id END AS trial_id, round(CASE WHEN has AND t > 72000000 THEN t - 86400000 ELSE t END, 3) AS t FROM ev LEFT JOIN nx USING (trial_id)""")
def moved_boundary(spark, sf_dir):
    """Days that end at eight at night: later events go to the user's next day, if there is one."""
    ev = events_long(spark, sf_dir)
    starts = trials(ev).select("trial_id", F.lit(72_000_000.0).alias("new_end"), F.lit(86_400_000.0).alias("length"))
    return series.move_across(ev.select("trial_id", "t"), starts).select("trial_id", F.round("t", 3).alias("t"))


@query(f"""{BOTH}, s AS (SELECT user_id, event_id, t, trial_id, sum(CASE WHEN event = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY trial_id, t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM ev)
SELECT user_id, session, count(*) AS n FROM s GROUP BY 1, 2""")
def sessionised(spark, sf_dir):
    """A user's events between one signup and the next."""
    from trialloom.sources.tables import sessionise

    s = sessionise(events_long(spark, sf_dir), F.col("event") == "signup", "user_id", ["trial_id", "t", "event_id"])
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query(f"""{BOTH}, m AS (SELECT trial_id, v - avg(v) OVER (PARTITION BY trial_id) AS d FROM ev) SELECT cond, round(sqrt(sum(d * d) / count(d)), 6) AS rms, count(d) AS n FROM m JOIN tr USING (trial_id) GROUP BY cond""")
def pooled_rms(spark, sf_dir):
    """Root mean square about each trial's mean, pooled over the trials of a condition."""
    from trialloom.functions.stats import rms_parts

    ev = events_long(spark, sf_dir)
    parts = ev.groupBy("trial_id").agg(*rms_parts("v")).join(trials(ev).select("trial_id", "cond"), "trial_id")
    return parts.groupBy("cond").agg(F.round(F.sqrt(F.sum("ssq") / F.sum("n")), 6).alias("rms"), F.sum("n").alias("n"))


@query(f"""{BOTH}, m AS (SELECT ev.trial_id, avg(v) AS v FROM ev GROUP BY 1) SELECT cond, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem, round(stddev_samp(v), 6) AS std, count(v) AS n FROM m JOIN tr USING (trial_id) GROUP BY cond""")
def two_level_mean(spark, sf_dir):
    """Means over time within trials, then over trials."""
    ev = events_long(spark, sf_dir)
    return timecourse.time_then_trial_means(ev, trials(ev)).select("cond", *[F.round(c, 6).alias(c) for c in ("mean", "sem", "std")], "n")


@query(f"""WITH RECURSIVE {BOTH[5:]}, o AS (SELECT trial_id, t, v, row_number() OVER (PARTITION BY trial_id ORDER BY t) AS i FROM ev),
r AS (SELECT trial_id, t, i, v AS y FROM o WHERE i = 1 UNION ALL SELECT o.trial_id, o.t, o.i, 0.8 * r.y + 0.2 * o.v FROM r JOIN o ON o.trial_id = r.trial_id AND o.i = r.i + 1)
SELECT trial_id, round(t, 3) AS t, round(y, 6) AS y FROM r""")
def recursive_filter(spark, sf_dir):
    """A first-order low pass along each trial."""
    out = sequential.filter_series(samples(events_long(spark, sf_dir)), b=[0.2], a=[1.0, -0.8], settled=True)
    return out.select("trial_id", F.round("t", 3).alias("t"), F.round("y", 6).alias("y"))


