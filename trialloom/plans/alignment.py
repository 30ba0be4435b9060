"""Queries on alignment and on what lies in aligned windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.functions import kernels
from trialloom.operators import binning, series, windows
from trialloom.plans.base import BOTH, events_long, points, samples, trials
from trialloom.plans.registry import query

HOUR = 3_600_000.0
#: First click of the day, an hour or two around it, cut to the day.
AROUND = "click-7200000:click+7200000 @ click"
AL = """al AS (
  SELECT trial_id, zero, greatest(round(z0 - zero) + zero, 0.0) AS start, least(round(z1 - zero) + zero, 86400000.0) AS stop
  FROM (SELECT trial_id, t AS zero, t - 7200000 AS z0, t + 7200000 AS z1 FROM ev WHERE event = 'click' AND occ = 1))"""
CLICKS = f"{BOTH}, {AL}"


def _base(spark, sf_dir):
    ev = events_long(spark, sf_dir)
    return ev, trials(ev)


@query(f"{CLICKS} SELECT tr.trial_id, round(zero, 3) AS zero, round(start, 3) AS start, round(stop, 3) AS stop, zero IS NOT NULL AS valid, CASE WHEN zero IS NULL THEN 'missing zero event' END AS cause FROM tr LEFT JOIN al USING (trial_id)")
def align_window(spark, sf_dir):
    """Window bounds, validity and cause of every trial."""
    ev, tr = _base(spark, sf_dir)
    return windows.align(tr, ev, AROUND).select("trial_id", *[F.round(c, 3).alias(c) for c in ("zero", "start", "stop")], "valid", "cause")


@query(f"""{BOTH}, x AS (
  SELECT tr.trial_id, min(t) FILTER (event = 'view') AS v, max(t) FILTER (event = 'purchase') AS p, min(t) FILTER (event = 'error') AS e
  FROM tr JOIN ev USING (trial_id) GROUP BY 1),
y AS (SELECT *, round(p - v) + v AS p2 FROM x), z AS (SELECT *, CASE WHEN v IS NULL THEN 'missing zero event' WHEN p IS NULL THEN 'missing stop event'
  WHEN v > p2 THEN 'start after stop' WHEN e BETWEEN v AND p2 OR EXISTS (SELECT 1 FROM ev WHERE ev.trial_id = y.trial_id AND ev.event = 'error' AND ev.t BETWEEN y.v AND y.p2) THEN 'overlaps error' WHEN p2 - v < 60000 THEN 'too short' END AS cause FROM y)
SELECT coalesce(cause, 'valid') AS cause, count(*) AS n, round(avg(CASE WHEN cause IS NULL THEN p2 - v END), 6) AS duration FROM z GROUP BY 1""")
def align_causes(spark, sf_dir):
    """View to last purchase, without errors between and a minute at least: causes counted."""
    ev, tr = _base(spark, sf_dir)
    al = windows.align(tr, ev, "view:purchase(end) @ view, invalidate error", min_duration=60_000)
    return al.groupBy(F.coalesce("cause", F.lit("valid")).alias("cause")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("stop") - F.col("start")), 6).alias("duration"))


@query(f"""{CLICKS}, x AS (SELECT al.*, (SELECT min(t) FROM ev WHERE ev.trial_id = al.trial_id AND event = 'purchase' AND occ = 1 AND t >= al.zero - 7200000) AS p FROM al),
y AS (SELECT trial_id, zero, least(round(7200000.0) + zero, p) AS stop0 FROM x)
SELECT trial_id, round(least(stop0, 86400000.0), 3) AS stop FROM y""")
def align_truncated(spark, sf_dir):
    """Stop moved back to the first purchase."""
    ev, tr = _base(spark, sf_dir)
    al = windows.align(tr, ev, AROUND + ", truncateAfter purchase")
    return al.where("valid").select("trial_id", F.round("stop", 3).alias("stop"))


@query(f"""{CLICKS} SELECT trial_id, round(least(round(7200000.0) + zero + 0.0, 86400000.0 - 600000), 3) AS stop, round(greatest(round(-7200000.0) + zero, 600000.0), 3) AS start
FROM al WHERE greatest(round(-7200000.0) + zero, 600000.0) <= least(round(7200000.0) + zero, 86400000.0 - 600000)""")
def align_padded(spark, sf_dir):
    """Ten minutes of padding on both sides move the window inward at the ends of a day."""
    ev, tr = _base(spark, sf_dir)
    al = windows.align(tr, ev, AROUND + ", pad [600000:600000]")
    return al.where("valid").select("trial_id", F.round("stop", 3).alias("stop"), F.round("start", 3).alias("start"))


@query(f"{CLICKS} SELECT n_views, count(*) AS n_trials FROM (SELECT al.trial_id, count(ev.t) AS n_views FROM al LEFT JOIN ev ON ev.trial_id = al.trial_id AND event = 'view' AND t BETWEEN start AND stop GROUP BY 1) GROUP BY 1")
def window_counts(spark, sf_dir):
    """Trials by the number of views in their window."""
    ev, tr = _base(spark, sf_dir)
    rates = binning.mean_rate(points(ev, "view"), windows.align(tr, ev, AROUND))
    return rates.where("n is not null").groupBy(F.col("n").alias("n_views")).agg(F.count("*").alias("n_trials"))


@query(f"{CLICKS} SELECT al.trial_id, count(ev.t) AS n, round(stop - start, 3) AS duration, round(count(ev.t) / (stop - start) * 1000, 9) AS rate FROM al LEFT JOIN ev ON ev.trial_id = al.trial_id AND event = 'view' AND t BETWEEN start AND stop GROUP BY al.trial_id, start, stop")
def mean_rates(spark, sf_dir):
    ev, tr = _base(spark, sf_dir)
    r = binning.mean_rate(points(ev, "view"), windows.align(tr, ev, AROUND)).where("n is not null")
    return r.select("trial_id", "n", F.round("duration", 3).alias("duration"), F.round("rate", 9).alias("rate"))


@query(f"{CLICKS} SELECT ev.trial_id, event_id, round(t - zero, 3) AS t, v FROM al JOIN ev ON ev.trial_id = al.trial_id AND t BETWEEN start AND stop")
def aligned_samples(spark, sf_dir):
    """The series inside each window, relative to zero."""
    ev, tr = _base(spark, sf_dir)
    got = windows.in_window(ev.select("trial_id", "event_id", "t", "v"), windows.align(tr, ev, AROUND))
    return got.select("trial_id", "event_id", F.round("t", 3).alias("t"), "v")


@query(f"""{CLICKS} SELECT trial_id, round(arg_min(t - zero, struct_pack(d := abs(t - zero), t := t)), 3) AS t, arg_min(v, struct_pack(d := abs(t - zero), t := t)) AS v
FROM (SELECT ev.trial_id, t, v, zero FROM al JOIN ev ON ev.trial_id = al.trial_id WHERE event <> 'click') GROUP BY trial_id""")
def sample_at_zero(spark, sf_dir):
    """The sample nearest to zero that is no click itself."""
    ev, tr = _base(spark, sf_dir)
    got = windows.nearest_sample(samples(ev.where("event <> 'click'")), windows.align(tr, ev, AROUND))
    return got.select("trial_id", F.round("t", 3).alias("t"), "v")


_BINS = f"""{CLICKS}, lim AS (SELECT trial_id, zero, start, stop, CAST(ceil((start - zero) / 3600000 - 1e-6) AS BIGINT) AS lo, CAST(floor((stop - zero) / 3600000 + 1e-6) AS BIGINT) AS hi FROM al),
grid AS (SELECT trial_id, unnest(range(lo, hi + 1)) AS bin FROM lim WHERE hi >= lo),
cnt AS (SELECT lim.trial_id, CASE WHEN abs((t - zero) - (hi + 1) * 3600000.0) < 1e-9 THEN hi ELSE CAST(floor((t - zero) / 3600000) AS BIGINT) END AS bin, count(*) AS n
  FROM lim JOIN ev ON ev.trial_id = lim.trial_id AND event <> 'click' AND t BETWEEN start AND stop GROUP BY 1, 2),
bins AS (SELECT trial_id, bin, coalesce(n, 0) AS n FROM grid LEFT JOIN cnt USING (trial_id, bin))"""


@query(f"{_BINS} SELECT trial_id, bin, n FROM bins")
def binned_counts(spark, sf_dir):
    """Other events than clicks by hour around the first click; 0 inside the window, no row outside."""
    ev, tr = _base(spark, sf_dir)
    return binning.binned_counts(ev.where("event <> 'click'").select("trial_id", "t"), windows.align(tr, ev, AROUND), HOUR, "acausal")


@query(f"""{_BINS}, taps(k, w) AS (VALUES (0, 0.5), (1, 0.3), (2, 0.2)),
rate AS (SELECT trial_id, bin + k AS bin, sum(n * w) * 1000 / 3600000 AS r FROM bins, taps GROUP BY trial_id, bin + k HAVING count(*) = 3)
SELECT cond, bin, round(avg(r), 9) AS mean, round(stddev_samp(r) / sqrt(count(r)), 9) AS sem, round(stddev_samp(r), 9) AS std, count(r) AS n
FROM rate JOIN tr USING (trial_id) GROUP BY cond, bin""")
def psth(spark, sf_dir):
    """Align, bin, smooth causally, average over the trials of a condition."""
    ev, tr = _base(spark, sf_dir)
    others = ev.where("event <> 'click'").select("trial_id", "t")
    got = binning.psth(others, windows.align(tr, ev, AROUND), tr.select("trial_id", "cond"), HOUR, [(0, 0.5), (1, 0.3), (2, 0.2)], mode="acausal")
    return got.select("cond", "bin", *[F.round(c, 9).alias(c) for c in ("mean", "sem", "std")], "n")


_KERNELS = {
    "gaussian": kernels.gaussian(2.0, 1.0), "half_gaussian": kernels.half_gaussian(2.0, 1.0), "delayed_gaussian": kernels.gaussian(2.0, 1.0, delay=3.0, causal=True),
    "exponential": kernels.exponential(5.0, 1.0), "growth_decay": kernels.growth_decay(2.0, 10.0, 1.0), "boxcar": kernels.boxcar(5), "identity": kernels.identity(),
}


@query(f"""{BOTH}, i AS (SELECT unnest(range(-200, 201)) AS k), raw AS (
SELECT 'gaussian' AS kernel, k, exp(-k * k / 8.0) AS w FROM i WHERE abs(k) <= 6 UNION ALL SELECT 'half_gaussian', k, exp(-k * k / 8.0) FROM i WHERE k BETWEEN 0 AND 6
UNION ALL SELECT 'delayed_gaussian', k, exp(-(k - 3) * (k - 3) / 8.0) FROM i WHERE k BETWEEN 0 AND 9 UNION ALL SELECT 'exponential', k, exp(-k / 5.0) FROM i WHERE k BETWEEN 0 AND 20
UNION ALL SELECT 'growth_decay', k, (1 - exp(-k / 2.0)) * exp(-k / 10.0) FROM i WHERE k BETWEEN 1 AND 40 UNION ALL SELECT 'boxcar', k, 1.0 FROM i WHERE k BETWEEN 0 AND 4 UNION ALL SELECT 'identity', 0, 1.0),
taps AS (SELECT kernel, k, w / sum(w) OVER (PARTITION BY kernel) AS w, count(*) OVER (PARTITION BY kernel) AS size FROM raw),
g AS (SELECT trial_id, cond, unnest(range(0, 49)) AS bin FROM tr), c AS (SELECT trial_id, CAST(floor(t / 1800000) AS BIGINT) AS bin, count(*) AS n FROM ev GROUP BY 1, 2),
x AS (SELECT g.trial_id, cond, bin, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (trial_id, bin)),
s AS (SELECT kernel, trial_id, cond, bin + k AS bin, sum(n * w) * 1000 / 1800000 AS r FROM x, taps GROUP BY kernel, trial_id, cond, bin + k, size HAVING count(*) = size)
SELECT kernel, cond, bin, round(avg(r) * 1e6, 5) AS mean, count(r) AS n FROM s GROUP BY 1, 2, 3""")
def kernel_taps(spark, sf_dir):
    """Events of a day by half hours through each of the kernels, averaged by condition."""
    ev, tr = _base(spark, sf_dir)
    days = windows.align(tr, ev, "TrialStart:TrialEnd @ TrialStart")
    got = binning.kernel_means(ev.select("trial_id", "t"), days, tr.select("trial_id", "cond"), HOUR / 2, _KERNELS, "acausal")
    return got.select("kernel", "cond", "bin", F.round(F.col("mean") * 1e6, 5).alias("mean"), "n")


@query(f"""{BOTH}, m AS (SELECT trial_id, occ, t FROM ev WHERE event = 'click')
SELECT m.trial_id, m.occ, count(p.t) AS n FROM m LEFT JOIN ev p ON p.trial_id = m.trial_id AND p.event = 'view' AND p.t BETWEEN m.t - 1800000 AND m.t + 3600000 GROUP BY 1, 2""")
def triggered_counts(spark, sf_dir):
    """Views from half an hour before to an hour after every click."""
    ev = events_long(spark, sf_dir)
    return series.triggered_counts(points(ev, "view"), points(ev, "click"), -1_800_000, 3_600_000)
