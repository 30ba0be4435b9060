"""Queries on conditions over time and on populations of several sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.operators import binning, contrasts, timecourse, windows
from trialloom.plans.alignment import AROUND, CLICKS, HOUR
from trialloom.plans.base import BOTH, events_long, samples, trials
from trialloom.plans.registry import query
from trialloom.sources.tables import written

_GRID = f"""{CLICKS}, s AS (SELECT al.trial_id, CAST(floor((t - zero) / 1800000) AS BIGINT) AS bin, avg(v) AS v FROM al JOIN ev ON ev.trial_id = al.trial_id AND t BETWEEN start AND stop GROUP BY 1, 2),
b AS (SELECT trial_id, avg(v) AS b FROM s WHERE bin BETWEEN -4 AND -1 GROUP BY 1)"""
_MEANS = "avg(v) AS mean, stddev_samp(v) / sqrt(count(v)) AS sem, stddev_samp(v) AS std, count(v) AS n"


def _series(spark, sf_dir):
    ev = events_long(spark, sf_dir)
    tr = trials(ev)
    return timecourse.on_grid(samples(ev), windows.align(tr, ev, AROUND), HOUR / 2, "acausal"), tr


def _rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in ("mean", "sem", "std")], "n")


@query(f"{_GRID}, d AS (SELECT trial_id, bin, v - b AS v FROM s LEFT JOIN b USING (trial_id)), m AS (SELECT cond, bin, {_MEANS} FROM d JOIN tr USING (trial_id) GROUP BY 1, 2) SELECT cond, bin, CASE WHEN n >= 1 THEN round(mean, 6) END AS mean, round(sem, 6) AS sem, round(std, 6) AS std, n FROM m")
def series_means(spark, sf_dir):
    """The series around the first click by half hours, less each trial's mean before it, by condition and time."""
    s, tr = _series(spark, sf_dir)
    return _rounded(timecourse.group_means(timecourse.subtract_baseline(s, timecourse.trial_baseline(s, -4, -1)), tr), "cond", "bin")


@query(f"""{_GRID}, c AS (SELECT cond, avg(b) AS b FROM b JOIN tr USING (trial_id) GROUP BY 1), m AS (SELECT cond, bin, avg(v - b) AS mean, stddev_samp(v - b) / sqrt(count(v)) AS sem FROM s JOIN tr USING (trial_id) JOIN c USING (cond) GROUP BY 1, 2)
SELECT bin, round(x.mean - y.mean, 6) AS diff, round(sqrt(x.sem * x.sem + y.sem * y.sem), 6) AS sem FROM (SELECT * FROM m WHERE cond = 1) x FULL JOIN (SELECT * FROM m WHERE cond = 0) y USING (bin)""")
def series_difference(spark, sf_dir):
    """One condition over time less another, each less its own mean before the click; errors in quadrature."""
    s, tr = _series(spark, sf_dir)
    m = timecourse.group_means(timecourse.subtract_baseline(s, timecourse.condition_baseline(s, tr, -4, -1)), tr)
    out = contrasts.difference(m.where("cond = 1"), m.where("cond = 0"), ["bin"])
    return out.select("bin", F.round("diff", 6).alias("diff"), F.round("sem", 6).alias("sem"))


@query(f"""{CLICKS}, s AS (SELECT al.trial_id, t - zero AS t, v FROM al JOIN ev ON ev.trial_id = al.trial_id AND t BETWEEN start AND stop),
p AS (SELECT *, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM s WINDOW w AS (PARTITION BY trial_id ORDER BY t)), g AS (SELECT unnest(range(-4, 5)) AS bin),
x AS (SELECT trial_id, bin, v + coalesce((v1 - v) * (bin * 1800000.0 - t) / (t1 - t), 0) AS v FROM p, g WHERE bin * 1800000.0 >= t AND (bin * 1800000.0 < t1 OR (t1 IS NULL AND bin * 1800000.0 = t)))
SELECT cond, bin, round(avg(v - 50), 6) AS mean, count(v) AS n FROM x JOIN tr USING (trial_id) GROUP BY 1, 2""")
def interpolated_means(spark, sf_dir):
    """The same at points of the grid by interpolation, less a constant."""
    ev = events_long(spark, sf_dir)
    tr = trials(ev)
    s = timecourse.on_grid(samples(ev), windows.align(tr, ev, AROUND), HOUR / 2, interpolate=True)
    return timecourse.group_means(timecourse.subtract_baseline(s, 50.0), tr).select("cond", "bin", F.round("mean", 6).alias("mean"), "n")


_SOURCES = ("error", "purchase", "view")
_POPULATION = f"""{CLICKS}, lim AS (SELECT trial_id, zero, start, stop, CAST(ceil((start - zero) / 3600000 - 1e-6) AS BIGINT) AS lo, CAST(floor((stop - zero) / 3600000 + 1e-6) AS BIGINT) AS hi FROM al),
grid AS (SELECT trial_id, basis, unnest(range(lo, hi + 1)) AS bin FROM lim, (SELECT unnest(['error', 'purchase', 'view']) AS basis) WHERE hi >= lo),
cnt AS (SELECT lim.trial_id, event AS basis, CASE WHEN abs((t - zero) - (hi + 1) * 3600000.0) < 1e-9 THEN hi ELSE CAST(floor((t - zero) / 3600000) AS BIGINT) END AS bin, count(*) AS n FROM lim JOIN ev ON ev.trial_id = lim.trial_id AND t BETWEEN start AND stop GROUP BY 1, 2, 3),
x AS (SELECT trial_id, basis, bin, CAST(coalesce(n, 0) AS DOUBLE) AS v, cond FROM grid LEFT JOIN cnt USING (trial_id, basis, bin) JOIN tr USING (trial_id)),
sp AS (SELECT basis, cond, trial_id, min(bin) AS t0, max(bin) AS t1 FROM x GROUP BY 1, 2, 3), rk AS (SELECT *, row_number() OVER (PARTITION BY basis, cond ORDER BY t0) AS a, row_number() OVER (PARTITION BY basis, cond ORDER BY t1 DESC) AS z FROM sp),
bw AS (SELECT basis, cond, max(t0) FILTER (a <= 5) AS t_min, min(t1) FILTER (z <= 5) AS t_max FROM rk GROUP BY 1, 2), win AS (SELECT cond, max(t_min) AS first, min(t_max) AS last FROM bw GROUP BY 1),
cube AS (SELECT basis, cond, bin, {_MEANS} FROM x GROUP BY 1, 2, 3), pop AS (SELECT cube.* FROM cube JOIN win USING (cond) WHERE bin BETWEEN first AND last AND n >= 5)"""


def _sources(spark, sf_dir):
    """All kinds of events as points of a basis, the events and the trials."""
    ev = events_long(spark, sf_dir)
    return ev.select(F.col("event").alias("basis"), "trial_id", "t"), ev, trials(ev)


def _population(spark, sf_dir):
    found, ev, tr = _sources(spark, sf_dir)
    return binning.rate_means(found, windows.align(tr, ev, AROUND), tr, HOUR, bases=list(_SOURCES), mode="acausal", min_count=5, least=5).where("n >= 5")


def _stored_population(spark, sf_dir):
    """The population's cube, a few rows, kept for plans that read it more than once."""
    return written(_population(spark, sf_dir))


@query(f"{_POPULATION} SELECT basis, cond, bin, round(mean, 6) AS mean, round(sem, 6) AS sem, round(std, 6) AS std, n FROM pop")
def population_timecourse(spark, sf_dir):
    """Three kinds of events as bases: means by basis, condition and hour where five trials of each basis have data."""
    return _rounded(_population(spark, sf_dir), "basis", "cond", "bin")


@query(f"""{_POPULATION}, f AS (SELECT cond, bin FROM pop GROUP BY 1, 2 HAVING count(mean) = 3) SELECT cond, bin, round(max(mean) FILTER (basis = 'error'), 6) AS error, round(max(mean) FILTER (basis = 'purchase'), 6) AS purchase, round(max(mean) FILTER (basis = 'view'), 6) AS "view"
FROM pop JOIN f USING (cond, bin) GROUP BY 1, 2""")
def population_matrix(spark, sf_dir):
    """The complete rows of the population over time, a column for each basis."""
    cube = timecourse.complete_rows(_stored_population(spark, sf_dir), 3)
    return timecourse.matrix(cube, list(_SOURCES)).select("cond", "bin", *[F.round(b, 6).alias(b) for b in _SOURCES])


@query(f"""{_POPULATION}, d AS (SELECT a.cond AS cond_a, b.cond AS cond_b, a.bin AS bin, b.bin AS bin_b, sqrt(sum((a.mean - b.mean) * (a.mean - b.mean))) AS d FROM pop a JOIN pop b ON a.basis = b.basis AND a.cond <> b.cond GROUP BY 1, 2, 3, 4)
SELECT cond_a, cond_b, bin, round(max(d) FILTER (bin = bin_b), 6) AS distance, round(min(d), 6) AS nearest FROM d GROUP BY 1, 2, 3""")
def nearest_distances(spark, sf_dir):
    """How far two conditions' states are at the same time, and at the time at which they are nearest."""
    got = timecourse.nearest_distances(_stored_population(spark, sf_dir), list(_SOURCES))
    return got.select("cond_a", "cond_b", "bin", F.round("distance", 6).alias("distance"), F.round("nearest", 6).alias("nearest"))


@query(f"{_POPULATION} SELECT basis, round(min(mean), 6) AS low, round(max(mean), 6) AS high, round(avg(mean), 6) AS mean, round(var_pop(mean), 6) AS variance, round(stddev_pop(mean), 6) AS deviation, count(mean) AS n FROM pop GROUP BY 1")
def basis_statistics_over_time(spark, sf_dir):
    """Extremes, mean and variance of each basis over conditions and times."""
    m = _population(spark, sf_dir).groupBy("basis")
    stats = {"low": F.min("mean"), "high": F.max("mean"), "mean": F.avg("mean"), "variance": F.var_pop("mean"), "deviation": F.stddev_pop("mean")}
    return m.agg(*[F.round(x, 6).alias(c) for c, x in stats.items()], F.count("mean").alias("n"))


_KINDS = ("click", "error", "purchase", "signup", "view")
_WINDOWS = ("click-7200000:click+7200000 @ click", "purchase-3600000:purchase+10800000 @ purchase", "view:view(end) @ view")
_ALIGNMENTS = f"""{BOTH}, zeros AS (SELECT trial_id, min_by(t, occ) FILTER (event = 'click') AS c, min_by(t, occ) FILTER (event = 'purchase') AS p, min_by(t, occ) FILTER (event = 'view') AS v, max_by(t, occ) FILTER (event = 'view') AS w FROM ev GROUP BY 1),
al AS (SELECT 0 AS align_id, trial_id, c AS zero, greatest(round(c - 7200000 - c) + c, 0.0) AS start, least(round(c + 7200000 - c) + c, 86400000.0) AS stop FROM zeros WHERE c IS NOT NULL
  UNION ALL SELECT 1, trial_id, p, greatest(round(p - 3600000 - p) + p, 0.0), least(round(p + 10800000 - p) + p, 86400000.0) FROM zeros WHERE p IS NOT NULL
  UNION ALL SELECT 2, trial_id, v, greatest(v, 0.0), least(round(w - v) + v, 86400000.0) FROM zeros WHERE v IS NOT NULL),
lim AS (SELECT *, CAST(ceil((start - zero) / 3600000 - 1e-6) AS BIGINT) AS lo, CAST(floor((stop - zero) / 3600000 + 1e-6) AS BIGINT) AS hi FROM al),
grid AS (SELECT align_id, trial_id, basis, unnest(range(lo, hi + 1)) AS bin FROM lim, (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS basis) WHERE hi >= lo),
cnt AS (SELECT align_id, lim.trial_id, event AS basis, CASE WHEN abs((t - zero) - (hi + 1) * 3600000.0) < 1e-9 THEN hi ELSE CAST(floor((t - zero) / 3600000) AS BIGINT) END AS bin, count(*) AS n FROM lim JOIN ev ON ev.trial_id = lim.trial_id AND t BETWEEN start AND stop GROUP BY 1, 2, 3, 4),
x AS (SELECT align_id, trial_id, basis, bin, CAST(coalesce(n, 0) AS DOUBLE) AS v, cond FROM grid LEFT JOIN cnt USING (align_id, trial_id, basis, bin) JOIN tr USING (trial_id)),
sp AS (SELECT align_id, basis, cond, trial_id, min(bin) AS t0, max(bin) AS t1 FROM x GROUP BY 1, 2, 3, 4), rk AS (SELECT *, row_number() OVER (PARTITION BY align_id, basis, cond ORDER BY t0) AS a, row_number() OVER (PARTITION BY align_id, basis, cond ORDER BY t1 DESC) AS z FROM sp),
bw AS (SELECT align_id, basis, cond, max(t0) FILTER (a <= 5) AS t_min, min(t1) FILTER (z <= 5) AS t_max FROM rk GROUP BY 1, 2, 3), win AS (SELECT align_id, cond, max(t_min) AS first, min(t_max) AS last FROM bw GROUP BY 1, 2),
cube AS (SELECT align_id, basis, cond, bin, {_MEANS} FROM x GROUP BY 1, 2, 3, 4), pop AS (SELECT cube.* FROM cube JOIN win USING (align_id, cond) WHERE bin BETWEEN first AND last AND n >= 5)"""


def _aligned_population(spark, sf_dir):
    found, ev, tr = _sources(spark, sf_dir)
    return binning.rate_means(found, windows.align_all(tr, ev, list(_WINDOWS)), tr, HOUR, bases=list(_KINDS), mode="acausal", min_count=5, least=5).where("n >= 5")


@query(f"""{_ALIGNMENTS}, spans AS (SELECT align_id, min(bin) AS a, max(bin) AS z FROM pop GROUP BY 1), offs AS (SELECT align_id, coalesce(sum(z - a + 1 + 2) OVER (ORDER BY align_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - a AS o FROM spans)
SELECT align_id, basis, cond, bin, CAST(bin + o AS BIGINT) AS place, round(mean, 6) AS mean, round(sem, 6) AS sem, n FROM pop JOIN offs USING (align_id)""")
def population_alignments(spark, sf_dir):
    """All kinds of events as bases under three alignments: means by alignment, basis, condition and
    hour, and where the hour stands when the alignments are laid end to end, two hours apart."""
    cube = _aligned_population(spark, sf_dir)
    return timecourse.end_to_end(cube, 2).select("align_id", "basis", "cond", "bin", "place", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"), "n")


@query(f"""{_ALIGNMENTS}, smooth AS (SELECT align_id, basis, trial_id, bin + k AS bin, sum(v * w) * 1000 / 3600000 AS r FROM x, (VALUES (-1, 0.25), (0, 0.5), (1, 0.25)) taps(k, w) GROUP BY 1, 2, 3, bin + k HAVING count(*) = 3),
b AS (SELECT trial_id, basis, avg(r) AS b FROM smooth WHERE align_id = 0 AND bin < 0 GROUP BY 1, 2)
SELECT align_id, basis, cond, bin, round(avg(r - b) * 1e6, 4) AS change, count(r - b) AS n FROM smooth JOIN tr USING (trial_id) LEFT JOIN b USING (trial_id, basis) GROUP BY 1, 2, 3, 4""")
def alignments_from_baseline(spark, sf_dir):
    """Smoothed rates under three alignments, less each trial's own before its first click."""
    found, ev, tr = _sources(spark, sf_dir)
    aligned = windows.align_all(tr, ev, list(_WINDOWS))
    got = binning.rate_changes(found, aligned, tr, HOUR, [(-1, 0.25), (0, 0.5), (1, 0.25)], 1000 / HOUR, list(_KINDS), (0, -24, -1), "acausal")
    return got.select("align_id", "basis", "cond", "bin", (F.round(F.col("change") * 1e6, 4) + F.lit(0.0)).alias("change"), "n")


@query(f"""{_ALIGNMENTS} SELECT trial_id, coalesce(sum(n) FILTER (align_id = 0), 0)::BIGINT AS around_click, coalesce(sum(n) FILTER (align_id = 1), 0)::BIGINT AS around_purchase, coalesce(sum(n) FILTER (align_id = 2), 0)::BIGINT AS within_views
FROM (SELECT align_id, al.trial_id, count(ev.t) AS n FROM al LEFT JOIN ev ON ev.trial_id = al.trial_id AND event IN ('click', 'view') AND t BETWEEN start AND stop GROUP BY 1, 2) GROUP BY 1""")
def combined_counts(spark, sf_dir):
    """Clicks and views as one source, counted in the windows of three alignments side by side."""
    ev = events_long(spark, sf_dir)
    aligned = windows.align_all(trials(ev), ev, list(_WINDOWS))
    n = binning.counts_in_windows(ev.where("event in ('click', 'view')"), aligned)
    return n.groupBy("trial_id").pivot("align_id", [0, 1, 2]).agg(F.first("n")).select("trial_id", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(c) for i, c in enumerate(("around_click", "around_purchase", "within_views"))])


@query(f"""{_ALIGNMENTS}, m AS (SELECT align_id, basis, bin, CASE WHEN cond = 0 THEN 0 ELSE 1 END AS cond, v FROM x JOIN win w USING (align_id, cond) WHERE bin BETWEEN w.first AND w.last AND (align_id, basis, cond, bin) IN (SELECT (align_id, basis, cond, bin) FROM pop))
SELECT align_id, basis, cond, bin, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(*)), 6) AS sem, count(*) AS n FROM m GROUP BY 1, 2, 3, 4""")
def regrouped_population(spark, sf_dir):
    """The population under three alignments with two of its conditions made one, from the cube alone."""
    cube = _aligned_population(spark, sf_dir)
    got = timecourse.regrouped(cube, {0: 0, 1: 1, 2: 1}, ["align_id", "basis", "bin"])
    return got.select("align_id", "basis", "cond", "bin", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"), "n")
