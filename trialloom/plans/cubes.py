"""Queries on cubes of conditions that are brought together."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.functions.stats import mean_sem
from trialloom.operators import cubes
from trialloom.plans.base import BOTH, events_long, trials
from trialloom.plans.registry import query


def _trials(spark, sf_dir):
    return trials(events_long(spark, sf_dir)).withColumnsRenamed({"cond": "site"}).withColumn("half", F.col("k") % 2)


def _means(cube, tr):
    return cube.members(tr).join(tr.select("trial_id", "n_events"), "trial_id").groupBy("cond").agg(*mean_sem("n_events"))


@query(f"""{BOTH}, t AS (SELECT *, k % 2 AS half FROM tr), e AS (SELECT unnest(['view', 'click', 'error']) AS first_event), s AS (SELECT unnest([0, 1]) AS site),
a AS (SELECT first_event, avg(n_events) AS m, stddev_samp(n_events) / sqrt(count(*)) AS s FROM t WHERE half = 0 AND first_event IN ('view', 'click', 'error') GROUP BY 1),
b AS (SELECT CASE WHEN cond = 2 THEN 1 ELSE 0 END AS site, first_event, avg(n_events) AS m, stddev_samp(n_events) / sqrt(count(*)) AS s FROM t WHERE first_event IN ('view', 'click', 'error') GROUP BY 1, 2)
SELECT CASE WHEN b.site = 1 THEN '2' ELSE '0|1' END AS site, b.first_event, round(b.m - a.m, 6) AS diff, round(sqrt(a.s * a.s + b.s * b.s), 6) AS sem FROM b JOIN a USING (first_event)""")
def matched_cubes(spark, sf_dir):
    """A cube by site and first event less one by first event alone, of other trials: conditions meet where both say the same."""
    tr = _trials(spark, sf_dir)
    events = ["view", "click", "error"]
    one = cubes.Cube().filtered(half=0).by("first_event", events)
    two = cubes.Cube().by("site", [[0, 1], 2]).by("first_event", events)
    two, one = cubes.expand_to_match([two, one])
    diff = cubes.matched_difference(two, _means(two, tr), one, _means(one, tr))
    return diff.join(two.table(spark), "cond").select("site", "first_event", F.round("diff", 6).alias("diff"), F.round("sem", 6).alias("sem"))


@query(f"""{BOTH}, t AS (SELECT trial_id, cond AS site, first_event, k % 2 AS half FROM tr WHERE n_events >= 4) SELECT CAST(site AS VARCHAR) AS site, first_event, CASE WHEN half IN (0, 1) THEN '0|1' END AS half, count(*) AS n FROM t GROUP BY 1, 2, 3""")
def occupied_conditions(spark, sf_dir):
    """The combinations of site and first event that occur among busy days, fixed, and both halves together."""
    tr = _trials(spark, sf_dir).where("n_events >= 4")
    cube = cubes.Cube().by_values(tr, "site", "first_event").by("half", [[0, 1]])
    counts = cube.members(tr).groupBy("cond").agg(F.count("*").alias("n"))
    return cube.table(spark).join(counts, "cond").select("site", "first_event", "half", "n")
