"""Queries on filters, conditions, aggregates and randomised groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.functions import stats
from trialloom.operators import conditions as C
from trialloom.operators import catalog, randomise, timecourse
from trialloom.operators.ranking import hazen_quantiles
from trialloom.plans.base import BOTH, events_long, trials
from trialloom.plans.registry import query


def _orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("trial_id", F.col("o_orderkey"))


def _tr(spark, sf_dir):
    return trials(events_long(spark, sf_dir))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 50000 AND 150000")
def filter_list_and_range(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.where(C.in_list(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]) & C.in_range(F.col("o_totalprice"), 50_000, 150_000)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice <= 20000 OR o_totalprice >= 250000")
def filter_outside_range(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.where(C.outside_range(F.col("o_totalprice"), 20_000, 250_000)).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE abs(l_discount - 0.05) < 1e-6 OR abs(l_discount - 0.07) < 1e-6")
def filter_tolerance(spark, sf_dir):
    """Numbers equal within a tolerance."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.where(C.in_list(F.col("l_discount"), [0.05, 0.07])).select("l_orderkey", "l_linenumber", "l_discount")


@query("""SELECT coalesce(cause, 'valid') AS cause, count(*) AS n FROM (SELECT CASE WHEN o_totalprice < 30000 THEN 'cheap' WHEN o_orderstatus = 'P' THEN 'pending' END AS cause FROM orders) GROUP BY 1""")
def validity_causes(spark, sf_dir):
    """Soft deletion with causes; the first cause stays."""
    o = C.set_invalid(_orders(spark, sf_dir), F.col("o_totalprice") >= 30_000, "cheap")
    o = C.set_invalid(o, F.col("o_orderstatus") != "P", "pending")
    return o.groupBy(F.coalesce("cause", F.lit("valid")).alias("cause")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice * 1.1 ELSE o_totalprice END AS price FROM orders""")
def masked_update(spark, sf_dir):
    """An update of valid rows only."""
    o = _orders(spark, sf_dir).withColumn("price", F.col("o_totalprice"))
    return catalog.masked_update(o, "price", F.col("price") * 1.1, F.col("o_orderstatus") != "P").select("o_orderkey", "price")


@query("SELECT o_orderkey, o_custkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_per_group(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return C.top_per_group(o, "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_orderkey", "o_custkey", "rank")


_EDGES = [0.0, 50_000.0, 100_000.0, 200_000.0, 1_000_000.0]
_CASES = " UNION ALL ".join(f"SELECT o_orderkey, {i} AS bin, o_totalprice FROM orders WHERE o_totalprice BETWEEN {a} AND {b}" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:])))


@query(f"SELECT bin, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS sem FROM ({_CASES}) GROUP BY bin")
def binned_conditions(spark, sf_dir):
    """Closed bins of an attribute as conditions."""
    o = _orders(spark, sf_dir)
    m = C.bin_membership(o, "o_totalprice", _EDGES).join(o.select("trial_id", "o_totalprice"), "trial_id")
    return m.groupBy("bin").agg(*stats.mean_sem("o_totalprice")).select("bin", "n", F.round("mean", 4).alias("mean"), F.round("sem", 4).alias("sem"))


@query("""WITH b AS (SELECT min(l_quantity) AS a, max(l_quantity) AS z FROM lineitem), e AS (SELECT i, CASE WHEN i = 5 THEN z ELSE a + (z - a) * i / 5 END AS x FROM b, (SELECT unnest(range(0, 6)) AS i)),
m AS (SELECT lo.i AS bin, l_quantity FROM lineitem, e lo, e hi WHERE hi.i = lo.i + 1 AND l_quantity BETWEEN lo.x AND hi.x) SELECT bin, count(*) AS n FROM m GROUP BY bin""")
def uniform_bins(spark, sf_dir):
    """Five equal bins from the smallest to the largest value; edges belong to both neighbours."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("trial_id", F.col("l_orderkey"))
    return C.bin_membership(li, "l_quantity", C.uniform_edges(li, "l_quantity", 5)).groupBy(F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("n"))


_HAZEN = """h AS (SELECT i, r, floor(r) AS lo FROM (SELECT i, greatest(1.0, least(n * 1.0, i / 4.0 * n + 0.5)) AS r FROM (SELECT count(*) AS n FROM orders), (SELECT unnest(range(0, 5)) AS i))),
s AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) AS k FROM orders), tot AS (SELECT count(*) AS n FROM orders),
e AS (SELECT i, a.x + (r - lo) * (b.x - a.x) AS x FROM h JOIN s a ON a.k = lo JOIN tot ON true JOIN s b ON b.k = least(lo + 1, n))"""


@query(f"WITH {_HAZEN} SELECT i, round(x, 4) AS x FROM e")
def quantile_edges(spark, sf_dir):
    """Quartiles by Hazen's rule, from counts of distinct values."""
    edges = C.quantile_edges(_orders(spark, sf_dir), "o_totalprice", 4)
    return spark.createDataFrame([(i, round(x, 4)) for i, x in enumerate(edges)], "i long, x double")


@query("""WITH c AS (SELECT * FROM (SELECT DISTINCT o_orderpriority FROM orders), (SELECT DISTINCT o_orderstatus FROM orders)),
a AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, avg(o_totalprice) AS mean FROM orders WHERE o_totalprice > 300000 GROUP BY 1, 2),
p AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS i FROM (SELECT DISTINCT o_orderpriority FROM orders)),
q AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) - 1 AS j FROM (SELECT DISTINCT o_orderstatus FROM orders))
SELECT i + j * (SELECT count(*) FROM p) AS cond, o_orderpriority, o_orderstatus, coalesce(n, 0) AS n, round(mean, 4) AS mean FROM c JOIN p USING (o_orderpriority) JOIN q USING (o_orderstatus) LEFT JOIN a USING (o_orderpriority, o_orderstatus)""")
def condition_cube(spark, sf_dir):
    """Every cell of two axes, empty ones too; the first axis runs fastest."""
    o = _orders(spark, sf_dir)
    cube = C.cube({a: o.select(a) for a in ("o_orderpriority", "o_orderstatus")})
    m = C.members(o.where("o_totalprice > 300000"), cube, ["o_orderpriority", "o_orderstatus"]).join(o.select("trial_id", "o_totalprice"), "trial_id")
    cells = m.groupBy("cond").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))
    return C.by_condition(cube, cells).select(F.col("cond").cast("long").alias("cond"), "o_orderpriority", "o_orderstatus", "n", F.round("mean", 4).alias("mean"))


@query("""WITH g AS (SELECT l_returnflag AS flag, l_tax AS x, l_quantity AS w FROM lineitem) SELECT flag, CASE WHEN count(x) >= greatest(5, ceil(0.5 * count(*))) THEN round(avg(x), 6) END AS mean, count(x) AS n, round(sum(x * w) / sum(w), 6) AS weighted,
round(sqrt(sum(w) / (count(w) - 1)) / sqrt(count(w)), 6) AS poisson FROM g GROUP BY flag""")
def mean_min_count(spark, sf_dir):
    """Means with a least count, weighted means and Poisson errors."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    mean, _, _, n = stats.mean_sem("l_tax", 5, 0.5)
    out = li.groupBy(F.col("l_returnflag").alias("flag")).agg(mean, n, stats.weighted_mean("l_tax", "l_quantity").alias("w"), stats.poisson_sem("l_quantity").alias("p"))
    return out.select("flag", F.round("mean", 6).alias("mean"), "n", F.round("w", 6).alias("weighted"), F.round("p", 6).alias("poisson"))


@query("SELECT CAST(floor(o_totalprice / 10000) * 10000 AS DOUBLE) AS edge, o_orderstatus, count(*) AS n FROM orders GROUP BY GROUPING SETS ((1, 2), (1))")
def histograms_with_total(spark, sf_dir):
    """Histograms of each status and of all, in one pass."""
    o = _orders(spark, sf_dir).select((F.floor(F.col("o_totalprice") / 10_000) * 10_000).cast("double").alias("edge"), "o_orderstatus")
    return o.groupingSets([["edge", "o_orderstatus"], ["edge"]], "edge", "o_orderstatus").agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT o_custkey % 7 AS site, floor(o_totalprice / 500) * 500 AS edge, count(*) AS n FROM orders GROUP BY 1, 2), m AS (SELECT edge, sum(n) AS n FROM h GROUP BY edge),
c AS (SELECT edge, n, sum(n) OVER (ORDER BY edge) AS upto, sum(n) OVER () AS total FROM m)
SELECT CAST(min(edge) AS DOUBLE) AS low, CAST(max(edge) AS DOUBLE) AS high, CAST(round(sum(edge * n) / max(total), 6) AS DOUBLE) AS mean, CAST(min(edge) FILTER (upto * 2 >= total) AS DOUBLE) AS median FROM c""")
def merged_histograms(spark, sf_dir):
    """Histograms of several sites merge into one, whose statistics come from its bins."""
    from trialloom.operators import histograms

    o = _orders(spark, sf_dir).withColumn("site", F.col("o_custkey") % 7)
    return histograms.summary(histograms.merge(histograms.histogram(o, "o_totalprice", 500.0, ["site"])))


@query(f"""{BOTH}, s AS (SELECT trial_id, cond, k, row_number() OVER (ORDER BY cond, md5('3:' || trial_id), trial_id) AS r FROM tr),
n AS (SELECT cond, count(*) AS n FROM tr GROUP BY cond), b AS (SELECT cond, sum(n) OVER (ORDER BY cond) AS hi, sum(n) OVER (ORDER BY cond) - n AS lo FROM n),
p AS (SELECT trial_id, row_number() OVER (ORDER BY md5('3:' || trial_id), trial_id) AS r FROM tr)
SELECT p.trial_id, b.cond FROM p JOIN b ON r > lo AND r <= hi""")
def shuffled_labels(spark, sf_dir):
    """Trials dealt anew to conditions that keep their sizes; a hash of seed and trial orders them."""
    tr = _tr(spark, sf_dir)
    return randomise.shuffle_labels(tr.select("trial_id", "cond"), seed=3)


@query(f"""{BOTH}, o AS (SELECT trial_id, cond, row_number() OVER (PARTITION BY cond ORDER BY trial_id) - 1 AS i, count(*) OVER (PARTITION BY cond) AS n FROM tr),
d AS (SELECT draw, cond, i, CAST(('0x' || substr(md5((10 + draw) || ':' || cond || ':' || i), 1, 8)) AS BIGINT) % n AS j FROM o, (SELECT unnest(range(0, 3)) AS draw)),
x AS (SELECT d.draw, d.cond, t.n_events FROM d JOIN o ON o.cond = d.cond AND o.i = d.j JOIN tr t ON t.trial_id = o.trial_id)
SELECT draw, cond, count(*) AS n, round(avg(n_events), 6) AS mean FROM x GROUP BY 1, 2""")
def bootstrap_means(spark, sf_dir):
    """Means of three resamples of every condition."""
    tr = _tr(spark, sf_dir)
    draws = randomise.bootstrap(tr.select("trial_id", "cond"), draws=3, seed=10).join(tr.select("trial_id", "n_events"), "trial_id")
    return draws.groupBy("draw", "cond").agg(F.count("*").alias("n"), F.round(F.avg("n_events"), 6).alias("mean"))


@query(f"""{BOTH}, s AS (SELECT cond, sum(n_events) AS s, count(*) AS n FROM tr GROUP BY cond) SELECT trial_id, round((s - n_events) / (n - 1.0), 6) AS others FROM tr JOIN s USING (cond) WHERE n > 1""")
def leave_one_out(spark, sf_dir):
    """For each trial the mean of the other trials of its condition."""
    tr = _tr(spark, sf_dir)
    return randomise.leave_one_out(tr, "cond", "n_events").select("trial_id", F.round("others", 6).alias("others"))


@query(f"""{BOTH}, x AS (SELECT cond, n_events, row_number() OVER (PARTITION BY cond ORDER BY n_events) AS k, count(*) OVER (PARTITION BY cond) AS n FROM tr),
q AS (SELECT cond, n, greatest(1.0, least(n * 1.0, 0.9 * n + 0.5)) AS r FROM (SELECT DISTINCT cond, n FROM x))
SELECT q.cond, round(a.n_events + (r - floor(r)) * (b.n_events - a.n_events), 6) AS q90 FROM q JOIN x a ON a.cond = q.cond AND a.k = floor(r) JOIN x b ON b.cond = q.cond AND b.k = least(floor(r) + 1, q.n)""")
def hazen_by_condition(spark, sf_dir):
    tr = _tr(spark, sf_dir)
    return hazen_quantiles(tr, ["cond"], "n_events", [0.9]).select("cond", F.round("x", 6).alias("q90"))


@query(f"""{BOTH}, m AS (SELECT k % 5 AS axis, cond, avg(n_events) AS x FROM tr GROUP BY 1, 2) SELECT cond, axis, round(x - lag(x) OVER (PARTITION BY cond ORDER BY axis), 6) AS step, round(x - avg(x) OVER (PARTITION BY cond), 6) AS centred FROM m""")
def axis_contrasts(spark, sf_dir):
    """Consecutive differences along an axis and deviations from the mean along it."""
    from trialloom.operators import contrasts

    tr = _tr(spark, sf_dir).withColumn("axis", F.col("k") % 5)
    m = tr.groupBy("axis", "cond").agg(F.avg("n_events").alias("x"))
    out = contrasts.subtract_mean(contrasts.consecutive(m, "axis", ["cond"], "x"), ["cond"], "x")
    return out.select("cond", "axis", F.round("step", 6).alias("step"), F.round("centred", 6).alias("centred"))


@query(f"""{BOTH}, c AS (SELECT k % 4 AS a, cond AS b, avg(n_events) AS x FROM tr GROUP BY 1, 2), g AS (SELECT a, b, avg(x) AS x FROM c GROUP BY CUBE (a, b))
SELECT c.a, c.b, round(ga.x - g0.x, 6) AS main_a, round(gb.x - g0.x, 6) AS main_b, round(c.x - ga.x - gb.x + g0.x, 6) AS interaction
FROM c JOIN g ga ON ga.a = c.a AND ga.b IS NULL JOIN g gb ON gb.b = c.b AND gb.a IS NULL JOIN g g0 ON g0.a IS NULL AND g0.b IS NULL""")
def marginalisation(spark, sf_dir):
    """Main effects and interaction of two axes from the averages of a cube."""
    from trialloom.operators import contrasts

    cells = _tr(spark, sf_dir).groupBy((F.col("k") % 4).alias("a"), F.col("cond").alias("b")).agg(F.avg("n_events").alias("x"))
    return contrasts.marginalise(cells, "a", "b", "x").select("a", "b", *[F.round(c, 6).alias(c) for c in ("main_a", "main_b", "interaction")])


@query(f"""{BOTH}, m AS (SELECT cond, k % 6 AS t, avg(n_events) AS x, stddev_samp(n_events) / sqrt(count(*)) AS s FROM tr GROUP BY 1, 2)
SELECT a.t, round(a.x - b.x, 6) AS diff, round(sqrt(a.s * a.s + b.s * b.s), 6) AS sem FROM (SELECT * FROM m WHERE cond = 1) a FULL JOIN (SELECT * FROM m WHERE cond = 0) b USING (t)""".replace("SELECT a.t,", "SELECT t,"))
def condition_difference(spark, sf_dir):
    """One condition's series less another's, with errors in quadrature, on the union of their grids."""
    from trialloom.operators import contrasts

    tr = _tr(spark, sf_dir).withColumn("t", F.col("k") % 6)
    m = tr.groupBy("cond", "t").agg(*stats.mean_sem("n_events"))
    out = contrasts.difference(m.where("cond = 1"), m.where("cond = 0"), ["t"])
    return out.select("t", F.round("diff", 6).alias("diff"), F.round("sem", 6).alias("sem"))


@query(f"""{BOTH}, m AS (SELECT cond, k % 6 AS t, avg(n_events) AS x, var_samp(n_events) AS v FROM tr GROUP BY 1, 2) SELECT t, round((a.x - b.x) / sqrt((a.v + b.v) / 2), 6) AS dprime FROM m a JOIN m b USING (t) WHERE a.cond = 1 AND b.cond = 0""")
def dprime(spark, sf_dir):
    """Discriminability of two conditions at each time."""
    tr = _tr(spark, sf_dir).withColumn("t", F.col("k") % 6)
    one = [F.when(F.col("cond") == c, F.col("n_events")) for c in (0, 1)]
    out = tr.groupBy("t").agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(one) for n, f in (("m", F.avg), ("v", F.var_samp))])
    return out.where("m0 is not null and m1 is not null").select("t", F.round(stats.dprime(F.col("m1"), F.col("v1"), F.col("m0"), F.col("v0")), 6).alias("dprime"))


@query(f"""{BOTH}, m AS (SELECT cond, k % 6 AS t, avg(n_events) AS x, stddev_samp(n_events) / sqrt(count(*)) AS s FROM tr GROUP BY 1, 2),
e AS (SELECT x, s, row_number() OVER (ORDER BY x) AS kx, row_number() OVER (ORDER BY s) AS ks, count(*) OVER () AS n FROM m WHERE s > 0),
r AS (SELECT max(greatest(1.0, least(n * 1.0, 0.95 * n + 0.5))) AS hi, max(greatest(1.0, least(n * 1.0, 0.05 * n + 0.5))) AS lo, max(greatest(1.0, least(n * 1.0, 0.9 * n + 0.5))) AS q, max(n) AS n FROM e)
SELECT round(((SELECT x FROM e, r WHERE kx = floor(hi)) + (hi - floor(hi)) * ((SELECT x FROM e, r WHERE kx = least(floor(hi) + 1, r.n)) - (SELECT x FROM e, r WHERE kx = floor(hi)))
 - (SELECT x FROM e, r WHERE kx = floor(lo)) - (lo - floor(lo)) * ((SELECT x FROM e, r WHERE kx = least(floor(lo) + 1, r.n)) - (SELECT x FROM e, r WHERE kx = floor(lo))))
 / ((SELECT s FROM e, r WHERE ks = floor(q)) + (q - floor(q)) * ((SELECT s FROM e, r WHERE ks = least(floor(q) + 1, r.n)) - (SELECT s FROM e, r WHERE ks = floor(q)))), 6) AS snr FROM r""")
def signal_to_noise(spark, sf_dir):
    """Span of the means over the size of their errors, both by quantiles."""
    tr = _tr(spark, sf_dir).withColumn("t", F.col("k") % 6)
    m = tr.groupBy("cond", "t").agg(*stats.mean_sem("n_events"))
    return timecourse.signal_to_noise(m).select(F.round("snr", 6).alias("snr"))
