"""Queries that sort, slice and reshape conditions, change channels and draw anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.operators import catalog, contrasts, population, randomise, series, windows
from trialloom.operators import conditions as C
from trialloom.plans.alignment import AROUND, CLICKS
from trialloom.plans.base import BOTH, events_long, samples, trials
from trialloom.plans.registry import query


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark, sf_dir):
    return _read(spark, sf_dir, "orders").withColumn("trial_id", F.col("o_orderkey"))


@query(f"""{CLICKS}, x AS (SELECT tr.trial_id, min(t) FILTER (event = 'view') AS v, max(t) FILTER (event = 'purchase') AS p FROM tr JOIN ev USING (trial_id) GROUP BY 1),
c AS (SELECT CASE WHEN n_events < 2 THEN 'manual' WHEN k % 7 = 0 THEN 'temporary' WHEN cond = 2 THEN 'no condition' WHEN zero IS NULL THEN 'alignment 0: missing zero event'
WHEN v IS NULL THEN 'alignment 1: missing zero event' WHEN p IS NULL THEN 'alignment 1: missing stop event' WHEN v > round(p - v) + v THEN 'alignment 1: start after stop' END AS cause FROM tr LEFT JOIN al USING (trial_id) JOIN x USING (trial_id))
SELECT coalesce(cause, 'valid') AS cause, count(*) AS n FROM c GROUP BY 1""")
def combined_validity(spark, sf_dir):
    """Trials by what makes them invalid first: by hand, for now, no condition, either of two alignments."""
    ev = events_long(spark, sf_dir)
    tr = trials(ev)
    flags = tr.select("trial_id", (F.col("n_events") >= 2).alias("manual_valid"), (F.col("k") % 7 != 0).alias("temporary_valid"))
    both = [windows.align(tr, ev, w) for w in (AROUND, "view:purchase(end) @ view")]
    got = C.combined_validity(flags, tr.where("cond <> 2"), both)
    return got.groupBy(F.coalesce("cause", F.lit("valid")).alias("cause")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey) AS rank FROM orders")
def sorted_conditions(spark, sf_dir):
    """Orders of a customer by status from last to first, then by price."""
    return C.sorted_within(_orders(spark, sf_dir), "o_custkey", ["-o_orderstatus", "o_totalprice"]).select("o_orderkey", "rank")


@query("SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('9:' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 20")
def random_per_group(spark, sf_dir):
    """Twenty orders of each status, drawn without replacement."""
    return C.random_per_group(_orders(spark, sf_dir), "o_orderstatus", 20, 9).select("o_orderkey", "o_orderstatus")


@query("""WITH p AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS i FROM (SELECT DISTINCT o_orderpriority FROM orders)), q AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) - 1 AS j FROM (SELECT DISTINCT o_orderstatus FROM orders))
SELECT j + i * (SELECT count(*) FROM q) AS cond, i + j * (SELECT count(*) FROM p) AS was, 'o_orderstatus=' || o_orderstatus || ' o_orderpriority=' || o_orderpriority AS both_axes FROM p, q WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def reshaped_axes(spark, sf_dir):
    """A cube of two axes with their order turned round, two values of one kept, and both merged into one axis."""
    o = _orders(spark, sf_dir)
    cube = C.permute_axes(C.cube({a: o.select(a) for a in ("o_orderpriority", "o_orderstatus")}), ["o_orderstatus", "o_orderpriority"])
    cut = C.slice_cube(cube, {"o_orderpriority": ["1-URGENT", "2-HIGH"]})
    flat = C.flatten_axes(cut, ["o_orderstatus", "o_orderpriority"], "both_axes")
    return flat.select(F.col("cond").cast("long").alias("cond"), F.col("was").cast("long").alias("was"), "both_axes")


@query("SELECT o_custkey AS cond, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS trials FROM orders GROUP BY 1")
def gathered_trials(spark, sf_dir):
    """The orders of each customer as a list."""
    got = C.gather(_orders(spark, sf_dir).select("trial_id", F.col("o_custkey").alias("cond")))
    return got.select("cond", "n", F.concat_ws(",", F.transform("trials", lambda x: x.cast("string"))).alias("trials"))


@query(f"{BOTH}, m AS (SELECT trial_id, median(v) AS m FROM ev GROUP BY 1) SELECT trial_id, round(median(abs(v - m)), 6) AS spread FROM ev JOIN m USING (trial_id) GROUP BY 1")
def mapped_groups(spark, sf_dir):
    """A function of one's own for each trial: the median distance from the median."""
    import numpy as np

    def spread(v: np.ndarray) -> float | None:
        v = v[~np.isnan(v)]
        return float(np.median(np.abs(v - np.median(v)))) if len(v) else None

    got = C.map_arrays(events_long(spark, sf_dir).select("trial_id", "v"), ["trial_id"], ["v"], spread, "spread")
    return got.select("trial_id", F.round("spread", 6).alias("spread"))


_MEMBERS = "m AS (SELECT o_orderkey AS trial_id, 0 AS cond, 1.0 AS weight FROM orders WHERE o_totalprice < 150000 UNION ALL SELECT o_orderkey, 1, 2.0 FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 2, 2.0 FROM orders WHERE o_totalprice > 100000)"


def _members(o):
    parts = [("o_totalprice < 150000", 0, 1.0), ("o_orderstatus = 'F'", 1, 2.0), ("o_totalprice > 100000", 2, 2.0)]
    out = None
    for where, cond, weight in parts:
        part = o.where(where).select("trial_id", F.lit(cond).alias("cond"), F.lit(weight).alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_MEMBERS} SELECT cond, round(sum(o_totalprice * weight) / sum(weight), 4) AS mean, sum(weight) AS weight FROM m JOIN orders ON o_orderkey = trial_id GROUP BY 1")
def weighted_memberships(spark, sf_dir):
    """Means over conditions that share trials with different weights."""
    o = _orders(spark, sf_dir)
    return C.weighted_means(o, _members(o), "o_totalprice").select("cond", F.round("mean", 4).alias("mean"), "weight")


@query(f"WITH {_MEMBERS} SELECT cond, conditions, count(*) AS n FROM (SELECT trial_id, arg_min(cond, -weight * 10 + cond) AS cond, count(*) AS conditions FROM m GROUP BY 1) GROUP BY 1, 2")
def first_subscripts(spark, sf_dir):
    """Each trial's condition of the largest weight, the first of equals, and how many it is in."""
    return C.first_subscript(_members(_orders(spark, sf_dir))).groupBy("cond", "conditions").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' ELSE 'low' END AS o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority NOT LIKE '3%' GROUP BY 1")
def merged_values(spark, sf_dir):
    """Values of an attribute merged by lists; the rest goes."""
    lists = {"high": ["1-URGENT", "2-HIGH"], "low": ["4-NOT SPECIFIED", "5-LOW"]}
    return C.merged_values(_orders(spark, sf_dir), "o_orderpriority", lists).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def values_in_both(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return C.values_in_both(_read(spark, sf_dir, "part"), li, "p_partkey")


@query("SELECT 'customers' AS side, c_nationkey AS nation, count(*) AS n, round(avg(c_acctbal), 4) AS balance FROM customer GROUP BY 2 UNION ALL SELECT 'suppliers', s_nationkey, count(*), NULL FROM supplier GROUP BY 2")
def union_axis(spark, sf_dir):
    """Two tables along a new axis; a column that one lacks is missing there."""
    c = _read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("balance"))
    s = _read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    return C.union_axis({"customers": c, "suppliers": s}, "side")


@query(f"""{BOTH}, s AS (SELECT trial_id, cond, k % 2 AS half FROM tr), p AS (SELECT trial_id, half, row_number() OVER (PARTITION BY half ORDER BY md5('6:' || trial_id), trial_id) AS r FROM s),
n AS (SELECT half, cond, count(*) AS n FROM s GROUP BY 1, 2), b AS (SELECT half, cond, sum(n) OVER (PARTITION BY half ORDER BY cond) AS hi, sum(n) OVER (PARTITION BY half ORDER BY cond) - n AS lo FROM n)
SELECT p.trial_id, p.half, b.cond FROM p JOIN b ON p.half = b.half AND r > lo AND r <= hi""")
def shuffled_within(spark, sf_dir):
    """Conditions dealt out anew inside each slice of another attribute."""
    tr = trials(events_long(spark, sf_dir)).select("trial_id", "cond", (F.col("k") % 2).alias("half"))
    return randomise.shuffle_within(tr, "half", seed=6)


@query(f"""{BOTH}, o AS (SELECT trial_id, cond, n_events, row_number() OVER (PARTITION BY cond ORDER BY trial_id) - 1 AS i FROM tr), z AS (SELECT cond, count(*) AS n FROM tr GROUP BY 1),
d AS (SELECT draw, o.cond, CASE WHEN o.cond = 0 THEN 1 ELSE o.cond END AS pool, i FROM o, (SELECT unnest(range(0, 2)) AS draw)),
e AS (SELECT draw, d.cond, pool, CAST(('0x' || substr(md5((20 + draw) || ':' || d.cond || ':' || i), 1, 8)) AS BIGINT) % z.n AS j FROM d JOIN z ON z.cond = pool)
SELECT draw, e.cond, count(*) AS n, round(avg(n_events), 6) AS mean FROM e JOIN o ON o.cond = pool AND o.i = j GROUP BY 1, 2""")
def bootstrap_from_others(spark, sf_dir):
    """Two resamples in which one condition's trials are taken from another."""
    tr = trials(events_long(spark, sf_dir)).withColumn("cond", F.col("cond").cast("long"))
    draws = randomise.bootstrap_from(tr.select("trial_id", "cond"), {0: 1}, 2, 20).join(tr.select("trial_id", "n_events"), "trial_id")
    return draws.groupBy("draw", "cond").agg(F.count("*").alias("n"), F.round(F.avg("n_events"), 6).alias("mean"))


_CUBE = "x AS (SELECT label AS cond, vec_id, i - 1 AS basis, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)), c AS (SELECT basis, cond, avg(v) AS mean, stddev_samp(v) / sqrt(count(v)) AS sem, count(v) AS n FROM x GROUP BY 1, 2)"


def _cube(spark, sf_dir):
    return population.population(_read(spark, sf_dir, "embeddings"), "label", "embedding")


@query(f"""WITH {_CUBE}, o AS (SELECT vec_id, label AS cond, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
d AS (SELECT draw, cond, CAST(('0x' || substr(md5((30 + draw) || ':' || cond || ':' || i), 1, 8)) AS BIGINT) % n AS j FROM o, (SELECT unnest(range(0, 2)) AS draw)),
q AS (SELECT draw, d.cond, basis, avg(v) AS mean FROM d JOIN o ON o.cond = d.cond AND o.i = j JOIN x ON x.vec_id = o.vec_id GROUP BY 1, 2, 3),
s AS (SELECT draw, basis, avg(mean) AS m, stddev_pop(mean) AS s FROM q GROUP BY 1, 2) SELECT q.draw, q.basis, cond, round(s.m + (mean - s.m) * s0.s / s.s, 5) AS mean FROM q JOIN s USING (draw, basis) JOIN s s0 ON s0.draw = 0 AND s0.basis = q.basis""")
def population_bootstrap(spark, sf_dir):
    """Resampled cubes, brought to the variance of the first."""
    e = _read(spark, sf_dir, "embeddings")
    draws = randomise.bootstrap(e.select(F.col("vec_id").alias("trial_id"), F.col("label").alias("cond")), draws=2, seed=30)
    values = e.select(F.col("vec_id").alias("trial_id"), F.posexplode("embedding").alias("basis", "v")).withColumn("v", F.col("v").cast("double"))
    return population.resampled_cubes(values, draws).select("draw", "basis", "cond", F.round("mean", 5).alias("mean"))


@query(f"WITH {_CUBE}, s AS (SELECT basis, avg(mean) AS m, stddev_pop(mean) AS s FROM c GROUP BY 1) SELECT basis, cond, round((mean - m) / s * 2 + 2, 5) AS z, round(sem / s * 2, 5) AS sem, round(mean, 6) AS back FROM c JOIN s USING (basis)")
def translated_and_back(spark, sf_dir):
    """A cube normalised, then moved by one and doubled, as one translation; and back again."""
    cube = _cube(spark, sf_dir)
    first = population.translation(cube)
    both = population.compose(first, first.select("basis", F.lit(1.0).alias("offset"), F.lit(2.0).alias("norm")))
    there = population.apply_translation(cube, both)
    back = population.apply_translation(there, both, inverse=True).select("basis", "cond", F.col("mean").alias("back"))
    return there.join(back, ["basis", "cond"]).select("basis", "cond", F.round("mean", 5).alias("z"), F.round("sem", 5).alias("sem"), F.round("back", 6).alias("back"))


@query(f"WITH {_CUBE}, b AS (SELECT basis, covar_pop(cond, mean) / var_pop(cond) AS b FROM c GROUP BY 1), w AS (SELECT basis, b / sqrt((SELECT sum(b * b) FROM b)) AS w FROM b) SELECT cond, round(sum(w * mean), 5) AS score FROM c JOIN w USING (basis) GROUP BY 1")
def targeted_projection(spark, sf_dir):
    """Conditions along the direction in which the population changes with the condition's number."""
    cube = _cube(spark, sf_dir)
    weights = population.targeted_weights(cube, cube.select("cond").distinct().select("cond", F.lit(0).alias("dimension"), F.col("cond").cast("double").alias("x")))
    return population.project(cube, weights).select("cond", F.round("mean", 5).alias("score"))


@query(f"WITH {_CUBE}, m AS (SELECT basis, avg(mean) AS m FROM c GROUP BY basis) SELECT basis, cond, round(mean - m, 5) AS mean FROM c JOIN m USING (basis)")
def reconstruction(spark, sf_dir):
    """All components of a population, encoded back: what the projection took apart comes together again."""
    cube = _cube(spark, sf_dir)
    weights = population.component_weights(cube, 64)
    scores = population.scores(cube, weights)
    return population.reconstruct(scores, weights.select("basis", "dimension", "w")).select("basis", "cond", F.round("mean", 5).alias("mean"))


@query(f"""{BOTH}, s AS (SELECT k % 6 AS t, avg(n_events) FILTER (cond = 1) AS m0, avg(n_events) FILTER (cond = 0) AS m1, var_samp(n_events) FILTER (cond = 1) AS v0, var_samp(n_events) FILTER (cond = 0) AS v1, count(*) FILTER (cond = 1) AS n0, count(*) FILTER (cond = 0) AS n1 FROM tr GROUP BY 1)
SELECT t, round(m0 - m1, 6) AS diff, round(m0 - m1 - 1.959963984540054 * sqrt(v0 / n0 + v1 / n1), 6) AS low, round(m0 - m1 + 1.959963984540054 * sqrt(v0 / n0 + v1 / n1), 6) AS high,
round((m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)) * (1 - 3.0 / (4 * (n0 + n1 - 2) - 1)), 6) AS hedges_g FROM s WHERE n0 > 1 AND n1 > 1""")
def compared_conditions(spark, sf_dir):
    """Two conditions at each time: difference with its interval, and Hedges' g."""
    tr = trials(events_long(spark, sf_dir)).withColumn("t", F.col("k") % 6)
    return contrasts.compare(tr, ["t"], "cond", 1, 0, "n_events").select("t", *[F.round(c, 6).alias(c) for c in ("diff", "low", "high", "hedges_g")])


@query("""WITH l AS (SELECT l_orderkey % 4 AS fold, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), f AS (SELECT DISTINCT fold FROM l), r AS (SELECT unnest([0.0, 1000.0, 100000.0]) AS ridge),
s AS (SELECT f.fold, ridge, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) AS xy, var_pop(x) * count(*) AS xx FROM l JOIN f ON l.fold <> f.fold, r GROUP BY 1, 2)
SELECT ridge, round(avg((y - my - xy / (xx + ridge) * (x - mx)) * (y - my - xy / (xx + ridge) * (x - mx))), 4) AS error FROM l JOIN s USING (fold) GROUP BY 1""")
def cross_validated_ridge(spark, sf_dir):
    """Prediction error of unseen folds for three ridges."""
    li = _read(spark, sf_dir, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)
    got = contrasts.cross_validated_ridge(li, F.col("l_orderkey") % 4, ["l_quantity"], "y", [0.0, 1000.0, 100_000.0], 4)
    return got.select("ridge", F.round("error", 4).alias("error"))


@query(f"{CLICKS} SELECT ev.trial_id, event_id, round(t, 3) AS t FROM al JOIN ev ON ev.trial_id = al.trial_id AND t BETWEEN start AND stop")
def trimmed_samples(spark, sf_dir):
    """Events inside their trial's window, with their own times."""
    ev = events_long(spark, sf_dir)
    got = windows.trim(ev.select("trial_id", "event_id", "t"), windows.align(trials(ev), ev, AROUND))
    return got.select("trial_id", "event_id", F.round("t", 3).alias("t"))


@query(f"{CLICKS}, i AS (SELECT trial_id, min(t) AS t0, max(t) AS t1 FROM ev WHERE event = 'view' GROUP BY 1) SELECT trial_id, 'interval' AS kind, round(greatest(t0, start) - zero, 3) AS t0, round(least(t1, stop) - zero, 3) AS t1 FROM i JOIN al USING (trial_id) WHERE t0 <= stop AND t1 >= start UNION ALL SELECT ev.trial_id, 'point', round(t - zero, 3), round(t - zero, 3) FROM ev JOIN al ON al.trial_id = ev.trial_id AND t BETWEEN start AND stop WHERE event = 'error'")
def marks_in_windows(spark, sf_dir):
    """Errors as points and the time of views as intervals, relative to the first click."""
    ev = events_long(spark, sf_dir)
    al = windows.align(trials(ev), ev, AROUND)
    views = ev.where("event = 'view'").groupBy("trial_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    at = [F.round(c, 3).alias(n) for c, n in (("t0", "t0"), ("t1", "t1"))]
    spans = windows.mark_intervals(views, al).select("trial_id", F.lit("interval").alias("kind"), *at)
    marks = windows.marks(trials(ev), ev, al, "error")
    return spans.unionByName(marks.select("trial_id", F.lit("point").alias("kind"), F.round("t", 3).alias("t0"), F.round("t", 3).alias("t1")))


@query(f"{CLICKS} SELECT 0 AS align_id, trial_id, round(zero, 3) AS zero FROM al UNION ALL SELECT 1, trial_id, round(t, 3) FROM ev WHERE event = 'view' AND occ = 1")
def several_alignments(spark, sf_dir):
    """The same trials aligned to two events at once."""
    ev = events_long(spark, sf_dir)
    return windows.align_all(trials(ev), ev, [AROUND, "view-1000:view+1000 @ view"]).where("valid").select("align_id", "trial_id", F.round("zero", 3).alias("zero"))


@query("SELECT c_custkey, c_acctbal AS balance, c_acctbal AS balance_before, c_acctbal * 2 AS doubled, c_name FROM customer")
def changed_channels(spark, sf_dir):
    """A channel copied, one added, one renamed and one dropped."""
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name", "c_mktsegment")
    return catalog.changed(c, add={"doubled": F.col("c_acctbal") * 2}, copy={"balance_before": "c_acctbal"}, rename={"c_acctbal": "balance"}, drop=["c_mktsegment"])


@query(f"{CLICKS} SELECT ev.trial_id, event_id, round(t - zero + zero, 3) AS t FROM al JOIN ev ON ev.trial_id = al.trial_id AND t BETWEEN start AND stop")
def stored_times(spark, sf_dir):
    """Aligned times turned back into the trials' own."""
    ev = events_long(spark, sf_dir)
    al = windows.align(trials(ev), ev, AROUND)
    got = catalog.stored_times(windows.in_window(ev.select("trial_id", "event_id", "t"), al), al)
    return got.select("trial_id", "event_id", F.round("t", 3).alias("t"))


@query("SELECT * FROM (VALUES ('c_custkey', NULL, 'key'), ('c_name', NULL, NULL), ('c_acctbal', 'dollar', 'param')) AS x(channel, units, kind)")
def channel_notes(spark, sf_dir):
    """Notes on channels, kept with the table."""
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return catalog.descriptions(catalog.described(c, {"c_custkey": {"kind": "key"}, "c_acctbal": {"units": "dollar", "kind": "param"}}), ["units", "kind"])


@query("""WITH i AS (SELECT unnest(range(1, 40)) AS i), p AS (SELECT i, min(substr(c_name, 1, i)) AS p, max(substr(c_name, 1, i)) AS q, min(length(c_name)) AS n FROM customer, i GROUP BY 1) SELECT p AS prefix FROM p WHERE p = q AND i <= n ORDER BY i DESC LIMIT 1""")
def common_prefix(spark, sf_dir):
    """What all customers' names begin with."""
    return catalog.common_prefix(_read(spark, sf_dir, "customer"), "c_name")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
def virtual_channels(spark, sf_dir):
    """A channel computed when it is read, from another such one."""
    made = catalog.VirtualChannels().define("net", F.col("l_extendedprice") * (1 - F.col("l_discount"))).define("unused", F.lit(1)).define("charge", F.col("net") * (1 + F.col("l_tax")), ["net"])
    return made.read(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax"), ["charge"]).select("l_orderkey", "l_linenumber", "charge")


@query(f"{BOTH} SELECT event_id, rank() OVER (PARTITION BY trial_id ORDER BY v) AS rank FROM ev")
def value_ranks(spark, sf_dir):
    ev = events_long(spark, sf_dir)
    return series.ranks(ev, ["trial_id"], "v").select("event_id", "rank")


@query(f"{BOTH}, o AS (SELECT trial_id, t, row_number() OVER (PARTITION BY trial_id ORDER BY t) AS a, row_number() OVER (PARTITION BY trial_id ORDER BY t DESC) AS z FROM ev WHERE v >= 60) SELECT trial_id, round(max(t) FILTER (a = 2), 3) AS second, round(max(t) FILTER (z = 1), 3) AS last FROM o GROUP BY 1 HAVING count(*) >= 2")
def nth_true(spark, sf_dir):
    """The second and the last sample of at least 60, where there are two."""
    s = samples(events_long(spark, sf_dir)).withColumn("on", F.col("v") >= 60)
    last = series.nth_true(s, 1, from_end=True).withColumnRenamed("t", "last")
    return series.nth_true(s, 2).join(last, "trial_id").select("trial_id", F.round("t", 3).alias("second"), F.round("last", 3).alias("last"))


_CELLS = f"""{BOTH}, c AS (SELECT k % 4 AS a, cond AS b, user_id % 2 AS d, avg(n_events) AS x FROM tr GROUP BY 1, 2, 3),
m AS (SELECT *, avg(x) OVER () AS g, avg(x) OVER (PARTITION BY a) AS ma, avg(x) OVER (PARTITION BY b) AS mb, avg(x) OVER (PARTITION BY d) AS md, avg(x) OVER (PARTITION BY a, b) AS mab, avg(x) OVER (PARTITION BY a, d) AS mad, avg(x) OVER (PARTITION BY b, d) AS mbd FROM c),
e AS (SELECT a, b, d, unnest(['a', 'b', 'd', 'a:b', 'a:d', 'b:d', 'a:b:d']) AS term, unnest([ma - g, mb - g, md - g, mab - ma - mb + g, mad - ma - md + g, mbd - mb - md + g, x - mab - mad - mbd + ma + mb + md - g]) AS effect FROM m)"""


def _effects(spark, sf_dir):
    tr = trials(events_long(spark, sf_dir))
    cells = tr.groupBy((F.col("k") % 4).alias("a"), F.col("cond").alias("b"), (F.col("user_id") % 2).alias("d")).agg(F.avg("n_events").alias("x"))
    return contrasts.effects(cells, ["a", "b", "d"], "x")


@query(f"{_CELLS} SELECT a, b, d, term, round(effect, 6) AS effect FROM e")
def effects_of_three_axes(spark, sf_dir):
    """Main effects and interactions of three axes in each cell of a cube."""
    return _effects(spark, sf_dir).withColumn("effect", F.round("effect", 6))


@query(f"{_CELLS}, v AS (SELECT term, avg(effect * effect) AS v FROM e GROUP BY 1) SELECT term, round(v, 6) AS variance, round(v / (SELECT sum(v) FROM v), 6) AS share FROM v")
def variance_by_term(spark, sf_dir):
    """How much of the variance each set of axes accounts for."""
    return contrasts.variance_by_term(_effects(spark, sf_dir)).select("term", F.round("variance", 6).alias("variance"), F.round("share", 6).alias("share"))


@query(f"WITH {_CUBE} SELECT basis, bool_or(mean > 0) AS any_positive, bool_and(mean > 0) AS all_positive, arg_max(cond, mean) AS highest, arg_min(cond, mean) AS lowest FROM c GROUP BY 1")
def over_conditions(spark, sf_dir):
    """Whether each basis is ever and always positive, and where it is highest and lowest."""
    return population.over_conditions(_cube(spark, sf_dir))


@query(f"{CLICKS} SELECT coalesce(cause, 'valid') AS cause, cond, count(*) AS n, round(avg(n_events), 6) AS mean FROM (SELECT tr.*, CASE WHEN n_events < 2 THEN 'few events' WHEN zero IS NULL THEN 'missing zero event' END AS cause FROM tr LEFT JOIN al USING (trial_id)) WHERE cause IS NULL GROUP BY 1, 2")
def trials_as_one_object(spark, sf_dir):
    """Aligned, filtered and grouped in one chain of steps: means of valid trials by condition."""
    from trialloom.api import Trials

    ev = events_long(spark, sf_dir)
    td = Trials(trials(ev).withColumnRenamed("cond", "third"), ev).align(AROUND).keep(F.col("n_events") >= 2, "few events").group_by("third")
    return td.means("n_events").select(F.lit("valid").alias("cause"), F.col("cond").cast("long").alias("cond"), "n", F.round("mean", 6).alias("mean"))
