"""Queries on how populations move and on what their components read."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.operators import demixing, dynamics, population, randomise
from trialloom.plans.population import _X
from trialloom.plans.registry import query
from trialloom.plans.timecourse import _POPULATION, _SOURCES, _stored_population

# The fitted rotation of three bases is a cross product with w, and (tr S - S) w = e.
_ROTATION = f"""{_POPULATION}, p AS (SELECT cond, bin, max(mean) FILTER (basis = 'error') AS a, max(mean) FILTER (basis = 'purchase') AS b, max(mean) FILTER (basis = 'view') AS c FROM pop GROUP BY 1, 2 HAVING count(mean) = 3),
z AS (SELECT cond, bin, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b, c - avg(c) OVER w AS c FROM p WINDOW w AS (PARTITION BY bin)),
d AS (SELECT z.*, y.a - z.a AS da, y.b - z.b AS db, y.c - z.c AS dc FROM z JOIN z y ON y.cond = z.cond AND y.bin = z.bin + 1),
s AS (SELECT sum(b * b) + sum(c * c) AS k11, sum(a * a) + sum(c * c) AS k22, sum(a * a) + sum(b * b) AS k33, -sum(a * b) AS k12, -sum(a * c) AS k13, -sum(b * c) AS k23,
  -(sum(b * dc) - sum(c * db)) AS e1, sum(a * dc) - sum(c * da) AS e2, -(sum(a * db) - sum(b * da)) AS e3 FROM d),
t AS (SELECT *, k11 * (k22 * k33 - k23 * k23) - k12 * (k12 * k33 - k23 * k13) + k13 * (k12 * k23 - k22 * k13) AS det FROM s),
w AS (SELECT (e1 * (k22 * k33 - k23 * k23) - k12 * (e2 * k33 - k23 * e3) + k13 * (e2 * k23 - k22 * e3)) / det AS w1,
  (k11 * (e2 * k33 - k23 * e3) - e1 * (k12 * k33 - k23 * k13) + k13 * (k12 * e3 - e2 * k13)) / det AS w2,
  (k11 * (k22 * e3 - e2 * k23) - k12 * (k12 * e3 - e2 * k13) + e1 * (k12 * k23 - k22 * k13)) / det AS w3 FROM t),
u AS (SELECT *, sqrt(w1 * w1 + w2 * w2 + w3 * w3) AS f FROM w)"""


@query(f"""{_ROTATION}, g AS (SELECT cond, bin, f, a * a + b * b + c * c AS r, abs(a * w1 + b * w2 + c * w3) / f AS n FROM z, u)
SELECT cond, bin, round(f, 5) AS frequency, round(sqrt(greatest(0, r - n * n)), 5) AS radius, round(n, 5) AS along FROM g""")
def rotational_components(spark, sf_dir):
    """Where each condition stands in the plane in which the population turns: how far from its
    axis, how far along it, and how fast the plane turns."""
    bases = list(_SOURCES)
    states = dynamics.states_in_time(_stored_population(spark, sf_dir), bases)
    weights, _ = dynamics.rotational_weights(states, bases, 3)
    score = lambda d: F.max(F.when(F.col("dimension") == d, F.col("score")))
    at = dynamics.along(states, weights, bases).groupBy("cond", "bin").agg(*[score(d).alias(f"s{d}") for d in range(3)])
    speed = weights.where("dimension = 0").agg(F.max("frequency").alias("f"))
    return at.crossJoin(speed).select("cond", "bin", F.round("f", 5).alias("frequency"), F.round(F.sqrt(F.col("s0") * F.col("s0") + F.col("s1") * F.col("s1")), 5).alias("radius"), F.round(F.abs("s2"), 5).alias("along"))


@query(f"""{_ROTATION} SELECT 'error' AS i, 'purchase' AS j, round(-w3, 6) AS m FROM u UNION ALL SELECT 'error', 'view', round(w2, 6) FROM u UNION ALL SELECT 'purchase', 'view', round(-w1, 6) FROM u""")
def rotation_between_bases(spark, sf_dir):
    """The fitted rotation of the population, by pairs of bases."""
    bases = list(_SOURCES)
    _, turns = dynamics.rotational_weights(dynamics.states_in_time(_stored_population(spark, sf_dir), bases), bases, 3)
    return turns.where("i < j").select("i", "j", F.round("m", 6).alias("m"))


_WALKS = """WITH RECURSIVE e AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS e, CAST(embedding[i + 32] AS DOUBLE) AS u FROM embeddings, (SELECT unnest(range(1, 33)) AS i)),
s AS (SELECT vec_id, i, x, 2 * x + 3 * u AS z FROM (SELECT vec_id, i, u, sum(e) OVER (PARTITION BY vec_id ORDER BY i) AS x FROM e)),
m AS (SELECT sum(x * x) AS xx, sum(z * x) AS zx, sum(z * z) AS zz, count(*) AS n FROM s WHERE vec_id % 4 <> 3),
k AS (SELECT sum(p.x * p.x) AS s11, sum(q.x * p.x) AS s21, sum(q.x * q.x) AS s22, count(*) AS n1 FROM s p JOIN s q ON p.vec_id = q.vec_id AND q.i = p.i + 1 WHERE p.vec_id % 4 <> 3),
par AS (SELECT a, (s22 - 2 * a * s21 + a * a * s11) / n1 AS w, h, (zz - 2 * h * zx + h * h * xx) / n AS q FROM (SELECT *, s21 / s11 AS a, zx / xx AS h FROM m, k)),
r(vec_id, i, x, p) AS (SELECT vec_id, i, x, CAST(0 AS DOUBLE) FROM s WHERE i = 1 AND vec_id % 4 = 3
  UNION ALL SELECT vec_id, i, a * x + g * (z - h * a * x), (1 - g * h) * pm FROM (
    SELECT s.vec_id, s.i, r.x, s.z, a, h, a * a * r.p + w AS pm, (a * a * r.p + w) * h / (h * h * (a * a * r.p + w) + q) AS g FROM r JOIN s ON s.vec_id = r.vec_id AND s.i = r.i + 1, par))"""


@query(f"{_WALKS} SELECT vec_id AS trial_id, i AS bin, round(x, 5) AS estimate FROM r")
def decoded_states(spark, sf_dir):
    """A walk, seen through noise, decoded for the trials that the decoder has not learned from."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    steps = e.select(F.col("vec_id").alias("trial_id"), F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.struct(
        F.aggregate(F.slice("embedding", 1, i), F.lit(0.0), lambda s, v: s + v.cast("double")).alias("x"), F.element_at("embedding", i + 32).cast("double").alias("u")))).alias("i", "s"))
    series = steps.select("trial_id", (F.col("i") + 1).cast("long").alias("bin"), F.array("s.x").alias("x"), F.array(2 * F.col("s.x") + 3 * F.col("s.u")).alias("z"))
    decoder = dynamics.fit_decoder(series.where("trial_id % 4 <> 3"))
    return dynamics.decode(series.where("trial_id % 4 = 3"), decoder).select("trial_id", "bin", F.round(F.col("estimate")[0], 5).alias("estimate"))


_LINES = "SELECT l_orderkey % 4 AS fold, l_returnflag AS a, l_linenumber % 2 AS b, basis, CASE basis WHEN 'price' THEN l_extendedprice / 1000 ELSE l_quantity END AS v FROM lineitem, (SELECT unnest(['price', 'quantity']) AS basis)"
_RIDGES = [0.0, 0.5, 50.0]


def _lines(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    bases = F.inline(F.array(F.struct(F.lit("price").alias("basis"), (F.col("l_extendedprice").cast("double") / 1000).alias("v")), F.struct(F.lit("quantity").alias("basis"), F.col("l_quantity").cast("double").alias("v"))))
    return li.select((F.col("l_orderkey") % 4).alias("fold"), F.col("l_returnflag").alias("a"), (F.col("l_linenumber") % 2).alias("b"), bases)


@query(f"""WITH l AS ({_LINES}), c AS (SELECT fold, a, b, basis, sum(v) AS s, count(v) AS n FROM l GROUP BY 1, 2, 3, 4),
m AS (SELECT fold, a, b, basis, s / n AS y, (sum(s) OVER w - s) / (sum(n) OVER w - n) AS x FROM c WINDOW w AS (PARTITION BY a, b, basis)),
z AS (SELECT fold, a, b, basis, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM m WINDOW w AS (PARTITION BY fold, basis)),
f AS (SELECT *, avg(x) OVER (PARTITION BY fold, basis, a) AS ma, avg(x) OVER (PARTITION BY fold, basis, b) AS mb FROM z),
t AS (SELECT fold, a, b, basis, x, y, term, CASE term WHEN 'a' THEN ma WHEN 'b' THEN mb ELSE x - ma - mb END AS t FROM f, (SELECT unnest(['a', 'b', 'a:b']) AS term)),
w AS (SELECT fold, a, b, term, max(x) FILTER (basis = 'price') AS x1, max(x) FILTER (basis = 'quantity') AS x2, max(y) FILTER (basis = 'price') AS y1, max(y) FILTER (basis = 'quantity') AS y2, max(t) FILTER (basis = 'price') AS t1, max(t) FILTER (basis = 'quantity') AS t2 FROM t GROUP BY 1, 2, 3, 4),
g AS (SELECT fold, term, ridge, sum(x1 * x1) + ridge AS g11, sum(x1 * x2) AS g12, sum(x2 * x2) + ridge AS g22, sum(t1 * x1) AS h11, sum(t1 * x2) AS h12, sum(t2 * x1) AS h21, sum(t2 * x2) AS h22,
  sum(t1 * y1) AS e11, sum(t1 * y2) AS e12, sum(t2 * y1) AS e21, sum(t2 * y2) AS e22, sum(y1 * y1) AS c11, sum(y1 * y2) AS c12, sum(y2 * y2) AS c22, sum(t1 * t1) + sum(t2 * t2) AS tt FROM w, (SELECT unnest({_RIDGES}) AS ridge) GROUP BY 1, 2, 3),
i AS (SELECT *, g11 * g22 - g12 * g12 AS det FROM g),
q AS (SELECT *, (h11 * g22 - h12 * g12) / det AS b11, (h12 * g11 - h11 * g12) / det AS b12, (h21 * g22 - h22 * g12) / det AS b21, (h22 * g11 - h21 * g12) / det AS b22 FROM i)
SELECT ridge, round(sum(tt - 2 * (b11 * e11 + b12 * e12 + b21 * e21 + b22 * e22) + b11 * b11 * c11 + 2 * b11 * b12 * c12 + b12 * b12 * c22 + b21 * b21 * c11 + 2 * b21 * b22 * c12 + b22 * b22 * c22) / sum(tt), 5) AS error FROM q GROUP BY 1""")
def demixing_ridge(spark, sf_dir):
    """How well terms of price and quantity are read from unseen trials, for three ridges."""
    got = demixing.cross_validated_demixing(_lines(spark, sf_dir), ["a", "b"], ["price", "quantity"], _RIDGES, 2)
    return got.select("ridge", F.round("error", 5).alias("error"))


@query(f"""WITH l AS ({_LINES}), c AS (SELECT a, b, basis, avg(v) AS v FROM l GROUP BY 1, 2, 3), z AS (SELECT a, b, basis, v - avg(v) OVER (PARTITION BY basis) AS x FROM c),
f AS (SELECT *, avg(x) OVER (PARTITION BY basis, a) AS ma, avg(x) OVER (PARTITION BY basis, b) AS mb FROM z),
t AS (SELECT a, b, basis, x, term, CASE term WHEN 'a' THEN ma WHEN 'b' THEN mb ELSE x - ma - mb END AS t FROM f, (SELECT unnest(['a', 'b', 'a:b']) AS term)),
w AS (SELECT a, b, term, max(x) FILTER (basis = 'price') AS x1, max(x) FILTER (basis = 'quantity') AS x2, max(t) FILTER (basis = 'price') AS t1, max(t) FILTER (basis = 'quantity') AS t2 FROM t GROUP BY 1, 2, 3),
g AS (SELECT term, sum(x1 * x1) AS g11, sum(x1 * x2) AS g12, sum(x2 * x2) AS g22, sum(t1 * x1) AS h11, sum(t1 * x2) AS h12, sum(t2 * x1) AS h21, sum(t2 * x2) AS h22, sum(t1 * t1) AS t11, sum(t1 * t2) AS t12, sum(t2 * t2) AS t22 FROM w GROUP BY 1),
i AS (SELECT *, (g11 + 0.5) * (g22 + 0.5) - g12 * g12 AS det FROM g),
q AS (SELECT *, (h11 * (g22 + 0.5) - h12 * g12) / det AS b11, (h12 * (g11 + 0.5) - h11 * g12) / det AS b12, (h21 * (g22 + 0.5) - h22 * g12) / det AS b21, (h22 * (g11 + 0.5) - h21 * g12) / det AS b22 FROM i),
v AS (SELECT *, b11 * b11 * g11 + 2 * b11 * b12 * g12 + b12 * b12 * g22 AS p, b21 * b21 * g11 + 2 * b21 * b22 * g12 + b22 * b22 * g22 AS r, b11 * b21 * g11 + (b11 * b22 + b12 * b21) * g12 + b12 * b22 * g22 AS o FROM q),
y AS (SELECT *, o AS u1, (p + r) / 2 + sqrt((p - r) * (p - r) / 4 + o * o) - p AS u2 FROM v),
d AS (SELECT *, (b11 * u1 + b21 * u2) / sqrt(u1 * u1 + u2 * u2) AS d1, (b12 * u1 + b22 * u2) / sqrt(u1 * u1 + u2 * u2) AS d2, u1 / sqrt(u1 * u1 + u2 * u2) AS f1, u2 / sqrt(u1 * u1 + u2 * u2) AS f2 FROM y),
x AS (SELECT term, d1, d2, (2 * (d1 * (g11 * f1 + g12 * f2) + d2 * (g12 * f1 + g22 * f2)) - (d1 * d1 * g11 + 2 * d1 * d2 * g12 + d2 * d2 * g22)) / (g11 + g22) AS explained FROM d),
k AS (SELECT x.*, o.term AS of_term, d1 * d1 * t11 + 2 * d1 * d2 * t12 + d2 * d2 * t22 AS spread FROM x, g o)
SELECT term, of_term, round(explained, 5) AS explained, round(spread / sum(spread) OVER (PARTITION BY term), 5) AS share FROM k""")
def demixed_components(spark, sf_dir):
    """For each term of price and quantity the component that reads it: what it explains, and of which terms its scores are made."""
    cells = _lines(spark, sf_dir).groupBy("a", "b", "basis").agg(F.avg("v").alias("mean"))
    _, _, shares = demixing.demixed_components(cells, ["a", "b"], ["price", "quantity"], 1, 0.5)
    return shares.select("term", "of_term", F.round("explained", 5).alias("explained"), F.round("share", 5).alias("share"))


@query(f"""{_X}, z AS (SELECT cond, basis, mean - avg(mean) OVER (PARTITION BY basis) AS z FROM c)
SELECT a.basis AS i, b.basis AS j, round(sum(a.z * b.z), 6) AS g FROM z a JOIN z b USING (cond) WHERE a.basis % 2 = 0 AND b.basis % 2 = 1 GROUP BY 1, 2""")
def regression_between_populations(spark, sf_dir):
    """One half of the bases read from the other with a ridge: the weights solve the normal equations."""
    cube = population.population(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "label", "embedding")
    even, odd = cube.where("basis % 2 = 0"), cube.where("basis % 2 = 1")
    w = demixing.regression_weights(even, list(range(0, 64, 2)), odd, list(range(1, 64, 2)), ["cond"], 0.01)
    g = population.gram(even)
    whole = g.unionByName(g.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "g")).withColumn("g", F.col("g") + F.when(F.col("i") == F.col("j"), 0.01).otherwise(0.0))
    back = whole.join(w.withColumnRenamed("basis", "j"), "j").groupBy("i", F.col("dimension").alias("j2")).agg(F.sum(F.col("g") * F.col("w")).alias("g"))
    return back.select("i", F.col("j2").alias("j"), F.round("g", 6).alias("g"))


@query(f"""{_X}, k AS (SELECT cond, basis, v, md5('12:' || vec_id) AS h FROM x), y AS (SELECT cond, basis, (arg_min(v, h) - arg_max(v, h)) / sqrt(2.0 * count(*)) AS diff FROM k GROUP BY 1, 2 HAVING count(*) > 1),
z AS (SELECT cond, basis, mean - avg(mean) OVER (PARTITION BY basis) AS z FROM c), s AS (SELECT basis % 3 AS dimension, cond, sum(z / (1 + basis)) AS z, sum(diff / (1 + basis)) AS e FROM z JOIN y USING (cond, basis) GROUP BY 1, 2),
t AS (SELECT dimension, sum(z * z) AS total, sum(e * e) AS noise, greatest(0, sum(z * z) - sum(e * e)) AS signal FROM s GROUP BY 1)
SELECT dimension, round(total, 6) AS total, round(noise, 6) AS noise, round(signal, 6) AS signal, round(sum(signal) OVER (ORDER BY dimension) / (SELECT sum(total) FROM t), 6) AS share FROM t""")
def signal_variance(spark, sf_dir):
    """What of the variance of three projections is signal, by the noise of pairs of trials in the same projections."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    values = e.select(F.col("vec_id").alias("trial_id"), F.col("label").alias("cond"), F.posexplode("embedding").alias("basis", "v")).withColumn("v", F.col("v").cast("double"))
    noise = randomise.pair_differences(values, ["cond", "basis"], "v", 12)
    cube = population.population(e, "label", "embedding")
    weights = cube.select("basis").distinct().select("basis", (F.col("basis") % 3).alias("dimension"), (1.0 / (1 + F.col("basis"))).alias("w"))
    return demixing.signal_variance(cube, noise, weights).select("dimension", *[F.round(c, 6).alias(c) for c in ("total", "noise", "signal", "share")])


@query(f"""{_POPULATION}, p AS (SELECT cond, bin, max(mean) FILTER (basis = 'error') AS a, max(mean) FILTER (basis = 'purchase') AS b, max(mean) FILTER (basis = 'view') AS c FROM pop GROUP BY 1, 2 HAVING count(mean) = 3),
z AS (SELECT cond, bin, a - avg(a) OVER () AS a, b - avg(b) OVER () AS b, c - avg(c) OVER () AS c FROM p),
g AS (SELECT sum(a * a) AS s11, sum(a * b) AS s12, sum(a * c) AS s13, sum(b * b) AS s22, sum(b * c) AS s23, sum(c * c) AS s33 FROM z),
q AS (SELECT *, (s11 + s22 + s33) / 3 AS m FROM g), r AS (SELECT *, sqrt(((s11 - m) * (s11 - m) + (s22 - m) * (s22 - m) + (s33 - m) * (s33 - m) + 2 * (s12 * s12 + s13 * s13 + s23 * s23)) / 6) AS p FROM q),
o AS (SELECT *, acos(greatest(-1, least(1, ((s11 - m) * ((s22 - m) * (s33 - m) - s23 * s23) - s12 * (s12 * (s33 - m) - s23 * s13) + s13 * (s12 * s23 - (s22 - m) * s13)) / (2 * p * p * p)))) / 3 AS phi FROM r),
v AS (SELECT *, m + 2 * p * cos(phi) AS l1 FROM o), e AS (SELECT v.*, s12 * s23 - s13 * (s22 - l1) AS e1, s13 * s12 - s23 * (s11 - l1) AS e2, (s11 - l1) * (s22 - l1) - s12 * s12 AS e3 FROM v),
n AS (SELECT *, sqrt(e1 * e1 + e2 * e2 + e3 * e3) * CASE WHEN abs(e1) >= abs(e2) AND abs(e1) >= abs(e3) THEN sign(e1) WHEN abs(e2) >= abs(e3) THEN sign(e2) ELSE sign(e3) END AS length FROM e)
SELECT cond, bin, round((a * e1 + b * e2 + c * e3) / length, 4) AS score, round(l1 / (3 * m), 5) AS explained FROM z, n""")
def components_over_time(spark, sf_dir):
    """The population over conditions and time along its direction of largest variance, at times at which all bases have data."""
    bases = list(_SOURCES)
    rows = population.complete_over_time(_stored_population(spark, sf_dir), bases)
    weights = population.component_weights(rows, 1)
    scores = population.scores(rows, weights)
    return scores.select("cond.cond", "cond.bin", F.round("score", 4).alias("score"), F.round("explained", 5).alias("explained"))
