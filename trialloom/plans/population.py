"""Queries on populations: bases x conditions x time, projections and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialloom.operators import population as P
from trialloom.plans.registry import query

_X = "WITH x AS (SELECT label AS cond, vec_id, i - 1 AS basis, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)), c AS (SELECT basis, cond, avg(v) AS mean, stddev_samp(v) / sqrt(count(v)) AS sem, count(v) AS n FROM x GROUP BY 1, 2)"


def _cube(spark, sf_dir):
    return P.population(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "label", "embedding")


@query(f"{_X} SELECT basis, cond, round(mean, 6) AS mean, round(sem, 6) AS sem, n FROM c")
def population_cube(spark, sf_dir):
    """Mean and error of every basis in every condition."""
    return _cube(spark, sf_dir).select("basis", "cond", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"), "n")


@query(f"{_X} SELECT basis, round(min(mean), 6) AS low, round(max(mean), 6) AS high, round(max(mean) - min(mean), 6) AS range, round(var_pop(mean), 6) AS variance FROM c GROUP BY basis")
def basis_statistics(spark, sf_dir):
    return P.basis_statistics(_cube(spark, sf_dir)).select("basis", *[F.round(c, 6).alias(c) for c in ("low", "high", "range", "variance")])


@query(f"{_X}, s AS (SELECT basis, avg(mean) AS m, stddev_pop(mean) AS s FROM c GROUP BY basis) SELECT basis, cond, round((mean - m) / s, 5) AS z FROM c JOIN s USING (basis)")
def normalised(spark, sf_dir):
    """Each basis centred and divided by its standard deviation over conditions."""
    return P.normalise(_cube(spark, sf_dir)).select("basis", "cond", F.round("z", 5).alias("z"))


@query(f"""{_X}, w AS (SELECT basis, d, CASE WHEN basis % 3 = d THEN 1.0 / (1 + basis) ELSE 0 END AS w FROM (SELECT DISTINCT basis FROM c), (SELECT unnest(range(0, 3)) AS d))
SELECT d AS dimension, cond, round(sum(w * mean), 6) AS mean, round(sqrt(sum(w * w * sem * sem)), 6) AS sem FROM c JOIN w USING (basis) WHERE w <> 0 GROUP BY d, cond""")
def linear_projection(spark, sf_dir):
    """Three weighted sums of bases, errors in quadrature."""
    cube = _cube(spark, sf_dir)
    weights = cube.select("basis").distinct().select("basis", (F.col("basis") % 3).cast("long").alias("dimension"), (1.0 / (1 + F.col("basis"))).alias("w"))
    return P.project(cube, weights).select("dimension", "cond", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"))


@query(f"""{_X}, m AS (SELECT basis, avg(mean) AS m FROM c GROUP BY basis), z AS (SELECT basis, cond, mean - m AS z FROM c JOIN m USING (basis)) SELECT a.basis AS i, b.basis AS j, round(sum(a.z * b.z), 6) AS g FROM z a JOIN z b ON a.cond = b.cond AND a.basis <= b.basis GROUP BY 1, 2""")
def gram_matrix(spark, sf_dir):
    """Products of centred bases summed over conditions, from which components follow."""
    return P.gram(_cube(spark, sf_dir)).select("i", "j", F.round("g", 6).alias("g"))


def _power(n: int) -> str:
    """The n-th direction by power iteration, and what is left of the matrix without it."""
    return f"""r{n}(k, v) AS (SELECT 0, list_transform(range(64), lambda i: 1.0::DOUBLE + i * 0.01) UNION ALL SELECT k + 1, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) FROM (SELECT k, list_transform(g, lambda r: list_dot_product(r, v)) AS u FROM r{n}, g{n} WHERE k < 1500)),
l{n} AS (SELECT v, list_dot_product(v, list_transform(g, lambda r: list_dot_product(r, v))) AS l FROM r{n}, g{n} WHERE k = 1500),
g{n + 1} AS (SELECT list_transform(range(64), lambda i: list_transform(range(64), lambda j: g[i + 1][j + 1] - l * v[i + 1] * v[j + 1])) AS g FROM g{n}, l{n})"""


@query(f"""WITH RECURSIVE {_X[5:]}, m AS (SELECT basis, avg(mean) AS m FROM c GROUP BY basis), z AS (SELECT basis, cond, mean - m AS z FROM c JOIN m USING (basis)),
e AS (SELECT a.basis AS i, b.basis AS j, sum(a.z * b.z) AS g FROM z a JOIN z b ON a.cond = b.cond GROUP BY 1, 2), g0 AS (SELECT list(r ORDER BY i) AS g FROM (SELECT i, list(g ORDER BY j) AS r FROM e GROUP BY i)),
{_power(0)}, {_power(1)}, {_power(2)},
w AS (SELECT d, l, list_transform(v, lambda x: x * CASE WHEN v[list_position(list_transform(v, lambda y: abs(y)), list_max(list_transform(v, lambda y: abs(y))))] < 0 THEN -1 ELSE 1 END) AS v FROM (SELECT 0 AS d, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2))
SELECT d AS dimension, cond, round(sum(z * v[basis + 1]), 4) AS score, round(any_value(l) / (SELECT sum(g) FROM e WHERE i = j), 5) AS explained FROM z, w GROUP BY 1, 2""")
def principal_components(spark, sf_dir):
    """Projections of conditions on three components, and the variance that these explain."""
    return P.principal_components(_cube(spark, sf_dir), 3).select("dimension", "cond", F.round("score", 4).alias("score"), F.round("explained", 5).alias("explained"))


@query(f"""{_X} SELECT a.cond AS cond_a, b.cond AS cond_b, round(sqrt(sum((a.mean - b.mean) * (a.mean - b.mean))), 6) AS distance FROM c a JOIN c b ON a.basis = b.basis AND a.cond < b.cond GROUP BY 1, 2""")
def condition_distances(spark, sf_dir):
    """Euclidean distance between the population states of each pair of conditions."""
    return P.distances(_cube(spark, sf_dir)).select("cond_a", "cond_b", F.round("distance", 6).alias("distance"))


@query("""WITH x AS (SELECT vec_id, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS v, label AS cond FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
w AS (SELECT cond, vec_id, min(i) AS a, max(i) AS b FROM x WHERE v > 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cond ORDER BY a) AS ka, row_number() OVER (PARTITION BY cond ORDER BY b DESC) AS kb FROM w)
SELECT cond, max(a) FILTER (ka <= 5) AS t_min, min(b) FILTER (kb <= 5) AS t_max FROM r GROUP BY cond""")
def population_window(spark, sf_dir):
    """Per condition the times from which and up to which five trials have data."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    spans = e.select(F.col("label").alias("cond"), "vec_id", F.posexplode("embedding").alias("i", "v")).where("v > 0").groupBy("cond", "vec_id").agg(F.min("i").alias("t0"), F.max("i").alias("t1"))
    return P.common_window(spans, ["cond"], 5).select("cond", F.col("t_min").cast("long").alias("t_min"), F.col("t_max").cast("long").alias("t_max"))
