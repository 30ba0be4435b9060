"""Queries on sets of trials: built, appended, shuffled, re-cut at their boundaries, and what their channels hold."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trialloom.api import Trials
from trialloom.functions import arrays
from trialloom.operators import binning, catalog, conditions, contrasts, population, sequential, series, signals, windows
from trialloom.plans.alignment import AROUND, CLICKS, HOUR
from trialloom.plans.base import BOTH, DAY, events_long, trials
from trialloom.plans.registry import query
from trialloom.plans.resampling import _EVEN, _even
from trialloom.sources import tables


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS trial_id, 0.0::DOUBLE AS t_start, o_totalprice::DOUBLE AS t_end FROM orders")
def built_trials(spark, sf_dir):
    """Trials without content, as long as a table says, the latest first."""
    return tables.trials_of_durations(_read(spark, sf_dir, "orders"), "o_totalprice", ["-o_orderdate", "o_orderkey"])


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS session, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def appended_sessions(spark, sf_dir):
    """Two sessions with the same contract as one."""
    o = _read(spark, sf_dir, "orders")
    part = lambda where, name: o.where(where).withColumn("session", F.lit(name))
    both = tables.append_same(part("o_orderstatus = 'F'", "done"), part("o_orderstatus <> 'F'", "open"))
    return both.groupBy("session").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""{BOTH}, n AS (SELECT cond, count(*) AS n FROM tr WHERE n_events >= 2 GROUP BY cond), b AS (SELECT cond, sum(n) OVER (ORDER BY cond) AS hi, sum(n) OVER (ORDER BY cond) - n AS lo FROM n),
p AS (SELECT trial_id, n_events, row_number() OVER (ORDER BY md5('8:' || trial_id), trial_id) AS r FROM tr WHERE n_events >= 2)
SELECT b.cond, round(avg(n_events), 6) AS mean, count(*) AS n FROM p JOIN b ON r > lo AND r <= hi GROUP BY 1""")
def shuffled_trials(spark, sf_dir):
    """Valid trials as one object, dealt anew to their conditions, and a mean of each."""
    ev = events_long(spark, sf_dir)
    td = Trials(trials(ev).withColumnRenamed("cond", "site"), ev).keep(F.col("n_events") >= 2, "few events").group_by("site")
    return td.shuffled(8).means("n_events").select("cond", F.round("mean", 6).alias("mean"), "n")


@query(f"{BOTH} SELECT trial_id, CASE WHEN n_events >= 3 THEN user_id END AS user_id, CASE WHEN n_events >= 3 THEN first_event END AS first_event FROM tr")
def values_of_valid_trials(spark, sf_dir):
    """Attributes of all trials, missing for those with few events."""
    ev = events_long(spark, sf_dir)
    return Trials(trials(ev), ev).keep(F.col("n_events") >= 3, "few events").values("user_id", "first_event")


@query(f"""{BOTH}, p AS (SELECT DISTINCT trial_id + 1 AS trial_id FROM tr), m AS (SELECT ev.trial_id, t FROM ev UNION ALL SELECT ev.trial_id - 1, t + 86400000 FROM ev JOIN p USING (trial_id) WHERE t < 7200000)
SELECT m.trial_id, round(t, 3) AS t, CASE WHEN s.trial_id IS NOT NULL THEN 86400000.0::DOUBLE END AS splice FROM m LEFT JOIN (SELECT trial_id FROM tr WHERE trial_id + 1 IN (SELECT trial_id FROM tr)) s USING (trial_id)""")
def boundary_copied_back(spark, sf_dir):
    """The first two hours of a day also at the end of the user's day before, and where the two were joined."""
    ev = events_long(spark, sf_dir)
    begins = trials(ev).select("trial_id", F.lit(7_200_000.0).alias("new_start"), F.lit(DAY).alias("length"))
    splices = series.splice_events(begins, forward=False).select("trial_id", F.col("t").alias("splice"))
    return series.move_back(ev.select("trial_id", "t"), begins, copy=True).join(splices, "trial_id", "left").select("trial_id", F.round("t", 3).alias("t"), "splice")


@query("""WITH w AS (SELECT vec_id, vec_id % 5 AS first, 20 + vec_id % 7 AS n, embedding FROM embeddings), e AS (SELECT min(first) AS lo, max(first + n - 1) AS hi FROM w),
i AS (SELECT unnest(range(lo, hi + 1)) AS i FROM e) SELECT i, round(avg(CASE WHEN i BETWEEN first AND first + n - 1 THEN CAST(embedding[i - first + 1 + first] AS DOUBLE) END), 6) AS mean, count(CASE WHEN i BETWEEN first AND first + n - 1 THEN 1 END) AS n, count(*) AS of FROM w, i GROUP BY 1""")
def common_waveforms(spark, sf_dir):
    """Waveforms of different beginnings and lengths on one sample index, and their mean."""
    e = _read(spark, sf_dir, "embeddings").withColumn("first", (F.col("vec_id") % 5).cast("int"))
    waves = e.select("first", F.slice("embedding", F.col("first") + 1, (20 + F.col("vec_id") % 7).cast("int")).alias("wave"))
    long = signals.common_waveforms(waves).select("first", F.posexplode("wave").alias("p", "v"))
    return long.groupBy((F.col("first") + F.col("p")).cast("long").alias("i")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"), F.count("v").alias("n"), F.count("*").alias("of"))


@query("SELECT vec_id, label, CAST(embedding[5] AS DOUBLE) AS fifth, CAST(embedding[64] AS DOUBLE) - CAST(embedding[1] AS DOUBLE) AS spread FROM embeddings")
def sub_channels(spark, sf_dir):
    """Places of a group by name, embedding(5), beside plain channels."""
    e = _read(spark, sf_dir, "embeddings")
    at = lambda name: catalog.sub_channel(e, name).cast("double")
    return e.select("vec_id", catalog.sub_channel(e, "label"), at("embedding(5)").alias("fifth"), (at("embedding(64)") - at("embedding(1)")).alias("spread"))


@query(f"""{CLICKS}, m AS (SELECT al.trial_id, t - zero AS x FROM al JOIN ev ON ev.trial_id = al.trial_id AND event = 'view' AND t BETWEEN start AND stop),
i AS (SELECT trial_id, min(t) AS t0, max(t) AS t1 FROM ev WHERE event = 'view' GROUP BY 1), c AS (SELECT trial_id, greatest(t0, start) - zero AS t0, least(t1, stop) - zero AS t1 FROM i JOIN al USING (trial_id) WHERE t0 <= stop AND t1 >= start),
x AS (SELECT trial_id, 'start' AS kind, start - zero AS x FROM al UNION ALL SELECT trial_id, 'stop', stop - zero FROM al UNION ALL SELECT trial_id, 'mark', x FROM m UNION ALL SELECT trial_id, 'interval start', t0 FROM c UNION ALL SELECT trial_id, 'interval length', t1 - t0 FROM c)
SELECT kind, cond, count(*) AS n, round(avg(x), 2) AS mean, round(coalesce(stddev_samp(x), 0), 1) AS std, round(min(x), 3) AS low, round(max(x), 3) AS high FROM x JOIN tr USING (trial_id) GROUP BY GROUPING SETS ((kind, cond), (kind))""")
def window_distributions(spark, sf_dir):
    """Starts, stops, views and spans of views around the first click, by condition and over all, of two sessions merged."""
    ev = events_long(spark, sf_dir)
    tr = trials(ev)
    al = windows.align(tr, ev, AROUND)
    spans = ev.where("event = 'view'").groupBy("trial_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    found, intervals = windows.marks(tr, ev, al, "view"), windows.mark_intervals(spans, al)
    sessions = [windows.distributions(al, tr.where(F.col("user_id") % 2 == h), found, intervals) for h in (0, 1)]
    got = windows.merged_distributions(sessions)
    std = F.round(F.coalesce("std", F.lit(0.0)), 1)
    return got.select("kind", "cond", "n", F.round("mean", 2).alias("mean"), std.alias("std"), F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


@query(f"""{CLICKS}, lim AS (SELECT trial_id, zero, start, stop, CAST(ceil((start - zero) / 3600000 - 1e-6) AS BIGINT) AS lo, CAST(floor((stop - zero) / 3600000 + 1e-6) AS BIGINT) AS hi FROM al),
g AS (SELECT trial_id, basis, unnest(range(lo, hi + 1)) AS bin FROM lim, (SELECT unnest(['error', 'view']) AS basis) WHERE hi >= lo),
c AS (SELECT lim.trial_id, event AS basis, CASE WHEN abs((t - zero) - (hi + 1) * 3600000.0) < 1e-9 THEN hi ELSE CAST(floor((t - zero) / 3600000) AS BIGINT) END AS bin, count(*) AS n FROM lim JOIN ev ON ev.trial_id = lim.trial_id AND t BETWEEN start AND stop GROUP BY 1, 2, 3)
SELECT basis, bin, round(avg(coalesce(n, 0) / 3600.0) * 1e6, 5) AS rate, count(*) AS n FROM g LEFT JOIN c USING (trial_id, basis, bin) GROUP BY 1, 2""")
def rates_read_back(spark, sf_dir):
    """Counts exported as vectors, read as a model would give them back, rates in place of counts."""
    ev = events_long(spark, sf_dir)
    bases = ["error", "view"]
    counts = binning.counts_by_basis(ev.select(F.col("event").alias("basis"), "trial_id", "t"), windows.align_all(trials(ev), ev, [AROUND]), bases, HOUR, "acausal")
    path = f"{tables.shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    tables.count_vectors(counts, bases).write.parquet(path)
    model = spark.read.parquet(path).select("trial_id", "bin", *[(F.col(b) / 3600.0).alias(b) for b in bases])
    rates = tables.rates_from_vectors(model, bases)
    return rates.groupBy("basis", "bin").agg(F.round(F.avg("v") * 1e6, 5).alias("rate"), F.count("*").alias("n"))


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: round(CAST(v AS DOUBLE), 6)) AS e FROM embeddings)
SELECT vec_id, kind, unnest(range(len(found)))::INTEGER AS i, unnest(found) AS v FROM (SELECT vec_id, unnest(['padded', 'split', 'repeated', 'masked', 'picked']) AS kind, unnest([list_concat(e[1:3], [e[4], e[5]]), e[61:64], list_concat(e[1:2], e[1:2]), list_filter(e[1:6], lambda v: v > 0), [e[2], e[64], NULL]]) AS found FROM x)""")
def array_elements(spark, sf_dir):
    """What is in arrays that are padded, cut into rows, repeated, masked and picked from."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.round(v.cast("double"), 6)).alias("e"))
    head = lambda n: F.slice("e", 1, n)
    parts = {
        "padded": arrays.padded(F.col("e"), 5), "split": F.element_at(arrays.split(F.col("e"), 6), 11), "repeated": arrays.repeated(head(2), 2),
        "masked": arrays.masked(head(6), F.transform(head(6), lambda v: v > 0)), "picked": arrays.picked(F.col("e"), [1, 63, 64]),
    }
    found = e.select("vec_id", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("found")) for k, x in parts.items()])))
    return found.select("vec_id", "kind", F.posexplode("found").alias("i", "v"))


@query(f"{BOTH} SELECT CASE WHEN n_events < 2 THEN 'few events' END AS cause, count(*) AS n FROM tr GROUP BY 1")
def reset_validity(spark, sf_dir):
    """Trials marked invalid for two causes, one of which is taken back."""
    tr = trials(events_long(spark, sf_dir))
    marked = conditions.set_invalid(conditions.set_invalid(tr, F.col("n_events") >= 2, "few events"), F.col("k") % 2 == 0, "odd")
    return conditions.reset_invalid(marked, ["odd"]).groupBy("cause").agg(F.count("*").alias("n"))


@query("WITH x AS (SELECT label AS cond, i - 1 AS basis, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)) SELECT cond, basis, round(avg(v), 6) AS mean, count(*) AS n FROM x WHERE cond <> 0 GROUP BY 1, 2")
def saved_population(spark, sf_dir):
    """A population saved with its conditions and read back, some conditions only."""
    cube = population.population(_read(spark, sf_dir, "embeddings"), "label", "embedding")
    path = f"{tables.shared_dir(spark)}/population-{uuid.uuid4().hex}"
    tables.save({"cube": cube, "conditions": cube.select("cond").distinct().withColumn("used", F.col("cond") != 0)}, path, {"cube": "cond"})
    back, used = spark.read.parquet(f"{path}/cube"), spark.read.parquet(f"{path}/conditions").where("used")
    return back.join(used, "cond", "left_semi").select("cond", "basis", F.round("mean", 6).alias("mean"), "n")


_RIDGES = [0.0, 1000.0, 100_000.0]


@query(f"""WITH l AS (SELECT l_orderkey % 4 AS fold, l_quantity::DOUBLE AS x, l_discount::DOUBLE * 100 AS z, l_extendedprice::DOUBLE / 1000 AS y FROM lineitem), r AS (SELECT unnest({_RIDGES}) AS ridge),
s AS (SELECT f.fold, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) * count(*) AS xx, var_pop(z) * count(*) AS zz, covar_pop(x, z) * count(*) AS xz, covar_pop(x, y) * count(*) AS xy, covar_pop(z, y) * count(*) AS zy FROM l JOIN (SELECT DISTINCT fold FROM l) f ON l.fold <> f.fold GROUP BY 1),
b AS (SELECT *, (xy * (zz + ridge) - zy * xz) / ((xx + ridge) * (zz + ridge) - xz * xz) AS b, (zy * (xx + ridge) - xy * xz) / ((xx + ridge) * (zz + ridge) - xz * xz) AS c FROM s, r)
SELECT ridge, round(avg(pow(y - my - b * (x - mx) - c * (z - mz), 2)), 4) AS error FROM l JOIN b USING (fold) GROUP BY 1""")
def ridge_of_two(spark, sf_dir):
    """Prediction error of unseen folds from two predictors, for three ridges."""
    li = _read(spark, sf_dir, "lineitem").withColumns({"y": F.col("l_extendedprice").cast("double") / 1000, "z": F.col("l_discount").cast("double") * 100})
    got = contrasts.cross_validated_ridge(li, F.col("l_orderkey") % 4, ["l_quantity", "z"], "y", _RIDGES, 4)
    return got.select("ridge", F.round("error", 4).alias("error"))


@query(f"""WITH RECURSIVE {_EVEN}, o AS (SELECT trial_id, bin, v, lead(v) OVER w AS v1 FROM x WINDOW w AS (PARTITION BY trial_id ORDER BY bin)),
c AS (SELECT trial_id, bin + 1 AS bin FROM o WHERE v < 0.1 AND v1 >= 0.1), r AS (SELECT trial_id, bin, row_number() OVER (PARTITION BY trial_id ORDER BY bin) AS k FROM c WHERE bin >= 3 AND bin + 4 <= 64),
g(trial_id, k, last, kept) AS (SELECT trial_id, k, bin, true FROM r WHERE k = 1 UNION ALL SELECT r.trial_id, r.k, CASE WHEN r.bin - last >= 6 THEN r.bin ELSE last END, r.bin - last >= 6 FROM g JOIN r ON r.trial_id = g.trial_id AND r.k = g.k + 1)
SELECT g.trial_id, g.last AS bin, round(sum(x.v), 6) AS area FROM g JOIN x ON x.trial_id = g.trial_id AND x.bin BETWEEN g.last - 3 AND g.last + 3 WHERE kept GROUP BY 1, 2""")
def snippets_in_order(spark, sf_dir):
    """Snippets around crossings from left to right, none within six samples of the last kept one."""
    rows = _even(spark, sf_dir).select("trial_id", F.col("bin").cast("double").alias("t"), "v")
    got = sequential.snippets(rows, 0.1, 2, 5, 6)
    return got.select("trial_id", (F.col("t") + 1).cast("long").alias("bin"), F.round(F.aggregate("wave", F.lit(0.0), lambda s, v: s + v), 6).alias("area"))
