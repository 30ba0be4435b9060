"""Queries on rates, splices, delays, snippets and groups of channels."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.operators import binning, resampling, sequential, signals
from trialloom.plans.base import events_long, samples
from trialloom.plans.registry import query
from trialloom.plans.resampling import _EVEN, _PAIRS, _embeddings, _even
from trialloom.sources.groups import ChannelGroup

# The Kaiser window by the series of its Bessel function.
_BESSEL = "list_sum([pow({x} / 2, 2 * j) / pow(gamma(j + 1), 2) for j in range(0, 30)])"


@query(f"""WITH {_EVEN}, k AS (SELECT k, CASE WHEN k = 0 THEN 1 ELSE sin(pi() * k / 3) / (pi() * k / 3) END * {_BESSEL.format(x="(5 * sqrt(1 - pow(k / 30.0, 2)))")} AS w FROM (SELECT unnest(range(-30, 31)) AS k)),
p AS (SELECT trial_id, n, v FROM (SELECT trial_id, bin AS n, v FROM x UNION ALL SELECT trial_id, -i, v FROM x, (SELECT unnest(range(1, 11)) AS i) WHERE bin = 0 UNION ALL SELECT trial_id, 63 + i, v FROM x, (SELECT unnest(range(1, 11)) AS i) WHERE bin = 63)),
m AS (SELECT unnest(range(0, 95)) AS m) SELECT trial_id, m AS bin, round(sum(v * w) / sum(w), 5) AS v FROM p, m, k WHERE k = m * 2 - n * 3 AND n BETWEEN (m * 2 - 30) / 3 - 1 AND (m * 2 + 30) / 3 + 1 GROUP BY 1, 2""")
def resampled_rational(spark, sf_dir):
    """Even series at three halves of their rate, behind a low pass."""
    return resampling.resample_rational(_even(spark, sf_dir), 3, 2).select("trial_id", "bin", F.round("v", 5).alias("v"))


@query(f"""WITH {_EVEN}, k AS (SELECT x, [-2, -1, 0, 1, 2] AS ps FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS x)), o AS (SELECT trial_id, bin, least(greatest(bin - 2, 0), 59) AS b0 FROM x)
SELECT o.trial_id, o.bin, round(sum(x.v * ((x.bin - b0 - 2) / 10.0 + 2 * (o.bin - b0 - 2) * (pow(x.bin - b0 - 2, 2) - 2) / 14.0)), 6) AS v FROM o JOIN x ON x.trial_id = o.trial_id AND x.bin BETWEEN b0 AND b0 + 4 GROUP BY 1, 2""")
def derivative_to_the_ends(spark, sf_dir):
    """Slope of a quadratic fitted to five samples, at the ends by the first and last five."""
    return resampling.differentiate(_even(spark, sf_dir), 5, 2, 1).select("trial_id", "bin", F.round("v", 6).alias("v"))


@query(f"""{_PAIRS}, e AS (SELECT trial_id, t, v, t1, v1, lag(t) OVER w AS t0, lead(t1) OVER w AS t2 FROM p WINDOW w AS (PARTITION BY trial_id ORDER BY t)),
h AS (SELECT trial_id, bin, v + coalesce((v1 - v) * (bin * 3600000.0 - t) / (t1 - t), 0) AS v FROM q WHERE t1 IS NOT NULL OR trial_id NOT IN (SELECT trial_id FROM e WHERE t1 IS NOT NULL)
  UNION SELECT trial_id, bin, v + (v1 - v) * (bin * 3600000.0 - t) / (t1 - t) FROM e, (SELECT unnest(range(-2, 28)) AS bin) WHERE t1 IS NOT NULL AND t0 IS NULL AND bin * 3600000.0 < t AND bin * 3600000.0 >= t - 5400000
  UNION SELECT trial_id, bin, v + (v1 - v) * (bin * 3600000.0 - t) / (t1 - t) FROM e, (SELECT unnest(range(-2, 28)) AS bin) WHERE t1 IS NOT NULL AND t2 IS NULL AND bin * 3600000.0 >= t1 AND bin * 3600000.0 <= t1 + 5400000)
SELECT trial_id, bin, round(v, 4) AS v FROM h""")
def interpolated_beyond(spark, sf_dir):
    """Interpolation at full hours, carried on for an hour and a half beyond a day's first and last event."""
    return binning.resample_interpolated(samples(events_long(spark, sf_dir)), 3_600_000.0, 5_400_000.0).select("trial_id", "bin", F.round("v", 4).alias("v"))


_SPLICED = f"""WITH {_EVEN}, a AS (SELECT trial_id, bin AS i, v, coalesce(lead(v) OVER w, v) AS u FROM x WHERE bin < 40 WINDOW w AS (PARTITION BY trial_id ORDER BY bin)),
b AS (SELECT trial_id - 1 AS trial_id, bin AS i, v, coalesce(lead(v) OVER w, v) AS u FROM x WHERE bin >= 20 WINDOW w AS (PARTITION BY trial_id ORDER BY bin)),
g AS (SELECT trial_id, arg_min(struct_pack(i := a.i, j := b.i), struct_pack(d := round(sqrt((a.v - b.v) * (a.v - b.v) + (a.u - b.u) * (a.u - b.u)), 9), i := a.i, j := b.i)) AS s FROM a JOIN b USING (trial_id) WHERE a.i BETWEEN 25 AND 36 AND b.i BETWEEN 24 AND 40 GROUP BY 1),
s AS (SELECT trial_id, i, v, u, s.i AS seam FROM a JOIN g USING (trial_id) WHERE i <= s.i UNION ALL SELECT trial_id, s.i + b.i - s.j, v, u, s.i FROM b JOIN g USING (trial_id) WHERE b.i > s.j)"""


def _spliced(spark, sf_dir):
    rows = _even(spark, sf_dir).withColumnRenamed("bin", "i").drop("t")
    nxt = lambda df: df.withColumn("u", F.coalesce(F.lead("v").over(W.partitionBy("trial_id").orderBy("i")), F.col("v")))
    a, b = nxt(rows.where("i < 40")), nxt(rows.where("i >= 20")).withColumn("trial_id", F.col("trial_id") - 1)
    return signals.splice_nearest(a, b, ["trial_id"], ["v", "u"], (25, 36), (24, 40))


@query(f"{_SPLICED} SELECT trial_id, i, round(v, 6) AS v, round(u, 6) AS u, seam FROM s")
def spliced_nearest(spark, sf_dir):
    """Two trajectories joined at the pair of times in their windows at which they are nearest."""
    return _spliced(spark, sf_dir).select("trial_id", "i", F.round("v", 6).alias("v"), F.round("u", 6).alias("u"), "seam")


@query(f"""{_SPLICED} SELECT trial_id, round(sum(v) FILTER (i - seam NOT BETWEEN -4 AND 5), 5) AS outside, round(max(abs(v)) FILTER (i - seam IN (-6, -5, 6, 7)), 6) AS held, round(sum(v) FILTER (i - seam BETWEEN -4 AND 5), 3) AS pull
FROM s GROUP BY 1""")
def smoothed_seam(spark, sf_dir):
    """A bridge over the seam: what is outside stays, and inside it solves the equations of least bending."""
    s = _spliced(spark, sf_dir)
    smooth = signals.smooth_seam(s.select("trial_id", "i", "v", "seam"), ["trial_id"], ["v"], 5, 4.0)
    # v + 4 D'D v over the bridge gives back what was smoothed: its sum over the inner ten samples
    w = W.partitionBy("trial_id").orderBy("i")
    at = F.col("i") - F.col("seam")
    second = F.lag("v").over(w) - 2 * F.col("v") + F.lead("v").over(w)
    bent = smooth.withColumn("_d", F.when(at.between(-5, 6), second).otherwise(0.0))
    fourth = F.lag("_d").over(w) - 2 * F.col("_d") + F.lead("_d").over(w)
    back = bent.withColumn("back", F.when(at.between(-4, 5), F.col("v") + 4.0 * fourth))
    inside, held = at.between(-4, 5), at.isin(-6, -5, 6, 7)
    return back.groupBy("trial_id").agg(
        F.round(F.sum(F.when(~inside, F.col("v"))), 5).alias("outside"), F.round(F.max(F.when(held, F.abs("v"))), 6).alias("held"), F.round(F.sum("back"), 3).alias("pull")
    )


@query(f"""WITH {_EVEN}, m0 AS (SELECT bin, avg(v) AS m FROM x GROUP BY 1), l AS (SELECT unnest(range(-3, 4)) AS lag),
c0 AS (SELECT trial_id, lag, coalesce(round(corr(v, m), 9), -2) AS r FROM x, l JOIN m0 ON m0.bin = x.bin - lag GROUP BY 1, 2), b0 AS (SELECT trial_id, arg_max(lag, struct_pack(r := r, near := -abs(lag), lag := -lag)) AS lag FROM c0 GROUP BY 1),
m1 AS (SELECT bin - lag AS bin, avg(v) AS m FROM x JOIN b0 USING (trial_id) GROUP BY 1),
c1 AS (SELECT trial_id, l.lag, coalesce(round(corr(v, m), 9), -2) AS r FROM x, l JOIN m1 ON m1.bin = x.bin - l.lag GROUP BY 1, 2), b1 AS (SELECT trial_id, arg_max(lag, struct_pack(r := r, near := -abs(lag), lag := -lag)) AS lag, max(r) AS r FROM c1 GROUP BY 1)
SELECT bin - lag AS bin, round(avg(v), 5) AS mean, count(*) AS n, round(avg(r), 6) AS r FROM x JOIN b1 USING (trial_id) GROUP BY 1""")
def joint_delays(spark, sf_dir):
    """All series brought together: twice moved to where each goes best with the mean of all, then averaged."""
    rows = _even(spark, sf_dir).select("trial_id", "bin", "v")
    lags = signals.joint_delays(rows, 3, rounds=2)
    together = signals.undelayed(rows, lags).join(lags.select("trial_id", "r"), "trial_id")
    return together.groupBy("bin").agg(F.round(F.avg("v"), 5).alias("mean"), F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("r"))


@query(f"""WITH RECURSIVE {_EVEN}, o AS (SELECT *, coalesce(v >= 0.1 AND NOT coalesce(lag(v) OVER w >= 0.1, false), false) AS begins FROM x WINDOW w AS (PARTITION BY trial_id ORDER BY bin)),
u AS (SELECT *, sum(begins::INT) OVER (PARTITION BY trial_id ORDER BY bin) AS run FROM o), p AS (SELECT trial_id, run, arg_max(bin, struct_pack(v := v, b := -bin)) AS bin, max(v) AS v FROM u WHERE v >= 0.1 GROUP BY 1, 2),
r AS (SELECT trial_id, bin, v, row_number() OVER (PARTITION BY trial_id ORDER BY v DESC, bin) AS k FROM p WHERE bin >= 2 AND bin + 3 <= 63),
g(trial_id, k, kept) AS (SELECT trial_id, 1::BIGINT, [bin] FROM r WHERE k = 1 UNION ALL SELECT r.trial_id, r.k, CASE WHEN len(list_filter(kept, lambda y: abs(y - r.bin) < 8)) > 0 THEN kept ELSE list_append(kept, r.bin) END FROM g JOIN r ON r.trial_id = g.trial_id AND r.k = g.k + 1),
f AS (SELECT trial_id, unnest(arg_max(kept, k)) AS bin FROM g GROUP BY 1)
SELECT f.trial_id, f.bin, round(max(x.v) FILTER (x.bin = f.bin), 6) AS height, round(sum(x.v), 6) AS area FROM f JOIN x ON x.trial_id = f.trial_id AND x.bin BETWEEN f.bin - 2 AND f.bin + 3 GROUP BY 1, 2""")
def largest_snippets(spark, sf_dir):
    """The highest peaks of each series, none within eight samples of a higher one, and the area of their snippets."""
    got = sequential.largest_snippets(_even(spark, sf_dir).select("trial_id", F.col("bin").cast("double").alias("t"), "v"), 0.1, 2, 4, 8)
    return got.select("trial_id", F.col("t").cast("long").alias("bin"), F.round("height", 6).alias("height"), F.round(F.aggregate("wave", F.lit(0.0), lambda s, v: s + v), 6).alias("area"))


@query("""WITH s AS (SELECT vec_id AS trial_id, i, list_transform(range(1, 5), lambda c: CAST(embedding[(i - 1) * 4 + c] AS DOUBLE)) AS x FROM embeddings, (SELECT unnest(range(1, 17)) AS i)),
c AS (SELECT trial_id, i, unnest(['sum', 'contrast']) AS channel, unnest([x[1] + x[2] + x[3], x[4] - 0.5 * x[1]]) AS v FROM s),
p AS (SELECT *, lead(v) OVER (PARTITION BY trial_id, channel ORDER BY i) AS v1 FROM c), g AS (SELECT unnest(range(0, 23)) AS b)
SELECT trial_id, channel, round(b * 7.0, 3) AS t, round(CASE WHEN b * 7.0 = (i - 1) * 10.0 THEN v ELSE v + (v1 - v) * (b * 7.0 - (i - 1) * 10.0) / 10 END, 6) AS v FROM p, g WHERE b * 7.0 >= (i - 1) * 10.0 AND (b * 7.0 < i * 10.0 AND v1 IS NOT NULL OR b * 7.0 = (i - 1) * 10.0)""")
def channel_group(spark, sf_dir):
    """A tensor of times and channels: two sums of channels, resampled together and unpacked."""
    e = _embeddings(spark, sf_dir)
    tensor = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, 4))
    group = ChannelGroup.of_tensor(e.withColumn("tensor", tensor), "vec_id", "tensor", ["a", "b", "c", "d"], 10.0)
    sums = group.combined({"sum": {"a": 1.0, "b": 1.0, "c": 1.0}, "contrast": {"d": 1.0, "a": -0.5}})
    return sums.resampled(7.0).unpacked().select("trial_id", "channel", F.round("t", 3).alias("t"), F.round("v", 6).alias("v"))


@query("""WITH RECURSIVE s AS (SELECT vec_id AS trial_id, i, c, CAST(embedding[(i - 1) * 4 + c] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 17)) AS i), (SELECT unnest(range(1, 4)) AS c) WHERE c <> 2),
f AS (SELECT trial_id, c, i, x AS y FROM s WHERE i = 1 UNION ALL SELECT s.trial_id, s.c, s.i, 0.7 * f.y + 0.3 * s.x FROM f JOIN s ON s.trial_id = f.trial_id AND s.c = f.c AND s.i = f.i + 1)
SELECT label AS cond, CAST(i - 1 AS DOUBLE) AS t, CASE c WHEN 1 THEN 'left' ELSE 'c' END AS channel, round(avg(y), 6) AS mean, count(*) AS n FROM f JOIN embeddings ON vec_id = trial_id GROUP BY 1, 2, 3""")
def filtered_group(spark, sf_dir):
    """Channels of a group but one, low-passed together and averaged by condition."""
    e = _embeddings(spark, sf_dir)
    tensor = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, 3))
    group = ChannelGroup.of_tensor(e.withColumn("tensor", tensor), "vec_id", "tensor", ["a", "b", "c"]).without(["b"]).renamed({"a": "left"})
    means = group.filtered([0.3], [1.0, -0.7]).means(e.select(F.col("vec_id").alias("trial_id"), F.col("label").alias("cond")))
    return means.select("cond", "t", "channel", F.round("mean", 6).alias("mean"), "n")


@query("""WITH s AS (SELECT user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS trial_id, CAST(epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS DOUBLE) / 1000 AS t, event_type, min(value) AS v FROM events WHERE event_type IN ('click', 'view', 'error', 'purchase') GROUP BY 1, 2, 3)
SELECT trial_id, count(DISTINCT t) AS times, round(sum(v) FILTER (event_type = 'click'), 4) AS clicks, round(sum(v) FILTER (event_type = 'view'), 4) AS views FROM s GROUP BY 1""")
def packed_channels(spark, sf_dir):
    """Channels packed into two groups that are joined, times counted and channels summed by place."""
    ev = events_long(spark, sf_dir).select("trial_id", F.col("event").alias("channel"), "t", "v")
    both = ChannelGroup.of(ev, ["click", "error"]).joined(ChannelGroup.of(ev, ["purchase", "view"]))
    rows = both.take(["view", "click"]).frame
    return rows.groupBy("trial_id").agg(F.count("*").alias("times"), F.round(F.sum(F.get("values", F.lit(1))), 4).alias("clicks"), F.round(F.sum(F.get("values", F.lit(0))), 4).alias("views"))
