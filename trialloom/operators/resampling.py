"""Even series at other rates: rational factors behind a low pass, and derivatives to the very ends."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.functions import kernels


def resample_rational(series: DataFrame, up: int, down: int, taps: kernels.Taps | None = None) -> DataFrame:
    """trial_id, bin, v: an even series(trial_id, bin, v) at up / down times its rate.

    Bin b of the result stands at b * down / up of the series' bins, from its first to its last one.
    The series is taken as if up - 1 zeros followed each sample and went through a low
    pass on that finer grid (taps, by default kernels.lowpass) of which every down-th
    output is kept; only the taps that meet a sample and a kept output are ever touched.
    Before the first and after the last sample the series goes on with its value there.
    Outputs are divided by the sum of the taps that met a sample, so constants stay and missing
    samples are passed over.
    """
    g = math.gcd(up, down)
    up, down = up // g, down // g
    weights = dict(taps if taps is not None else kernels.lowpass(up, down))
    reach = max(abs(k) for k in weights)
    table = F.array(*[F.lit(float(weights.get(k, 0.0))) for k in range(-reach, reach + 1)])
    pad = math.ceil(reach / up)
    by_bin = W.partitionBy("trial_id").orderBy("bin")
    known = series.where("v is not null and not isnan(v)").select("trial_id", F.col("bin").cast("long").alias("bin"), F.col("v").cast("double").alias("v"))
    ends = known.withColumns({"_first": F.lag("bin").over(by_bin).isNull(), "_last": F.lead("bin").over(by_bin).isNull(), "_lo": F.min("bin").over(W.partitionBy("trial_id")), "_hi": F.max("bin").over(W.partitionBy("trial_id"))})
    # a sample at an end stands for those beyond it too
    places = F.sequence(F.when(F.col("_first"), F.col("bin") - pad).otherwise(F.col("bin")), F.when(F.col("_last"), F.col("bin") + pad).otherwise(F.col("bin")))
    at = ends.withColumn("_n", F.explode(places))
    lo = F.greatest(F.ceil((F.col("_n") * up - reach) / down), F.ceil(F.col("_lo") * up / down)).cast("long")
    hi = F.least(F.floor((F.col("_n") * up + reach) / down), F.floor(F.col("_hi") * up / down)).cast("long")
    sent = at.withColumns({"_a": lo, "_z": hi}).where("_a <= _z").withColumn("_m", F.explode(F.sequence("_a", "_z")))
    tap = F.get(table, (F.col("_m") * down - F.col("_n") * up + reach).cast("int"))
    sums = sent.select("trial_id", F.col("_m").alias("bin"), (tap * F.col("v")).alias("x"), tap.alias("w")).groupBy("trial_id", "bin").agg(F.sum("x").alias("x"), F.sum("w").alias("w"))
    return sums.select("trial_id", "bin", F.try_divide("x", "w").alias("v"))


def differentiate(series: DataFrame, frame: int = 5, degree: int = 2, order: int = 1, width: float = 1.0) -> DataFrame:
    """trial_id, bin, v: the derivative of a polynomial fitted around each sample of an even series.

    In the inside the frame is centred. Near the ends it is the first or last frame's
    polynomial, taken where the sample stands. Trials with fewer samples than a frame have none.
    """
    half = frame // 2
    rows = [[0.0] * frame for _ in range(frame)]  # by place in the frame, weights of its samples
    for place in range(frame):
        for k, w in kernels.savitzky_golay(frame, degree, order, width, at=place - half):
            rows[place][half - k] = w
    table = F.array(*[F.array(*[F.lit(w) for w in row]) for row in rows])
    by_bin = W.partitionBy("trial_id").orderBy("bin")
    numbered = series.select("trial_id", "bin", F.col("v").cast("double").alias("v"), (F.row_number().over(by_bin) - 1).alias("_j"), F.count("*").over(W.partitionBy("trial_id")).cast("int").alias("_n")).where(F.col("_n") >= frame)
    numbered = numbered.withColumn("_b0", F.first("bin").over(by_bin))
    # the places that a sample counts for: those whose frame holds it
    first = F.when(F.col("_j") < frame, F.lit(0)).otherwise(F.col("_j") - half)
    last = F.when(F.col("_j") >= F.col("_n") - frame, F.col("_n") - 1).otherwise(F.col("_j") + half)
    sent = numbered.withColumn("_o", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.lit(0), F.least(F.col("_o") - half, F.col("_n") - frame))  # where the frame of place _o begins
    inside = sent.withColumn("_s", F.col("_j") - begin).where((F.col("_s") >= 0) & (F.col("_s") < frame))
    weight = F.get(F.get(table, F.col("_o") - begin), F.col("_s"))
    return inside.select("trial_id", (F.col("_b0") + F.col("_o")).alias("bin"), (weight * F.col("v")).alias("x")).groupBy("trial_id", "bin").agg(F.sum("x").alias("v"))
