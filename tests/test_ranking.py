"""Positions and distinct values of groups of any size, against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from trialloom.operators import conditions, randomise, ranking, series


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    data = []
    for i in range(1200):
        group = rng.choice(["hot", "hot", "hot", "a", "b", None])
        data.append((i, group, rng.choice([None, 1.5, 2.5, float(rng.randint(0, 40))]), rng.choice(["x", "y", "z", None])))
    return data, spark.createDataFrame(data, "trial_id int, g string, v double, s string").repartition(5).cache()


def plain(data, keys):
    """{trial_id: position} by group, missing values last."""
    at = {"trial_id": 0, "v": 2, "s": 3}

    def part(r, k):
        x = r[at[k.removeprefix("-")]]
        if isinstance(x, str):
            x = ord(x)
        return (x is None, 0 if x is None else (-x if k.startswith("-") else x))

    out = {}
    for g in {r[1] for r in data}:
        for i, r in enumerate(sorted((r for r in data if r[1] == g), key=lambda r: [part(r, k) for k in keys])):
            out[r[0]] = i
    return out


@pytest.mark.parametrize("keys", [["trial_id"], ["-v", "s", "trial_id"], ["s", "-trial_id"], ["-s", "v", "trial_id"]])
@pytest.mark.parametrize("size", [7, 100, 10_000])
def test_positions(rows, keys, size):
    data, df = rows
    got = {r.trial_id: r.i for r in ranking.numbered(df, ["g"], keys, rows=size).collect()}
    assert got == plain(data, keys)


def test_ties_share_their_position(rows):
    data, df = rows
    got = {r.trial_id: r.i for r in ranking.numbered(df, ["g"], "v", rows=20, ties=True).collect()}
    for i, g, v, _ in data:
        less = sum(1 for _, o, x, _ in data if o == g and x is not None and (v is None or x < v))
        assert got[i] == less
    assert {r.trial_id: r["rank"] for r in series.ranks(df, ["g"], "v").collect()} == {k: i + 1 for k, i in got.items()}


def test_a_hot_group_is_cut(rows):
    """No task has much more than its share of a group that holds half of all rows."""
    data, df = rows
    parts = ranking.stretches(df, ["g"], "trial_id", rows=50).groupBy("_part").count().collect()
    assert len(parts) >= 20 and max(r["count"] for r in parts) < 150
    whole = ranking.numbered(df, ["g"], "trial_id", rows=50)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in whole and "SinglePartition" not in whole


def test_sorted_and_distinct_by_stretches(rows, monkeypatch):
    data, df = rows
    values = sorted({r[2] for r in data if r[2] is not None})
    want = [v for p, v in zip([None, *values], values) if p is None or v - p > 0.02 * max(values)]
    for size in (5, 1_000_000):
        monkeypatch.setattr(conditions, "stretches", lambda d, b, o, size=size: ranking.stretches(d, b, o, rows=size))
        assert sorted(r.x for r in conditions.distinct_with_tolerance(df, "v", 0.02).collect()) == want
    got = {r.trial_id: r["rank"] for r in conditions.sorted_within(df, "g", ["-v", "s"]).collect()}
    assert got == {k: i + 1 for k, i in plain(data, ["-v", "s", "trial_id"]).items()}


def test_shuffled_labels_meet_by_bands(spark):
    df = spark.range(5000).select(F.col("id").alias("trial_id"), (F.col("id") % 700).alias("cond"))
    got = randomise.shuffle_labels(df, 3)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 5000 and got.select("trial_id").distinct().count() == 5000
    assert {r.cond: r["count"] for r in got.groupBy("cond").count().collect()} == {r.cond: r["count"] for r in df.groupBy("cond").count().collect()}


def test_empty(spark):
    none = spark.createDataFrame([], "trial_id int, g string, v double")
    assert ranking.numbered(none, ["g"], ["v", "trial_id"]).collect() == []
    assert conditions.distinct_with_tolerance(none, "v").collect() == []
    assert [r.period for r in series.sampling_period(none.select("trial_id", F.col("v").alias("t"))).collect()] in ([], [None])
