import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialloom.llm import mixing

SF = "/root/testdata/sf0.01"


def words_of(text):
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    n = -1 if len(w) <= 12 else 8 * len(set(w)) // len(w)
    return len(w), {*w, mixing.EVERY, f"{mixing.EVERY}{n}"}


def plain_mix(docs, labelled, targets, asked):
    """Classifier in plain Python, on all labelled rows; asked are the documents it is fitted to."""
    domains = sorted(targets)
    text = dict(docs)
    known = [(i, d) for i, d in labelled if i in text and d in domains]
    every = Counter(d for _, d in labelled if d in domains)
    prior = np.array([math.log((every[d] + 1) / (sum(every.values()) + len(domains))) for d in domains])
    n = Counter(d for i, d in labelled if d in domains and i not in asked)
    df = {d: Counter() for d in domains}
    for i, d in known:
        if i not in asked:
            df[d].update(words_of(text[i])[1])
    total = Counter()
    for d in domains:
        total.update(df[d])
    used = sum(n.values())
    gain = {}
    for w, c in total.items():
        if c >= mixing.LEAST_DOCS and w != mixing.EVERY:
            share = math.log((c + 1) / (used + 2))
            gain[w] = [math.log((df[d][w] + 0.5) / (n[d] + 1)) - share for d in domains]
    worth = {w: round(sum((df[d][w] - total[w] * n[d] / used) ** 2 / (total[w] * n[d] / used) for d in domains), 6) for w in gain}
    chosen = sorted((w for w in gain if worth[w] >= mixing.CHI_SQUARE), key=lambda w: (-worth[w], w))

    def evidence(t, size, full):
        keep = set(chosen[:size])
        hit = [gain[w] for w in words_of(t)[1] if w in keep]
        return min(1, full / max(1, len(hit))) * np.sum(hit, axis=0) if hit else np.zeros(len(domains))

    part = [(i, d) for i, d in known if i in asked]
    there = Counter(d for _, d in part)
    y, weight = np.array([domains.index(d) for _, d in part]), np.array([every[d] / there[d] for _, d in part])
    tried = []
    for size in mixing.SIZES:
        for full in mixing.FULL:
            tried.append((*mixing.calibrate(np.array([evidence(text[i], size, full) for i, _ in part]), y, weight, prior), size, full))
    _, start, slope, size, full = min(tried, key=lambda x: (round(x[0], 9), x[3], x[4]))
    x = start + slope * np.array([evidence(t, size, full) for _, t in docs])
    p = np.exp(x - x.max(axis=1, keepdims=True))
    return [i for i, _ in docs], np.array([words_of(t)[0] for _, t in docs], float), p / p.sum(axis=1, keepdims=True)


def test_calibration_finds_slope_and_start():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 3)) * 2
    z = np.array([0.5, -0.2, -0.3]) + 0.6 * x
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    _, start, slope = mixing.calibrate(x, y, np.ones(len(y)), np.log(np.ones(3) / 3))
    assert slope == pytest.approx(0.6, abs=0.05) and start[0] - start[1] == pytest.approx(0.7, abs=0.1)
    _, start, slope = mixing.calibrate(np.zeros((0, 3)), np.zeros(0, int), np.zeros(0), np.log(np.ones(3) / 3))
    assert slope == 1 and np.allclose(start, math.log(1 / 3))


def test_posteriors_and_rates(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    got = mixing.mix(docs, labels, mixing.TARGETS).collect()
    asked = {r.doc_id for r in labels.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(4)) == 0).collect()}
    ids, tokens, p = plain_mix([(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.domain) for r in labels.collect()], mixing.TARGETS, asked)
    at = {i: k for k, i in enumerate(ids)}
    order = [at[r.doc_id] for r in got]
    assert len(got) == len(ids)
    mine = np.array([[r.p_clean, r.p_low, r.p_toxic] for r in got])
    assert [r.tokens for r in got] == tokens[order].tolist()
    assert np.abs(mine - p[order]).max() < 1e-6
    rate = np.array([r.rate for r in got])
    share = (rate * tokens[order]) @ mine / tokens.sum()
    assert np.abs(share - [0.86, 0.04, 0.10]).max() < 2e-4 and rate.min() >= 0
    assert np.allclose(share, [got[0].reached_clean, got[0].reached_low, got[0].reached_toxic], atol=2e-4)
    for r in got:
        assert r.copies in (math.floor(r.rate), math.floor(r.rate) + 1)
    truth = {r.doc_id: r.domain for r in labels.collect()}
    known = [r for r in got if r.doc_id in truth]
    right = [max(("clean", r.p_clean), ("low", r.p_low), ("toxic", r.p_toxic), key=lambda x: x[1])[0] == truth[r.doc_id] for r in known]
    assert sum(right) / len(right) > 0.9
    # posteriors are calibrated: they expect of each domain about as many as there are
    for i, d in enumerate(("clean", "low", "toxic")):
        assert np.mean([[r.p_clean, r.p_low, r.p_toxic][i] for r in known]) == pytest.approx(np.mean([truth[r.doc_id] == d for r in known]), abs=0.04)


def test_kept_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    for targets in (mixing.TARGETS, {"clean": 0.4, "low": 0.3, "toxic": 0.3}):
        got = mixing.mix(docs, labels, targets, keep="clean").collect()
        clean = [r for r in got if r.p_clean >= max(r.p_low, r.p_toxic)]
        assert len(clean) > 500 and min(r.copies for r in clean) >= 1
        for d in targets:
            assert got[0][f"reached_{d}"] == pytest.approx(targets[d], abs=0.01)


def test_rates_match_plain_projected_gradient(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4] * 3, size=200)
    t = rng.integers(0, 50, size=200).astype(float)
    df = spark.createDataFrame([(i, int(t[i]), p[i].tolist()) for i in range(200)], "doc_id long, tokens long, p array<double>")
    want = np.array([0.45, 0.33, 0.22])
    rates, reached = mixing.fit_rates(df, want.tolist())
    got = {r.doc_id: r.rate for r in rates.collect()}
    size = t @ p / t.sum()
    rate = np.ones(200)
    for _ in range(20_000):
        rate = np.maximum(0, rate - p @ (((rate * t) @ p / t.sum() - want) / size))
    mine = np.array([got[i] for i in range(200)])

    def loss(r):
        return ((((r * t) @ p / t.sum() - want) ** 2) / size).sum()

    assert mine.min() >= 0 and loss(mine) <= loss(rate) + 1e-5 and loss(mine) < loss(np.ones(200)) / 20
    assert np.allclose((mine * t) @ p / t.sum(), reached)


def test_a_domain_without_tokens_repeats_nothing_for_ever(spark):
    rows = [(i, 100, [1 - 1e-6, 1e-6]) for i in range(50)] + [(99, 1, [0.2, 0.8])]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>")
    rates, reached = mixing.fit_rates(df, [0.9, 0.1])
    got = {r.doc_id: r.rate for r in rates.collect()}
    assert max(got.values()) < 2 and reached[1] < 0.01


def test_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "good words here", None), (3, "good words here", None), (None, "x y", "b"), (None, "z", "b"), (4, "bad " * 50_000, "b"), (5, "good thing", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    labelled = spark.createDataFrame([(3, "g"), (5, "g"), (4, "b"), (4, None), (9, "g"), (None, "b")], "doc_id long, domain string")
    got = {r.doc_id: r for r in mixing.mix(docs, labelled, {"g": 3, "b": 1}).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None} and got[1].tokens == got[2].tokens == 0 and got[3].tokens == 6
    assert all(r.rate >= 0 and abs(r.p_g + r.p_b - 1) < 1e-9 for r in got.values())
    assert mixing.mix(docs.limit(0), labelled, {"g": 1, "b": 1}).collect() == []
    even = mixing.mix(docs, labelled.limit(0), {"g": 1, "b": 1}).collect()
    assert all(r.p_g == 0.5 and r.rate == pytest.approx(1) for r in even)
    out = mixing.mixed_documents(docs, labelled, {"g": 3, "b": 1})
    assert out.columns == docs.columns
    assert out.where(F.col("doc_id").isNull()).count() == 2
    clash = docs.withColumnsRenamed({"tokens": "_copies"}).withColumn("_id", F.lit("x"))
    assert mixing.mixed_documents(clash, labelled, {"g": 3, "b": 1}).columns == clash.columns
    plan = mixing.mix(docs, labelled, {"g": 3, "b": 1})._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_rare_domain_reaches_its_target(spark, caplog):
    rows = [(i, 100, [0.01, 0.99] if i < 3 else [0.99, 0.01]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>")
    rate = {r.doc_id: r.rate for r in mixing.fit_rates(df, [0.9, 0.1])[0].collect()}
    assert sum(rate[i] * p[1] for i, _, p in rows) / 200 == pytest.approx(0.1, abs=2e-4) and rate[0] > 4
    assert not caplog.records
    mixing.fit_rates(df, [0.9, 0.1], steps=0)
    assert "shares of tokens reached" in caplog.text
