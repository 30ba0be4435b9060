import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from trialloom.llm import quality
from trialloom.llm.common import held_out

SF = "/root/testdata/sf0.01"


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    field = quality.Field(np.zeros(quality.N_FEATURES), 0.0, rng.normal(size=(2, 2)))
    for n in (1, 2, 5):
        s = rng.normal(size=n) * 2
        weight, good = 0.0, np.zeros(n)
        for labels in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(s[i] * labels[i] for i in range(n)) + sum(field.pair[a, b] for a, b in itertools.pairwise(labels)))
            weight += w
            good += w * np.array(labels)
        assert np.allclose(field.marginals(s.tolist()), good / weight)


def test_fit_follows_neighbours():
    rng = np.random.default_rng(2)
    chains, x, y = [], [], []
    for c in range(60):
        n = int(rng.integers(1, 9))
        label = int(rng.random() < 0.5)
        chains += [c] * n
        y += [label] * n
        x += [[label + rng.normal(), rng.normal()] for _ in range(n)]
    f = quality.fit(np.array(x), np.array(y), np.array(chains), context=1.0)
    assert f.weights[0] > 0.3 and abs(f.weights[1]) < 0.4
    assert f.pair[0, 0] + f.pair[1, 1] > f.pair[0, 1] + f.pair[1, 0] + 1


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    field = quality.train(docs, labels, ~held_out(F.col("doc_id")))
    got = quality.score(docs, field).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    right = sum((r.score >= 0.7) == (r.quality == 1) for r in got)
    assert right / len(got) >= 0.97
    kept = {r.doc_id for r in quality.good_documents(docs, field).collect()}
    assert kept == {r.doc_id for r in quality.score(docs, field).collect() if r.score >= 0.7}


def test_junk_lines_in_good_documents_are_found(spark):
    """A line of junk between the lines of a good document is judged by itself; so is a good one between junk."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    field = quality.train(docs, labels, ~held_out(F.col("doc_id")))
    rows = docs.join(labels, "doc_id").where(held_out(F.col("doc_id"))).orderBy("doc_id").collect()
    good = [r.text.split("\n") for r in rows if r.quality == 1 and r.text.count("\n") > 5]
    junk = [x for r in rows if r.quality == 0 for x in r.text.split("\n") if any(m in x for m in ("!!", " | ", "&&&"))]
    planted, others = [], []
    for i, lines in enumerate(good):
        k = 1 + i % (len(lines) - 1)
        p = field.marginals(quality.line_scores(["\n".join([*lines[:k], junk[i % len(junk)], *lines[k:]])], field)[0])
        planted.append(p[k])
        others += [*p[:k], *p[k + 1 :]]
    assert len(good) > 20 and np.median(planted) < 0.5 and np.quantile(planted, 0.9) < 0.7
    assert np.median(others) > 0.9 and np.mean(np.array(others) > 0.7) > 0.9


def test_blocks_of_lines_change_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    field = quality.Field(rng.normal(size=quality.N_FEATURES), 0.2, rng.normal(size=(2, 2)))
    texts = [None, "", "\n", "one line", "\n\nx\n", *["\n".join("ab C!" * int(rng.integers(0, 9)) for _ in range(int(n))) for n in rng.integers(1, 60, size=20)]]
    x = [quality.with_neighbours(quality.line_features((t or "").split("\n"))[0], *quality._ends(np.array([(t or "").count("\n") + 1]))) for t in texts]
    want = np.concatenate([m @ field.weights + field.bias for m in x])
    for chunk, block in ((1 << 20, 20_000), (1, 1), (7, 13)):
        monkeypatch.setattr(quality, "CHUNK", chunk)
        monkeypatch.setattr(quality, "BLOCK", block)
        s, _, counts = quality.line_scores(texts, field)
        assert np.allclose(s, want) and counts.tolist() == [(t or "").count("\n") + 1 for t in texts]


def test_many_lines():
    field = quality.Field(np.ones(quality.N_FEATURES), 0.0, np.zeros((2, 2)))
    assert 0 <= quality.scores(["a b\n" * 300_000], field)[0] <= 1


def test_cases(spark):
    rows = [(1, None, 1.0), (2, "", 2.0), (None, "a line", 3.0), (3, "\n\n\n", 4.0), (4, "word " * 100_000, 5.0), (4, "x\ny", 6.0), (4, "x\ny", 6.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    field = quality.train(df, no_labels, F.lit(True))
    got = quality.score(df, field).collect()
    assert len(got) == len(rows) and all(r.score == 0.5 for r in got)
    one = spark.createDataFrame([(1, 1), (4, 0), (4, None), (None, 1)], "doc_id long, quality int")
    field = quality.train(df, one, F.lit(True))
    got = quality.score(df, field).collect()
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows)
    assert quality.score(df.limit(0), field).collect() == []
