import math
from collections import Counter

import numpy as np
import pytest

from trialloom.llm import lm

SF = "/root/testdata/sf0.001"


def plain(texts):
    """Stupid backoff over the words themselves, one document at a time."""
    docs = [(t or "").lower().encode().split() for t in texts]
    one, two = Counter(), Counter()
    for d in docs:
        one.update(d)
        two.update(zip(d, d[1:]))
    total = sum(one.values())
    out = []
    for d in docs:
        own = Counter(zip(d, d[1:]))
        log, back = math.log(one[d[0]] / total) if d else 0.0, 0
        for v, w in zip(d, d[1:]):
            c = two[v, w] - own[v, w]
            if c > 0:
                log += math.log(c / one[v])
            else:
                log += math.log(0.4 * one[w] / total)
                back += 1
        out.append((len(d), back, log))
    return out


def check(got, texts):
    want = sorted(plain(texts))
    got = sorted((r.n_words, r.n_backoff, r.log_score, r.score) for r in got)
    assert len(got) == len(want)
    for (n, back, log, score), (n2, back2, log2) in zip(got, want):
        assert (n, back) == (n2, back2) and log == pytest.approx(log2, rel=1e-6, abs=1e-4)
        assert (score is None) == (n == 0) and (n == 0 or score == pytest.approx(log / n))


@pytest.mark.parametrize("hot,common", [(lm.HOT, lm.COMMON), (8, 300), (0, 0), (0, 50), (40, 40)])
def test_matches_plain_version(spark, monkeypatch, hot, common):
    """Whatever number of words is hot or common, every pair is scored once."""
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "COMMON", common)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = df.collect()
    got = lm.stupid_backoff(df).collect()
    check(got, [r.text for r in rows])
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows)


def test_a_home_word_with_a_third_of_all_words(spark, monkeypatch):
    """A common word outside the hot ones is dealt to many buckets, and every score stays."""
    rng = np.random.default_rng(3)
    texts = [" ".join(w for k in rng.integers(0, 3000, size=60) for w in ("often", f"w{k}", f"x{k % 50}")) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(lm, "HOT", 0)
    monkeypatch.setattr(lm, "PER_PART", 1000)
    check(lm.stupid_backoff(df).collect(), texts)
    words = lm.written(lm.unigram_counts(df))
    top = words.toPandas().sort_values("word")
    share, none, parts, total = spark.sparkContext.broadcast, np.zeros(0, dtype=np.int64), 54, 54_000
    held = {}
    for r in lm.exploded(df, parts, total, share((top["word"].to_numpy(), top["n"].to_numpy())), share(none), share(none)).collect():
        held[r.bucket] = held.get(r.bucket, 0) + len(r.r)
    assert max(held.values()) < 4 * sum(held.values()) / parts  # one bucket had a third before


def test_cases(spark, monkeypatch):
    texts = [None, "", "  \n", "one", "a b a b a b", "a b c", "a b c", "É x É x", "w " * 70_000, "a b"]
    rows = [(None if i == 5 else i % 7, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score long")
    for common in (lm.COMMON, 2):
        monkeypatch.setattr(lm, "COMMON", common)
        monkeypatch.setattr(lm, "SUMMED", 3)
        got = lm.stupid_backoff(df).collect()
        check(got, texts)
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert lm.stupid_backoff(df.limit(0)).collect() == []


def test_plan_joins_counts_in_place(spark):
    """Pair counts are joined to the pairs where they were counted, and both read one shuffle."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    words = lm.written(lm.unigram_counts(rows))
    none, share = np.zeros(0, dtype=np.int64), spark.sparkContext.broadcast
    blocks = lm.exploded(rows, 4, 10, share((none, none)), share(none), share(none))
    with lm._joins_by_bucket(spark):
        out = lm.sums(blocks, words, words.limit(1), 4, 10)
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Join [") >= 3 and plan.count("MapInArrow") == 1 and "ReusedExchange" in plan
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
