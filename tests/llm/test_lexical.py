import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trialloom.llm import lexical


def slow(docs, items, k):
    """Every document against every item: {item: [(rank, doc_id, score)]}."""

    def words(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    held = [(d, Counter(w), len(w)) for d, t in docs if (w := words(t))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, text in items:
        asked.setdefault(i, Counter()).update(words(text))
    out = {}
    for i, terms in asked.items():
        scored = []
        for d, c, n in held:
            m = 75 + (25 * n * n_docs) // n_terms
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in terms.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        best = sorted(scored, key=lambda x: x[:3])[:k]
        if best:
            out[i] = [(r, x[3], -x[0]) for r, x in enumerate(best, 1)]
    return out


def ranked(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    return {i: sorted(v) for i, v in out.items()}


def test_cases(spark):
    docs = [
        (1, "Alpha beta gamma", 0), (2, "alpha ALPHA beta", 0), (3, None, 0), (4, "", 0), (5, "... !!", 0), (None, "alpha beta", 0), (6, "alpha beta", 0), (6, "alpha beta", 0),
        (7, "élan naïve ünïcode Ünïcode", 0), (8, "x" * 300_000 + " alpha", 0), (9, "alpha " * 100_000, 0),
    ]
    docs += [(100 + i, "common filler words " + "pad " * (i % 7), 0) for i in range(60)]
    items = [(1, "Alpha, beta!", 9), (2, "unicode Ünïcode", 9), (3, None, 9), (4, "", 9), (5, "nowhere", 9), (6, "alpha alpha common", 9), (6, "filler", 9), (None, "gamma", 9)]
    d = spark.createDataFrame(docs, "doc_id long, text string, rank int").repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string, score int")
    for k in (1, 3, 20):
        assert ranked(lexical.rank(d, q, k)) == slow([x[:2] for x in docs], [x[:2] for x in items], k)
    assert ranked(lexical.rank(d.limit(0), q)) == {} and ranked(lexical.rank(d, q.limit(0))) == {}


def test_blocks_and_small_shards(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 30, 300])))) for i in range(400)]
    docs += [(1000 + i, docs[i % 5][1]) for i in range(200)]  # copies tie
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))) for i in range(30)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = slow(docs, items, 20)
    assert ranked(lexical.rank(d, q)) == want
    monkeypatch.setattr(lexical, "BLOCK", 100)
    assert ranked(lexical.rank(d, q)) == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 5), st.sampled_from([3, 16, 4096]))
def test_maxscore_equals_all_scores(seed, k, window):
    rng = random.Random(seed)
    docs = [(rng.randrange(200) if rng.random() < 0.95 else None, " ".join(rng.choices("abcdefghij", weights=[2.0**-i for i in range(10)], k=rng.randint(0, 30)))) for _ in range(rng.randint(0, 60))]
    items = [(0, " ".join(rng.choices("abcdefghijk", k=rng.randint(1, 8))))]
    n_docs = sum(1 for _, t in docs if t)
    n_terms = sum(len(t.split()) for _, t in docs)
    terms = Counter(items[0][1].split())
    df = Counter(t for _, text in docs for t in set(text.split()))
    q = lexical.Query({t: lexical.weight(n_docs, df[t]) * r for t, r in terms.items() if df[t]}, k)
    old, lexical.WINDOW = lexical.WINDOW, window
    try:
        for part in (docs[::2], docs[1::2]):
            shard = lexical._Open({t.encode(): i for i, t in enumerate(sorted(terms))})
            for d, t in part:
                shard.add(d, t.encode())
            row = {c: v[0] for c, v in shard.row().items()}
            if row["ids"]:
                lexical.Shard(row, n_docs, n_terms).search(q)
    finally:
        lexical.WINDOW = old
    got = sorted(((-s, not known, -neg) for s, known, neg in q.best))
    want = [(-s, d is None, d or 0) for _, d, s in slow(docs, items, k).get(0, [])]
    assert got == want


def test_weak_lists_are_probed_for_few():
    """A common term's list is not read for documents that can no longer qualify."""
    rng = np.random.default_rng(1)
    shard = lexical._Open(None)
    n = 20_000
    for i in range(n):
        shard.add(i, b"the " * int(rng.integers(1, 4)) + (b"rare " * 3 if i < 30 else b"") + b"pad " * int(rng.integers(5, 50)))
    s = lexical.Shard({c: v[0] for c, v in shard.row().items()}, n, shard.n_terms)
    q = lexical.Query({"the": lexical.weight(n, n // 2), "rare": lexical.weight(n, 30)}, 20)
    s.search(q)
    assert len(q.best) == 20 and all(-neg < 30 for _, _, neg in q.best)
    assert s.probes <= 30 + lexical.WINDOW


def test_full_index(spark):
    """Without a set of terms a shard holds all of them."""
    df = spark.createDataFrame([(1, "b a b"), (2, "c")], "doc_id long, text string").coalesce(1)
    (row,) = lexical.build_shards(df).collect()
    assert (row.n_docs, row.n_terms, row.ids, row.lengths, sorted(row.terms)) == (2, 4, [1, 2], [3, 1], ["a", "b", "c"])
