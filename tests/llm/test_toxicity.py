import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialloom.llm import queries, toxicity as tox
from trialloom.llm.common import held_out


def test_composition_is_one_after_the_other():
    machines = [tox.after(tox.TARGET, 4, {tox.INSULT: (tox.DIRECTED, 1.0)}), tox.after(tox.NEGATION, 3, tox._all(tox.NEGATED, -3.0)), tox.after(tox.REPORT, None, tox._all(tox.REPORTED, -2.0))]
    one = tox.compose(*machines)
    rng = random.Random(1)
    for _ in range(300):
        symbols = rng.choices(tox.SYMBOLS, weights=[4, 2, 1, 1, 1, 0.3, 0.2, 0.2, 0.2, 0.2], k=rng.randint(0, 15))
        seen, weights = list(symbols), [0.0] * len(symbols)
        for m in machines:
            seen, w = m.apply(seen)
            weights = [a + b for a, b in zip(weights, w)]
        assert one.apply(symbols) == (seen, weights)


def slow_after(symbols, mark, span, changes):
    """The rule of after(), read off positions."""
    out = []
    for i, s in enumerate(symbols):
        near = symbols[:i] if span is None else symbols[max(0, i - span) : i]
        out.append(changes[s][0] if mark in near and s in changes else s)
    return out


def test_machines_match_positions():
    rng = random.Random(2)
    for _ in range(300):
        symbols = rng.choices(tox.SYMBOLS[:6], k=rng.randint(0, 14))
        for span in (1, 3, None):
            changes = {tox.INSULT: (tox.DIRECTED, 1.0), tox.THREAT: (tox.THREATENED, 1.0)}
            assert tox.after(tox.TARGET, span, changes).apply(symbols)[0] == slow_after(symbols, tox.TARGET, span, changes)


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("you are such an idiot", {tox.DIRECTED}),
        ("what a stupid day", {tox.INSULT}),
        ("stupid you", {tox.DIRECTED}),
        ("you are not an idiot", {tox.NEGATED}),
        ("he said you are an idiot", {tox.REPORTED}),
        ("you idiot, he said", {tox.REPORTED}),
        ("I will kill you", {tox.THREATENED}),
        ("kill the process", set()),
        ("I would never kill you", {tox.NEGATED}),
        ("du bist ein Vollidiot", {tox.DIRECTED}),
        ("il a dit que tu es un connard", {tox.REPORTED}),
    ],
)
def test_clauses(text, kinds):
    lexicon = tox.Lexicon(tox.seeds())
    read = [lexicon[t] for t in tox._TOKEN.findall(text.lower())]
    assert set(tox.clause_scores([s for s, _ in read], [w for _, w in read])) == kinds


def test_clauses_count_and_not_words():
    """The same insults are worth more aimed at someone than denied or reported, also across clauses."""
    lexicon, g = tox.Lexicon(tox.seeds()), tox.Grammar()
    direct, plain, denied, reported = (g.score(tox.features(t, lexicon)) for t in ("you are an idiot", "some idiot did it", "you are not an idiot", "they called him an idiot"))
    assert direct > plain > max(denied, reported)
    assert tox.features("not. an idiot", lexicon)[0] > tox.features("not an idiot", lexicon)[0]  # a negation ends with its clause


def test_lexicon_adds_up_a_path():
    lexicon = tox.Lexicon({"low*": (tox.INSULT, 1.0), "lowei*": (tox.INSULT, 2.0), "loweit": (tox.INSULT, 4.0), "the": (tox.TARGET, 0.0)})
    assert [lexicon[w] for w in ("low", "lowei", "loweit", "loweits", "lo", "the", "then")] == [(tox.INSULT, 1.0), (tox.INSULT, 3.0), (tox.INSULT, 7.0), (tox.INSULT, 3.0), (tox.WORD, 0.0), (tox.TARGET, 0.0), (tox.WORD, 0.0)]


def test_sparse_weights_choose_the_stem():
    """An entry that stands in all toxic documents takes the weight of those that go along with it."""
    rng = np.random.default_rng(0)
    y = np.array([1.0] * 100 + [0.0] * 100)
    pairs = [(d, 0) for d in range(100)] + [(d, 1 + int(rng.integers(5))) for d in range(100)] + [(d, 6) for d in range(0, 200, 2)]
    w = tox._sparse(np.array([d for d, _ in pairs]), np.array([e for _, e in pairs]), y, np.zeros(7))
    assert w[0] > 2 and w[0] > 3 * w[1:].max() and (w >= 0).all()


def test_longest_stems():
    counts = {"lo*": (9, 1), "low*": (9, 0), "lowei*": (9, 0), "lowein": (4, 0), "idi*": (5, 0), "idiot": (5, 0), "idiot*": (5, 0), "zu*": (3, 0)}
    assert tox._longest(counts) == ["idiot", "lo*", "lowei*", "lowein", "zu*"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op12_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    hits = sum(r.predicted == 1 and r.toxic == 1 for r in got)
    # 9 of 144 toxic ones are junk (one word over and over, cells, capitals) that holds no insult
    assert hits / sum(r.predicted for r in got) > 0.97 and hits / sum(r.toxic for r in got) > 0.92
    assert docs.count() == queries.op12_toxicity(spark, sf).count()


def test_cases(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "you are an idiot", 1), (3, "you are an idiot", 1), (3, "you are an idiot", 1), (4, "idiot " * 200_000, 1), (5, "a calm text", 1), (6, "x" * 500_000, 1), (7, "...\n!?", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = tox.score(df, tox.Grammar()).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] == by[2] and by[3] == by[None] > 0.7 and by[4] > 0.7 and by[5] < 0.3 and by[6] < 0.3
    assert tox.score(df.limit(0), tox.Grammar()).collect() == []
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 1), (3, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    for labels in (none, one):  # without documents of both labels the fixed words count
        assert tox.train(df, labels, F.lit(True)) == tox.Grammar()
    both = spark.createDataFrame([(i, int(i in (3, 4))) for i in range(1, 8)], "doc_id long, toxic int")
    trained = tox.train(df, both, ~held_out(F.col("doc_id"), 3, 1))
    assert tox.score(df, trained).count() == len(rows)
    assert tox.train(df.limit(0), both, F.lit(True)) == tox.Grammar()


def test_very_long_text_is_read_once():
    text = ("you are an idiot and not a clown. " * 3 + "w" * 1000 + " ") * 3000
    start = time.monotonic()
    x = tox.features(text, tox.Lexicon(tox.seeds()))
    assert x[1] > 8 and time.monotonic() - start < 20
