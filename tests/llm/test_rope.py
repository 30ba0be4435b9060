import hashlib
import random
import time

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from trialloom.llm import queries, rope


def slow(doc_id, text, unit="char"):
    """The transformation with plain lists of units."""
    text = text or ""
    units = list(text) if unit == "char" else regex.findall(rope.UNITS[unit], text)
    assert "".join(units) == text
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]
    cuts = [h[0] % (len(units) + 1), h[1] % (len(units) + 1)]
    a, b = min(cuts), max(cuts)
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def depth_holds(r):
    if isinstance(r, rope.Leaf):
        return True
    counts = r.units == r.left.units + r.right.units and r.chars == r.left.chars + r.right.chars
    return counts and abs(r.left.depth - r.right.depth) <= 1 and depth_holds(r.left) and depth_holds(r.right)


TEXTS = st.lists(st.sampled_from(["a", "é", "😀", " ", "\n", "<P", ">", "<S>", "word", "é", "‍", "x" * 9]), max_size=30).map("".join)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(0, 400), st.sampled_from(["char", "word", "line"]))
def test_matches_plain_lists(text, doc_id, unit):
    r = rope.rope(text, unit, size=4)
    p = rope.plan(text, r.units, rope.draws(doc_id))
    out, prefix, middle = rope.transform(r, p)
    assert (r.units, p.form, prefix, middle, rope.text_of(out)) == slow(doc_id, text, unit)
    # the inverse sees nothing but output and form
    assert rope.text_of(rope.restore(rope.rope(rope.text_of(out), size=4), p.form)) == text
    assert rope.text_of(rope.restore(out, p.form)) == text


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 300), st.data())
def test_trees_stay_balanced(n, data):
    r = rope.rope("ab" * n, size=3)
    for _ in range(6):
        at = data.draw(st.integers(0, r.units))
        a, b = rope.split(r, at)
        assert rope.text_of(a) + rope.text_of(b) == rope.text_of(r) and a.units == at
        assert depth_holds(a) and depth_holds(b)
        r = rope.join(b, a)
        assert depth_holds(r)


def test_very_long_text():
    text = "".join(random.Random(1).choices("abc é😀\n", k=3_000_000))
    start = time.monotonic()
    for doc_id in range(3):
        r = rope.rope(text)
        assert r.depth <= 12
        out, prefix, middle = rope.transform(r, rope.plan(text, r.units, rope.draws(doc_id)))
        assert rope.text_of(rope.restore(out, rope.plan(text, r.units, rope.draws(doc_id)).form)) == text
    assert time.monotonic() - start < 30


def test_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a<M>b", 0), (None, "null id here", 0), (4, "x", 0), (5, "dup dup", 0), (5, "dup dup", 0), (6, "é😀", 0), (7, "long " * 200_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    got = sorted((r.doc_id or 0, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256, r.restored_sha256) for r in rope.fill_in_middle(df).collect())
    want = []
    for doc_id, text, _ in rows:
        w = slow(doc_id, text)
        want.append((doc_id or 0, *w, hashlib.sha256(w[-1].encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert rope.fill_in_middle(df.limit(0)).collect() == []
    words = {r.doc_id: r for r in rope.fill_in_middle(df, unit="word").collect()}
    assert (words[5].n, words[5].output) == (slow(5, "dup dup", "word")[0], slow(5, "dup dup", "word")[-1])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op13_fim(spark, f"/root/testdata/{sf}").collect()}
    assert len(got) == len(docs) and {r.form for r in got.values()} == {"plain", "psm", "spm"}
    for d in docs:
        n, form, prefix, middle, out = slow(d.doc_id, d.text)
        r = got[d.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256(d.text.encode()).hexdigest()
