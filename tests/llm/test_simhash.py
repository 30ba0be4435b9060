import random

import xxhash

from trialloom.llm import simhash


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in lower + " ":
        if c in " \t\n\v\f\r":
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[j] < label[i]:
                    label[i] = label[j]
                    changed = True
    return label


def test_fingerprint_matches_plain_version(monkeypatch):
    texts = ["", None, "one", "One two", "a b\tc\nd  e", "É x y z É", "w " * 500, "A b C d E f g h"]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "BLOCK", 3)
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def planted(rng):
    fps = [rng.getrandbits(64) for _ in range(30)]
    for base in fps[:6]:
        cur = base
        for _ in range(8):
            for _ in range(rng.randint(1, 3)):
                cur ^= 1 << rng.randrange(64)
            fps.append(cur)
    dense = rng.getrandbits(64)
    fps += [dense ^ (rng.getrandbits(64) & 0b1010101) for _ in range(40)]
    return sorted(set(fps))


def test_links_find_every_component(spark):
    rng = random.Random(3)
    fps = planted(rng)
    want = slow_components(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    for limit in (2048, 6):  # 6: every step of cutting large groups is used
        edges = {(r.src, r.dst) for r in simhash.links(df, limit).collect()}
        at = {s: i for i, s in enumerate(signed)}
        label = list(range(len(fps)))
        for _ in range(len(fps)):
            for a, b in edges:
                label[at[a]] = label[at[b]] = min(label[at[a]], label[at[b]])
        assert label == want


def test_groups_and_cases(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, text, "x"), (3, text, "x"), (9, text.upper().lower() + " end", "y"), (1, None, "x"), (2, "", None), (None, text, "q"), (7, "other words here now", "z"), (7, "other words here now", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = [(r.doc_id, r.component_id) for r in simhash.simhash_groups(docs).collect()]
    assert len(got) == len(rows)
    near = (simhash.fingerprint(rows[2][1]) ^ simhash.fingerprint(text)).bit_count() <= 3
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (9, 3 if near else 9), (1, 1), (2, 1), (None, 3), (7, 7), (7, 7)], key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(empty).collect() == []
    kept = [r.doc_id for r in simhash.deduplicated(docs).collect()]
    assert sorted(kept, key=str) == sorted([3, 1, 7, None] + ([] if near else [9]), key=str)


def test_rows_that_stay_are_known_by_id_and_text(spark):
    """Different texts under one id are rows of their own; of the same row one stays."""
    a, b, c = ("word%d " % i * 3 + " ".join(f"{x}{i * k}" for k, x in enumerate("qrstuvwxyz")) for i in (1, 2, 3))
    rows = [(1, a), (1, b), (2, a), (3, c), (3, c), (4, c), (None, a), (None, a), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", None) for i, t in rows], "doc_id long, text string, _id string, times string")
    kept = sorted(((r.doc_id, r.text) for r in simhash.deduplicated(docs).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (3, c), (None, a), (None, a), (5, None)], key=str)
