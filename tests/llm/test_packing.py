import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from trialloom.llm import packing


def plain_best_fit(lengths, window):
    """Sequence loads by the textbook rule, one item at a time."""
    loads = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, x in enumerate(loads) if x + n <= window]
        if fits:
            loads[max(fits, key=lambda i: (loads[i], -i))] += n
        else:
            loads.append(n)
    return sorted(loads)


def test_best_fit_matches_plain_version():
    rng = random.Random(5)
    for window in (7, 16, 64):
        for _ in range(60):
            lengths = [rng.choice([1, 2, 3, rng.randint(1, window)]) for _ in range(rng.randint(1, 60))]
            histogram = {n: lengths.count(n) for n in set(lengths)}
            loads, items = {}, 0
            for length, _, n, per, seq, at in packing.best_fit_decreasing(histogram, window):
                for i in range(n):
                    s, o = seq + i // per, at + i % per * length
                    assert loads.get(s, 0) == o
                    loads[s] = o + length
                    items += 1
            assert items == len(lengths)
            assert sorted(loads) == list(range(len(loads)))
            assert sorted(loads.values()) == plain_best_fit(lengths, window)


def check_pack(rows, docs, window):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, (_, text) in enumerate(docs):
        want[i] = tok.encode(text or "", add_special_tokens=False).ids + [0]
    got = sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id is not None)
    expected = []
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is None:
            continue
        for s in range(0, len(want[i]), window):
            part = want[i][s : s + window]
            expected.append((doc_id, s, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()), len(want[i])))
    assert got == sorted(expected)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window


def test_pack_round_trip(spark):
    docs = [(1, None), (2, ""), (3, "Hello <|endoftext|> world  \n\n x"), (4, "wörd " * 50), (5, "a"), (5, "a"), (None, "null id"), (6, "É!!  '’s don't 12345"), (7, "abc " * 8), (8, " ".join(map(str, range(90)))), (9, "many wörds and 漢字 " * 40_000), (10, "x" * 200_000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, length int").repartition(3)
    rows = packing.pack(df, window=16).collect()
    check_pack(rows, docs, 16)
    assert sum(r.doc_id is None for r in rows) == 1
    assert packing.pack(df.limit(0), window=16).collect() == []


def test_pack_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    rows = packing.pack(df).collect()
    check_pack(rows, docs, 1024)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.02 * total / 1024 + 1


def test_ids_are_the_tokenizers_own(spark, monkeypatch):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = packing._Ids("byte_bpe_50k")
    rng = random.Random(9)
    bits = [" ", "  ", "\n", "\t", "\r\n", "a", "Word", "don't", "'s", "12", "é", "ñandú", "ǅɏ", "ɐ", "naïve,x2", "ﬁ", "Ⅷ", "a\u0301", "!!", "$$$.", "\u00a0", "\u2028", "<|endoftext|>", "漢字", "_", "🙂", "\x1c", "\u0120", "x" * 300]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    texts += [" ".join(rng.choice(bits[4:]) for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    for limit in (packing.CACHE, 1000):  # with the smaller one, words are learned again and again
        monkeypatch.setattr(packing, "CACHE", limit)
        got = [np.frombuffer(x, dtype="<u4").tolist() for i in range(0, len(texts), 256) for x in ids.encode(texts[i : i + 256])]
        assert got == want
