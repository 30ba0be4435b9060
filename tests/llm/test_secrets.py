import hashlib
import math
import random
import re
import time
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from trialloom.llm import secrets

KEY = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_.=-"


def slow_base(text):
    """The patterns read character by character."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    found, i = [], 0
    while i < len(text):
        end = None
        for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if low.startswith(word, i):
                j = i + len(word)
                if text[j : j + 1] in ("'", '"') and text[j : j + 1]:
                    j += 1
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] not in (":", "="):
                    continue
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] in ("'", '"') and text[j : j + 1]:
                    j += 1
                k = j
                while k < len(text) and text[k] in KEY:
                    k += 1
                if k > j:
                    end = k
                    if k - j >= 6:
                        found.append(("assign", i, k))
                    break
        i = end or i + 1
    i = 0
    while i < len(text):
        if text.startswith("AKIA", i):
            k = i + 4
            while k < len(text) and text[k] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
                k += 1
            if k - i >= 20:
                found.append(("access", i, k))
            i = max(k, i + 1) if k > i + 4 else i + 1
        else:
            i += 1
    i = 0
    while i < len(text):
        k = i
        while k < len(text) and text[k] in "0123456789abcdef":
            k += 1
        if k - i >= 24:
            found.append(("hex", i, k))
        i = max(k, i + 1)
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


PARTS = st.sampled_from(["token", "TOKEN", "api_key", "apikey", "Secret", "passwd", '"', "'", " ", "=", ":", "AKIA", "ABCDEF0123456789", "deadbeef00", "é", "abc", "x" * 7, "\n", "ſecret", "toKen", "=="])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_matches_plain_reading(text):
    assert secrets.base_spans(text) == slow_base(text)


def test_entropy_matches_plain_version():
    rng = random.Random(1)
    for _ in range(50):
        run = "".join(rng.choice("ab12cdEF34" if rng.random() < 0.5 else KEY[:62]) for _ in range(rng.randint(1, 80)))
        hit = set()
        for s in range(len(run) - 19):
            w = run[s : s + 20]
            h = -sum(c / 20 * math.log2(c / 20) for c in Counter(w).values())
            if h >= 3.4 and sum(map(str.isalpha, w)) >= 2:
                changes = sum(a.isalpha() and b.isalpha() and a.isupper() != b.isupper() for a, b in zip(w, w[1:]))
                if sum(map(str.isdigit, w)) / 2 + changes / 4 < 1:
                    continue
                hit |= set(range(s, s + 20))
        got = {i for a, b in secrets.high_entropy(run, 20, 3.4 - 1e-12, 2, 2, 4) for i in range(a, b)}
        assert got == hit


def slow_windows(run, width, bits, digits, letters, changes):
    """Characters that some window of the run covers, each window read by itself."""
    hit = set()
    for s in range(len(run) - width + 1):
        w = run[s : s + width]
        h = -sum(c / width * math.log2(c / width) for c in Counter(w).values())
        turns = sum(a.isalpha() and b.isalpha() and a.isupper() != b.isupper() for a, b in zip(w, w[1:]))
        if h >= bits and sum(map(str.isalpha, w)) >= letters and sum(map(str.isdigit, w)) / digits + turns / changes >= 1:
            hit |= set(range(s, s + width))
    return hit


def test_runs_of_one_character():
    """Rules, padding and runs longer than a window, alone and around random characters."""
    rng = random.Random(5)
    for c in secrets.CLASSES:
        alphabet = [x for x in KEY if re.fullmatch(c.run, x)]
        for ch in alphabet:
            for n in (c.width - 1, c.width, c.width + 1, 3 * c.width):
                assert secrets.high_entropy(ch * n, c.width, c.bits, c.digits, c.letters, c.changes) == []
        for _ in range(60):
            run = "".join(rng.choice(alphabet) * rng.choice([1, 1, 1, 2, c.width, c.width + 7]) for _ in range(rng.randint(1, 60)))
            got = {i for a, b in secrets.high_entropy(run, c.width, c.bits - 1e-12, c.digits, c.letters, c.changes) for i in range(a, b)}
            assert got == slow_windows(run, c.width, c.bits - 1e-9, c.digits, c.letters, c.changes)


def test_scan_cases(spark):
    mixed = "k9Zp2LmQ7xRt4VbN8sWd3YcF"
    rows = [
        (1, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', 1),
        (2, None, 2), (3, "", 3), (4, f"see {mixed} here", 4), (None, "password: hunter2222", 5),
        (5, "EXAMPLE" + mixed[:12] + "EXAMPLE" + mixed[:9], 6), (8, "EXAMPLE" + mixed, 6), (6, "plain words only and averyveryverylongwordwithoutdigits", 7), (6, "plain words only and averyveryverylongwordwithoutdigits", 7),
        (7, "AKIA" + "A1" * 10, 8), (9, "hello\n" + "-" * 40 + "\nend", 9), (10, "=" * 30 + "x" * 25 + "\n" + "0" * 21 + "_" * 80 + "\n" + mixed, 10),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = {(r.doc_id, r.text if "text" in r else None): r for r in secrets.scan_secrets(df).collect()}
    by = {r.doc_id: r for r in got.values()}
    assert len(secrets.scan_secrets(df).collect()) == len(rows)
    assert by[1].n_assign == 1 and by[1].n_hex == 1 and by[1].spans == "assign:0:49,hex:9:49"
    assert by[1].base_sha256 == hashlib.sha256(b"assign:0:49,hex:9:49").hexdigest()
    assert by[1].redacted == '[SECRET]" end'
    assert by[2].spans == "" and by[2].redacted is None and by[3].spans == ""
    assert by[4].spans == f"entropy_alnum:4:{4 + len(mixed)}"
    assert by[8].n_entropy == 1  # what stands beside an allowed word is a secret by itself
    assert secrets.scan_secrets(df, redacted=False).columns == secrets.scan_secrets(df).drop("redacted").columns
    assert by[9].spans == "" and by[9].redacted.startswith("hello") and by[10].n_entropy == 1
    bare = df.select("doc_id", "text")
    assert {r.doc_id: r.text for r in secrets.without_secrets(bare).collect()}[9] == "hello\n" + "-" * 40 + "\nend"
    assert by[5].spans == "" and by[6].spans == "" and by[None].n_assign == 1 and by[7].n_access == 1
    assert secrets.scan_secrets(df.limit(0)).collect() == []


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: secrets.joined(slow_base(r.text)) for r in df.where("doc_id % 4 = 2 or text like '%token%'").collect()}
    got = {r.doc_id: r for r in secrets.scan_secrets(df).collect()}
    assert len(got) == 1000
    for k, v in want.items():
        assert got[k].base_sha256 == hashlib.sha256(v.encode()).hexdigest()
    assert sum(r.n_entropy for r in got.values()) == 0  # clean texts stay clean
    assert secrets.without_secrets(df).count() == 1000


def test_planted_secrets_are_found():
    """Random tokens without a keyword before them, which no base pattern finds."""
    rng, scanner = random.Random(7), secrets.Scanner()
    alphabets = {"alnum": KEY[:62], "letters": KEY[10:62], "base64": KEY[:62] + "+/", "url": KEY[:62] + "_-"}
    for name, letters in alphabets.items():
        found = 0
        for _ in range(400):
            token = "".join(rng.choice(letters) for _ in range(rng.randint(24, 44)))
            base, every = scanner.spans(f"the key is {token} and no more")
            assert not base
            found += any(b - a >= 0.8 * len(token) for _, a, b in every)
        assert found / 400 >= (0.8 if name == "letters" else 0.95), (name, found)
    for plain in ("getUserNameFromTableRows", "averyveryverylongwordwithoutdigits", "https/www-example-org/some-path_to/files", "2024-11-28-10-22-33-44-55", "IncomprehensibilitiesOfMen", "12345678901234567890123"):
        assert scanner.spans(plain)[1] == [], plain


def test_very_long_texts():
    rng = random.Random(3)
    tokens = ["".join(rng.choice(KEY[:62]) for _ in range(24)) for _ in range(2000)]
    text = " ".join(tokens * 50)  # 100,000 tokens, 2.5 MB
    start = time.monotonic()
    base, every = secrets.Scanner().spans(text)
    assert len(every) > 90_000 and time.monotonic() - start < 60
    assert len(secrets.redact(text, every)) < len(text)
