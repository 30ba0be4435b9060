"""Secrets in texts: fixed patterns, and windows of high entropy."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import map_arrow

# The base patterns and the least lengths of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is matched whole, so shorter runs never match
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Order of kinds that start at the same place.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")


@dataclass(frozen=True)
class EntropyClass:
    """A class of characters: windows of this width inside runs of it count as secret from this
    entropy (bits a character) on, if they hold at least so many letters, and so many digits
    or changes between upper and lower case, or part of the one and part of the other."""

    kind: str
    run: str
    width: int
    bits: float
    digits: int
    letters: int
    changes: int


CLASSES = (
    EntropyClass("entropy_hex", r"[0-9A-Fa-f]", 24, 3.1, 4, 2, 99),
    EntropyClass("entropy_alnum", r"[0-9A-Za-z]", 20, 3.8, 3, 5, 9),
    EntropyClass("entropy_base64", r"[0-9A-Za-z+/_=-]", 24, 4.0, 3, 6, 10),
)

#: Spans that hold matches of one of these, and outside them nothing as long as a window, are no secrets.
ALLOW = (
    r"(?i)example|placeholder|changeme|dummy",
    r"(?i)0123456789abcdef|abcdefghijklmnop|1234567890",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[0-9]+(?:[-_/][0-9]+)+$",
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, in code points, ordered by start and kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def high_entropy(run: str, width: int, bits: float, digits: int, letters: int, changes: int) -> list[tuple[int, int]]:
    """Joined windows of the run whose Shannon entropy is high enough.

    With counts c of the characters in a window of w, the entropy is
    log2 w - sum(c log2 c) / w; moving on by one character changes two counts.
    """
    weight = [0.0, 0.0, *(c * math.log2(c) for c in range(2, width + 1))]
    top = math.log2(width)
    counts: dict[str, int] = {}
    total, n_digits, n_letters, n_changes, out = 0.0, 0, 0, 0, []
    turns = [a.isalpha() and b.isalpha() and a.isupper() != b.isupper() for a, b in itertools.pairwise(run)]
    for i, ch in enumerate(run):
        if i >= width:  # the oldest goes first, so that no count exceeds width
            old = run[i - width]
            c = counts[old]
            counts[old] = c - 1
            total += weight[c - 1] - weight[c]
            n_digits -= old.isdigit()
            n_letters -= old.isalpha()
            n_changes -= turns[i - width]
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += weight[c + 1] - weight[c]
        n_digits += ch.isdigit()
        n_letters += ch.isalpha()
        n_changes += i > 0 and turns[i - 1]
        if i >= width - 1 and n_digits * changes + n_changes * digits >= digits * changes and n_letters >= letters and top - total / width >= bits:
            start = i - width + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


class Scanner:
    """Finds spans in one text; holds compiled patterns."""

    def __init__(self, classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> None:
        self.classes = [(c, re.compile(f"{c.run}{{{c.width},}}")) for c in classes]
        self.allow = [re.compile(a) for a in allow]

    def spans(self, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """(base spans, all spans); an entropy span inside an earlier span adds nothing."""
        text = text or ""
        base = base_spans(text)
        every = list(base)
        for c, runs in self.classes:
            # ends[i]: how far the spans found so far reach that start at starts[i] or before
            starts = sorted({s for _, s, _ in every})
            reach = dict.fromkeys(starts, 0)
            for _, s, e in every:
                reach[s] = max(reach[s], e)
            ends = list(itertools.accumulate((reach[s] for s in starts), max))
            far = 0  # of this class's own spans, which come in order
            for run in runs.finditer(text):
                for a, b in high_entropy(run[0], c.width, c.bits, c.digits, c.letters, c.changes):
                    start, end = run.start() + a, run.start() + b
                    at = bisect.bisect_right(starts, start)
                    if end <= far or (at and end <= ends[at - 1]):
                        continue
                    if not self.allowed(text[start:end], c.width):
                        every.append((c.kind, start, end))
                        far = end
        return base, sorted(every, key=lambda s: (s[1], KINDS.index(s[0])))

    def allowed(self, span: str, width: int) -> bool:
        """Whether the allow list suppresses a span: one of it stands in the span, and what is left
        and right of it is too short to be a secret by itself."""
        for p in self.allow:
            at = 0
            for m in p.finditer(span):
                if m.start() - at >= width:
                    break
                at = m.end()
            if at and len(span) - at < width:
                return True
        return False


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mask: str = "[SECRET]") -> str:
    """The text with every span, or joined spans that overlap, replaced by mask."""
    out, at, last = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= last:
            out += [text[at:a], mask]
        last = max(last, b)
        at = last
    return "".join([*out, text[at:]])


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW, redacted: bool = True
) -> DataFrame:
    """One row for each row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy, redacted.

    Null texts count as empty; null ids and repeated rows keep their rows; other columns
    are not read; an empty table gives no row. redacted is the text with every span masked (null stays null); with
    redacted=False it is left out, so that no text comes back.
    """
    names = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy", *(["redacted"] if redacted else []))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        scanner = Scanner(classes, allow)
        for b in batches:
            out: dict[str, list] = {n: [] for n in names}
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                base, every = scanner.spans(text)
                kinds = [k for k, _, _ in base]
                row = (doc_id, *(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base))
                row = (*row, redact(text, every) if every else text) if redacted else row
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            yield out

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long" + ", redacted string" * redacted)


def without_secrets(docs: DataFrame) -> DataFrame:
    """The rows of documents with secrets masked and, where there is a column n_chars, that counted
    anew; no row goes. Null and empty texts stay as they are, and so does an empty table."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        scanner = Scanner()
        for b in batches:
            b["text"] = [redact(t, every) if t and (every := scanner.spans(t)[1]) else t for t in b["text"]]
            if "n_chars" in b:
                b["n_chars"] = [n if t is None else len(t) for t, n in zip(b["text"], b["n_chars"], strict=True)]
            yield b

    return map_arrow(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
