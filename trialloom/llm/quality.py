"""Document quality from a linear-chain conditional random field over lines.

Every line gets a label, good or bad. A line's own features and those of the lines next
to it give its score; a 2 x 2 table scores neighbouring labels. The quality of a document
is the mean, weighted by line length, of the marginal probabilities that its lines are
good. A text is read in blocks of lines; of each line only a few numbers are kept.

Labels mark whole documents, so a field that learned from them as they are would never
see a label change and would judge all lines of a document alike. Therefore chains are
spliced for training: a few lines of a bad document go between the lines of a good one
and the other way round, each line under the label of the document that it came from. A
bad document has good lines too. So line labels are hidden: the field is fitted in turns
with the labels that it finds itself, given that a document's label holds for most lines.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import bounded_sample, map_arrow, written

#: Bounds of the training data: documents, lines in a stretch, and stretches of each document.
SAMPLE, STRETCH, STRETCHES = 3000, 64, 4
#: Of the stretches, how many are spliced, and lines at most that come from another document.
SPLICED, GRAFT = 0.7, 4
#: Turns of fitting, and how likely a document's label is taken to be wrong for a line.
TURNS, WRONG = 3, 0.2
#: Characters of a text read at once (on to the end of the line), and lines measured at once.
CHUNK, BLOCK = 1 << 20, 20_000

_KIND = np.full(256, 7, dtype=np.uint8)  # other punctuation
_KIND[[*range(97, 123), *range(128, 256)]] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[9, 11, 12, 13, 32]] = 3
_KIND[ord("!")] = 4
_KIND[[ord(c) for c in "#$%&*<>=\\^~{}[]@_+"]] = 5
_KIND[ord("|")] = 6
N_KINDS = 8
N_OWN = 15
N_FEATURES = 3 * N_OWN + 2


def line_features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line by itself, lengths in bytes) for the lines of many documents."""
    raw = [x.encode("utf-8", "surrogatepass") for x in lines]
    length = np.array([len(r) for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(r + b"\n" for r in raw), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    kinds = _KIND[data]
    kinds[starts + length] = 255  # the line ends count as nothing
    own = np.zeros((len(lines), N_OWN))
    size = np.maximum(length, 1)
    for k in range(N_KINDS):
        own[:, k] = np.add.reduceat((kinds == k).astype(np.int64), starts) / size
    letters = own[:, 0] + own[:, 1]
    own[:, 1] /= np.maximum(letters, 1e-9)
    words = np.zeros((len(lines), 4))
    for i, r in enumerate(raw):
        w = r.split()
        n = len(w)
        if n:
            words[i] = n, len(set(w)) / n, sum(map(eq, w, w[1:])) / n, w[-1][-1] in b".!?:;\"')"
    own[:, 8] = np.log1p(length) / 8
    own[:, 9] = np.log1p(words[:, 0]) / 6
    own[:, 10] = np.where(words[:, 0] > 3, 1 - words[:, 1], 0)
    own[:, 11] = words[:, 2]
    own[:, 12] = words[:, 3]
    own[:, 13] = np.minimum(length / np.maximum(words[:, 0], 1), 20) / 20
    own[:, 14] = length == 0
    return own, length


def with_neighbours(own: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Features of each line: its own, the line's before and the line's after, and whether it has either."""
    n = len(own)
    out = np.zeros((n, N_FEATURES))
    out[:, :N_OWN] = own
    inner = ~first
    out[inner, N_OWN : 2 * N_OWN] = own[np.flatnonzero(inner) - 1]
    inner = ~last
    out[inner, 2 * N_OWN : 3 * N_OWN] = own[np.flatnonzero(inner) + 1]
    out[:, -2], out[:, -1] = first, last
    return out


@dataclass
class Field:
    """weights and bias of the score of label good against bad; pair[i][j] scores label j after i."""

    weights: np.ndarray
    bias: float
    pair: np.ndarray

    def marginals(self, scores: Sequence[float]) -> array:
        """P(good) of each line of one chain, by forward-backward on log odds."""
        (a00, a01), (a10, a11) = np.exp(self.pair - self.pair.max()).tolist()
        scores = array("d", scores)
        n, exp, log = len(scores), math.exp, math.log
        ahead = array("d", bytes(8 * n))
        odds = 0.0
        for t in range(n):
            if t:
                e = exp(max(-500.0, min(500.0, odds)))
                odds = log((a01 + e * a11) / (a00 + e * a10))
            odds += scores[t]
            ahead[t] = odds
        back, out = 0.0, array("d", bytes(8 * n))
        for t in range(n - 1, -1, -1):
            z = max(-500.0, min(500.0, ahead[t] + back))
            out[t] = 1 / (1 + exp(-z))
            e = exp(max(-500.0, min(500.0, scores[t] + back)))
            back = log((a10 + e * a11) / (a00 + e * a01))
        return out


def fit(x: np.ndarray, y: np.ndarray, chain: np.ndarray, l2: float = 3e-4, context: float = 200.0, steps: int = 300) -> Field:
    """Maximum conditional likelihood by Adam. y holds labels or P(good); chain numbers the chains,
    equal for lines of one chain, which stand together; all chains take a step in time at once.
    What comes from neighbours is held context times as close to 0 as a line's own features."""
    n, d = x.shape
    starts = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]])
    lengths = np.diff(np.r_[starts, n])
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    longest = int(lengths[0])
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(longest)]  # chains longer than t
    w, b, pair = np.zeros(d), 0.0, np.zeros((2, 2))
    theta = np.zeros(d + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.ones(n, dtype=bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    before, after = (np.stack([1 - y[i], y[i]]) for i in (at - 1, at))
    seen = before @ after.T
    pull = x.T @ y
    held = l2 * np.where(np.arange(d) < N_OWN, 1.0, context)
    for step in range(1, steps + 1):
        w, b, pair = theta[:d], theta[d], theta[d + 1 :].reshape(2, 2)
        s = x @ w + b
        f = np.zeros((n, 2))
        f[starts, 1] = s[starts]
        for t in range(1, longest):
            i = starts[: active[t]] + t
            f[i] = np.logaddexp(f[i - 1, :1] + pair[0], f[i - 1, 1:] + pair[1])
            f[i, 1] += s[i]
        g = np.zeros((n, 2))
        for t in range(longest - 2, -1, -1):
            i = starts[: active[t + 1]] + t
            ahead = g[i + 1] + np.stack([np.zeros(len(i)), s[i + 1]], axis=1)
            g[i] = np.logaddexp(ahead[:, :1] + pair[:, 0], ahead[:, 1:] + pair[:, 1])
        z = np.logaddexp(*(f + g).T)
        p = np.exp(f[:, 1] + g[:, 1] - z)
        q = np.exp(f[at - 1][:, :, None] + pair + (g[at] + np.stack([np.zeros(len(at)), s[at]], axis=1))[:, None, :] - z[at][:, None, None]).sum(axis=0) if len(at) else np.zeros((2, 2))
        grad = np.concatenate([(x.T @ p - pull) / n + held * w, [(p - y).mean()], ((q - seen) / n + l2 * context * pair).ravel()])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(theta[:d].copy(), float(theta[d]), theta[d + 1 :].reshape(2, 2).copy())


def _chunks(text: str) -> Iterator[list[str]]:
    """The lines of a text, some at a time; a text has one line at least."""
    at = 0
    while True:
        end = text.find("\n", at + CHUNK)
        yield text[at:].split("\n") if end < 0 else text[at:end].split("\n")
        if end < 0:
            return
        at = end + 1


def _measured(texts: list[str | None], keep) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keep(own features), lengths in bytes, number of lines of each text) for all lines of texts;
    lines are measured in blocks, so that keep bounds what a long text needs."""
    held: list[str] = []
    kept, lengths, counts = [], [], np.zeros(len(texts), dtype=np.int64)

    def measure() -> None:
        own, length = line_features(held)
        kept.append(keep(own))
        lengths.append(length)
        held.clear()

    for i, text in enumerate(texts):
        for lines in _chunks(text or ""):
            counts[i] += len(lines)
            held += lines
            if len(held) >= BLOCK:
                measure()
    if held:
        measure()
    return np.concatenate(kept), np.concatenate(lengths), counts


def _ends(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line is its text's first, and its last."""
    last = np.cumsum(counts)
    first = np.zeros(int(last[-1]), dtype=bool)
    first[last - counts] = True
    end = np.zeros(len(first), dtype=bool)
    end[last - 1] = True
    return first, end


def spliced(parts: list[np.ndarray], lines: list[np.ndarray], y: np.ndarray, seed: int = 5) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(own features, P(good) of lines) of chains: a part of a text as it is, or with lines of a
    part of the other label put in between. parts hold the own features of lines, lines their
    labels so far, y the labels of their texts."""
    rng = np.random.default_rng(seed)
    by = [np.flatnonzero(y == v) for v in (0, 1)]
    chains, labels = [], []
    for part, label, v in zip(parts, lines, y, strict=True):
        others = by[1 - v]
        if rng.random() < SPLICED and len(others):
            other = others[rng.integers(len(others))]
            n = int(rng.integers(1, min(GRAFT, len(parts[other])) + 1))
            a, at = int(rng.integers(len(parts[other]) - n + 1)), int(rng.integers(len(part) + 1))
            part = np.concatenate([part[:at], parts[other][a : a + n], part[at:]])
            label = np.concatenate([label[:at], lines[other][a : a + n], label[at:]])
        chains.append(part)
        labels.append(label)
    return chains, labels


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", sample: int = SAMPLE, stretch: int = STRETCH, stretches: int = STRETCHES) -> Field:
    """A field from labelled rows of docs for which usable holds.

    At most about sample documents (a hash of doc_id picks them; of rows that share an id one)
    and of each at most stretches parts of stretch lines go to the driver: 60 bytes a line,
    with the given ones 46 MB in all, and some 400 MB while the field is fitted. Labels other than 0 and 1 and null ids are ignored;
    without rows of both labels every score is 0.5.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    ids = docs.where(usable).select("doc_id").distinct().join(known, "doc_id").withColumn("all", F.lit(1))
    chosen = written(bounded_sample(ids, "all", "doc_id", sample).select("doc_id", "y"))
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about sample rows, so texts stay where they are
    once = picked.groupBy("doc_id").agg(F.min_by(F.struct("text", "y"), F.xxhash64("text")).alias("d")).select("d.text", "d.y")  # summed where the texts are

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for y, text in zip(b["y"], b["text"], strict=True):
                own, _, (n,) = _measured([text], lambda x: x.astype("<f4"))
                parts = [own[k * stretch : (k + 1) * stretch] for k in np.unique(np.linspace(0, (n - 1) // stretch, stretches).astype(int))]
                yield {"y": [y] * len(parts), "x": [p.tobytes() for p in parts]}

    got = map_arrow(once.select("text", "y"), run, "y long, x binary").toPandas()
    if got["y"].nunique() < 2:
        return Field(np.zeros(N_FEATURES), 0.0, np.zeros((2, 2)))
    got = got.iloc[np.lexsort((got["x"].map(zlib.crc32), got["x"].map(len)))]  # the same order on every run
    parts = [np.frombuffer(r, dtype="<f4").reshape(-1, N_OWN).astype(np.float64) for r in got["x"]]
    y = got["y"].to_numpy()
    lines = [np.full(len(p), float(v)) for p, v in zip(parts, y, strict=True)]
    for turn in range(TURNS):
        chains, labels_ = spliced(parts, lines, y)
        counts = np.array([len(c) for c in chains])
        x = with_neighbours(np.concatenate(chains), *_ends(counts))
        steps = 300 if turn == TURNS - 1 else 120
        field = fit(x, np.concatenate(labels_), np.repeat(np.arange(len(chains)), counts), steps=steps)
        if turn < TURNS - 1:
            lines = _revised(field, parts, y)
    return field


def _revised(field: Field, parts: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
    """P(good) of the lines of each part, under the field and the label of its document."""
    counts = np.array([len(p) for p in parts])
    s = with_neighbours(np.concatenate(parts), *_ends(counts)) @ field.weights + field.bias
    known = math.log((1 - WRONG) / WRONG)
    cuts = np.cumsum(counts)
    return [np.array(field.marginals(s[z - n : z] + (known if v else -known))) for n, z, v in zip(counts, cuts, y, strict=True)]


def line_scores(texts: list[str | None], field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score of label good for each line, lengths, lines of each text). Of a line's features only
    what they add to its own score, to the next line's and to the last one's is kept."""
    w = field.weights[: 3 * N_OWN].reshape(3, N_OWN).T
    adds, length, counts = _measured(texts, lambda own: own @ w)
    first, last = _ends(counts)
    s = adds[:, 0] + field.bias + first * field.weights[-2] + last * field.weights[-1]
    s[1:] += np.where(first[1:], 0.0, adds[:-1, 1])
    s[:-1] += np.where(last[:-1], 0.0, adds[1:, 2])
    return s, length, counts


def scores(texts: list[str | None], field: Field) -> list[float]:
    """Quality of each text: its lines' marginals weighted by length, the plain mean if all are empty."""
    s, length, counts = line_scores(texts, field)
    out, at = [], 0
    for n in counts.tolist():
        p, weight = np.array(field.marginals(s[at : at + n])), length[at : at + n]
        total = int(weight.sum())
        mean = float(p @ weight) / total if total else float(p.mean())
        out.append(min(1.0, max(0.0, mean)))
        at += n
    return out


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row: whole texts, null as empty. Null ids and repeated rows
    keep their rows, equal texts have equal scores, no rows give none; other columns are not read."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "score": scores(b["text"], field)}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def good_documents(docs: DataFrame, field: Field, least: float = 0.7) -> DataFrame:
    """The rows of docs, unchanged, whose score reaches least."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            stays = [i for i, s in enumerate(scores(b["text"], field)) if s >= least]
            yield {c: [values[i] for i in stays] for c, values in b.items()}

    return map_arrow(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
