"""Toxicity by a weighted grammar of finite-state transducers over clauses.

A lexicon reads the letters of a word and says whether it is an insult, a threatening verb,
a target, a negation or a word of reported speech, and with what weight. Transducers that
read a clause's words from either end turn insults into directed, negated or reported ones;
they are composed into one machine for each direction. A clause is worth what the arcs of
its path and the words on it add up to, and a document what its clauses do.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import bounded_sample, drop_written, map_arrow, written

#: Documents that are learned from, as many of each label, and entries that the lexicon is chosen from.
SAMPLE, CANDIDATES = 3000, 4096
#: Letters of the stems that are tried, and documents that an entry must stand in.
STEMS, LEAST = range(3, 8), 3
#: Parts in which the lexicon and what clauses add up to are fitted crosswise.
FOLDS = 4
#: Words that a worker remembers.
REMEMBERED = 200_000

WORD, INSULT, THREAT, TARGET, NEGATION, REPORT = "word", "insult", "threat", "target", "negation", "report"
DIRECTED, THREATENED, NEGATED, REPORTED = "directed", "threatened", "negated", "reported"
SYMBOLS = (WORD, INSULT, THREAT, TARGET, NEGATION, REPORT, DIRECTED, THREATENED, NEGATED, REPORTED)
#: What a clause is scored by; a threat without a target is none.
SCORED = (INSULT, DIRECTED, THREATENED, NEGATED, REPORTED)

# Common words of English, German, French and Spanish.
SEEDS = {
    INSULT: "idiot idiots moron morons stupid scum loser losers worthless pathetic disgusting trash clown imbecile dumbass "
    "dummkopf vollidiot abschaum widerlich arschloch connard imbécile ordure débile idiota estúpido estúpida imbécil basura",
    THREAT: "kill murder stab shoot strangle hurt destroy umbringen töten erschlagen tuer frapper matar golpear",
    TARGET: "you your you're u yourself they he she him them dich du ihr euch sie toi vous tu tú ustedes te",
    NEGATION: "not never no don't isn't aren't nobody nicht kein keine nie pas jamais aucun nunca jamás",
    REPORT: "said says wrote writes claimed claims reported according quoted called sagte schrieb laut dit écrit selon dijo escribió según",
}
#: What seeds are worth that no labelled text speaks for or against.
SEED_WEIGHT = {INSULT: 2.0, THREAT: 3.0}

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\n]")
_BREAKS = frozenset(".!?;\n")


@dataclass(frozen=True)
class Transducer:
    """A deterministic machine that reads and writes one symbol at a time: arcs lead from (state,
    symbol read) to (next state, symbol written, weight). State 0 is where a clause begins."""

    arcs: dict[tuple[int, str], tuple[int, str, float]]

    def apply(self, symbols: Iterable[str]) -> tuple[list[str], list[float]]:
        state, out, weights = 0, [], []
        for s in symbols:
            state, written_, w = self.arcs[state, s]
            out.append(written_)
            weights.append(w)
        return out, weights


def after(mark: str, span: int | None, changes: dict[str, tuple[str, float]]) -> Transducer:
    """Within span symbols after mark (None: to the clause's end) symbols become others, at a weight;
    all else is passed on."""
    reach = span or 1  # a state for each number of symbols that the mark still reaches
    arcs = {}
    for left in range(reach + 1):
        for s in SYMBOLS:
            new, w = changes.get(s, (s, 0.0)) if left else (s, 0.0)
            rest = reach if s == mark else (left if span is None else max(0, left - 1))
            arcs[left, s] = (rest, new, w)
    return Transducer(arcs)


def compose(*machines: Transducer) -> Transducer:
    """One machine that does what the machines do one after the other: its states are tuples of
    theirs, numbered as they are reached, and its weights the sums of theirs."""
    start = (0,) * len(machines)
    number, todo, arcs = {start: 0}, [start], {}
    while todo:
        state = todo.pop()
        for s in SYMBOLS:
            symbol, weight, states = s, 0.0, []
            for m, q in zip(machines, state, strict=True):
                q, symbol, w = m.arcs[q, symbol]
                states.append(q)
                weight += w
            to = tuple(states)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            arcs[number[state], s] = (number[to], symbol, weight)
    return Transducer(arcs)


def _all(to: str, weight: float) -> dict[str, tuple[str, float]]:
    return {s: (to, weight) for s in (INSULT, DIRECTED, THREATENED)}


#: From right to left: "kill you", "stupid you", "idiot, he said".
RIGHT = compose(after(TARGET, 4, {THREAT: (THREATENED, 1.0)}), after(TARGET, 2, {INSULT: (DIRECTED, 1.0)}), after(REPORT, None, _all(REPORTED, -2.0)))
#: From left to right: "you are an idiot", "not an idiot", "they called it trash".
LEFT = compose(after(TARGET, 4, {INSULT: (DIRECTED, 1.0)}), after(NEGATION, 3, _all(NEGATED, -3.0)), after(REPORT, None, _all(REPORTED, -2.0)))


class Lexicon(dict):
    """word -> (symbol, weight), found by reading its letters through a tree. An entry that ends in
    * is a stem and counts for all words that go on from it; what a path passes adds up.

    As a dictionary it remembers words, up to a bound.
    """

    def __init__(self, entries: dict[str, tuple[str, float]]) -> None:
        super().__init__()
        self.root: dict = {}
        for text, (symbol, weight) in entries.items():
            node = self.root
            for ch in text.removesuffix("*"):
                node = node.setdefault(ch, {})
            node["stem" if text.endswith("*") else "word"] = (symbol, weight)

    def read(self, word: str) -> tuple[str, float]:
        node, symbol, total = self.root, WORD, 0.0
        for i, ch in enumerate(word):
            node = node.get(ch)
            if node is None:
                break
            ends = [node.get("stem"), node.get("word") if i == len(word) - 1 else None]
            for found in ends:
                if found:
                    symbol, total = found[0], total + found[1]
        return symbol, total

    def __missing__(self, word: str) -> tuple[str, float]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = self.read(word)
        return found


def seeds() -> dict[str, tuple[str, float]]:
    return {w: (symbol, SEED_WEIGHT.get(symbol, 0.0)) for symbol, words in SEEDS.items() for w in words.split()}


def clause_scores(symbols: list[str], weights: list[float]) -> dict[str, float]:
    """What each kind of match in a clause is worth: words plus the arcs of both machines."""
    back, a = RIGHT.apply(reversed(symbols))
    kinds, b = LEFT.apply(reversed(back))
    out: dict[str, float] = {}
    for kind, w, x, y in zip(kinds, weights, reversed(a), b, strict=True):
        if kind in SCORED:
            out[kind] = out.get(kind, 0.0) + w + x + y
    return out


N_FEATURES = 6


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Of a whole text: what its best clause is worth, and as logarithms of 1 + x what all clauses
    are worth in sum and for each 100 words, what is directed and what threatens, and how many
    clauses there are."""
    tokens = _TOKEN.findall((text or "").lower())
    read = [lexicon[t] for t in tokens]
    n_clauses = 1 + sum(t in _BREAKS for t in tokens)
    total = most = directed = threats = 0.0
    if any(s in (INSULT, THREAT) for s, _ in read):
        at = 0
        for i in [*(i for i, t in enumerate(tokens) if t in _BREAKS), len(tokens)]:
            clause, at = read[at:i], i + 1
            if any(s in (INSULT, THREAT) for s, _ in clause):
                found = clause_scores([s for s, _ in clause], [w for _, w in clause])
                worth = max(0.0, sum(found.values()))
                total, most = total + worth, max(most, worth)
                directed += max(0.0, found.get(DIRECTED, 0.0))
                threats += max(0.0, found.get(THREATENED, 0.0))
    words = max(1, len(tokens) - n_clauses + 1)
    return [most, *(math.log1p(x) for x in (total, 100 * total / words, directed, threats, n_clauses))]


@dataclass
class Grammar:
    """The lexicon's entries, and how the features of a document add up to its score."""

    entries: dict[str, tuple[str, float]] = field(default_factory=seeds)
    # without labels: a directed insult in a short text counts as toxic, a plain one does not
    weights: tuple[float, ...] = (1.0, 0.5, 0.3, 0.3, 0.3, -0.2)
    bias: float = -4.0

    def score(self, x: list[float]) -> float:
        z = self.bias + sum(w * v for w, v in zip(self.weights, x, strict=True))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _candidates(text: str | None) -> list[str]:
    """Words and stems of a text, each once."""
    words = {t for t in _TOKEN.findall((text or "").lower()) if t not in _BREAKS}
    return sorted(words | {w[:n] + "*" for w in words for n in STEMS if n <= len(w)})


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", sample: int = SAMPLE, candidates: int = CANDIDATES) -> Grammar:
    """A grammar from labelled rows of docs for which usable holds.

    About sample documents, as many of each label, are learned from (a hash of doc_id picks
    them; rows that share an id count once). Words and stems that stand in toxic documents more
    often than in others make the lexicon. What clauses add up to is fitted to the same
    documents in FOLDS parts, each read with the lexicon of the others. The driver sees which
    of at most candidates entries stand in which of those documents. Labels other than 0 and
    1 and null ids are ignored; without documents of both labels the fixed words count by
    their fixed weights.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ids = docs.where(usable).select("doc_id").distinct().join(known, "doc_id")
    total = {r.y: r.n for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return Grammar()
    chosen = written(bounded_sample(ids, "y", "doc_id", sample).select("doc_id", "y"))
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about sample ids, so texts stay where they are
    fold = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    texts = written(picked.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("y", "text", fold))
    *parts, whole = _lexicons(texts, candidates)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        lexicons = [Lexicon(p) for p in parts]
        for b in batches:
            yield {"y": b["y"], "x": [features(t, lexicons[f]) for t, f in zip(b["text"], b["fold"], strict=True)]}

    got = map_arrow(texts, run, "y int, x array<double>").collect()
    drop_written(texts)
    drop_written(chosen)
    y, x = np.array([r.y for r in got], dtype=float), np.array([r.x for r in got], dtype=float).reshape(-1, N_FEATURES)
    if len(set(y.tolist())) < 2:
        return Grammar(whole)
    share = np.where(y == 1, total[1] / (total[0] + total[1]) / y.mean(), total[0] / (total[0] + total[1]) / (1 - y.mean()))
    order = np.lexsort((*x.T, y))  # the same sums on every run
    w = _fit(x[order], y[order], share[order], np.array([*Grammar.weights, Grammar.bias]))
    return Grammar(whole, tuple(w[:-1].tolist()), float(w[-1]))


def _lexicons(texts: DataFrame, candidates: int) -> list[dict[str, tuple[str, float]]]:
    """Entries with weights: from all parts but one, for each part, and from all. What speaks for a
    toxic document comes on top of what the fixed words are worth."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"y": b["y"], "fold": b["fold"], "entries": [_candidates(t) for t in b["text"]]}

    held = written(map_arrow(texts, run, "y int, fold int, entries array<string>"))
    n = {r.y: r.n for r in held.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        drop_written(held)
        return [seeds()] * (FOLDS + 1)
    a, b = F.col("toxic") / n[1], F.col("clean") / n[0]
    both = (F.col("toxic") + F.col("clean")) / (n[0] + n[1])
    gain = F.col("toxic") * F.log(a / both) + F.when(F.col("clean") > 0, F.col("clean") * F.log(b / both)).otherwise(0.0)
    counts = held.select("y", F.explode("entries").alias("entry")).groupBy("entry").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    best = counts.where((F.col("toxic") >= LEAST) & (a > 2 * b)).orderBy(gain.desc(), "entry").limit(candidates)
    names = _longest({r.entry: (r.toxic, r.clean) for r in best.collect()})
    fixed = {w: v for w, (s, v) in seeds().items() if s == INSULT}
    place = {e: i for i, e in enumerate([*names, *(w for w in fixed if w not in set(names))])}

    def pairs(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"y": b["y"], "fold": b["fold"], "at": [[place[e] for e in es if e in place] for es in b["entries"]]}

    rows = sorted(map_arrow(held, pairs, "y int, fold int, at array<int>").collect(), key=lambda r: (r.fold, r.y, r.at))
    drop_written(held)
    base = np.array([fixed.get(e, 0.0) for e in place])
    out = []
    for left_out in [*range(FOLDS), None]:
        mine = [r for r in rows if r.fold != left_out]
        doc = np.repeat(np.arange(len(mine)), [len(r["at"]) for r in mine])
        entry = np.array([i for r in mine for i in r["at"]], dtype=np.int64)
        w = base + (_sparse(doc, entry, np.array([r.y for r in mine], dtype=float), base) if len(entry) else 0.0)
        out.append(seeds() | {e: (INSULT, float(v)) for e, v in zip(place, w, strict=True) if v > 0.05})
    return out


def _longest(counts: dict[str, tuple[int, int]]) -> list[str]:
    """Entries without the stems that stand in no other documents than a longer stem or word does."""
    order, out = sorted(counts), []
    for i, e in enumerate(order):  # what goes on from a stem comes right after it
        stem = e.removesuffix("*")
        longer = itertools.takewhile(lambda x, stem=stem: x.startswith(stem), order[i + 1 :]) if e != stem else ()
        if counts.get(stem) != counts[e] or e == stem:
            if not any(counts[x] == counts[e] for x in longer):
                out.append(e)
    return out


def _sparse(doc: np.ndarray, entry: np.ndarray, y: np.ndarray, base: np.ndarray, penalty: float = 1.0, steps: int = 300) -> np.ndarray:
    """What entries are worth on top of base, none below 0, by a logistic model of which documents
    are toxic, held small by a penalty on their sum: accelerated projected gradient. Entries
    that only go along with others get none."""
    n = len(base)
    v = np.ones(n)
    for _ in range(30):  # the largest stretch of the entries' incidence, for the length of a step
        v = np.bincount(entry, weights=np.bincount(doc, weights=v[entry], minlength=len(y))[doc], minlength=n)
        norm = float(np.linalg.norm(v))
        v /= norm
    step = 1 / (0.3 * (norm + len(y)))
    w = ahead = np.zeros(n)
    bias = bias_ahead = 0.0
    for k in range(steps):
        z = np.bincount(doc, weights=(base + ahead)[entry], minlength=len(y)) + bias_ahead
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        new = np.maximum(0.0, ahead - step * (np.bincount(entry, weights=miss[doc], minlength=n) + penalty))
        new_bias = bias_ahead - step * miss.sum()
        momentum = k / (k + 3)
        ahead, bias_ahead = new + momentum * (new - w), new_bias + momentum * (new_bias - bias)
        w, bias = new, new_bias
    return w


def _fit(x: np.ndarray, y: np.ndarray, share: np.ndarray, prior: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic weights (the last one is the bias) near prior, by Newton steps; rows count by share."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + ridge * (w - prior)
        curve = (x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w = w - move * min(1.0, 2.0 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row: whole texts, null as empty. Null ids and repeated rows
    keep their rows, equal texts have equal scores, an empty table gives none; other columns are not read."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        lexicon = Lexicon(grammar.entries)
        for b in batches:
            yield {"doc_id": b["doc_id"], "score": [grammar.score(features(t, lexicon)) for t in b["text"]]}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
