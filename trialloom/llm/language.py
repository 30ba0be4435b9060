"""Language identification: the family first, then duels within the family.

Features are hashed character n-grams of the whole text. Linear support vector machines
separate families one against one, and then the languages of the winning family one
against one; most duels won wins, the sum of margins breaks ties.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import bounded_sample, map_arrow

#: Features, and documents that the machines learn from, as many of each language.
SIZE, SAMPLE = 1 << 14, 1600

# Language families by ISO 639 code. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt ro rm sc wa",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tk tr tt ug uz",
    "semitic": "am ar he mt ti",
    "indo-iranian": "bn fa gu hi ku mr ne pa ps sa sd si tg ur",
    "dravidian": "kn ml ta te",
    "sinitic": "yue zh",
    "austronesian": "fil id jv mg mi ms su tl",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = regex.compile(r"\p{L}")
#: Bytes that are neither ASCII letters nor part of other characters become blanks.
_PLAIN = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def family(code: str) -> str:
    return _FAMILY.get(code.lower().split("-")[0].split("_")[0], code)


def features(texts: list[str | None]) -> np.ndarray:
    """A row of unit length for each text: roots of the counts of its hashed 1- to 4-grams of bytes.

    A row of a text without letters is zero.
    """
    out = np.zeros((len(texts), SIZE), dtype=np.float32)
    for row, text in zip(out, texts, strict=True):
        words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()
        for at in range(0, len(words), 1 << 16):  # memory does not follow the length of a text
            x = np.frombuffer(b" " + b" ".join(words[at : at + (1 << 16)]) + b" ", dtype=np.uint8).astype(np.uint32)
            gram = x
            for n in range(1, 5):
                if n > 1:
                    gram = gram[:-1] * np.uint32(257) + x[n - 1 :]
                mixed = (gram + np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)
                row += np.bincount(mixed >> np.uint32(32 - 14), minlength=SIZE)
    np.sqrt(out, out=out)
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    out /= np.maximum(norm, 1e-12)[:, None]
    return out


def fit_duel(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge loss, y in {-1, 1}, by dual
    coordinate ascent; both sides weigh the same in sum."""
    n = len(y)
    x = np.concatenate([x, np.ones((n, 1), dtype=np.float32)], axis=1)
    cost = np.where(y > 0, c * n / (2 * max(1, (y > 0).sum())), c * n / (2 * max(1, (y < 0).sum())))
    diag = 0.5 / cost
    q = np.einsum("ij,ij->i", x, x) + diag
    alpha, w = np.zeros(n), np.zeros(x.shape[1], dtype=np.float32)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(n):
            grad = y[i] * float(x[i] @ w) - 1 + diag[i] * alpha[i]
            new = max(0.0, alpha[i] - grad / q[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


@dataclass
class Duels:
    """One-against-one machines among classes."""

    classes: list[str]
    weights: np.ndarray  # a row for each pair of classes, bias last

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> Duels:
        classes = sorted(set(labels.tolist()))
        rows = []
        for a, b in combinations(classes, 2):
            use = np.flatnonzero((labels == a) | (labels == b))
            rows.append(fit_duel(x[use], np.where(labels[use] == a, 1.0, -1.0)))
        return cls(classes, np.array(rows, dtype=np.float32).reshape(len(rows), x.shape[1] + 1))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the winner, its share: the least probability over its duels)."""
        k = len(self.classes)
        if k == 1:
            return np.zeros(len(x), dtype=int), np.ones(len(x))
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        won, total, least = np.zeros((len(x), k)), np.zeros((len(x), k)), np.ones((len(x), k))
        for j, (a, b) in enumerate(combinations(range(k), 2)):
            m = margins[:, j].astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(3 * m, -50, 50)))
            won[:, a] += m >= 0
            won[:, b] += m < 0
            total[:, a] += m
            total[:, b] -= m
            least[:, a] = np.minimum(least[:, a], p)
            least[:, b] = np.minimum(least[:, b], 1 - p)
        best = (won + 1e-3 * np.tanh(total)).argmax(axis=1)
        return best, least[np.arange(len(x)), best]


@dataclass
class Model:
    families: Duels
    members: list[Duels]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        x = features(texts)
        group, sure = self.families.predict(x)
        lang, score = [""] * len(texts), sure.copy()
        for g in set(group.tolist()):
            at = np.flatnonzero(group == g)
            best, p = self.members[g].predict(x[at])
            score[at] *= p
            for i, b in zip(at, best, strict=True):
                lang[i] = self.members[g].classes[b]
        for i, text in enumerate(texts):
            if not text or not _LETTER.search(text):
                lang[i], score[i] = "und", 0.0
        return lang, score.tolist()


def train(docs: DataFrame, usable: Column, sample: int = SAMPLE) -> Model | None:
    """Machines from the rows of docs with a language for which usable holds; None if there are none.

    About sample rows, shared out evenly among the languages and picked by a hash of
    doc_id and text, go to the driver, where they take 64 kB each. Rows that are the same
    in both and in language count once, so neither an id nor a text that very many rows
    share brings more.
    """
    rows = docs.where(usable).select("doc_id", "text", "lang").where("text is not null")
    picked = bounded_sample(rows, "lang", ["doc_id", "text"], sample).dropDuplicates(["doc_id", "text", "lang"])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            x = features(b["text"])
            at = [np.flatnonzero(r) for r in x]
            yield {"doc_id": b["doc_id"], "lang": b["lang"], "at": [a.astype("<u2").tobytes() for a in at], "value": [r[a].astype("<f4").tobytes() for r, a in zip(x, at, strict=True)]}

    got = map_arrow(picked, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, at binary, value binary").toPandas()
    if got.empty:
        return None
    got = got.sort_values(["lang", "doc_id", "at"], ignore_index=True)
    x = np.zeros((len(got), SIZE), dtype=np.float32)
    for row, at, value in zip(x, got["at"], got["value"], strict=True):
        row[np.frombuffer(at, dtype="<u2")] = np.frombuffer(value, dtype="<f4")
    langs = got["lang"].to_numpy(dtype=object)
    groups = np.array([family(code) for code in langs], dtype=object)
    top = Duels.fit(x, groups)
    return Model(top, [Duels.fit(x[groups == g], langs[groups == g]) for g in top.classes])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row: whole texts; `und` with score 0 where the text
    is null or has no letter, or where there was nothing to learn from. Of languages with as
    many duels won the one with the larger sum of margins wins, then the first by name. Null ids and
    repeated rows keep their rows, no rows give none; other columns are not read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # a row of weights for each pair of classes

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            n = len(b["text"])
            lang, score = held.value.predict(b["text"]) if held.value else (["und"] * n, [0.0] * n)
            yield {"doc_id": b["doc_id"], "lang_pred": lang, "score": score}

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
