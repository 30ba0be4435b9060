"""Ranked lexical search over shards: MaxScore.

A shard is one row: the postings of a bounded stretch of documents. In every shard a query's
terms are ordered by the most they can add to a score. While the terms at the lower end
cannot lift a document over the query's threshold by themselves they are non-essential: only
the postings of the other, essential terms bring documents up, and non-essential postings
are probed from the strongest on, for documents that can still qualify.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.llm.common import drop_written, map_arrow, written

#: Postings, documents and bytes of text at which a shard is closed.
POSTINGS, DOCUMENTS, BYTES = 1 << 20, 1 << 15, 1 << 28
#: Rows (item, term) of the queries that one pass over the texts serves.
BLOCK = 1 << 17
#: Documents that are looked at together in a shard.
WINDOW = 4096
#: Parts of an item's candidates before they come together.
SALT = 64

# A term's characters are ASCII letters and digits and all beyond ASCII; A-Z count as a-z.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_SHARD = "n_docs long, n_terms long, ids array<long>, lengths array<int>, terms array<string>, sizes array<int>, docs binary, counts binary"


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, in order and with repeats. Null and empty texts have none."""
    return (text or b"").translate(_TERMS).split()


def build_shards(docs: DataFrame, terms: set[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each shard: n_docs and n_terms (documents with a term, and terms with repeats,
    of the whole stretch), ids and lengths of the documents that have a posting, terms with the
    sizes of their lists, and all lists end to end as 32-bit numbers: places in ids, and counts.

    With terms, a set of bounded size, only their postings are kept. Documents of a shard are
    in order of their ids, nulls last.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        known: dict[bytes, int] | None = None if terms is None else {t.encode(): i for i, t in enumerate(sorted(terms))}
        shard = _Open(known)
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                if shard.full():
                    yield shard.row()
                    shard = _Open(known)
                shard.add(doc_id, text)
        yield shard.row()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_arrow(rows, run, _SHARD)


class _Open:
    """A shard that still takes documents."""

    def __init__(self, known: dict[bytes, int] | None) -> None:
        self.known, self.names = known, {} if known is None else known
        self.n_docs = self.n_terms = self.postings = self.bytes = 0
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def full(self) -> bool:
        return self.postings >= POSTINGS or len(self.ids) >= DOCUMENTS or self.bytes >= BYTES

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        words = terms_of(text)
        if not words:
            return
        self.n_docs += 1
        self.n_terms += len(words)
        self.bytes += len(text)
        if self.known is None:
            for w in words:
                self.names.setdefault(w, len(self.names))
        at = self.names
        mine, counts = np.unique(np.array([at[w] for w in words if w in at], dtype=np.int32), return_counts=True)
        if len(mine):
            self.ids.append(doc_id)
            self.lengths.append(len(words))
            self.parts.append((mine, counts.astype(np.int32)))
            self.postings += len(mine)

    def row(self) -> dict:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0, self.lengths[i]))
        parts = [self.parts[i] for i in order]
        term = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int32)
        doc = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[0]) for p in parts])
        count = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int32)
        by_term = np.argsort(term, kind="stable")
        used, sizes = np.unique(term, return_counts=True)
        names = list(self.names)
        row = {
            "n_docs": self.n_docs, "n_terms": self.n_terms, "ids": [self.ids[i] for i in order], "lengths": [self.lengths[i] for i in order],
            "terms": [names[i].decode("utf-8", "replace") for i in used.tolist()], "sizes": sizes.tolist(),
            "docs": doc[by_term].astype("<i4").tobytes(), "counts": count[by_term].astype("<i4").tobytes(),
        }
        return {k: [v] for k, v in row.items()}


def weight(n_docs: int, df: int) -> int:
    """What a term that df of n_docs documents hold is worth."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def parts_of_score(count: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A posting's part of a score before its term's weight, in whole numbers."""
    c = count.astype(np.int64)
    m = 75 + (25 * length.astype(np.int64) * n_docs) // n_terms
    return (1_000_000_000 * c) // (1000 * c + 12 * m)


@dataclass
class Query:
    """An item's terms with weight times repeats, and its k best documents so far."""

    weights: dict[str, int]
    k: int

    def __post_init__(self) -> None:
        self.best: list[tuple[int, bool, int]] = []  # a heap of (score, id is known, -id): the worst first

    @property
    def threshold(self) -> int:
        """What a document has to reach to matter: the k-th best score, which an earlier id may equal."""
        return self.best[0][0] if len(self.best) == self.k else 1

    def offer(self, score: int, doc_id: int | None) -> None:
        entry = (score, doc_id is not None, -(doc_id or 0))
        if len(self.best) < self.k:
            heapq.heappush(self.best, entry)
        elif entry > self.best[0]:
            heapq.heapreplace(self.best, entry)


class Shard:
    """A shard's lists, with the part of a score of each posting."""

    def __init__(self, row: dict, n_docs: int, n_terms: int) -> None:
        self.ids = row["ids"]
        docs, counts = np.frombuffer(row["docs"], "<i4"), np.frombuffer(row["counts"], "<i4")
        parts = parts_of_score(counts, np.array(row["lengths"], dtype=np.int64)[docs], n_docs, n_terms)
        ends = np.cumsum(row["sizes"])
        self.lists = {t: (docs[z - n : z], parts[z - n : z]) for t, n, z in zip(row["terms"], row["sizes"], ends.tolist(), strict=True)}
        self.most = {t: int(p.max()) for t, (_, p) in self.lists.items()}
        self.probes = 0

    def search(self, q: Query) -> None:
        """Offer q every document of the shard that can be among its best."""
        terms = sorted((self.most[t] * w, t) for t, w in q.weights.items() if w > 0 and t in self.lists)
        if not terms:
            return
        upper = [u for u, _ in terms]
        below = np.concatenate([[0], np.cumsum(upper)]).tolist()  # the most that all weaker terms add together
        if below[-1] < q.threshold:
            return
        lists = [(*self.lists[t], q.weights[t]) for _, t in terms]
        n = len(self.ids)
        for lo in range(0, n, WINDOW):
            hi = min(n, lo + WINDOW)
            if below[-1] < q.threshold:
                return  # no document can qualify any more
            first = next(i for i in range(len(terms)) if below[i + 1] >= q.threshold)
            score = np.zeros(hi - lo, dtype=np.int64)
            for docs, parts, w in lists[first:]:  # essential lists
                a, z = np.searchsorted(docs, (lo, hi))
                score[docs[a:z] - lo] += parts[a:z] * w
            near = np.flatnonzero(score)
            for i in range(first - 1, -1, -1):  # non-essential ones, the strongest first
                near = near[score[near] + below[i + 1] >= q.threshold]
                if not len(near):
                    break
                docs, parts, w = lists[i]
                at = np.searchsorted(docs, near + lo)
                self.probes += len(near)
                hit = at < len(docs)
                hit[hit] = docs[at[hit]] == near[hit] + lo
                score[near[hit]] += parts[at[hit]] * w
            near = near[score[near] >= q.threshold]
            if len(near) > q.k:  # ties at the k-th score all stay: an id decides
                near = near[score[near] >= np.partition(score[near], -q.k)[-q.k]]
            for i in near.tolist():
                if score[i] >= q.threshold:
                    q.offer(int(score[i]), self.ids[lo + i])


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term, repeats. Rows that share an id (or have none) are one item with all their terms."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    rows = items.select(F.col(id_col).alias("item_id"), F.explode(terms).alias("term"))
    return rows.groupBy("item_id", "term").agg(F.count("*").alias("repeats"))


def rank(docs: DataFrame, items: DataFrame, k: int = 20, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0.

    Items are served in blocks of about BLOCK terms, one pass over the texts for each; one
    item's terms are always together. The terms of a block are what reaches the driver and
    the tasks besides texts. Tasks keep k documents for each item over all their shards.

    Null and empty texts, and texts without a term, take no part; items without a term have
    no row, and neither has anything if a table is empty. Equal scores go by ascending id, a
    null id last. Rows of docs that share an id are ranked each by itself. Other columns are not read.
    """
    wanted = written(item_terms(items, item_id, item_text))
    blocks = max(1, math.ceil(wanted.count() / BLOCK))
    out = None
    for block in range(blocks):
        mine: dict = {}
        for r in wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toLocalIterator():
            mine.setdefault(r.item_id, {})[r.term] = r.repeats
        part = written(_ranked(docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")), mine, k, wanted.schema["item_id"].dataType.simpleString()))
        out = part if out is None else out.unionByName(part)
    drop_written(wanted)
    return out


def _ranked(docs: DataFrame, items: dict, k: int, kind: str) -> DataFrame:
    spark = docs.sparkSession
    terms = {t for weights in items.values() for t in weights}
    shards = written(build_shards(docs, terms))
    n_docs, n_terms = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    lists = shards.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x"))
    df = {r["term"]: r["df"] for r in lists.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.sizes").alias("df")).toLocalIterator()}
    worth = {t: weight(n_docs, n) for t, n in df.items()}
    queries = spark.sparkContext.broadcast({i: {t: worth[t] * n for t, n in weights.items() if t in worth} for i, weights in items.items()})

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        mine = {i: Query(w, k) for i, w in queries.value.items()}
        for b in batches:
            for values in zip(*b.values(), strict=True):
                shard = Shard(dict(zip(b, values, strict=True)), n_docs, n_terms)
                for q in mine.values():
                    shard.search(q)
        found = [(i, -neg if known else None, score) for i, q in mine.items() for score, known, neg in q.best]
        for at in range(0, len(found), 1 << 16):
            rows = found[at : at + (1 << 16)]
            yield {"item_id": [r[0] for r in rows], "doc_id": [r[1] for r in rows], "score": [r[2] for r in rows]}

    best = map_arrow(shards.where(F.size("ids") > 0), run, f"item_id {kind}, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = best.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
    some = salted.withColumn("rank", F.row_number().over(W.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= k).drop("salt")
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
