"""Packing documents into fixed token windows by best-fit decreasing.

Tokens are counted in tasks; packing needs lengths only. A document of n tokens is cut
into n // window full windows and a rest, and each full window is a sequence of its own.
The rests are at most window - 1 long, so the corpus enters best-fit decreasing as a
histogram of at most window lengths, whatever its size. Equal rests and equally
filled windows are placed as runs: one step puts thousands of rests of a length into
windows that all have the same remaining capacity. A segment tree indexed by remaining
capacity finds the tightest open window. The plan is a table of runs (bounded by window
alone) that says where the k-th rest of a length goes. A task numbers its own pieces of
each length as it cuts them, and the tasks' counts say where its numbers begin, so
pieces are never sorted and no task sees all of one length.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.llm.common import map_arrow, written

#: Distinct words whose ids a worker remembers; beyond it, it starts anew.
CACHE = 600_000
#: Words encoded at once, and the longest that is remembered.
TOGETHER, LONGEST = 256, 200
#: Words up to this character (Latin letters) are split alike by every version of Unicode, so the
#: vocabulary's ranks may encode them; all others go to its tokenizer.
PLAIN = "\u024f"


def _ranks(vocabulary: str) -> tiktoken.Encoding | None:
    """The vocabulary as ranks, if there is a file of them."""
    file = public_tokenizers.path(f"{vocabulary}.tiktoken")
    if not os.path.exists(file):
        return None
    with open(file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Ids(dict):
    """Words, each standing for itself after a blank, to their ids as little-endian bytes.

    The vocabulary's own pattern takes one blank into the word that follows it and never
    joins two words, so the ids of a text are those of its pieces between blanks one after
    another, if no piece is empty or begins with white space; other texts, and those that
    hold an added token of the vocabulary, are encoded whole. Most words come again and
    again, so few are encoded at all.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.after_blank = np.zeros(max(tokens.values()) + 1, dtype=bool)
        self.after_blank[[i for t, i in tokens.items() if t.startswith("\u0120")]] = True  # how the file writes a blank
        self.ranks = _ranks(vocabulary)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in found]

    def _learn(self, words: list[str]) -> None:
        """Words come together, as one text of TOGETHER words costs less than as many texts. The same
        vocabulary as ranks, where there is such a file, gives the same ids in a quarter of the time."""
        plain: list[str] = []
        others: list[str] = []
        for w in words:
            (plain if self.ranks and (w.isascii() or max(w) <= PLAIN) else others).append(w)
        self._learn_by(plain, lambda texts: [np.array(self.ranks.encode_ordinary(t), dtype="<u4") for t in texts])
        self._learn_by(others, self.whole)

    def _learn_by(self, words: list[str], encode: Callable[[list[str]], list[np.ndarray]]) -> None:
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for group, ids in zip(groups, encode([" " + " ".join(g) for g in groups]), strict=True):
            cuts = np.flatnonzero(self.after_blank[ids])
            parts = [ids[a:z] for a, z in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
            self.update(zip(group, map(np.ndarray.tobytes, parts), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        words: list[list[str] | None] = []
        unknown: set[str] = set()
        for t in texts:
            cut = t.split(" ")[1:]
            new = {w for w in set(cut) if w not in self}
            if any(a in t for a in self.added) or any(not w or w[0].isspace() or len(w) > LONGEST for w in new):
                words.append(None)
            else:
                words.append(cut)
                unknown |= new
        if len(self) + len(unknown) > CACHE:
            self.clear()
            unknown = set(itertools.chain.from_iterable(w for w in words if w is not None))
        self._learn(list(unknown))
        heads = self.whole([t if w is None else t.split(" ", 1)[0] for t, w in zip(texts, words, strict=True)])
        return [h.tobytes() + b"".join(map(self.__getitem__, w or ())) for h, w in zip(heads, words, strict=True)]


@functools.lru_cache(maxsize=2)
def _ids(vocabulary: str) -> _Ids:
    return _Ids(vocabulary)


def pieces(docs: DataFrame, window: int, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, task, k, start, length, ids_crc32, doc_tokens): full windows and the rest of each row.

    task numbers the input partitions; k counts the pieces of one length within one.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        ids_of, seen = _ids(vocabulary), [0] * (window + 1)
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("doc_id", "task", "k", "start", "length", "ids_crc32", "doc_tokens")}
            for doc_id, task, encoded in zip(b["doc_id"], b["task"], ids_of.encode(b["text"]), strict=True):
                ids = encoded + b"\0\0\0\0"
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    length = len(part) // 4
                    for name, value in zip(out, (doc_id, task, seen[length], start, length, zlib.crc32(part), n), strict=True):
                        out[name].append(value)
                    seen[length] += 1
            yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.spark_partition_id().alias("task"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, "doc_id long, task int, k long, start long, length long, ids_crc32 long, doc_tokens long")


class OpenWindows:
    """A segment tree over remaining capacities; each leaf holds runs of equally filled windows."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.count = np.zeros(2 * self.size, dtype=np.int64)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, first: int, n: int) -> None:
        self.runs[capacity].append((first, n))
        self._change(capacity, n)

    def take(self, capacity: int, most: int) -> tuple[int, int]:
        """(first window, number) of a run with this remaining capacity, most at the most."""
        first, n = self.runs[capacity].pop()
        if n > most:
            self.runs[capacity].append((first + most, n - most))
            n = most
        self._change(capacity, -n)
        return first, n

    def _change(self, capacity: int, n: int) -> None:
        at = self.size + capacity
        while at:
            self.count[at] += n
            at //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of an open window that holds length."""
        at = self.size + length
        if self.count[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, rank, n, per, sequence, offset): the rests of this length with ranks
    rank .. rank + n - 1 go to windows sequence, sequence + 1, ..., per of them side by
    side in each from offset on. Longest first, each into the tightest window that holds it."""
    open_, plan, used = OpenWindows(window), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = open_.tightest(length)
            # once a rest is in, its window is the tightest for the next of that length
            per = min((capacity if capacity is not None else window) // length, left)
            if capacity is None:
                first, n, capacity = used, left // per, window
                used += n
            else:
                first, n = open_.take(capacity, left // per)
            plan.append((length, rank, n * per, per, first, window - capacity))
            open_.add(capacity - per * length, first, n)
            rank += n * per
            left -= n * per
    return plan


def pack(docs: DataFrame, window: int = 1024, vocabulary: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the closing id 0 alone. Repeated rows are packed each; null
    ids keep their rows. Sequence ids are 0, 1, ... without gaps, and the pieces of a
    sequence fill it from offset 0 without gaps. No rows give no pieces.
    """
    found = written(pieces(docs, window, vocabulary, id_col, text_col))
    counts = written(found.groupBy("length", "task").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most window rows
    plan = best_fit_decreasing(histogram, window)
    runs = docs.sparkSession.createDataFrame(plan, "length long, rank long, n long, per long, sequence long, at long")
    of_length = F.array_sort(F.collect_list(F.struct("rank", "per", "sequence", "at")))  # a few each
    runs = runs.groupBy("length").agg(of_length.alias("runs"))
    # pieces of a length are numbered task by task; the tasks' counts alone are ordered
    in_length = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = counts.select("length", "task", (F.sum("n").over(in_length) - F.col("n")).alias("before"))
    placed = (
        found.join(before, ["length", "task"])
        .join(F.broadcast(runs), "length")  # at most window rows
        .withColumn("k", F.col("k") + F.col("before"))
        .withColumn("run", F.element_at(F.filter("runs", lambda r: r.rank <= F.col("k")), -1))
        .withColumn("i", F.col("k") - F.col("run.rank"))
    )
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.expr("run.sequence + i div run.per").alias("sequence_id"), F.expr("run.at + (i % run.per) * length").alias("offset"))
