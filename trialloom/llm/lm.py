"""Stupid-backoff language model scores of documents against the rest of the corpus.

Counts cover all documents. A document is scored with its own occurrences taken out: for
a word w after v that the other documents hold c(v w) times,

    S(w | v) = c(v w) / c(v)            if c(v w) > 0
             = 0.4 c(w) / N             otherwise

and S(w) = c(w) / N for the first word, with c(v) and c(w) over all documents and N all
words. log S is summed for each document. Words are known by 64-bit hashes.

The tables of word and pair counts are partitioned by hash and never leave the cluster.
Pairs of words are exploded from the texts once for each document that holds them, and
each goes to the hash bucket of one of its words, its home. There the pairs are counted,
and the pair counts and the home word's count are joined to them. What the other word
counts is needed too; for the COMMON commonest words a broadcast table of that bounded
size has it. A pair of two rarer words goes to both words' buckets: at home with v it is
scored if other documents hold it, at home with w if they do not.

Pairs of two of the HOT commonest words may be in every document; those are counted with
map-side sums into a table of at most HOT^2 rows, which is broadcast. The home of any
other pair is a word outside the HOT commonest. A home word that is common all the same
has several buckets, as many as its count asks for, and the pair's other word says which; its
own count goes to each of them. Pairs travel to their buckets in arrays, one row for each block of documents and
bucket; scores are summed as integers, so that they come out alike on every run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.llm.common import drop_written, map_arrow, written

HOT, COMMON = 1024, 1 << 17
BACKOFF = 0.4
#: Words of the corpus for each bucket, and buckets at most (beyond both, buckets grow). A word that is
#: not among the COMMON commonest has no more than a COMMON-th of all words, so not more than a bucket.
PER_PART, MOST_PARTS = 1_500_000, COMMON
#: A home word with more than one part in PIECES of a bucket's words is dealt to several buckets.
PIECES = 8
#: From one bucket of a home word to the next.
STRIDE = 7919
#: Counts that a worker sums up; beyond, it starts anew.
SUMMED = 500_000
#: Scores are summed in units of 1 / UNIT.
UNIT = 1e8
#: What a row of an exploded array says of its document: a pair at home with v or with w,
#: a pair of rare words there, a first word; id and number of words; what is known already.
AT_V, AT_W, IF_HIT, IF_MISS, FIRST, ID, KNOWN = range(7)


def block_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes of the words of all texts, the place there of each word in order, words of each
    text): lower-cased runs of anything but ASCII white space. Only distinct words are hashed."""
    runs = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    coded = runs.flatten().dictionary_encode()
    known = coded.dictionary.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(runs)), pc.list_value_length(runs).to_numpy())
    code = coded.indices.to_numpy()
    keep = (known != "")[code] if len(code) else np.zeros(0, dtype=bool)  # empty ones stand beside white space at either end
    doc, code = doc[keep], code[keep]
    used = np.zeros(len(known), dtype=bool)
    used[code] = True
    words, at = np.unique(pd.util.hash_array(known[used], categorize=False).view(np.int64), return_inverse=True)
    places = np.full(len(known), -1)
    places[used] = at
    return words, places[code], np.bincount(doc, minlength=len(runs))


def _place(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each hash in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


def unigram_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts of docs(text); word is its hash."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        for b in batches:
            words, at, _ = block_words(b["text"])
            held.append((words, np.bincount(at, minlength=len(words))))
            if sum(len(w) for w, _ in held) > SUMMED:
                yield dict(zip(("word", "n"), _summed(held), strict=True))
                held = held[:1]
        yield dict(zip(("word", "n"), _summed(held), strict=True))

    return map_arrow(docs.select("text"), run, "word long, n long", ("text",)).groupBy("word").agg(F.sum("n").alias("n"))


def _summed(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words, at = np.unique(np.concatenate([w for w, _ in counts]), return_inverse=True)
    return words, np.bincount(at, weights=np.concatenate([n for _, n in counts]), minlength=len(words)).astype(np.int64)


def _pairs(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, second word, text) of each two neighbours in a text; at numbers the words."""
    doc = np.repeat(np.arange(len(n)), n)
    same = doc[1:] == doc[:-1]
    return at[:-1][same], at[1:][same], doc[1:][same]


def hot_pair_counts(docs: DataFrame, hot) -> DataFrame:
    """(key, n) of pairs of the hot words; hot is a broadcast of their sorted hashes."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        keys = hot.value
        size = len(keys)
        total = np.zeros(size * size, dtype=np.int64)
        for b in batches:
            words, at, n = block_words(b["text"])
            v, w, _ = _pairs(_place(keys, words)[at] if len(words) else at, n)
            total += np.bincount((v * size + w)[(v >= 0) & (w >= 0)], minlength=size * size)
        at = np.flatnonzero(total)
        yield {"key": at, "n": total[at]}

    return map_arrow(docs.select("text"), run, "key long, n long", ("text",)).groupBy("key").agg(F.sum("n").alias("n"))


def pieces(n, parts: int, total: int):
    """How many buckets a home word of that count has; n is an array or a column."""
    share = max(1, total // parts // PIECES)
    return (n + share - 1) // share if isinstance(n, np.ndarray) else F.ceil(n / F.lit(share))


def exploded(docs: DataFrame, parts: int, total: int, common, hot, hot_pairs) -> DataFrame:
    """(bucket, block, r, o, code, n): what docs(doc_id long, text) hold, as arrays by block and bucket.

    An element is the home word r of a pair, its other word o, how often the document has
    the pair, and a code: the document's place in the block times 8, and what it is.
    common: sorted hashes and counts; hot: sorted hashes; hot_pairs: counts by both places.
    """
    log_total, log_backoff = math.log(max(total, 1)), math.log(BACKOFF)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        (keys, counts), hot_keys, both = common.value, hot.value, hot_pairs.value
        log_count, spread = np.log(counts), pieces(counts, parts, total)
        for b in batches:
            words, at, n = block_words(b["text"])
            known, warm = _place(keys, words), _place(hot_keys, words)
            base, hits = np.zeros(len(n)), np.zeros(len(n), dtype=np.int64)
            rows: list[tuple] = []  # bucket, r, o, code, n

            def add(r, o, doc, what, times, to=None, piece=0, rows=rows):
                rows.append((np.mod(np.mod(r if to is None else to, parts) + piece * STRIDE, parts), r, o, doc * 8 + what, times))

            doc = np.flatnonzero(n)
            first = at[(np.cumsum(n) - n)[doc]]
            easy = known[first] >= 0
            base[doc[easy]] += log_count[known[first[easy]]] - log_total
            add(words[first[~easy]], words[first[~easy]] * 0, doc[~easy], FIRST, np.ones((~easy).sum(), dtype=np.int64))
            # each pair once for a document, with its number of times
            v, w, doc = _pairs(at, n)
            size, d = max(1, len(words)), len(n)
            mine, times = np.unique((v * size + w) * d + doc, return_counts=True)
            doc, w, v = mine % d, mine // d % size, mine // d // size
            done = (warm[v] >= 0) & (warm[w] >= 0)
            if done.any():
                a, z, t, at_doc = v[done], w[done], times[done], doc[done]
                others = both[warm[a] * len(hot_keys) + warm[z]] - t
                hit = others > 0
                gain = t * np.where(hit, np.log(np.maximum(others, 1)) - log_count[known[a]], log_backoff + log_count[known[z]] - log_total)
                base += np.bincount(at_doc, weights=gain, minlength=d)
                hits += np.bincount(at_doc, weights=t * hit, minlength=d).astype(np.int64)
            easy_v, easy_w = known[v] >= 0, known[w] >= 0
            at_v = ~done & easy_w & (~easy_v | (warm[v] < 0))
            rare = ~easy_v & ~easy_w
            at_w = ~done & ~at_v & ~rare
            for mask, what, home, other in ((at_v, AT_V, v, w), (at_w, AT_W, w, v), (rare, IF_HIT, v, w), (rare, IF_MISS, w, v)):
                r, o, place = words[home[mask]], words[other[mask]], known[home[mask]]
                piece = np.mod(o, spread[place]) * (place >= 0) if len(spread) else 0
                add(r, o, doc[mask], what, times[mask], piece=piece)
            start = b["row"][0]  # rows of a batch are numbered one after another
            to = np.full(d, xxhash.xxh64_intdigest(start.to_bytes(8, "little")) >> 1)  # any bucket will do
            ids = np.array([i or 0 for i in b["doc_id"]], dtype=np.int64)
            add(ids, np.array([i is None for i in b["doc_id"]], dtype=np.int64), np.arange(d), ID, n, to)
            add(np.rint(base * UNIT).astype(np.int64), hits, np.arange(d), KNOWN, n * 0, to)
            columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
            order = np.lexsort((columns[1], columns[0]))
            bucket, r, o, code, times = (c[order] for c in columns)
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            at = pa.array(np.r_[cuts, len(bucket)], pa.int32())
            lists = {k: pa.ListArray.from_arrays(at, pa.array(x, t)) for k, x, t in (("r", r, pa.int64()), ("o", o, pa.int64()), ("code", code, pa.int32()), ("n", times, pa.int32()))}
            yield {"bucket": bucket[cuts], "block": [start] * len(cuts), **lists}

    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    return map_arrow(numbered, run, "bucket int, block long, r array<long>, o array<long>, code array<int>, n array<int>", ("text",))


@contextmanager
def _joins_by_bucket(spark: SparkSession) -> Iterator[None]:
    """Lets Spark join on (bucket, word) what is partitioned by bucket, without a further shuffle."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sums(blocks: DataFrame, words: DataFrame, common: DataFrame, parts: int, total: int) -> DataFrame:
    """(doc_id, n_words, hits, log_score) from exploded() and the counts of all and of common words."""
    what, place = F.col("code").bitwiseAND(7), F.shiftright("code", 3)
    # no bucket is null: said here, so that both uses below read one and the same shuffle
    sent = blocks.where("bucket is not null").repartitionById(parts, "bucket")
    elements = sent.select("*", F.posexplode("code").alias("i", "what")).select("bucket", "block", *[F.get(c, F.col("i")).alias(c) for c in ("r", "o", "n")], F.col("what").alias("code"))
    side = F.when(what.isin(AT_V, IF_HIT), 0).when(what.isin(AT_W, IF_MISS), 1)
    pairs = elements.withColumn("side", side)
    # the table of pair counts: of pairs that more than one document holds
    holder = F.col("block") + place
    counts = pairs.where("side is not null").groupBy("r", "bucket", "o", "side").agg(F.sum("n").alias("all"), F.min(holder).alias("lo"), F.max(holder).alias("hi")).where("lo <> hi")
    piece = F.explode(F.sequence(F.lit(0).cast("long"), pieces(F.col("n"), parts, total) - 1))
    spread = words.select(F.col("word").alias("r"), F.col("n").alias("c_r"), piece.alias("piece"))  # at most PIECES * parts rows more
    bucket = F.pmod(F.pmod("r", F.lit(parts)) + F.col("piece") * STRIDE, F.lit(parts)).cast("int")
    homes = spread.select("r", "c_r", bucket.alias("bucket")).distinct().repartitionById(parts, "bucket")
    others = F.broadcast(common.select(F.col("word").alias("o"), F.col("n").alias("c_o")))  # at most COMMON rows
    joined = (
        pairs.join(counts.select("r", "bucket", "o", "side", "all"), ["r", "bucket", "o", "side"], "left")
        .join(homes, ["r", "bucket"], "left")
        .join(others, "o", "left")
    )
    n, hit, log_total = F.col("n"), F.col("all").isNotNull(), math.log(max(total, 1))
    on_v = F.log(F.col("all") - n) - F.log(F.when(what == AT_W, F.col("c_o")).otherwise(F.col("c_r")))
    on_w = F.log(F.when(what == AT_V, F.col("c_o")).otherwise(F.col("c_r"))) - F.lit(log_total)
    gain = F.when(hit & (what != IF_MISS), on_v).when(~hit & what.isin(AT_V, AT_W, IF_MISS), on_w + math.log(BACKOFF)).when(what == FIRST, on_w)
    mine = joined.select(
        "bucket", "block", place.alias("doc"),
        F.when(what == KNOWN, F.col("r")).otherwise(F.round(n * gain * UNIT).cast("long")).alias("gain"),
        F.when(what == KNOWN, F.col("o")).when(hit & (what != IF_MISS), n).alias("hits"),
        F.when(what == ID, n).alias("n_words"),
        F.when((what == ID) & (F.col("o") == 0), F.col("r")).alias("doc_id"),
    )
    aggregates = [F.sum("gain").alias("gain"), F.sum("hits").alias("hits"), F.max("n_words").alias("n_words"), F.max("doc_id").alias("doc_id")]
    by_bucket = mine.groupBy("bucket", "block", "doc").agg(*aggregates)
    columns = ("doc", "gain", "hits", "n_words", "doc_id")
    packed = by_bucket.groupBy("bucket", "block").agg(F.collect_list(F.struct(*columns)).alias("docs"))  # at most a block

    def total_up(table: pa.Table) -> pa.Table:
        """The sums of each document of a block; there is one row for each bucket."""
        rows = pa.RecordBatch.from_struct_array(table.column("docs").combine_chunks().flatten())
        docs = pa.Table.from_batches([rows]).group_by("doc", use_threads=False).aggregate([("gain", "sum"), ("hits", "sum"), ("n_words", "max"), ("doc_id", "max")])
        return docs.select(["doc_id_max", "n_words_max", "hits_sum", "gain_sum"]).rename_columns(["doc_id", "n_words", "hits", "gain"])

    totals = packed.select("block", "docs").groupBy("block").applyInArrow(total_up, "doc_id long, n_words int, hits long, gain long")
    return totals.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("gain", F.lit(0)) / UNIT).alias("log_score"))


def stupid_backoff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, n_words, n_backoff, log_score, score (log_score / n_words).

    n_backoff counts the words for which the other documents do not hold the pair. A text
    without words (null, empty, blank) has 0 words, log_score 0 and a null score. Rows
    repeated under one id and null ids are documents of their own; ids are read as long,
    other columns not at all. No rows give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words = written(unigram_counts(rows))
    common = written(words.orderBy(F.desc("n"), "word").limit(COMMON))
    total = words.agg(F.sum("n").alias("n")).head().n or 0
    top = common.toPandas().sort_values(["n", "word"], ascending=[False, True])  # at most COMMON rows
    ordered = top.sort_values("word")
    hot_keys = np.sort(top["word"].to_numpy()[:HOT])
    share = spark.sparkContext.broadcast
    hot = share(hot_keys)
    found = hot_pair_counts(rows, hot).toArrow()  # at most HOT^2 rows
    hot_pairs = np.zeros(len(hot_keys) ** 2, dtype=np.int64)
    hot_pairs[found.column("key").to_numpy()] = found.column("n").to_numpy()
    parts = max(1, min(MOST_PARTS, math.ceil(total / PER_PART)), spark.sparkContext.defaultParallelism)
    blocks = exploded(rows, parts, total, share((ordered["word"].to_numpy(), ordered["n"].to_numpy())), hot, share(hot_pairs))
    with _joins_by_bucket(spark):
        totals = written(sums(blocks, words, common, parts, total))
    for t in (words, common):
        drop_written(t)
    n = F.col("n_words")
    backed = F.greatest(n - 1, F.lit(0)) - F.col("hits")
    return totals.select("doc_id", "n_words", backed.alias("n_backoff"), "log_score", F.when(n > 0, F.col("log_score") / n).alias("score"))
