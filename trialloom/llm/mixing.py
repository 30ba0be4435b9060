"""Mixing documents to target weights of domains that they belong to softly.

A naive Bayes classifier, counted from a table of labelled documents, gives every
document a posterior over domains. Its words are not independent, so labelled documents that the
counts have not seen decide how many words it listens to and how much they say. Rates r say how often each document is taken: they minimise the squared
difference between the expected tokens of each domain, sum(r * tokens * posterior), and
its target, under r >= 0 (r >= 1 for documents of a domain that is to be kept). The
rates are a column: every step of projected gradient is one aggregation to a few sums
for each domain and pair of domains, and one expression on the rows. Everything is
DataFrame and SQL functions.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.llm.common import bounded_sample, drop_written, written

#: Bounds of the classifier: labelled documents it learns from, and words it knows; fewer
#: words are tried too.
SAMPLE, VOCABULARY, LEAST_DOCS = 20_000, 2048, 4
SIZES = (32, 128, 512, 2048)
#: Chi-square from which a word tells domains apart.
CHI_SQUARE = 16.0
#: Matches that count in full; with more, each counts less. The best of these is taken.
FULL = (2.0, 8.0, 32.0, 1e9)
#: Steps at most, steps between tables, and the share of all tokens that totals may be off.
STEPS, NESTED, CLOSE = 60, 4, 1e-4
#: A domain whose target is more than so many times the share that it has has practically no
#: tokens: its target cannot be met, and no document is repeated for its sake. A parameter of
#: fit_rates, mix and mixed_documents; float("inf") repeats however few there are.
SCARCE = 100.0
#: Stands in every document.
EVERY = "\u0001"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\n\\t\\x0B\\f\\r]+"), "")


def _features(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with tokens and one row for each distinct word and shape."""
    w = F.col("words")
    repeats = F.floor(8 * F.size("distinct") / F.greatest(F.size(w), F.lit(1)))
    rows = docs.withColumn("words", _words(F.col("text"))).drop("text").withColumn("tokens", F.size(w).cast("long")).withColumn("distinct", F.array_distinct(w))
    shapes = F.array(F.lit(EVERY), F.concat(F.lit(EVERY), F.when(F.col("tokens") > 12, repeats).otherwise(-1).cast("string")))
    return rows.withColumn("word", F.explode(F.concat("distinct", shapes))).drop("words", "distinct")


@dataclass
class Domains:
    """words(word, place, gain array), the log odds that a text starts from, the weight of its
    evidence, how many words count, and how many matches in full."""

    words: DataFrame
    start: list[float]
    slope: float
    size: int
    full: float

    def posterior(self) -> list[Column]:
        """Probabilities of the domains from the columns of _evidence."""
        scale = F.lit(self.slope) * F.least(F.lit(1.0), F.lit(self.full) / F.greatest("n", F.lit(1)))
        x = [F.lit(b) + scale * F.col(f"s{i}") for i, b in enumerate(self.start)]
        top = F.greatest(*x) if len(x) > 1 else x[0]
        w = [F.exp(v - top) for v in x]
        total = sum(w[1:], w[0])
        return [v / total for v in w]


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE, size: int = VOCABULARY) -> Domains:
    """A classifier from labelled(doc_id, domain).

    Its words are at most size that tell domains apart most, each with log P(word | domain)
    - log P(word), and one sign that stands in every document. Rows with another or no
    domain, or without a document, are ignored; a document with several domains counts for
    each. A quarter of the sample is not counted but decides how evidence is weighed.
    Without labels, posteriors are even.
    """
    known = labelled.where(F.col("domain").isin(domains)).select("doc_id", "domain").distinct()
    picked = written(bounded_sample(known, "domain", "doc_id", sample).withColumn("asked", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(4)) == 0))
    rows = written(_features(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")))  # about sample rows
    n = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    seen = {(r["domain"], r["asked"]): r["n"] for r in picked.groupBy("domain", "asked").agg(F.count("*").alias("n")).collect()}
    mine = [seen.get((d, False), 0) for d in domains]
    total, used = sum(n.values()), sum(mine)
    counts = rows.where("not asked").groupBy("word").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(domains)])
    share = F.log((F.col("n") + 1.0) / (used + 2.0))
    gain = [F.log((F.col(f"n{i}") + 0.5) / (m + 1.0)) - share for i, m in enumerate(mine)]
    # chi-square of a word against the domains' shares of documents
    expect = [F.col("n") * F.lit(max(m, 0.5) / max(used, 1)) for m in mine]
    worth = sum(((F.col(f"n{i}") - e) * (F.col(f"n{i}") - e) / e for i, e in enumerate(expect)), F.lit(0.0))
    best = counts.where((F.col("n") >= LEAST_DOCS) & (F.col("word") != EVERY)).withColumns({"gain": F.array(*gain), "worth": F.round(worth, 6)})
    best = best.where(F.col("worth") >= CHI_SQUARE).orderBy(F.desc("worth"), "word").limit(size)
    best = best.withColumn("place", F.row_number().over(W.orderBy(F.desc("worth"), "word"))).select("word", "place", "gain")  # at most size rows
    zero = docs.sparkSession.range(1).select(F.lit(EVERY).alias("word"), F.lit(0).alias("place"), F.array(*[F.lit(0.0)] * len(domains)).alias("gain"))
    words = written(best.unionByName(zero))
    # the documents asked, about a quarter of the sample, weigh as much as their domain does in all labels
    sizes = sorted({min(z, size) for z in SIZES})
    evidence = _evidence(rows.where("asked"), words, len(domains), ["domain"], sizes)
    columns = [F.col(f"e{z}.{c}").alias(f"{c}_{z}") for z in sizes for c in ("n", *(f"s{i}" for i in range(len(domains))))]
    got = evidence.select("domain", *columns).collect()
    y = np.array([domains.index(r["domain"]) for r in got], dtype=int)
    weight = np.array([n[d] / max(1, seen.get((d, True), 0)) for d in (r["domain"] for r in got)])
    prior = np.log(np.array([n.get(d, 0) + 1.0 for d in domains]) / (total + len(domains)))
    tried = []
    for z in sizes:
        hits = np.array([r[f"n_{z}"] for r in got], dtype=float)
        sums = np.array([[r[f"s{i}_{z}"] for i in range(len(domains))] for r in got], dtype=float).reshape(len(got), len(domains))
        for full in FULL:
            tried.append((*calibrate(sums * np.minimum(1, full / np.maximum(hits, 1))[:, None], y, weight, prior), z, full))
    _, start, slope, z, full = min(tried, key=lambda x: (round(x[0], 9), x[3], x[4]))
    for t in (picked, rows):
        drop_written(t)
    return Domains(words, start.tolist(), float(slope), z, full)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: np.ndarray, steps: int = 40) -> tuple[float, np.ndarray, float]:
    """(loss, start, slope) of P(domain) ~ exp(start + slope x) by weighted likelihood, held to
    prior and 1 as by one document; Newton steps."""
    k = len(prior)
    goal = np.r_[prior, 1.0]
    theta, weight = goal.copy(), weight / max(weight.mean(), 1e-12) if len(weight) else weight
    one = np.eye(k)[y] if len(y) else np.zeros((0, k))

    def loss(t: np.ndarray) -> float:
        z = t[:k] + t[k] * x
        z = z - z.max(axis=1, keepdims=True) if len(z) else z
        return float(-(weight * ((one * z).sum(axis=1) - np.log(np.exp(z).sum(axis=1)))).sum() + 0.5 * ((t - goal) ** 2).sum())

    now = loss(theta)
    for _ in range(steps):
        z = theta[:k] + theta[k] * x
        p = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
        p = p / p.sum(axis=1, keepdims=True)
        mean = (p * x).sum(axis=1)
        grad = np.r_[(weight[:, None] * (p - one)).sum(axis=0), (weight * (mean - (one * x).sum(axis=1))).sum()] + theta - goal
        h = np.eye(k + 1)
        h[:k, :k] += np.diag((weight[:, None] * p).sum(axis=0)) - (weight[:, None] * p).T @ p
        h[:k, k] += (weight[:, None] * p * (x - mean[:, None])).sum(axis=0)
        h[k, :k] = h[:k, k]
        h[k, k] += (weight * ((p * x * x).sum(axis=1) - mean**2)).sum()
        step = np.linalg.solve(h, grad)
        while (after := loss(theta - step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if now - after < 1e-9:
            break
        theta, now = theta - step, after
    return now, theta[:k], theta[k]


def _evidence(features: DataFrame, words: DataFrame, k: int, by: list[str], sizes: list[int]) -> DataFrame:
    """(doc_id, *by, tokens, e<size>(n, s0, ..) for each size): tokens, and of the first size words
    those that are there and their sums of gains."""
    hits = features.join(F.broadcast(words), "word")  # at most VOCABULARY + 1 rows
    sums = []
    for z in sizes:
        mine = (F.col("place") <= z) & (F.col("place") > 0)
        sums.append(F.count(F.when(mine, 1)).alias(f"n_{z}"))
        sums += [F.sum(F.when(mine, F.col("gain")[i]).otherwise(0.0)).alias(f"s{i}_{z}") for i in range(k)]
    own = hits.groupBy("doc_id", *by).agg(F.sum(F.when(F.col("word") == EVERY, F.col("tokens"))).alias("tokens"), *sums)
    parts = [F.struct(F.col(f"n_{z}").alias("n"), *[F.col(f"s{i}_{z}").alias(f"s{i}") for i in range(k)]).alias(f"e{z}") for z in sizes]
    return own.select("doc_id", *by, "tokens", *parts)


def posteriors(docs: DataFrame, model: Domains) -> DataFrame:
    """(doc_id, tokens, p array): one row for each doc_id. Rows under one id count as one
    document, also those with a null id; null texts have no words."""
    own = _evidence(_features(docs.select("doc_id", "text")), model.words, len(model.start), [], [model.size])
    return own.select("doc_id", "tokens", f"e{model.size}.*").select("doc_id", "tokens", F.array(*model.posterior()).alias("p"))


def fit_rates(members: DataFrame, targets: list[float], steps: int = STEPS, keep: int | None = None, scarce: float = SCARCE) -> tuple[DataFrame, list[float]]:
    """(members(doc_id, tokens, p) with rate, reached): from 1 everywhere, projected gradient on
    the squares of what the tokens of each domain are off their target.

    targets are shares of all tokens, reached the shares of all tokens that rates give.
    In the metric that weighs a document by its tokens, a step moves rates alike for short
    and long documents. Squares are weighed by the inverse of the moments sum(tokens p p')
    of the documents that may move, so that a step of length 1 would meet all targets if no
    rate met its bound; a step that makes things worse is tried again at half the length.
    It ends when every total is within 1e-4 of all tokens, when steps have shrunk to
    nothing, or after steps steps. A table without tokens keeps its rates at 1.
    keep names a domain: documents whose likeliest domain that is keep a rate of 1 at least.
    Rates have no upper bound. The target of a domain that is more than scarce times what it has is what it
    has, and the others share the rest. Totals that stay off by more than 1e-4 are logged
    as a warning.
    """
    k = len(targets)
    p = [F.col("p")[i] for i in range(k)]
    t = F.col("tokens").cast("double")
    least = F.lit(0.0) if keep is None else F.when(p[keep] >= F.array_max("p"), F.lit(1.0)).otherwise(F.lit(0.0))
    table = written(members.withColumn("rate", F.lit(1.0)))
    r = table.agg(F.sum(t).alias("t"), *[F.sum(t * p[i]).alias(f"s{i}") for i in range(k)]).head()
    total = r["t"] or 0.0
    if not total:
        return table, list(targets)
    size = np.array([max(r[f"s{i}"] / total, 1e-9) for i in range(k)])
    goal = np.array(targets)
    few = goal > scarce * size
    if few.any() and not few.all():
        goal = np.where(few, size, goal * (goal.sum() - size[few].sum()) / goal[~few].sum())
    rate, nested, length = F.col("rate"), 0, 1.0
    before: tuple | None = None  # rate, off, direction and weights of squares at the last step that helped

    def stepped(rate: Column, direction: np.ndarray) -> Column:
        pull = sum((p[i] * F.lit(float(direction[i])) for i in range(1, k)), p[0] * F.lit(float(direction[0])))
        return F.greatest(least, rate - pull)

    for step in range(steps + 1):
        # totals at these rates, and the moments of the documents that a step may move
        free = F.when((rate > least) | (F.lit(step) == 0), t).otherwise(0.0)
        sums = [F.sum(t * rate * p[i]).alias(f"s{i}") for i in range(k)]
        sums += [F.sum(free * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
        now = table.agg(*sums).head()
        off = np.array([now[f"s{i}"] / total for i in range(k)]) - goal
        if before is not None and off @ before[3] @ off >= before[1] @ before[3] @ before[1]:
            length /= 2
            if length < 1e-3:
                rate, off = before[0], before[1]
                break
            rate = stepped(before[0], length * before[2])
            continue
        if np.abs(off).max() <= CLOSE or step == steps:
            before = (rate, off, None, None)
            break
        moments = np.array([[now[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / total
        moments += 1e-9 * max(np.trace(moments), 1e-12) * np.eye(k)
        weights = np.linalg.inv(moments)
        direction, length = weights @ off, min(1.0, 2 * length)
        nested += 1
        if nested % NESTED == 0:
            old, table = table, written(table.withColumn("rate", rate))
            drop_written(old)
            rate = F.col("rate")
        before = (rate, off, direction, weights)
        rate = stepped(rate, length * direction)
    rate, off = before[0], before[1]
    reached = [float(x) for x in off + goal]
    if np.abs(reached - np.array(targets)).max() > CLOSE:
        logging.getLogger(__name__).warning("shares of tokens reached: %s; targets: %s; without tokens: %s", reached, targets, few.tolist())
    return table.withColumn("rate", rate), reached


def mix(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], sample: int = SAMPLE, size: int = VOCABULARY, steps: int = STEPS, keep: str | None = None, scarce: float = SCARCE
) -> DataFrame:
    """One row for each doc_id: doc_id, tokens, p_<domain> for each domain of targets, rate, copies,
    and reached_<domain>, the share of the taken tokens, the same in every row.

    targets give each domain its share of the tokens (made to sum to 1). copies is rate
    rounded up or down by a hash of doc_id, so that it equals rate on average. keep names
    a domain whose documents are all taken at least once: as many tokens are taken in all
    as that needs (without keep, as many as there are).
    """
    domains = sorted(targets)
    share = [targets[d] / sum(targets.values()) for d in domains]
    members = written(posteriors(docs, learn(docs, labelled, domains, sample, size)))
    kept = domains.index(keep) if keep else None
    budget = _budget(members, share, kept) if keep else 1.0
    rated, reached = fit_rates(members, [budget * s for s in share], steps, kept, scarce)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = F.floor("rate")
    copies = (whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    taken = max(sum(reached), 1e-12)
    shares = [F.lit(x / taken).alias(f"reached_{d}") for d, x in zip(domains, reached, strict=True)]
    return rated.select("doc_id", "tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)], "rate", copies.alias("copies"), *shares)


def _budget(members: DataFrame, share: list[float], kept: int) -> float:
    """Tokens to take, as a share of all, so that what is kept whole does not exceed its target:
    documents of the kept domain bring their tokens of every domain with them."""
    k, t = len(share), F.col("tokens").cast("double")
    stays = F.when(F.col("p")[kept] >= F.array_max("p"), t).otherwise(0.0)
    r = members.agg(F.sum(t).alias("t"), *[F.sum(stays * F.col("p")[i]).alias(f"s{i}") for i in range(k)]).head()
    return max(1.0, r[f"s{kept}"] / r["t"] / share[kept]) if r["t"] else 1.0


def mixed_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], keep: str | None = None, scarce: float = SCARCE) -> DataFrame:
    """The rows of docs, each as often as its copies say. Rows with a null id stay once.

    Rates are a table of ids; Spark broadcasts it if it is small, so that texts stay in place,
    and merges it with the texts if it is large.
    """
    rated = written(mix(docs, labelled, targets, keep=keep, scarce=scarce).select(F.col("doc_id").alias("_id"), F.col("copies").alias("_copies")))
    packed = docs.select(F.struct("*").alias("d"))  # the row as one value, so that no column of it can clash
    taken = packed.join(rated.where("_copies > 0"), F.col("d.doc_id") == F.col("_id"))
    out = taken.select("d", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_k")).select("d.*")
    return out if rated.where("_id is null").isEmpty() else out.unionByName(docs.where("doc_id is null"))


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from labels(doc_id, quality, toxic): toxic, low or clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


#: Production targets: more clean text, less of the rest.
TARGETS = {"clean": 0.86, "low": 0.04, "toxic": 0.10}
