"""Near-duplicates by SimHash fingerprints that differ in few bits.

Fingerprints have 64 bits and link at 3 differing bits or fewer. Cut into two segments
of 32 bits, two linked fingerprints differ by at most one bit in one of them. So every
segment value is indexed under its 32 one-wildcard variants; an equality of variants
finds all pairs of values at one bit, and each such pair (or a value alone) names a
bucket whose members are verified. Values are joined rather than fingerprints: a variant
holds two values at most, however many documents share them.

Copies never meet as pairs: the index holds distinct fingerprints. A bucket of more than
LIMIT fingerprints is cut by the same argument over the other segment (two halves of 16
bits, then two quarters of 8). After both cuts 11 bits are free, so no group ever
exceeds 2048 fingerprints, and none is dropped. Within a group the members of one
connected part are tied to its smallest member rather than to each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import map_arrow, written
from trialloom.llm.components import connected_components

#: Bits in which linked fingerprints may differ; two segments find them up to 3.
MAX_BITS = 3
#: Fingerprints verified against each other at once.
LIMIT = 2048
#: Segment values whose variants one task makes.
SPREAD = 100_000
#: Shingles hashed at once, so that a text's length does not bound the memory needed.
BLOCK = 1 << 16
WORDS = 3
SEED = 42


def fingerprint(text: str | None) -> int:
    """The 64 fingerprint bits as an unsigned integer.

    A-Z are lower-cased; words are runs of anything but ASCII white space; shingles of
    3 words count as often as they occur; fewer words make one shingle, none (also a
    null text) the fingerprint zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - WORDS + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + WORDS - 1]
        shingles = map(join, zip(part, part[1:], part[2:], strict=False)) if len(words) >= WORDS else [join(words)]
        h = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, text_hash long) for every row; other columns of docs are not read."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield {"doc_id": b["doc_id"], "fp": fps, "text_hash": b["text_hash"]}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return map_arrow(rows, run, "doc_id long, fp long, text_hash long")


def _parts(adjacent: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each row of a symmetric 0/1 matrix."""
    n = len(adjacent)
    label = np.arange(n)
    while True:
        near = np.where(adjacent, label[None, :], n).min(axis=1)
        after = np.minimum(label, near)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _verify(fps: np.ndarray, side: np.ndarray, single: bool) -> Iterator[tuple[int, int]]:
    """Edges that tie together the linked members of one group."""
    order = np.argsort(fps)
    fps, side = fps[order], side[order]
    if len(fps) == 2:
        if int(fps[0] ^ fps[1]).bit_count() <= MAX_BITS:
            yield int(fps[1]), int(fps[0])
        return
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= MAX_BITS
    if not single:
        near &= side[:, None] != side[None, :]
    for i, j in enumerate(_parts(near)):
        if i != j:
            yield int(fps[i]), int(fps[j])


def _verify_groups(members: DataFrame, keys: list[str]) -> DataFrame:
    """(src, dst) from members(*keys, v0, v1, side, fp); each group is at most 2048 rows."""
    parts = members.repartition(*keys).sortWithinPartitions(*keys).select(F.struct(*keys).alias("key"), (F.col("v0") == F.col("v1")).alias("single"), "side", "fp")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        last, single, fps, side = None, True, [], []

        def close() -> list[tuple[int, int]]:
            if len(fps) < 2:
                return []
            return list(_verify(np.array(fps, dtype=np.int64).view(np.uint64), np.array(side), single))

        for b in batches:
            edges: list[tuple[int, int]] = []
            for key, alone, s, fp in zip(b["key"], b["single"], b["side"], b["fp"], strict=True):
                if key != last:
                    edges += close()
                    last, single, fps, side = key, alone, [], []
                fps.append(fp)
                side.append(s)
            if edges:
                e = np.array(edges, dtype=np.uint64).view(np.int64)
                yield {"src": e[:, 0], "dst": e[:, 1]}
        if edges := close():
            e = np.array(edges, dtype=np.uint64).view(np.int64)
            yield {"src": e[:, 0], "dst": e[:, 1]}

    return map_arrow(parts, run, "src long, dst long")


def _bits(col, start: int, width: int):
    return F.shiftrightunsigned(col, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _one_wildcard(value, width: int, part: int = 0) -> list:
    """Structs (part, w, rest, bit): value with bit w cleared and that bit, for each w."""
    out = []
    for w in range(width):
        rest = value.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << w)).cast("long"))
        out.append(F.struct(F.lit(part).alias("part"), F.lit(w).alias("w"), rest.alias("rest"), (rest != value).alias("bit")))
    return out


def _refine(members: DataFrame, keys: list[str], parts: list, width: int, tag: str) -> tuple[DataFrame, list[str]]:
    """Cut groups that are too large: one of two parts of the remaining bits differs by one bit at most."""
    variants = F.explode(F.array(*[x for i, p in enumerate(parts) for x in _one_wildcard(p, width, i)]))
    cut = members.withColumn("x", variants)
    cut = cut.withColumns({f"{tag}_{c}": F.col(f"x.{c}") for c in ("part", "w", "rest")}).drop("x")
    return cut, [*keys, f"{tag}_part", f"{tag}_w", f"{tag}_rest"]


def links(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(src, dst) pairs that connect exactly the fingerprints that links connect.

    fps(fp) holds distinct fingerprints. A pair joins two that verified links reach from
    one another inside one group; any two within 3 bits are connected by such pairs.
    """
    segs = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), _bits(F.col("fp"), 0, 32).alias("v")), F.struct(F.lit(1).alias("seg"), _bits(F.col("fp"), 32, 32).alias("v")))).alias("s")).select("s.seg", "s.v", "fp")
    values = written(segs.groupBy("seg", "v").agg(F.count("*").alias("n")))
    # each row becomes 32: spread first, as the written table has few files
    wide = values.repartition(max(1, values.count() // SPREAD, fps.sparkSession.sparkContext.defaultParallelism), "seg", "v")
    pairs = (
        wide.select("seg", "n", F.explode(F.array(*_one_wildcard(F.col("v"), 32))).alias("x"))
        .groupBy("seg", F.col("x.w").alias("w"), F.col("x.rest").alias("v0"))
        .agg(F.sum(F.when(~F.col("x.bit"), F.col("n"))).alias("n0"), F.sum(F.when(F.col("x.bit"), F.col("n"))).alias("n1"))
        .where("n0 is not null and n1 is not null")
        .select("seg", "v0", F.col("v0").bitwiseOR(F.expr("shiftleft(1L, w)")).alias("v1"), (F.col("n0") + F.col("n1")).alias("n"))
    )
    buckets = written(pairs.unionByName(values.where("n > 1").select("seg", F.col("v").alias("v0"), F.col("v").alias("v1"), "n")))
    sides = buckets.select("seg", F.col("v0").alias("v"), F.lit(0).alias("side"), "v0", "v1", "n").unionByName(
        buckets.where("v0 <> v1").select("seg", F.col("v1").alias("v"), F.lit(1).alias("side"), "v0", "v1", "n")
    )
    keys = ["seg", "v0", "v1"]
    edges = _verify_groups(sides.where(F.col("n") <= limit).join(segs, ["seg", "v"]), keys)
    if not buckets.where(F.col("n") > limit).isEmpty():
        edges = edges.unionByName(_large(sides.where(F.col("n") > limit).join(segs, ["seg", "v"]), keys, limit))
    return edges


def _large(members: DataFrame, keys: list[str], limit: int) -> DataFrame:
    other = F.when(F.col("seg") == 0, _bits(F.col("fp"), 32, 32)).otherwise(_bits(F.col("fp"), 0, 32))
    members = written(members.select(*keys, "side", "fp", other.alias("other")))
    cut, keys2 = _refine(members, keys, [_bits(F.col("other"), 0, 16), _bits(F.col("other"), 16, 16)], 16, "h")
    sizes = written(cut.groupBy(*keys2).agg(F.count("*").alias("m")).where("m > 1"))
    small = cut.join(sizes.where(F.col("m") <= limit).drop("m"), keys2)
    edges = _verify_groups(small, keys2)
    if sizes.where(F.col("m") > limit).isEmpty():
        return edges
    large = cut.join(sizes.where(F.col("m") > limit).drop("m"), keys2)
    half = F.when(F.col("h_part") == 0, _bits(F.col("other"), 16, 16)).otherwise(_bits(F.col("other"), 0, 16))
    large = large.withColumn("half", half)
    last, keys3 = _refine(large, keys2, [_bits(F.col("half"), 0, 8), _bits(F.col("half"), 8, 8)], 8, "q")
    return edges.unionByName(_verify_groups(last, keys3))


def _rooted(rows: DataFrame, limit: int) -> DataFrame:
    """(fp, root, component_id) for each fingerprint of rows(doc_id, fp): root is a fingerprint, the
    same for all that links connect; component_id is the smallest doc_id there."""
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = connected_components(links(fps.select("fp"), limit))
    rooted = written(fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    tops = written(rooted.groupBy("root").agg(F.min("rep").alias("component_id")))
    return written(rooted.join(tops, "root").select("fp", "root", "component_id"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id): one row for each row of docs.

    component_id is the smallest doc_id among the rows whose fingerprints can be reached
    by links, the row itself included. Null ids keep their row and never name a
    component (a component of null ids only has a null component_id). Null, empty and
    blank texts have fingerprint zero and are linked like any other. Repeated rows stay; no
    rows give none.
    """
    rows = written(fingerprints(docs, id_col, text_col))
    named = _rooted(rows, limit).select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the smallest
    doc_id stays, of several texts under that id the one with the smallest hash, of rows
    repeated with it one. Rows with a null id stay, as they cannot be told apart.

    Which rows stay is a table of ids and hashes; Spark broadcasts it if it is small, so
    that texts stay in place, and merges it with the texts if it is large.
    """
    rows = written(fingerprints(docs))
    known = rows.where("doc_id is not null").join(_rooted(rows, LIMIT).select("fp", "root"), "fp")
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    counted = known.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    stays = counted.groupBy("root").agg(first, F.min_by("times", F.struct("doc_id", "text_hash")).alias("times"))
    # texts with one hash have one fingerprint, so one root
    stays = written(stays.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"), "times"))

    # the row as one value, so that no column of it can clash
    packed = docs.select(F.struct("*").alias("d"), F.xxhash64("text").alias("h"))
    same = (F.col("d.doc_id") == F.col("_id")) & (F.col("h") == F.col("_hash"))
    again = stays.where("times > 1")
    out = packed.join(stays.where("times = 1"), same).select("d.*")
    if not again.isEmpty():
        out = out.unionByName(packed.join(again, same).dropDuplicates(["_id", "_hash"]).select("d.*"))
    return out if rows.where("doc_id is null").isEmpty() else out.unionByName(docs.where("doc_id is null"))
