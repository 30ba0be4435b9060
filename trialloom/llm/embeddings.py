"""Near-duplicate vectors from a neighbour graph refined by NN-descent.

Equal vectors of a label become one, with a count. Each distinct vector holds a list of
its k best neighbours so far. The first lists come from groups of vectors that share a
few random hyperplane signs; then, round by round, every vector joins its neighbours and
those that count it as theirs in a group, all pairs inside the group are compared, and
better ones enter the lists. Groups that only hold old acquaintances rest.

A list whose every entry reaches the threshold is saturated: there may be more, also
outside the connected part of the lists that it lies in. Parts that hold a saturated list
are therefore counted whole. Members within half the threshold's angle of one member, the
head, all link with each other, so they are counted without comparing. The rest of the
part meets itself and those, and each part every other such part of its label that an
angle bound around the heads does not rule out. That goes tile by tile and returns counts
and the parts that touch, so that a large group of near copies never becomes a list of pairs.

Recall is audited against brute force on a bounded set of query vectors after that; while
it is below its target, lists double and the descent goes on. If that does not reach it
either, all vectors of a label are compared tile by tile, which is exact.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.llm.common import drop_written, written
from trialloom.llm.components import connected_components

THRESHOLD = 0.98
#: Neighbours in a list, groups of signs for the first lists, and least signs in each.
K, TABLES, SIGNS = 8, 4, 10
#: Vectors compared all with all at once; larger groups are dealt out at random.
GROUP = 128
ROUNDS, RECALL, ENLARGE = 6, 0.97, 3
#: Query vectors of an audit: as many as show so many links, but no more than the last.
AUDIT, AUDIT_LINKS, AUDIT_MOST = 256, 200, 4096
TILE = 2048
#: Parts of more vectors are split around PIVOTS of them, up to LEVELS times.
SPLIT, PIVOTS, LEVELS = 512, 16, 8
#: More, in angle, than what rounding can do.
SLACK = 1e-6


def distinct_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows(row, vec_id), members(row, vec_id, node), nodes(node, label, v, copies)).

    row is a key of its own for every input row; node is the smallest row with the same
    label and vector. Null labels, and vectors that are null, zero or hold a null or a
    component that is not finite, have no node. Ids play no part in this.
    """
    v = F.col("v")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    raw = F.col(vector_col)
    if vectors.schema[vector_col].dataType.simpleString() != "array<float>":
        raw = raw.cast("array<double>")
    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), raw.alias("v"))
    plus_zero = F.transform(v, lambda x: F.when(x == 0, x * 0).otherwise(x))
    read = read.withColumn("v", F.when(F.col("label").isNotNull() & good, plus_zero))
    table = written(read.withColumn("row", F.monotonically_increasing_id()))
    with_vector = table.where("v is not null")
    nodes = written(with_vector.groupBy("label", "v").agg(F.min("row").alias("node"), F.count("*").alias("copies")))
    members = written(with_vector.join(nodes.drop("copies"), ["label", "v"]).select("row", "vec_id", "node"))
    return table.select("row", "vec_id"), members, nodes


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrix(column) -> np.ndarray:
    """A list column whose lists have the same length, as rows of unit length."""
    if not len(column):
        return np.zeros((0, 0))
    return _unit(np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1))


def _compare_groups(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(node, nbr, sim): for each vector of a group its k best others there that beat its list.

    rows(*keys, node, v, least, fresh): least is what a new neighbour must exceed; only pairs
    with a fresh member count. Vectors of different lengths are never compared.
    """
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys).select(F.xxhash64(*keys).alias("g"), "node", "v", "least", "fresh")

    def one(node: np.ndarray, x: np.ndarray, least: np.ndarray, fresh: np.ndarray) -> tuple:
        sim = x @ x.T
        sim[node[:, None] == node[None, :]] = -2
        sim[~(fresh[:, None] | fresh[None, :])] = -2
        take = min(k, len(node) - 1)
        best = np.argpartition(-sim, take - 1, axis=1)[:, :take]
        val = np.take_along_axis(sim, best, axis=1)
        i, j = np.nonzero(val > least[:, None])
        return node[i], node[best[i, j]], val[i, j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # of the group that goes on

        def close(out: list[tuple]) -> None:
            by: dict[int, list[int]] = {}
            for i, h in enumerate(held):
                by.setdefault(h[1].shape[1], []).append(i)
            for same in by.values():
                node, x, least, fresh = (np.concatenate([held[i][f] for i in same]) for f in range(4))
                _, first = np.unique(node, return_index=True)
                for at in range(0, len(first), GROUP * 4):  # groups are bounded; this holds if a hash collides
                    part = first[at : at + GROUP * 4]
                    if len(part) > 1 and fresh[part].any():
                        out.append(one(node[part], x[part], least[part], fresh[part]))

        last = None
        for b in batches:
            g, node, least, fresh = (b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "node", "least", "fresh"))
            sizes = np.diff(np.asarray(b.column("v").offsets))
            cuts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (sizes[1:] != sizes[:-1])]) if len(g) else []
            out: list[tuple] = []
            for a, z in zip(cuts, [*cuts[1:], len(g)], strict=False):
                if g[a] != last:
                    close(out)
                    held, last = [], g[a]
                held.append((node[a:z], _matrix(b.column("v").slice(a, z - a)), least[a:z], fresh[a:z].astype(bool)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["node", "nbr", "sim"])
        out = []
        close(out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["node", "nbr", "sim"])

    return dealt.mapInArrow(run, "node long, nbr long, sim double")


def _best(pairs: DataFrame, k: int, threshold: float) -> DataFrame:
    """The k best neighbours of each node, each once. An entry stays fresh if no older list
    had it and the node's new list is not saturated."""
    once = pairs.groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    ranked = once.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy(F.desc("sim"), "nbr")))
    close = F.sum((F.col("sim") >= threshold).cast("int")).over(W.partitionBy("node"))
    kept = ranked.where(F.col("r") <= k).withColumn("close", close)
    return kept.select("node", "nbr", "sim", (F.col("fresh") & (F.col("close") < k)).alias("fresh"))


def first_lists(nodes: DataFrame, dim: int, k: int, threshold: float, seed: int = 11) -> DataFrame:
    """Lists from groups of vectors of a label with the same signs along random directions,
    as many as keep a group's expected size at about half of GROUP."""
    n_signs = max(SIGNS, math.ceil(math.log2(max(1.0, 2 * nodes.count() / GROUP))))
    planes = np.random.default_rng(seed).normal(size=(TABLES * n_signs, dim))

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            sizes = np.diff(np.asarray(v.offsets))
            key = np.zeros((len(sizes), TABLES), dtype=np.int64)
            for d in np.unique(sizes):  # of other lengths than most: as far as the directions reach
                at = np.flatnonzero(sizes == d)
                x = _matrix(v.take(pa.array(at)))[:, :dim]
                bit = (x @ planes[:, : x.shape[1]].T > 0).reshape(len(at), TABLES, n_signs)
                key[at] = (bit.astype(np.int64) << np.arange(n_signs)).sum(axis=2) * 4096 + d % 4096
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("label"), v, pa.array(list(key), type=pa.list_(pa.int64()))], names=["node", "label", "v", "keys"])

    keyed = nodes.select("node", "label", "v").mapInArrow(signs, f"node long, label string, v {nodes.schema['v'].dataType.simpleString()}, keys array<long>")
    rows = keyed.select("node", "label", "v", F.posexplode("keys").alias("t", "key"))
    sizes = rows.groupBy("label", "t", "key").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / GROUP))
    slot = F.pmod(F.xxhash64("node", "t"), F.col("parts"))
    dealt = rows.join(written(sizes.drop("n")), ["label", "t", "key"]).withColumn("slot", slot)
    found = _compare_groups(dealt.withColumns({"least": F.lit(-1.5), "fresh": F.lit(True)}), ["label", "t", "key", "slot"], k)
    # some of its label besides, so that no list starts empty and the parts hang together
    counts = nodes.groupBy("label").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / (4 * k)))
    mixed = nodes.select("node", "label", "v").join(written(counts.drop("n")), "label").withColumn("slot", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")))
    others = _compare_groups(mixed.withColumns({"least": F.lit(-1.5), "fresh": F.lit(True)}), ["label", "slot"], max(2, k // 2))
    return written(_best(found.unionByName(others).withColumn("fresh", F.lit(True)), k, threshold))


def descend(nodes: DataFrame, graph: DataFrame, k: int, threshold: float) -> tuple[DataFrame, int]:
    """One round of neighbours of neighbours: (better graph, how many of its entries are links)."""
    state = graph.groupBy("node").agg(F.count("*").alias("n"), F.min("sim").alias("low"))
    least = F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(-1.5))
    vectors = nodes.select("node", "v").join(state, "node", "left").select("node", "v", F.coalesce(least, F.lit(-1.5)).alias("least"))
    ahead = graph.select(F.col("node").alias("pivot"), F.col("nbr").alias("node"), "fresh")
    back = graph.select(F.col("nbr").alias("pivot"), "node", "fresh")
    own = nodes.select(F.col("node").alias("pivot"), "node", F.lit(False).alias("fresh"))
    group = ahead.unionByName(back).unionByName(own).groupBy("pivot", "node").agg(F.max("fresh").alias("fresh"))
    # a vector that very many count as a neighbour has its group dealt out in parts
    sizes = group.groupBy("pivot").agg(F.count("*").alias("n"), F.max("fresh").alias("any")).where("any")
    parts = written(sizes.select("pivot", F.ceil(F.col("n") / GROUP).alias("parts")))
    group = written(group.join(parts, "pivot").select("pivot", F.pmod(F.xxhash64("node"), F.col("parts")).alias("slot"), "node", "fresh"))
    found = _compare_groups(group.join(written(vectors), "node"), ["pivot", "slot"], k).withColumn("fresh", F.lit(True))
    after = written(_best(graph.withColumn("fresh", F.lit(False)).unionByName(found), k, threshold))
    return after, after.where(F.col("sim") >= threshold).count()


def _by_length(v: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) for each length that lists of v have."""
    sizes = np.diff(np.asarray(v.offsets))
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, _matrix(v.take(pa.array(at)))


def _true_links(nodes: DataFrame, n: int, queries: int, threshold: float) -> DataFrame:
    """(a, b): all links of about so many nodes a, which a hash picks of n."""
    draw = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = nodes.where(draw < F.lit(min(1.0, queries / n))).select("node", "label", "v").collect()  # about AUDIT_MOST vectors at most
    at: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    for key in {(r.label, len(r.v)) for r in picked}:
        rows = [r for r in picked if (r.label, len(r.v)) == key]
        at[key] = np.array([r.node for r in rows]), _unit(np.array([r.v for r in rows], dtype=np.float64))
    asked = nodes.sparkSession.sparkContext.broadcast(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, label = b.column("node").to_numpy(), np.array(b.column("label").to_pylist(), dtype=object)
            for mine, y in _by_length(b.column("v")):
                for (of, size), (ids, x) in asked.value.items():
                    if size == y.shape[1]:
                        j = np.flatnonzero(label[mine] == of)
                        i, k = np.nonzero(x @ y[j].T >= threshold)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(node[mine[j[k]]])], names=["a", "b"])

    return written(nodes.select("node", "label", "v").mapInArrow(run, "a long, b long").where("a <> b"))


def audit(nodes: DataFrame, graph: DataFrame, whole: DataFrame, threshold: float) -> tuple[float, int]:
    """(share of the links of query vectors that lists and whole parts hold, links seen).

    The queries meet all vectors of their label; there are four times as many while they
    show few links. A link counts as found if either end lists the other, or if
    whole(node, root), the vectors that were counted part by part, has both under one root.
    """
    n, queries = nodes.count(), AUDIT
    if not n:
        return 1.0, 0
    true = _true_links(nodes, n, queries, threshold)
    while (seen := true.count()) < AUDIT_LINKS and queries < min(n, AUDIT_MOST):
        drop_written(true)
        queries *= 4
        true = _true_links(nodes, n, queries, threshold)
    links = graph.where(F.col("sim") >= threshold)
    both = links.select(F.col("node").alias("a"), F.col("nbr").alias("b")).unionByName(links.select(F.col("nbr").alias("a"), F.col("node").alias("b"))).distinct().withColumn("hit", F.lit(1))
    ends = [whole.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab"]
    found = true.join(both, ["a", "b"], "left").join(ends[0], "a", "left").join(ends[1], "b", "left").where("hit is not null or ra = rb").count()
    drop_written(true)
    return found / seen if seen else 1.0, seen


def _tiled(rows: DataFrame, of: str, meets: DataFrame) -> DataFrame:
    """rows(of, ...) dealt to the groups (lo, hi, a, b) where tile a of lo meets tile b of hi.

    A part (a value of the column of) of n rows is cut into tiles of about 2048, so a part's
    work spreads over tasks. meets(lo, hi), lo <= hi, says which parts meet.
    """
    sizes = written(rows.groupBy(F.col(of).alias("part")).agg(F.ceil(F.count("*") / TILE).alias("tiles")))
    both = meets.select(F.col("lo").alias("part"), F.col("hi").alias("mate")).unionByName(meets.where("lo <> hi").select(F.col("hi").alias("part"), F.col("lo").alias("mate")))
    mates = written(both.join(sizes, "part").join(sizes.select(F.col("part").alias("mate"), F.col("tiles").alias("others")), "mate"))
    each = rows.withColumn("part", F.col(of)).join(mates, "part").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    first = F.when(F.col("part") == F.col("mate"), F.col("tile") <= F.col("other")).otherwise(F.col("part") < F.col("mate"))
    return each.withColumns({
        "lo": F.least("part", "mate"), "hi": F.greatest("part", "mate"),
        "a": F.when(first, F.col("tile")).otherwise(F.col("other")), "b": F.when(first, F.col("other")).otherwise(F.col("tile")),
    }).drop("mate", "tiles", "others", "other")


def split_parts(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, part) of parts(node, part), large parts cut into smaller ones.

    A part is a node, its head, and all its members have the same label and vector length. Of a
    part with more than SPLIT members PIVOTS are drawn, which become heads, and each member goes to
    the nearest one; so again with what is still large, until nothing is or LEVELS are over. What
    is close stays together, so most pairs of the new parts are too far apart to be compared.
    """
    current = parts.select("node", "part")
    for level in range(LEVELS):
        big = written(current.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT))
        if big.isEmpty():
            drop_written(big)
            break
        members = current.join(big, "part").join(nodes.select("node", "v"), "node").withColumn("blocks", F.ceil(F.col("n") / TILE))
        drawn = W.partitionBy("part").orderBy(F.xxhash64(F.lit(level), "node"), "node")
        pivots = written(members.withColumn("_r", F.row_number().over(drawn)).where(F.col("_r") <= PIVOTS).select("node", "part", "v", "blocks"))
        dealt = members.select("node", "part", "v", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).alias("block"))
        around = pivots.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

        def nearest(members: pa.Table, heads: pa.Table) -> pa.Table:
            node, head = members.column("node").to_numpy(), heads.column("node").to_numpy()
            part = np.zeros(0, dtype=np.int64)
            if len(node):
                x, y = _matrix(members.column("v").combine_chunks()), _matrix(heads.column("v").combine_chunks())
                part = head[np.argmax(x @ y.T, axis=1)]
                part = np.where(np.isin(node, head), node, part)  # a head is always its own
            return pa.table({"node": pa.array(node, pa.int64()), "part": pa.array(part, pa.int64())})

        again = dealt.groupBy("part", "block").cogroup(around.groupBy("part", "block")).applyInArrow(nearest, "node long, part long")
        old = current
        current = written(again.unionByName(old.join(big, "part", "left_anti").select("node", "part")))
        for t in (big, pivots, *([old] if level else [])):
            drop_written(t)
    return current


def placed_parts(nodes: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """(node, whole, part, label, v, copies, angle) of parts(node, part), cut in two.

    whole is the given part, a node that is its head. Members within half the threshold's
    angle of the head keep the part's number and all link with each other; the others get
    the part -1 - whole. All members of a part have the same label and vector length.
    """
    heads = nodes.select(F.col("node").alias("part"), F.col("v").alias("head"))
    pairs = parts.join(nodes, "node").join(heads, "part").select("node", "part", "label", "v", "copies", "head")

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows)
            for at, x in _by_length(b.column("v")):
                y = _matrix(b.column("head").take(pa.array(at)))
                out[at] = np.arccos(np.clip(np.einsum("ij,ij->i", x, y), -1, 1))
            kept = [b.column(c) for c in ("node", "part", "label", "v", "copies")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out)], names=["node", "whole", "label", "v", "copies", "angle"])

    kind = nodes.schema["v"].dataType.simpleString()
    found = pairs.mapInArrow(angles, f"node long, whole long, label string, v {kind}, copies long, angle double")
    near = F.col("angle") <= (math.acos(min(1.0, threshold)) - SLACK) / 2
    return written(found.withColumn("part", F.when(near | (F.col("node") == F.col("whole")), F.col("whole")).otherwise(-1 - F.col("whole"))))


def touching_parts(placed: DataFrame, threshold: float) -> DataFrame:
    """(lo, hi): the pairs of parts of a label, lo <= hi, that may hold a link to be counted.

    A head stands for its part, within an angle that no member exceeds. By the triangle
    inequality a link needs two heads within both angles and the threshold's. A part
    around its own head needs no comparing with itself.
    """
    wide = placed.groupBy("part", "whole").agg(F.max("angle").alias("angle"))
    heads = placed.where("node = whole").select("whole", "label", "v")
    rows = written(wide.join(heads, "whole").select(F.col("part").alias("node"), "label", "v", "angle"))
    labels = rows.select(F.col("label").alias("lo"), F.col("label").alias("hi")).distinct()
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + SLACK

    def run(table: pa.Table) -> pa.Table:
        node, wide, tile = (table.column(c).to_numpy() for c in ("node", "angle", "tile"))
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        out = [np.zeros((2, 0), dtype=np.int64)]
        for at, x in _by_length(table.column("v").combine_chunks()):
            i, j = (at, at) if a == b else (at[tile[at] == a], at[tile[at] != a])
            y, z = (x, x) if a == b else (x[tile[at] == a], x[tile[at] != a])
            p, q = np.nonzero(np.arccos(np.clip(y @ z.T, -1, 1)) <= wide[i][:, None] + wide[j][None, :] + reach)
            p, q = node[i[p]], node[j[q]]
            keep = (p <= q) & ((p != q) | (p < 0)) if a == b else np.ones(len(p), dtype=bool)
            out.append(np.stack([np.minimum(p, q)[keep], np.maximum(p, q)[keep]]))
        lo, hi = np.concatenate(out, axis=1)
        return pa.table({"lo": lo, "hi": hi})

    return written(_tiled(rows, "label", labels).groupBy("lo", "hi", "a", "b").applyInArrow(run, "lo long, hi long"))


def _ties(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the nodes left and right just as link[i, j] does, one a node at most."""
    at, none = np.arange(len(left)), len(left)
    while True:
        to = np.where(link, at[:, None], none).min(axis=0, initial=none)
        after = np.minimum(at, np.where(link, to[None, :], none).min(axis=1, initial=none))
        if (after == at).all():
            break
        at = after
    i, j = np.flatnonzero(at != np.arange(len(left))), np.flatnonzero(to != none)
    return np.r_[left[i], right[j]], np.r_[left[at[i]], left[to[j]]]


def _tile_counts(placed: DataFrame, meets: DataFrame, threshold: float, ties: bool = False) -> DataFrame:
    """(node, links, src, dst): the links of every vector to the parts that meets(lo, hi) names
    for its part, vectors counted with their copies; and rows with src and dst alone, the
    parts of two tiles that hold a link, or with ties nodes that connect what the links of
    two tiles connect. No pair of vectors is ever a row by itself."""

    def run(table: pa.Table) -> pa.Table:
        lo, hi, a, b = (table.column(c)[0].as_py() for c in ("lo", "hi", "a", "b"))
        node, copies, side = (table.column(c).to_numpy() for c in ("node", "copies", "tile" if lo == hi else "part"))
        out: list[tuple] = []
        for at, x in _by_length(table.column("v").combine_chunks()):
            ids, n = node[at], copies[at]
            if (lo, a) == (hi, b):
                i = j = np.arange(len(at))
                link = x @ x.T >= threshold
                np.fill_diagonal(link, False)
                out.append((ids, link @ n, None, None))
            else:
                mine = side[at] == (a if lo == hi else lo)
                i, j = np.flatnonzero(mine), np.flatnonzero(~mine)
                link = x[i] @ x[j].T >= threshold
                out += [(ids[i], link @ n[j], None, None), (ids[j], n[i] @ link, None, None)]
            if ties:
                out.append((None, None, *_ties(link, ids[i], ids[j])))
            elif lo != hi and link.any():
                out.append((None, None, np.array([hi]), np.array([lo])))
        names = ["node", "links", "src", "dst"]
        tables = []
        for columns in out:
            size = next(len(c) for c in columns if c is not None)
            tables.append(pa.table({m: pa.nulls(size, pa.int64()) if c is None else pa.array(c, pa.int64()) for m, c in zip(names, columns, strict=True)}))
        return pa.concat_tables(tables)

    dealt = _tiled(placed.select("node", "part", "v", "copies"), "part", meets)
    return written(dealt.groupBy("lo", "hi", "a", "b").applyInArrow(run, "node long, links long, src long, dst long"))


def _with_core(placed: DataFrame, counted: DataFrame) -> DataFrame:
    """(node, links) of all of placed: counted links, and those around a head."""
    core = placed.where("part >= 0").groupBy("part").agg(F.sum("copies").alias("all"))
    around = placed.where("part >= 0").select("node", "part", "copies").join(core, "part").select("node", (F.col("all") - F.col("copies")).alias("links"))
    every = around.unionByName(placed.where("part < 0").select("node", F.lit(0).cast("long").alias("links")))
    return every.unionByName(counted.where("node is not null").select("node", "links")).groupBy("node").agg(F.sum("links").alias("links"))


def whole_parts(nodes: DataFrame, close: DataFrame, roots: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(whole(node, root, links), joined(part, root)) of the parts that hold a saturated list.

    close holds the links of the lists, roots their connected parts. links counts a vector's
    links to all of whole; joined gives the parts that touch others their common root.
    """
    # saturated: as many links as the list has places
    full = close.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("node")
    big = written(full.join(roots, "node").select(F.col("root").alias("part")).distinct())
    parts = written(roots.select("node", F.col("root").alias("part")).join(big, "part", "left_semi").select("node", "part"))
    small = split_parts(nodes, parts)
    placed = placed_parts(nodes, small, threshold)
    counted = _tile_counts(placed, touching_parts(placed, threshold), threshold)
    # what two small parts share ties the parts that they are of
    owner = small.where("node = part").select("node").join(parts, "node").select(F.col("node").alias("head"), "part")
    ends = counted.where("src is not null").select(*[F.expr(f"if({c} < 0, -1 - {c}, {c})").alias(c) for c in ("src", "dst")]).distinct()
    touch = ends.join(owner.select(F.col("head").alias("src"), F.col("part").alias("a")), "src").join(owner.select(F.col("head").alias("dst"), F.col("part").alias("b")), "dst")
    joined = written(connected_components(touch.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()).select(F.col("node").alias("part"), "root"))
    links = _with_core(placed, counted)
    whole = written(parts.join(joined, "part", "left").select("node", F.coalesce("root", "part").alias("root")).join(links, "node"))
    for t in (big, small, parts, placed, counted):
        drop_written(t)
    return whole, joined


def compared_whole(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(roots(node, root), whole(node, root, links)) from all vectors of a label, split around pivots
    and compared where two parts can touch: exact, for when the graph misses too much. The work
    grows with the square of what lies within reach, of a whole label in the worst case."""
    heads = nodes.groupBy("label", F.size("v").alias("d")).agg(F.min("node").alias("part"))
    parts = written(nodes.select("node", "label", F.size("v").alias("d")).join(heads, ["label", "d"]).select("node", "part"))
    placed = placed_parts(nodes, split_parts(nodes, parts), threshold)
    counted = _tile_counts(placed, touching_parts(placed, threshold), threshold, ties=True)
    around = placed.where("part >= 0 and node <> whole").select(F.col("node").alias("src"), F.col("whole").alias("dst"))
    roots = connected_components(counted.where("src is not null").select("src", "dst").unionByName(around))
    whole = written(_with_core(placed, counted).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "links"))
    return whole.select("node", "root"), whole


def neighbour_graph(nodes: DataFrame, threshold: float = THRESHOLD, k: int = K) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """(edges(src, dst) of the lists, roots(node, root), whole(node, root, links), audited recall)."""
    dim = nodes.agg(F.max(F.size("v")).alias("d")).head().d or 1
    log = logging.getLogger(__name__)
    graph = first_lists(nodes, dim, k, threshold)
    before = graph.where(F.col("sim") >= threshold).count()
    for attempt in range(ENLARGE):
        for _ in range(ROUNDS):
            old = graph
            graph, links = descend(nodes, graph, k, threshold)
            drop_written(old)
            grown, before = links - before, links
            if grown <= 0.001 * links:
                break
        close = graph.where(F.col("sim") >= threshold)
        edges = written(close.select(F.greatest("node", "nbr").alias("src"), F.least("node", "nbr").alias("dst")).distinct())
        roots = connected_components(edges)
        whole, joined = whole_parts(nodes, close, roots, k, threshold)
        recall, seen = audit(nodes, graph, whole, threshold)
        log.info("lists of %d: recall %.4f of %d links", k, recall, seen)
        if recall >= RECALL:
            top = joined.select(F.col("part").alias("root"), F.col("root").alias("top"))
            roots = roots.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            return edges, written(roots), whole, recall
        if attempt < ENLARGE - 1:
            k *= 2
            graph = written(graph.withColumn("fresh", F.lit(True)))
    log.warning("recall %.4f stays below %.2f: all vectors of a label are compared", recall, RECALL)
    return edges, *compared_whole(nodes, threshold), 1.0


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each row: vec_id, n_links, component_id, kept.

    Vectors link if labels are equal and not null and their cosine in double precision
    reaches threshold; null, zero and not finite vectors and null labels link with nothing.
    n_links counts the other rows linked directly, copies included. component_id is the
    smallest vec_id reachable, itself included; kept is vec_id = component_id. Rows that
    share an id are vectors of their own. Null ids link like others and never name a
    component (one of null ids alone has none, and none of it is kept). Extra columns are
    not read; no rows give no rows.
    """
    rows, members, nodes = distinct_vectors(vectors, id_col, vector_col, label_col)
    edges, roots, whole, _ = neighbour_graph(nodes, threshold, k)
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("nbr")))
    listed = both.join(whole.select("node"), "node", "left_anti").join(nodes.select(F.col("node").alias("nbr"), "copies"), "nbr").groupBy("node").agg(F.sum("copies").alias("links"))
    links = written(listed.unionByName(whole.select("node", "links")))
    of_node = written(
        nodes.select("node", "copies")
        .join(links, "node", "left")
        .join(roots, "node", "left")
        .select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    smallest = members.join(of_node, "node").groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = written(of_node.join(smallest, "root").select("node", "n_links", "component_id"))
    linked = written(members.join(named, "node").select("row", "n_links", "component_id", F.lit(True).alias("linked")))
    out = rows.join(linked, "row", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
