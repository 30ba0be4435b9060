import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trialloom.llm import embeddings

SF = "/root/testdata/sf0.01"


def plain(rows, threshold=0.98):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    def unit(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, dtype=np.float64)
        a /= np.abs(a).max()
        return a / np.sqrt(a @ a)

    x = [unit(v) if label is not None else None for _, v, label in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), comp, rows[i][0] is not None and rows[i][0] == comp))
    return sorted(out, key=str)


def run(df):
    return sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()], key=str)


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert run(df) == plain([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_dense_group_and_copies(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    rows = [(i, (base + 0.06 * rng.normal(size=16)).tolist(), 1) for i in range(60)]
    rows += [(100 + i, rng.normal(size=16).tolist(), 1 + i % 2) for i in range(80)]
    rows += [(300 + i, rows[-1][1], 2) for i in range(5)]
    rows += [(400 + i, rows[70 + i][1], 1 + i % 2) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert run(df) == plain(rows)


def test_cases(spark):
    rows = [
        (1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [1.0, float("nan")], 1), (5, [float("inf"), 1.0], 1), (6, [], 1),
        (7, [1.0, 2.0], None), (8, [1.0, 2.0], 1), (9, [2.0, 4.0], 1), (10, [1.0, 2.0], 2), (None, [1.0, 2.0], 1), (11, [1.0, 2.0, 0.0], 1),
        (12, [1e300, 2e300], 1), (13, [-0.0, 1.0], 3), (14, [0.0, 1.0], 3),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    assert run(df) == plain(rows)
    assert run(df.limit(0)) == []


def test_linked_groups_that_fill_their_lists(spark):
    """Every list is full of a vector's own tight group; links to other groups count all the same."""
    rng = np.random.default_rng(8)
    a, b, c = np.linalg.qr(rng.normal(size=(16, 3)))[0].T
    rows = []
    for g, centre in enumerate((a, 0.989 * a + math.sqrt(1 - 0.989**2) * b, c)):
        rows += [(100 * g + i, (centre + 0.002 * rng.normal(size=16)).tolist(), 1) for i in range(12)]
    want = plain(rows)
    assert sorted(n for _, n, _, _ in want) == [11] * 12 + [23] * 24
    assert run(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")) == want


def test_repeated_ids_keep_their_rows(spark):
    """Six rows of three ids, with other vectors, labels and a null, are six vectors."""
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (1, [1.0, 0.01], 2), (1, None, 1), (2, [0.01, 1.0], 1), (3, [1.0, 0.0], 2)]
    got = run(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert len(got) == 6 and got == plain(rows)


def random_rows(seed, n=150):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 6))
    rows = []
    for _ in range(n):
        v = (centres[rng.integers(12)] + rng.choice([0.0, 0.05, 0.2]) * rng.normal(size=6)).tolist()
        kind = rng.integers(12)
        v = None if kind == 0 else v[:4] if kind == 1 else v
        rows.append((None if rng.random() < 0.05 else int(rng.integers(n // 2)), v, None if rng.random() < 0.05 else int(rng.integers(3))))
    return rows


def test_random_tables(spark):
    """Repeated and null ids, ties, nulls and unequal lengths."""
    for seed in (1, 2):
        rows = random_rows(seed)
        assert run(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")) == plain(rows)


def test_exact_way_when_recall_stays_low(spark, monkeypatch, caplog):
    monkeypatch.setattr(embeddings, "RECALL", 1.1)
    monkeypatch.setattr(embeddings, "ENLARGE", 1)
    monkeypatch.setattr(embeddings, "TILE", 16)
    rows = random_rows(3)
    assert run(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")) == plain(rows)
    assert "all vectors of a label are compared" in caplog.text


def test_small_tiles(spark, monkeypatch):
    """Parts cut into many tiles count the same links."""
    monkeypatch.setattr(embeddings, "TILE", 8)
    rng = np.random.default_rng(7)
    path = np.cumsum(rng.normal(size=(70, 5)) * 0.04, axis=0) + rng.normal(size=5)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(path)] + [(200 + i, (path[0] + 0.01 * rng.normal(size=5)).tolist(), 1) for i in range(30)]
    assert run(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")) == plain(rows)


def test_split_parts(spark, monkeypatch):
    """Splitting changes no count, and heads stay with themselves."""
    monkeypatch.setattr(embeddings, "SPLIT", 12)
    monkeypatch.setattr(embeddings, "PIVOTS", 3)
    monkeypatch.setattr(embeddings, "TILE", 8)
    rng = np.random.default_rng(11)
    path = np.cumsum(rng.normal(size=(150, 6)) * 0.05, axis=0) + rng.normal(size=6)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(path)] + [(300 + i, (path[0] + 0.01 * rng.normal(size=6)).tolist(), 1) for i in range(40)]
    assert run(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")) == plain(rows)
    nodes = spark.createDataFrame([(i, embeddings._unit(np.array([v]))[0].tolist()) for i, (_, v, _) in enumerate(rows)], "node long, v array<double>")
    small = embeddings.split_parts(nodes, nodes.select("node", F.lit(0).cast("long").alias("part"))).collect()
    assert sorted(r.node for r in small) == list(range(len(rows)))
    assert all(r.part == r.node for r in small if r.node in {x.part for x in small})
    monkeypatch.setattr(embeddings, "RECALL", 1.1)
    monkeypatch.setattr(embeddings, "ENLARGE", 1)
    assert run(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")) == plain(rows)


def test_a_part_of_many_vectors_is_not_compared_whole(spark):
    """A chain of tight groups is one part; few of its pairs are compared."""
    rng = np.random.default_rng(12)
    angle = np.arange(60) * 0.2  # neighbours are 0.13 apart, links reach 0.2
    centres = np.stack([np.cos(angle / 3), np.sin(angle / 3), np.cos(angle), np.sin(angle), np.cos(angle / 2), np.sin(angle / 2), *np.zeros((4, 60))], axis=1)
    x = np.repeat(centres, 840, axis=0) + 0.01 * rng.normal(size=(60 * 840, 10))
    n = len(x)
    frame = spark.createDataFrame(pd.DataFrame({"node": np.arange(n), "v": (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()}), "node long, v array<double>")
    nodes = embeddings.written(frame.select("node", F.lit("1").alias("label"), "v", F.lit(1).cast("long").alias("copies")).repartition(8))
    small = embeddings.split_parts(nodes, nodes.select("node", F.lit(0).cast("long").alias("part")))
    placed = embeddings.placed_parts(nodes, small, 0.98)
    meets = embeddings.touching_parts(placed, 0.98)
    sizes = {r.part: r["count"] for r in placed.groupBy("part").count().collect()}
    compared = sum(sizes.get(r.lo, 0) * sizes.get(r.hi, 0) for r in meets.collect())
    assert compared < 0.1 * n * n / 2
    v = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = {r.node: r.links for r in embeddings._with_core(placed, embeddings._tile_counts(placed, meets, 0.98)).where("node % 997 = 0").collect()}
    assert links == {i: int((v @ v[i] >= 0.98).sum()) - 1 for i in range(0, n, 997)}


def test_audit_needs_a_common_root(spark):
    v = [[1.0, 0.0], [1.0, 0.01], [1.0, 0.02]]
    nodes = spark.createDataFrame([(i, "1", x, 1) for i, x in enumerate(v)], "node long, label string, v array<double>, copies long")
    graph = spark.createDataFrame([(0, 1, 0.9999)], "node long, nbr long, sim double")
    apart = spark.createDataFrame([(1, 1), (2, 2)], "node long, root long")
    recall, seen = embeddings.audit(nodes, graph, apart, 0.98)
    assert seen == 6 and recall == 2 / 6
    together = spark.createDataFrame([(1, 1), (2, 1)], "node long, root long")
    assert embeddings.audit(nodes, graph, together, 0.98)[0] == 4 / 6
