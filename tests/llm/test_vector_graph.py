"""Linked vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursegrid.llm import queries, vector_graph


def brute(rows, threshold=0.95):
    """[(id, links, component, kept)], every row against every other."""
    def usable(v):
        return v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))

    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if usable(v) else None for _, v in rows]
    n = [0] * len(rows)
    for i, a in enumerate(unit):
        for j in range(i):
            b = unit[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= threshold:
                n[i], n[j] = n[i] + 1, n[j] + 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            least[find(i)] = min(least.get(find(i), own), own)
    named = [(own, n[i], least.get(find(i)) if unit[i] is not None else own) for i, (own, _) in enumerate(rows)]
    return sorted(((i, k, c, i == c) for i, k, c in named), key=str)


def near(rng, v, cos):
    """A vector at that cosine from v."""
    v = v / np.linalg.norm(v)
    w = rng.normal(size=len(v))
    w -= (w @ v) * v
    return cos * v + np.sqrt(1 - cos * cos) * w / np.linalg.norm(w)


def family(rng, size, dim=16, low=0.955):
    middle = rng.normal(size=dim)
    return [near(rng, middle, c) * rng.uniform(0.5, 9) for c in rng.uniform(low, 0.9999, size)]


LAYOUT = "vec_id long, embedding array<float>"


def got(frame):
    assert frame.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in frame.collect()), key=str)


def as_float(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    one = rng.normal(size=16).tolist()
    rows = [(k, v.tolist()) for k, v in enumerate(family(rng, 40) + list(rng.normal(size=(60, 16))))]
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [None] + one[1:]), (204, [float("nan")] + one[1:]), (205, [float("inf")] + one[1:])]
    rows += [(300 + k, one) for k in range(30)] + [(300, one), (None, one), (None, None), (400, one[:8]), (401, one[:8]), (402, [1e-30] * 16), (403, [1e30] * 16)]
    rows = as_float(rows)
    frame = spark.createDataFrame(rows, LAYOUT).repartition(3)
    for name in ("node", "vec", "cell", "links", "size", "k0", "label"):
        frame = frame.withColumn(name, F.lit("x"))
    assert got(vector_graph.links(frame)) == brute(rows)


def test_cells_blocks_and_families(spark, monkeypatch):
    """Small shards: many cells, families larger than a block."""
    monkeypatch.setattr(vector_graph, "ROWS", 64)
    rng = np.random.default_rng(2)
    vectors = list(rng.normal(size=(500, 16))) + [v for size in (2, 2, 3, 5, 8, 20, 300) for v in family(rng, size)]
    rows = as_float([(int(i), v.tolist()) for i, v in zip(rng.permutation(len(vectors)), vectors)])
    want, found = brute(rows), got(vector_graph.links(spark.createDataFrame(rows, LAYOUT).repartition(4)))
    assert [r[0] for r in found] == [r[0] for r in want]
    assert sum(r[1] for r in found) >= 0.98 * sum(r[1] for r in want)
    assert all(f[1] <= w[1] for f, w in zip(found, want))  # nothing below the threshold, nothing twice
    assert sum(f[2] == w[2] for f, w in zip(found, want)) >= 0.98 * len(want)


def test_search_finds_everything_in_range():
    rng = np.random.default_rng(3)
    vectors = vector_graph.units([*rng.normal(size=(300, 16)), *family(rng, 150)]).astype(np.float32)
    lists = vector_graph.robust(vectors, rng)
    assert max(map(len, lists)) <= vector_graph.NEAR + vector_graph.FAR
    edges = {(i, int(j)) for i, own in enumerate(lists) for j in own}
    both = sorted(edges | {(j, i) for i, j in edges})
    cut = np.searchsorted([i for i, _ in both], np.arange(len(vectors) + 1))
    u, v = vector_graph.in_range(vectors, cut, np.array([j for _, j in both]), vector_graph.medoids(vectors), 0.95)
    want = np.argwhere(vectors @ vectors.T >= 0.95)
    assert len(u) >= 0.99 * len(want) and (np.einsum("ij,ij->i", vectors[u], vectors[v]) >= 0.95).all()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], LAYOUT)
    assert got(vector_graph.links(empty)) == []
    assert got(vector_graph.links(spark.createDataFrame([(1, None), (2, [0.0])], LAYOUT))) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert got(vector_graph.links(spark.createDataFrame([(3, [1.0, 2.0])], LAYOUT))) == [(3, 0, 3, True)]


def test_query(spark, folder):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()][:400]
    assert queries.op12_pruned_graph(spark, folder).count() >= len(rows)
    assert got(vector_graph.links(spark.createDataFrame(rows, LAYOUT))) == brute(rows)
