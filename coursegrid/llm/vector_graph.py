"""Near-duplicate vectors by a flat graph that is pruned robustly.

1. Equal vectors form one class with a size; only classes go on, so a vector that a third of the rows hold is one node.
2. Cluster centres are fitted on a bounded sample (`SAMPLE_NUMBERS` components); every class joins the cells of its `overlap` nearest
   centres. Cells of more than `ROWS` classes are dealt into blocks by hash.
3. Each block is a shard. Candidates of a node are its nearest nodes in the shard; robust pruning drops those that another
   chosen neighbour is much closer to, and some chosen at random keep the graph in one piece. Edges go both ways. A
   node's lists from all its shards are put together.
4. Every class is searched for in each of its cells, over the united lists of the cell's members, from medoids: the best `BEAM` seen
   are expanded, and beyond them everything within range, until nothing in range is left. In a cell of several blocks each pair of
   blocks is searched. What is found is verified in double precision.
5. A pair counts in the first cell that both share, so that links add up over cells; no pair leaves its task, only numbers of links and the
   root of each node among the links of the task. Components come from these.
6. The links of a bounded sample of classes are counted by brute force over all classes. Where fewer than `RECALL` of them were found, the
   search runs again with twice the overlap.

Defined cases: null, empty and zero vectors, and those with null or non-finite components, link with nothing; vectors of different
lengths are not compared; every input row is a vector, so repeated rows link with one another; a null id counts as a link, and a component
is named by its smallest id that is not null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursegrid.llm.components import components
from coursegrid.llm.shared import settled

#: Numbers in the sample that centres are fitted on, and the most centres.
SAMPLE_NUMBERS, SAMPLE_ROWS, CENTRES, ROUNDS = 1 << 20, 8192, 2048, 8
ROWS, OVERLAP, MOST_OVERLAP = 1024, 4, 16
#: Candidates, neighbours kept of them, and neighbours at random. ALPHA is over squared distances.
CANDIDATES, NEAR, FAR, ALPHA = 48, 16, 8, 1.44
BEAM, EXPANDED, MEDOIDS = 48, 8, 8
#: Rows of the audit, and the part of their links that must be found.
AUDIT, RECALL = 1024, 0.98
#: Pairs handled at once.
PAIRS = 1 << 16
#: What single precision may be off.
SLACK = 1e-4


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(vectors: list, width: int | None = None) -> np.ndarray:
    """Vectors of length 1 in double precision, filled up to `width` with zeros."""
    width = max(map(len, vectors), default=0) if width is None else width
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True, initial=0.0)  # keeps squares in range
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def centres(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(5)
    out = sample[rng.choice(len(sample), k, replace=False)].astype(np.float32)
    points = sample.astype(np.float32)
    for _ in range(ROUNDS):
        own = np.argmax(points @ out.T, axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, points)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(length > 0, sums / np.maximum(length, 1e-30), out)
    return out


def _cells(sent, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = sent.value
        k = min(overlap, len(middle))
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                near = units(batch.column("vec").to_pylist(), middle.shape[1]).astype(np.float32) @ middle.T
                own = np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), pa.array(own.tolist(), pa.list_(pa.int32()))], names=["node", "cells"]
                )

    return run


def robust(vectors: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """For each node the chosen ones among its nearest, and some at random."""
    n = len(vectors)
    k = min(CANDIDATES, n - 1)
    if k < 1:
        return [np.zeros(0, np.int64)] * n
    out = []
    for low in range(0, n, 256):
        own = np.arange(low, min(n, low + 256))
        near = vectors[own] @ vectors.T
        near[np.arange(len(own)), own] = -np.inf
        cand = np.argpartition(-near, k - 1, axis=1)[:, :k]
        sims = np.take_along_axis(near, cand, axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")
        cand, sims = np.take_along_axis(cand, order, axis=1), np.take_along_axis(sims, order, axis=1)
        among = vectors[cand] @ vectors[cand].transpose(0, 2, 1)
        alive, chosen = np.ones(cand.shape, bool), np.zeros(cand.shape, bool)
        for t in range(k):
            take = alive[:, t] & (chosen.sum(axis=1) < NEAR)
            chosen[take, t] = True
            alive[take] &= ALPHA * (1 - among[take, t]) > 1 - sims[take]
        far = rng.integers(0, n, (len(own), FAR))
        out += [np.unique(np.append(c[m], f[f != i])) for i, c, m, f in zip(own, cand, chosen, far)]
    return out


def _build(table: pa.Table) -> pa.Table:
    """Neighbours of each node of a shard, in both directions."""
    nodes = table.column("node").to_numpy()
    vectors = units(table.column("vec").to_pylist()).astype(np.float32)
    lists = robust(vectors, np.random.default_rng(len(nodes)))
    to = np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)
    of = np.repeat(np.arange(len(nodes)), [len(x) for x in lists])
    keys = np.unique(np.concatenate([of * len(nodes) + to, to * len(nodes) + of]))
    cut = np.searchsorted(keys, np.arange(len(nodes) + 1) * len(nodes)).astype(np.int32)
    return pa.table({"node": nodes, "near": pa.ListArray.from_arrays(pa.array(cut), pa.array(nodes[keys % len(nodes)]))})


def medoids(vectors: np.ndarray) -> np.ndarray:
    """Members closest to the middles of a few groups of them."""
    return np.unique(np.argmax(vectors @ centres(vectors, min(MEDOIDS, len(vectors))).T, axis=0))


def in_range(vectors: np.ndarray, cut: np.ndarray, to: np.ndarray, starts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) of at least that similarity that the search finds; every vector is a query. Edges: to[cut[i]:cut[i+1]]."""
    n = len(vectors)
    seen = np.full((n, n), -np.inf, np.float32)
    expanded = np.zeros((n, n), bool)
    seen[:, starts] = vectors @ vectors[starts].T
    active = np.arange(n)
    while len(active):
        own = seen[active]
        beam = np.partition(own, n - BEAM, axis=1)[:, n - BEAM] if n > BEAM else np.full(len(active), -np.inf)
        open_ = np.where(expanded[active] | ~((own >= beam[:, None]) | (own >= least)), -np.inf, own)
        some = min(EXPANDED, n)
        best = np.argpartition(-open_, some - 1, axis=1)[:, :some]
        row, column = np.nonzero(np.take_along_axis(open_, best, axis=1) > -np.inf)
        query, node = active[row], best[row, column]
        active = np.unique(query)
        expanded[query, node] = True
        degree = cut[node + 1] - cut[node]
        ahead = np.cumsum(degree) - degree
        met = to[np.arange(degree.sum()) + np.repeat(cut[node] - ahead, degree)]
        pairs = np.repeat(query, degree) * n + met
        pairs = np.unique(pairs[np.isneginf(seen.ravel()[pairs])])
        for low in range(0, len(pairs), PAIRS):
            q, v = np.divmod(pairs[low : low + PAIRS], n)
            seen[q, v] = np.einsum("ij,ij->i", vectors[q], vectors[v])
    return np.nonzero(seen >= least)


def _first_common(cells: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest cell that both nodes are in. `cells`: sorted cells of each node."""
    both = (cells[u][:, :, None] == cells[v][:, None, :]).any(axis=2)
    return np.where(both, cells[u], np.iinfo(np.int32).max).min(axis=1)


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes, the least node that the edges connect it with."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, u, root[v])
        np.minimum.at(root, v, root[u])
        root = root[root]
        if (root == before).all():
            return root


def _search(threshold: float):
    def search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cell, x, y = (k.as_py() for k in key[:3])
        table = table.sort_by("node")
        nodes, sizes, block = (table.column(c).to_numpy() for c in ("node", "size", "b"))
        exact = units(table.column("vec").to_pylist())
        vectors = exact.astype(np.float32)
        lists = table.column("near").combine_chunks()
        flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        at = np.minimum(np.searchsorted(nodes, flat), len(nodes) - 1)
        here = nodes[at] == flat
        cut = np.concatenate([[0], np.cumsum(here)])[offsets].astype(np.int64)
        starts = np.concatenate([np.flatnonzero(block == b)[medoids(vectors[block == b])] for b in np.unique(block)])
        u, v = in_range(vectors, cut, at[here], starts, threshold - SLACK)
        pairs = np.unique(np.minimum(u, v)[u != v] * len(nodes) + np.maximum(u, v)[u != v])
        cells = np.array(table.column("cells").to_pylist(), np.int64)
        links, edges = np.zeros(len(nodes), np.int64), []
        for low in range(0, len(pairs), PAIRS):
            u, v = np.divmod(pairs[low : low + PAIRS], len(nodes))
            near = np.einsum("ij,ij->i", exact[u], exact[v]) >= threshold
            u, v = u[near], v[near]
            edges.append((u, v))
            own = (np.minimum(block[u], block[v]) == x) & (np.maximum(block[u], block[v]) == y) & (_first_common(cells, u, v) == cell)
            np.add.at(links, u[own], sizes[v[own]])
            np.add.at(links, v[own], sizes[u[own]])
        u, v = (np.concatenate([np.zeros(0, np.int64), *(e[k] for e in edges)]) for k in (0, 1))
        root = nodes[_roots(len(nodes), u, v)]
        told = np.flatnonzero((links > 0) | (root != nodes))
        return pa.table({"node": nodes[told], "links": links[told], "root": root[told]})

    return search


def _counted(sent, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, length, queries = sent.value
        links = np.zeros(len(nodes), np.int64)
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                vec = batch.column("vec").to_pylist()
                near = (units(vec, queries.shape[1]) @ queries.T >= threshold) & (np.array([len(v) for v in vec])[:, None] == length)
                near &= batch.column("node").to_numpy()[:, None] != nodes
                links += batch.column("size").to_numpy() @ near
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links)], names=["node", "exact"])

    return run


def _bounded(classes: DataFrame, rows: int, width: int) -> list:
    return classes.orderBy(F.xxhash64("vec"), "node").limit(max(1, min(rows, SAMPLE_NUMBERS // max(1, width)))).collect()


def recall(classes: DataFrame, links: DataFrame, width: int, threshold: float) -> tuple[int, int]:
    """Links found and links there are, of a bounded sample of classes: the sample is compared with all of them."""
    sample = _bounded(classes, AUDIT, width)
    queries = units([r["vec"] for r in sample], width)
    about = np.array([r["node"] for r in sample], np.int64), np.array([len(r["vec"]) for r in sample]), queries
    sent = classes.sparkSession.sparkContext.broadcast(about)
    exact = classes.select("node", "size", "vec").mapInArrow(_counted(sent, threshold), "node long, exact long")
    both = exact.groupBy("node").agg(F.sum("exact").alias("exact")).join(links, "node", "left")
    told = both.agg(F.sum(F.coalesce("links", F.lit(0))).alias("found"), F.sum("exact").alias("exact")).first()
    return told["found"] or 0, told["exact"] or 0


def _found(classes: DataFrame, count: int, width: int, overlap: int, threshold: float) -> DataFrame:
    """`node, links, root`, a row for each task that has something to say of a node."""
    context = classes.sparkSession.sparkContext
    sample = _bounded(classes, SAMPLE_ROWS, width)
    k = min(CENTRES, max(1, math.ceil(count * overlap / ROWS)), max(1, len(sample) // 4))
    middle = context.broadcast(centres(units([r["vec"] for r in sample], width), k))
    placed = classes.join(
        classes.select("node", "vec").mapInArrow(_cells(middle, overlap), "node long, cells array<int>"), "node"
    )
    every = placed.select("node", "size", "vec", "cells", F.size("vec").alias("dim"), F.explode("cells").alias("cell"))
    sizes = every.groupBy("cell").agg(F.count("*").alias("rows")).filter(F.col("rows") > ROWS)
    blocks = F.ceil(F.coalesce("rows", F.lit(1)) / ROWS)
    members = every.join(F.broadcast(sizes), "cell", "left").withColumn("blocks", blocks).drop("rows")  # a row a centre
    members = settled(members.withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks"))))
    built = members.select("cell", "b", "dim", "node", "vec").groupBy("cell", "b", "dim").applyInArrow(_build, "node long, near array<long>")
    graph = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    b = F.col("b")
    tasks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least(o, b).alias("x"), F.greatest(o, b).alias("y")))
    asked = members.join(graph, "node").select("cell", "dim", "b", "node", "size", "vec", "cells", "near", F.explode(tasks).alias("t"))
    asked = asked.select("cell", "t.x", "t.y", "dim", "b", "node", "size", "vec", "cells", "near")
    return settled(asked.groupBy("cell", "x", "y", "dim").applyInArrow(_search(threshold), "node long, links long, root long"))


def links(embeddings: DataFrame, threshold: float = 0.95, overlap: int = OVERLAP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`vec_id, n_links, component_id, kept`: one row per input row."""
    vec = F.col(vector_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).alias("id"), F.when(usable(vec), vec).alias("vec"))
    address = [F.xxhash64(F.lit(k), "vec").alias(f"k{k}") for k in (0, 1)]
    classes = rows.filter("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("size"))
    classes = settled(classes.select(F.monotonically_increasing_id().alias("node"), "vec", "least", "size", *address))
    whole = classes.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    found = counted = None
    if whole["n"]:
        while True:
            found = _found(classes, whole["n"], whole["width"], overlap, threshold)
            counted = found.groupBy("node").agg(F.sum("links").alias("links"))
            own, every = recall(classes, counted, whole["width"], threshold)
            if own >= RECALL * every or overlap >= MOST_OVERLAP:
                break
            overlap *= 2
        labels = settled(components(found.select(F.col("node").alias("u"), F.col("root").alias("v"))))
        about = classes.drop("vec").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")).join(counted, "node", "left")
        named = about.groupBy("root").agg(F.min("least").alias("component"))
        classed = settled(about.join(named, "root").select("k0", "k1", "size", "links", "component"))
    else:
        classed = classes.select("k0", "k1", "size", F.lit(0).alias("links"), F.col("least").alias("component"))
    keyed = rows.select("id", *[F.when(F.col("vec").isNotNull(), a).alias(f"k{k}") for k, a in enumerate(address)])
    out = keyed.join(classed, ["k0", "k1"], "left")
    component = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce(F.col("size") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )
