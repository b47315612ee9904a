"""Ranked lexical search over hashed max-sketches.

A query's score of a document is the sum, over the query's terms, of the term's impact in the document:
`w * ((10^9 tf) div (1000 tf + 8 m))`, with the weight `w` from the number of documents that hold the term and `m` from the document's length.

1. Queries are handled in blocks of about `BLOCK_TERMS` terms, so what goes to all tasks is bounded; each block is one pass.
2. Postings: every whole text is cut into terms once; a document keeps its length and the frequencies of those terms that a query
   of the block holds. Numbers of documents and terms are added up over all documents.
3. Each document's impacts are folded into a sketch of `SKETCH` coordinates: a term falls on a coordinate by its hash, which
   keeps the largest impact. A batch of sketches times the queries' term counts by coordinate gives, for every document and
   query, an upper bound of the score.
4. A task takes its documents in descending order of the bound, scores them exactly from the postings and stops
   when the next bound is below the score that it needs to be among the task's `top` best. The bests of all tasks are ranked.

A query thus meets all documents, but only by their bounds, and at most `top` rows for each query and task are shuffled. Terms
are found by 64-bit hashes and compared byte by byte. Scores are 64-bit integers; bounds are doubles, raised by a rounding error.

Defined cases: null and empty texts have no terms; a query without terms, or whose terms no document holds, has no result;
documents with score 0 are not returned; every input row is a document, so repeated rows are ranked each for itself; null
document ids come first among equal scores; queries of one id, also null, are one query with all their terms; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coursegrid.llm import words
from coursegrid.llm.shared import settled

SKETCH = 512
BLOCK_TERMS = 1 << 18
#: Numbers in the table of bounds of one batch of documents.
BOUNDS = 1 << 20
#: Slots of the filter that is asked before a word is looked up.
FILTER = 1 << 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = words.folded(np.arange(256, dtype=np.uint8))


class Terms(NamedTuple):
    """The terms of a block of queries, in the order of their hashes."""

    hashes: np.ndarray
    data: np.ndarray  # their bytes
    offsets: np.ndarray
    seen: np.ndarray  # by the low bits of a hash, whether some term has them


class Queries(NamedTuple):
    ids: list
    terms: list[np.ndarray]  # of each query, places in Terms
    counts: list[np.ndarray]


def _hashes(texts: list[str]) -> np.ndarray:
    """The hash of each text that is one term."""
    own, values = words.alphanumeric(), words.folded(words.BYTE_VALUES)
    return np.concatenate([np.zeros(0, np.uint64), *(b.hashes for b in words.blocks(pa.array(texts, pa.string()), own, values))])


def dictionary(terms: list[str]) -> tuple[Terms, dict[str, int]]:
    """The terms and the place of each."""
    h = _hashes(terms)
    order = np.argsort(h, kind="stable")
    encoded = [terms[i].encode() for i in order]
    seen = np.zeros(FILTER, bool)
    seen[(h % words.U64(FILTER)).astype(np.int64)] = True
    offsets = np.cumsum([0, *map(len, encoded)])
    return Terms(h[order], np.frombuffer(b"".join(encoded), np.uint8), offsets, seen), {terms[i]: k for k, i in enumerate(order)}


def found(block: words.Block, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of a block that are among the terms, and the terms' places."""
    at = np.flatnonzero(terms.seen[(block.hashes % words.U64(FILTER)).astype(np.int64)])
    place = np.minimum(np.searchsorted(terms.hashes, block.hashes[at]), len(terms.hashes) - 1)
    same = terms.hashes[place] == block.hashes[at]
    at, place = at[same], place[same]
    start, low, size = block.starts[at], terms.offsets[place], np.diff(terms.offsets)[place]
    right = block.ends[at] - start == size
    for k in range(int(size[right].max(initial=0))):
        longer = np.flatnonzero(right & (size > k))
        right[longer] = FOLD[block.data[start[longer] + k]] == terms.data[low[longer] + k]
    return at[right], place[right]


def _postings(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, width = sent.value, len(sent.value.hashes)
        for batch in batches:
            for block in words.blocks(batch.column("text"), words.alphanumeric(), words.folded(words.BYTE_VALUES)):
                at, place = found(block, terms)
                rows = np.searchsorted(block.first, at, "right") - 1
                keys, counts = np.unique(rows * width + place, return_counts=True)
                cut = pa.array(np.searchsorted(keys, np.arange(len(block.rows) + 1) * width).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(block.rows.start, len(block.rows)),
                        pa.array(np.diff(block.first).astype(np.int64)),
                        pa.ListArray.from_arrays(cut, pa.array((keys % width).astype(np.int32))),
                        pa.ListArray.from_arrays(cut, pa.array(counts.astype(np.int64))),
                    ],
                    names=["id", "n", "terms", "tf"],
                )

    return run


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Of terms that come `tf` times in a document of `n` terms, among `documents` with `length` terms in all."""
    m = 100 - 75 + 75 * n * documents // length
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)


class _Best:
    """The best documents of each query so far."""

    def __init__(self, queries: int, top: int):
        self.top, self.rows = top, [[] for _ in range(queries)]

    def needed(self, q: int) -> int:
        return -self.rows[q][-1][0] if len(self.rows[q]) == self.top else 1

    def add(self, q: int, scored: list[tuple[int, object]]) -> None:
        self.rows[q] += [(-s, i is not None, i if i is not None else 0) for s, i in scored if s >= self.needed(q)]
        self.rows[q] = sorted(self.rows[q])[: self.top]


def _ranked(sent, width: int, top: int, kind: pa.DataType, item_kind: pa.DataType):
    def score(rows: np.ndarray, q: int, keys: np.ndarray, values: np.ndarray, queries: Queries) -> np.ndarray:
        """Exact scores of documents of a batch."""
        wanted = rows[:, None] * width + queries.terms[q][None, :]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0) @ queries.counts[q]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, slot, by_slot, weight, documents, length = sent.value
        best = _Best(len(queries.ids), top)
        step = max(64, min(4096, BOUNDS // max(1, len(queries.ids))))
        for whole in batches:
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                size = pa.compute.list_value_length(batch.column("terms")).to_numpy()
                row = np.repeat(np.arange(batch.num_rows), size)
                if not len(row):
                    continue
                term = batch.column("terms").flatten().to_numpy().astype(np.int64)
                n = batch.column("n").to_numpy()
                value = impacts(batch.column("tf").flatten().to_numpy(), n[row], weight[term], documents, length)
                sketch = np.zeros((batch.num_rows, SKETCH))
                np.maximum.at(sketch, (row, slot[term]), value.astype(float))
                bounds = (sketch @ by_slot) * (1 + 1e-9)
                ids = batch.column("id")
                for q in range(len(queries.ids)):
                    own = np.flatnonzero(bounds[:, q] >= best.needed(q))
                    own = own[np.argsort(-bounds[own, q], kind="stable")]
                    at, some = 0, top
                    while at < len(own) and bounds[own[at], q] >= best.needed(q):
                        rows = own[at : at + some]
                        exact = score(rows, q, row * width + term, value, queries)
                        good = np.flatnonzero(exact >= best.needed(q))
                        best.add(q, [(int(exact[i]), ids[int(rows[i])].as_py()) for i in good])
                        at, some = at + some, 2 * some
        rows = [(q, i if there else None, -s) for q, own in enumerate(best.rows) for s, there, i in own]
        items, found_ids, scores = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array([queries.ids[q] for q in items], item_kind), pa.array(found_ids, kind), pa.array(scores, pa.int64())],
            names=["item_id", "doc_id", "score"],
        )

    return run


def _terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def search(
    documents: DataFrame,
    queries: DataFrame,
    top: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """`item_id, rank, doc_id, score`: each query's `top` highest-scoring documents with a score above 0."""
    asked = settled(
        queries.select(F.col(item_col).alias("item"), F.explode(_terms_of(F.col(item_text_col))).alias("term"))
        .groupBy("item", "term")
        .agg(F.count("*").alias("c"))
    )
    blocks = max(1, math.ceil(asked.count() / block_terms))
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found_rows = None
    for k in range(blocks):
        of_block = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        rows = _searched(texts, of_block, top)
        found_rows = rows if found_rows is None else found_rows.unionByName(rows)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = found_rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _searched(texts: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """`item_id, doc_id, score`: the best documents of each task for the queries of one block."""
    context = texts.sparkSession.sparkContext
    terms, place = dictionary(sorted(r["term"] for r in asked.select("term").distinct().collect()))
    kind, item_kind = (f.schema[c].dataType for f, c in ((texts, "id"), (asked, "item")))
    layout = f"item_id {item_kind.simpleString()}, doc_id {kind.simpleString()}, score long"
    if not place:
        return texts.sparkSession.createDataFrame([], layout)
    by_item: dict = {}
    for r in asked.collect():
        by_item.setdefault(r["item"], []).append((place[r["term"]], r["c"]))
    both = [np.array(own, np.int64).T for own in by_item.values()]
    queries = Queries(list(by_item), [b[0] for b in both], [b[1] for b in both])

    numbers = "n long, terms array<int>, tf array<long>"
    postings = settled(texts.mapInArrow(_postings(context.broadcast(terms)), f"id {kind.simpleString()}, {numbers}"))
    total = postings.filter("n > 0").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = np.zeros(len(place), np.int64)
    for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        df[r["term"]] = r["df"]

    slot = (words.mixed(terms.hashes) % words.U64(SKETCH)).astype(np.int64)
    by_slot = np.zeros((SKETCH, len(queries.ids)))
    for q in range(len(queries.ids)):
        np.add.at(by_slot[:, q], slot[queries.terms[q]], queries.counts[q])
    sent = context.broadcast((queries, slot, by_slot, weights(df, total["documents"]), total["documents"], max(1, total["length"])))
    arrow = (_arrow(texts, "id"), _arrow(asked, "item"))
    return postings.mapInArrow(_ranked(sent, len(place), top, *arrow), layout)


def _arrow(frame: DataFrame, name: str) -> pa.DataType:
    return frame.select(name).limit(0).toArrow().schema.field(name).type
