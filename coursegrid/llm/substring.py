"""Exact substring removal: repeated windows of words, found by Rabin-Karp hashes.

The hash of every run of `window` words of every text is taken from prefix sums and counted over the corpus (see `cells`: a
chunk sends each different hash once, a bucket answers which of them other chunks have too). Windows found twice or
more, in whatever texts, are merged into maximal intervals of words, and all those words are removed.

Hashes have 64 bits, from hashes of the words themselves: among n windows about n^2 / 2^65 single ones look repeated, that is
two in ten thousand million.

Defined cases: every input row gives one result row, and repeated rows repeat each other's windows; null and empty texts have
no words; texts below `window` words lose nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from coursegrid.llm import cells, words


def _hashes(block: words.Block, window: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(block.windows(window))
    return starts, block.rolled(window)[starts]


def _own(texts, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Different window hashes of a chunk, sorted, and which of them it has more than once."""
    found = [_hashes(b, window)[1] for b in words.blocks(texts, words.spaced())]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, int))


def _send(window: int, buckets: int):
    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, _ = _own(table.column("text"), window)
        at = cells.cuts(keys, buckets)
        full = np.flatnonzero(np.diff(at))
        return pa.table(
            {
                "chunk": pa.array([key[0].as_py()] * len(full), pa.int32()),
                "bucket": pa.array(full, pa.int32()),
                "keys": pa.array([cells.packed(keys[at[b] : at[b + 1]]) for b in full], pa.binary()),
            }
        )

    return send


def _answer(table: pa.Table) -> pa.Table:
    """For each cell of a bucket, one bit per key: whether another cell has it."""
    own = [cells.unpacked(c.as_py()) for c in table.column("keys")]
    every = np.sort(np.concatenate(own))
    common = np.unique(every[1:][every[1:] == every[:-1]])
    marks = [cells.located(k, common)[1] for k in own]
    useful = [i for i, m in enumerate(marks) if m.any()]
    return pa.table(
        {
            "chunk": table.column("chunk").take(pa.array(useful, pa.int64())).cast(pa.int32()),
            "bucket": table.column("bucket").take(pa.array(useful, pa.int64())).cast(pa.int32()),
            "marks": pa.array([np.packbits(marks[i]).tobytes() for i in useful], pa.binary()),
        }
    )


def _remove(window: int, buckets: int):
    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys, counts = _own(table.column("text"), window)
        repeated = counts > 1
        at = cells.cuts(keys, buckets)
        for b, marks in zip(answers.column("bucket").to_pylist(), answers.column("marks").to_pylist()):
            low, high = at[b], at[b + 1]
            repeated[low:high] |= np.unpackbits(np.frombuffer(marks, np.uint8), count=high - low).astype(bool)
        removed = keys[repeated]
        n_words, n_removed, kept, runs = [], [], [], []
        for block in words.blocks(table.column("text"), words.spaced()):
            starts, hashes = _hashes(block, window)
            starts = starts[cells.located(hashes, removed)[1]]
            edges = np.zeros(len(block.hashes) + 1, np.int32)
            edges[starts] += 1
            np.subtract.at(edges, starts + window, 1)
            inside = np.cumsum(edges[:-1]) > 0
            for i in range(len(block.rows)):
                low, high = int(block.first[i]), int(block.first[i + 1])
                gone = inside[low:high]
                own = block.data[block.offsets[i] : block.offsets[i + 1]].tobytes().split()
                n = int(gone.sum())
                n_words.append(high - low)
                n_removed.append(n)
                kept.append(b" ".join(compress(own, ~gone) if n else own))
                runs.append(_intervals(gone) if n else [])
        return pa.table(
            {
                "doc_id": table.column("id"),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "removed": pa.array(runs, pa.list_(pa.list_(pa.int64()))),
                "text": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    return remove


def _intervals(gone: np.ndarray) -> list[list[int]]:
    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    return edges.reshape(-1, 2).tolist()


def remove_repeats(documents: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, n_words, n_removed, removed, text`: removed [start, end) runs of words, and the words left, joined by blanks."""
    chunks, count = cells.dealt(documents, id_col, text_col)
    kind = chunks.schema["id"].dataType.simpleString()
    sent = chunks.groupBy("chunk").applyInArrow(_send(window, count), "chunk int, bucket int, keys binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "chunk int, bucket int, marks binary")
    return (
        chunks.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(
            _remove(window, count),
            f"doc_id {kind}, n_words long, n_removed long, removed array<array<long>>, text string",
        )
    )
