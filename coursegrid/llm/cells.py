"""Sorted 64-bit keys of many documents, moved between tasks as packed cells.

An operator that compares every position of every text with all others would move one row per position. Here the documents
are dealt into chunks; a task takes the keys of a chunk, sorts them and sends one cell for each bucket of the key
range; a bucket's task answers each cell in the cell's own order, so the answer needs no keys. Chunks and buckets grow with
the session's number of shuffle partitions. A key that fills a third of the corpus is once in a cell, so no bucket is
larger than its share of the different keys of the chunks.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursegrid.llm.shared import partitions

#: Chunks, and buckets, for each shuffle partition.
PER_PARTITION = 2
U64 = np.uint64


def chunk_of(id_col: Column, text: Column, chunks: int) -> Column:
    """By id, so that copies of a text are spread; by text where there is no id."""
    return F.pmod(F.coalesce(F.when(id_col.isNotNull(), F.xxhash64(id_col)), F.xxhash64(text)), F.lit(chunks)).cast("int")


def dealt(texts: DataFrame, id_col: str, text_col: str, *more: str) -> tuple[DataFrame, int]:
    """`chunk, id, text` and more columns, and the number of chunks."""
    chunks = max(1, PER_PARTITION * partitions(texts.sparkSession))
    text = F.coalesce(F.col(text_col), F.lit(""))
    chunk = chunk_of(F.col(id_col), text, chunks)
    return texts.select(chunk.alias("chunk"), F.col(id_col).alias("id"), text.alias("text"), *more), chunks


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted keys pass from one bucket to the next: buckets + 1 positions."""
    lows = np.array([(b << 64) // buckets for b in range(1, buckets)], U64)
    return np.concatenate([[0], np.searchsorted(keys, lows), [len(keys)]])


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane: the high planes are zeros and vanish when compressed."""
    steps = np.diff(keys, prepend=U64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(cell: bytes) -> np.ndarray:
    planes = np.frombuffer(cell, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U64).ravel(), dtype=U64)


def planes(numbers: np.ndarray) -> bytes:
    """Non-negative 32-bit numbers, byte plane by byte plane."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def numbers(data: bytes) -> np.ndarray:
    parts = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(parts.T).view("<u4").ravel()


def located(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of keys in a sorted array, and whether they are there."""
    if not len(among):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return at, among[at] == keys


def squeezed(totals: np.ndarray) -> bytes:
    """Counts of any size, compressed."""
    steps = np.ascontiguousarray(totals.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zlib.compress(steps.tobytes(), 1)


def unsqueezed(data: bytes) -> np.ndarray:
    parts = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(parts.T).view("<u8").ravel()
