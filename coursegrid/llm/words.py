"""Words of a batch of texts as flat arrays: positions, 64-bit hashes, hashes of word windows.

Helpers for functions that run inside Spark tasks. A batch is cut into blocks of a few megabytes of text, so that memory
follows the block (or the longest single text), not the batch. Hashes are polynomials over mapped bytes modulo 2^64, taken
from prefix sums, and mixed; equal words have equal hashes in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U64 = np.uint64


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=U64) | U64(1)


BYTE_VALUES = _table(20_011)
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)


def spaced() -> np.ndarray:
    """Word bytes of the rule `[^\\x20\\x09-\\x0D]+`."""
    own = np.ones(256, bool)
    own[[0x20, *range(0x09, 0x0E)]] = False
    return own


def alphanumeric() -> np.ndarray:
    """Word bytes of the rule `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` over texts with A-Z in lower case."""
    own = np.zeros(256, bool)
    own[0x30:0x3A] = own[0x41:0x5B] = own[0x61:0x7B] = own[0x80:] = True
    return own


def folded(values: np.ndarray) -> np.ndarray:
    """Byte values under which A-Z equal a-z."""
    out = values.copy()
    out[0x41:0x5B] = out[0x61:0x7B]
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xA0761D6478BD642F)
    h ^= h >> U64(32)
    return h


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK_BYTES + 1), base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 1 << 22:
            _powers[base] = have
    return have[:n]


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair; positions of a window count from its start."""
    sums = np.empty(len(values) + 1, U64)
    sums[0] = 0
    np.cumsum(values * powers(BASE, len(values)), out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(INVERSE, len(values) + 1)[starts]


class Block(NamedTuple):
    rows: range  # rows of the batch
    data: np.ndarray  # bytes of their texts
    offsets: np.ndarray  # first byte of each row, and the number of bytes
    starts: np.ndarray  # byte positions of words
    ends: np.ndarray
    hashes: np.ndarray  # of words
    first: np.ndarray  # first word of each row, and the number of words

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def windows(self, k: int) -> np.ndarray:
        """Whether a window of k words of one row starts at a word."""
        counts = np.diff(self.first)
        return np.arange(len(self.hashes)) + k <= np.repeat(self.first[1:], counts)

    def rolled(self, k: int) -> np.ndarray:
        """Hash of the k words from each word; meaningless where `windows(k)` is false."""
        n = len(self.hashes)
        at = np.arange(n)
        return mixed(spans(self.hashes, at, np.minimum(at + k, n)))


def strings(column) -> pa.Array:
    """A text column of a batch as one array with 64-bit offsets; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    return column.cast(pa.large_string()).fill_null("")


def blocks(column, own: np.ndarray, values: np.ndarray = BYTE_VALUES) -> Iterator[Block]:
    """Cut a text column into blocks. `own`: word bytes; `values`: what a byte counts in a hash."""
    texts = strings(column)
    if not len(texts):
        return
    _, offsets_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1
        last = min(max(last, row + 1), len(texts))
        yield _block(range(row, last), data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row], own, values)
        row = last


def _block(rows: range, data: np.ndarray, offsets: np.ndarray, own: np.ndarray, values: np.ndarray) -> Block:
    n = len(data)
    inside = own[data]
    joins = inside[1:] & inside[:-1]  # a byte and the next lie in one word ...
    joins[offsets[(offsets > 0) & (offsets < n)] - 1] = False  # ... unless a text starts between them
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~joins
    ends[:-1] &= ~joins
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    hashes = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):  # long texts in slices, cut between words
        stop = max(int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, "right")), at + 1)
        low, high = starts[at], ends[stop - 1]
        hashes[at:stop] = spans(values[data[low:high]], starts[at:stop] - low, ends[at:stop] - low)
        at = stop
    first = np.searchsorted(starts, offsets)
    return Block(rows, data, offsets, starts, ends, mixed(hashes), first)
