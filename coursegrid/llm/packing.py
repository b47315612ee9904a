"""Packing by non-negative least squares over length combinations.

Documents are tokenized and closed with an end id; a document is cut into pieces of `window` tokens and a rest. The number of
pieces of each length (a histogram of at most `window` bins) is all that the plan needs. Every combination of at most three
lengths that fills the window exactly is a pattern; non-negative least squares finds how often each is to be used so that the
histogram is met; the counts are rounded down to what the pieces allow, and the pieces left are packed greedily, longest
first, each into the fullest sequence that takes it.

The pieces are then numbered within their length and looked up in the plan. Numbering is done in shards of a length, with the
shards' sizes added up, so a length that half of all pieces have is not in one task. The plan has a row for each
pattern and length, at most about window^2 / 4, whatever the number of documents, and goes to all tasks.

Defined cases: a null text is empty and gives one piece, its end id; each row is packed, repeated rows each for itself; null ids
are kept; an empty table gives an empty result; other columns are not read. A special token's spelling in a text
becomes what the tokenizer makes of it.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from coursegrid.llm.shared import partitions, settled

END = 0
SWEEPS = 20
#: A block of this many bytes without, or with nothing but, white space sends a text to the plain tokenizer.
RUN = 1 << 10
#: By byte: 1 what is not white space, 2 what may be part of white space, 3 bytes outside ASCII.
_KINDS = np.array([3 if b > 0x7F else 2 if b == 0x20 or 0x09 <= b <= 0x0D else 1 for b in range(256)], np.uint8)
# Fixed value: how byte-level BPE cuts a text before merging.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)).difference(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of texts, equal to those of the tokenizer in the file.

    Its vocabulary is read into tiktoken's encoder, which merges in the same order and gives the ids as an array. Texts
    with the spelling of a special token, or with very long runs, which that encoder takes quadratic time for, go to
    the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        cut = model["pre_tokenizer"] or {}
        if model["normalizer"] or (cut["type"], cut["add_prefix_space"]) != ("ByteLevel", False):
            raise ValueError(f"{path} is not a byte-level tokenizer without a normalizer")
        self.path, self.special = path, [t["content"] for t in model["added_tokens"]]
        to_byte = _bytes_of()
        ranks = {
            bytes(to_byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.special
        }
        self.fast = tiktoken.Encoding("packing", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def plain(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        return [self._ids(t).astype("<u4", copy=False).tobytes() for t in texts]

    def _ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special) or _has_run(text):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


def _has_run(text: str) -> bool:
    """Whether some piece of a text may be longer than 2 RUN bytes: then a whole block of RUN bytes is of one kind."""
    if len(text) < RUN // 4:
        return False
    data = text.encode("utf-8", "surrogatepass")
    blocks = len(data) // RUN
    kinds = _KINDS[np.frombuffer(data, np.uint8, blocks * RUN)].reshape(blocks, RUN)
    return bool(np.bitwise_and.reduce(kinds, axis=1).any())


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _cut(path: str, window: int, keep_ids: bool):
    end = np.array([END], "<u4").tobytes()
    step = 4 * window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = []
                for i, text in enumerate(batch.column("text")):
                    ids = encoder(path).ids([text.as_py() or ""])[0] + end
                    for low in range(0, len(ids), step):
                        piece = ids[low : low + step]
                        rows.append((i, low // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece if keep_ids else None))
                c = list(zip(*rows))
                columns = [batch.column("id").take(pa.array(c[0], pa.int64()))]
                columns += [pa.array(x, pa.int64()) for x in c[1:5]] + [pa.array(c[5], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "crc", "doc_tokens", "ids"])

    return run


def combinations(window: int, lengths: list[int]) -> list[tuple[int, ...]]:
    """One, two or three of the given lengths, longest first, that add up to the window."""
    have, out = set(lengths), [(window,)] if window in lengths else []
    for a in sorted(have, reverse=True):
        if 2 * a >= window > a and window - a in have:
            out.append((a, window - a))
    for a in sorted(have, reverse=True):
        for b in range(min(a, window - a - 1), (window - a - 1) // 2, -1):
            c = window - a - b
            if b in have and c in have and c <= b:
                out.append((a, b, c))
    return out


def least_squares(patterns: list[tuple[int, ...]], histogram: dict[int, int], sweeps: int = SWEEPS) -> list[float]:
    """Non-negative repeat counts whose pieces come closest to the histogram, by cyclic coordinate descent."""
    rest = {n: float(c) for n, c in histogram.items()}
    parts = [[(n, p.count(n)) for n in dict.fromkeys(p)] for p in patterns]
    norms = [sum(m * m for _, m in own) for own in parts]
    x = [0.0] * len(patterns)
    for _ in range(sweeps):
        moved = 0.0
        for i, own in enumerate(parts):
            to = x[i] + sum(m * rest[n] for n, m in own) / norms[i]
            step = max(to, 0.0) - x[i]
            if step:
                x[i] += step
                moved = max(moved, abs(step))
                for n, m in own:
                    rest[n] -= m * step
        if moved < 0.01:
            break
    return x


def packed(window: int, histogram: dict[int, int]) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with the number of sequences that follow each; together they hold exactly the histogram's pieces."""
    left = dict(histogram)
    patterns = combinations(window, list(left))
    plan = []
    for x, p in sorted(zip(least_squares(patterns, left), patterns), key=lambda t: -t[0]):
        n = min(round(x), *(left[k] // p.count(k) for k in p))
        if n > 0:
            plan.append((p, n))
            for k in p:
                left[k] -= n
    return plan + _greedy(window, left)


def _greedy(window: int, left: dict[int, int]) -> list[tuple[tuple[int, ...], int]]:
    """Longest pieces first, each into the fullest open sequence that takes it; equal sequences are handled together."""
    open_, rooms = {}, []  # room -> {pattern: count}; the rooms in order

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = window - sum(pattern)
        if room not in open_:
            open_[room] = {}
            insort(rooms, room)
        open_[room][pattern] = open_[room].get(pattern, 0) + n

    for length in sorted(left, reverse=True):
        todo = left[length]
        while todo:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fit = window // length
                if todo >= fit:
                    put((length,) * fit, todo // fit)
                    todo %= fit
                else:
                    put((length,) * todo, 1)
                    todo = 0
                continue
            room = rooms[at]
            pattern, n = next(iter(open_[room].items()))
            used = min(n, todo)
            open_[room][pattern] -= used
            if not open_[room][pattern]:
                del open_[room][pattern]
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            put((*pattern, length), used)
            todo -= used
    return [(p, n) for group in open_.values() for p, n in group.items()]


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows of: first rank, pieces of that length in the pattern, first sequence, offset of the first."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, n in plan:
        offset = 0
        for length in dict.fromkeys(pattern):
            m = pattern.count(length)
            out.setdefault(length, []).append((used.get(length, 0), m, sequence, offset))
            used[length] = used.get(length, 0) + n * m
            offset += m * length
        sequence += n
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def _placed(where):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                rows = where.value[int(n)]
                own = np.flatnonzero(length == n)
                at = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                inside = rank[own] - at[:, 0]
                sequence[own] = at[:, 2] + inside // at[:, 1]
                offset[own] = at[:, 3] + inside % at[:, 1] * n
            names = ["id", "start", "length", "crc", "doc_tokens"]
            columns = [batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset), batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            )

    return run


def _ranked(pieces: DataFrame, shards: int) -> DataFrame:
    """Each piece's number among those of its length, from 0."""
    key = F.pmod(F.xxhash64("id", "start", "crc"), F.lit(shards)).cast("int")
    sharded = pieces.withColumn("shard", key)
    sizes = sharded.groupBy("length", "shard").agg(F.count("*").alias("size"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "shard").orderBy("id", "start", "crc")
    numbered = sharded.withColumn("number", F.row_number().over(inside))
    return numbered.join(sizes, ["length", "shard"]).withColumn("rank", F.col("before") + F.col("number") - 1)


def pack(
    documents: DataFrame,
    tokenizer: str,
    window: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """`doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids`, one row per piece.

    `ids` are the piece's little-endian 32-bit ids if `keep_ids`, else null.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    numbers = "start long, length long, crc long, doc_tokens long"
    pieces = settled(texts.mapInArrow(_cut(tokenizer, window, keep_ids), f"id {kind}, {numbers}, ids binary"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = spark.sparkContext.broadcast(places(packed(window, histogram)))
    ranked = _ranked(pieces, 2 * partitions(spark))
    layout = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return ranked.mapInArrow(_placed(where), layout)
