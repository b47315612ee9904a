"""Benchmark decontamination by winnowing.

Every text is cut into words; the hash of each run of `GRAM` words is a k-gram, and of each `SLIDE` consecutive k-grams the
smallest hash is kept. Two texts that share `GRAM + SLIDE - 1` = `span` words in a row therefore share a kept hash inside that
run. Kept hashes of documents are joined with those of the benchmark, and each joint hash is extended to both sides over
equal words: with at least `span` words, all of them are hit. An item with fewer words is one window of all its words; for
each such length the documents' runs of that length are all compared.

The documents are read once and their texts are not shuffled: a kept hash travels with the few words around it, all that the
extension can need. Before that, hashes that the benchmark does not have are dropped by a bitmap of fixed size
(`FILTER_BITS`, 1 MiB) that Spark builds from the benchmark; it lets through some others, which the join drops. Documents
without any hash keep one row under a hash of their own, so no key gathers them. The words themselves are compared, so
equal hashes of different words do no harm.

Defined cases: rows equal in id and text are one document; null and empty texts have no words and are not contaminated; a null
id is kept as null; equal items count once per id, and an item without an id marks words but counts as no item; an empty
benchmark hits nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursegrid.llm import words
from coursegrid.llm.shared import settled

GRAM = 5
FILTER_BITS = 1 << 23
#: Bits in one row of Spark's bitmap functions.
BUCKET = 32_768

PRINTS = "digest long, n_words long, gram int, print long, at int, before array<string>, run string, after array<string>"


def _kept(block: words.Block, gram: int, slide: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the smallest of each `slide` consecutive k-grams (the last of equal ones)."""
    h = block.rolled(gram)
    n = max(len(h) - slide + 1, 0)
    least, at = h[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, slide):
        lower = h[k : k + n] <= least
        least[lower] = h[k : k + n][lower]
        at[lower] = k
    starts = np.flatnonzero(block.windows(gram + slide - 1)[:n])
    marked = np.zeros(len(h), bool)
    marked[starts + at[starts]] = True
    found = np.flatnonzero(marked)
    return found, h[found]


def _runs(block: words.Block, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all runs of `gram` words."""
    found = np.flatnonzero(block.windows(gram))
    return found, block.rolled(gram)[found]


def _word(block: words.Block, i: int) -> str:
    return block.word(i).lower().decode("utf-8", "replace")  # bytes.lower() changes A-Z alone


def _prints(span: int, short: list[int] | None, bits: bytes | None):
    """Kept hashes with the words around them as rows; one row without a hash for a text that has none.

    `short`: lengths of which every run is kept, under the length as a negative number; None for benchmark items, which
    have at most one such run, that of all their words. `bits`: hashes worth keeping, or None for all.
    """
    gram = min(GRAM, span)
    slide = span - gram + 1
    flags = None if bits is None else np.frombuffer(bits, np.uint8)

    def of_block(block: words.Block) -> Iterator[tuple]:
        counts = np.diff(block.first)
        lengths = sorted(set(counts[(counts > 0) & (counts < span)].tolist())) if short is None else short
        for length in [gram, *(-n for n in lengths)]:
            at, h = _kept(block, gram, slide) if length > 0 else _runs(block, -length)
            h = words.mixed(h ^ words.U64(abs(length) + 1000 * (length < 0)))  # lengths do not meet
            doc = np.searchsorted(block.first, at, "right") - 1
            chosen = np.ones(len(at), bool)
            if length < 0 and short is None:
                chosen = counts[doc] == -length
            if flags is not None:
                bit = (h % words.U64(FILTER_BITS)).astype(np.int64)
                chosen &= (flags[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
            reach = slide - 1 if length > 0 else 0
            for i, d, p in zip(at[chosen].tolist(), doc[chosen].tolist(), h[chosen].view(np.int64).tolist()):
                low, high = int(block.first[d]), int(block.first[d + 1])
                start = max(low, i - reach)
                near = [_word(block, j) for j in range(start, min(high, i + abs(length) + reach))]
                own = i - start
                yield d, length, p, i - low, near[:own][::-1], " ".join(near[own : own + abs(length)]), near[own + abs(length) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column("text"), words.alphanumeric(), words.folded(words.BYTE_VALUES)):
                counts = np.diff(block.first)
                rows = list(of_block(block))
                bare = set(range(len(block.rows))) - {r[0] for r in rows}
                rows += [(d, 0, None, None, None, None, None) for d in sorted(bare)]
                columns = list(zip(*rows))
                at = pa.array([block.rows.start + d for d in columns[0]], pa.int64())
                digests = batch.column("digest").take(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(at),
                        digests,
                        pa.array(counts[list(columns[0])], pa.int64()),
                        pa.array(columns[1], pa.int32()),
                        # a row without a hash goes by its own digest, so that no key gathers such rows
                        pc.coalesce(pa.array(columns[2], pa.int64()), digests),
                        pa.array(columns[3], pa.int32()),
                        pa.array(columns[4], pa.list_(pa.string())),
                        pa.array(columns[5], pa.string()),
                        pa.array(columns[6], pa.list_(pa.string())),
                    ],
                    names=["id", "digest", "n_words", "gram", "print", "at", "before", "run", "after"],
                )

    return run


def _keyed(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts.select(
        F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text")
    )


def _prints_of(texts: DataFrame, id_col: str, text_col: str, span: int, short, bits) -> DataFrame:
    keyed = _keyed(texts, id_col, text_col)
    kind = keyed.schema["id"].dataType.simpleString()
    return keyed.mapInArrow(_prints(span, short, bits), f"id {kind}, {PRINTS}")


def digest(text: Column) -> Column:
    """With the id, what makes rows one document."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _bitmap(prints: DataFrame) -> bytes:
    """One bit for each hash modulo `FILTER_BITS`; at most FILTER_BITS / BUCKET rows of a fixed size come to the driver."""
    slot = F.pmod("print", F.lit(FILTER_BITS))
    rows = (
        prints.groupBy(F.floor(slot / BUCKET).cast("int").alias("bucket"))
        .agg(F.bitmap_construct_agg(slot % BUCKET).alias("bits"))
        .collect()
    )
    out = bytearray(FILTER_BITS // 8)
    for row in rows:
        out[row["bucket"] * BUCKET // 8 : (row["bucket"] + 1) * BUCKET // 8] = row["bits"]
    return bytes(out)


def _equal_words(a: str, b: str) -> Column:
    """Number of equal words at the start of two lists."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_other = F.array_position(same, False)
    return F.when(first_other == 0, F.size(same)).otherwise(first_other.cast("int") - 1)


def _covered(runs: Column) -> Column:
    """Number of words in the union of [start, end) runs."""
    state = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, x: Column) -> Column:
        more = F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["to"]))
        return F.struct(F.greatest(s["to"], x["end"]).alias("to"), (s["n"] + more).alias("n"))

    return F.aggregate(F.array_sort(runs), state, step, lambda s: s["n"])


def hits(
    documents: DataFrame,
    benchmark: DataFrame,
    span: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """`doc_id, digest, n_words, n_hit, n_items, items, runs, contaminated`: one row per document.

    `runs` are the hit runs of words, `items` the ids, as text, of the items with a window in the document.
    """
    items = settled(_prints_of(benchmark, item_col, item_text_col, span, None, None).filter("gram <> 0"))
    short = sorted(-r["gram"] for r in items.filter("gram < 0").select("gram").distinct().collect())  # below `span` each
    shared = items.groupBy("gram", "print", "run", "before", "after").agg(
        F.collect_set(F.col("id").cast("string")).alias("items")
    )
    prints = _prints_of(documents, id_col, text_col, span, short, _bitmap(items))
    d, b = prints.alias("d"), shared.alias("b")
    on = [F.col(f"d.{c}") == F.col(f"b.{c}") for c in ("print", "gram", "run")]
    met = d.join(b, on, "left").select(
        "d.id", "d.digest", "d.n_words", "d.gram", "d.at", "b.items",
        _equal_words("d.before", "b.before").alias("left"),
        _equal_words("d.after", "b.after").alias("right"),
    )
    long = F.col("left") + F.col("gram") + F.col("right") >= span
    run = F.struct(
        (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.abs("gram") + F.col("right")).alias("end")
    )
    hit = F.col("items").isNotNull() & ((F.col("gram") < 0) | long)
    of_doc = met.groupBy("id", "digest").agg(
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(hit, run)).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("items")))))).alias("items"),
    )
    return of_doc.select(
        F.col("id").alias("doc_id"),
        "digest",
        "n_words",
        _covered(F.col("runs")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        "runs",
        (F.size("runs") > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input rows and columns without the contaminated documents."""
    found = hits(documents, benchmark, id_col=id_col, text_col=text_col, **options).filter("contaminated")
    row, bad = documents.alias("row"), found.select("doc_id", "digest").alias("bad")
    same = F.col(f"row.{id_col}").eqNullSafe(F.col("bad.doc_id")) & (digest(F.col(f"row.{text_col}")) == F.col("bad.digest"))
    return row.join(bad, same, "left_anti")
