"""Toxicity scores by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is put in lower case, white space becomes blanks, and its character n-grams of 3 to 6 are hashed to `SLOTS` features that are
present or absent; that an n-gram comes twice, or three times, in a text is a feature of its own, since a part of a word that
other texts have once by chance can fill a text of label 1. On labelled texts each feature's ratio is log((df1 + a) / (n1 + 2a)) - log((df0 + a) / (n0 + 2a)); features
whose ratio lies `NOISE` standard errors from 0 are kept, at most `FEATURES` by that distance. A logistic regression on
presence times ratio, with a quadratic penalty and more weight on the rarer label, run until its gradient is small, gives the weights. The score is its probability for label 1.

Fitting is bounded: at most `SAMPLE` labelled rows, chosen by a hash of the id, evenly over all ids; the list of chosen ids is
therefore small enough to be sent to all tasks. Feature counts are added up in Spark, SLOTS numbers of each label whatever the
texts; then only the kept features of the chosen texts come to the driver. Scoring is one pass over the whole texts with a
table of SLOTS weights.

Defined cases: each input row gives one row; a null text is empty; an empty text has the score of no features; without labelled
rows of both kinds the score is the share of label 1 (0 without any) and no text is predicted above it by features; a document with several
labels counts as 1 if any is, one with several texts is learnt from the smallest of them; rows without id or label are not
learnt from; an empty table gives an empty result; other columns are not read. Ids, languages and sources are no features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: These lengths, NOISE, PENALTY and RARE_WEIGHT were chosen by language, on four parts of the rows that are not held out.
GRAMS = (3, 4, 5, 6)
SLOTS = 1 << 20
#: How often an n-gram comes at least, and what then turns its slot into another one.
TIMES = ((2, 0x5A3C7), (3, 0xB4D19))
#: Slots in one row of counts.
PART = 1 << 14
SAMPLE = 16_000
FEATURES = 4_096
NOISE = 4.5
SMOOTHING = 1.0
PENALTY = 1e-3
#: What a row of label 1, the rarer one, counts in the regression.
RARE_WEIGHT = 2.0
#: The regression ends at a gradient of this length. ROUNDS of Newton and STEPS of conjugate gradients in each are only bounds.
SMALL = 1e-7
ROUNDS, STEPS = 100, 500
#: Characters of text handled at once.
BLOCK = 1 << 18
PAD = " " * max(GRAMS)


class Model(NamedTuple):
    weights: np.ndarray  # by slot
    bias: float


def _blocks(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, code points of some rows with blanks between them, and the row of each code point."""
    row = 0
    while row < len(texts):
        parts, size, first = [], 0, row
        while row < len(texts) and (not parts or size < BLOCK):
            parts.append(PAD[:1] + texts[row].lower() + PAD)
            size += len(parts[-1])
            row += 1
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").copy()
        codes[(codes >= 9) & (codes <= 13)] = 32
        yield first, codes, np.repeat(np.arange(row - first), [len(p) for p in parts])


def _slots(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each n, the slot of the n-gram that starts at each code point. Some run from one text into the next."""
    # Fixed odd multipliers of the hash.
    step, spread = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    wide = codes.astype(np.uint64)
    h = wide.copy()
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * step + wide[n - 1 :]
        if n in GRAMS:
            mixed = h ^ (h >> np.uint64(31))
            mixed *= spread
            yield n, (mixed >> np.uint64(64 - 20)).astype(np.int64)


def _inside(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Those of the n-grams that end in the text in which they start."""
    return at[rows[at] == rows[at + n - 1]]


def _keys(found: list[np.ndarray]) -> np.ndarray:
    """Sorted different keys, row * SLOTS + slot, of all n-grams and of those that come several times."""
    keys = np.sort(np.concatenate(found))
    more = [keys[k - 1 :][keys[k - 1 :] == keys[: len(keys) - k + 1]] ^ other for k, other in TIMES]
    every = np.sort(np.concatenate([keys, *more]))
    return every[np.diff(every, prepend=-1) != 0]


def features(texts: list[str]) -> Iterator[np.ndarray]:
    """Sorted different slots of each text."""
    for _, codes, rows in _blocks(texts):
        found = []
        for n, s in _slots(codes):
            at = _inside(rows, np.arange(len(s)), n)
            found.append(rows[at] * SLOTS + s[at])
        keys = _keys(found)
        yield from np.split(keys % SLOTS, np.searchsorted(keys, np.arange(1, rows[-1] + 1) * SLOTS))


def scores(texts: list[str], model: Model) -> np.ndarray:
    out = np.full(len(texts), model.bias)
    weighty = model.weights != 0
    used = weighty.copy()
    for _, other in TIMES:
        used |= weighty[np.arange(SLOTS) ^ other]
    for first, codes, rows in _blocks(texts):
        found = []
        for n, s in _slots(codes):
            at = _inside(rows, np.flatnonzero(used[s]), n)
            found.append(rows[at] * SLOTS + s[at])
        keys = _keys(found)
        n = int(rows[-1]) + 1
        out[first : first + n] += np.bincount(keys // SLOTS, model.weights[keys % SLOTS], n)
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def held_out(id_col: str) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _ratios(df: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratios of all slots, and the kept slots in order. `df`: texts with each slot, by label; `n`: texts."""
    a = SMOOTHING
    ratio = np.log((df[1] + a) / (n[1] + 2 * a)) - np.log((df[0] + a) / (n[0] + 2 * a))
    clear = np.abs(ratio) / np.sqrt(1 / (df[1] + a) + 1 / (df[0] + a))
    kept = np.flatnonzero((clear >= NOISE) & (df[0] + df[1] > 1))
    return ratio, np.sort(kept[np.argsort(-clear[kept], kind="stable")[:FEATURES]])


def _regression(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Logistic regression with a quadratic penalty, by Newton steps that conjugate gradients solve."""
    n, weight = len(y), np.where(y > 0, RARE_WEIGHT, 1.0)
    w = np.append(np.zeros(width), np.log(weight[y > 0].sum() / weight[y == 0].sum()))  # the bias is last
    penalty = np.append(np.full(width, PENALTY), 0.0)

    def along(v: np.ndarray) -> np.ndarray:
        return np.bincount(rows, values * v[columns], n) + v[-1]

    def back(e: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(columns, values * e[rows], width), e.sum())

    def loss(v: np.ndarray) -> float:
        z = along(v)
        return (weight * (np.logaddexp(0, z) - y * z)).sum() / n + (penalty * v * v).sum() / 2

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(along(w), -500, 500)))
        slope = back(weight * (p - y)) / n + penalty * w
        length = np.linalg.norm(slope)
        if length < SMALL:
            break
        curve, step, left = weight * p * (1 - p) / n, np.zeros_like(w), -slope
        way, size = left.copy(), left @ left
        for _ in range(STEPS):
            bent = back(curve * along(way)) + penalty * way
            far = size / (way @ bent)
            step, left = step + far * way, left - far * bent
            before, size = size, left @ left
            if size**0.5 < min(0.1, length**0.5) * length:
                break
            way = left + size / before * way
        now, share = loss(w), 1.0
        while share > 1e-9 and loss(w + share * step) > now + 1e-4 * share * (slope @ step):
            share /= 2
        w = w + share * step
    return w[:-1], float(w[-1])


def constant(share: float) -> Model:
    return Model(np.zeros(SLOTS), float(np.log((share + 1e-9) / (1 - share + 1e-9))))


def fitted(ratio: np.ndarray, kept: np.ndarray, marks: list[np.ndarray], labels: list[int]) -> Model:
    """`marks`: for each text, which of the kept slots it has, as places among them."""
    y = np.array(labels, float)
    rows = np.repeat(np.arange(len(y)), [len(m) for m in marks])
    columns = np.concatenate(marks).astype(np.int64)
    w, bias = _regression(rows, columns, ratio[kept][columns], y, len(kept))
    weights = np.zeros(SLOTS)
    weights[kept] = w * ratio[kept]
    return Model(weights, bias)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each slot, by label, of one task: a compressed row for each PART slots, and the number of texts."""
    df, n = np.zeros((2, SLOTS), np.int32), [0, 0]
    for batch in batches:
        for label, own in zip(batch.column("label").to_pylist(), features(_texts(batch))):
            df[label][own] += 1
            n[label] += 1
    if any(n):
        parts = [zlib.compress(df[:, low : low + PART].tobytes(), 1) for low in range(0, SLOTS, PART)]
        parts.append(zlib.compress(np.array(n, np.int32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts)], names=["part", "df"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(c), np.int32) for c in table.column("df").to_pylist())
    return pa.table({"part": table.column("part").slice(0, 1), "df": pa.array([zlib.compress(total.tobytes(), 1)])})


def _mark(kept):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [np.flatnonzero(np.isin(kept.value, f, assume_unique=True)) for f in features(_texts(batch))]
            marks = pa.array([m.astype("<u4").tobytes() for m in marks], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("label"), marks], names=["label", "marks"])

    return run


def train(
    documents: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Fit on at most `sample` labelled rows that are not held out."""
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .filter("id IS NOT NULL AND label IS NOT NULL")
        .filter(~held_out("id"))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    learnt = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    learnt = learnt.select((F.col("label") > 0).cast("int").alias("label"), "text")
    counts = learnt.mapInArrow(_count, "part int, df binary").groupBy("part").applyInArrow(_add, "part int, df binary")
    parts = [np.frombuffer(zlib.decompress(r["df"]), np.int32) for r in counts.orderBy("part").collect()]
    n = parts.pop() if parts else np.zeros(2)
    if n.min() == 0:
        return constant(n[1] / max(1, n.sum()))
    ratio, kept = _ratios(np.concatenate([p.reshape(2, PART) for p in parts], axis=1).astype(float), n)
    sent = documents.sparkSession.sparkContext.broadcast(kept)
    rows = learnt.mapInArrow(_mark(sent), "label int, marks binary").collect()
    return fitted(ratio, kept, [np.frombuffer(r["marks"], "<u4") for r in rows], [r["label"] for r in rows])


def score(documents: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The input rows and columns, in order, with the score."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            found = pa.array(scores(texts, sent.value))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "score"])

    plain = documents.toDF(*[f"c{i}" for i in range(len(documents.columns))])  # any column name may come in
    scored = plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("score", DoubleType())]))
    return scored.toDF(*documents.columns, score_col)


def clean(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, training: DataFrame | None = None) -> DataFrame:
    """The input rows and columns whose score is below the threshold."""
    model = train(documents if training is None else training, labels)
    name = "score"
    while name in documents.columns:
        name += "_"
    return score(documents, model, score_col=name).filter(F.col(name) < threshold).drop(name)
