"""Cross-entropy difference: each document's loss per token under a target model less that under a background model.

Both are bigram models of one form and one vocabulary, all word types of the corpus and an end mark: a word's probability
is (c(v, w) + PRIOR * p(w)) / (c(v) + PRIOR) after v, with p(w) = (c(w) + 1) / (tokens + types). The target counts come from the
chosen documents, the background counts from all; of either a document's own counts are taken off before it is scored, so that no
text is judged by a model that has seen it. A low difference marks a text that is like the target, a low background loss
one that other documents repeat.

All words and word pairs of the whole corpus are counted (see `cells`): a chunk sends each of its different keys once, with its
counts; a bucket adds them up over the chunks and answers the totals in the order of the cell; the chunk then scores its
documents. Every bucket also tells every chunk its sums (types, tokens, target tokens), which add up to those of the corpus,
so all is one query without a stop: the texts are shuffled once, and nothing comes to the driver. Documents are scored in
slices of about `SLICE` tokens.

Defined cases: every input row gives one result row and counts as a document, repeated rows too, which see each other; null and empty texts have no
tokens and null losses; without target documents the target model is uniform; a null id is never in the target; an
empty table gives an empty result; other columns are not read. Words and pairs are compared by 63-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursegrid.llm import cells, words

PRIOR = 10.0
#: Tokens scored at once; the documents in which they lie are not cut.
SLICE = 1 << 19
U64 = np.uint64
END_WORD = U64(0x243F6A8885A308D3)
_ONE = U64(1)


def _tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, each text's followed by an end mark, their texts, and where texts with words begin.

    A text's first token comes after the end mark of the text before, as it were: the mark is the context at the start.
    """
    tokens, rows, at = [np.zeros(0, U64)], [np.zeros(0, np.int64)], 0
    for block in words.blocks(texts, words.spaced(), words.folded(words.BYTE_VALUES)):
        counts = np.diff(block.first)
        full = np.flatnonzero(counts)
        tokens.append(np.insert(block.hashes, block.first[1:][full], END_WORD))
        rows.append(np.repeat(at + full, counts[full] + 1))
        at += len(block.rows)
    rows = np.concatenate(rows)
    return np.concatenate(tokens), rows, np.flatnonzero(np.diff(rows, prepend=-1))


def _keys(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in order (words even, pairs odd), for each token the place of its word, context and pair, its text."""
    tokens, rows, starts = _tokens(texts)
    context = np.roll(tokens, 1)
    context[starts] = END_WORD
    single = words.mixed(tokens ^ U64(0xB7E1)) & ~_ONE
    pair = words.mixed(context * U64(words.BASE) + tokens) | _ONE
    keys, place = np.unique(np.concatenate([single, pair]), return_inverse=True)
    word, both = place[: len(tokens)], place[len(tokens) :]
    before = np.roll(word, 1)
    if len(starts):
        before[starts] = word[-1]  # the last token is an end mark
    return keys, word, before, both, rows


def _chosen(table: pa.Table, chosen: pa.Table) -> np.ndarray:
    """Which rows are target documents."""
    target = pc.is_in(table.column("id"), value_set=chosen.column("id").combine_chunks())
    return np.asarray(target.to_numpy(zero_copy_only=False), bool) & np.asarray(table.column("id").is_valid())


def _send(buckets: int):
    def send(table: pa.Table, chosen: pa.Table) -> pa.Table:
        keys, word, _, both, rows = _keys(table.column("text"))
        of_target = _chosen(table, chosen)[rows]
        all_ = np.bincount(word, minlength=len(keys)) + np.bincount(both, minlength=len(keys))
        own = np.bincount(word[of_target], minlength=len(keys)) + np.bincount(both[of_target], minlength=len(keys))
        at = cells.cuts(keys, buckets)
        full = np.flatnonzero(np.diff(at))
        chunk = (table.column("chunk")[0] if len(table) else chosen.column("chunk")[0]).as_py()
        return pa.table(
            {
                "chunk": pa.array([chunk] * len(full), pa.int32()),
                "bucket": pa.array(full, pa.int32()),
                "keys": pa.array([cells.packed(keys[at[b] : at[b + 1]]) for b in full], pa.binary()),
                "counts": pa.array(
                    [cells.planes(np.concatenate([all_[at[b] : at[b + 1]], own[at[b] : at[b + 1]]])) for b in full],
                    pa.binary(),
                ),
            }
        )

    return send


def _answer(chunks: int):
    def answer(table: pa.Table) -> pa.Table:
        """For each chunk, the totals of its cell of this bucket, if it has one, and the bucket's sums."""
        keys = [cells.unpacked(c.as_py()) for c in table.column("keys")]
        counts = [cells.numbers(c.as_py()).reshape(2, -1) for c in table.column("counts")]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        both = np.concatenate(counts, axis=1)
        totals = np.stack([np.bincount(place, c, len(every)) for c in both]).astype(np.int64)
        single = (every & _ONE) == 0
        cut = np.split(place, np.cumsum([len(k) for k in keys])[:-1])
        own = {c: cells.squeezed(totals[:, p].ravel()) for c, p in zip(table.column("chunk").to_pylist(), cut)}
        sums = [int(single.sum()), int(totals[0][single].sum()), int(totals[1][single].sum())]
        return pa.table(
            {
                "chunk": pa.array(range(chunks), pa.int32()),
                "bucket": pa.array([table.column("bucket")[0].as_py()] * chunks, pa.int32()),
                "totals": pa.array([own.get(c) for c in range(chunks)], pa.binary()),
                "sums": pa.array([sums] * chunks, pa.list_(pa.int64())),
            }
        )

    return answer


def _slices(rows: np.ndarray):
    """Tokens in runs of whole documents, of about SLICE tokens each."""
    low = 0
    while low < len(rows):
        last = rows[min(low + SLICE, len(rows)) - 1]
        high = int(np.searchsorted(rows, last, "right"))
        yield slice(low, high)
        low = high


def _own(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How often a token's document has its key."""
    _, place, count = np.unique((rows - rows[0]) * (keys.max() + 1) + keys, return_inverse=True, return_counts=True)
    return count[place]


def _losses(buckets: int):
    def losses(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys, word, before, both, rows = _keys(table.column("text"))
        at = cells.cuts(keys, buckets)
        total = np.zeros((2, len(keys)))
        answered = answers.filter(pc.is_valid(answers.column("bucket")))
        for b, t in zip(answered.column("bucket").to_pylist(), answered.column("totals").to_pylist()):
            if t is not None:
                total[:, at[b] : at[b + 1]] = cells.unsqueezed(t).reshape(2, -1)
        types, *tokens = (sum(x) for x in zip([0, 0, 0], *answered.column("sums").to_pylist()))
        n = np.bincount(rows, minlength=len(table))
        inside = _chosen(table, answers.filter(pc.is_valid(answers.column("id"))))
        loss = np.zeros((2, len(table)))
        for s in _slices(rows):
            r, v, w, vw = rows[s], before[s], word[s], both[s]
            own_w, own_vw = _own(r, w), _own(r, vw)
            own_v = np.roll(own_w, 1)
            own_v[np.flatnonzero(np.diff(r, prepend=-1))] = 1  # the end mark, once in each text
            for k, off in enumerate((1, inside[r])):
                p = (total[k, w] - off * own_w + 1) / (tokens[k] - off * n[r] + types)
                each = -np.log((total[k, vw] - off * own_vw + PRIOR * p) / (total[k, v] - off * own_v + PRIOR))
                loss[k, r[0] : r[-1] + 1] += np.bincount(r - r[0], each)
        out = {"doc_id": table.column("id"), "n_tokens": pa.array(n, pa.int64())}
        for name, each in zip(("background_loss", "target_loss"), loss):
            out[name] = pa.array(each / np.maximum(n, 1), pa.float64(), mask=n == 0)
        return pa.table(out)

    return losses


def score(documents: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, n_tokens, target_loss, background_loss, difference`; `target`: the ids of the target documents."""
    chunks, count = cells.dealt(documents, id_col, text_col)
    kind = chunks.schema["id"].dataType
    ids = target.select(F.col(id_col).cast(kind).alias("id")).filter("id IS NOT NULL").distinct()
    chosen = ids.select(cells.chunk_of(F.col("id"), F.lit(""), count).alias("chunk"), "id")
    sent = (
        chunks.groupBy("chunk")
        .cogroup(chosen.groupBy("chunk"))
        .applyInArrow(_send(count), "chunk int, bucket int, keys binary, counts binary")
    )
    layout = "chunk int, bucket int, totals binary, sums array<long>"
    answers = sent.groupBy("bucket").applyInArrow(_answer(count), layout)
    told = answers.unionByName(chosen, allowMissingColumns=True)  # a row has a bucket or an id
    scored = (
        chunks.groupBy("chunk")
        .cogroup(told.groupBy("chunk"))
        .applyInArrow(
            _losses(count), f"doc_id {kind.simpleString()}, n_tokens long, background_loss double, target_loss double"
        )
    )
    return scored.withColumn("difference", F.col("target_loss") - F.col("background_loss"))
