"""Ranked search against plain Python."""

import math
import re
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coursegrid.llm import max_sketch, words

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, (text or "").translate(brute.LOWER))


def ranking(rows, items, top=10):
    """{item: [(score, doc_id), ...]} best first, equal scores by id."""
    docs = [(i, Counter(terms(t))) for i, t in rows]
    full = [c for _, c in docs if c]
    length, df = sum(c.total() for c in full), Counter(t for c in full for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms(text))
    out = {}
    for item, wanted in asked.items():
        scored = []
        for i, c in docs:
            m = 100 - 75 + 75 * c.total() * len(full) // max(1, length)
            score = sum(
                k * math.floor(1000 * math.log((2 * len(full) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, k in wanted.items()
                if c[t]
            )
            if score > 0:
                scored.append((-score, i is not None, i or 0))
        out[item] = [(-s, i if there else None) for s, there, i in sorted(scored)[:top]]
    return {item: own for item, own in out.items() if own}


def listed(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: r.rank):
        own = out.setdefault(r.item_id, [])
        assert r.rank == len(own) + 1
        own.append((r.score, r.doc_id))
    return out


ITEMS = [
    (1, "red green blue"), (2, "STONE stone river7"), (3, None), (4, "nowhere seen"), (5, "x" * 30_000 + " one"), (6, "..."),
    (None, "wood two words"), (2, "hill"), (7, " ".join(words_ + str(k) for words_ in ("red", "iron", "pink") for k in range(11))),
    (8, "straße ÄÖÜ 漢字 hunter2hunter2"),
]


@pytest.mark.parametrize("block_terms", [max_sketch.BLOCK_TERMS, 5])
def test_rows(spark, documents, rows, block_terms):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    got = max_sketch.search(documents, items, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert listed(got) == ranking(rows, ITEMS)


@pytest.mark.parametrize("seed", range(3))
def test_many_documents_with_ties(spark, monkeypatch, seed):
    """Few coordinates and small batches: loose bounds, many ties, copies, a hot word."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    odds = 1 / np.arange(1, 61)
    odds /= odds.sum()
    rows = [(int(k), " ".join(rng.choice(vocabulary, rng.integers(0, 40), p=odds))) for k in rng.permutation(600)]
    rows += [(10_000 + k, "w3 w50 w59") for k in range(300)] + [(None, "w59 w59"), (5, rows[0][1])]
    items = [(f"q{k}", " ".join(rng.choice(vocabulary, rng.integers(1, 9)))) for k in range(25)]
    monkeypatch.setattr(max_sketch, "BOUNDS", 64 * 25)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = max_sketch.search(docs, spark.createDataFrame(items, "item_id string, text string"))
    assert listed(got) == ranking(rows, items)


def test_other_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "two")], "name string, body string")
    items = spark.createDataFrame([(1, "one")], "item_id int, text string")
    got = max_sketch.search(docs, items, id_col="name", text_col="body", top=1)
    assert [(r.item_id, r.doc_id) for r in got.collect()] == [(1, "a")]
    none = max_sketch.search(docs.limit(0), items, id_col="name", text_col="body")
    assert none.collect() == [] and none.columns == got.columns
    assert max_sketch.search(docs, items.limit(0), id_col="name", text_col="body").collect() == []


def test_words_with_equal_hashes_are_told_apart():
    own, values = words.alphanumeric(), words.folded(words.BYTE_VALUES)
    known, place = max_sketch.dictionary(["alpha", "beta"])
    block = next(iter(words.blocks(pa.array(["beta Alpha gamma"]), own, values)))
    at, found = max_sketch.found(block, known)
    assert at.tolist() == [0, 1] and found.tolist() == [place["beta"], place["alpha"]]
    other = known._replace(data=np.frombuffer(bytes(known.data).replace(b"beta", b"bete"), np.uint8))
    assert max_sketch.found(block, other)[0].tolist() == [1]
