"""What near-duplicate search moves: rows of repeated ids, of families of copies, and of texts that need no comparison."""

import random
import re

import brute
import numpy as np
import pytest

from coursegrid.llm import components, near_dup


@pytest.fixture
def steps(monkeypatch):
    """Rows of each step that is written down."""
    found = []

    def counted(frame, real=near_dup.settled):
        out = real(frame)
        found.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(near_dup, "settled", counted)
    monkeypatch.setattr(components, "settled", counted)
    return found


def _words(seed, n):
    rnd = random.Random(seed)
    return [f"{rnd.choice('abcdefgh')}{rnd.randrange(500)}" for _ in range(n)]


def _changed(words, seed, share):
    rnd = random.Random(seed)
    return [f"new{rnd.randrange(10**6)}" if rnd.random() < share else w for w in words]


def _found(spark, texts):
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    return {r.doc_id: r.component_id for r in near_dup.group(frame, 3, 85).collect()}


def test_rows_that_repeat_are_compared_once(spark, steps):
    """Two near copies, each in 30 equal rows: one pair, where all rows of one id were paired with all of the other."""
    base = _words(1, 300)
    texts = [(1, base)] * 30 + [(2, [*base, "end"])] * 30 + [(3, _words(2, 300))]
    assert _found(spark, texts) == {1: 1, 2: 1, 3: 3}
    links = [n for columns, n in steps if columns == ["u", "v"]]
    assert max(links) == 1


def test_an_id_with_many_texts(spark, steps):
    """25 band keys for each text, where there were so many for each two texts of the id."""
    base = _words(3, 200)
    texts = [(7, [*base, f"end{k}"]) for k in range(40)] + [(k, [*base, f"more{k}"]) for k in (3, 9)] + [(8, _words(4, 200))]
    assert _found(spark, texts) == brute.components([(i, " ".join(w)) for i, w in texts], 3, 85)
    bands = near_dup.LANES // near_dup.rows_per_band(0.85)
    assert max(n for _, n in steps) <= bands * len(texts)


def test_no_second_search_for_two_that_were_compared(spark, monkeypatch):
    """Pairs that share a band key but not enough shingles are compared in the first search and need no other."""
    opened = []

    def crossing(open_, *more, real=near_dup._crossing):
        opened.append(open_.count())
        return real(open_, *more)

    monkeypatch.setattr(near_dup, "_crossing", crossing)
    texts = [(2 * k + j, _changed(_words(k, 200), f"{k}.{j}", 0.045 * j)) for k in range(40) for j in (0, 1)]
    assert _found(spark, texts) == brute.components([(i, " ".join(w)) for i, w in texts], 3, 85)
    assert opened == [0]


def test_parities_differ_in_no_more_than_the_sets():
    rnd = np.random.default_rng(9)
    for n, other in ((1, 0), (20, 3), (400, 60), (400, 130), (5000, 900)):
        a = near_dup._different(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        b = near_dup._different(np.concatenate([a[other // 2 :], rnd.integers(0, 1 << 63, other, dtype=np.uint64)]))
        differ = sum(int(x).bit_count() for x in (near_dup._parities(a) ^ near_dup._parities(b)).view(np.uint64))
        most = len(np.setxor1d(a, b))
        assert most // 2 <= differ <= most if n < 1000 else differ <= most


def test_family_of_copies(spark):
    """Copies of all degrees, of which many reach the threshold through others only."""
    base = _words(5, 250)
    texts = [(k, _changed(base, f"x{k}", (k % 12) / 150)) for k in range(1, 150)]
    texts += [(200 + k, _changed(texts[100 + k][1], f"y{k}", 0.02)) for k in range(40)]
    assert _found(spark, texts) == brute.components([(i, " ".join(w)) for i, w in texts], 3, 85)


def test_texts_pass_the_filter_before_they_are_dealt_out(spark):
    """Only texts of the wanted classes reach the shuffle: the join on the bitmap's rows comes below it."""
    texts = spark.createDataFrame([(k, f"text {k} of many", k * 3) for k in range(-200, 200)], "id long, text string, print long")
    wanted = spark.createDataFrame([(0, 5, 15), (1, -7, -21), (2, 199, 597)], "node long, id long, print long")
    shelf = near_dup._shelf(texts, wanted, 3)
    got = {r.node: [int.from_bytes(r.shingles[k : k + 8], "little") for k in range(0, len(r.shingles), 8)] for r in shelf.collect()}
    assert sorted(got) == [0, 1, 2] and all(len(s) == 2 and s == sorted(s) for s in got.values())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = near_dup._chosen(texts, wanted)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchange = re.search(r"\n[^\n]*Exchange hashpartitioning\(id[^\n]*\n(?:[^\n]*\n)*?[^\n]*BroadcastHashJoin \[bucket", plan)
    assert exchange
