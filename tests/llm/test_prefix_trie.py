"""Tries of conversation prefixes against plain Python."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursegrid.llm import prefix_trie


def digest(role, text):
    return sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def nodes(rows):
    """Every node's row, from turns (conv, turn, role, text)."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    said = {c: [t[3:] for t in sorted(own)] for c, own in convs.items()}
    rebuilt = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        rebuilt[c] = tuple(said.get(base, [])[:h] + own[h:])
    through = {}
    for c, own in rebuilt.items():
        for d in range(len(own) + 1):
            through.setdefault(own[:d], []).append(c)
    out = []
    for path, members in through.items():
        under = [p for p in through if p[: len(path)] == path]
        children = lambda p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in through)
        ends = sorted(c for c in members if rebuilt[c] == path)
        out.append(
            (
                min(members), len(path), min(through[path[:-1]]) if path else None, len(members), children(path),
                sum(children(p) == 0 for p in under), sum((len(through[p]) - 1) * len(p[-1][1]) for p in under if p),
                sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=lambda r: r[:2])


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(frame):
    assert frame.columns == NAMES
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: r[:2])


def talk(seed, convs=120, longest=14):
    """Conversations over few turns, so that prefixes are shared, with copies, gaps, nulls and repeated rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(0, convs), *range(1000, 1010), -250, -200, 10**15]:
        n = int(rng.integers(0, longest))
        for turn in range(n):
            text = rng.choice(["", "hi", "how are you", "漢字 🙂"], p=[0.1, 0.6, 0.2, 0.1]) if turn else "hello"
            rows.append((int(c), turn, "user" if turn % 2 else "bot", str(text)))
    rows += [(c, t, "user", "the same talk") for c in range(400, 460) for t in range(9)]
    rows += [(5000, None, None, "x"), (5000, None, "a", None), (5000, 3, "a", "b"), (5000, 3, "a", "b"), (None, 1, "a", "b")]
    rows += [(5001, t, "user", f"long {t}") for t in range(40)] + [(5002, t, "user", f"long {t}") for t in range(33)]
    return rows


LAYOUT = "conv_id long, turn int, role string, text string"


@pytest.mark.parametrize("block, shard", [(256, 1 << 17), (256, 40), (12, 1), (16, 1 << 17)])
def test_nodes(spark, block, shard):
    rows = talk(block + shard)
    frame = spark.createDataFrame(rows, LAYOUT).repartition(3)
    for name in ("conv", "d", "j", "pk", "key", "digest", "p", "_range", "a.b"):
        frame = frame.withColumn(name, F.lit("x"))
    assert got(prefix_trie.tree(frame, block=block, shard=shard)) == nodes(rows)


def test_turnless_conversations_and_empty_tables(spark):
    frame = spark.createDataFrame([(7, 0, "a", "b"), (8, 0, "a", "b")], LAYOUT)  # no base, fewer turns than are taken from it
    assert got(prefix_trie.tree(frame)) == nodes([(7, 0, "a", "b"), (8, 0, "a", "b")])
    assert prefix_trie.tree(frame.limit(0)).collect() == []
    assert prefix_trie.tree(frame.withColumn("conv_id", F.lit(None).cast("long"))).collect() == []


def test_long_texts_and_other_names(spark):
    rows = [(c, t, "user", "x" * 100_000 + str(t)) for c in (1, 2, 3) for t in range(8)]
    frame = spark.createDataFrame(rows, "talk int, nr int, who string, said string")
    found = prefix_trie.tree(frame, "talk", "nr", "who", "said")
    assert got(found) == nodes(rows)


def test_double_array_walks():
    rng = np.random.default_rng(1)
    found = sorted({tuple(rng.integers(0, 30, rng.integers(1, 9)).tolist()) for _ in range(3000)})
    size = np.array([len(s) for s in found])
    ids, first = np.concatenate([np.array(s) for s in found]), np.cumsum(size) - size
    base, check = prefix_trie.pack(ids, first, size)
    slots = {}
    for s in found:
        at = 0
        for d, i in enumerate(s):
            to = base[at] + i
            assert to > 0 and check[to] == at
            at = to
            assert slots.setdefault(at, s[: d + 1]) == s[: d + 1]  # a slot is one prefix
    assert len(slots) == len({s[:d] for s in found for d in range(1, len(s) + 1)}) == (check >= 0).sum() - 1


def test_ids_are_listed_in_groups(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "GROUP", 7)
    rows = [(c, 0, "a", "b") for c in range(-40, 200)]
    assert got(prefix_trie.tree(spark.createDataFrame(rows, LAYOUT))) == nodes(rows)
