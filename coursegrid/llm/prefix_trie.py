"""Tries of conversation prefixes, held as double arrays.

Conversations that begin with the same turns share the nodes of those turns. The aggregates of every node tell how many conversations
run through it, where they part, and what is saved if its text is kept once.

1. Turns are addressed by 128 bits of the SHA-256 of role and text, so no text is shuffled. They are numbered within their
   conversation over ranges, and every conversation is rebuilt: the first turns of the base conversation (`base_of`), then its own.
2. A conversation is cut into pieces of `BLOCK` turns; a piece knows the prefix before it by a sum of hashes. Equal pieces after equal
   prefixes are one sequence with a count, so copies of a conversation cost one row from here on.
3. The different sequences are dealt by ranges of their turns. A task cuts its range into prefix shards of about `SHARD` turns. In a
   shard the turns get dense ids, and a double array is packed: the child of node s by turn t is slot BASE[s] + t, and
   it exists if CHECK[slot] is s. All sequences walk through the array at once and leave their counts in the nodes.
4. Sequences are in order, so a node can lie in several shards only if it is on the path of a shard's first or last sequence. Those
   upper nodes, at most two paths a shard, are merged over all shards; all others are complete within theirs.
5. Pieces beyond the first are handled first, deepest first; a piece's root hands its aggregates to the node that it continues.

Ids of conversations that end at a node are joined to strings in groups of `GROUP` ids, which are hashed in order as a stream.

Defined cases: rows without a conversation id belong to none; null roles and texts are empty; null turns come first, equal turns in
order of the hash of role and text, and rows that are equal in all are turns of their own; ids are cast to long; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coursegrid.llm.shared import numbered, partitions, settled

BLOCK = 256
SHARD = 1 << 17
GROUP = 8192
#: Places tried for the children of a node before they go behind all others.
TRIES = 32
HEADS = 5
NOTHING = hashlib.sha256(b"").hexdigest()
NODES = (
    "shared boolean, key binary, path array<binary>, parent_key binary, parent_conv long, conv long, depth int, n long, "
    "children long, leaves long, saved long, chars long, ends string, pk binary"
)


def base_of(conv: Column) -> Column:
    return conv - conv % 100


def turns_from_base(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % 6


class DoubleArray:
    """BASE and CHECK over dense ids from 0; slot 0 is the root, which is nobody's child."""

    def __init__(self) -> None:
        self.base, self.check, self.low = [0], [0], 1

    def _free(self, slot: int) -> bool:
        return slot > 0 and (slot >= len(self.check) or self.check[slot] < 0)

    def add(self, parent: int, ids: list[int]) -> None:
        """Give a node all its children; `ids` ascend."""
        while self.low < len(self.check) and self.check[self.low] >= 0:
            self.low += 1
        first = self.low
        for _ in range(TRIES):
            if all(self._free(first + i - ids[0]) for i in ids):
                break
            first += 1
        else:
            first = len(self.check)
        self.base[parent] = base = first - ids[0]
        more = base + ids[-1] + 1 - len(self.check)
        if more > 0:
            self.base += [0] * more
            self.check += [-1] * more
        for i in ids:
            self.check[base + i] = parent

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.base, np.int64), np.array(self.check, np.int64)


def pack(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BASE and CHECK of sorted sequences: sequence r is ids[first[r] : first[r] + size[r]]."""
    array, at = DoubleArray(), np.zeros(len(first), np.int64)
    for d in range(int(size.max(initial=0))):
        rows = np.flatnonzero(size > d)
        own, parent = ids[first[rows] + d], at[rows]
        new = np.ones(len(rows), bool)
        new[1:] = (own[1:] != own[:-1]) | (parent[1:] != parent[:-1])
        nodes = np.flatnonzero(new)
        cut = np.flatnonzero(np.diff(parent[nodes], prepend=-1))
        for low, high in zip(cut.tolist(), [*cut[1:].tolist(), len(nodes)]):
            array.add(int(parent[nodes[low]]), sorted(own[nodes[low:high]].tolist()))
        at[rows] = np.array(array.base, np.int64)[parent] + own
    return array.packed()


def _shard(rows: list[dict]) -> pa.RecordBatch:
    """The nodes of sorted sequences; those on the path of the first or the last one as parts of shared nodes."""
    symbols = [r["pk"] + r["seq"] for r in rows]
    size = np.array([len(s) // 16 for s in symbols], np.int64)
    first = np.cumsum(size) - size
    _, ids = np.unique(np.frombuffer(b"".join(symbols), "S16"), return_inverse=True)
    chars = np.concatenate([np.array([0, *r["chars"]], np.int64) for r in rows])
    base, check = pack(ids, first, size)

    slots = len(check)
    n, leaves, saved = (np.zeros(slots, np.int64) for _ in range(3))
    least, depth, length = np.full(slots, np.iinfo(np.int64).max), np.full(slots, -1), np.zeros(slots, np.int64)
    count, conv = np.array([r["n"] for r in rows], np.int64), np.array([r["conv"] for r in rows], np.int64)
    at, edge, paths = np.zeros(len(rows), np.int64), np.zeros(slots, bool), {0: [], len(rows) - 1: []}
    for d in range(int(size.max())):
        own = np.flatnonzero(size > d)
        slot = base[at[own]] + ids[first[own] + d]
        assert (check[slot] == at[own]).all()
        at[own] = slot
        np.add.at(n, slot, count[own])
        np.minimum.at(least, slot, conv[own])
        depth[slot], length[slot] = d, chars[first[own] + d]
        for r, path in paths.items():
            if size[r] > d:
                path.append(int(at[r]))
    for path in paths.values():
        edge[path] = True

    nodes = np.flatnonzero(depth >= 0)
    below = nodes[depth[nodes] > 0]
    children = np.bincount(check[below], minlength=slots)
    ends: dict[int, str] = {}
    for r, slot in zip(rows, at.tolist()):
        if r["b_leaves"] is not None:  # what the next piece says of the node
            children[slot], saved[slot] = r["b_children"], r["b_saved"]
            leaves[slot] = r["b_leaves"] if r["b_children"] else 0  # a node without children counts itself
        ends[slot] = r["ends"]
    kept = children.copy()  # without the children that are shared themselves
    np.subtract.at(kept, check[below[edge[below]]], 1)
    for d in range(int(depth.max()), -1, -1):
        own = nodes[(depth[nodes] == d) & ~edge[nodes]]
        leaves[own[children[own] == 0]] = 1
        saved[own] += (n[own] - 1) * length[own]
        if d:
            np.add.at(leaves, check[own], leaves[own])
            np.add.at(saved, check[own], saved[own])

    key: dict[int, tuple[bytes, list[bytes]]] = {}
    for r, path in paths.items():
        state, keys = hashlib.blake2b(digest_size=16), []
        for d, slot in enumerate(path):
            state.update(symbols[r][16 * d : 16 * d + 16])
            keys.append(state.digest())
            key[slot] = keys[-1], keys[: d + 1]

    shared, parent = edge[nodes], check[nodes]
    known = (depth[nodes] > 0) & ~edge[parent]
    pk = dict(zip(at_first(ids, first, base).tolist(), (r["pk"] for r in rows)))
    listed = nodes.tolist()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(shared),
            pa.array([key[s][0] if s in key else None for s in listed], pa.binary()),
            pa.array([key[s][1] if s in key else None for s in listed], pa.list_(pa.binary())),
            pa.array([key[p][0] if d and p in key else None for p, d in zip(parent.tolist(), depth[nodes].tolist())], pa.binary()),
            pa.array(least[parent], mask=~known),
            pa.array(least[nodes]),
            pa.array(depth[nodes].astype(np.int32)),
            pa.array(n[nodes]),
            pa.array(kept[nodes]),
            pa.array(leaves[nodes]),
            pa.array(saved[nodes]),
            pa.array(length[nodes]),
            pa.array([ends.get(s) for s in listed], pa.string()),
            pa.array([pk.get(s) for s in listed], pa.binary()),
        ],
        names=[c.split()[0] for c in NODES.split(", ")],
    )


def at_first(ids: np.ndarray, first: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The node of each sequence's first id."""
    return base[0] + ids[first]


def _shards(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, turns = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                rows.append(row)
                turns += 1 + len(row["chars"])
                if turns >= size:
                    yield _shard(rows)
                    rows, turns = [], 0
        if rows:
            yield _shard(rows)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined lists of each `sid`, whose rows follow one another in order."""
    held, state = None, None
    for batch in batches:
        out = []
        for sid, ids in zip(batch.column("sid").to_pylist(), batch.column("ids").to_pylist()):
            if sid == held:
                state.update(b",")
            else:
                if held is not None:
                    out.append((held, state.hexdigest()))
                held, state = sid, hashlib.sha256()
            state.update(ids.encode())
        yield _ended(out)
    if held is not None:
        yield _ended([(held, state.hexdigest())])


def _ended(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    columns = [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["sid", "ends"])


def rebuilt(turns: DataFrame, base: Callable[[Column], Column], taken: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns `conv, d, digest, chars`, d from 1, and `conv, total` for every conversation.

    `turns`: `conv, p, digest, chars`, p from 0. `taken` is at most HEADS.
    """
    conv = F.col("conv")
    sizes = turns.groupBy("conv").agg(F.count("*").alias("own"))
    heads = (
        turns.filter(F.col("p") < HEADS)
        .groupBy("conv")
        .agg(F.sort_array(F.collect_list(F.struct("p", "digest", "chars"))).alias("head"))
        .withColumnRenamed("conv", "base")
    )
    none = F.array().cast(heads.schema["head"].dataType)
    convs = settled(
        sizes.select("conv", "own", base(conv).alias("base"), taken(conv).cast("int").alias("h"))
        .join(heads, "base", "left")
        .select("conv", "own", "h", F.slice(F.coalesce("head", none), F.lit(1), F.col("h")).alias("head"))
    )
    total = F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    of_base = convs.select("conv", F.posexplode("head").alias("p", "t")).select(
        "conv", (F.col("p") + 1).cast("long").alias("d"), "t.digest", "t.chars"
    )
    short = convs.filter(F.size("head") < F.col("h")).select("conv", (F.col("h") - F.size("head")).alias("less"))
    own = turns.filter(F.col("p") >= taken(conv)).join(short, "conv", "left")
    own = own.select("conv", (F.col("p") + 1 - F.coalesce("less", F.lit(0))).alias("d"), "digest", "chars")
    return of_base.unionByName(own), convs.select("conv", total.cast("long").alias("total"))


def _pieces(turns: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """`conv, j, pk, npk, seq, chars`: each conversation in pieces; the last one is shorter than `block`, or empty.

    `pk` stands for all turns before the piece, `npk` for those up to its end.
    """
    cut = turns.withColumn("j", F.floor((F.col("d") - 1) / block).cast("long"))
    said = F.sort_array(F.collect_list(F.struct("d", "digest", "chars")))
    full = cut.groupBy("conv", "j").agg(said.alias("said")).select(
        "conv",
        "j",
        F.array_join(F.transform("said", lambda x: x["digest"]), "").alias("hex"),
        F.transform("said", lambda x: x["chars"].cast("long")).alias("chars"),
    )
    empty = convs.filter(F.col("total") % block == 0).select(
        "conv", F.floor(F.col("total") / block).cast("long").alias("j"), F.lit("").alias("hex"), F.array().cast("array<long>").alias("chars")
    )
    every = full.unionByName(empty)
    digest = F.md5(F.concat_ws(":", "j", "hex").cast("binary"))
    for k, part in ((0, 1), (1, 17)):
        every = every.withColumn(f"h{k}", F.conv(F.substring(digest, part, 16), 16, 10).cast("decimal(20,0)"))
    before = Window.partitionBy("conv").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("conv").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)

    def prefix(j: Column, over) -> Column:
        return F.unhex(F.md5(F.concat_ws(":", j, F.sum("h0").over(over), F.sum("h1").over(over)).cast("binary")))

    named = every.withColumn("pk", prefix(F.col("j"), before)).withColumn("npk", prefix(F.col("j") + 1, upto))
    return named.select("conv", "j", "pk", "npk", F.unhex("hex").alias("seq"), "chars")


def _sequences(pieces: DataFrame, block: int) -> DataFrame:
    """`j, pk, npk, seq, chars, n, conv, ends`: different pieces after equal prefixes, with the hash of ids that end there."""
    spread = partitions(pieces.sparkSession)
    sid = F.unhex(F.md5(F.concat("pk", "seq")))
    last = pieces.filter(F.size("chars") < block).select(sid.alias("sid"), "conv", F.floor(F.col("conv") / GROUP).alias("part"))
    listed = F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string"))
    ends = (
        last.groupBy("sid", "part").agg(F.array_join(listed, ",").alias("ids"))
        .repartition(spread, "sid").sortWithinPartitions("sid", "part")
        .select("sid", "ids").mapInArrow(_hashed, "sid binary, ends string")
    )
    counted = pieces.groupBy("j", "pk", "seq").agg(
        F.first("npk").alias("npk"), F.first("chars").alias("chars"), F.count("*").alias("n"), F.min("conv").alias("conv")
    )
    return counted.withColumn("sid", sid).join(ends, "sid", "left").drop("sid")


def _merged(nodes: DataFrame) -> DataFrame:
    """`pk, depth, conv, parent_conv, n, children, leaves, saved, ends` of all nodes, those in several shards put together."""
    parts = nodes.filter("shared").groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("path", "parent_key", "depth")],
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
        *[F.max(c).alias(c) for c in ("chars", "ends", "pk")],
        F.min("conv").alias("conv"),
    )
    parts = settled(parts)
    kids = parts.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("kids"))
    whole = parts.join(kids, "key", "left").withColumn("children", F.col("children") + F.coalesce("kids", F.lit(0)))
    own_leaf = F.when((F.col("children") == 0), 1).otherwise(0)
    sums = (
        whole.select(
            F.explode("path").alias("key"),
            (F.col("leaves") + own_leaf).alias("leaves"),
            (F.col("saved") + (F.col("n") - 1) * F.col("chars")).alias("saved"),
        )
        .groupBy("key")
        .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    )
    columns = ["pk", "depth", "conv", "parent_conv", "n", "children", "leaves", "saved", "ends", "parent_key"]
    upper = whole.drop("leaves", "saved").join(sums, "key").withColumn("parent_conv", F.lit(None).cast("long")).select(columns)
    every = upper.unionByName(nodes.filter("NOT shared").select(columns))
    above = parts.select(F.col("key").alias("parent_key"), F.col("conv").alias("above"))
    every = every.join(above, "parent_key", "left").withColumn("parent_conv", F.coalesce("parent_conv", "above"))
    return every.drop("above", "parent_key")


def tree(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    base: Callable[[Column], Column] = base_of,
    taken: Callable[[Column], Column] = turns_from_base,
    block: int = BLOCK,
    shard: int = SHARD,
) -> DataFrame:
    """`conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`: one row per node.

    A node is named by its depth and the smallest conversation that runs through it.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    said = conversations.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).alias("chars")
    ).filter("conv IS NOT NULL")
    turns, convs = rebuilt(numbered(said, ["conv"], ["turn", "digest"], "p"), base, taken)
    pieces = settled(_pieces(turns, convs, block))
    sequences = settled(_sequences(pieces, block))
    deepest = sequences.agg(F.max("j")).first()[0] or 0
    below, out = None, None
    kinds = {"b_children": "long", "b_leaves": "long", "b_saved": "long", "b_ends": "string"}
    for j in range(deepest, -1, -1):
        rows = sequences.filter(F.col("j") == j)
        if below is None:
            rows = rows.select("*", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
        else:
            # Shorter pieces have nothing below; each has a hash of its own here, as none is met.
            rows = rows.join(below, "npk", "left")
        rows = rows.select("pk", "seq", "chars", "n", "conv", F.coalesce("b_ends", "ends").alias("ends"), "b_children", "b_leaves", "b_saved")
        ranged = rows.repartitionByRange(partitions(rows.sparkSession), "pk", "seq").sortWithinPartitions("pk", "seq")
        nodes = settled(_merged(settled(ranged.mapInArrow(_shards(shard), NODES))))
        roots = nodes.filter("depth = 0")
        below = settled(
            roots.select(
                F.col("pk").alias("npk"), F.col("children").alias("b_children"), F.col("leaves").alias("b_leaves"),
                F.col("saved").alias("b_saved"), F.coalesce("ends", F.lit(NOTHING)).alias("b_ends"),
            )
        ) if j else None
        named = (nodes if j == 0 else nodes.filter("depth > 0")).select(
            F.col("conv").alias("conv_id"),
            (F.col("depth") + j * block).cast("long").alias("depth"),
            F.col("parent_conv").alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            F.col("children").alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
        )
        out = named if out is None else out.unionByName(named)
    return out
