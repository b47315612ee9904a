"""Near-duplicates by b-bit MinHash.

1. A text's set of word shingles gives `LANES` minima. Bands of minima are the candidate keys; of each minimum only `BITS` low bits
   are kept, packed into four integers. Rows and bands follow from the threshold: the most rows per band with which a pair at
   the threshold is missed with a probability of at most `MISS`.
2. Documents with equal sets form one class, named by its smallest id; only classes go on.
3. Classes that share a band key are candidates. All are first compared with one class of the key, the one that shares
   the most keys with others, which in a family of copies is close to the original. A similarity is estimated from
   equal low bits, corrected for equality by chance; pairs more than `MARGIN` below the threshold (over six standard
   deviations) are dropped inside the join, the rest is confirmed on the full sets.
4. Two classes that are already in one component need no comparison, nor do two of which one is the key's central class. For keys
   whose other classes are still in several components, the pairs of different components that could reach the threshold are
   found without listing pairs: a pair at the threshold must share a shingle among the rarest few of either set, at places that
   leave room for enough common ones (prefix and position filter), and not differ in more of the `PARITIES` than they may in
   shingles. Shingles are counted over all these classes, and pairs confirmed on the full sets. Nothing is capped; in a family
   of copies few pairs are left here.
5. Components come from the confirmed links (`components`).

Sketches are read once from the texts. Classes have numbers of their own; band keys travel in packed blocks, one per task and
range of keys. Of the texts only those of classes that may be compared travel again, one per class: a bitmap of fixed size
(`FILTER_BITS`) drops the others before the shuffle. Their shingles are kept as sorted hashes for all comparisons.

Defined cases: null and empty texts and texts without words have no shingles and are linked with nothing; texts with fewer
words than a shingle are one shingle; rows with one id are one document, linked through any of its texts, and each row has its result row; a
null id is linked with nothing, its component is null and it is kept; an empty table gives an empty result; other columns
are not read. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursegrid.llm import cells, words
from coursegrid.llm.components import components
from coursegrid.llm.shared import partitions, settled

LANES, BITS, MISS, MARGIN = 128, 2, 1e-6, 0.25
#: Rows of either side of a shared shingle that one task compares.
TILE = 512
#: Band keys that a task gathers before it sends them on, and shingles in a chunk of the rarest-shingle search.
BLOCK, CHUNK = 1 << 21, 1 << 16
#: Bits of the filter that texts pass before they are dealt out, and in one row of Spark's bitmap functions.
FILTER_BITS, BUCKET = 1 << 25, 32_768
U64 = np.uint64
U32 = np.uint32
_FACTORS = np.random.default_rng(77).integers(0, 1 << 31, LANES, dtype=U32) * U32(2) + U32(1)
_SHIFTS = np.random.default_rng(78).integers(0, 1 << 32, LANES, dtype=U32)
SIGNATURE = ["s0", "s1", "s2", "s3"]
#: Each has for 64 ranges of hashes whether a set has an odd number of shingles there: sets differ in at least as many shingles.
PARITIES = ["p0", "p1", "p2", "p3", "p4", "p5", "p6", "p7"]


def rows_per_band(threshold: float) -> int:
    fits = [r for r in range(1, 17) if (1 - threshold**r) ** (LANES // r) <= MISS]
    return max(fits, default=1)


def _different(hashes: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    out = np.sort(hashes)
    new = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out[new]


def shingle_sets(block: words.Block, size: int) -> list[np.ndarray]:
    """Sorted different shingle hashes of each row; below `size` words, one hash of them all."""
    rolled, out, shorter = block.rolled(size), [], {}
    for i in range(len(block.rows)):
        low, n = int(block.first[i]), int(block.first[i + 1] - block.first[i])
        if n >= size:
            out.append(_different(rolled[low : low + n - size + 1]))
        elif n:
            if n not in shorter:
                shorter[n] = words.mixed(block.rolled(n) ^ U64(n))
            out.append(shorter[n][low : low + 1])
        else:
            out.append(rolled[:0])
    return out


def _blocks(column) -> Iterator[words.Block]:
    return words.blocks(column, words.spaced(), words.folded(words.BYTE_VALUES))


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """LANES minima of each non-empty set, of the upper halves of its hashes."""
    flat = (np.concatenate(sets) >> U64(32)).astype(U32)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out, held = np.empty((len(sets), LANES), U64), np.empty_like(flat)
    for lane in range(LANES):
        np.multiply(flat, _FACTORS[lane], out=held)
        held += _SHIFTS[lane]
        out[:, lane] = np.minimum.reduceat(held, at)
    return out


def _low_bits(minima: np.ndarray) -> np.ndarray:
    """The low bits of each minimum, packed into 64-bit integers."""
    per = 64 // BITS
    bits = (words.mixed(minima) & U64((1 << BITS) - 1)).reshape(len(minima), -1, per)
    return np.bitwise_or.reduce(bits << (U64(BITS) * np.arange(per, dtype=U64)), axis=2)


def _band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    bands = LANES // rows
    parts = minima[:, : bands * rows].reshape(len(minima), bands, rows)
    keys = np.broadcast_to(np.arange(bands, dtype=U64), parts.shape[:2])
    for r in range(rows):
        keys = words.mixed(keys * U64(words.BASE) + parts[:, :, r])
    return keys


def _sketches(size: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch.column("text")):
                sets = shingle_sets(block, size)
                full = [i for i, s in enumerate(sets) if len(s)]
                ids = batch.column("id").slice(block.rows.start, len(block.rows))
                halves = np.zeros((len(sets), 2), np.int64)
                sign = np.zeros((len(sets), len(SIGNATURE)), np.int64)
                keys: list = [None] * len(sets)
                if full:
                    minima = _minima([sets[i] for i in full])
                    sign[full] = _low_bits(minima).view(np.int64)
                    for i, k in zip(full, _band_keys(minima, rows).view(np.int64)):
                        keys[i] = k
                        halves[i] = np.frombuffer(xxhash.xxh3_128_digest(sets[i].tobytes()), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        batch.column("print").slice(block.rows.start, len(block.rows)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(halves[:, 0]),
                        pa.array(halves[:, 1]),
                        pa.array(keys, pa.list_(pa.int64())),
                        *[pa.array(np.ascontiguousarray(sign[:, i])) for i in range(len(SIGNATURE))],
                    ],
                    names=["id", "print", "n", "d0", "d1", "keys", *SIGNATURE],
                )

    return run


def _stored(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([s.tobytes() for s in sets], pa.binary())


def _loaded(column) -> list[np.ndarray]:
    return [np.frombuffer(c.as_buffer(), U64) for c in column]


def _shingled(size: int):
    """Texts as their sets of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch.column("text")):
                nodes = batch.column("node").slice(block.rows.start, len(block.rows))
                yield pa.RecordBatch.from_arrays([nodes, _stored(shingle_sets(block, size))], names=["node", "shingles"])

    return run


def _confirmed(threshold: int):
    """Pairs whose full sets reach the threshold, in hundredths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for a, b in zip(_loaded(batch.column("set_u")), _loaded(batch.column("set_v"))):
                both = np.sort(np.concatenate([a, b]))
                common = np.count_nonzero(both[1:] == both[:-1])
                links.append(100 * common >= threshold * (len(both) - common))
            pairs = pa.RecordBatch.from_arrays([batch.column(c) for c in ("u", "v")], names=["u", "v"])
            yield pairs.filter(pa.array(links, pa.bool_()))

    return run


def _blocked(buckets: int):
    """Band keys and the classes that have them, in blocks by ranges of keys."""

    def block(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, nodes = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys)
        keys, nodes = keys[order], nodes[order]
        at = cells.cuts(keys, buckets)
        full = np.flatnonzero(np.diff(at))
        packs = [pa.array([x[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()) for x in (keys, nodes)]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *packs], names=["bucket", "keys", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            lists, nodes = batch.column("keys"), batch.column("node").to_numpy()
            keys = lists.flatten().to_numpy().view(U64)
            held.append((keys, np.repeat(nodes, lists.value_lengths().to_numpy())))
            size += len(keys)
            if size >= BLOCK:
                yield block(held)
                held, size = [], 0
        if size:
            yield block(held)

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of a range of keys, those of several classes: each class that has one, and how many have it."""
    keys = np.concatenate(_loaded(table.column("keys")))
    order = np.argsort(keys)
    keys, nodes = keys[order], np.concatenate(_loaded(table.column("nodes")))[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(starts, append=len(keys))
    size = np.repeat(sizes, sizes)
    kept = size > 1
    return pa.table({"key": keys[kept].view(np.int64), "node": nodes[kept].view(np.int64), "size": size[kept]})


def _counted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([np.zeros(0, U64), *sets]), return_counts=True)


def _send(buckets: int):
    """A chunk's different shingles with the number of its sets that have them, in cells."""

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, counts = _counted(_loaded(table.column("shingles")))
        at = cells.cuts(keys, buckets)
        full = np.flatnonzero(np.diff(at))
        return pa.table(
            {
                "chunk": pa.array([key[0].as_py()] * len(full), pa.int32()),
                "bucket": pa.array(full, pa.int32()),
                "keys": pa.array([cells.packed(keys[at[b] : at[b + 1]]) for b in full], pa.binary()),
                "counts": pa.array([cells.planes(counts[at[b] : at[b + 1]]) for b in full], pa.binary()),
            }
        )

    return send


def _add(table: pa.Table) -> pa.Table:
    """The totals of a bucket's shingles, for each cell in its order."""
    keys = [cells.unpacked(c.as_py()) for c in table.column("keys")]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([cells.numbers(c.as_py()) for c in table.column("counts")])
    totals = np.bincount(place, counts, len(every)).astype(np.int64)
    cut = np.split(place, np.cumsum([len(k) for k in keys])[:-1])
    return pa.table(
        {
            "chunk": table.column("chunk"),
            "bucket": table.column("bucket"),
            "totals": pa.array([cells.squeezed(totals[p]) for p in cut], pa.binary()),
        }
    )


def _parities(own: np.ndarray) -> np.ndarray:
    size = 64 * len(PARITIES)
    odd = np.bincount((own & U64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _prefixes(threshold: int, buckets: int):
    """Of each set, the rarest shingles that others have too, as many as a partner at the threshold must meet."""

    def prefixes(table: pa.Table, answers: pa.Table) -> pa.Table:
        sets = _loaded(table.column("shingles"))
        keys, _ = _counted(sets)
        at, totals = cells.cuts(keys, buckets), np.zeros(len(keys), np.int64)
        for b, t in zip(answers.column("bucket").to_pylist(), answers.column("totals").to_pylist()):
            totals[at[b] : at[b + 1]] = cells.unsqueezed(t)
        row, token, place = [], [], []
        for i, own in enumerate(sets):
            df = totals[np.searchsorted(keys, own)]
            order = np.lexsort((own, df))[: len(own) - -(-threshold * len(own) // 100) + 1]
            shared = np.flatnonzero(df[order] > 1)
            row.append(np.full(len(shared), i))
            token.append(own[order[shared]])
            place.append(shared)
        rows = pa.array(np.concatenate([np.zeros(0, np.int64), *row]).astype(np.int64))
        odd = np.array([_parities(s) for s in sets], np.int64).reshape(len(sets), len(PARITIES))
        return pa.table(
            {
                "token": pa.array(np.concatenate([np.zeros(0, U64), *token]).view(np.int64)),
                "place": pa.array(np.concatenate([np.zeros(0, np.int64), *place]).astype(np.int64)),
                "n": pa.array([len(s) for s in sets], pa.int64()).take(rows),
                "node": table.column("node").take(rows),
                "comp": table.column("comp").take(rows),
                **{p: pa.array(odd[:, i]).take(rows) for i, p in enumerate(PARITIES)},
            }
        )

    return prefixes


def _similar(a: str, b: str) -> Column:
    """Similarity of two packed signatures, corrected for lanes that are equal by chance."""
    even = F.lit(0x5555555555555555)
    other = F.lit(0)
    for s in SIGNATURE:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        other = other + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(even))
    chance = 1 / (1 << BITS)
    return (1 - other / LANES - chance) / (1 - chance)


def group(
    documents: DataFrame,
    shingle: int = 5,
    threshold: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept`: one row per input row.

    Linked are documents with 100 x common shingles >= `threshold` x all shingles; a component is named by its smallest id.
    """
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("print"))
    kind = texts.schema["id"].dataType.simpleString()
    rows = rows_per_band(threshold / 100)
    layout = f"id {kind}, print long, n long, d0 long, d1 long, keys array<long>, " + ", ".join(f"{s} long" for s in SIGNATURE)
    sketches = settled(texts.mapInArrow(_sketches(shingle, rows), layout))
    linked = (F.col("n") > 0) & F.col("id").isNotNull()
    sets = sketches.filter(linked)
    first = F.min(F.struct("id", "print")).alias("first")
    rest = [F.first(c).alias(c) for c in ("n", "keys", *SIGNATURE)]
    classes = sets.groupBy("d0", "d1").agg(first, F.count("*").alias("size"), *rest)
    number = F.monotonically_increasing_id().alias("node")
    classes = settled(classes.select(number, "first.*", "d0", "d1", "size", "n", "keys", *SIGNATURE))
    known = settled(_of_one_id(sets, classes))
    named = _named(classes, _labels(texts, classes, known, shingle, threshold))
    found = sketches.select("id", "n", "d0", "d1").join(named, ["d0", "d1"], "left")
    component = F.when(linked, F.coalesce("component", "id")).otherwise(F.col("id"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )


def _of_one_id(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Links `u, v` between the classes of an id that has several texts."""
    ends = [f(c).alias(f"{c}_{f.__name__}") for c in ("d0", "d1") for f in (F.min, F.max)]
    several = sets.groupBy("id").agg(*ends).filter("d0_min < d0_max OR d1_min < d1_max")
    placed = sets.select("id", "d0", "d1").join(several.select("id"), "id")
    placed = placed.join(classes.select("d0", "d1", "node"), ["d0", "d1"])
    least = placed.groupBy("id").agg(F.min("node").alias("v"))
    return placed.join(least, "id").filter("node <> v").select(F.col("node").alias("u"), "v").distinct()


def _named(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """`d0, d1, component` of the classes that are linked or of several documents: the smallest id of the component."""
    linked = labels.unionByName(labels.select(F.col("root").alias("node"), "root").distinct())
    about = classes.select("node", "id", "d0", "d1", "size").join(linked, "node", "left").filter("root IS NOT NULL OR size > 1")
    about = settled(about.withColumn("root", F.coalesce("root", "node")))
    least = about.groupBy("root").agg(F.min("id").alias("component"))
    return about.join(least, "root").select("d0", "d1", "component")


def _members(classes: DataFrame) -> DataFrame:
    """`key, node, size, pivot`: classes with each band key that they share with others, and the key's central class."""
    buckets = max(1, cells.PER_PARTITION * partitions(classes.sparkSession))
    blocks = classes.select("node", "keys").mapInArrow(_blocked(buckets), "bucket int, keys binary, nodes binary")
    near = settled(blocks.groupBy("bucket").applyInArrow(_shared, "key long, node long, size long"))
    weight = near.groupBy("node").agg(F.sum("size").alias("weight"))
    central = near.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("p"))
    return settled(near.join(central, "key").select("key", "node", "size", F.col("p.node").alias("pivot")))


def _chosen(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """`node, text` of the classes in `wanted` (`node, id, print`), one text of each; `texts`: `id, text, print`."""
    slot, bit = F.pmod("print", F.lit(FILTER_BITS)), F.pmod("print", F.lit(BUCKET))
    bucket = F.floor(slot / BUCKET).cast("int").alias("bucket")
    bits = F.broadcast(wanted.groupBy(bucket).agg(F.bitmap_construct_agg(bit).alias("bits")))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = texts.withColumn("bucket", bucket).join(bits, "bucket")
    found = found.filter(byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) > 0).select("id", "print", "text")
    one = found.join(wanted, ["id", "print"]).groupBy("id", "print", "node").agg(F.first("text").alias("text"))
    return one.select("node", "text")


def _shelf(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """`node, shingles` of the classes in `wanted`."""
    return settled(_chosen(texts, wanted).mapInArrow(_shingled(shingle), "node long, shingles binary"))


def _links(pairs: DataFrame, shelf: DataFrame, threshold: int) -> DataFrame:
    """The pairs `u, v` that reach the threshold."""
    for c in ("v", "u"):
        pairs = pairs.join(shelf.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")), c)
    return settled(pairs.mapInArrow(_confirmed(threshold), "u long, v long"))


def _near_pivots(members: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Pairs of the central class of each key with the others of the key that may reach the threshold."""
    about = classes.select("node", "n", *SIGNATURE)
    pairs = members.filter("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    pairs = pairs.join(about.alias("p"), F.col("u") == F.col("p.node")).join(about.alias("m"), F.col("v") == F.col("m.node"))
    low, high = F.least("p.n", "m.n"), F.greatest("p.n", "m.n")
    near = (100 * low >= threshold * high) & (_similar("p", "m") >= threshold / 100 - MARGIN)
    return settled(pairs.filter(near).select("u", "v"))


def _crossing(open_: DataFrame, threshold: int) -> DataFrame:
    """Pairs of different components among `node, shingles, comp` that may reach the threshold."""
    most = max(1, cells.PER_PARTITION * partitions(open_.sparkSession))
    held = open_.agg(F.sum(F.length("shingles"))).first()[0] or 0
    count = min(most, held // (8 * CHUNK) + 1)
    chunks = open_.select(cells.chunk_of(F.col("node"), F.col("node"), count).alias("chunk"), "node", "shingles", "comp")
    answers = (
        chunks.groupBy("chunk")
        .applyInArrow(_send(count), "chunk int, bucket int, keys binary, counts binary")
        .groupBy("bucket")
        .applyInArrow(_add, "chunk int, bucket int, totals binary")
    )
    layout = ", ".join(f"{c} long" for c in ("token", "place", "n", "node", "comp", *PARITIES))
    rows = settled(
        chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_prefixes(threshold, count), layout)
    )
    # The largest component of a token meets the others only, so its rows are not paired with one another. A token of many
    # rows is a rectangle of both sides, cut into tiles of at most TILE rows of either.
    by_comp = rows.groupBy("token", "comp").agg(F.count("*").alias("size"))
    of_token = by_comp.groupBy("token").agg(
        F.max(F.struct("size", "comp")).alias("m"), F.count("*").alias("comps"), F.sum("size").alias("all")
    )
    tiles = [F.ceil(n / TILE).alias(c) for n, c in ((F.col("all") - F.col("m.size"), "across"), (F.col("all"), "down"))]
    main = settled(of_token.filter("comps > 1").select("token", F.col("m.comp").alias("main"), *tiles))
    mixed = rows.join(main, "token")
    x, y = (F.pmod(F.xxhash64("node"), F.col(c)) for c in ("across", "down"))
    every_x, every_y = (F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)) for c in ("across", "down"))
    a = mixed.filter("comp <> main").withColumn("x", x).withColumn("y", every_y).alias("a")
    b = mixed.withColumn("y", y).withColumn("x", every_x).alias("b")
    # Least number of common shingles of two sets of these sizes that reaches the threshold.
    common = F.ceil(F.lit(threshold) * (F.col("a.n") + F.col("b.n")) / F.lit(100 + threshold) - F.lit(1e-9))
    differ = reduce(add, [F.bit_count(F.col(f"a.{p}").bitwiseXOR(F.col(f"b.{p}"))) for p in PARITIES])
    near = (
        (F.col("a.token") == F.col("b.token"))
        & (F.col("a.x") == F.col("b.x"))
        & (F.col("a.y") == F.col("b.y"))
        & (F.col("a.comp") != F.col("b.comp"))
        & (F.col("a.n") - F.col("a.place") >= common)
        & (F.col("b.n") - F.col("b.place") >= common)
        & (100 * F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n"))
        & (differ <= F.col("a.n") + F.col("b.n") - 2 * common)
    )
    return a.join(b, near).select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")).distinct()


def _labels(texts: DataFrame, classes: DataFrame, known: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """`node, root` of all classes that are linked with a smaller one; `known` links hold from the start."""
    members = _members(classes)
    pairs = _near_pivots(members, classes, threshold)
    # Of a key's classes, all were compared with the central one, so only the others may still have links with one another.
    others = members.filter("size > 2 AND node <> pivot").select("key", "node")
    met = [pairs.select(F.col("u").alias("node")), pairs.select(F.col("v").alias("node")), others.select("node")]
    wanted = classes.select("node", "id", "print").join(met[0].union(met[1]).union(met[2]).distinct(), "node")
    shelf = _shelf(texts, wanted, shingle)
    labels = components(_links(pairs, shelf, threshold).unionByName(known))
    named = others.join(labels, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    mixed = named.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a < b").select("key")
    open_ = settled(shelf.join(named.join(mixed, "key", "left_semi").select("node", "comp").distinct(), "node"))
    more = _links(_crossing(open_, threshold), open_, threshold)
    if more.isEmpty():
        return labels
    return components(labels.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))


def clean(documents: DataFrame, shingle: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows and columns with one document of each component."""
    gone = group(documents, shingle, threshold, id_col, text_col).filter("NOT kept").select("doc_id").distinct()
    row = documents.alias("row")
    return row.join(gone.alias("gone"), F.col(f"row.{id_col}") == F.col("gone.doc_id"), "left_anti")
