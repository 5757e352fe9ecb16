"""Merkle dataset manifest: bitmap ranks give every leaf its coordinates, keyed slot arrays reduce the levels.

Each task turns its rows' ids into compressed bitmaps, one for each group and run of RUN ids; bitmaps of one run are
merged, and running sums over the bitmaps' counts make the directory: how many rows of the group come before a run. A
row's place in its group is that number plus the bits below its own, counted with a directory of popcounts by word, so
that no leaves are sorted. Leaves then go to slot arrays keyed by (group, place / 4096) and each array reduces its
levels in one task; the arrays' tops are the next leaves, until one node a group is left, and the groups' nodes go the
same way. On the way back every array meets the siblings above it once and gives each of its leaves the whole proof.
Only thin rows (id and digests) are ever shuffled; an array, a bitmap and a path have fixed sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlane.llm.common import bounds, materialise, partitions_for

#: Children of a node, levels that one slot array reduces, and its slots.
ARITY, LEVELS = 8, 4
SLOTS = ARITY**LEVELS
#: Ids of a bitmap; from so many ids on it is stored as bits, below as sorted 16-bit numbers. A run is what one task takes
#: at a time.
RUN_BITS = 13
RUN, DENSE = 1 << RUN_BITS, (1 << RUN_BITS) // 16
#: The run of null ids: below that of every 64-bit id.
NULL_RUN = -(1 << 62)
#: Rows of running totals or of groups up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of a row (id, digests) while it is shuffled.
ROW_BYTES, BYTES_PER_PARTITION = 160, 128 << 20
NO_STEPS = "cast(array() as array<struct<at:int,others:binary>>)"


def digest(children: bytes) -> bytes:
    """Hex digest of the children's hex digests, one after the other."""
    return sha256(children).hexdigest().encode()


def field(value: Column) -> Column:
    """What a leaf's hash takes in for a column: `-` for null, else the UTF-8 byte count, a colon, the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)).cast("binary"), 256))


# -- compressed bitmaps -----------------------------------------------------------------------------------------------

def pack(lows: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """(bitmap, repeats) of sorted distinct numbers below RUN: the bitmap as bits or as the numbers themselves, whichever is
    shorter; repeats as pairs (number, count) of those counted more than once."""
    many = counts > 1
    repeats = np.stack([lows[many], counts[many]], 1).astype("<i8").tobytes()
    if len(lows) < DENSE:
        return lows.astype("<u2").tobytes(), repeats
    bits = np.zeros(RUN, bool)
    bits[lows] = True
    return np.packbits(bits, bitorder="little").tobytes(), repeats


def unpack(bitmap: bytes, repeats: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lows, counts) of a packed bitmap."""
    if len(bitmap) == RUN // 8:
        lows = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little"))
    else:
        lows = np.frombuffer(bitmap, "<u2").astype(np.int64)
    counts = np.ones(len(lows), np.int64)
    pairs = np.frombuffer(repeats, "<i8").reshape(-1, 2)
    counts[np.searchsorted(lows, pairs[:, 0])] = pairs[:, 1]
    return lows, counts


class Ranks:
    """Rank queries on one bitmap, by a popcount directory over its 64-bit words."""

    def __init__(self, bitmap: bytes, repeats: bytes):
        if len(bitmap) == RUN // 8:
            self.words = np.frombuffer(bitmap, "<u8")
        else:
            bits = np.zeros(RUN, bool)
            bits[np.frombuffer(bitmap, "<u2")] = True
            self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = bounds(np.bitwise_count(self.words))
        pairs = np.frombuffer(repeats, "<i8").reshape(-1, 2)
        self.repeated, self.extra = pairs[:, 0], bounds(pairs[:, 1] - 1)
        self.seen = np.zeros(len(pairs), np.int64)

    def places(self, lows: np.ndarray) -> np.ndarray:
        """Rows of the run before each of these, which come in one after the other: bits below, and further rows of
        repeated numbers, the same number's as they have come in so far."""
        word, bit = lows >> 6, (lows & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        out = self.before[word] + np.bitwise_count(below).astype(np.int64)
        if len(self.repeated):
            at = np.searchsorted(self.repeated, lows)
            out += self.extra[at]
            for i in np.flatnonzero(self.repeated[np.minimum(at, len(self.repeated) - 1)] == lows):
                out[i] += self.seen[at[i]]
                self.seen[at[i]] += 1
        return out


def runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal consecutive rows of the key arrays."""
    n = len(keys[0])
    if n:
        new = np.zeros(n, bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        at = [*np.flatnonzero(new).tolist(), n]
        yield from zip(at, at[1:])


def group_runs(batch: pa.RecordBatch, second: str) -> Iterator[tuple[tuple, int, int]]:
    """((group, second), start, end) of a batch's ranges of equal keys."""
    groups = batch.column("g").dictionary_encode()
    second = batch.column(second).to_numpy()
    for a, b in runs(groups.indices.to_numpy(), second):
        yield (groups[a].as_py(), int(second[a])), a, b


# -- coordinates ------------------------------------------------------------------------------------------------------

def leaves_of(docs: DataFrame, key: str, group: str, columns: list[str], text: str) -> DataFrame:
    """(g, run, low, doc, leaf, bad), written: the group as text that sorts null first, the id's run and place in it,
    the leaf, and what the leaf becomes by tampering (null where that is the same)."""
    cols = [F.col(c) for c in columns]
    doc = F.col(key).cast("long")
    # A run number is the id without its lowest bits, which hold the place.
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = (F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0) & (lowered != F.col(text))
    bad = [lowered if c == text else F.col(c) for c in columns]
    return materialise(docs.select(
        F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string"))).alias("g"),
        F.coalesce(F.shiftright(doc, RUN_BITS), F.lit(NULL_RUN)).alias("run"), F.coalesce(doc.bitwiseAND(F.lit(RUN - 1)), F.lit(0)).cast("int").alias("low"),
        F.col(key).alias("doc"), leaf_hash(cols).alias("leaf"), F.when(hit, leaf_hash(bad)).alias("bad")), "merkle-leaves")


def bitmaps(leaves: DataFrame, parts: int) -> DataFrame:
    """(g, run, bitmap, repeats, n): the merged bitmap of every group and run of ids, and the number of its rows."""
    schema = "g string, run long, bitmap binary, repeats binary"

    def build(batches):
        """One bitmap for each group and run that a batch holds."""
        for batch in batches:
            groups = batch.column("g").dictionary_encode()
            g, run, low = groups.indices.to_numpy(), batch.column("run").to_numpy(), batch.column("low").to_numpy()
            order = np.lexsort((low, run, g))
            g, run, low = g[order], run[order], low[order].astype(np.int64)
            rows = []
            for a, b in runs(g, run):
                lows, counts = np.unique(low[a:b], return_counts=True)
                rows.append((groups.dictionary[int(g[a])].as_py(), int(run[a]), *pack(lows, counts)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary(), pa.binary()))],
                                                 ["g", "run", "bitmap", "repeats"])

    def merge(batches):
        """The bitmaps of one key, which follow each other, as one."""
        key, total = None, None

        def closed():
            lows = np.flatnonzero(total)
            return pa.RecordBatch.from_pylist([dict(zip(("g", "run", "bitmap", "repeats"), (*key, *pack(lows, total[lows]))),
                                                    n=int(total.sum()))], out_schema)

        for batch in batches:
            for k, a, b in group_runs(batch, "run"):
                if k != key:
                    if key is not None:
                        yield closed()
                    key, total = k, np.zeros(RUN, np.int64)
                for i in range(a, b):
                    lows, counts = unpack(batch.column("bitmap")[i].as_py(), batch.column("repeats")[i].as_py())
                    total[lows] += counts
        if key is not None:
            yield closed()

    out_schema = pa.schema([("g", pa.string()), ("run", pa.int64()), ("bitmap", pa.binary()), ("repeats", pa.binary()), ("n", pa.int64())])
    partial = leaves.select("g", "run", "low").mapInArrow(build, schema)
    dealt = partial.repartition(parts, "g", "run").sortWithinPartitions("g", "run")
    return dealt.mapInArrow(merge, schema + ", n long")


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def directory(maps: DataFrame, parts: int) -> DataFrame:
    """The bitmaps with before: the rows of their group in the runs before them. They are dealt out by range; running
    sums inside a range and prefix sums over the ranges' totals make up the number."""
    dealt = materialise(maps.repartitionByRange(parts, "g", "run").withColumn("part", F.spark_partition_id()), "merkle-directory")
    inside = Window.partitionBy("part", "g").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part", "g").agg(F.sum("n").alias("n"))
    bases = totals.select("part", "g", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    sums = dealt.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return sums.join(bases, ["part", "g"]).select("g", "run", "bitmap", "repeats", (F.col("base") + F.col("inside")).alias("before"))


def placed(leaves: DataFrame, index: DataFrame, sizes: DataFrame, parts: int) -> DataFrame:
    """(g, pos, n, doc, leaf, bad), written: every leaf with its place in its group and the group's size. Every bitmap
    meets the leaves of its run, in order of their hashes so that repeated ids have a defined order; leaves pass by."""
    head = index.join(sizes, "g").select("g", "run", F.lit(0).alias("kind"), "bitmap", "repeats", "before", "n", *(
        F.lit(None).cast(t).alias(c) for c, t in (("low", "int"), ("doc", leaves.schema["doc"].dataType), ("leaf", "binary"), ("bad", "binary"))))
    body = leaves.select("g", "run", F.lit(1).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in (
        ("bitmap", "binary"), ("repeats", "binary"), ("before", "long"), ("n", "long"))), "low", "doc", "leaf", "bad")
    both = head.unionByName(body).repartition(parts, "g", "run").sortWithinPartitions("g", "run", "kind", "leaf")

    def run(batches):
        key = ranks = None
        before = n = 0
        for batch in batches:
            out = []
            for k, a, b in group_runs(batch, "run"):
                if k != key:  # a key's first row is its bitmap
                    key, ranks = k, Ranks(batch.column("bitmap")[a].as_py(), batch.column("repeats")[a].as_py())
                    before, n = batch.column("before")[a].as_py(), batch.column("n")[a].as_py()
                    a += 1
                if b > a:
                    pos = ranks.places(batch.column("low").slice(a, b - a).to_numpy().astype(np.int64)) + before
                    out.append(pa.RecordBatch.from_arrays(
                        [batch.column("g").slice(a, b - a), pa.array(pos), pa.array(np.full(b - a, n)),
                         *(batch.column(c).slice(a, b - a) for c in ("doc", "leaf", "bad"))], ["g", "pos", "n", "doc", "leaf", "bad"]))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    doc = leaves.schema["doc"].dataType.simpleString()
    return materialise(both.mapInArrow(run, f"g string, pos long, n long, doc {doc}, leaf binary, bad binary"), "merkle-placed")


# -- slot arrays ------------------------------------------------------------------------------------------------------

class Block:
    """The levels of one slot array: level 0 as filled, and up to the level on which one node is left of the array (or of
    the whole group, where that comes first)."""

    def __init__(self, group_nodes: int):
        depth, left = 0, group_nodes
        while left > 1 and depth < LEVELS:
            depth, left = depth + 1, -(-left // ARITY)
        self.nodes, self.depth, self.slots, self.filled = group_nodes, depth, np.zeros((SLOTS, 32), np.uint8), 0
        self.levels: list[bytes] = []

    def fill(self, slots: np.ndarray, nodes: pa.Array) -> None:
        self.slots[slots] = np.frombuffer(b"".join(nodes.to_pylist()), np.uint8).reshape(-1, 32)
        self.filled = max(self.filled, int(slots.max()) + 1)

    def reduce(self) -> bytes:
        """Hash all levels; the top as 32 bytes."""
        self.levels = [self.slots[:self.filled].tobytes().hex().encode()]
        for _ in range(self.depth):
            nodes = self.levels[-1]
            self.levels.append(b"".join(digest(nodes[i:i + 64 * ARITY]) for i in range(0, len(nodes), 64 * ARITY)))
        return bytes.fromhex(self.levels[-1].decode())

    def steps(self, slot: int, first: int = 0) -> list[tuple[int, bytes]]:
        """(place in its run, hex digests of the run's others) from a level on, upwards."""
        out = []
        for level in range(first, self.depth):
            i = slot // ARITY ** (level - first)
            start = i // ARITY * 64 * ARITY
            run, at = self.levels[level][start:start + 64 * ARITY], i % ARITY
            out.append((at, run[:64 * at] + run[64 * at + 64:]))
        return out


def arrays(batches, value: str):
    """(key, [(rows, slots)], Block) of every slot array of a task's batches, whose rows come in order of (g, block)."""
    key = block = None
    parts: list = []
    for batch in batches:
        for k, a, b in group_runs(batch, "block"):
            if k != key:
                if key is not None:
                    yield key, parts, block
                key, parts, block = k, [], None
            rows = batch.slice(a, b - a)
            real = rows.filter(pa.compute.is_valid(rows.column(value)))
            slots = real.column("pos").to_numpy() % SLOTS
            if len(slots):
                block = block or Block(real.column("n")[0].as_py())
                block.fill(slots, real.column(value))
            parts.append((rows, slots))
    if key is not None:
        yield key, parts, block


def keyed(nodes: DataFrame, parts: int, *order: str) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {SLOTS}")).repartition(parts, "g", "block").sortWithinPartitions("g", "block", *order)


def tops(nodes: DataFrame, parts: int) -> DataFrame:
    """(g, pos, n, node): the top of every slot array of nodes (g, pos, n, node); n is how many of them the group has."""

    def run(batches):
        for (g, number), _, block in arrays(batches, "node"):
            top = block.reduce()
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([number], pa.int64()), pa.array([-(-block.nodes // SLOTS)], pa.int64()),
                                              pa.array([top], pa.binary())], ["g", "pos", "n", "node"])

    return keyed(nodes, parts).mapInArrow(run, "g string, pos long, n long, node binary")


def paths(nodes: DataFrame, parts: int) -> DataFrame:
    """(g, pos, block, steps, top, up_n), written: the siblings of every node up to the top of its slot array; the array's
    top stands beside its first node."""

    def run(batches):
        for (g, number), filled, block in arrays(batches, "node"):
            top = block.reduce()
            for rows, slots in filled:
                steps = [[{"at": at, "others": bytes.fromhex(o.decode())} for at, o in block.steps(s)] for s in slots.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("g"), rows.column("pos"), rows.column("block"), pa.array(steps, pa.list_(pa.struct([("at", pa.int32()), ("others", pa.binary())]))),
                     pa.array([top if s == 0 else None for s in slots.tolist()], pa.binary()),
                     pa.array(-(-rows.column("n").to_numpy() // SLOTS))], ["g", "pos", "block", "steps", "top", "up_n"])

    schema = "g string, pos long, block long, steps array<struct<at:int,others:binary>>, top binary, up_n long"
    return materialise(keyed(nodes, parts).mapInArrow(run, schema), "merkle-paths")


def climb(nodes: DataFrame, largest: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """((g, pos, steps) with every node's siblings up to its group's last node, (g, node) with that node)."""
    if largest <= 1:
        return nodes.select("g", "pos", F.expr(NO_STEPS).alias("steps")), nodes.select("g", "node")
    here = paths(nodes, parts)
    above = here.where(F.col("top").isNotNull()).select("g", F.col("block").alias("pos"), F.col("up_n").alias("n"), F.col("top").alias("node"))
    up, last = climb(above, -(-largest // SLOTS), parts)
    up = up.select(F.col("g").alias("up_g"), F.col("pos").alias("up_pos"), F.col("steps").alias("up_steps"))
    return here.join(up, (F.col("g") == F.col("up_g")) & (F.col("block") == F.col("up_pos"))).select(
        "g", "pos", F.concat("steps", "up_steps").alias("steps")), last


def proofs(leaves: DataFrame, above: DataFrame, parts: int) -> DataFrame:
    """Every leaf with its proof, from the slot arrays filled once more beside the siblings above each (g, block, steps,
    subroot, root)."""
    doc = leaves.schema["doc"].dataType
    body = leaves.select("g", "pos", "n", "doc", F.col("leaf").alias("node"), "bad", F.lit(None).cast("array<struct<at:int,others:binary>>").alias("steps"),
                         *(F.lit(None).cast("binary").alias(c) for c in ("subroot", "root")))
    head = above.select("g", (F.col("block") * SLOTS).alias("pos"), F.lit(None).cast("long").alias("n"), F.lit(None).cast(doc).alias("doc"),
                        *(F.lit(None).cast("binary").alias(c) for c in ("node", "bad")), "steps", "subroot", "root")

    def run(batches):
        for _, filled, block in arrays(batches, "node"):
            first = filled[0][0]  # the row that holds what is above the array comes first
            upper = [(s["at"], s["others"].hex().encode()) for s in first.column("steps")[0].as_py()]
            subroot, root = (first.column(c)[0].as_py().hex() for c in ("subroot", "root"))
            block.reduce()
            tails: dict[int, tuple[list, bytes]] = {}
            for rows, slots in filled:
                rows = rows.filter(pa.compute.is_valid(rows.column("node")))
                if not len(rows):
                    continue
                out = [prove(block, s, upper, tails, leaf, bad) for s, leaf, bad in zip(
                    slots.tolist(), rows.column("node").to_pylist(), rows.column("bad").to_pylist())]
                leaf, proof, folded = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc"), *(pa.array(x) for x in (leaf, [subroot] * len(rows), [root] * len(rows), proof, folded)),
                     pa.array([f == root for f in folded])], names)

    names = ["doc", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kind = doc.simpleString()
    both = body.unionByName(head).withColumn("kind", F.col("node").isNotNull())
    return keyed(both, parts, "kind").mapInArrow(
        run, f"doc {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def prove(block: Block, slot: int, upper: list, tails: dict, leaf: bytes, bad: bytes | None) -> tuple[str, str, str]:
    """(leaf, digest of all siblings, root folded from the tampered or else the original leaf)."""
    group = slot // ARITY
    if group not in tails:  # eight leaves share all siblings but those of the lowest level
        rest = block.steps(group, 1) + upper
        tails[group] = rest, b"".join(o for _, o in rest)
    rest, joined = tails[group]
    low = []
    if block.depth:
        run, at = block.levels[0][64 * ARITY * group:64 * ARITY * (group + 1)], slot % ARITY
        low = [(at, run[:64 * at] + run[64 * at + 64:])]
    node = (bad or leaf).hex().encode()
    for at, others in low + rest:
        node = digest(others[:64 * at] + node + others[64 * at:])
    return leaf.hex(), sha256((low[0][1] if low else b"") + joined).hexdigest(), node.decode()


def manifest(docs: DataFrame, columns: list[str], key: str = "doc_id", group: str = "lang", text: str = "text") -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of docs.

    A leaf is the hash of the columns, in their order. Leaves of a group are in order of the key, null keys first; rows of
    one key in order of their leaves, and equal leaves have a slot each. Groups are in bytewise order, null first. A
    table of one row has its leaf as subroot and root and an empty proof. Tampering lower-cases A-Z in the text of the rows
    whose key's crc32 is divisible by 3 (null keys, null texts and texts without such letters stay as they are and verify).
    Other columns are not read. An empty table gives none."""
    spark = docs.sparkSession
    leaves = leaves_of(docs, key, group, columns, text)
    parts = partitions_for(spark, leaves.count() * ROW_BYTES, BYTES_PER_PARTITION)
    index = directory(bitmaps(leaves, parts), parts)
    sizes = materialise(leaves.groupBy("g").agg(F.count("*").alias("n")), "merkle-groups")
    groups, largest = sizes.agg(F.count("*"), F.max("n")).first()
    sizes = small(sizes, groups)
    ranked = placed(leaves, index, sizes, parts)
    blocks = materialise(tops(ranked.select("g", "pos", "n", F.col("leaf").alias("node")), parts), "merkle-blocks")
    steps, subroots = climb(blocks, -(-(largest or 0) // SLOTS), parts)
    order = F.row_number().over(Window.orderBy("g")) - 1  # one thin row a group
    top = materialise(subroots.select(F.col("g").alias("name"), "node", F.lit("all").alias("g"), order.cast("long").alias("pos"),
                                      F.lit(groups).cast("long").alias("n")), "merkle-subroots")
    upper, root = climb(top.select("g", "pos", "n", "node"), groups, parts)
    ends = top.join(upper, ["g", "pos"]).join(root.select("g", F.col("node").alias("root")), "g").select(
        F.col("name").alias("g"), F.col("steps").alias("top_steps"), F.col("node").alias("subroot"), "root")
    above = steps.join(small(ends, groups), "g").select("g", F.col("pos").alias("block"), F.concat("steps", "top_steps").alias("steps"), "subroot", "root")
    out = proofs(ranked, above, parts)
    return out.select(F.col("doc").alias(key), *out.columns[1:])

