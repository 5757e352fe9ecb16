"""Random forest regression without a depth limit (ML03): two-phase growth.

Every tree draws its bootstrap (Poisson weights from a hash of the row key), and each pair of tree and node has a set of
rows, packed as binaries. Sets above NODE_ROWS are split by histograms that partial sums merge, all trees and nodes of a
level in one pass over the rows, which find their node by the splits so far: no tree's rows are written for it. As soon as a set is small enough it is dealt to one task, which grows the rest of that subtree on exact
split points until its leaves are pure or cannot be split. The fitted forest is two tables (splits of large nodes, packed
subtrees); rows are scored by the same dealing: to the subtree where they end up in each tree, then averaged per row.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlane.operators.dims import MAX_BROADCAST_ROWS, materialize, materialize_counted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a set from which on one task grows the subtree (about 100 bytes a row and feature while it does).
NODE_ROWS = 1 << 17
#: Parts of a feature's range in a large node's histogram.
BINS = 256
#: Gains that differ by less than this share count as equal, so that rounding does not choose between equal splits.
NEAR = 1e-10
#: Levels of a subtree after which its rows are laid out anew, and rows that a task packs or counts at a time.
RENUMBER, CHUNK_ROWS = 4, 1 << 19
#: Splits of large nodes up to which they go to the tasks and rows find their sets anew in each pass; beyond, the sets are written.
MAX_TOP = 1 << 14
#: Nodes are numbered as in a heap (children 2n and 2n + 1) down to this depth; deeper ones are left to a task.
HEAP_DEPTH = 60

STATE = "tree int, node long, n long, x binary, y binary, w binary"
SPLITS = "tree int, node long, feature int, threshold float"
SUMS = "tree int, node long, sums binary, edges binary"
SUBTREES = "tree int, node long, feature binary, threshold binary, child binary, value binary, depth int, n_nodes long"


# -- one subtree in a task --------------------------------------------------------------------------------------------

def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, max_depth: int | None = None) -> dict:
    """An exact regression tree on rows x (n, features), targets y and weights w, level by level.

    Rows stand in one order a feature, sorted by its value inside each node of the level; running sums in that order give
    the gain of every threshold of every node at once, and only places where the value changes are looked at. A node is split
    while its targets differ and some feature takes two values; thresholds are midpoints; equal gains go to the first feature
    and the smallest threshold. Nodes of equal targets leave as soon as they are made; every RENUMBER levels the rows that are
    left are laid out in the order of their nodes, so that what is read together lies together."""
    n, d = x.shape
    mean = float(np.average(y, weights=w))
    y = y - mean
    x = np.ascontiguousarray(x.T)
    order = np.argsort(x, axis=1, kind="stable").astype(np.int32)
    pair = w + 1j * (w * y)  # weight and weighted target, gathered and summed together
    size, ids, depth, nodes = np.array([n]), np.array([0]), 0, 1
    feature, threshold, child, value = [np.full(1, -1, np.int16)], [np.zeros(1, np.float32)], [np.zeros(1, np.int32)], [np.full(1, mean)]
    rows = order[0]
    total = np.add.reduceat(pair[rows], [0])
    value[0][:] = total.imag / total.real + mean
    here = 0  # number of the level's first node
    alive = y.max() > y.min()
    while alive and (max_depth is None or depth < max_depth):
        m = len(size)
        end = np.cumsum(size)
        first = end - size
        seg = np.repeat(np.arange(m, dtype=np.int32), size)
        t_y, t_w = total.imag, total.real
        best, best_f, cut = np.full(m, -np.inf), np.full(m, -1, np.int16), np.zeros(m, np.float32)
        inside = np.ones(len(seg) - 1, bool)
        inside[end[:-1] - 1] = False
        for f in range(d):
            rows = order[f]
            v = x[f].take(rows)
            at = np.flatnonzero((v[:-1] < v[1:]) & inside)
            if not len(at):
                continue
            s = seg.take(at)
            run = pair.take(rows).cumsum()
            base = run.take(first - 1)
            base[0] = 0
            left = run.take(at) - base.take(s)
            left_w, left_y = left.real, left.imag
            gain = left_y**2 / left_w + (t_y.take(s) - left_y) ** 2 / (t_w.take(s) - left_w)
            begin = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])
            mine = s[begin]
            top = np.maximum.reduceat(gain, begin)
            was = best[mine]
            better = top > was + NEAR * np.abs(np.where(np.isfinite(was), was, 0))
            if better.any():
                least = np.full(m, np.inf)
                least[mine[better]] = (top - NEAR * np.abs(top))[better]
                near = np.flatnonzero(gain >= least.take(s))
                to = s[near]
                one = np.concatenate([[True], to[1:] != to[:-1]])
                to, i = to[one], at[near[one]]
                a, b = v[i], v[i + 1]
                mid = ((a.astype(np.float64) + b) / 2).astype(np.float32)
                best[mine[better]] = top[better]
                best_f[to], cut[to] = f, np.where(mid < b, mid, a)
        split = best_f >= 0
        if not split.any():
            break
        # The level's nodes by number, so that children are numbered in their order.
        inner = np.flatnonzero(split)
        inner = inner[np.argsort(ids[inner])]
        at_id = ids[inner] - here
        feature[-1][at_id], threshold[-1][at_id] = best_f[inner], cut[inner]
        child[-1][at_id] = nodes + 2 * np.arange(len(inner))
        number = np.zeros(m, np.int64)
        number[inner] = np.arange(len(inner))
        # Rows go to the left child where their value is at most the threshold; all left children stand before the right ones.
        rows = order[0]
        go_left = x[np.maximum(best_f, 0)[seg], rows] <= cut[seg]
        on = split[seg]
        left, right = go_left & on, on & ~go_left
        keep = np.concatenate([rows[left], rows[right]])
        n_left = np.add.reduceat(left, first, dtype=np.int64)
        of = np.flatnonzero(split)
        size = np.concatenate([n_left[of], (np.diff([*first, len(seg)]) - n_left)[of]])
        ids = nodes + np.concatenate([2 * number[of], 2 * number[of] + 1])
        first = np.cumsum(size) - size
        total = np.add.reduceat(pair[keep], first)
        here, depth, nodes = nodes, depth + 1, nodes + len(ids)
        for parts, kind in ((feature, np.int16), (threshold, np.float32), (child, np.int32), (value, np.float64)):
            parts.append(np.full(len(ids), -1 if parts is feature else 0, kind))
        value[-1][ids - here] = total.imag / total.real + mean
        t = y[keep]
        impure = np.maximum.reduceat(t, first) > np.minimum.reduceat(t, first)
        alive = impure.any()
        if not alive:
            break
        goes = np.repeat(impure, size)
        n_l = int(left.sum())
        side = np.zeros(x.shape[1], np.int8)
        side[keep[:n_l][goes[:n_l]]] = 1
        side[keep[n_l:][goes[n_l:]]] = 2
        size, ids, total = size[impure], ids[impure], total[impure]
        moved = np.empty((d, int(size.sum())), np.int32)
        for f in range(d):
            s = side.take(order[f])
            a = order[f][s == 1]
            moved[f, :len(a)] = a
            moved[f, len(a):] = order[f][s == 2]
        order = moved
        if depth % RENUMBER == 0:  # rows that stand together lie together
            rows = order[0]
            place = np.empty(x.shape[1], np.int32)
            place[rows] = np.arange(len(rows), dtype=np.int32)
            x, y, pair, order = np.ascontiguousarray(x[:, rows]), y[rows], pair[rows], place[order]
    return {"feature": np.concatenate(feature), "threshold": np.concatenate(threshold), "child": np.concatenate(child),
            "value": np.concatenate(value), "depth": depth}


def descend(tree: dict, x: np.ndarray) -> np.ndarray:
    """The leaf values of rows."""
    at = np.zeros(len(x), np.int64)
    going = np.arange(len(x)) if tree["feature"][0] >= 0 else np.zeros(0, np.int64)
    while len(going):
        node = at[going]
        f = tree["feature"][node]
        at[going] = tree["child"][node] + (x[going, f] > tree["threshold"][node])
        going = going[tree["feature"][at[going]] >= 0]
    return tree["value"][at]


# -- packed sets of rows ----------------------------------------------------------------------------------------------

def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def bootstrap(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row: Poisson of mean 1, from the row's key."""
    own = mix(np.array([tree * 1_000_003 + seed], np.int64).view(np.uint64))[0]
    u = (mix(keys.view(np.uint64) ^ own) >> np.uint64(11)).astype(np.float64) / 2.0**53
    steps = np.exp(-1.0) * np.cumsum(1 / np.cumprod([1.0, *range(1, 12)]))
    return np.searchsorted(steps, u, side="right").astype(np.uint8)


def matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(batch), d)


def packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("tree", pa.int32()), ("node", pa.int64()), ("n", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("w", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [k for k, _ in kinds])


def chunks(batches, d: int):
    """(x, keys, y) of up to about CHUNK_ROWS rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append((matrix(batch, d), batch.column("key").to_numpy(), batch.column("y").to_numpy()))
        n += len(batch)
        if n >= CHUNK_ROWS:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held)))


def reached(x: np.ndarray, at: np.ndarray, splits: dict):
    """(node, rows) of the nodes that are not split, from the root; splits: {node: (feature, threshold)}."""
    going = [(1, at)]
    while going:
        node, at = going.pop()
        if node in splits:
            f, t = splits[node]
            right = x[at, f] > np.float32(t)
            going += [(2 * node + 1, at[right]), (2 * node, at[~right])]
        elif len(at):
            yield node, at


def draw_sets(rows: DataFrame, trees: int, seed: int, d: int, with_all: bool, top: dict | None = None) -> DataFrame:
    """The rows (key, x, y) as packed sets, at the nodes that they reach by the splits of top ({tree: {node: (feature, threshold)}}):
    all rows for scoring, where y is an id, else those that a tree has drawn, with their weights."""
    top = top or {}

    def run(batches):
        for x, keys, y in chunks(batches, d):
            for tree in range(trees):
                w = None if with_all else bootstrap(keys, tree, seed)
                for node, at in reached(x, np.arange(len(y)) if with_all else np.flatnonzero(w), top.get(tree, {})):
                    yield packed([(tree, node, len(at), x[at].tobytes(), y[at].tobytes(), b"" if with_all else w[at].tobytes())])

    return rows.mapInArrow(run, STATE)


def node_ranges(rows: DataFrame, trees: int, seed: int, d: int, top: dict, open_: set) -> DataFrame:
    """(tree, node, f, n, lo, hi) of the sets named in open_: drawn rows and each feature's range."""
    names = ["tree", "node", "f", "n", "lo", "hi"]

    def run(batches):
        for x, keys, _ in chunks(batches, d):
            for tree in range(trees):
                for node, at in reached(x, np.flatnonzero(bootstrap(keys, tree, seed)), top.get(tree, {})):
                    if (tree, node) in open_:
                        mine = x[at]
                        yield pa.RecordBatch.from_arrays([pa.array([tree] * d, pa.int32()), pa.array([node] * d, pa.int64()), pa.array(range(d), pa.int32()),
                                                          pa.array([len(at)] * d, pa.int64()), pa.array(mine.min(0)), pa.array(mine.max(0))], names)

    return rows.mapInArrow(run, "tree int, node long, f int, n long, lo float, hi float").groupBy("tree", "node", "f").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def node_sums(rows: DataFrame, trees: int, seed: int, d: int, top: dict, big: dict) -> DataFrame:
    """Partial histograms (SUMS) of the large sets in big ({(tree, node): (lo, hi) of its features})."""
    def run(batches):
        for x, keys, y in chunks(batches, d):
            for tree in range(trees):
                w = bootstrap(keys, tree, seed)
                for node, at in reached(x, np.flatnonzero(w), top.get(tree, {})):
                    if (tree, node) in big:
                        cuts = edges(*big[tree, node])
                        yield summed((tree, node), counted(np.zeros((2, d, BINS)), cuts, x[at], y[at], w[at]), cuts)

    return rows.mapInArrow(run, SUMS)


def unpack(row: dict, d: int, kind=np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["x"], np.float32).reshape(-1, d), np.frombuffer(row["y"], kind), np.frombuffer(row["w"], np.uint8)


def dealt(state: DataFrame, parts: int, *order: str) -> DataFrame:
    return state.repartition(parts, "tree", "node").sortWithinPartitions("tree", "node", *order)


def by_set(batches):
    """((tree, node), rows so far) of consecutive packed rows of one set."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["tree"], row["node"]) != key:
                if rows:
                    yield key, rows
                key, rows = (row["tree"], row["node"]), []
            rows.append(row)
    if rows:
        yield key, rows


def split_sets(state: DataFrame, splits: DataFrame, d: int) -> DataFrame:
    """The rows of split nodes as sets of their children; other sets as they are."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if row["feature"] is None:
                    yield packed([tuple(row[c] for c in ("tree", "node", "n", "x", "y", "w"))])
                    continue
                x, y, w = np.frombuffer(row["x"], np.float32).reshape(-1, d), np.frombuffer(row["y"], np.int64), np.frombuffer(row["w"], np.uint8)
                right = x[:, row["feature"]] > np.float32(row["threshold"])
                for side in (0, 1):
                    at = np.flatnonzero(right == side)
                    if len(at):
                        yield packed([(row["tree"], 2 * row["node"] + side, len(at), x[at].tobytes(), y[at].tobytes(), w[at].tobytes() if len(w) else b"")])

    return state.join(splits, ["tree", "node"], "left").mapInArrow(run, STATE)


def edges(lo, hi) -> np.ndarray:
    """The BINS - 1 inner bounds of the parts of each feature's range."""
    lo, hi = np.array(lo, np.float64), np.array(hi, np.float64)
    return (lo[:, None] + (hi - lo)[:, None] * np.arange(1, BINS) / BINS).astype(np.float32)


def counted(sums: np.ndarray, cuts: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """sums with the weights and weighted targets of the rows added, per feature and part of its range."""
    w = w.astype(np.float64)
    wy = w * y
    for f, e in enumerate(cuts):
        at = np.searchsorted(e, x[:, f])
        sums[0, f] += np.bincount(at, w, BINS)
        sums[1, f] += np.bincount(at, wy, BINS)
    return sums


def summed(key: tuple, sums: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([sums.tobytes()]), pa.array([cuts.tobytes()])],
                                      ["tree", "node", "sums", "edges"])


def set_sums(state: DataFrame, big: DataFrame, d: int) -> DataFrame:
    """Partial histograms (SUMS) of the large sets in big (tree, node) of written sets."""
    def ranges(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = unpack(row, d)[0]
                yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * d, pa.int32()), pa.array([row["node"]] * d, pa.int64()), pa.array(range(d), pa.int32()),
                                                  pa.array(x.min(0)), pa.array(x.max(0))], ["tree", "node", "f", "lo", "hi"])

    mine = state.join(big.select("tree", "node"), ["tree", "node"], "left_semi")
    bounds = mine.mapInArrow(ranges, "tree int, node long, f int, lo float, hi float").groupBy("tree", "node", "f").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    bounds = bounds.groupBy("tree", "node").agg(F.array_sort(F.collect_list(F.struct("f", "lo", "hi"))).alias("bounds"))  # one entry a feature

    def histogram(batches):
        """One histogram for each set in the task."""
        key, sums, cuts = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["tree"], row["node"]) != key:
                    if key is not None:
                        yield summed(key, sums, cuts)
                    key, sums = (row["tree"], row["node"]), np.zeros((2, d, BINS))
                    cuts = edges(*([b[c] for b in row["bounds"]] for c in ("lo", "hi")))
                counted(sums, cuts, *unpack(row, d))
        if key is not None:
            yield summed(key, sums, cuts)

    return mine.join(bounds, ["tree", "node"]).sortWithinPartitions("tree", "node").mapInArrow(histogram, SUMS)


def best_splits(sums: DataFrame, d: int, parts: int) -> DataFrame:
    """SPLITS of large nodes: the threshold of highest gain among BINS parts of each feature's range in the node."""
    def choose(batches):
        key = total = at = None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["tree"], row["node"]) != key:
                    if key is not None:
                        yield pick(key, total, at)
                    key, total, at = (row["tree"], row["node"]), 0, np.frombuffer(row["edges"], np.float32).reshape(d, -1)
                total = total + np.frombuffer(row["sums"]).reshape(2, d, BINS)
        if key is not None:
            yield pick(key, total, at)

    def pick(key, total, at):
        left_w, left_y = total[0].cumsum(1)[:, :-1], total[1].cumsum(1)[:, :-1]
        all_w, all_y = total[0].sum(1, keepdims=True), total[1].sum(1, keepdims=True)
        ok = (left_w > 0) & (left_w < all_w)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, left_y**2 / left_w + (all_y - left_y) ** 2 / (all_w - left_w), -np.inf)
        f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
        some = bool(np.isfinite(gain[f, b]))
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([int(f) if some else None], pa.int32()),
                                           pa.array([float(at[f, b]) if some else None], pa.float32())], ["tree", "node", "feature", "threshold"])

    return sums.repartition(parts, "tree", "node").sortWithinPartitions("tree", "node").mapInArrow(choose, SPLITS).where(F.col("feature").isNotNull())


@dataclass
class Forest:
    """A fitted forest: splits of large nodes by level, and packed subtrees."""

    trees: int
    features: list[str]
    levels: list[DataFrame]
    subtrees: DataFrame
    depth: int
    n_nodes: int

    def predict(self, df: DataFrame, columns: list, out: str) -> DataFrame:
        """df with the mean of all trees' leaf values as a column. Rows get a number by being written once."""
        d, spark = len(self.features), df.sparkSession
        rows, n = materialize_counted(df.withColumn("_row", F.monotonically_increasing_id()))
        known, top = 0, {}
        for level in self.levels:  # the first levels go to the tasks, as far as they are small
            found = level.limit(MAX_TOP + 1).collect()
            if len(found) + sum(map(len, top.values())) > MAX_TOP:
                break
            known, top = known + 1, with_splits(top, found)
        state = draw_sets(rows.select(F.lit(0).cast("long").alias("key"), F.array(*columns).alias("x"), F.col("_row").alias("y")), self.trees, 0, d, True, top)
        for level in self.levels[known:]:
            state = split_sets(state, level, d)
        none = lambda t: F.lit(None).cast(t)
        sets = state.select("tree", "node", F.lit(1).alias("kind"), "x", "y", *(none("binary").alias(c) for c in ("feature", "threshold", "child", "value")))
        trees = self.subtrees.select("tree", "node", F.lit(0).alias("kind"), none("binary").alias("x"), none("binary").alias("y"), "feature", "threshold", "child", "value")
        parts = _parts(spark, n * self.trees, 4 * NODE_ROWS, self.trees)

        def run(batches):
            key = tree = None
            for batch in batches:
                for row in batch.to_pylist():
                    if row["kind"] == 0:  # a set's subtree comes first
                        key, tree = (row["tree"], row["node"]), opened(row)
                    elif (row["tree"], row["node"]) == key:
                        x, ids = np.frombuffer(row["x"], np.float32).reshape(-1, d), np.frombuffer(row["y"], np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(descend(tree, x))], ["_row", "leaf"])

        leaves = dealt(trees.unionByName(sets), parts, "kind").mapInArrow(run, "_row long, leaf double")
        mean = leaves.groupBy("_row").agg((F.sum("leaf") / self.trees).alias(out))
        return rows.join(mean, "_row").drop("_row")

    def nodes(self) -> DataFrame:
        """The forest as a node table: (tree, root, id, feature, threshold, left, right, value); root is the heap number of the
        subtree's set, ids count inside it, feature is null in leaves; splits of large nodes have id null."""
        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    t = opened(row)
                    n, leaf = len(t["value"]), t["feature"] < 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, row["tree"], np.int32)), pa.array(np.full(n, row["node"], np.int64)), pa.array(np.arange(n, dtype=np.int64)),
                         pa.array(t["feature"].astype(np.int32), mask=leaf), pa.array(t["threshold"], mask=leaf), pa.array(t["child"].astype(np.int64), mask=leaf),
                         pa.array(t["child"].astype(np.int64) + 1, mask=leaf), pa.array(t["value"])], names)

        names = ["tree", "root", "id", "feature", "threshold", "left", "right", "value"]
        out = self.subtrees.mapInArrow(run, "tree int, root long, id long, feature int, threshold float, left long, right long, value double")
        for level in self.levels:
            out = out.unionByName(level.select("tree", F.col("node").alias("root"), F.lit(None).cast("long").alias("id"), "feature", "threshold",
                                               (F.col("node") * 2).alias("left"), (F.col("node") * 2 + 1).alias("right"), F.lit(None).cast("double").alias("value")))
        return out

    def save(self, path: str) -> None:
        self.subtrees.write.mode("overwrite").parquet(f"{path}/subtrees")
        spark = self.subtrees.sparkSession
        levels = [s.withColumn("level", F.lit(i)) for i, s in enumerate(self.levels)]
        top = reduce(DataFrame.unionByName, levels) if levels else spark.createDataFrame([], SPLITS + ", level int")
        top.write.mode("overwrite").parquet(f"{path}/splits")
        spark.createDataFrame([(self.trees, self.features, len(levels), self.depth, self.n_nodes)],
                              "trees int, features array<string>, levels int, depth int, n_nodes long").write.mode("overwrite").parquet(f"{path}/forest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        r = spark.read.parquet(f"{path}/forest").first()
        top = spark.read.parquet(f"{path}/splits")
        return cls(r["trees"], list(r["features"]), [top.where(F.col("level") == i).drop("level") for i in range(r["levels"])],
                   spark.read.parquet(f"{path}/subtrees"), r["depth"], r["n_nodes"])


def opened(row: dict) -> dict:
    kinds = {"feature": np.int16, "threshold": np.float32, "child": np.int32, "value": np.float64}
    return {c: np.frombuffer(row[c], t) for c, t in kinds.items()}


def with_splits(top: dict, splits) -> dict:
    """top ({tree: {node: (feature, threshold)}}) with more splits."""
    top = {tree: dict(nodes) for tree, nodes in top.items()}
    for r in splits:
        top.setdefault(r["tree"], {})[r["node"]] = (r["feature"], r["threshold"])
    return top


def _parts(spark: SparkSession, rows: int, per_part: int, most: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(most, 4096), -(-int(rows) // per_part))


def _split_written(state: DataFrame, d: int, deepest: int) -> tuple[DataFrame, list[DataFrame]]:
    """(sets that are small enough or cannot be split, the splits by level) of written sets."""
    spark, ready, levels = state.sparkSession, [], []
    while True:
        sizes = state.groupBy("tree", "node").agg(F.sum("n").alias("n"))
        big, n_big = materialize_counted(sizes.where((F.col("n") > NODE_ROWS) & (F.col("node") < (1 << deepest))))
        if not n_big:
            ready.append(state)
            break
        parts = _parts(spark, n_big * 64, 4096, n_big)
        sums = set_sums(state, F.broadcast(big) if n_big <= MAX_BROADCAST_ROWS else big, d)
        splits, n_splits = materialize_counted(best_splits(sums, d, parts))
        if not n_splits:
            ready.append(state)
            break
        small = F.broadcast(splits) if n_splits <= MAX_BROADCAST_ROWS else splits
        ready.append(state.join(small, ["tree", "node"], "left_anti"))
        state = materialize(split_sets(state.join(small, ["tree", "node"], "left_semi"), small, d))
        levels.append(small)
    return materialize(reduce(DataFrame.unionByName, ready)), levels


def fit_forest(train: DataFrame, features: list[str], columns: list, target: str, trees: int = 100, max_depth: int | None = None, seed: int = 42,
               key: str = "row_key") -> Forest:
    """Trees on bootstraps of all rows of train, all features at every split, until leaves are pure, cannot be split, or have
    max_depth. columns: one expression a feature; they and the target are complete. An empty table gives trees that predict 0."""
    spark, d = train.sparkSession, len(features)
    rows = train.select(F.xxhash64(key).alias("key"), F.array(*columns).alias("x"), F.col(target).cast("double").alias("y"))
    rows = materialize(rows.repartition("key"))  # once, evenly, for all passes
    deepest = min(HEAP_DEPTH, HEAP_DEPTH if max_depth is None else max_depth)
    levels, top, settled, open_ = [], {}, {}, {(tree, 1) for tree in range(trees)}
    while open_:
        found: dict = {}
        for r in node_ranges(rows, trees, seed, d, top, open_).collect():  # one row a set and feature, MAX_TOP sets or so
            found.setdefault((r["tree"], r["node"]), {})[r["f"]] = (r["n"], r["lo"], r["hi"])
        settled |= {key: by[0][0] for key, by in found.items()}
        big = {key: tuple(zip(*(by[f][1:] for f in range(d)))) for key, by in found.items() if by[0][0] > NODE_ROWS and key[1].bit_length() - 1 < deepest}
        if not big:
            open_ = set()
            break
        if len(big) + sum(map(len, top.values())) > MAX_TOP:
            break
        splits = materialize(best_splits(node_sums(rows, trees, seed, d, top, big), d, _parts(spark, len(big) * 64, 4096, len(big))))
        new = splits.collect()  # one row a large set
        if not new:
            open_ = set()
            break
        settled = {k: n for k, n in settled.items() if k not in {(r["tree"], r["node"]) for r in new}}
        levels, top, open_ = [*levels, F.broadcast(splits)], with_splits(top, new), {(r["tree"], 2 * r["node"] + side) for r in new for side in (0, 1)}
    sets = draw_sets(rows, trees, seed, d, False, top)
    if open_:  # too many large sets for the tasks' memory: they are written and split by joins
        sets, more = _split_written(materialize(sets), d, deepest)
        levels, sizes = levels + more, sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct("tree", "node")).first()
        total, n_sets = sizes
    else:
        total, n_sets = sum(settled.values()), len(settled)

    def finish(batches):
        for (tree, node), packs in by_set(batches):
            parts = [unpack(p, d) for p in packs]
            x, y, w = (np.concatenate(c) for c in zip(*parts))
            left = None if max_depth is None else max(0, max_depth - (node.bit_length() - 1))
            t = grow(x, y, w.astype(np.float64), left)
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree], pa.int32()), pa.array([node], pa.int64()), *(pa.array([t[c].tobytes()], pa.binary()) for c in ("feature", "threshold", "child", "value")),
                 pa.array([t["depth"] + node.bit_length() - 1], pa.int32()), pa.array([len(t["value"])], pa.int64())],
                ["tree", "node", "feature", "threshold", "child", "value", "depth", "n_nodes"])

    subtrees = materialize(dealt(sets, _parts(spark, total, 2 * NODE_ROWS, n_sets)).mapInArrow(finish, SUBTREES))
    depth, n_nodes = subtrees.agg(F.coalesce(F.max("depth"), F.lit(0)), F.coalesce(F.sum("n_nodes"), F.lit(0))).first()
    return Forest(trees, features, levels, subtrees, int(depth), int(n_nodes))
