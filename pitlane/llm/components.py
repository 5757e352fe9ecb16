"""Connected components of links by rounds of joins, and groups of bounded size for comparing rows in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlane.llm.common import materialise

#: Links that a task connects at a time.
LINKS_AT_ONCE = 1_000_000


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, roots) of all ids in some links: root is the smallest id that an id is connected to."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[:len(a)], at[len(a):], np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for end in (root[x], root[y], x, y):
            np.minimum.at(new, end, low)
        while (jumped := new[new]).tolist() != new.tolist():
            new = jumped
        if (new == root).all():
            return ids, ids[root]
        root = new


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) as stars (id, root) of the components that the task's own links make; roots stand there with themselves."""
    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= LINKS_AT_ONCE:
            yield _star_rows(held)
            held, n = [], 0
    if n:
        yield _star_rows(held)


def _star_rows(held: list) -> pa.RecordBatch:
    ids, roots = spanning(*(np.concatenate(x) for x in zip(*held)))
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots)], ["id", "root"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of an id's stars (rows in order of the id): its smallest root (kind 0), and links from its other roots to that one, as
    stars again (kind 1)."""
    names = ["kind", "id", "root"]

    def rows(kind: int, ids: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids), pa.array(roots)], names)

    def settle(ids: np.ndarray, roots: np.ndarray):
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        least = np.minimum.reduceat(roots, first)
        yield rows(0, ids[first], least)
        to = np.repeat(least, np.diff(np.append(first, len(ids))))
        other = roots != to
        if other.any():
            yield rows(1, *spanning(roots[other], to[other]))

    ids, roots = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        ids, roots = np.concatenate([ids, batch.column(0).to_numpy()]), np.concatenate([roots, batch.column(1).to_numpy()])
        if len(ids) >= LINKS_AT_ONCE and ids[0] != ids[-1]:
            behind = int(np.searchsorted(ids, ids[-1]))  # the last id may have more rows to come
            yield from settle(ids[:behind], roots[:behind])
            ids, roots = ids[behind:], roots[behind:]
    if len(ids):
        yield from settle(ids, roots)


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in links (a, b): root is the smallest id that it is linked to over any number of links.

    Every task first connects what its own links connect, so what leaves it is one row an id. Ids that several tasks have
    found then link the roots that these gave them, which are far fewer, and the same is done with those links until none is
    left: one exchange a round. Each round is written to the shared folder."""
    stars, found = links.select("a", "b").where("a <> b").mapInArrow(_stars, "id long, root long"), []
    while True:
        step = materialise(stars.repartition("id").sortWithinPartitions("id").mapInArrow(_merged, "kind int, id long, root long"), "roots")
        found.append(step.where("kind = 0").select("id", "root"))
        again = step.where("kind = 1").select("id", "root")
        if again.isEmpty():
            break
        stars = again
    out = found.pop()
    while found:  # a round's roots are the ids of the next
        up = out.select(F.col("id").alias("root"), F.col("root").alias("up"))
        out = found.pop().join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root"))
    return out


def block_pairs(rows: DataFrame, group: str, size: str, row_id: str, limit: int, far: bool | None = None) -> DataFrame:
    """rows dealt out so that any two rows of a group meet in one (group, i, j), which holds 2 * limit rows or so at
    most: groups beyond limit rows are cut into blocks, and every row goes to each pair of blocks that its own is
    in. own is the row's block. far: only pairs of the same or neighbouring blocks (False), only the others (True).
    The result is partitioned by the key and sorted by it."""
    k = F.ceil(F.col(size) / limit).cast("int")
    own = F.pmod(F.xxhash64(row_id), k).cast("int")
    spread = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), k - 1)))
    if far is not None:
        apart = F.abs(F.col("own") - F.col("other")) > 1
        spread = spread.where(apart if far else ~apart)
    keyed = spread.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")
    return keyed.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys of a sorted partition. Only the run at hand is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        edges = [0, *new.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def forest(label: np.ndarray, own: np.ndarray, crossing: bool, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links between labels that span what `linked` links: linked(k, others) says which of the rows `others` row k is
    linked to. Rows of one label are linked already. In a pair of different blocks only rows of different blocks
    are held against each other."""
    names, group = np.unique(label, return_inverse=True)
    up = list(range(len(names)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for k in range(len(label) - 1):
        others = np.arange(k + 1, len(label))
        others = others[group[others] != group[k]]
        if crossing:
            others = others[own[others] != own[k]]
        if not len(others):
            continue
        for x in np.unique(group[others[linked(k, others)]]).tolist():
            a, b = root(int(group[k])), root(x)
            if a != b:
                up[b] = a
                out.append((int(names[group[k]]), int(names[x])))
    return out


def linked_rows(rows: DataFrame, group: str, size: str, row_id: str, label: str, limit: int, comparer: Callable[[pa.Table], Callable],
                column: str, far: bool | None = None) -> DataFrame:
    """(a, b): links between the labels of rows of a group, which span all links that comparer finds between them.
    comparer gets a bounded group of rows with `column` as x and gives the function that forest() asks."""
    wanted = rows.select(F.col(group).alias("g"), F.col(size).alias("n"), F.col(row_id).alias("id"), F.col(label).alias("c"), F.col(column).alias("x"))

    def run(batches):
        for part in groups(batches, ["g", "i", "j"]):
            ids, own, names = (part.column(c).to_numpy() for c in ("id", "own", "c"))
            _, one = np.unique(ids, return_index=True)
            if len(np.unique(names)) > 1:
                found = forest(names[one], own[one], part.column("i")[0] != part.column("j")[0], comparer(part.take(one)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return block_pairs(wanted, "g", "n", "id", limit, far).mapInArrow(run, "a long, b long")


def relabelled(rows: DataFrame, label: str, links: DataFrame) -> DataFrame:
    """rows with each label replaced by the root of its component of links, written to the shared folder."""
    roots = components(links).select(F.col("id").alias(label), "root")
    names = [c for c in rows.columns if c != label]
    return materialise(rows.join(roots, label, "left").select(*names, F.coalesce("root", label).alias(label)), "labels")


def undecided(rows: DataFrame, group: str, label: str) -> DataFrame:
    """The rows of those groups that have rows of different labels."""
    mixed = rows.groupBy(group).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo < hi").select(group)
    return rows.join(mixed, group)
