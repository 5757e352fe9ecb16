"""Seeded hash sampling and splitting (T04-T08) -- map-only where possible.

Membership is decided by a hash of the stable row key, so it does not depend
on partitioning, task retries or executor loss. The hash is the first 8 hex
digits of md5(row_key || '#' || seed) read as an unsigned 32-bit integer, an
expression DuckDB evaluates identically.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


HASH_SPACE = float(2 ** 32)


def hash_rank(key="row_key", seed: int = 42) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(k.cast("string"), F.lit(f"#{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def hash_sql(key: str = "row_key", seed: int = 42) -> str:
    """DuckDB form of hash_rank."""
    return f"CAST(('0x' || substr(md5({key} || '#{seed}'), 1, 8)) AS BIGINT)"


def hash_split(df: DataFrame, test_fraction: float = 0.2, seed: int = 42,
               key: str = "row_key") -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash threshold. No shuffle; stable under repartitioning."""
    cut = int(test_fraction * HASH_SPACE)
    marked = df.withColumn("_h", hash_rank(key, seed))
    test = marked.filter(F.col("_h") < cut).drop("_h")
    train = marked.filter(F.col("_h") >= cut).drop("_h")
    return train, test


def mark_split(df: DataFrame, test_fraction: float = 0.2, seed: int = 42, key: str = "row_key") -> DataFrame:
    """Same split as a boolean column `is_test` (lets both parts share one scan)."""
    cut = int(test_fraction * HASH_SPACE)
    return df.withColumn("is_test", hash_rank(key, seed) < cut)


def kth_hash_threshold(df: DataFrame, k: int, seed: int = 42, key: str = "row_key", hashed: DataFrame | None = None) -> tuple[int, str | None]:
    """Exact k-th smallest (hash, key) pair without a global sort (radix select on the 32-bit hash).

    Pass 1 counts rows per high 16 bits, pass 2 per low 16 bits inside the one
    high bucket that holds rank k: both are map-side aggregates whose results
    have at most 65,536 rows. Rows sharing the final hash value (rare 32-bit
    collisions) are ordered by key. Returns (t, key_t): a row is among the k
    smallest when hash < t or (hash == t and key <= key_t). hashed: the rows' hashes as _h, if they are already written.
    """
    if k <= 0:
        return -1, None
    h = _hashed(df, seed, key) if hashed is None else hashed
    hi = sorted((r[0], r[1]) for r in h.groupBy((F.col("_h") / 65536).cast("bigint").alias("b"))
                .agg(F.count(F.lit(1)).alias("n")).collect())
    seen = 0
    for b, n in hi:
        if seen + n >= k:
            break
        seen += n
    else:
        return int(HASH_SPACE), None  # fewer than k rows: everything is selected
    lo = sorted((r[0], r[1]) for r in h.filter((F.col("_h") / 65536).cast("bigint") == b)
                .groupBy((F.col("_h") % 65536).alias("v")).agg(F.count(F.lit(1)).alias("n")).collect())
    for v, n in lo:
        if seen + n >= k:
            break
        seen += n
    t = int(b) * 65536 + int(v)
    ties = df.filter(hash_rank(key, seed) == t).groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    return t, _key_at([(r["_k"], r["n"]) for r in ties.collect()], k - seen)


def _key_at(keys: list, k: int):
    """The key of the k-th row, from the rows of each key; the keys share one hash, so they are few."""
    for key, n in sorted(keys):
        k -= n
        if k <= 0:
            return key
    return None


def _hashed(df: DataFrame, seed: int, key: str, *more: Column) -> DataFrame:
    """The hash of every row (and more), written once to the shared folder so the selection passes do not recompute the
    input: four bytes a row, not its key, which only the few rows of the last hash need."""
    from pitlane.operators.dims import materialize
    low = materialize(df.select(*more, (hash_rank(key, seed) - 2 ** 31).cast("int").alias("_h")))
    return low.withColumn("_h", F.col("_h").cast("bigint") + 2 ** 31)


def _among(h: Column, t: int, key: Column, key_t: str | None) -> Column:
    """Whether a row's hash and key are among those up to (t, key_t); rows beyond t, the most in a sample, are settled by one
    comparison, so that their hash is computed once."""
    return h < t if key_t is None else (h <= t) & ((h != t) | (key <= F.lit(key_t)))


def exact_split(df: DataFrame, test_fraction: float = 0.2, seed: int = 42, key: str = "row_key") -> DataFrame:
    """T07 exact mode: `is_test` marks exactly ceil(test_fraction * n) rows (the smallest hashes)."""
    hashed = _hashed(df, seed, key)
    k = math.ceil(test_fraction * hashed.count() - 1e-9)
    t, kt = kth_hash_threshold(df, k, seed, key, hashed)
    h = hash_rank(key, seed)
    return df.withColumn("is_test", _among(h, t, F.col(key), kt))


def _class_thresholds(df: DataFrame, hashed: DataFrame, quota: dict, label_column: str, seed: int, key: str) -> dict:
    """{class: (t, key_t)}: exact thresholds of the quota[class] smallest (hash, key) pairs of each class, by the two
    counting passes of kth_hash_threshold for all classes at once (at most 65,536 counts a class and pass); hashed: the
    class and hash of every row of df."""
    high, low = (F.col("_h") / 65536).cast("bigint"), F.col("_h") % 65536
    counts: dict = {}
    for r in hashed.groupBy("_l", high.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["_l"], []).append((r["b"], r["n"]))
    at: dict = {}
    for label, k in quota.items():
        seen = 0
        for b, n in sorted(counts.get(label, [])):
            if k <= 0:
                at[label] = (-1, 0)
                break
            if seen + n >= k:
                at[label] = (b, k - seen)
                break
            seen += n
    mine = None
    for label, (b, _) in at.items():
        here = F.col("_l").eqNullSafe(F.lit(label)) & (high == b)
        mine = here if mine is None else mine | here
    out = {label: (-1, None) for label in quota}
    if mine is None:
        return out
    fine: dict = {}
    for r in hashed.filter(mine).groupBy("_l", "_h").agg(F.count(F.lit(1)).alias("n")).collect():
        fine.setdefault(r["_l"], []).append((r["_h"], r["n"]))
    last = {}
    for label, (_, left) in at.items():
        for h, n in sorted(fine.get(label, [])):
            if left <= n:
                last[label] = (h, left)
                break
            left -= n
    if not last:
        return out
    own = reduce(lambda a, b: a | b, (F.col(label_column).eqNullSafe(F.lit(label)) & (hash_rank(key, seed) == h) for label, (h, _) in last.items()))
    ties: dict = {}
    for r in df.filter(own).groupBy(F.col(label_column).alias("_l"), F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("n")).collect():
        ties.setdefault(r["_l"], []).append((r["_k"], r["n"]))
    return out | {label: (h, _key_at(ties[label], left)) for label, (h, left) in last.items()}


def _mark_smallest(df: DataFrame, label: str, quota_of, seed: int, key: str) -> Column:
    """Condition that marks, in each class of label, the quota_of({class: rows})[class] smallest hashes."""
    hashed = _hashed(df, seed, key, F.col(label).alias("_l"))
    rows = {r["_l"]: r["n"] for r in hashed.groupBy("_l").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a class
    h, mark = hash_rank(key, seed), F.lit(False)
    for value, (t, kt) in _class_thresholds(df, hashed, quota_of(rows), label, seed, key).items():
        low = _among(h, t, F.col(key), kt)
        mark = mark | (F.col(label).eqNullSafe(F.lit(value)) & low)
    return mark


def mark_stratified(df: DataFrame, label: str, test_fraction: float = 0.2, seed: int = 42, key: str = "row_key") -> DataFrame:
    """`is_test` marks exactly ceil(test_fraction * n) rows of every class (the smallest hashes; a null label is
    a class of its own). Rows with one key go together."""
    return df.withColumn("is_test", _mark_smallest(
        df, label, lambda n: {c: math.ceil(test_fraction * k - 1e-9) for c, k in n.items()}, seed, key))


def stratified_split(df: DataFrame, label: str, test_fraction: float = 0.2, seed: int = 42,
                     key: str = "row_key") -> tuple[DataFrame, DataFrame]:
    """T08 as (train, test)."""
    marked = mark_stratified(df, label, test_fraction, seed, key)
    return marked.filter(~F.col("is_test")).drop("is_test"), marked.filter("is_test").drop("is_test")


def hash_sample(df: DataFrame, n: int, seed: int = 42, key: str = "row_key") -> DataFrame:
    """Exactly min(n, rows) rows: the n smallest hashes.

    Two counting passes give the n-th smallest (hash, key) pair, and rows up to it pass a map-only filter; of rows
    that repeat one key the sort that follows takes as many as are still wanted, so heavily repeated keys lose
    nothing and keep nothing too much.
    """
    t, kt = kth_hash_threshold(df, n, seed, key)
    marked = df.withColumn("_h", hash_rank(key, seed))
    if kt is not None:
        marked = marked.filter(_among(F.col("_h"), t, F.col(key), kt))
    return marked.orderBy("_h", key).limit(n).drop("_h")


def top_k_per_group(df: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    """Exact top-k rows per group (column `rank_in_group`, 1-based), safe for hot groups.

    `row_number() <= k` with a literal k lets Catalyst insert a partial
    WindowGroupLimit before the shuffle: every map task forwards at most k rows
    per group, so a group holding a third of the table costs k rows per task,
    not a third of the table in one task.
    """
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("rank_in_group", F.row_number().over(w)).filter(F.col("rank_in_group") <= F.lit(int(k)))


CAP_SEED = 4242  # independent of the split seed, so the cap is not correlated with the split


def class_quotas(rows: dict, cap: int) -> dict:
    """How many rows of each class a cap leaves: floor(cap * share), and what is left over to the largest fractions
    (equal ones in order of the class), so that the sum is exactly min(cap, rows)."""
    total = sum(rows.values())
    if total <= cap:
        return dict(rows)
    quota = {c: cap * n // total for c, n in rows.items()}
    order = sorted(rows, key=lambda c: (-(cap * rows[c] % total), str(c)))
    for c in order[:cap - sum(quota.values())]:
        quota[c] += 1
    return quota


def stratified_cap(df: DataFrame, label: str, cap: int, seed: int = CAP_SEED, key: str = "row_key") -> DataFrame:
    """Exactly min(cap, rows) rows keeping class shares: per class the smallest hashes, by exact thresholds
    (counting passes; no class is ever gathered in one task)."""
    return df.filter(_mark_smallest(df, label, lambda rows: class_quotas(rows, cap), seed, key))
