"""Rendezvous shards: the law, the slots, and rows that ask for care."""

import zlib
from collections import Counter, defaultdict

from helpers import edge_docs, edge_rows, no_docs

from pitlane.llm import shards


def test_slots_sizes_and_odd_rows(spark):
    out = shards.assign(edge_docs(spark), [1.0] * 4).collect()
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append((r["slot"], r["doc_id"]))
    for rows in by.values():
        rows.sort()
        assert [s for s, _ in rows] == list(range(len(rows)))
        ids = [i for _, i in rows]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in edge_rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    assert all(len({r["shard"] for r in out if r["doc_id"] == i}) == 1 for i in (9, None))
    assert shards.assign(no_docs(spark), [1.0] * 4).count() == 0


def test_law_and_growth(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'t' as text")
    small = {r["doc_id"]: r for r in shards.assign(docs, [1.0] * 10).collect()}
    large = {r["doc_id"]: r["shard"] for r in shards.assign(docs.orderBy((docs.doc_id * 7919) % 4001), [1.0] * 11).collect()}
    assert all(large[i] == r["grown_shard"] and r["grown_shard"] in (r["shard"], 10) for i, r in small.items())
    moved = sum(r["grown_shard"] == 10 for r in small.values())
    assert 250 < moved < 480  # a share of one in eleven: 364
    n = Counter(r["shard"] for r in small.values())
    assert min(n.values()) > 300 and max(n.values()) < 500


def test_weights_and_one_hot_key(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "'t' as text")
    n = Counter(r["shard"] for r in shards.assign(docs, [1.0, 2.0, 3.0]).collect())
    assert abs(n[0] - 1000) < 150 and abs(n[2] - 3000) < 200
    hot = spark.range(3000).selectExpr("cast(id % 2 as long) as doc_id", "'t' as text")
    out = shards.assign(hot, [1.0] * 3).collect()
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
