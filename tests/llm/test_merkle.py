"""The manifest against plain trees; bitmaps and ranks; rows that ask for care."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from helpers import prose

from pitlane.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, leaf int, pos int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def leaf(i, text, lang, source, n):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i:i + 8]) for i in range(0, len(last), 8)])
    return levels


def plain(rows):
    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        ok = leaf(i, text, lang, source, n)
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and text is not None
        groups[b"" if lang is None else b"=" + lang.encode()].append((i is not None, i or 0, ok, leaf(i, lower(text), lang, source, n) if hit else ok, i))
    order = sorted(groups)
    trees = {g: tree([r[2] for r in sorted(groups[g])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for pos, (_, _, ok, bad, i) in enumerate(sorted(groups[g])):
            node, others = bad, []
            for levels, p in ((trees[g], pos), (top, at)):
                for level in levels[:-1]:
                    a = p // 8 * 8
                    run = level[a:a + 8]
                    others += run[:p - a] + run[p - a + 1:]
                    node, p = h(*run[:p - a], node, *run[p - a + 1:]), p // 8
            out.append((i, ok, trees[g][-1][0], top[-1][0], h(*others), node, node == top[-1][0]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)


def check(spark, rows, parts=3):
    got = merkle.manifest(frame(spark, rows).repartition(parts), COLUMNS).collect()
    assert Counter(map(tuple, got)) == Counter(plain(rows))
    return got


def test_sizes_around_every_level(spark):
    for n in (1, 2, 8, 9, 65):
        rows = [(7 * i - 20, prose(i, 3).title(), "en", "s", i) for i in range(n)]
        rows += [(10**15 + i * 65_537, f"Text {i}", lang, None, None) for i, lang in enumerate(["de", "é", None, ""][:n])]
        check(spark, rows)


def test_more_leaves_than_a_slot_array(spark):
    got = check(spark, [(i, f"Ab {i}", "en" if i % 9 else "fr", "s", i) for i in range(2 * merkle.SLOTS + 300)], 5)
    assert 0.6 < sum(r["verified"] for r in got) / len(got) < 0.73


def test_many_groups(spark):
    """More groups than children of a node: the groups' own tree has levels."""
    check(spark, [(i, "T", f"l{i % 70}", "s", 1) for i in range(150)])


def test_odd_rows(spark):
    r = random.Random(5)
    rows = [(None, "A", "en", "s", 1), (None, None, None, None, None), (3, None, "en", None, 2), (3, "", "en", "x", 2), (3, "", "en", "x", 2), (4, "", None, "", 0),
            (-5, "ÄÖ Text", "en", "s", 2), (-(2**63), "Low", "en", "s", 1), (2**63 - 1, "High", "en", "s", 1), (9, prose(8, 200_000).upper(), "en", "s", 9)]
    rows += [(6, "Same", "en", "s", 1)] * 30 + [(6, f"Other {i}", "en", "s", 1) for i in range(30)]
    rows += [(r.randrange(-2**60, 2**60), "Sparse", "en", "s", 1) for _ in range(40)]
    check(spark, rows)


def test_empty_and_single(spark):
    assert merkle.manifest(frame(spark, []), COLUMNS).collect() == []
    (only,) = check(spark, [(3, "no capitals", "en", "s", 1)])
    assert only["leaf"] == only["subroot"] == only["root"] and only["proof_sha256"] == h() and only["verified"]


@pytest.mark.parametrize("n", [0, 1, 50, merkle.DENSE - 1, merkle.DENSE, merkle.RUN])
def test_bitmaps_give_ranks(n):
    lows = np.sort(np.random.default_rng(n).choice(merkle.RUN, n, replace=False))
    counts = np.where(lows % 5 == 0, 3, 1)
    bitmap, repeats = merkle.pack(lows, counts)
    back, again = merkle.unpack(bitmap, repeats)
    assert (back == lows).all() and (again == counts).all() and len(bitmap) <= merkle.RUN // 8
    places = merkle.Ranks(bitmap, repeats).places(np.repeat(lows, counts)[::-1].copy())
    assert sorted(places.tolist()) == list(range(int(counts.sum())))
