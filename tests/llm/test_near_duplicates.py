"""Near duplicates against all pairs, signatures against similarity."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import EDGE_SCHEMA, edge_docs, edge_rows, no_docs, prose, simple_words

from pitlane.llm import bag_minhash as B
from pitlane.llm import components


def bag(text):
    w = simple_words(text)
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    shared = sum((a & b).values())
    return shared / max(1, sum(a.values()) + sum(b.values()) - shared)


def edited(text, n, r):
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"x{r.randrange(1000)}"
    return " ".join(words)


def brute_classes(rows):
    """{row number: class's smallest id}; a null text is alone."""
    bags = [bag(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a is not None and b is not None and (a == b or bags[i] and bags[j] and similarity(bags[i], bags[j]) >= 0.8):
                up[root(i)] = root(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out[i] = min(ids) if ids else None
    return out


def test_signatures_agree_as_the_bags_overlap():
    r, errors = random.Random(1), []
    for k in range(60):
        base = prose(k, r.randint(30, 300)) + " again and again" * (k % 3) * 20
        texts = [base, *(edited(base, n, r) for n in (1, 4, 10))]
        of, shingle = B.shingles(texts)
        sig, there = B.signatures(len(texts), *B.counted(of, shingle))
        assert there.all()
        linked = B._by_overlap(pa.table({"x": texts}))
        for i in range(1, 4):
            s = similarity(bag(texts[0]), bag(texts[i]))
            errors.append(((sig[0] == sig[i]).mean() - s) / np.sqrt(max(s * (1 - s), 0.01) / B.COMPONENTS))
            assert linked(0, np.array([i]))[0] == (s >= 0.8)
    assert abs(np.mean(errors)) < 0.35 and 0.7 < np.std(errors) < 1.3


def group_rows():
    """A chain of edits, a wide group around the threshold, exact copies, short and empty texts."""
    r = random.Random(2)
    rows, text = [], prose(500, 150)
    for i in range(12):
        rows.append((100 - i, text))
        text = edited(text, 2, r)
    base = prose(501, 120)
    rows += [(200 + i, edited(base, 1 + i % 6, r)) for i in range(60)]
    rows += [(300 + i, prose(600 + i // 5, 40)) for i in range(20)]
    rows += [(400 + i, t) for i, t in enumerate(["a b", "a b", "a b c", "", "", "!!", "!!", "?", None, None])]
    return rows


def test_classes_of_groups(spark, monkeypatch):
    monkeypatch.setattr(B, "SIGNATURES_PER_BLOCK", 16)  # so that groups are cut into blocks
    monkeypatch.setattr(B, "TEXTS_PER_BLOCK", 8)
    rows = group_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in B.near_duplicates(docs).collect()}
    assert got == {rows[i][0]: c for i, c in brute_classes(rows).items()}


def test_odd_rows_and_one_of_each(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    want = brute_classes(rows)
    docs = edge_docs(spark)
    got = Counter((r["doc_id"], r["class_id"]) for r in B.near_duplicates(docs).collect())
    assert got == Counter((rows[i][0], rows[i][0] if rows[i][1] is None else c) for i, c in want.items())
    left = B.one_of_each(docs)
    assert left.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert len([1 for _, t in kept if t is None]) == 2
    classes = {(rows[i][1], c) for i, c in want.items() if rows[i][1] is not None}
    assert len([1 for _, t in kept if t is not None]) == len({c for _, c in classes if c is not None}) + len({t for t, c in classes if c is None})
    assert B.near_duplicates(no_docs(spark)).count() == 0
    assert B.one_of_each(spark.createDataFrame([], EDGE_SCHEMA)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (301, 300), (301, 300)]
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {300: 300, 301: 300}
