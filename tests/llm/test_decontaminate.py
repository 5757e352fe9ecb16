"""Decontamination against a search for every window."""

import hashlib
import random

import pytest
from helpers import edge_docs, edge_rows, no_docs, prose, simple_words

from pitlane.llm import decontaminate


def brute(text, items, window):
    words, hit, found = simple_words(text), set(), set()
    for name, body in items:
        mine = simple_words(body)
        for w in {tuple(mine[i:i + window]) for i in range(max(1, len(mine) - window + 1))} - {()}:
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i:i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found.add(name)
    return len(words), hit, found


def test_automaton():
    r = random.Random(3)
    for _ in range(1500):
        items = [(str(i), " ".join(r.choice("abcd") for _ in range(r.randint(0, 9)))) for i in range(r.randint(0, 5))]
        automaton = decontaminate.ItemAutomaton(items, 4)
        for _ in range(2):
            text = " ".join(r.choice(["a", "b", "c", "d", "zz"]) for _ in range(r.randint(0, 25)))
            n, ranges, found = automaton.hits(text)
            assert (n, {x for a, b in ranges for x in range(a, b)}, found) == brute(text, items, 4)


@pytest.mark.parametrize("words_per_automaton", [100_000, 20])
def test_report(spark, monkeypatch, words_per_automaton):
    monkeypatch.setattr(decontaminate, "WORDS_PER_AUTOMATON", words_per_automaton)
    rows = edge_rows()
    items = [(1, prose(1, 80)[10:200]), (10, rows[5][1][:150].upper()), (2, "WORD"), (3, None), (4, ""), (5, "!!"), (2, "word"), (6, prose(8, 30))]
    table = spark.createDataFrame([(i, t, 0) for i, t in [*items, (None, prose(1, 80))]], "item_id long, text string, n_words int")
    got = decontaminate.report(edge_docs(spark), table).collect()

    def want(doc_id, text):
        n, hit, found = brute(text, [(str(i), t) for i, t in items], 10)
        return (doc_id, n, len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))

    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted((want(r[0], r[1]) for r in rows), key=key)
    assert any(r["n_items"] > 1 or r["contaminated"] for r in got)
    assert decontaminate.report(no_docs(spark), table).count() == 0
    assert decontaminate.report(edge_docs(spark), table.limit(0)).where("contaminated").count() == 0
