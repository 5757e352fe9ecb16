"""Line dedup against a plain count of lines, with rows that ask for care."""

import hashlib
from collections import Counter, defaultdict

from helpers import edge_docs, edge_rows, no_docs, prose

from pitlane.llm import line_dedup

LINE = "A line of some forty characters, which many documents hold"


def plain(rows, min_chars, min_docs):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(i)
    often = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in often or (i is not None and i == often[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def odd_rows():
    rows = [(i, f"{LINE}\nown text {i}\n\t {LINE.upper()} \r\n") for i in range(20, 26)]
    rows += [(None, f"{LINE}\nnull"), (None, "another null"), (25, f"{LINE}\n{LINE}"), (24, f"{LINE}\nown text 24\n\t {LINE.upper()} \r\n"),
             (40, "é" * 40 + "\n\n" + "é" * 39), *((i, "É" * 40) for i in range(41, 46)), *((i, "é" * 40 + " ") for i in range(46, 50)),
             (50, LINE + "\n" + prose(3, 200_000) + "\n" + "x\n" * 50_000 + LINE), (51, "\n".join([LINE] * 3)), (52, "\x0b".join([LINE] * 2))]
    return rows + [r[:2] for r in edge_rows()]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, i, "gone") for i, t in rows], "doc_id long, text string, doc long, mark string")


def test_odd_rows_against_a_plain_count(spark):
    for min_chars, min_docs in ((40, 5), (1, 2), (30, 7)):
        got = Counter(tuple(r) for r in line_dedup.dedup(frame(spark, odd_rows()), min_chars, min_docs).collect())
        assert got == plain(odd_rows(), min_chars, min_docs)


def test_few_keys_may_be_broadcast(spark, monkeypatch):
    """Keys beyond an even share are broadcast and all others shuffled; the result is the same whatever the share."""
    rows = [(i, "\n".join(f"line number {i % n} of the common ones, long enough to count" for n in (1, 2, 5, 9))) for i in range(90)]
    want = plain(rows, 40, 5)
    for n in (1, 3, 100_000):
        monkeypatch.setattr(line_dedup, "HOT_KEYS", n)
        assert Counter(tuple(r) for r in line_dedup.dedup(frame(spark, rows)).collect()) == want


def test_report_and_empty_tables(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = Counter((i, n, d, hashlib.sha256(k.encode()).hexdigest()) for (i, n, d, k), c in plain(rows, 40, 5).items() for _ in range(c))
    assert Counter(tuple(r) for r in line_dedup.report(docs).collect()) == want
    assert any(d for _, _, d, _ in want)
    assert line_dedup.report(no_docs(spark)).collect() == []
    assert line_dedup.report(edge_docs(spark)).count() == len(edge_rows())
