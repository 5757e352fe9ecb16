"""Repeated byte strings against a table of all of them."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import edge_docs, edge_rows, no_docs, prose

from pitlane.llm import repeats


def brute(rows, length=50):
    """For each row (bytes, removed, runs, digest of the rest)."""
    least = {}
    raw = [(t or "").encode() for _, t in rows]
    for (d, _), b in zip(rows, raw):
        if d is not None:
            for i in range(len(b) - length + 1):
                s = b[i:i + length]
                least[s] = min(d, least.get(s, d))
    out = []
    for (d, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1) if d is not None else ():
            if least[b[i:i + length]] < d:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def test_odd_rows(spark):
    """Very long texts too."""
    rows = [(r[0], r[1]) for r in edge_rows()]
    assert max(len(t or "") for _, t in rows) > 100_000
    assert ordered(repeats.report(edge_docs(spark)).collect()) == ordered(brute(rows))
    assert repeats.report(no_docs(spark)).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_passages_copies_and_periods(spark, monkeypatch, small):
    r = random.Random(8)
    passages = [prose(900 + i, 12)[:n] for i, n in enumerate((49, 50, 51, 60, 75))]
    rows = []
    for i in range(60):
        text = prose(i, 10)
        for _ in range(r.randint(0, 3)):
            text += r.choice(("", " ", "x")) + r.choice(passages) + prose(1000 + i, r.randint(0, 4))
        rows.append((i * 3 % 61, text))
    rows += [(70, "ab" * 80), (71, "ab" * 40), (72, "b" + "ab" * 30), (73, "a" * 49), (74, "a" * 49), (75, "a" * 50), (76, "a" * 200), (3, rows[9][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = ordered(brute(rows))
    if small:  # every batch is passed on after a few rows, every sort holds a few strings
        monkeypatch.setattr(repeats, "STRINGS_PER_SORT", 5)
        texts = [t.encode() for _, t in rows]
        monkeypatch.setattr(repeats, "PAIRS_PER_BATCH", 40)
        seg = repeats.Segments(texts, 50)
        assert seg.n.sum() == sum(max(0, len(t) - 49) for t in texts)
        by, marks = {}, {}
        for i, s, n, d, m in zip(seg.text.tolist(), seg.start.tolist(), seg.n.tolist(), seg.digit.tolist(), seg.mark.tolist()):
            assert marks.setdefault(texts[i][s:s + n + 49], m) == m
            for k in range(s, s + n):
                assert by.setdefault(texts[i][k:k + 50], d) == d  # equal strings have equal digits
        assert len(set(marks.values())) == len(marks)
    assert ordered(repeats.report(docs).collect()) == want
    assert sum(w[2] for w in want) > 500


def test_kept_text_and_length(spark):
    rows = [(1, "é" * 40 + "k" * 30), (2, "zé" + "é" * 39 + "k" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["kept"]["doc_id"]: r for r in repeats.without_repeats(docs, 60).collect()}
    assert out[1]["removed"] == [] and out[2]["removed"] == [1, 111]
    with pytest.raises(ValueError):
        repeats.repeated_runs(docs, 10)


def test_least_passages(spark):
    """Passages count by bytes or by words; what is too short by both stays."""
    words, short, long = "a b c d e f " * 6, "thirty-six-words-would-be-too-few-for-this one", "q" * 90
    rows = [(1, f"x1 {words}y1 {short}z1 {long}w1"), (2, f"x2 {words}y2 {short}z2 {long}w2")]
    out = {r["kept"]["doc_id"]: r for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 30, least_bytes=80, least_words=30).collect()}
    assert out[1]["removed"] == []
    gone = [rows[1][1][a:b] for a, b in zip(out[2]["removed"][::2], out[2]["removed"][1::2])]
    assert [g.strip() for g in gone] == [(words + "y").strip(), (long + "w").strip()]


def hot_rows():
    """A passage in most documents, which go on differently at both of its edges."""
    passage = prose(4000, 30)
    return [(i * 7 % 401, prose(i, 6) + " " + passage + " " + prose(2000 + i, 6)) for i in range(400)]


@pytest.mark.parametrize("in_batch,in_all", [(4, 1000), (1000, 4), (1000, 1000), (0, 0)])
def test_hot_passages(spark, monkeypatch, in_batch, in_all):
    """The same result whether digits are hot in a batch, over all, nowhere or everywhere."""
    monkeypatch.setattr(repeats, "HOT_IN_BATCH", in_batch)
    monkeypatch.setattr(repeats, "HOT_SEGMENTS", in_all)
    monkeypatch.setattr(repeats, "STRINGS_PER_SORT", 300)
    rows = hot_rows() + [(500, "ab" * 80), (501, "ab" * 40), (3, hot_rows()[9][1]), (502, hot_rows()[5][1]), (None, hot_rows()[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ordered(repeats.report(docs).collect()) == ordered(brute(rows))


def test_hot_passages_are_dealt_over_ranges(monkeypatch):
    """Of a passage that most documents hold, no range of digits gets more than a few entries, and the strings at its edges
    go to all ranges."""
    monkeypatch.setattr(repeats, "HOT_IN_BATCH", 8)
    ranges, rows = 16, hot_rows()
    ids, texts = pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows])
    names = repeats._schema(repeats.DIGITS, {"told": ""})
    dealt = [r for b in repeats._pass_digits(50, ranges, ranges, names)([pa.RecordBatch.from_arrays([ids, texts], ["doc", "text"])]) for r in b.to_pylist()]
    entries = np.concatenate([np.frombuffer(r["digit"], "<u8") for r in dealt if r["kind"] == 0])
    assert np.unique(entries, return_counts=True)[1].max() <= 9
    load = [sum(len(r["doc"]) // 8 for r in dealt if r["kind"] == 1 and r["to"] == to) for to in range(ranges)]
    assert max(load) < 3 * sum(load) / ranges

    told = {}
    for r in dealt:
        if r["kind"] == 1:
            for d, m, k in zip(*(np.frombuffer(r[c], t).tolist() for c, t in (("doc", "<i8"), ("mark", "<u8"), ("told", "<i1")))):
                told.setdefault(d, []).append((m, k))
    arrays = [pa.array([np.array([x[i] for x in told.get(d, [(2, 0)])], t).tobytes() for d, _ in rows], pa.binary()) for i, t in ((0, "<u8"), (1, "<i1"))]
    part = pa.RecordBatch.from_arrays([ids, texts, pa.array(range(len(rows)), pa.int64()), *arrays], ["doc", "text", "row", "marks", "told"])
    names = repeats._schema(repeats.PARTS, repeats.STRINGS, repeats.RUNS)
    out = [r for b in repeats._pass_strings(50, ranges, ranges, names)([part]) for r in b.to_pylist()]
    load = [sum(len(r["hash"]) // 8 for r in out if r["kind"] == 1 and r["to"] == to) for to in range(ranges)]
    assert sum(load) > 400 and max(load) < 3 * sum(load) / ranges
