"""Removal of repeated byte strings by depth-limited most-significant-digit sorting of suffixes.

Only the first `length` bytes of a suffix count, so suffixes are sorted to that depth and no further; suffixes that
are equal to that depth are exactly the repeated strings. The passes, from the first digit on:

1. The digit of a string is the smallest hash among its 20-byte grams. Equal strings have equal digits, and
   neighbouring ones mostly share theirs, so a document is cut into segments, runs of strings of one digit. A segment goes
   to its digit's task as a triple of numbers (digit, hash of the segment, document). Of equal segments all but the one of
   the smallest document are settled: all their strings go. What no other document holds falls out. Only where the
   segments of a digit differ, those of the smallest documents have strings still to be compared.
2. These segments are dealt out by digit with their bytes; their strings are sorted by bytes, eight a pass, strings of
   one document falling out after each. A digit with more than HOT_SEGMENTS different segments (the edges of a passage
   that very many documents hold) would fill one task: its strings are dealt out by the hash of all their bytes instead,
   as numbers, and told apart by that and the digit.

A task first settles what its own rows decide: of a segment or string that many of its documents hold, one entry goes on.
Everything between tasks travels as packed arrays, one row for a range of digits or of documents.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlane.llm.common import bounds, materialise, mix64, partitions_for, powers, ragged_index, slices, text_bytes
from pitlane.llm.components import groups

GRAM = 20
BASE = 0x9E3779B97F4A7C15
#: Segments, and strings of hot digits, that a task gathers before it passes them on.
PAIRS_PER_BATCH = 500_000
#: Text bytes whose strings are hashed at a time.
TEXT_SLICE = 250_000
#: Text bytes that a partition is for, and that a range of digits and one of documents are for (the least number of ranges
#: serves small tables). How many ranges there are depends on the texts alone, not on the partitions.
BYTES_PER_PARTITION, BYTES_PER_RANGE, BYTES_PER_DOC_RANGE, LEAST_RANGES = 16 << 20, 512 << 10, 1 << 20, 32
#: Strings that are sorted at a time; a digit's strings stay together.
STRINGS_PER_SORT = 100_000
#: Different segments of a digit from which its strings are dealt out one by one; fewer are compared in one sort.
HOT_SEGMENTS = 1_000
#: Different segments of a digit in one batch from which it counts as hot at once, so that few of them go on.
HOT_IN_BATCH = 32
#: In place of a segment's hash: the digit is hot.
HOT_MARK = np.uint64(0)
#: What a document is told about a segment: all its strings go, its bytes are to be compared, or its strings' hashes.
GO, COMPARE, APART = 0, 1, 2


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)


class _Hashed:
    """Running sums over some bytes, from which the hash of any range of them follows."""

    def __init__(self, buf: np.ndarray):
        up, self.down = (p[:len(buf) + 1] for p in _powers(1 << int(len(buf) + 1).bit_length()))
        self.total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.total[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return mix64((self.total[start + size] - self.total[start]) * self.down[start])

    def all(self, width: int) -> np.ndarray:
        """Hashes of the `width` bytes from each position on."""
        return mix64((self.total[width:] - self.total[:-width]) * self.down[:len(self.total) - width])


class Segments:
    """The segments of some texts, in order: text, first string, number of strings, digit, hash of the segment's bytes."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        self.size = np.array([len(t) for t in texts], np.int64)
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        self.at = bounds(self.size)
        none = np.zeros(0, np.int64)
        self.text = self.start = self.n = none
        self.digit = self.mark = none.view(np.uint64)
        if len(self.buf) < length:
            return
        self.hashed = _Hashed(self.buf)
        low = self.hashed.all(GRAM)
        width, have = length - GRAM + 1, 1
        while have < width:  # minima over windows that double, the last step as wide as is left
            step = min(have, width - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        inside = np.maximum(self.size - length + 1, 0)
        pos = ragged_index(self.at[:-1], inside)
        text, digit = np.repeat(np.arange(len(texts)), inside), low[pos]
        first = _runs(text, digit)
        self.text, self.digit, self.pos = text[first], digit[first], pos[first]
        self.start, self.n = self.pos - self.at[self.text], np.diff(np.append(first, len(pos)))
        self.mark = mix64(self.hashed.of(self.pos, self.n + length - 1) + self.n.astype(np.uint64) * np.uint64(BASE)) | np.uint64(1)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """First rows of the runs of rows with equal columns."""
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])) if len(columns[0]) else np.zeros(0, np.int64)


def _lengths(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(first, n))


def _range_of(digit: np.ndarray, ranges: int) -> np.ndarray:
    return ((digit >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


def _range_of_doc(docs: np.ndarray, ranges: int) -> np.ndarray:
    return _range_of(mix64(docs.view(np.uint64)), ranges)


def _texts(batch: pa.RecordBatch, column: str):
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    for a, b in slices(sizes, TEXT_SLICE):
        part = batch.slice(a, b - a)
        yield part, [(x or "").encode() for x in part.column(column).to_pylist()]


#: Columns of the packed tables, and what their arrays hold.
DIGITS = {"digit": "<u8", "mark": "<u8", "doc": "<i8"}
TOLD = {"doc": "<i8", "mark": "<u8", "kind": "<i1"}
STRINGS = {"hash": "<u8", "digit": "<u8", "doc": "<i8", "row": "<i8", "start": "<i4"}
PARTS = {"digit": "<u8", "doc": "<i8", "row": "<i8", "start": "<i4", "size": "<i4", "bytes": "u1"}
RUNS = {"doc": "<i8", "row": "<i8", "start": "<i4", "n": "<i4"}


def _schema(*tables: dict) -> str:
    return "to int, kind int, " + ", ".join(f"{c} binary" for c in dict.fromkeys(c for t in tables for c in t))


def _pack(to: np.ndarray, kind: int, table: dict, columns: dict, names: list[str], most: int = 1 << 18):
    """Record batches with one row for each range in `to`: its entries of all columns. Columns that are not the table's are
    null. bytes are given flat, with each entry's size."""
    order = np.argsort(to, kind="stable")
    to, flat = to[order], None
    cols = {c: np.asarray(columns[c])[order].astype(t) for c, t in table.items() if c != "bytes"}
    if "bytes" in table:
        size = cols["size"].astype(np.int64)
        flat = bounds(np.asarray(columns["size"], np.int64))[:-1][order]
        at = bounds(size)
    first = _runs(to)
    edges = [*first.tolist(), len(to)]
    rows: list[tuple] = []
    held = 0
    for a, b in zip(edges, edges[1:]):
        row = {c: x[a:b].tobytes() for c, x in cols.items()}
        if flat is not None:
            row["bytes"] = columns["bytes"][ragged_index(flat[a:b], size[a:b])].tobytes()
            held += int(at[b] - at[a])
        rows.append((int(to[a]), kind, row))
        held += b - a
        if held >= most:
            yield _packed_rows(rows, names)
            rows, held = [], 0
    if rows:
        yield _packed_rows(rows, names)


def _packed_rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                       *(pa.array([r[2].get(c) for r in rows], pa.binary()) for c in names[2:])], names)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _unpack(rows: pa.Table, table: dict) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in table.items()}


def _join(parts: list[dict], table: dict) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, t) for c, t in table.items()}


# -- first pass: digits -----------------------------------------------------------------------------------------------

def _later(digit: np.ndarray, mark: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, later) of entries in order of (digit, mark, doc): those of one digit and mark but another document than the
    smallest are later."""
    order = np.lexsort((doc, mark, digit))
    digit, mark, doc = digit[order], mark[order], doc[order]
    first = _runs(digit, mark)
    return order, doc != np.repeat(doc[first], _lengths(first, len(doc)))


def _distinct(e: dict) -> dict:
    order = np.lexsort((e["doc"], e["mark"], e["digit"]))
    e = {c: x[order] for c, x in e.items()}
    one = _runs(e["digit"], e["mark"], e["doc"])
    return {c: x[one] for c, x in e.items()}


def _pass_digits(length: int, ranges: int, doc_ranges: int, schema: str):
    """The segments of documents as packed triples by range of digits (kind 0); what a task's own rows settle, by range of
    documents (kind 1)."""
    names = _names(schema)

    def dealt(parts: list[dict]):
        e = _distinct(_join(parts, DIGITS))
        order, later = _later(e["digit"], e["mark"], e["doc"])
        e = {c: x[order] for c, x in e.items()}
        stay = {c: x[~later] for c, x in e.items()}
        # A digit with many different segments here is hot: one mark says so, and its documents are told already.
        first = _runs(stay["digit"])
        number = _lengths(first, len(stay["digit"]))
        hot = np.repeat(number > HOT_IN_BATCH, number)
        at = first[number > HOT_IN_BATCH]
        on = {c: np.concatenate([stay[c][~hot], stay[c][at]]) for c in DIGITS}
        on["mark"][len(on["mark"]) - len(at):] = HOT_MARK
        yield from _pack(_range_of(on["digit"], ranges), 0, DIGITS, on, names)
        told = {c: np.concatenate([e[c][later], stay[c][hot]]) for c in ("doc", "mark")}
        told["kind"] = np.repeat(np.array([GO, APART], np.int8), [int(later.sum()), int(hot.sum())])
        yield from _told(told, doc_ranges, names)

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            for part, texts in _texts(batch, "text"):
                seg = Segments(texts, length)
                parts.append({"digit": seg.digit, "mark": seg.mark, "doc": part.column("doc").to_numpy()[seg.text]})
                n += len(seg.text)
                if n >= PAIRS_PER_BATCH:
                    yield from dealt(parts)
                    parts, n = [], 0
        if n:
            yield from dealt(parts)

    return run


def _told(e: dict, doc_ranges: int, names: list[str]):
    """Packed answers for documents; the column kind travels as told."""
    yield from _pack(_range_of_doc(e["doc"], doc_ranges), 1, {"doc": "<i8", "mark": "<u8", "told": "<i1"}, e | {"told": e["kind"]}, names)


def _settle_digits(doc_ranges: int, schema: str):
    """What documents are told about their segments, from all entries of each digit; what they are told already passes by."""
    names = _names(schema)

    def settle(rows: pa.Table) -> dict:
        e = _distinct(_unpack(rows, DIGITS))
        digit, mark, doc = e["digit"], e["mark"], e["doc"]
        first = _runs(digit, mark)
        later = doc != np.repeat(doc[first], _lengths(first, len(doc)))
        later &= mark != HOT_MARK
        # The smallest documents of a digit's segments: where there are several, their strings are compared.
        d, m, least = digit[first], mark[first], doc[first]
        by = _runs(d)
        n = _lengths(by, len(d))
        hot = (n > HOT_SEGMENTS) | (m[by] == HOT_MARK)  # the mark of a hot digit comes first
        mixed = np.repeat(hot | (np.minimum.reduceat(least, by) != np.maximum.reduceat(least, by)), n) & (m != HOT_MARK)
        kind = np.where(np.repeat(hot, n), APART, COMPARE).astype(np.int8)[mixed]
        return {"doc": np.concatenate([doc[later], least[mixed]]), "mark": np.concatenate([mark[later], m[mixed]]),
                "kind": np.concatenate([np.full(int(later.sum()), GO, np.int8), kind])}

    def run(batches):
        parts, n = [], 0
        for rows in groups(batches, ["kind", "to"]):
            if rows.column("kind")[0].as_py() == 1:
                yield from rows.select(names).to_batches()
                continue
            parts.append(settle(rows))
            n += len(parts[-1]["doc"])
            if n >= 4 * PAIRS_PER_BATCH:
                yield from _told(_join(parts, TOLD), doc_ranges, names)
                parts, n = [], 0
        if n:
            yield from _told(_join(parts, TOLD), doc_ranges, names)

    return run


def _by_document(batches):
    """(doc, marks, told): everything a document is told, as one row."""
    table = {"doc": "<i8", "mark": "<u8", "told": "<i1"}
    for rows in groups(batches, ["to"]):
        e = _unpack(rows, table)
        order = np.argsort(e["doc"], kind="stable")
        doc, mark, told = (e[c][order] for c in table)
        edges = [*_runs(doc).tolist(), len(doc)]
        for a in range(0, len(edges) - 1, 10_000):
            part = edges[a:a + 10_001]
            yield pa.RecordBatch.from_arrays([pa.array(doc[part[:-1]]), pa.array([mark[x:y].tobytes() for x, y in zip(part, part[1:])], pa.binary()),
                                              pa.array([told[x:y].tobytes() for x, y in zip(part, part[1:])], pa.binary())], ["doc", "marks", "told"])


# -- second pass: strings ---------------------------------------------------------------------------------------------

def _pass_strings(length: int, ranges: int, doc_ranges: int, schema: str):
    """Of documents' segments: those to compare, with their bytes, by range of digits (kind 0); strings of hot digits by range
    of their hashes (kind 1); and runs of strings that go, by range of documents (kind 2). row tells texts of one document."""
    names = _names(schema)

    def strings(parts: list[dict]):
        """Of strings that several documents here hold, those of the smallest go on and the others are settled."""
        e = _join(parts, STRINGS)
        order, later = _later(e["hash"], e["digit"], e["doc"])
        e = {c: x[order] for c, x in e.items()}
        stay = {c: x[~later] for c, x in e.items()}
        yield from _pack(_range_of(stay["hash"], ranges), 1, STRINGS, stay, names)
        yield from _gone({c: e[c][later] for c in ("doc", "row", "start")}, doc_ranges, names)

    def run(batches):
        apart, n = [], 0
        for batch in batches:
            parts, runs = [], []
            for part, texts in _texts(batch, "text"):
                seg = Segments(texts, length)
                doc, row = part.column("doc").to_numpy(), part.column("row").to_numpy()
                marks, told = ([np.frombuffer(x, t) for x in part.column(c).to_pylist()] for c, t in (("marks", "<u8"), ("told", "<i1")))
                at = np.searchsorted(seg.text, np.arange(len(texts) + 1))
                kind = np.full(len(seg.text), -1, np.int8)
                for i in range(len(texts)):
                    order = np.argsort(marks[i])
                    known, mine = marks[i][order], seg.mark[at[i]:at[i + 1]]
                    here = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                    kind[at[i]:at[i + 1]] = np.where(known[here] == mine, told[i][order][here], -1)
                entry = lambda which: {"doc": doc[seg.text[which]], "row": row[seg.text[which]], "start": seg.start[which], "n": seg.n[which]}  # noqa: E731,B023
                runs.append(entry(kind == GO))
                one = np.flatnonzero(kind == COMPARE)
                size = seg.n[one] + length - 1
                if len(one):
                    parts.append(entry(one) | {"digit": seg.digit[one], "size": size, "bytes": seg.buf[ragged_index(seg.pos[one], size)]})
                one = np.flatnonzero(kind == APART)
                if len(one):
                    each = np.repeat(one, seg.n[one])
                    step = np.arange(len(each)) - np.repeat(bounds(seg.n[one])[:-1], seg.n[one])
                    apart.append({"hash": seg.hashed.of(seg.pos[each] + step, length), "digit": seg.digit[each], "doc": doc[seg.text[each]],
                                  "row": row[seg.text[each]], "start": seg.start[each] + step})
                    n += len(each)
            if parts:
                e = _join(parts, PARTS)
                yield from _pack(_range_of(e["digit"], ranges), 0, PARTS, e, names)
            yield from _pack_runs(_join(runs, RUNS), doc_ranges, names)
            if n >= PAIRS_PER_BATCH:
                yield from strings(apart)
                apart, n = [], 0
        if n:
            yield from strings(apart)

    return run


def _pack_runs(e: dict, doc_ranges: int, names: list[str]):
    if len(e["doc"]):
        yield from _pack(_range_of_doc(e["doc"], doc_ranges), 2, RUNS, e, names)


def _gone(e: dict, doc_ranges: int, names: list[str]):
    """Packed runs of single strings that go."""
    order = np.lexsort((e["start"], e["row"], e["doc"]))
    doc, row, start = (e[c][order] for c in ("doc", "row", "start"))
    new = _runs(doc, row, start)
    doc, row, start = doc[new], row[new], start[new]
    first = _runs(doc, row, start - np.arange(len(start)))
    yield from _pack_runs({"doc": doc[first], "row": row[first], "start": start[first], "n": _lengths(first, len(start))}, doc_ranges, names)


def equal_strings(size: np.ndarray, flat: np.ndarray, digit: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, string in it) of the strings that a segment of the same digit and a smaller document holds too, of segments
    that lie one after the other in flat."""
    strings = size - length + 1
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), ">u8", padded.tobytes(), strides=(1,))
    of = np.repeat(np.arange(len(size)), strings)
    inner = np.arange(len(of)) - np.repeat(bounds(strings)[:-1], strings)
    pos, doc = bounds(size)[:-1][of] + inner, docs[of]
    group = digit[of]
    for depth in [*range(0, length - 8, 8), length - 8]:
        word = words[pos + depth].astype(np.uint64)
        order = np.lexsort((word, group))
        of, inner, pos, doc, group, word = (x[order] for x in (of, inner, pos, doc, group, word))
        first = _runs(group, word)
        if not len(first):
            break
        number = _lengths(first, len(of))
        low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
        keep = np.repeat(low < high, number)
        group = np.repeat(np.arange(len(first)).astype(np.uint64), number)[keep]
        least = np.repeat(low, number)[keep]
        of, inner, pos, doc = of[keep], inner[keep], pos[keep], doc[keep]
    else:
        later = doc > least
        return of[later], inner[later]
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def _settle_strings(length: int, doc_ranges: int, schema: str):
    """Packed runs of the strings that go, from the segments and hot strings of each range; settled runs are handed on."""
    names = _names(schema)

    def compare(rows: pa.Table) -> dict:
        e = _unpack(rows, PARTS)
        size = e["size"].astype(np.int64)
        at = bounds(size)[:-1]
        order = np.argsort(e["digit"], kind="stable")
        digit = e["digit"][order]
        first = _runs(digit)
        edges = [*first.tolist(), len(order)]
        each = np.add.reduceat((size - length + 1)[order], first).tolist()
        found = []
        for a, b in slices(each, STRINGS_PER_SORT):
            mine = order[edges[a]:edges[b]]
            seg, inner = equal_strings(size[mine], e["bytes"][ragged_index(at[mine], size[mine])], e["digit"][mine], e["doc"][mine], length)
            seg = mine[seg]
            found.append({"doc": e["doc"][seg], "row": e["row"][seg], "start": e["start"][seg] + inner})
        return _join(found, {"doc": "<i8", "row": "<i8", "start": "<i4"})

    def apart(rows: pa.Table) -> dict:
        e = _unpack(rows, STRINGS)
        order, later = _later(e["hash"], e["digit"], e["doc"])
        return {c: e[c][order][later] for c in ("doc", "row", "start")}

    def run(batches):
        found, n = [], 0
        for rows in groups(batches, ["kind", "to"]):
            kind = rows.column("kind")[0].as_py()
            if kind == 2:
                yield from rows.select(names).to_batches()
                continue
            found.append(compare(rows) if kind == 0 else apart(rows))
            n += len(found[-1]["doc"])
            if n >= 8 * PAIRS_PER_BATCH:
                yield from _gone(_join(found, {"doc": "<i8", "row": "<i8", "start": "<i4"}), doc_ranges, names)
                found, n = [], 0
        if n:
            yield from _gone(_join(found, {"doc": "<i8", "row": "<i8", "start": "<i4"}), doc_ranges, names)

    return run


def _runs_by_document(batches):
    """(doc, row, runs): all runs of a text that go, as one row: pairs (first string, number)."""
    for rows in groups(batches, ["to"]):
        e = _unpack(rows, RUNS)
        order = np.lexsort((e["start"], e["row"], e["doc"]))
        doc, row = e["doc"][order], e["row"][order]
        pairs = np.stack([e["start"][order], e["n"][order]], 1).astype("<i4")
        edges = [*_runs(doc, row).tolist(), len(doc)]
        for a in range(0, len(edges) - 1, 10_000):
            part = edges[a:a + 10_001]
            yield pa.RecordBatch.from_arrays([pa.array(doc[part[:-1]]), pa.array(row[part[:-1]]), pa.array([pairs[x:y].tobytes() for x, y in zip(part, part[1:])], pa.binary())],
                                             ["doc", "mark", "runs"])


def removed_bytes(size: int, runs: bytes, length: int, counts=None) -> np.ndarray:
    """(start, end) rows, in order and apart, of the bytes covered by the strings of a document's runs. counts(start, end)
    says whether a passage, a run of strings one byte apart, does."""
    pairs = np.frombuffer(runs, "<i4").reshape(-1, 2).astype(np.int64)
    if counts is not None and len(pairs):
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        end = np.maximum.accumulate(pairs.sum(1))
        first = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > end[:-1]]))
        last = np.append(first[1:], len(pairs)) - 1
        pairs = np.array([(a, b - a) for a, b in zip(pairs[first, 0].tolist(), end[last].tolist()) if counts(a, b - 1 + length)], np.int64).reshape(-1, 2)
    if not len(pairs):
        return np.zeros((0, 2), np.int64)
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, pairs[:, 0], 1)
    np.add.at(change, pairs[:, 0] + pairs[:, 1] - 1 + length, -1)
    gone = (np.cumsum(change) > 0).astype(np.int8)
    edge = np.diff(np.concatenate([[0], gone, [0]]))
    return np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)])


def repeated_runs(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, mark, runs) of the documents with strings that a smaller document holds too: the key, the hash of the text,
    and the strings' runs as a binary of (first start, number) pairs. See without_repeats."""
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} at least")
    spark = docs.sparkSession
    total = text_bytes(docs, text)
    n = partitions_for(spark, total, BYTES_PER_PARTITION)
    ranges, doc_ranges = (max(LEAST_RANGES, -(-total // b)) for b in (BYTES_PER_RANGE, BYTES_PER_DOC_RANGE))
    rows = docs.where(F.col(key).isNotNull() & (F.octet_length(text) >= length)).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    triples, answers = _schema(DIGITS, {"told": ""}), _schema({"doc": "", "mark": "", "told": ""})
    told = (rows.mapInArrow(_pass_digits(length, ranges, doc_ranges, triples), triples).repartition(n, "to").sortWithinPartitions("kind", "to")
            .mapInArrow(_settle_digits(doc_ranges, answers), answers))
    held = materialise(told.repartition(n, "to").sortWithinPartitions("to").mapInArrow(_by_document, "doc long, marks binary, told binary"), "told")
    found = _schema(PARTS, STRINGS, RUNS)
    strings = (rows.join(held, "doc").select("doc", "text", F.xxhash64("text").alias("row"), "marks", "told")
               .mapInArrow(_pass_strings(length, ranges, doc_ranges, found), found))
    runs = _schema(RUNS)
    gone = strings.repartition(n, "to").sortWithinPartitions("kind", "to").mapInArrow(_settle_strings(length, doc_ranges, runs), runs)
    return materialise(gone.repartition(n, "to").sortWithinPartitions("to").mapInArrow(_runs_by_document, "doc long, mark long, runs binary"), "runs")


def without_repeats(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text", keep=None, least_bytes: int = 0,
                    least_words: int = 0) -> DataFrame:
    """(kept, n_bytes, removed, kept_bytes) of every row of docs: its UTF-8 text without each byte that is covered by a
    string of `length` bytes that also starts in a document with a smaller key (an integer); removed holds the
    removed parts' starts and ends, flat. Strings are looked for in the texts as given; they lie in one document.
    kept is the column `keep` (default: the whole row as a struct), handed through. With least_bytes, a repeated passage
    (strings of which each starts a byte after the last) goes only if it has so many bytes, or least_words words.

    Null texts count as empty. Rows with a null key lose nothing and take nothing from others. Rows of one key take
    nothing from each other, whether their texts are equal or not. Texts shorter than `length` stay whole, of any
    length beyond are taken whole. An empty table gives none; further columns and their names do not matter."""
    runs = repeated_runs(docs, length, key, text)
    keep = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if keep is None else keep
    rows = docs.select(keep.alias("kept"), F.col(text).alias("text"), F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("mark"))
    joined = rows.join(runs, ["doc", "mark"], "left").select("kept", "text", "runs")
    schema = T.StructType([joined.schema["kept"], T.StructField("n_bytes", T.LongType()),
                           T.StructField("removed", T.ArrayType(T.IntegerType())), T.StructField("kept_bytes", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for part, texts in _texts(batch, "text"):
                gone, left = [], []
                for raw, found in zip(texts, part.column("runs").to_pylist()):
                    counts = (lambda a, b, raw=raw: b - a >= least_bytes or len(raw[a:b].split()) >= least_words) if least_bytes else None
                    parts = removed_bytes(len(raw), found or b"", length, counts)
                    gone.append(parts.ravel().tolist())
                    at = [0, *gone[-1], len(raw)]
                    left.append(b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2])))
                yield pa.RecordBatch.from_arrays([part.column("kept"), pa.array([len(t) for t in texts], pa.int64()),
                                                  pa.array(gone, pa.list_(pa.int32())), pa.array(left, pa.binary())], schema.names)

    return joined.mapInArrow(run, schema)


def report(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    out = without_repeats(docs, length, keep=F.col("doc_id"))
    return out.select(F.col("kept").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept_bytes")).alias("n_removed"),
                      (F.size("removed") / 2).cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


@F.pandas_udf(T.StringType())
def valid_text(raw: pd.Series) -> pd.Series:
    """UTF-8 bytes as text without the bytes of characters that are not whole; a null stays null."""
    return raw.map(lambda b: b.decode("utf-8", "ignore"), na_action="ignore")
