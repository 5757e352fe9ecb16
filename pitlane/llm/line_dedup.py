"""Line dedup: normalised lines are exploded and hashed, documents counted per hash, frequent lines dropped.

A scan explodes every text into thin rows (hash of the line's key, document, position); nothing of the text is shuffled
for counting. Documents per hash are counted with partial sums before each exchange, so a line that a third of all
documents holds costs a task one row. The hashes over the threshold go back to their lines in two ways that share one
rule: those with more than an even share of all repeats (HOT_KEYS at most, whatever the input) are broadcast, all
others meet their lines by a shuffle in which no key is larger than that share. The positions that go are gathered per
text, and each text is put together again from the lines that stay.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlane.llm.common import materialise, slices

#: Hashes that are broadcast at most: each of them has at least one part in so many of all counted repeats.
HOT_KEYS = 65_536
#: White space that is stripped from a line's ends, and the letters that are lower-cased.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """What lines are compared by: the line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def text_mark(text: Column) -> Column:
    """With the document's id, this tells which texts a decision about lines belongs to."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def long_lines(docs: DataFrame, min_chars: int, key: str, text: str) -> DataFrame:
    """(hash, doc, mark, pos) of every line whose key has min_chars code points or more, written: it is read twice."""
    lines = docs.select(F.col(key).alias("doc"), text_mark(F.col(text)).alias("mark"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))
    keyed = lines.where(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    return materialise(keyed.select(F.unhex(F.md5("key")).alias("hash"), "doc", "mark", "pos"), "lines")


def repeated_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """(hash, n, keeper) of the hashes that n >= min_docs documents hold; keeper is the largest of their ids."""
    held = lines.select("hash", "doc").distinct()
    return materialise(held.groupBy("hash").agg(F.count("*").alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= min_docs), "line-keys")


def positions(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc, mark, gone) with the sorted positions of the lines that each text loses."""
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = -(-int(total) // HOT_KEYS)
    hot, rest = repeated.where(F.col("n") >= share), repeated.where(F.col("n") < share)
    found = lines.join(F.broadcast(hot), "hash").unionByName(
        lines.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(rest, "hash"))
    lost = found.where(~F.col("doc").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc", "mark").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_lines, n_dropped, kept) of every row of docs: how many lines its text has, how many go, and the text of
    the lines that stay.

    A line whose key has min_chars code points or more and is found in min_docs documents or more stays only in the
    document with the largest id among them, there as often as it is; all others lose it, wherever it stands. Lines are
    cut at line feeds alone. A null or empty text is one empty line, and kept is empty; kept is empty too if every line
    goes. Rows of one id, null ids too, are one document: a key counts once for all of them, and they keep or lose it
    together; null ids are below all others. Repeated rows each give a row. Further columns are not read, whatever
    their names. An empty table gives none."""
    lines = long_lines(docs, min_chars, key, text)
    gone = positions(lines, repeated_keys(lines, min_docs))
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), text_mark(F.col(text)).alias("mark"))
    same = rows["doc"].eqNullSafe(gone["doc"]) & (rows["mark"] == gone["mark"])
    cut = rows.join(gone, same, "left").select(rows["doc"].alias(key), rows["text"], "gone")
    schema = T.StructType([T.StructField(key, cut.schema[key].dataType), T.StructField("n_lines", T.LongType()),
                           T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])

    def run(batches):
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in slices(sizes):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                drops = batch.column(2).slice(a, b - a).to_pylist()
                done = [without(t or "", d or ()) for t, d in zip(texts, drops)]
                n, lost, kept = zip(*done)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(lost, pa.int64()),
                                                  pa.array(kept, pa.string())], schema.names)

    return cut.mapInArrow(run, schema)


def without(text: str, gone) -> tuple[int, int, str]:
    """(lines, lines that go, the text of the others)."""
    if not gone:
        return text.count("\n") + 1, 0, text
    lines = text.split("\n")
    lost = set(gone)
    return len(lines), len(lost), "\n".join(x for i, x in enumerate(lines) if i not in lost)


def report(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    return dedup(docs, min_chars, min_docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
