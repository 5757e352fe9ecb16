"""Token ids as flat binary files: unsigned little-endian integers, one file a partition, beside 64-bit document
offsets. Partition bases come from prefix sums over the files' token counts, and files are read by memory map.

A data set is a folder with, for partition k: part-k.bin (the ids of its documents end to end, 16 bits wide if the
vocabulary allows and 32 otherwise), part-k.idx (unsigned 64-bit: the first id of each document inside the file,
and the end), part-k.keys (the documents' keys, an Arrow file), and manifest.json (width, and for each file its
documents, ids and base: the ids in all files before it). Documents are in ascending order of their keys over all
files. A file gets its name only when it is whole, so a lost or repeated task leaves no part of one behind.
"""

from __future__ import annotations

import json
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlane.llm import libraries
from pitlane.llm.common import SLICE_BYTES, bounds, partitions_for, slices, text_bytes
from pitlane.llm.pieces import PieceCache, encode_texts

#: Text bytes a file is made of, about; files are as many as the texts need.
BYTES_PER_FILE = 128 << 20


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@lru_cache(maxsize=2)
def _worker(spec: str) -> PieceCache:
    """Distinct pre-tokens' ids as the library's own model gives them."""
    model = libraries.Tokenizer.from_str(spec).model
    stand_in = {b: c for c, b in libraries.STAND_INS.items() if b != 10}

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        text = b"\n".join(p.replace(b"\n", b"\0\0") if b"\n" in p else p for p in pieces)
        words = text.decode("latin-1").translate(stand_in).split("\n")
        for i, p in enumerate(pieces):
            if b"\n" in p:
                words[i] = p.decode("latin-1").translate(stand_in | {10: libraries.LINE_END})
        each = [[t.id for t in model.tokenize(w)] for w in words]
        return np.array([i for ids in each for i in ids], np.uint32), np.array([len(x) for x in each], np.int64)

    return PieceCache(encode)


def _document_ids(cache, classes, special: dict[str, int], end_id: int, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each with end_id behind it; number of ids of each text)."""
    parts = [libraries.split_special(t, list(special)) for t in texts]
    ids, count = encode_texts(cache, classes, [s for p in parts for s in p[0]])
    # After each part goes the special string's id that follows it, or the end id after a text's last.
    behind = np.array([i for p in parts for i in [*(special[s] for s in p[1]), end_id]], np.uint32)
    out = np.insert(ids, np.cumsum(count), behind)
    return out, np.diff(bounds(count + 1)[bounds([len(p[0]) for p in parts])])


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> dict:
    """Write the ids of every row of docs below folder, in ascending order of key, and return the manifest.

    Ids are those of the tokenizers library for the byte-level file at path without added special tokens, with
    end_id behind each document. Null texts count as empty (the end id alone), null keys come first, equal keys
    stand next to each other in any order, further columns are not read. An empty table gives a data set without
    files. One key may hold any share of the rows: a row number takes part in dealing them out."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    tokens, _, special = libraries.read_json_bpe(path)
    width = "<u2" if max(len(tokens) - 1, end_id, *special.values()) < 1 << 16 else "<u4"
    sent = spark.sparkContext.broadcast((spec, libraries.json_classes()))
    fields = T.StructType([T.StructField(n, T.LongType()) for n in ("part", "documents", "ids")])

    def run(batches):
        cache, classes = _worker(sent.value[0]), sent.value[1]
        where, root = store(folder)
        part, mark = TaskContext.get().partitionId(), uuid.uuid4().hex
        name = f"{root}/part-{part:06d}"
        counts, keys = [], []
        out = None
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in slices(sizes):
                out = out or where.open_output_stream(f"{name}.bin-{mark}")
                ids, count = _document_ids(cache, classes, special, end_id, [x or "" for x in batch.column(1).slice(a, b - a).to_pylist()])
                out.write(ids.astype(width).tobytes())
                counts.append(count)
            keys.append(batch.column(0))
        if out is None:
            return
        out.close()
        at = bounds(np.concatenate(counts))
        with where.open_output_stream(f"{name}.idx-{mark}") as f:
            f.write(at.astype("<u8").tobytes())
        with where.open_output_stream(f"{name}.keys-{mark}") as f, pa.ipc.new_file(f, pa.schema([(key, keys[0].type)])) as w:
            for k in keys:
                w.write(pa.record_batch([k], [key]))
        for kind in ("bin", "idx", "keys"):
            where.move(f"{name}.{kind}-{mark}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": [part], "documents": [len(at) - 1], "ids": [int(at[-1])]})

    where, root = store(folder)
    where.create_dir(root, recursive=True)
    n = partitions_for(spark, text_bytes(docs, text), BYTES_PER_FILE)
    files = (docs.select(F.col(key), F.col(text), F.monotonically_increasing_id().alias("row"))
             .repartitionByRange(n, F.col(key).asc_nulls_first(), F.col("row"))
             .sortWithinPartitions(F.col(key).asc_nulls_first()).select(key, text).mapInArrow(run, fields))
    rows = sorted(tuple(r) for r in files.collect())  # one row a file
    base = bounds([r[2] for r in rows]).tolist()
    manifest = {"width": width, "files": [{"part": p, "documents": d, "ids": i, "base": b} for (p, d, i), b in zip(rows, base)]}
    with where.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def open_flat(uri: str, name: str, kind: str) -> np.ndarray:
    """A flat file as an array: a memory map in a file system of this machine's, else its bytes."""
    where, root = store(uri)
    if isinstance(where, fs.LocalFileSystem):
        return np.memmap(f"{root}/{name}", kind, "r")
    with where.open_input_file(f"{root}/{name}") as f:
        return np.frombuffer(f.read(), kind)


def read_token_files(spark: SparkSession, folder: str, key_field: T.StructField) -> DataFrame:
    """(key, start, n_tokens, ids) of every document of a data set: the ids in all documents before it, how many it
    has, and its ids as little-endian unsigned 32-bit integers. One task a file."""
    where, root = store(folder)
    with where.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    files, width = manifest["files"], manifest["width"]
    fields = T.StructType([key_field, T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                name = f"part-{files[i]['part']:06d}"
                flat, at = open_flat(folder, f"{name}.bin", width), open_flat(folder, f"{name}.idx", "<u8").astype(np.int64)
                there, path = store(folder)
                with there.open_input_file(f"{path}/{name}.keys") as f:
                    keys = pa.ipc.open_file(f).read_all().column(0).combine_chunks()
                for a, b in slices((4 * np.diff(at)).tolist(), SLICE_BYTES):
                    ids = [flat[x:y].astype("<u4").tobytes() for x, y in zip(at[a:b], at[a + 1:b + 1])]
                    yield pa.RecordBatch.from_arrays([
                        keys.slice(a, b - a), pa.array(at[a:b] + files[i]["base"]), pa.array(np.diff(at[a:b + 1])),
                        pa.array(ids, pa.binary())], fields.names)

    return spark.range(0, len(files), 1, max(len(files), 1)).mapInArrow(run, fields)


