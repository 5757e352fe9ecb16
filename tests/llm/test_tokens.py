"""Encoding, counting and token files against the tokenizer libraries themselves."""

import hashlib
import random
import uuid
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from helpers import edge_docs, edge_rows, no_docs, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pitlane.llm import libraries, prefix_bpe, token_counts, token_files
from pitlane.llm.pieces import encode_texts
from pitlane.session import scratch_path

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    ranks = {t: i for i, t in enumerate(libraries.read_ranks(RANKS))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def bpe():
    return prefix_bpe._worker(*prefix_bpe.packed_ranks(RANKS, P.PATTERN))


def spread(flat, count):
    return [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] if len(count) else []


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab cde'stréüñ\n  the9!#日\U0001F600AÃÂ\x85\x1c"), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=4))
def test_prefix_encoding_is_the_librarys(texts, bpe, reference):
    table, cache = bpe
    assert spread(*encode_texts(cache, table.classes, texts)) == [reference.encode_ordinary(t) for t in texts]


def test_any_bytes_encode_as_one_piece(bpe, reference):
    table, r = bpe[0], random.Random(3)
    for _ in range(3000):
        piece = b"".join(r.choice(table.tokens) for _ in range(r.randint(1, 4)))
        assert table.ids(piece, table.last_tokens(piece)) == reference._core_bpe.encode_single_piece(piece)


def test_appends_extend_the_table(bpe):
    table, r = bpe[0], random.Random(4)
    for _ in range(300):
        piece = b"".join(r.choice(table.tokens) for _ in range(4))
        k = r.randint(0, len(piece))
        assert table.last_tokens(piece, table.last_tokens(piece[:k])) == table.last_tokens(piece)


@settings(max_examples=60, deadline=None)
@given(data=st.data())
def test_edits_encode_near_the_edit_only(data, bpe, reference):
    chars = st.text(alphabet="ab cd'streéll\n  9!", max_size=12)
    text = data.draw(st.text(alphabet="ab cd'streéll\n  9!", max_size=60))
    state = prefix_bpe.EditableEncoding(bpe[0], text)
    for _ in range(4):
        a = data.draw(st.integers(0, len(state.text)))
        b = data.draw(st.integers(a, min(len(state.text), a + 4)))
        state.replace(a, b, data.draw(chars))
        state.append(data.draw(chars))
        assert state.ids() == reference.encode_ordinary(state.text)
    long = prefix_bpe.EditableEncoding(bpe[0], prose(1, 3000))
    assert long.replace(5000, 5001, "Q") < 12


def test_a_small_cache_gives_the_same_ids(bpe, reference):
    small = prefix_bpe.PieceCache(bpe[0].encode_pieces, limit=50, bits=6)
    texts = [prose(i, 200) for i in range(8)]
    for t in texts * 2:
        assert spread(*encode_texts(small, bpe[0].classes, [t])) == [reference.encode_ordinary(t)]


def test_encoded_documents(spark, reference):
    docs = edge_docs(spark)
    out = prefix_bpe.encoded_digests(docs, RANKS, P.PATTERN).collect()

    def want(i, t):
        ids = reference.encode_ordinary(t or "")
        return (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())

    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, out), key=key) == sorted((want(r[0], r[1]) for r in edge_rows()), key=key)
    assert prefix_bpe.encoded_digests(no_docs(spark), RANKS, P.PATTERN).count() == 0
    apart = prefix_bpe.decode_documents(prefix_bpe.encode_documents(docs, RANKS, P.PATTERN), RANKS)
    assert sorted(map(tuple, prefix_bpe.digests(apart).collect()), key=key) == sorted(map(tuple, out), key=key)


def test_token_counts(spark, library):
    out = token_counts.count_tokens(edge_docs(spark), JSON, 512).collect()

    def want(i, t):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        return i, len((t or "").encode()), n, n > 512

    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, out), key=key) == sorted((want(r[0], r[1]) for r in edge_rows()), key=key)
    assert token_counts.count_tokens(no_docs(spark), JSON, 512).count() == 0


def test_merges_of_runs_and_long_pieces(library):
    cache = token_counts._worker(*(a.tobytes() for a in token_counts.merger_arrays(JSON)))
    texts = ["a" * n for n in range(1, 40)] + ["ab" * 300, "ÃÂ" * 200, "".join(map(chr, range(33, 2000))), "x" * 5000]
    value, one = encode_texts(cache, libraries.json_classes(), texts)
    assert [sum(x) for x in spread(value, one)] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_files_round_trip(spark, library):
    docs = edge_docs(spark)
    folder = scratch_path(spark, f"test-tokens-{uuid.uuid4().hex}")
    manifest = token_files.write_token_files(docs, folder, JSON, end_id=0)
    assert manifest["width"] == "<u2" and sum(f["documents"] for f in manifest["files"]) == docs.count()
    back = token_files.read_token_files(spark, folder, docs.schema["doc_id"]).orderBy("start").collect()
    ids = [library.encode(t or "", add_special_tokens=False).ids + [0] for _, t, *_ in edge_rows()]
    assert sorted(r["ids"] for r in back) == sorted(np.array(i, "<u4").tobytes() for i in ids)
    assert [r["start"] for r in back] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in back])[:-1]]).tolist()
    keys = [r["doc_id"] for r in back]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))  # nulls first, then ascending
    flat = token_files.open_flat(folder, f"part-{manifest['files'][0]['part']:06d}.bin", "<u2")
    assert flat.tolist()[:back[0]["n_tokens"]] == np.frombuffer(back[0]["ids"], "<u4").tolist()
    assert all(zlib.crc32(r["ids"]) >= 0 for r in back)


def test_token_files_of_nothing(spark):
    folder = scratch_path(spark, f"test-tokens-{uuid.uuid4().hex}")
    assert token_files.write_token_files(no_docs(spark), folder, JSON, end_id=0)["files"] == []
    assert token_files.read_token_files(spark, folder, no_docs(spark).schema["doc_id"]).count() == 0
