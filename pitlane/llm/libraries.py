"""What the operators take from the tokenizer libraries and vocabulary files, read on the driver and sent to tasks."""

from __future__ import annotations

import base64
import json
import re

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer, pre_tokenizers

from pitlane.llm.pieces import library_classes

#: The byte that each printable stand-in of a byte-level vocabulary file means: printable Latin-1 bytes stand for
#: themselves, the others for the code points from 256 on, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
STAND_INS = {chr(b): b for b in _PRINTABLE} | {
    chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a .tiktoken file in rank order (line k holds rank k, or ranks are dense: both are checked)."""
    with open(path, "rb") as f:
        found = {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
    if sorted(found) != list(range(len(found))):
        raise ValueError(f"{path}: ranks are not dense")
    return [found[i] for i in range(len(found))]


def read_json_bpe(path: str) -> tuple[list[bytes], dict[tuple[int, int], tuple[int, int]], dict[str, int]]:
    """(bytes of each id, {(left id, right id): (rank, id of both)}, special strings with ids) of a byte-level BPE
    .json file. Only files that this reader's split covers are accepted."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"], spec["model"]
    if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or model["type"] != "BPE":
        raise ValueError(f"{path}: not a plain byte-level BPE file")
    vocab = model["vocab"]
    tokens = [b""] * (max(vocab.values()) + 1)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    for text, i in vocab.items():
        if text not in special:
            tokens[i] = bytes(STAND_INS[c] for c in text)
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges[vocab[a], vocab[b]] = rank, vocab[a + b]
    return tokens, merges, special


def json_classes() -> np.ndarray:
    """Character classes as the tokenizers library's byte-level split has them."""
    pre = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def joins(strings: list[str]) -> np.ndarray:
        one = np.zeros(len(strings), bool)
        found = {a for _, (a, b) in pre.pre_tokenize_str("\n".join(strings)) if b - a == 2}
        one[[i for i in range(len(strings)) if 3 * i in found]] = True
        return one

    return library_classes(joins)


def rank_classes(pattern: str) -> np.ndarray:
    """Character classes as the tiktoken library's pattern engine has them."""

    def joins(strings: list[str]) -> np.ndarray:
        ranks = {bytes([i]): i for i in range(256)}
        ranks |= {s.encode(): 256 + i for i, s in enumerate(strings)}
        enc = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        one = np.zeros(len(strings), bool)
        got = np.array(enc.encode_ordinary("\n".join(strings)))
        one[got[got >= 256] - 256] = True
        return one

    return library_classes(joins)


def library_tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


def split_special(text: str, special: list[str]) -> tuple[list[str], list[str]]:
    """(the parts of a text around the special strings in it, those strings)."""
    if not any(s in text for s in special):
        return [text], []
    found = re.split("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")", text)
    return found[::2], found[1::2]


#: How the line end is written in a byte-level vocabulary.
LINE_END = next(c for c, b in STAND_INS.items() if b == 10)
