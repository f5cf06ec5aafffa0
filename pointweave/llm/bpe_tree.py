"""Byte-level BPE by monoid tree reduction.

A text is halved until a part is short, parts are encoded on their own, and neighbours are joined.
A join concatenates the ids when the seam is a place where every context splits, which a blank after
a non-blank is: no match of the pattern holds a blank inside a word, and none looks further ahead
than that blank. Otherwise it re-encodes a window around the seam:

* the window grows, both ways, to the nearest such places; outside them nothing can change;
* inside a long run of letters, which is one match of the pattern, it grows by tokens until the pair
  of tokens at either rim stands by itself, that is, encodes to just those two. A sequence whose
  neighbours all stand by themselves is the encoding of the run, so tokens outside are settled.

Joining is associative, so the tree's shape has no influence on the ids. Decoding concatenates the
bytes of halves up the tree.

Results in special cases: a null or empty text has no ids (the hash is that of no bytes); texts are
encoded whole; strings of special tokens are ordinary text; rows are independent, so repeated rows
give repeated results and an empty table an empty one; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .common import map_texts, table, texts_of

LEAF_CHARS = 512
LEAF_IDS = 4096
#: Letters on both sides of a seam from which a window grows by tokens.
RUN_CHARS = 128


@lru_cache(maxsize=4)
def token_bytes(enc: tiktoken.Encoding) -> list[bytes]:
    out = [b""] * enc.n_vocab
    for token in enc.token_byte_values():
        out[enc.encode_single_token(token)] = token
    return out


def _left(text: str, lo: int, mid: int) -> int:
    """The last place in (lo, mid] that splits in every context, or lo."""
    at = mid + 1
    while (at := text.rfind(" ", lo + 1, at)) > lo:
        if not text[at - 1].isspace():
            return at
    return lo


def _right(text: str, mid: int, hi: int) -> int:
    at = mid - 1
    while (at := text.find(" ", at + 1, hi)) >= 0:
        if not text[at - 1].isspace():
            return at
    return hi


def _pop(ids: list[int], size: int, names: list[bytes], last: bool) -> int:
    """How many ids at one end make up so many bytes."""
    n = 0
    while size > 0:
        n += 1
        size -= len(names[ids[-n] if last else ids[n - 1]])
    if size:
        raise AssertionError("a window ends inside a token")
    return n


def _in_run(left: list[int], right: list[int], text: str, mid: int, enc: tiktoken.Encoding) -> list[int] | None:
    """Join inside a run of letters by tokens; None when no window within the run has settled rims."""
    names, piece = token_bytes(enc), enc._encode_single_piece
    for letters in (RUN_CHARS, 8 * RUN_CHARS, 64 * RUN_CHARS):
        a, b = text[max(0, mid - letters) : mid], text[mid : mid + letters]
        if len(a) < letters or len(b) < letters or not (a + b).isalpha():
            return None
        k = max(4, letters // 16)
        if k >= len(left) or k >= len(right):
            return None
        inner = [b"".join(names[i] for i in left[-k:]), b"".join(names[i] for i in right[:k])]
        before, after = left[-k - 1], right[k]
        if len(inner[0]) + len(names[before]) > len(a.encode()) or len(inner[1]) + len(names[after]) > len(b.encode()):
            continue
        window = piece(inner[0] + inner[1])
        settled = piece(names[before] + names[window[0]]) == [before, window[0]] and piece(names[window[-1]] + names[after]) == [window[-1], after]
        if settled:
            return [*left[:-k], *window, *right[k:]]
    return None


def join(left: list[int], right: list[int], text: str, lo: int, mid: int, hi: int, enc: tiktoken.Encoding) -> list[int]:
    """The ids of text[lo:hi] from those of its two parts."""
    if text[mid] == " " and not text[mid - 1].isspace():
        return left + right
    if text[mid - 1].isalpha() and text[mid].isalpha() and (joined := _in_run(left, right, text, mid, enc)) is not None:
        return joined
    a, b = _left(text, lo, mid), _right(text, mid, hi)
    names = token_bytes(enc)
    out = _pop(left, len(text[a:mid].encode()), names, True)
    off = _pop(right, len(text[mid:b].encode()), names, False)
    return left[: len(left) - out] + enc.encode_ordinary(text[a:b]) + right[off:]


def encode(text: str, enc: tiktoken.Encoding, leaf: int = LEAF_CHARS, lo: int = 0, hi: int | None = None) -> list[int]:
    hi = len(text) if hi is None else hi
    if hi - lo <= max(leaf, 2):
        return enc.encode_ordinary(text[lo:hi])
    mid = (lo + hi) // 2
    return join(encode(text, enc, leaf, lo, mid), encode(text, enc, leaf, mid, hi), text, lo, mid, hi, enc)


def decode(ids: list[int], enc: tiktoken.Encoding, leaf: int = LEAF_IDS) -> bytes:
    if len(ids) <= leaf:
        return enc.decode_bytes(ids)
    mid = len(ids) // 2
    return decode(ids[:mid], enc, leaf) + decode(ids[mid:], enc, leaf)


def bpe_encode(docs: DataFrame, ranks: str = bpe.RANKS, leaf: int = LEAF_CHARS) -> DataFrame:
    """doc_id, ids array<int>, decoded binary."""

    def run(texts: list[str], rest: dict) -> dict:
        enc = bpe.from_ranks(ranks)
        ids = [encode(x, enc, leaf) for x in texts]
        return {"doc_id": rest["doc_id"], "ids": ids, "decoded": [decode(x, enc) for x in ids]}

    return map_texts(texts_of(docs), "text", run, "doc_id long, ids array<int>, decoded binary")


def bpe_digests(docs: DataFrame, ranks: str = bpe.RANKS, leaf: int = LEAF_CHARS) -> DataFrame:
    """bpe_encode with hashes in place of ids and bytes, which then don't leave the Python worker."""

    def run(texts: list[str], rest: dict) -> dict:
        enc = bpe.from_ranks(ranks)
        ids = [encode(x, enc, leaf) for x in texts]
        return {
            "doc_id": rest["doc_id"],
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [hashlib.sha256(np.array(x, dtype="<u4").tobytes()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(decode(x, enc)).hexdigest() for x in ids],
        }

    return map_texts(texts_of(docs), "text", run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))
