"""Lexical retrieval packing: sequences filled with a seed document's nearest unused neighbours.

Documents are encoded once and kept. Those with like vocabulary are dealt into the same shard, a
range of a weighted min-hash of their tokens that holds up to SHARD_DOCS documents and about SHARD_IDS ids,
so that copies of one text, however many, spread over as many shards as they need. A table within these
bounds is one shard, in which BM25 sees all of it; in a larger one a seed sees its shard's documents. A shard
builds its inverted index of token ids with BM25 weights; document frequencies and lengths are counted over
all documents. A task reads its shards one after another, so its memory is that of one shard.

The postings of a shard's DENSE commonest tokens are held as columns over its unused documents, those of the
others as lists: the scores of several seeds are then one product of matrices, in single precision, and
count to three decimals.

A document of at least a whole sequence fills sequences of its own first. The rest of each is
packed: the longest unused rest is the seed, BM25 ranks all unused documents of the shard for the
seed's whole text, those that fit are taken in that order, and the best of the others is cut to fill
what room is left; its remainder stays unused. So all sequences of a shard but the last are full, and
the last one's tokens are cut into sequences whose lengths are powers of two, which take no padding.

Results in special cases: a null or empty text is the one separator id; texts are encoded whole, and a special
token's string in a text is that token, as in the library; ties in rank go by (doc_id, ids); rows are packed one
by one, so repeated rows give pieces of their own; an empty table gives none; only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import give_back, keep, map_texts, table, texts_of

SEQUENCE, SEPARATOR = 2048, 1
#: Large shards cost CPU time in proportion, but a seed can see no further than its own: tables within these bounds are searched whole.
SHARD_DOCS, SHARD_IDS = 16_384, 1 << 25
#: Tokens of a shard whose postings are columns, and seeds that are scored at once.
DENSE, SEEDS = 1024, 48
K1, B = 1.2, 0.75
#: Ids at the start of a vocabulary are its commonest; a token's weight in the sign rises with its id.
SIGN_POWER = 3.0

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _signs(n_vocab: int) -> np.ndarray:
    """A random rank of each token; a document's least one is its sign."""
    u = np.random.default_rng(11).random(n_vocab)
    return -np.log(u) / ((np.arange(n_vocab) + 1.0) / n_vocab) ** SIGN_POWER


def encoded(docs: DataFrame, vocabulary: str = bpe.VOCABULARY, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, ids (little-endian, of 2 or 4 bytes by vocabulary) with the separator, their number and the shard sign."""
    wide, code = ("<u2", "H") if bpe.from_vocabulary(vocabulary).n_vocab <= 1 << 16 else ("<u4", "I")

    def run(texts: list[str], rest: dict) -> dict:
        enc = bpe.from_vocabulary(vocabulary)
        rank = _signs(enc.n_vocab)
        ids = [array(code, bpe.as_library(enc, x)) for x in texts]
        for x in ids:
            x.append(separator)
        return {"doc_id": rest["doc_id"], "ids": [x.tobytes() for x in ids], "n": [len(x) for x in ids], "sign": [float(rank[np.frombuffer(x, wide)].min()) for x in ids]}

    return map_texts(texts_of(docs), "text", run, "doc_id long, ids binary, n long, sign double")


def token_counts(tokens: DataFrame, n_vocab: int, wide: str) -> np.ndarray:
    """How many documents have each token: one count per token and task, summed; as long as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(n_vocab, np.int64)
        for batch in batches:
            each = [np.unique(np.frombuffer(ids.as_buffer(), wide)) for ids in batch.column("ids")]
            if each:
                found += np.bincount(np.concatenate(each), minlength=n_vocab)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], names=["token", "n"])

    sums = tokens.select("ids").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = np.zeros(n_vocab, np.int64)
    for token, n in sums.collect():
        counts[token] = n
    return counts


class Index:
    """BM25 over a shard's documents: columns of weights for its commonest tokens, postings sorted by token for the others."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean: float):
        each = [np.unique(x, return_counts=True) for x in texts]
        self.terms = [t for t, _ in each]
        term = np.concatenate(self.terms)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in self.terms])
        tf = np.concatenate([c for _, c in each]).astype(np.float32)
        length = np.array([len(x) for x in texts], np.float32)[doc]
        weight = idf.astype(np.float32)[term] * tf * np.float32(K1 + 1) / (tf + np.float32(K1) * (np.float32(1 - B) + np.float32(B / mean) * length))
        held = np.bincount(term, minlength=len(idf))
        common = np.argsort(-held, kind="stable")[: min(DENSE, np.count_nonzero(held))]
        self.column = np.full(len(idf), -1, np.int32)
        self.column[common] = np.arange(len(common))
        at = self.column[term]
        self.dense = np.zeros((len(texts), len(common)), np.float32)
        self.dense[doc[at >= 0], at[at >= 0]] = weight[at >= 0]
        rest = np.flatnonzero(at < 0)
        rest = rest[np.argsort(term[rest], kind="stable")]
        self.doc, self.weight = doc[rest], weight[rest]
        self.known, first = np.unique(term[rest], return_index=True)
        self.first = np.append(first, len(rest))
        self.rows = np.arange(len(texts))
        self.row_of = np.arange(len(texts))

    def keep_only(self, used: np.ndarray) -> None:
        """Leave out the rows of used documents, in place."""
        stay = np.flatnonzero(~used[self.rows])
        for i in range(0, len(stay), 1024):
            self.dense[i : i + 1024][: len(stay[i : i + 1024])] = self.dense[stay[i : i + 1024]]
        self.dense = self.dense[: len(stay)]
        self.rows = self.rows[stay]
        self.row_of[:] = -1
        self.row_of[self.rows] = np.arange(len(self.rows))

    def scores(self, of: int) -> np.ndarray:
        """Of the documents in rows, for the terms of one of them."""
        return self.scores_of([of])[0]

    def scores_of(self, seeds: list[int]) -> np.ndarray:
        """The same for several: a row each."""
        asked = np.zeros((len(seeds), self.dense.shape[1]), np.float32)
        for i, seed in enumerate(seeds):
            at = self.column[self.terms[seed]]
            asked[i, at[at >= 0]] = 1
        out = asked @ self.dense.T
        for i, seed in enumerate(seeds):
            term = self.terms[seed]
            at = np.searchsorted(self.known, term[self.column[term] < 0])
            start, size = self.first[at], self.first[at + 1] - self.first[at]
            if size.sum():
                postings = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                row = self.row_of[self.doc[postings]]
                out[i] += np.bincount(row[row >= 0], self.weight[postings][row >= 0], len(self.rows)).astype(np.float32)
        return out


def _ranked(score: np.ndarray, most: int = 32) -> np.ndarray:
    """Places of the highest scores, and of all that equal the last of them, highest first and ties in order."""
    if len(score) > most:
        top = np.flatnonzero(score >= np.partition(score, len(score) - most)[len(score) - most])
        return top[np.argsort(-score[top], kind="stable")]
    return np.argsort(-score, kind="stable")


def pack(texts: list[np.ndarray], idf: np.ndarray, mean: float, most: int = SEQUENCE) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold each id of the texts once."""
    out = [[(d, s, most)] for d, x in enumerate(texts) for s in range(0, len(x) - most + 1, most)]
    start = np.array([len(x) // most * most for x in texts], np.int64)
    left = np.array([len(x) for x in texts], np.int64) - start
    if not left.any():
        return out
    index = Index(texts, idf, mean)
    index.keep_only(left == 0)
    last: list[tuple[int, int, int]] = []
    # the longest rest first; one that has been cut is a seed in its old place, if it isn't taken before
    seeds = np.argsort(-left, kind="stable")
    while len(seeds := seeds[left[seeds] > 0]):
        if np.count_nonzero(left[index.rows]) < 0.8 * len(index.rows):
            index.keep_only(left == 0)
        rows = index.rows
        asked = seeds[:SEEDS].tolist()
        for seed, score in zip(asked, index.scores_of(asked).round(3), strict=True):
            if not left[seed]:
                continue
            sequence, room = [(seed, int(start[seed]), int(left[seed]))], most - int(left[seed])
            left[seed] = 0
            while room:  # the best of those that fit, again and again
                sizes = left[rows]
                fit = np.flatnonzero((sizes > 0) & (sizes <= room))
                if not len(fit):
                    break
                for d in rows[fit[_ranked(score[fit])]].tolist():
                    if left[d] <= room:
                        sequence.append((d, int(start[d]), int(left[d])))
                        room -= int(left[d])
                        left[d] = 0
            if room and len(over := np.flatnonzero(left[rows])):
                d = int(rows[over[score[over].argmax()]])
                sequence.append((d, int(start[d]), room))
                start[d] += room
                left[d] -= room
                room = 0
            if room:
                last = sequence
            else:
                out.append(sequence)
        seeds = seeds[len(asked) :]
    return out + _powers(last)


def _powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A short sequence as several whose lengths are powers of two."""
    total, out = sum(n for _, _, n in pieces), []
    rest = list(reversed(pieces))
    for size in (1 << b for b in reversed(range(total.bit_length())) if total >> b & 1):
        sequence, room = [], size
        while room:
            d, s, n = rest.pop()
            take = min(n, room)
            sequence.append((d, s, take))
            room -= take
            if take < n:
                rest.append((d, s + take, n - take))
        out.append(sequence)
    return out


def _shards(batches: Iterator[pa.RecordBatch], wide: str, shard_docs: int, shard_ids: int) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """(doc_id, ids) of sorted rows, cut so that a shard holds up to shard_docs documents and shard_ids ids, or one document."""
    shard, total = [], 0
    for batch in batches:
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
            x = np.frombuffer(ids.as_py(), wide)
            if shard and (len(shard) >= shard_docs or total + len(x) > shard_ids):
                yield shard
                shard, total = [], 0
            shard.append((doc_id, x))
            total += len(x)
    if shard:
        yield shard


def packed(docs: DataFrame, vocabulary: str = bpe.VOCABULARY, separator: int = SEPARATOR, most: int = SEQUENCE, shard_docs: int = SHARD_DOCS, shard_ids: int = SHARD_IDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    spark = docs.sparkSession
    n_vocab = bpe.from_vocabulary(vocabulary).n_vocab
    wide = "<u2" if n_vocab <= 1 << 16 else "<u4"
    tokens = keep(encoded(docs, vocabulary, separator), "tokens")
    total = tokens.agg(F.count("*").alias("docs"), F.sum("n").alias("ids")).first()
    counts = token_counts(tokens, n_vocab, wide)
    idf = np.log1p((total["docs"] - counts + 0.5) / (counts + 0.5))
    shared = spark.sparkContext.broadcast((idf, (total["ids"] or 1) / max(1, total["docs"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for shard in _shards(batches, wide, shard_docs, shard_ids):
            texts = [x for _, x in shard]
            out: list[tuple] = []
            for sequence in pack(texts, *shared.value, most):
                offset = 0
                for d, s, n in sequence:
                    out.append((shard[d][0], s, n, zlib.crc32(texts[d][s : s + n].astype("<u4").tobytes()), len(texts[d]), base, offset))
                    offset += n
                base += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PIECES, strict=True)], schema=PIECES)
            del shard, texts, out
            give_back()

    # ranges are drawn by sampling, so a shard of full size may be followed by a smaller one
    ranges = max(1, -(-total["docs"] // shard_docs), -(-(total["ids"] or 0) // shard_ids))
    order = ["sign", F.col("doc_id").asc_nulls_last(), F.crc32("ids")]
    dealt = tokens.select("doc_id", "ids", "sign").repartitionByRange(ranges, *order).sortWithinPartitions(*order, "ids")
    return dealt.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
