"""Cross-tokenizer alignment: which tokens of two vocabularies end together, and how often over all texts.

Each text is encoded by both tokenizers. The byte offsets where tokens of both end cut them into groups; the two
tokens that end there are a link. An id pair is one int64, the first id in the upper half. A task counts the
distinct pairs of its documents (np.unique), the partial counts are sorted over ranges of pairs and equal ones
summed as runs, and each range becomes a shard: a sorted file of pairs and one of counts in the shared folder.
For the figures of a document its pairs are searched in the memory-mapped shards that hold their range.

A shard's file names carry the task's attempt, and only those that a finished task has returned are read, so
tasks may run again. Where the shared folder is no local one, a task maps a copy of the shards it needs that
goes with it. What is held is bounded by the vocabularies: the highest count of each id of the second, and a task's
distinct pairs up to MOST_HELD, beyond which it hands on what it has counted and begins anew.

Results in special cases: texts that are null or empty, or that either tokenizer does not give back byte by byte
(the second may join blanks or replace characters), have zeros and an empty groups_sha256 and link nothing; special
tokens' strings are plain text; ties for the highest count are all best; repeated rows count as often as they
occur; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import drop_kept, give_back, keep, map_texts, table, texts_of, work_dir

PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Pairs that a task collects before it counts them, and distinct ones that it holds.
MOST_RAW, MOST_HELD = 1 << 21, 1 << 21
LOW = (1 << 32) - 1


class Side:
    """A vocabulary's token bytes, their lengths and the ids as text with what may follow."""

    def __init__(self, tokens: list[bytes], end: str):
        self.tokens = tokens
        self.sizes = np.array([len(x) for x in tokens], np.int64)
        self.inner = np.array([f"{i}," for i in range(len(tokens))], object)
        self.last = np.array([f"{i}{end}" for i in range(len(tokens))], object)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def byte_side(path: str = bpe.VOCABULARY) -> Side:
    enc = bpe.from_vocabulary(path)
    tokens = [b""] * enc.n_vocab
    for token in enc.token_byte_values():
        tokens[enc.encode_single_token(token)] = token
    return Side(tokens, "|")


@functools.lru_cache(maxsize=2)
def piece_side(path: str = PIECES) -> tuple[sentencepiece.SentencePieceProcessor, Side]:
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    return pieces, Side([bytes([int(x[3:5], 16)]) if pieces.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)], ";")


def aligned(text: str, vocabulary: str = bpe.VOCABULARY, model: str = PIECES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Ids of both sides, and where in each the groups end; None where there are no tokens."""
    if not text:
        return None
    (pieces, b), a, want = piece_side(model), byte_side(vocabulary), (" " + text).encode()
    b_list = pieces.encode(text, num_threads=1)
    if b.joined(b_list) != want:
        return None
    a_list = bpe.from_vocabulary(vocabulary).encode_ordinary(" " + text)
    if a.joined(a_list) != want:
        return None
    a_ids, b_ids = np.array(a_list, np.int64), np.array(b_list, np.int64)
    a_end, b_end = np.cumsum(a.sizes[a_ids]), np.cumsum(b.sizes[b_ids])
    both = np.zeros(len(want) + 1, np.int8)
    both[a_end] += 1
    both[b_end] += 1
    return a_ids, b_ids, np.flatnonzero(both[a_end] == 2), np.flatnonzero(both[b_end] == 2)


def shown(a_ids: np.ndarray, b_ids: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, a: Side, b: Side) -> str:
    """The groups as text: ids of the first, a bar, ids of the second; groups set apart by semicolons."""
    a_names, b_names = a.inner[a_ids], b.inner[b_ids]
    a_names[a_last], b_names[b_last] = a.last[a_ids[a_last]], b.last[b_ids[b_last]]
    a_sizes, b_sizes = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
    out = np.empty(len(a_ids) + len(b_ids), object)
    out[np.arange(len(a_ids)) + np.repeat(b_last - b_sizes + 1, a_sizes)] = a_names
    out[np.arange(len(b_ids)) + np.repeat(a_last + 1, b_sizes)] = b_names
    return "".join(out.tolist())[:-1]


def alignments(docs: DataFrame, vocabulary: str = bpe.VOCABULARY, model: str = PIECES) -> DataFrame:
    """doc_id, a and b array<int>, a_last and b_last array<int>: ids of both sides and the last place of each group in them; null without tokens."""

    def run(texts: list[str], rest: dict) -> dict:
        found = [aligned(x, vocabulary, model) for x in texts]
        return {"doc_id": rest["doc_id"], **{name: [None if x is None else x[i] for x in found] for i, name in enumerate(("a", "b", "a_last", "b_last"))}}

    return map_texts(texts_of(docs), "text", run, "doc_id long, a array<int>, b array<int>, a_last array<int>, b_last array<int>")


def linked(docs: DataFrame, vocabulary: str = bpe.VOCABULARY, model: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, and the distinct pairs of the document with how often it has them, as bytes."""

    def run(texts: list[str], rest: dict) -> dict:
        out = {"doc_id": rest["doc_id"], "n_a": [], "n_b": [], "n_groups": [], "groups_sha256": [], "pairs": [], "times": []}
        a, b = byte_side(vocabulary), piece_side(model)[1]
        for text in texts:
            found = aligned(text, vocabulary, model)
            if found is None:
                row = (0, 0, 0, "", b"", b"")
            else:
                a_ids, b_ids, a_last, b_last = found
                pairs, times = np.unique(a_ids[a_last] << 32 | b_ids[b_last], return_counts=True)
                digest = hashlib.sha256(shown(*found, a, b).encode()).hexdigest()
                row = (len(a_ids), len(b_ids), len(a_last), digest, np.diff(pairs, prepend=0).astype("<i8").tobytes(), times.astype("<u4").tobytes())
            for name, value in zip(("n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"), row, strict=True):
                out[name].append(value)
        return out

    return map_texts(texts_of(docs), "text", run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary, times binary")


def _pairs(column: pa.Array) -> list[np.ndarray]:
    """The pairs of each row, which are stored as differences."""
    return [np.cumsum(np.frombuffer(x.as_buffer(), "<i8")) for x in column]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def partial_counts(documents: DataFrame, most_raw: int = MOST_RAW, most_held: int = MOST_HELD) -> DataFrame:
    """pair, n: counts of each task's documents; a pair has a row for each task that has it, or a few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        keys, counts, n = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _summed(np.concatenate([held[0], *keys]), np.concatenate([held[1], *counts]))

        for batch in batches:
            for pairs, times in zip(_pairs(batch.column("pairs")), batch.column("times"), strict=True):
                keys.append(pairs)
                counts.append(np.frombuffer(times.as_buffer(), "<u4").astype(np.int64))
                n += len(pairs)
                if n >= most_raw:
                    held, keys, counts, n = merged(), [], [], 0
                    if len(held[0]) >= most_held:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["pair", "n"])
                        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        held = merged()
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["pair", "n"])
        give_back()

    return documents.where("n_groups > 0").select("pairs", "times").mapInArrow(run, "pair long, n long")


def count_shards(counts: DataFrame, folder: str) -> DataFrame:
    """Sum sorted runs and write a shard for each range of pairs; a row for each shard, with the highest count of each of its second ids."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct pairs with their sums; the last run of a batch may go on in the next."""
        open_run = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            keys, n = (np.concatenate((x, batch.column(c).to_numpy())) for x, c in zip(open_run, ("pair", "n"), strict=True))
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            keys, n = keys[first], np.add.reduceat(n, first)
            open_run = (keys[-1:], n[-1:])
            yield keys[:-1], n[:-1]
        yield open_run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        best: dict[str, np.ndarray] = {"b": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)}
        first = last = None
        total, files = 0, None
        for keys, n in runs(batches):
            if not len(keys):
                continue
            if files is None:
                store.create_dir(root, recursive=True)
                files = [store.open_output_stream(f"{root}/{name}.{kind}") for kind in ("pairs", "counts")]
                first = int(keys[0])
            last, total = int(keys[-1]), total + len(keys)
            files[0].write(keys.astype("<i8").tobytes())
            files[1].write(n.astype("<i8").tobytes())
            b = np.concatenate((best["b"], keys & LOW))
            top = np.concatenate((best["n"], n))
            order = np.lexsort((-top, b))
            b, top = b[order], top[order]
            new = np.concatenate(([True], b[1:] != b[:-1]))
            best = {"b": b[new], "n": top[new]}
        if files is not None:
            for file in files:
                file.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([first]), pa.array([last]), pa.array([total]), pa.array([best["b"]]), pa.array([best["n"]])], names=["name", "first", "last", "n", "b", "best"]
            )
        give_back()

    ranges = counts.repartitionByRange("pair").sortWithinPartitions("pair")
    return ranges.mapInArrow(run, "name string, first long, last long, n long, b array<long>, best array<long>")


class Counts:
    """Counts of pairs in the shards, which are mapped when first asked for."""

    def __init__(self, folder: str, shards: list[tuple[str, int, int, int]]):
        self.folder, self.shards = folder, sorted(shards, key=lambda s: s[1])
        self.first = [s[1] for s in self.shards]
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _mapped(self, store: fs.FileSystem, path: str, n: int) -> np.ndarray:
        if isinstance(store, fs.LocalFileSystem):
            return np.memmap(path, "<i8", "r", shape=(n,))
        copy = tempfile.TemporaryFile()  # has no name, so nothing stays of it
        with store.open_input_stream(path) as source:
            while part := source.read(1 << 22):
                copy.write(part)
        copy.flush()
        return np.memmap(copy, "<i8", "r", shape=(n,))

    def _shard(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.open:
            store, root = fs.FileSystem.from_uri(self.folder)
            name, _, _, n = self.shards[i]
            self.open[i] = (self._mapped(store, f"{root}/{name}.pairs", n), self._mapped(store, f"{root}/{name}.counts", n))
        return self.open[i]

    def of(self, pairs: np.ndarray) -> np.ndarray:
        """The counts of sorted distinct pairs, all of which have been counted."""
        out, at = np.zeros(len(pairs), np.int64), 0
        while at < len(pairs):
            i = bisect.bisect_right(self.first, int(pairs[at])) - 1
            end = int(np.searchsorted(pairs, self.first[i + 1])) if i + 1 < len(self.first) else len(pairs)
            known, counts = self._shard(i)
            place = np.searchsorted(known, pairs[at:end])
            if not np.array_equal(known[place], pairs[at:end]):
                raise LookupError(f"a pair that is in no shard of {self.folder}")
            out[at:end] = counts[place]
            at = end
        return out


def with_counts(documents: DataFrame, folder: str, shards: list[tuple[str, int, int, int]], best: np.ndarray) -> DataFrame:
    """The figures of each document: its links, those that are the best of their second id, and the sum of their counts."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(folder, shards)
        for batch in batches:
            each = _pairs(batch.column("pairs"))
            times = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in batch.column("times"))])
            distinct, place = np.unique(np.concatenate([np.zeros(0, np.int64), *each]), return_inverse=True)
            n = counts.of(distinct)
            is_best = n == best[distinct & LOW]
            ends = np.cumsum([0] + [len(x) for x in each])
            sums = [np.concatenate(([0], np.cumsum(x)))[ends] for x in (times, times * is_best[place], times * n[place])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(np.diff(s)) for s in sums)], names=[*names, "n_links", "n_best", "count_sum"])
        give_back()

    return documents.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long")


def alignment_counts(docs: DataFrame, vocabulary: str = bpe.VOCABULARY, model: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum for each row."""
    spark = docs.sparkSession
    folder = f"{work_dir(spark)}/pointweave/shards-{uuid.uuid4().hex}"
    documents = keep(linked(docs, vocabulary, model), "links")
    partial = keep(partial_counts(documents), "counts")
    manifest = keep(count_shards(partial, folder), "shards")
    shards = [tuple(r) for r in manifest.select("name", "first", "last", "n").collect()]
    best = np.zeros(len(piece_side(model)[1].tokens), np.int64)
    # a row for each id of the second vocabulary at most
    tops = manifest.select(F.explode(F.arrays_zip("b", "best")).alias("x")).groupBy("x.b").agg(F.max("x.best").alias("n"))
    for b, n in tops.collect():
        best[b] = n
    out = keep(with_counts(documents, folder, shards, best), "aligned")
    for used in (documents, partial, manifest):
        drop_kept(used)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment_counts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
