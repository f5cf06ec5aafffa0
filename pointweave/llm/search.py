"""Ranked lexical search: WAND over document shards, with whole-number scores.

A first pass counts the items' terms in whole texts and keeps, for each document, its length and the terms it
shares with any item. From that come the counts over all documents, and from these each posting's impact, its
share of a score. A shard is an index of up to SHARD_DOCS documents: the postings of a term by document, and the
term's maximum impact. The 50 best so far of an item set its threshold.

WAND asks of a document whether the maximum impacts of the terms it has can reach the threshold; the next that
can is the pivot, and all before it are skipped. Here the pivots of a window of documents are selected together:
terms go from the highest maximum down, a document enters only through a term from which the maxima that are
left still reach the threshold, the others' postings are only looked up for documents that can still reach it,
and the documents whose maxima do are scored in full. The threshold then rises, for the next window, and is
handed on from shard to shard of a task. The shards' best are merged by rank.

Items are searched in blocks of about MOST_ASKED terms, so what a task holds of them is bounded by that and the
terms of one item. A document counts in all statistics whether or not it shares a term.

Results in special cases: null or empty texts have no term, nor are they counted; an item without terms, or
whose terms no document has, has no rows; equal scores go by ascending doc_id; repeated rows of documents are
documents each and may take several ranks, repeated items and items of one id are one item with the terms of
all; rows whose id is null are not ranked or asked, though such documents count; an empty table gives no rows;
only the ids and text are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_kept, give_back, keep, map_texts, table

BEST = 50
#: Documents of a shard, those of the first window of a shard and of its largest.
SHARD_DOCS, FIRST_WINDOW, LARGEST_WINDOW = 16_384, 512, 8192
#: Terms of the items that are searched at once.
MOST_ASKED = 1 << 18
#: Letters, digits and all that isn't ASCII make terms; A-Z as a-z.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_TERM).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, weights: np.ndarray, length: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """What each posting adds to a score."""
    if int(length.max(initial=0)) * 50 * n_docs < 1 << 62:
        scaled = 50 * length * n_docs // total
    else:
        scaled = np.array([50 * int(n) * n_docs // total for n in length], np.int64)
    return weights * (1_000_000_000 * tf // (1000 * tf + 20 * (50 + scaled)))


class Best:
    """The best documents of an item so far, highest score first, then least doc_id."""

    def __init__(self, most: int):
        self.most = most
        self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def threshold(self) -> int:
        """What a document must reach to come in."""
        return int(self.score[-1]) if len(self.score) == self.most else 1

    def add(self, doc: np.ndarray, score: np.ndarray) -> None:
        score, doc = np.concatenate((self.score, score)), np.concatenate((self.doc, doc))
        order = np.lexsort((doc, -score))[: self.most]
        self.score, self.doc = score[order], doc[order]


class Shard:
    """An inverted index of documents, which stand in the order of their ids."""

    def __init__(self, doc: np.ndarray, sizes: np.ndarray, term: np.ndarray, impact: np.ndarray):
        by_id = np.argsort(doc, kind="stable")
        self.doc = doc[by_id]
        place = np.empty(len(doc), np.int64)
        place[by_id] = np.arange(len(doc))
        owner = np.repeat(place, sizes)
        order = np.lexsort((owner, term))
        self.owner, self.impact = owner[order].astype(np.int32), impact[order]
        self.known, self.first = np.unique(term[order], return_index=True)
        self.highest = np.maximum.reduceat(self.impact, self.first) if len(self.first) else np.zeros(0, np.int64)
        self.last = np.append(self.first[1:], len(order))
        self.scored = 0

    def lists(self, terms: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Documents, impacts and highest impact of each term, the highest first."""
        at = np.searchsorted(self.known, terms)
        at = at[(at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == terms)] if len(self.known) else at[:0]
        at = at[self.highest[at] > 0]
        at = at[np.argsort(-self.highest[at], kind="stable")]
        return [(self.owner[self.first[i] : self.last[i]], self.impact[self.first[i] : self.last[i]], int(self.highest[i])) for i in at]

    def search(self, terms: np.ndarray, best: Best) -> None:
        """Put the documents of this shard that belong there among the best."""
        lists = self.lists(terms)
        left = np.cumsum([0] + [m for _, _, m in reversed(lists)])[::-1].tolist()  # left[i]: the maxima of list i and all after it
        lo, width = 0, FIRST_WINDOW
        cursor = [0] * len(lists)
        while lists and lo < len(self.doc) and left[0] >= best.threshold:
            hi = min(lo + width, len(self.doc))
            ends = [c + int(np.searchsorted(owner[c:], hi)) for c, (owner, _, _) in zip(cursor, lists, strict=True)]
            inside = [(owner[c:e], impact[c:e], m) for c, e, (owner, impact, m) in zip(cursor, ends, lists, strict=True)]
            pivots = self._pivots(inside, left, lo, hi, best.threshold)
            if len(pivots):
                self.scored += len(pivots)
                best.add(self.doc[pivots], self._scores(inside, pivots))
            lo, cursor, width = hi, ends, min(2 * width, LARGEST_WINDOW)

    @staticmethod
    def _pivots(inside: list, left: list[int], lo: int, hi: int, threshold: int) -> np.ndarray:
        """The documents from lo up to hi whose terms' maxima sum to the threshold at least."""
        bound, entered = np.zeros(hi - lo, np.int64), 0
        while entered < len(inside) and left[entered] >= threshold:
            bound[inside[entered][0] - lo] += inside[entered][2]
            entered += 1
        found = np.flatnonzero((bound > 0) & (bound + left[entered] >= threshold))
        bound = bound[found]
        for i in range(entered, len(inside)):
            if not len(found):
                break
            owner = inside[i][0]
            if len(owner):
                at = np.minimum(np.searchsorted(owner, found + lo), len(owner) - 1)
                bound = bound + inside[i][2] * (owner[at] == found + lo)
            stay = bound + left[i + 1] >= threshold
            found, bound = found[stay], bound[stay]
        return found + lo

    @staticmethod
    def _scores(inside: list, docs: np.ndarray) -> np.ndarray:
        score = np.zeros(len(docs), np.int64)
        for owner, impact, _ in inside:
            if len(owner):
                at = np.minimum(np.searchsorted(owner, docs), len(owner) - 1)
                score += impact[at] * (owner[at] == docs)
        return score


def shared_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, the number n of its terms, and which of the vocabulary it has how often; documents without terms are left out."""

    def run(texts: list[str], rest: dict) -> dict:
        n, term, tf = [], [], []
        for text in texts:
            words = terms_of(text)
            found = Counter(map(vocabulary.get, words))
            found.pop(None, None)
            n.append(len(words))
            term.append(list(found))
            tf.append(list(found.values()))
        return {"doc_id": rest["doc_id"], "n": n, "term": term, "tf": tf}

    return map_texts(docs.select("doc_id", "text"), "text", run, "doc_id long, n long, term array<int>, tf array<long>").where("n > 0")


def asked_terms(items: DataFrame) -> DataFrame:
    """The (item_id, term) pairs of all items, once each."""

    def run(texts: list[str], rest: dict) -> dict:
        return {"item_id": rest["item_id"], "term": [sorted(set(terms_of(x))) for x in texts]}

    each = map_texts(items.select("item_id", "text").where("item_id is not null"), "text", run, "item_id long, term array<binary>")
    return each.select("item_id", F.explode("term").alias("term")).distinct()


def _search_block(docs: DataFrame, asked: list[tuple[int, bytes]], best: int, shard_docs: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, t in asked}))}
    queries: dict[int, list[int]] = {}
    for item, term in asked:
        queries.setdefault(item, []).append(vocabulary[term])
    wanted = [(item, np.array(sorted(terms), np.int64)) for item, terms in sorted(queries.items())]
    index = keep(shared_terms(docs, vocabulary), "search")
    n_docs, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # a row for each term of this block of items at most
    df = dict(index.select(F.explode("term").alias("term")).groupBy("term").count().collect())
    weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(vocabulary))], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best(best) for _ in wanted]
        held: list[pa.RecordBatch] = []

        def search() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            doc, n = rows["doc_id"].to_numpy(), rows["n"].to_numpy()
            sizes = rows["term"].combine_chunks().value_lengths().to_numpy()
            term, tf = (rows[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("term", "tf"))
            shard = Shard(doc, sizes, term, impacts(tf, weights[term], np.repeat(n, sizes), n_docs, total))
            for (_, terms), own in zip(wanted, found, strict=True):
                shard.search(terms, own)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= shard_docs:
                search()
                held.clear()
        if held:
            search()
        give_back()
        for (item, _), own in zip(wanted, found, strict=True):
            if len(own.doc):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own.doc), item)), pa.array(own.doc), pa.array(own.score)], names=["item_id", "doc_id", "score"])

    # as many tasks as shards, as each task gives its best of each item
    ranked = index.where("doc_id is not null and size(term) > 0").coalesce(max(1, -(-n_docs // shard_docs)))
    out = keep(ranked.mapInArrow(run, "item_id long, doc_id long, score long"), "found")
    drop_kept(index)
    return out


def search(docs: DataFrame, items: DataFrame, best: int = BEST, shard_docs: int = SHARD_DOCS, most_asked: int = MOST_ASKED) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each item."""
    asked = keep(asked_terms(items), "asked")
    blocks = max(1, -(-asked.count() // most_asked))
    found = None
    for block in range(blocks):
        pairs = [(r["item_id"], bytes(r["term"])) for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()]
        part = _search_block(docs, pairs, best, shard_docs)
        found = part if found is None else found.unionAll(part)
    drop_kept(asked)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


def op12_wand_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
