"""Ranked search: against a plain scoring of all documents."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import regex

from pointweave.llm import search as s

TERM = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, best):
    """(item_id, rank, doc_id, score) by the formula alone."""
    held = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(x for _, c in held for x in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, c in held:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 20 * m)) for x in terms if x in c)
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(i, rank, d, -score) for rank, (score, d) in enumerate(sorted(scores)[:best], 1)]
    return sorted(out)


def corpus(seed, n, words=300):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["É", "中文", "x_y", "A-b"]
    share = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(7 * i % n, " ".join(r.choices(vocabulary, share, k=r.randrange(0, 120)))) for i in range(n)], [
        (i, " ".join(r.choices(vocabulary, share, k=r.randrange(1, 30)))) for i in range(12)
    ]


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("most_asked", [1 << 18, 40])
def test_best_are_those_of_a_plain_scoring(spark, most_asked):
    docs, items = corpus(1, 900)
    d, i = frames(spark, docs, items)
    got = s.search(d.repartition(5), i, best=10, shard_docs=100, most_asked=most_asked).collect()
    assert sorted(map(tuple, got)) == plain(docs, items, 10)


def test_ties_copies_and_special_rows(spark):
    docs = [(i, "same text here") for i in range(80, 0, -1)] + [(None, "same"), (500, None), (501, ""), (502, "..."), (7, "same text here"), (503, "rare " + "z " * 50_000)]
    items = [(1, "same text"), (1, "TEXT"), (2, ""), (3, None), (4, "absent"), (None, "same"), (5, "z rare")]
    d, i = frames(spark, docs, items)
    got = sorted(map(tuple, s.search(d.repartition(3), i, best=20, shard_docs=16).collect()))
    assert got == plain(docs, items, 20)
    assert [r[2] for r in got if r[0] == 1] == [1, 2, 3, 4, 5, 6, 7, 7, *range(8, 20)]
    assert s.search(d.limit(0), i).count() == 0 and s.search(d, i.limit(0)).count() == 0
    clash = d.selectExpr("doc_id", "text", "1 as item_id", "'x' as term", "2.0 as score")
    assert sorted(map(tuple, s.search(clash, i, best=20, shard_docs=16).collect())) == got


def shard_of(docs, weights):
    each = [Counter(t.split()) for _, t in docs]
    terms = {x: i for i, x in enumerate(sorted({x for c in each for x in c}))}
    sizes = np.array([len(c) for c in each])
    term = np.array([terms[x] for c in each for x in c], np.int64)
    tf = np.array([n for c in each for n in c.values()], np.int64)
    return terms, s.Shard(np.array([d for d, _ in docs]), sizes, term, tf * weights[term])


def test_documents_that_cannot_reach_the_threshold_are_not_scored():
    docs = [(i, "common " + ("rare" if i % 500 == 3 else "other")) for i in range(5000)]
    terms, shard = shard_of(docs, np.array([1, 2, 1000]))  # common, other, rare
    best = s.Best(5)
    shard.search(np.array([terms["common"], terms["rare"]]), best)
    assert best.doc.tolist() == [3, 503, 1003, 1503, 2003] and best.threshold == 1001
    assert shard.scored < 4000  # once five are found, none without the rare term
    again = shard.scored
    shard.search(np.array([terms["common"], terms["other"]]), best)
    assert shard.scored == again and best.threshold == 1001


def test_impacts_of_long_texts_are_exact():
    big = np.array([3_000_000_000], np.int64)
    got = s.impacts(np.array([5], np.int64), np.array([7], np.int64), big, 10**10, 4 * 10**12)
    assert got.tolist() == [7 * (5 * 10**9 // (5000 + 20 * (50 + 50 * 3_000_000_000 * 10**10 // (4 * 10**12))))]
