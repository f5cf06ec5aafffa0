"""Quality rules: counts against a plain recount, the model on made junk, special cases."""

import random
import re

import numpy as np
import pytest

from pointweave.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def recount(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
        "n_repeat_words": len(covered),
    }


def made(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(["ab", "é", "中", "#", " ", " ", "\n", " ", "\t", "x"]) for _ in range(r.randrange(0, 60))) for _ in range(n)]


def test_counts_are_a_plain_recount():
    texts = ["", " ", "one", "a b c", "a b c a b c", "a a a a", "x\n x\nx\n\n\n", "a b c d a b", *made(3, 200), "w " * 3000]
    found = q.judged(texts, q.Model(), most=500)
    for i, text in enumerate(texts[:-1]):
        assert {k: int(found[k][i]) for k in recount("")} == recount(text), text
    assert found["n_words"][-1] == found["n_repeat_words"][-1] == 3000
    assert found["base_failed"].tolist() == [recount(t)["n_words"] < 50 or 100 * recount(t)["n_repeat_words"] > 50 * recount(t)["n_words"] for t in texts[:-1]] + [True]


def prose(r, n=80):
    return " ".join("".join(r.choice(["ba", "ko", "ri", "ten", "lu"]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def junk(r, n=80):
    return " ".join(x + r.choice(["&&&", "$$$", "%%%"]) for x in prose(r, n).split())


@pytest.fixture(scope="module")
def learnt(spark):
    r = random.Random(5)
    rows = [(i, junk(r) if i % 4 == 0 else prose(r)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)] + [(7, 0, 0), (9, None, 0), (11, 5, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, q.learn(docs, labels)


def test_held_out_rows_are_told_apart(spark, learnt):
    docs, _, model = learnt
    got = q.quality(docs.where(q.fold() == 0), model).collect()
    assert len(got) > 50 and all(r["kept"] == (r["doc_id"] % 4 != 0) for r in got)
    assert all(0 <= r["probability"] <= 1 for r in got)


def test_scores_do_not_depend_on_the_batch(learnt):
    model, r = learnt[2], random.Random(8)
    texts = [prose(r, n) for n in (1, 5, 60, 300)] + ["", "é" * 500, junk(r)] * 2
    one = [q.judged([t], model)["probability"][0] for t in texts]
    assert q.judged(texts, model)["probability"].tolist() == q.judged(texts, model, most=100)["probability"].tolist() == one


def test_special_rows(spark, learnt):
    docs, labels, model = learnt
    rows = [(None, None, "x"), (1, "", "x"), (2, prose(random.Random(1)), None), (2, prose(random.Random(1)), None), (3, "w " * 200_000, "x")]
    own = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = q.quality(own, model).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in got) == [(0, 0, False), (1, 0, False), (2, 80, True), (2, 80, True), (3, 200_000, False)]
    assert sorted(map(tuple, q.of_quality(own, model).collect())) == [rows[2], rows[3]]
    assert q.quality(own.limit(0), model).count() == 0
    for none in (labels.limit(0), labels.where("quality = 1"), labels.select("doc_id", "toxic").selectExpr("doc_id", "int(null) quality", "toxic")):
        bare = q.learn(docs, none)
        assert not bare.fitted and q.judged([prose(random.Random(2))], bare)["kept"].all()
    assert not q.learn(docs.limit(0), labels).fitted


def test_curve_recovers_a_made_one():
    r = np.random.default_rng(3)
    score = r.normal(size=20_000) * 2
    slope, shift = q._curve(score, (r.random(20_000) < 1 / (1 + np.exp(-(1.7 * score - 0.6)))).astype(float))
    assert abs(slope - 1.7) < 0.1 and abs(shift + 0.6) < 0.1
