"""Neighbour joins where many points share a place, against brute force."""

import random

from pointweave.operators import spatial

rnd = random.Random(5)


def points(n, key):
    return [(g, i, float(rnd.randrange(3)), float(rnd.randrange(4)), float(rnd.randrange(3)) / 4) for g in (0, 1) for i in range(n if g else n // 3)], f"g int, {key} long, x double, y double, z double"


def brute(q, t, k):
    out = {}
    for g, i, *p in q:
        far = sorted((sum((a - b) ** 2 for a, b in zip(p, o, strict=True)), j) for h, j, *o in t if g == h)
        out[g, i] = far[:k]
    return out


def test_neighbours_at_shared_places(spark):
    q, t = points(120, "qid"), points(90, "tid")
    far = [(1, 1000, 6.0, -5.0, 2.0), (2, 1001, 0.0, 0.0, 0.0)]
    queries, targets = spark.createDataFrame(q[0] + far, q[1]), spark.createDataFrame(t[0], t[1])
    for k in (1, 4):
        got = {}
        for r in spatial.nearest(queries, targets, ("g",), k).collect():
            got.setdefault((r.g, r.qid), {})[r["rank"]] = (r.d2, r.tid)
        want = {a: dict(enumerate(b, 1)) for a, b in brute(q[0] + far, t[0], k).items() if b}
        assert got == want
    counts = {(r.g, r.qid): r.n for r in spatial.neighbours_in_radius(queries, targets, 1.0, ("g",)).collect()}
    assert counts == {a: sum(d <= 1 for d, _ in b) for a, b in brute(q[0] + far, t[0], 10**6).items()}


def test_coinciding_points_are_joined_once(spark):
    """The joins' rows are bounded by the places: 40,000 x 20,000 points at two places are four pairs, not 400 million."""
    queries = spark.range(40_000).selectExpr("id as qid", "id % 2 * 1.0D as x", "0.0D as y", "0.0D as z")
    targets = spark.range(20_000).selectExpr("id as tid", "id % 2 * 1.0D as x", "0.0D as y", "0.0D as z")
    near = spatial.nearest(queries, targets, (), 3).groupBy("qid").agg({"tid": "sum", "d2": "max"}).toDF("qid", "tids", "d2")
    assert {tuple(r) for r in near.selectExpr("qid % 2", "tids", "d2").distinct().collect()} == {(0, 6, 0.0), (1, 9, 0.0)} and near.count() == 40_000
    assert [tuple(r) for r in spatial.neighbours_in_radius(queries, targets, 10.0).groupBy("n").count().collect()] == [(20_000, 40_000)]
