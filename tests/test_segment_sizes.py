"""What segmentation asks for at size: no broadcast sides, only pairs of clusters that fit, all k-means rounds."""

import numpy as np

from pointweave.operators import cluster, spatial
from pointweave.plans.queries import QUERIES
from pointweave.plans.store import staged


def _assigned(spark, sizes):
    rows = [(0, c, 1000 * c + i, float(c), 0.0, 0.0) for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "ts int, cluster int, pid long, x double, y double, z double")


def test_neighbours_within_a_radius_are_not_broadcast(spark):
    places = staged(_assigned(spark, {c: 20 for c in range(5)}).selectExpr("ts", "pid as tid", "x", "y", "z"), "small")
    met = spatial.within_radius(places.withColumnRenamed("tid", "qid"), places, 1.0, ("ts",))
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 20 * 20 * (5 + 2 * 4)


def test_only_clusters_that_fit_are_paired(spark):
    got = cluster.close_points(_assigned(spark, {0: 9, 1: 6, 2: 4, 3: 8}), ["ts"], 5.0, most=12).collect()
    assert {(r.a, r.b) for r in got} == {(1, 2), (2, 1), (2, 3), (3, 2)}


def test_many_centres_are_met_by_cells(monkeypatch):
    random = np.random.default_rng(5)
    xyz, centres = random.integers(0, 30, (4000, 3)) + 0.0, random.integers(0, 30, (900, 3)) + 0.5  # many ties
    want = cluster.nearest_centres(xyz[:200], centres)
    met = []
    monkeypatch.setattr(cluster, "Cells", lambda c, own=cluster.Cells: met.append(len(c)) or own(c))
    got = cluster.nearest_centres(xyz, centres)
    assert met == [900] and np.array_equal(got[:200], want)


def test_k_means_of_dense_segments_is_not_cut(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(cluster, "k_means", lambda *a, own=cluster.k_means: seen.append(a[3:5]) or own(*a))
    assert QUERIES["dense_segment"](spark, "/root/testdata/sf0.001").count() == 10
    assert seen == [(100, 0.01)]
