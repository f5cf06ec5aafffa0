"""Close points of clusters are counted by place, however many points coincide."""

from pointweave.operators import cluster


def test_coinciding_points_are_one_row_with_their_number(spark):
    at = {0: [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0)], 1: [(2.0, 0.0, 0.0), (9.0, 0.0, 0.0)]}
    rows = [(7, c, 100 * (2 * c + i) + k, *p) for c, ps in at.items() for i, p in enumerate(ps) for k in range(30)]
    df = spark.createDataFrame(rows, "ts int, cluster int, pid long, x double, y double, z double")
    got = {(r.pid, r.a, r.b, r.hits, r.points) for r in cluster.close_points(df, ["ts"], 1.5).collect()}
    assert got == {(100, 0, 1, 30, 30), (200, 1, 0, 30, 30)}


def test_coinciding_points_count_when_clusters_merge(spark):
    # 6 points of one place have 6 of the other near: enough on both counts, which one place each would not be
    rows = [(7, c, 10 * c + k, 3.0 * c, 0.0, 0.0) for c in (0, 1) for k in range(6)]
    df = spark.createDataFrame(rows, "ts int, cluster int, pid long, x double, y double, z double")
    assert {r.patch for r in cluster.merge_small(df, ["ts"], 20, 3.0).collect()} == {0}
    assert {r.patch for r in cluster.merge_small(df.where("pid % 10 < 4"), ["ts"], 20, 3.0).collect()} == {0, 1}
