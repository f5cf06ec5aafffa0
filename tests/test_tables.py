"""Joins, clustering and stages on tables."""

import numpy as np
from pyspark.sql import functions as F

from pointweave.functions import scalar as fn
from pointweave.operators import cluster, spatial
from pointweave.params import Params
from pointweave.plans import stages


def cloud(spark, n=120, seed=0, ts=0, width=60):
    xyz = np.random.default_rng(seed).integers(0, width, (n, 3))
    rows = [(ts, i, *map(float, p), int(p[0]) % 256, int(p[1]) % 256, 9) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "ts int, pid long, x double, y double, z double, r int, g int, b int")


def test_nearest_is_brute_force(spark):
    a, b = cloud(spark, 40, 1), cloud(spark, 50, 2).where("x > 20 or pid < 3")
    got = {(r.qid, r["rank"]): (r.tid, r.d2) for r in spatial.nearest(a.withColumnRenamed("pid", "qid"), b.withColumnRenamed("pid", "tid"), ("ts",), 3, 2.0).collect()}
    pa, pb = ({r.pid: np.array([r.x, r.y, r.z]) for r in df.collect()} for df in (a, b))
    for q, p in pa.items():
        want = sorted((float(((p - t) ** 2).sum()), i) for i, t in pb.items())[:3]
        assert [got[q, k + 1] for k in range(3)] == [(i, d) for d, i in want]
    few = spatial.nearest(a.withColumnRenamed("pid", "qid"), b.limit(2).withColumnRenamed("pid", "tid"), ("ts",), 3)
    assert few.count() == 80 and spatial.nearest(a.withColumnRenamed("pid", "qid"), b.where("false").withColumnRenamed("pid", "tid"), ("ts",)).count() == 0


def test_segments_partition_the_cloud(spark):
    points = cloud(spark, 200, 3)
    out = cluster.dense_segments(points, ["ts"], num=40, blocks=2, radius2=50.0, rounds=2, edge=16.0)
    sizes = [r.n for r in out.groupBy("patch").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 200 and len(sizes) >= 4 and out.select("pid").distinct().count() == 200
    same = spark.createDataFrame([("b", i, 1.0, 1.0, 1.0) for i in range(9)], "block string, pid long, x double, y double, z double")
    assert cluster.split_to(same, [], 2).select("block").distinct().count() == 1


def test_a_whole_run(spark):
    first = cloud(spark, 90, 4, 1, 20)
    points = first.unionByName(first.withColumn("ts", F.lit(2)).withColumn("x", F.col("x") + 0.5))
    params = Params().with_(segment={"num": 60, "block_num": 1.0}, patch={"fitting_ths": 100.0, "max_iter": 5, "interpolation_num": 2}, icp={"iteration_ths": 20, "mse_ths": 50.0}, zstd_level=1)
    patches = stages.segment(points, params)
    assert patches.count() == 180 and {r.ts: r.type for r in patches.select("ts", "type").distinct().collect()} == {1: 0, 2: 1}
    slices = stages.compress(patches, stages.deform(patches, params), params)
    decoded, quality = stages.decompress(slices, points)
    assert {r.ts for r in decoded.select("ts").distinct().collect()} == {1, 2}
    assert all(r.geometry_psnr > 40 for r in quality.collect())


def test_edges_of_scalars(spark):
    row = spark.range(1).select(fn.psnr(F.lit(0.0)).alias("p"), fn.haar(F.lit(1.0), F.lit(2.0), F.lit(0), F.lit(0))[0].alias("h"), fn.tree_height(F.lit(0.0)).alias("t"), *(c.alias(n) for c, n in zip(fn.yuv_to_rgb(F.lit(255.0), F.lit(255.0), F.lit(255.0)), "rgb", strict=True))).first()
    assert row["p"] is None and (row["h"], row["t"], row["r"], row["b"]) == (0.0, 1, 255, 255)
