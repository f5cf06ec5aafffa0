"""Quality and size figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import PEAK_GEOMETRY, PEAK_LUMA, bitrate_mbps, psnr, rgb_to_yuv
from .spatial import nearest


def valid_scores(score: str) -> list[Column]:
    """Least, largest, mean and population deviation of the scores that are not negative (negative or null: no score)."""
    s = F.when(F.col(score) >= 0, F.col(score))
    return [F.count(s).alias("n"), F.min(s).alias("least"), F.max(s).alias("largest"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("deviation")]


def patch_sizes(points: DataFrame, *by: str) -> DataFrame:
    """Patches, points, and mean, least, largest and deviation of patch sizes per group."""
    sizes = points.groupBy(*by, "patch").agg(F.count("*").alias("n"))
    return sizes.groupBy(*by).agg(F.count("*").alias("patches"), F.sum("n").alias("points"), F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("largest"), F.stddev_pop("n").alias("deviation"))


def weighted_mse(scores: DataFrame, *by: str) -> DataFrame:
    """Mean of mse weighted by n over the scored rows, and how many have one."""
    ok = F.col("mse") >= 0
    total = F.sum(F.when(ok, F.col("n")))
    return scores.groupBy(*by).agg((F.sum(F.when(ok, F.col("mse") * F.col("n"))) / F.when(total > 0, total)).alias("mse"), F.count(F.when(ok, 1)).alias("converged"), F.min(F.when(ok, F.col("mse"))).alias("least"), F.max(F.when(ok, F.col("mse"))).alias("largest"))


def directed_mse(source: DataFrame, target: DataFrame, *by: str) -> DataFrame:
    """by..., and the means of the squared distance and YUV differences from each source point to its nearest target."""
    ends = nearest(source.withColumnRenamed("pid", "qid"), target.withColumnRenamed("pid", "tid"), by)

    def coloured(df: DataFrame, key: str, side: str) -> DataFrame:
        return df.select(*by, F.col("pid").alias(key), *(c.alias(f"{n}_{side}") for c, n in zip(rgb_to_yuv("r", "g", "b"), "yuv", strict=True)))

    both = ends.join(coloured(source, "qid", "a"), [*by, "qid"]).join(coloured(target, "tid", "b"), [*by, "tid"])
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.avg("d2").alias("geometry"), *(F.avg((F.col(f"{n}_a") - F.col(f"{n}_b")) ** 2).alias(n) for n in "yuv"))


def symmetric_mse(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """The worse of both directions; null where a cloud is empty."""
    ab, ba = directed_mse(a, b, *by), directed_mse(b, a, *by)
    names = ("geometry", "y", "u", "v")
    both = ab.select(*by, *(F.col(n).alias(f"{n}_ab") for n in names)).join(ba.select(*by, *(F.col(n).alias(f"{n}_ba") for n in names)), list(by), "full")
    return both.select(*by, *(F.when(F.col(f"{n}_ab").isNotNull() & F.col(f"{n}_ba").isNotNull(), F.greatest(f"{n}_ab", f"{n}_ba")).alias(n) for n in names))


def pair_scores(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """by..., direction (ab, ba, or worse of both), geometry, y, u, v."""
    names = ("geometry", "y", "u", "v")
    ab, ba = (d.select(*by, F.lit(name).alias("direction"), *names) for d, name in ((directed_mse(a, b, *by), "ab"), (directed_mse(b, a, *by), "ba")))
    both = ab.unionAll(ba)
    worse = both.groupBy(*by).agg(F.count("*").alias("n"), *(F.max(n).alias(n) for n in names)).where("n = 2")
    return both.unionByName(worse.select(*by, F.lit("worse").alias("direction"), *names))


def score_stats(scores: DataFrame, channel: str = "geometry", direction: str = "worse", *by: str) -> DataFrame:
    """Figures of the valid scores of one channel in one direction."""
    return scores.where(F.col("direction") == direction).groupBy(*by).agg(*valid_scores(channel))


def quality(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """Geometry and luma PSNR per group."""
    mse = symmetric_mse(a, b, *by)
    return mse.select(*by, psnr("geometry", PEAK_GEOMETRY).alias("geometry_psnr"), psnr("y", PEAK_LUMA).alias("luma_psnr"))


def mean_quality(scores: DataFrame, *by: str) -> DataFrame:
    """frames, and the means of their PSNRs; frames without a score count in neither mean."""
    return scores.groupBy(*by).agg(F.count("*").alias("frames"), F.avg("geometry_psnr").alias("geometry_psnr"), F.avg("luma_psnr").alias("luma_psnr"))


def stream_sizes(slices: DataFrame) -> DataFrame:
    """Slices and bytes per frame, and of all frames (ts null), with the bit rate of the whole."""
    sums = slices.rollup("ts").agg(F.count("*").alias("slices"), F.sum("bytes").alias("bytes"), F.countDistinct("ts").alias("_frames"))
    return sums.select("ts", "slices", "bytes", F.when(F.col("ts").isNull(), bitrate_mbps("bytes", F.col("_frames"))).alias("mbps"))


