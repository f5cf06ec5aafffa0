"""Tracking of patches from one frame into the next, on tables.

The patches of a frame are brought to the next frame's centroid, each is shifted by the mean way of its points to
their nearest, then registered to the whole frame, and the frame's points go to the patch whose moved points are
near. Registration is a loop over all patches of all frames at once: a join gives each point its nearest, sums of
products by patch are all that a rigid step needs (17 numbers a patch), and the steps are joined to the points
again. So no task holds a patch or a frame; patches that have settled leave the loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import affine
from ..params import Icp
from ..plans.store import dropped, outlast, passing, staged
from .registration import align_centroids, check
from .spatial import conditional_nearest, nearest

AXES = ("x", "y", "z")
#: Neighbours of a point that may take it, and how many times its patch's error one may be away.
NEIGHBOURS, TIMES = 5, 2.0


def rigid_from_sums(n: float, source: np.ndarray, target: np.ndarray, products: np.ndarray) -> np.ndarray:
    """The 4x4 rigid motion of least squares from the sums of n pairs: of points, of targets, and of source times target."""
    a, b = source / n, target / n
    u, _, vt = np.linalg.svd(products - n * np.outer(a, b))
    turn = vt.T @ np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0]) @ u.T
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = turn, b - turn @ a
    return out


def _pairs(points: DataFrame, target: DataFrame, by: list[str]) -> DataFrame:
    """by..., patch, pid, the points x, y, z and their nearest of the target, tid, tx, ty, tz, with d2."""
    found = nearest(points.select(*by, "patch", F.col("pid").alias("qid"), *AXES), target.select(*by, F.col("pid").alias("tid"), *AXES), tuple(by), more=("patch", *AXES))
    return found.withColumnRenamed("qid", "pid")


def _applied(points: DataFrame, steps: DataFrame, by: list[str]) -> DataFrame:
    moved = points.join(steps.select(*by, "patch", "step"), [*by, "patch"])
    return moved.select(*by, "patch", "pid", *(c.alias(a) for a, c in zip(AXES, affine("step", *AXES), strict=True)))


def shifted(points: DataFrame, target: DataFrame, by: list[str]) -> DataFrame:
    """Each patch moved by the mean way of its points to their nearest."""
    ways = _pairs(points, target, by).groupBy(*by, "patch").agg(*(F.avg(F.col(f"t{a}") - F.col(a)).alias(f"d{a}") for a in AXES))
    return points.join(ways, [*by, "patch"]).select(*by, "patch", "pid", *((F.col(a) + F.col(f"d{a}")).alias(a) for a in AXES))


def registered(points: DataFrame, target: DataFrame, by: list[str], icp: Icp) -> tuple[DataFrame, DataFrame]:
    """The points where registration to the whole target leaves them, and by..., patch, mse, converged. Patches without pairs stay, with an error of -1."""
    check(icp)
    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in (*by, "patch"))
    products = [(a, b) for a in AXES for b in AXES]

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                mv, ends = np.eye(4), r["n"] < 3
                if not ends:
                    mv = rigid_from_sums(r["n"], *(np.array([r[f"{side}{a}"] for a in AXES]) for side in "st"), np.array([r[f"p{a}{b}"] for a, b in products]).reshape(3, 3))
                    ends = ((mv - np.eye(4)) ** 2).sum() < icp.transformation_ths or abs((np.inf if pd.isna(r["before"]) else r["before"]) - r["mse"]) < icp.mse_ths * 1e-6
                rows.append([*(r[c] for c in (*by, "patch")), mv.ravel().tolist(), r["mse"] if r["n"] >= 3 else None, bool(ends)])
            yield pd.DataFrame(rows, columns=[*by, "patch", "step", "before", "ends"])

    spark = points.sparkSession
    left = points.select(*by, "patch", "pid", *AXES)
    before = points.select(*by, "patch").distinct().withColumn("before", F.lit(None).cast("double"))
    done, failed = [], []
    for i in range(icp.iteration_ths):
        with passing(spark):  # a round leaves its steps and each point once, settled or not
            near = _pairs(left, target, by).where(F.col("d2") <= icp.correspondence_ths**2)
            sums = near.groupBy(*by, "patch").agg(
                F.count("*").alias("n"), F.avg("d2").alias("mse"), *(F.sum(a).alias(f"s{a}") for a in AXES), *(F.sum(f"t{a}").alias(f"t{a}") for a in AXES), *(F.sum(F.col(a) * F.col(f"t{b}")).alias(f"p{a}{b}") for a, b in products)
            )
            asked = before.join(sums, [*by, "patch"], "left").fillna(0, ["n"])
            steps = outlast(asked.mapInPandas(step, f"{kinds}, step array<double>, before double, ends boolean"), "steps")
        moved = staged(_applied(left, steps, by), "moved")
        if i:
            dropped(left)
        ended = steps.select(*by, "patch").where("ends" if i + 1 < icp.iteration_ths else "true")
        failed.append(steps.where("before is null").select(*by, "patch"))
        before = steps.where("not ends").select(*by, "patch", "before")
        done.append(staged(moved.join(ended, [*by, "patch"], "left_semi"), "done"))
        if before.isEmpty():
            break
        left = staged(moved.join(before, [*by, "patch"], "left_semi"), "left")
        dropped(moved)
    settled, lost = done[0], failed[0]
    for d, f in zip(done[1:], failed[1:], strict=True):
        settled, lost = settled.unionByName(d), lost.unionByName(f)
    for used in (moved, left) if i else (moved,):
        dropped(used)
    lost = lost.select(*by, "patch", F.lit(False).alias("converged"))
    with passing(spark):
        final = _pairs(settled, target, by).groupBy(*by, "patch").agg(F.avg("d2").alias("mse")).join(lost, [*by, "patch"], "left").withColumn("converged", F.coalesce("converged", F.lit(True)))
        errors = outlast(final.select(*by, "patch", F.when(F.col("converged"), F.col("mse")).otherwise(-1.0).alias("mse"), "converged"), "errors")
    return settled, errors


def track(patches: DataFrame, target: DataFrame, by: list[str], icp: Icp | None = None) -> tuple[DataFrame, DataFrame]:
    """The target's points with the patch they go to, and the patches' errors.

    patches: by..., patch, pid (unique in a frame), x, y, z; target: by..., pid, x, y, z and any other columns. A point
    goes to the patch of the first of its NEIGHBOURS moved points that is nearer than TIMES its patch's error, else of the nearest.
    """
    icp = icp or Icp()
    here = patches.select(*by, "patch", "pid", *(F.col(a).cast("double").alias(a) for a in AXES))
    goal = target.select(*by, "pid", *(F.col(a).cast("double").alias(a) for a in AXES))
    spark = patches.sparkSession
    with passing(spark):
        if icp.centroid_alignment:
            here = staged(align_centroids(here, goal, by), "centred")
        start = outlast(shifted(here, goal, by), "shifted")
    moved, errors = registered(start, goal, by, icp)
    dropped(start)
    limits = errors.select(*by, "patch", (TIMES * F.col("mse")).alias("limit"))
    with passing(spark):
        hits = outlast(conditional_nearest(goal.withColumnRenamed("pid", "qid"), moved.withColumnRenamed("pid", "tid"), limits, tuple(by), NEIGHBOURS).select(*by, F.col("qid").alias("pid"), "patch"), "hits")
    return target.join(hits, [*by, "pid"]), errors
