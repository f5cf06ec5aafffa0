"""Segmentation of clouds into patches: block splits, k-means, dense and reference segmentation.

Loops run over whole tables: each round splits, assigns or averages all blocks and clusters of all
clouds at once, and is staged, so lineage doesn't grow. The merge of small clusters is sequential by
its definition; it runs per cloud on counts of close pairs, which are a table of cluster pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError, Kind
from ..plans.store import append, new_stage, staged
from .registration import Cells
from .spatial import AXES, CELLS, centroid, nearest, with_block, within_radius
from .windows import apportion

#: A merged or kept cluster may be this much larger than its target.
TOLERANCE = 0.2
CLOSE_POINTS = 4
#: Centres that go to all tasks, about 3 MB; more are joined.
MOST_HELD = 1 << 16
#: Distances to centres that are held at once.
PAIRS = 1 << 18


def split_once(points: DataFrame, by: list[str], most: int) -> DataFrame:
    """Each block of more than `most` points in two: along its longest axis (x before y before z), at the middle, below it and not.

    points: by..., block, pid, x, y, z; blocks are strings, of which a split one's parts end in a and b.
    A block whose points coincide stays whole.
    """
    w = Window.partitionBy(*by, "block")
    extent = {a: F.max(a).over(w) - F.min(a).over(w) for a in AXES}
    out = points.withColumns({f"_e{a}": e for a, e in extent.items()} | {f"_m{a}": (F.max(a).over(w) + F.min(a).over(w)) / 2 for a in AXES} | {"_n": F.count("*").over(w)})
    z = F.col("_ez") > F.greatest("_ex", "_ey")
    x = F.col("_ex") > F.col("_ey")
    low = F.when(z, F.col("z") < F.col("_mz")).when(x, F.col("x") < F.col("_mx")).otherwise(F.col("y") < F.col("_my"))
    split = (F.col("_n") > most) & (F.greatest("_ex", "_ey", "_ez") > 0)
    return out.withColumn("block", F.when(split, F.concat("block", F.when(low, "a").otherwise("b"))).otherwise(F.col("block"))).select(*points.columns)


def oversize(points: DataFrame, by: list[str], most: int) -> DataFrame:
    """Blocks that a split would change."""
    ends = [(F.max(a) - F.min(a)).alias(a) for a in AXES]
    return points.groupBy(*by, "block").agg(F.count("*").alias("n"), *ends).where((F.col("n") > most) & (F.greatest(*AXES) > 0))


def split_to(points: DataFrame, by: list[str], most: int, rounds: int = 64) -> DataFrame:
    """Splits until no block that can be split has more than `most` points. Splits are independent, so all are made in parallel."""
    for _ in range(rounds):
        if oversize(points, by, most).isEmpty():
            break
        points = staged(split_once(points, by, most), "split")
    return points


def nearest_centres(xyz: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of each point's nearest centre (ties: the first), by cells where pairs are many."""
    if len(xyz) * len(centres) > PAIRS and np.isfinite(xyz).all() and np.isfinite(centres).all():
        return Cells(centres).nearest(xyz)[0]
    step = max(1, PAIRS // max(1, len(centres)))
    out = np.empty(len(xyz), np.int64)
    for i in range(0, len(xyz), step):
        d = xyz[i : i + step, None] - centres[None]
        out[i : i + step] = (d[..., 0] ** 2 + d[..., 1] ** 2 + d[..., 2] ** 2).argmin(1)
    return out


Held = dict[tuple, tuple[np.ndarray, np.ndarray]]


def held_centres(centres: DataFrame, by: list[str], most: int) -> Held | None:
    """The clusters and centres of each cloud, in the order of clusters; None if they are more than `most`."""
    rows = centres.select(*by, "cluster", *(f"c{a}" for a in AXES)).limit(most + 1).collect()
    if len(rows) > most:
        return None
    groups: dict[tuple, list] = {}
    for r in sorted(rows, key=lambda r: r["cluster"]):
        groups.setdefault(tuple(r)[: len(by)], []).append(tuple(r)[len(by) :])
    return {k: (np.array([r[0] for r in rs]), np.array([r[1:] for r in rs], float)) for k, rs in groups.items()}


def _clouds(batch: pd.DataFrame, by: list[str], held: Held):
    """(cloud, its points in the batch, the place of each one's nearest centre)."""
    for key, group in batch.groupby(by, sort=False):
        if key in held:
            yield key, group, nearest_centres(group[list(AXES)].to_numpy(float), held[key][1])


def _assign_held(points: DataFrame, held: Held, by: list[str]) -> DataFrame:
    points = points.drop("cluster")
    shared = points.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        for batch in batches:
            for key, group, at in _clouds(batch, by, shared.value):
                yield group.assign(cluster=shared.value[key][0][at])

    return points.mapInPandas(run, T.StructType([*points.schema.fields, T.StructField("cluster", T.IntegerType())]))


def _assign_joined(points: DataFrame, centres: DataFrame, by: list[str], edge: float) -> DataFrame:
    targets = centres.select(*by, F.col("cluster").alias("tid"), *(F.col(f"c{a}").alias(a) for a in AXES))
    met = nearest(points.withColumnRenamed("pid", "qid"), targets, tuple(by), 1, edge)
    return points.drop("cluster").join(met.select(*by, F.col("qid").alias("pid"), F.col("tid").alias("cluster")), [*by, "pid"])


def assign(points: DataFrame, centres: DataFrame, by: list[str], edge: float = 8.0, most_held: int = MOST_HELD) -> DataFrame:
    """points with the nearest centre's cluster (ties: the least). centres: by..., cluster, cx, cy, cz.

    Up to most_held centres go to all tasks; more are joined by grid cells.
    """
    held = held_centres(centres, by, most_held)
    return _assign_joined(points, centres, by, edge) if held is None else _assign_held(points, held, by)


def _shift(moves: np.ndarray, squared: bool) -> float:
    d2 = (moves**2).sum(1)
    return float((d2 if squared else np.sqrt(d2)).mean())


def _k_means_held(points: DataFrame, held: Held, by: list[str], rounds: int, least_shift: float, squared: bool) -> Held:
    """Lloyd rounds of one job each: tasks sum the points of each cluster, and a cloud that has settled is left out of the next."""
    context = points.sparkSession.sparkContext
    schema = ", ".join([*(f"{c} {points.schema[c].dataType.simpleString()}" for c in by), "at long, n long", *(f"s{a} double" for a in AXES)])
    left = dict(held)
    for _ in range(rounds):
        shared = context.broadcast(left)

        def run(batches, shared=shared):
            for batch in batches:
                for key, group, at in _clouds(batch, by, shared.value):
                    sums = group[list(AXES)].astype(float).groupby(at).agg("sum")
                    yield pd.DataFrame({**dict(zip(by, key, strict=True)), "at": sums.index, "n": np.bincount(at)[sums.index], **{f"s{a}": sums[a].to_numpy() for a in AXES}})

        sums = points.select(*by, *AXES).mapInPandas(run, schema).groupBy(*by, "at").agg(F.sum("n").alias("n"), *(F.sum(f"s{a}").alias(f"s{a}") for a in AXES))
        moved = {k: c.copy() for k, (_, c) in left.items()}
        for r in sums.collect():  # a row per centre
            moved[tuple(r)[: len(by)]][r["at"]] = np.array([r[f"s{a}"] for a in AXES]) / r["n"]
        shared.destroy()
        shifts = {k: _shift(c - left[k][1], squared) for k, c in moved.items()}
        held = held | {k: (held[k][0], c) for k, c in moved.items()}
        left = {k: held[k] for k, s in shifts.items() if s >= least_shift}
        if not left:
            break
    return held


def k_means(points: DataFrame, centres: DataFrame, by: list[str], rounds: int = 100, least_shift: float = 0.01, squared: bool = True, edge: float = 8.0, most_held: int = MOST_HELD) -> tuple[DataFrame, DataFrame]:
    """(assigned points, centres) after Lloyd rounds; a cluster without points keeps its centre.

    A cloud is settled when the mean (squared or plain) shift of its centres falls below least_shift; its points
    then belong to the last centres. Up to most_held centres are kept by the driver, more are a table.
    """
    centres = staged(centres.select(*by, "cluster", *(F.col(f"c{a}").cast("double").alias(f"c{a}") for a in AXES)), "centres")
    held = held_centres(centres, by, most_held)
    if held is not None:
        points = staged(points, "clouds")
        held = _k_means_held(points, held, by, rounds, least_shift, squared)
        rows = [(*k, int(c), *map(float, xyz)) for k, (clusters, where) in held.items() for c, xyz in zip(clusters, where, strict=True)]
        return staged(_assign_held(points, held, by), "assigned"), points.sparkSession.createDataFrame(rows, centres.schema)
    settled = None
    for _ in range(rounds):
        means = centroid(_assign_joined(points, centres, by, edge), *by, "cluster").select(*by, "cluster", *(F.col(f"c{a}").alias(f"n{a}") for a in AXES))
        moved = centres.join(means, [*by, "cluster"], "left").select(*by, "cluster", *(F.col(f"c{a}").alias(f"o{a}") for a in AXES), *(F.coalesce(f"n{a}", f"c{a}").alias(f"c{a}") for a in AXES))
        moved = staged(moved, "moved")
        d2 = sum(((F.col(f"c{a}") - F.col(f"o{a}")) ** 2 for a in AXES[1:]), (F.col("cx") - F.col("ox")) ** 2)
        done = moved.groupBy(*by).agg(F.avg(d2 if squared else F.sqrt(d2)).alias("s")).where(F.col("s") < least_shift).select(*by)
        now = moved.select(*by, "cluster", *(f"c{a}" for a in AXES))
        rest = now.join(done, by, "left_anti")
        ended = now.join(done, by)
        settled = staged(ended if settled is None else settled.unionByName(ended), "settled")
        centres = staged(rest, "centres")
        if centres.isEmpty():
            break
    centres = centres if settled is None else centres.unionByName(settled)
    return staged(_assign_joined(points, centres, by, edge), "assigned"), centres


def grid_seeds(points: DataFrame, by: list[str], per_patch: int, blocks: int) -> DataFrame:
    """Centres of a cloud: grid blocks get seats by their size, are split to per_patch points, and give the means of their largest parts."""
    placed = with_block(points, blocks, *by)
    sizes = placed.groupBy(*by, "block").agg(F.count("*").alias("n"))
    seats = apportion(sizes, "n", per_patch, by).where("seats > 0").select(*by, F.col("block").alias("cell"), "seats")
    parts = split_to(placed.withColumn("block", F.col("block").cast("string")), by, per_patch)
    means = centroid(parts, *by, "block").withColumn("cell", F.regexp_extract("block", r"^\d+", 0).cast("int"))
    rank = F.row_number().over(Window.partitionBy(*by, "cell").orderBy(F.desc("n"), "block"))
    chosen = means.withColumn("rank", rank).join(seats, [*by, "cell"]).where("rank <= seats")
    number = F.row_number().over(Window.partitionBy(*by).orderBy("cell", "rank")) - 1
    return chosen.select(*by, number.cast("int").alias("cluster"), *(f"c{a}" for a in AXES))


def close_points(assigned: DataFrame, by: list[str], radius: float, most: float | None = None) -> DataFrame:
    """(by..., pid, a, b, hits, points): how many points of another cluster b lie within the radius of a point of cluster a.

    Points of a cluster at one place have the same near them: they are one row, of the least pid, which counts for `points`.
    If `most` is given, only clusters that have no more points together are paired: merged ones have more still.
    """
    sizes = assigned.groupBy(*by, "cluster").agg(F.count("*").alias("size"))
    places = assigned.groupBy(*by, "cluster", *AXES).agg(F.min("pid").alias("pid"), F.count("*").alias("points"))
    places = staged(places.join(sizes, [*by, "cluster"]), "places")
    targets = places.select(*by, F.col("pid").alias("tid"), F.col("cluster").alias("b"), F.col("points").alias("n"), F.col("size").alias("size_b"), *AXES)
    queries = places.select(*by, F.col("pid").alias("qid"), F.col("cluster").alias("a"), "points", F.col("size").alias("size_a"), *AXES)
    pairs = within_radius(queries, targets, radius, tuple(by), here=("a", "points", "size_a"), there=("b", "n", "size_b"))
    pairs = pairs.where("a <> b") if most is None else pairs.where((F.col("a") != F.col("b")) & (F.col("size_a") + F.col("size_b") <= most))
    # a query's cell is its own: rows are dealt by it already
    sums = pairs.groupBy(*by, *CELLS, F.col("qid").alias("pid"), "a", "b").agg(F.sum("n").alias("hits"), F.first("points").alias("points"))
    return sums.drop(*CELLS)


@dataclass
class Near:
    """How many points of a cluster have more than CLOSE_POINTS points of another near them, at least and at most, and how many others have some."""

    low: int
    high: int
    weak: int


def merge_pass(sizes: dict[int, int], near: dict[tuple[int, int], Near], most: float, start: int | None = None) -> tuple[dict[int, int], int | None]:
    """Which cluster each one ends in, and the cluster where a count is needed (or None). near: by (cluster, other).

    From the last cluster back: of the earlier ones with which it fits into `most` points, the first to
    which it is close takes it, and the pass ends at the first cluster that fits with none. A cluster is
    close to another if more than CLOSE_POINTS of its points have more than CLOSE_POINTS points of the
    other near them, both taken with all that they have been merged with.

    When two clusters merge, their points' counts near a third add up; those of a third's
    points near the two are known within bounds, as points with few near each may have enough near both. Where the
    bounds don't tell, the pass ends, and goes on from there with the counts of the merged clusters.
    """
    order, size, members = sorted(sizes), dict(sizes), {c: [c] for c in sizes}
    left, at_of = np.array([size[c] for c in order]), {c: i for i, c in enumerate(order)}
    rows: dict[int, dict[int, Near]] = {}
    columns: dict[int, set[int]] = {}
    for (own, other), n in near.items():
        rows.setdefault(own, {})[other] = Near(n.low, n.high, n.weak)
        columns.setdefault(other, set()).add(own)
    needs = None
    for i in range(len(order) - 1, 0, -1):
        cur = order[i]
        if start is not None and cur > start:
            continue
        if not (left[:i] + size[cur] <= most).any():
            break
        mine = rows.get(cur, {})
        for k in sorted(k for k, n in mine.items() if k < cur and n.high > CLOSE_POINTS and size[cur] + size[k] <= most):
            if mine[k].low <= CLOSE_POINTS:
                needs = cur
                break
            size[k] += size.pop(cur)
            left[at_of[k]] = size[k]
            members[k] += members.pop(cur)
            for other, count in rows.pop(cur).items():
                columns[other].discard(cur)
                if other != k:
                    have = rows.setdefault(k, {}).setdefault(other, Near(0, 0, 0))
                    have.low, have.high, have.weak = have.low + count.low, have.high + count.high, have.weak + count.weak
                    columns[other].add(k)
            for own in columns.pop(cur, ()):
                count = rows[own].pop(cur)
                if own == k:
                    continue
                have = rows[own].setdefault(k, Near(0, 0, 0))
                have.low, have.high, have.weak = max(have.low, count.low), have.high + count.high + min(have.weak, count.weak), have.weak + count.weak
                columns.setdefault(k, set()).add(own)
            break
        if needs is not None:
            break
    return {c: k for k, cs in members.items() for c in cs}, needs


def merge_small(assigned: DataFrame, by: list[str], num: int, radius: float) -> DataFrame:
    """points with clusters merged as in merge_pass, per cloud, and renumbered without gaps.

    A task sees a cloud's pairs of neighbouring clusters, not its points. Where merge_pass needs a count anew, what it
    has merged so far is written into the table of close points, which Spark counts again for all such clouds at once.
    """
    keys, most = list(by), num * (1 + TOLERANCE)
    named = ", ".join(f"{c} {assigned.schema[c].dataType.simpleString()}" for c in keys)
    close = staged(close_points(assigned, by, radius, most), "close")
    sizes = staged(assigned.groupBy(*by, F.col("cluster").alias("at")).agg(F.count("*").alias("n")).withColumn("start", F.lit(None).cast("int")), "sizes")
    state = assigned.select(*by, "cluster", F.col("cluster").alias("at")).distinct()
    finished = new_stage(assigned.sparkSession, "finished")  # a folder, so that no plan grows with the rounds

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own, pairs = group[group["b"].isna()], group[group["b"].notna()]
        counts = {(int(r.a), int(r.b)): Near(int(r.n), int(r.n), int(r.weak)) for r in pairs.itertuples()}
        start = own["start"].iloc[0]
        into, needs = merge_pass({int(a): int(n) for a, n in zip(own["a"], own["n"], strict=True)}, counts, most, None if pd.isna(start) else int(start))
        return pd.DataFrame({**{c: group[c].iloc[0] for c in keys}, "at": list(into), "to": list(into.values()), "start": pd.array([needs] * len(into), "Int32")})

    while True:
        dense = F.col("hits") > CLOSE_POINTS
        pairs = close.groupBy(*by, "a", "b").agg(F.sum(F.when(dense, F.col("points")).otherwise(0)).alias("n"), F.sum(F.when(dense, 0).otherwise(F.col("points"))).alias("weak")).withColumn("start", F.lit(None).cast("int"))
        graph = sizes.select(*by, F.col("at").alias("a"), F.lit(None).cast("int").alias("b"), "n", F.lit(0).cast("long").alias("weak"), "start")
        plan = staged(graph.unionByName(pairs).groupBy(*by).applyInPandas(run, f"{named}, at int, to int, start int"), "plan")
        state = staged(state.join(plan, [*by, "at"]).select(*by, "cluster", F.col("to").alias("at"), "start"), "merged")
        ended = state.where("start is null").drop("start")
        append(ended, finished)
        state = state.where("start is not null").drop("start")
        if state.isEmpty():
            break
        waiting = plan.where("start is not null")
        sizes = staged(sizes.drop("start").join(waiting, [*by, "at"]).groupBy(*by, F.col("to").alias("at")).agg(F.sum("n").alias("n"), F.first("start").alias("start")), "sizes")
        for side in ("a", "b"):
            close = close.join(waiting.select(*by, F.col("at").alias(side), F.col("to").alias(f"_{side}")), [*by, side]).drop(side).withColumnRenamed(f"_{side}", side)
        close = staged(close.where("a <> b").groupBy(*by, "pid", "a", "b").agg(F.sum("hits").alias("hits"), F.first("points").alias("points")), "close")
    number = F.dense_rank().over(Window.partitionBy(*by).orderBy("at")) - 1  # a row per cluster
    merged = assigned.sparkSession.read.schema(ended.schema).parquet(finished)
    return assigned.join(merged.select(*by, "cluster", number.cast("int").alias("patch")), [*by, "cluster"]).drop("cluster")


def dense_segments(points: DataFrame, by: list[str], num: int = 2048, blocks: int = 8, radius2: float = 10.0, rounds: int = 100, shift: float = 0.01, edge: float = 8.0) -> DataFrame:
    """points (by..., pid, x, y, z, ...) with their patch.

    Seeds from a grid, nearest-seed clusters split to num points, k-means from the parts' means, and a merge of small neighbours.
    """
    if num < 1 or blocks < 1:
        raise EngineError(Kind.INVALID_PARAM_SEGMENT)
    first = assign(points, grid_seeds(points, by, num, blocks), by, edge)
    parts = split_to(staged(first.withColumn("block", F.col("cluster").cast("string")), "parts"), by, num)
    seeds = centroid(parts, *by, "block").withColumn("cluster", (F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "block")) - 1).cast("int"))
    assigned, _ = k_means(points, seeds, by, rounds, shift, True, edge)
    return merge_small(assigned, by, num, float(np.sqrt(radius2)))


def reference_segments(points: DataFrame, reference: DataFrame, by: list[str], rounds: int = 100, shift: float = 0.01, edge: float = 8.0) -> DataFrame:
    """points with the patches of a reference frame: k-means from its patches' centroids; a patch left empty gets the reference patch's first point."""
    seeds = centroid(reference, *by, "patch").withColumnRenamed("patch", "cluster")
    assigned, _ = k_means(points, seeds, by, rounds, shift, True, edge)
    out = assigned.withColumnRenamed("cluster", "patch")
    empty = reference.join(out.select(*by, "patch").distinct(), [*by, "patch"], "left_anti")
    first = empty.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "patch").orderBy("pid"))).where("_rank = 1")
    return out.unionByName(first.select(*out.columns)) if set(out.columns) <= set(reference.columns) else out


def result_patches(points: DataFrame, by: list[str]) -> DataFrame:
    """Patches renumbered without gaps, as force-key patches (type 0)."""
    number = F.dense_rank().over(Window.partitionBy(*by).orderBy("patch")) - 1
    return points.withColumn("patch", number.cast("int")).withColumn("type", F.lit(0).cast("byte"))


def rekeyed(sizes: DataFrame, num: int, worst: float = 10.0) -> DataFrame:
    """Frames that start a new key frame: their largest patch has over 2 * num points, or their weighted MSE is above `worst`.

    sizes: ts, patch, n, mse (null or negative: no score).
    """
    scored = F.when(F.col("mse") >= 0, F.col("n"))
    mse = F.sum(scored * F.col("mse")) / F.sum(scored)
    out = sizes.groupBy("ts").agg(F.max("n").alias("largest"), mse.alias("mse"))
    return out.withColumn("rekey", (F.col("largest") > 2 * num) | F.coalesce(F.col("mse") > worst, F.lit(False)))
