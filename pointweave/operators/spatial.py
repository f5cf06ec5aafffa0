"""Bounding boxes, blocks and neighbour joins.

Neighbour joins deal points into cubic cells and join a query with the cells around its own, so they
are equi-joins on (group, cell). A nearest neighbour found within a cell's edge is exact; queries
without one are asked again with cells of twice the edge, which ends after log2(extent / edge)
rounds. Rows are dealt by blocks of cells, a target also to the blocks it borders on, so that a query's
27 cells are unfolded, joined and summed in one task and none of these rows is shuffled. Points at one place are one row of these joins. No side is broadcast but for tables of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import squared_distance
from ..plans.store import settings, staged

AXES = ("x", "y", "z")
#: Cells along an edge of a block, and places of queries and targets that a task is meant to get.
BLOCK, PLACES = 8, 1 << 14
CELLS = ("_cx", "_cy", "_cz")


def bounding_box(points: DataFrame, *by: str) -> DataFrame:
    ends = [f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))]
    return points.groupBy(*by).agg(F.count("*").alias("n"), *ends)


def centroid(points: DataFrame, *by: str) -> DataFrame:
    return points.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(a).alias(f"c{a}") for a in AXES))


def with_block(points: DataFrame, blocks: int, *by: str) -> DataFrame:
    """Each point's block in a grid of blocks^3 over its cloud's box: half-open, the last block closed; flat clouds have one block along that axis."""
    box = bounding_box(points, *by).drop("n")
    joined = points.join(box, list(by)) if by else points.crossJoin(F.broadcast(box))  # a single row
    place = []
    for a in AXES:
        low, extent = F.col(f"min_{a}"), F.col(f"max_{a}") - F.col(f"min_{a}")
        tick = F.when(extent > 0, extent).otherwise(F.lit(1.0)) / blocks
        place.append(F.least(F.floor((F.col(a) - low) / tick), F.lit(blocks - 1)))
    block = place[0] + place[1] * blocks + place[2] * blocks * blocks
    return joined.withColumn("block", block.cast("int")).select(*points.columns, "block")


def _cell(axis: str, edge: Column | float) -> Column:
    return F.floor(F.col(axis) / edge)


def _around(df: DataFrame, edge: Column | float, names: tuple[str, ...]) -> DataFrame:
    """A row for each of the 27 cells around a point's own."""
    steps = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    for a, n in zip(AXES, names, strict=True):
        df = df.withColumn("_step", F.explode(steps)).withColumn(n, _cell(a, edge) + F.col("_step")).drop("_step")
    return df


def _places(points: DataFrame, by: tuple[str, ...], key: str, names: tuple[str, ...], k: int | None = None) -> DataFrame:
    """A row for each place that holds points: by..., the coordinates and n, the points there, or, if k is given, ids, its k least keys."""
    at = points.select(*by, key, *(F.col(a).cast("double").alias(n) for a, n in zip(AXES, names, strict=True)))
    if k is None:
        return at.groupBy(*by, *names).agg(F.count("*").alias("n"))
    if k == 1:
        return at.groupBy(*by, *names).agg(F.array(F.min(key)).alias("ids"))
    ranked = at.withColumn("_r", F.row_number().over(Window.partitionBy(*by, *names).orderBy(key))).where(f"_r <= {k}")
    return ranked.groupBy(*by, *names).agg(F.array_sort(F.collect_list(key)).alias("ids"))


def _first_edges(places: DataFrame, by: tuple[str, ...], k: int, edge: float) -> DataFrame:
    """by..., _edge: the given edge, halved until a cell holds about k places on the mean of a group's box (a power of two of it)."""
    box = places.groupBy(*by).agg(F.count("*").alias("_n"), *(F.greatest(F.max(f"t{a}") - F.min(f"t{a}"), F.lit(edge / 1024)).alias(f"_{a}") for a in AXES))
    room = F.col("_x") * F.col("_y") * F.col("_z") * (k + 1) / F.col("_n")
    halved = F.least(F.greatest(F.ceil(-F.log2(F.cbrt(room) / edge)), F.lit(0)), F.lit(10))
    return box.select(*by, (F.lit(edge) / F.pow(F.lit(2.0), halved)).alias("_edge"))


def _nearest_places(queries: DataFrame, targets: DataFrame, by: tuple[str, ...], k: int, edge: float, most_rounds: int) -> DataFrame:
    """by..., _qx, _qy, _qz, tid, d2, rank, tx, ty, tz: the k nearest targets of each place that holds queries."""
    spark = queries.sparkSession
    cells, blocks, here, there = ("_cx", "_cy", "_cz"), ("_bx", "_by", "_bz"), ("_qx", "_qy", "_qz"), ("tx", "ty", "tz")
    own = staged(_places(targets, by, "tid", there, k), "places")
    edges = _first_edges(own, by, k, edge)
    known = own.groupBy(*by).agg(F.least(F.sum(F.size("ids")), F.lit(k)).alias("_most"))
    asked = _places(queries, by, "qid", here).drop("n")
    start = edges.join(known, list(by)) if by else edges.crossJoin(F.broadcast(known))
    asked = asked.join(start, list(by)) if by else asked.crossJoin(F.broadcast(start))
    left = staged(asked.select(*by, *here, "_edge", "_most"), "asked")
    own = own.join(edges, list(by)) if by else own.crossJoin(F.broadcast(edges))  # a single row
    most, n_asked = own.count(), left.count()
    sides, done = [*by, *blocks, *here], None
    for i in range(most_rounds):
        size = F.col("_edge") * float(2**i)
        tasks = max(1, -(-(most + n_asked) // PLACES))
        dealt = own.select(*by, "ids", *there, *(F.floor(F.col(t) / size).alias(c) for t, c in zip(there, cells, strict=True)))
        for c, b in zip(cells, blocks, strict=True):
            dealt = dealt.withColumn(b, F.explode(F.array_distinct(F.array(*(F.floor((F.col(c) + s) / BLOCK) for s in (-1, 1))))))
        dealt = dealt.repartition(tasks, *by, *blocks)
        around = left.withColumns({b: F.floor(F.floor(F.col(h) / size) / BLOCK) for h, b in zip(here, blocks, strict=True)}).repartition(tasks, *by, *blocks)
        around = _around(around.withColumns({a: F.col(h) for a, h in zip(AXES, here, strict=True)}), size, cells)
        met = around.join(dealt, [*by, *blocks, *cells]).withColumn("d2", squared_distance(AXES, there)).where(F.col("d2") <= size * size)
        if k == 1:
            least = met.groupBy(*sides).agg(F.min(F.struct("d2", F.col("ids")[0].alias("tid"), *there)).alias("m"))
            sure = least.select(*sides, "m.*", F.lit(1).alias("rank"))
        else:
            # a place that k others precede gives none; of equally far ones all stay until their targets are ranked
            places = met.withColumn("_r", F.rank().over(Window.partitionBy(*sides).orderBy("d2"))).where(f"_r <= {k}")
            ranked = places.select(*sides, "_most", "d2", *there, F.explode("ids").alias("tid")).withColumn("rank", F.row_number().over(Window.partitionBy(*sides).orderBy("d2", "tid"))).where(f"rank <= {k}")
            sure = ranked.withColumn("_got", F.count("*").over(Window.partitionBy(*sides))).where("_got = _most")
        with settings(spark, ALL_KEYS="false"):
            found = staged(sure.select(*by, *here, "tid", "d2", "rank", *there), "nearest")
        done = found if done is None else done.unionByName(found)
        left = staged(left.join(found.where("rank = 1").select(*by, *here), [*by, *here], "left_anti"), "unmet")
        n_asked = left.count()
        if not n_asked:
            return done
    raise ValueError(f"points further apart than {edge * 2.0**most_rounds}")


def nearest(queries: DataFrame, targets: DataFrame, by: tuple[str, ...] = (), k: int = 1, edge: float = 8.0, most_rounds: int = 50, more: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest targets of each query: by..., qid, tid, d2, rank (from 1; ties go to the least tid), and the columns `more` of queries and tx, ty, tz if any are named.

    queries: by..., qid, x, y, z; targets: by..., tid, x, y, z. Groups with fewer than k targets give
    all of them, groups without give none. Places are compared, not points: however many points coincide,
    a place is asked once, and stands with its k least targets. The first cells are as small as a group is dense.
    """
    done = _nearest_places(queries, targets, by, k, edge, most_rounds)
    here = ("_qx", "_qy", "_qz")
    ends = queries.select(*by, "qid", *more, *(F.col(a).cast("double").alias(h) for a, h in zip(AXES, here, strict=True)))
    return ends.join(done, [*by, *here]).select(*by, "qid", "tid", "d2", "rank", *more, *(("tx", "ty", "tz") if more else ()))


def within_radius(queries: DataFrame, targets: DataFrame, radius: float, by: tuple[str, ...] = (), here: tuple[str, ...] = (), there: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (by..., qid, tid, d2) at most radius apart, with the columns `here` of queries, `there` of targets, and the query's cell, CELLS.

    Rows are dealt by the query's cell, to which go the targets of the cells around it. Neither side is broadcast,
    however small its file: packed columns of cells take many times that in a driver's memory.
    """
    dealt = _around(targets.select(*by, "tid", *there, *AXES), radius, CELLS).withColumnsRenamed({a: f"t{a}" for a in AXES})
    asked = queries.select(*by, "qid", *here, *AXES, *(_cell(a, radius).alias(c) for a, c in zip(AXES, CELLS, strict=True)))
    met = asked.join(dealt.hint("merge"), [*by, *CELLS]).withColumn("d2", squared_distance(AXES, ("tx", "ty", "tz")))
    return met.where(F.col("d2") <= radius * radius).select(*by, "qid", "tid", "d2", *here, *there, *CELLS)


def neighbours_in_radius(queries: DataFrame, targets: DataFrame, radius: float, by: tuple[str, ...] = ()) -> DataFrame:
    """How many targets each query has within the radius, 0 included. Places are compared, and count for the points they hold."""
    here, there = ("_qx", "_qy", "_qz"), ("_tx", "_ty", "_tz")
    cells = ("_cx", "_cy", "_cz")
    asked = _places(queries, by, "qid", here).select(*by, *here, *(F.col(h).alias(a) for a, h in zip(AXES, here, strict=True)))
    dealt = _places(targets, by, "tid", there).select(*by, "n", *there, *(_cell(t, radius).alias(c) for t, c in zip(there, cells, strict=True)))
    met = _around(asked, radius, cells).join(dealt, [*by, *cells]).where(squared_distance(AXES, there) <= radius * radius)
    counts = met.groupBy(*by, *here).agg(F.sum("n").alias("n"))
    ends = queries.select(*by, "qid", *(F.col(a).cast("double").alias(h) for a, h in zip(AXES, here, strict=True)))
    return ends.join(counts, [*by, *here], "left").select(*by, "qid", F.coalesce("n", F.lit(0)).alias("n"))


def conditional_nearest(queries: DataFrame, targets: DataFrame, limits: DataFrame, by: tuple[str, ...] = (), k: int = 5) -> DataFrame:
    """The first of k neighbours that is nearer than its patch's limit, else the nearest of all.

    targets carry a patch; limits: patch, limit (in squared distance), and those of by in which a patch has several.
    """
    own = [c for c in by if c in limits.columns]
    met = nearest(queries, targets, by, k).join(targets.select(*by, "tid", "patch"), [*by, "tid"]).join(limits, [*own, "patch"], "left")
    first = F.min_by(F.struct("tid", "patch", "d2"), F.struct(F.when(F.col("d2") < F.col("limit"), 0).otherwise(1), "rank"))
    return met.groupBy(*by, "qid").agg(first.alias("hit")).select(*by, "qid", "hit.*")


def interpolate(queries: DataFrame, targets: DataFrame, values: tuple[str, ...], by: tuple[str, ...] = (), k: int = 10) -> DataFrame:
    """Means of the k nearest targets' values, weighted by the inverse squared distance (1e-6 at least)."""
    met = nearest(queries, targets, by, k).join(targets.select(*by, "tid", *values), [*by, "tid"])
    w = 1 / F.greatest("d2", F.lit(1e-6))
    return met.groupBy(*by, "qid").agg(*((F.sum(w * F.col(v)) / F.sum(w)).alias(v) for v in values))


def mean_displacement(queries: DataFrame, targets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The mean step from each query to its nearest target."""
    ends = nearest(queries, targets, by).join(queries.select(*by, "qid", *(F.col(a).alias(f"q{a}") for a in AXES)), [*by, "qid"]).join(targets.select(*by, "tid", *AXES), [*by, "tid"])
    return ends.groupBy(*by).agg(*(F.avg(F.col(a) - F.col(f"q{a}")).alias(f"d{a}") for a in AXES))
