"""Fitting clouds of all groups at once, level by level.

The parts of space that are still to be halved are a frontier: each point carries the part it is in, and a level
is one count of points by part, side and member, one decision a part from those counts, and one join that gives
the points their new parts. No task holds a group's points but those of a part that is clustered. The result is
that of fitting.fitting_cloud for each group, whose recursion this is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError, Kind
from ..functions.batches import columns_of, runs
from ..functions.scalar import power_above
from ..params import Params, SplitMethod
from ..plans.store import dealt, staged
from .fitting import HALVES, clustered

AXES = ("x", "y", "z")
MOST_LEVELS = 64


def _octant() -> Column:
    return sum((F.when(F.col(a) <= F.col(f"c{a}"), w).otherwise(0) for a, w in zip(AXES, (4, 2, 1), strict=True)), F.lit(0)).cast("int")


def _even(present: Column) -> Column:
    """Whether a side has points of all members or of none."""
    return (present == 0) | (present == F.col("members"))


def _decisions(frontier: DataFrame, params: Params, *by: str) -> DataFrame:
    """by..., part, even (of each octant), and the axis of an even bisection, null without one."""
    part = [*by, "part"]
    counts = frontier.groupBy(*part, "members", "member", "octant").agg(F.count("*").alias("n"))
    members = counts.groupBy(*part, "members", "member").agg(*(F.coalesce(F.sum(F.when(F.col("octant") == o, F.col("n"))), F.lit(0)).alias(f"n{o}") for o in range(8)))
    present = [F.count(F.when(F.col(f"n{o}") > 0, 1)) for o in range(8)]
    sides = {}
    for axis, weight in enumerate((4, 2, 1)):
        for side in (0, 1):  # 0: the high one
            own = sum((F.col(f"n{o}") for o in range(8) if bool(o & weight) == bool(side)), F.lit(0))
            sides[axis, side] = own
    spread = [
        *(F.count(F.when(v > 0, 1)).alias(f"p{a}{s}") for (a, s), v in sides.items()),
        # members ** 2 times the variance of a side's counts, a whole number; members that are absent count as 0
        *((F.first("members") * F.sum(v * v) - F.sum(v) * F.sum(v)).alias(f"v{a}{s}") for (a, s), v in sides.items()),
    ]
    sums = members.groupBy(*part, "members").agg(F.array(*present).alias("present"), *spread)
    fits = [_even(F.col(f"p{a}0")) & _even(F.col(f"p{a}1")) for a in range(3)]
    score = [F.when(fits[a], F.greatest(f"v{a}0", f"v{a}1")) for a in range(3)]
    best = F.array_min(F.array(*(F.when(fits[a], F.struct(score[a].alias("score"), F.lit(a).alias("axis"))) for a in range(3))))
    axis = best["axis"] if params.patch.split_method is SplitMethod.PLANAR_BISECTION else F.lit(None).cast("int")
    return sums.select(*part, F.transform("present", _even).alias("even"), axis.alias("axis"))


def _moved(names: list[str], params: Params) -> list[Column]:
    """The columns of a point in its new part; `done` says that the part is to be clustered."""
    all_even = F.forall("even", lambda e: e)
    bisected = ~all_even & F.col("axis").isNotNull()
    partial = ~all_even & F.lit(params.patch.split_method is SplitMethod.PARTIAL_CLUSTERING)
    goes_on = F.get("even", F.col("octant"))
    weight = F.element_at(F.array(F.lit(4), F.lit(2), F.lit(1)), F.coalesce("axis", F.lit(0)) + 1)
    low = F.col("octant").bitwiseAND(weight) > 0
    down = all_even | (partial & goes_on)
    part = F.when(down, F.concat("part", F.col("octant").cast("string"))).when(bisected, F.concat("part", F.element_at(F.array(*map(F.lit, HALVES)), F.col("axis") * 2 + F.when(low, 2).otherwise(1)))).when(partial, F.concat("part", F.lit("p"))).otherwise(F.col("part"))
    out = [F.col(n) for n in names] + [part.alias("part"), (~down & ~bisected).alias("done"), (F.col("level") + 1).alias("level")]
    for i, a in enumerate(AXES):
        below = F.col("octant").bitwiseAND(F.lit((4, 2, 1)[i])) > 0
        cut = down | (bisected & (F.col("axis") == i))
        out.append(F.when(cut, F.col(f"c{a}") + F.when(below, -1).otherwise(1) * F.col(f"e{a}") / 4).otherwise(F.col(f"c{a}")).alias(f"c{a}"))
        out.append(F.when(cut, F.col(f"e{a}") / 2).otherwise(F.col(f"e{a}")).alias(f"e{a}"))
    return out


def fitting_clouds(points: DataFrame, params: Params, *by: str, seed: int = 0) -> DataFrame:
    """by..., x, y, z: the fitting cloud of each group. points: by..., member (a cloud of the group), pid, x, y, z."""
    p = params.patch
    if p.clustering_ths < 1:
        raise EngineError(Kind.BAD_PARAMETERS, "patch.clustering_ths is below 1")
    names = [*by, "member", "pid", *AXES, "members", "deepest"]
    box = points.groupBy(*by).agg(F.countDistinct("member").alias("members"), *(f(a).cast("double").alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))))
    widest = F.greatest(*(F.col(f"hi{a}") - F.col(f"lo{a}") for a in AXES))
    deepest = F.when(widest > 0, power_above(widest) - int(np.ceil(np.log2(p.clustering_ths)))).otherwise(0).cast("int")
    roots = box.select(*by, "members", deepest.alias("deepest"), *(((F.col(f"lo{a}") + F.col(f"hi{a}")) / 2).alias(f"c{a}") for a in AXES), *((F.col(f"hi{a}") - F.col(f"lo{a}")).alias(f"e{a}") for a in AXES))
    cast = [F.col(c) for c in (*by, "member", "pid")] + [F.col(a).cast("double").alias(a) for a in AXES]
    frontier = points.select(cast).join(roots, list(by)).withColumns({"part": F.lit(""), "level": F.lit(0), "done": F.lit(False)})
    ready = []
    for _ in range(MOST_LEVELS):
        stays = F.col("done") | (F.col("level") >= F.col("deepest"))
        frontier = staged(frontier, "frontier")
        ready.append(frontier.where(stays).select(*names, "part"))
        frontier = frontier.where(~stays)
        if frontier.isEmpty():
            break
        asked = frontier.withColumn("octant", _octant())
        frontier = asked.join(_decisions(asked, params, *by), [*by, "part"]).select(_moved(names, params))
    parts = ready[0]
    for r in ready[1:]:
        parts = parts.unionByName(r)

    own = [*by, "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Most parts are small: they pass one after another, a row of a batch for each of their centres."""
        for rows in runs(batches, *own):
            centres = clustered(columns_of(rows, AXES), rows["members"][0].as_py(), rows["part"][0].as_py(), params, seed)
            same = [pa.array([rows[c][0].as_py()] * len(centres), rows[c].type) for c in by]
            yield pa.RecordBatch.from_arrays([*same, *(pa.array(centres[:, i]) for i in range(3))], names=[*by, *AXES])

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "x double, y double, z double"])
    return dealt(parts, *own).sortWithinPartitions(*own, "member", "pid").mapInArrow(run, schema)
