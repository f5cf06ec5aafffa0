"""Octrees and the region-adaptive hierarchical transform in closed form.

A leaf's place along an axis is one floor, its key the interleaved bits of three places, most
significant first. Nodes of a level are prefixes of keys, so a level is a grouped aggregation, and
the transform one over all levels at once: a leaf meets each of its ancestors three times, once per
axis, and every coefficient is a difference of the two sides' sums. The inverse is one join and one
sum. Both are independent of the order in which a recursive tree would be walked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import power_above

AXES = ("x", "y", "z")
MOST_DEPTH = 20


def tree_frame(points: DataFrame, *by: str, resolution: float = 1.0) -> DataFrame:
    """by..., centre (cx, cy, cz), edge of the root cube and depth, per cloud."""
    ends = points.groupBy(*by).agg(*(f(a).cast("double").alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))))
    extent = F.greatest(*(F.col(f"max_{a}") - F.col(f"min_{a}") for a in AXES))
    extent = F.when(extent > 0, extent).otherwise(F.lit(1.0))
    power = power_above(extent)
    depth = F.greatest(power - power_above(F.lit(float(resolution))), F.lit(0))
    return ends.select(*by, *(((F.col(f"max_{a}") + F.col(f"min_{a}")) / 2).alias(f"c{a}") for a in AXES), F.pow(F.lit(2.0), power).alias("edge"), depth.cast("int").alias("depth"))


def fixed_frame(points: DataFrame, *by: str, centre: float, edge: float, depth: int) -> DataFrame:
    """The same root cube for each cloud."""
    return points.select(*by).distinct().select("*", *(F.lit(centre).alias(f"c{a}") for a in AXES), F.lit(edge).alias("edge"), F.lit(depth).alias("depth"))


def leaf_place(axis: str) -> Column:
    """How far from the upper face; ties fall to the low side, the lower face into the last cell."""
    cells = F.pow(F.lit(2.0), F.col("depth"))
    at = F.floor((F.col(f"c{axis}") + F.col("edge") / 2 - F.col(axis)) * cells / F.col("edge"))
    return F.least(at, (cells - 1).cast("long"))


def leaf_centre(axis: str, place: Column | str) -> Column:
    place = F.col(place) if isinstance(place, str) else place
    return F.col(f"c{axis}") + F.col("edge") / 2 - (place + 0.5) * F.col("edge") / F.pow(F.lit(2.0), F.col("depth"))


def interleave(kx: Column, ky: Column, kz: Column, depth: int = MOST_DEPTH) -> Column:
    """The octal digits 4 * x bit + 2 * y bit + z bit of three places as one long."""
    out = F.lit(0).cast("long")
    for bit in range(depth):
        digit = sum((F.shiftleft(F.shiftright(k.cast("long"), bit).bitwiseAND(F.lit(1)), 2 - i) for i, k in enumerate((kx, ky, kz))), F.lit(0))
        out = out.bitwiseOR(F.shiftleft(digit.cast("long"), 3 * bit))
    return out


def leaf_keys(points: DataFrame, frame: DataFrame, *by: str, depth: int = MOST_DEPTH) -> DataFrame:
    """points with their cloud's frame and leaf key."""
    joined = points.join(frame, list(by))
    return joined.withColumn("key", interleave(*(leaf_place(a) for a in AXES), depth=depth))


def leaves(keyed: DataFrame, *by: str, values: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """One row per occupied leaf: by..., depth, key, points and the mean of each value."""
    return keyed.groupBy(*by, "depth", "key").agg(F.count("*").alias("points"), *(F.avg(v).alias(v) for v in values))


def ancestors(leaf: DataFrame, *keep: str) -> DataFrame:
    """Each leaf with its branch nodes: level from 0 (the root), prefix and the digit that leads on."""
    levels = F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("level")
    down = F.expr("shiftright(key, cast(3 * (depth - 1 - level) as int))")
    out = leaf.where("depth > 0").select(*keep, "depth", "key", levels)
    return out.withColumn("digit", down.bitwiseAND(F.lit(7))).withColumn("prefix", F.expr("shiftright(key, cast(3 * (depth - level) as int))"))


def occupancy(leaf: DataFrame, *by: str) -> DataFrame:
    """by..., level, prefix, the occupancy byte and the weight (leaves below) of each branch node."""
    nodes = ancestors(leaf, *by)
    return nodes.groupBy(*by, "level", "prefix").agg(F.bit_or(F.expr("shiftright(128, cast(digit as int))")).cast("int").alias("occupancy"), F.count("*").alias("weight"))


def _splits() -> Column:
    """The three splits that a leaf takes part in at a node: idx and the side it is on."""
    x, y, z = (F.shiftright("digit", s).bitwiseAND(F.lit(1)) for s in (2, 1, 0))
    return F.array(F.struct(F.lit(1).cast("long").alias("idx"), x.alias("side")), F.struct((2 + x).alias("idx"), y.alias("side")), F.struct((4 + 2 * x + y).alias("idx"), z.alias("side")))


def raht(leaf: DataFrame, *by: str, values: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """by..., level, prefix, idx, n0, n1 and a coefficient per value; the mean's row has level -1.

    Leaves have weight 1. A node splits along x (idx 1), then y (2, 3), then z (4 to 7).
    """
    # the sums of a node's children first: at most eight rows of a node are split three times, not all its leaves
    children = ancestors(leaf, *by, *values).groupBy(*by, "level", "prefix", "digit").agg(F.count("*").alias("w"), *(F.sum(v).alias(v) for v in values))
    sides = children.withColumn("split", F.explode(_splits())).select(*by, "level", "prefix", "split.*", "w", *values)
    one = F.col("side") == 1
    sums = sides.groupBy(*by, "level", "prefix", "idx").agg(
        F.sum(F.when(one, 0).otherwise(F.col("w"))).alias("n0"), F.sum(F.when(one, F.col("w")).otherwise(0)).alias("n1"), *(F.sum(F.when(one == bool(s), F.col(v)).otherwise(0.0)).alias(f"{v}_{s}") for v in values for s in (0, 1))
    )
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    high = [((F.sqrt(n0 / n1) * F.col(f"{v}_1") - F.sqrt(n1 / n0) * F.col(f"{v}_0")) / F.sqrt(n0 + n1)).alias(v) for v in values]
    ac = sums.where("n0 > 0 and n1 > 0").select(*by, "level", "prefix", "idx", "n0", "n1", *high)
    dc = leaf.groupBy(*by).agg(F.count("*").alias("n0"), *(F.sum(v).alias(v) for v in values))
    dc = dc.select(*by, F.lit(-1).alias("level"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("idx"), "n0", F.lit(0).cast("long").alias("n1"), *((F.col(v) / F.sqrt(F.col("n0").cast("double"))).alias(v) for v in values))
    return dc.unionByName(ac)


def inverse_raht(coefficients: DataFrame, leaf: DataFrame, *by: str, values: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """by..., key and the values of each leaf. coefficients as from raht; leaf: by..., depth, key."""
    # what a node's coefficients add to each of its children is summed first, so that a leaf meets one row a level
    ac = coefficients.where("level >= 0").withColumn("digit", F.explode(F.sequence(F.lit(0), F.lit(7))))
    within = "idx = 1 or (idx in (2, 3) and shiftright(digit, 2) = idx - 2) or (idx >= 4 and shiftright(digit, 1) = idx - 4)"
    side = F.expr("shiftright(digit, case when idx = 1 then 2 when idx < 4 then 1 else 0 end) & 1")
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    share = F.when(side == 1, F.sqrt(n0 / n1)).otherwise(-F.sqrt(n1 / n0)) / F.sqrt(n0 + n1)
    child = ac.where(within).groupBy(*by, "level", "prefix", F.col("digit").cast("long").alias("digit")).agg(*(F.sum(share * F.col(v)).alias(f"_{v}") for v in values))
    down = ancestors(leaf.select(*by, "depth", "key"), *by).select(*by, "key", "level", "prefix", F.col("digit").cast("long").alias("digit"))
    steps = down.join(child, [*by, "level", "prefix", "digit"]).groupBy(*by, "key").agg(*(F.sum(f"_{v}").alias(f"_{v}") for v in values))
    base = coefficients.where("level = -1").select(*by, *((F.col(v) / F.sqrt(F.col("n0").cast("double"))).alias(v) for v in values))
    out = leaf.select(*by, "key").join(base, list(by)).join(steps, [*by, "key"], "left")
    return out.select(*by, "key", *((F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0.0))).alias(v) for v in values))


def stream_order(coefficients: DataFrame, *by: str) -> DataFrame:
    """Coefficients with their place in a coded stream: the mean last, deep nodes first."""
    order = Window.partitionBy(*by).orderBy(F.desc("level"), F.desc("prefix"), F.desc("idx"))
    return coefficients.withColumn("pos", F.row_number().over(order) - 1)


def uniform_cells(keyed: DataFrame, *by: str, level: int, patch: str = "patch") -> DataFrame:
    """Cells of a level that are touched by all of the clouds' patches or by none: by..., prefix, patches, uniform."""
    total = keyed.groupBy(*by).agg(F.countDistinct(patch).alias("of"))
    cell = F.expr(f"shiftright(key, cast(3 * (depth - {level}) as int))")
    cells = keyed.where(f"depth >= {level}").groupBy(*by, cell.alias("prefix")).agg(F.countDistinct(patch).alias("patches"))
    return cells.join(total, list(by)).select(*by, "prefix", "patches", (F.col("patches") == F.col("of")).alias("uniform"))

