"""Coded octrees as tables: SQL table functions from geometry bytes to leaves and back, and slices decoded by joins.

    SELECT * FROM leaves(TABLE(SELECT ts, patch, type, geometry FROM slices))
    SELECT * FROM geometry(TABLE(leaves) PARTITION BY (ts, patch) ORDER BY key)

Decoding by joins holds no history of a patch in a task. A slice's tree is that of its patch's latest intra
slice, an as-of join. Its coded values, in the order of the stream, meet the places of that tree's transform,
are turned back by one inverse over all slices, and predicted slices add the intra slice's colours, a join on
the leaf. A pair of an intra slice and a leaf is the unit of the work, so it spreads however few patches there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import EngineError, Kind
from ..functions.entropy import rlgr_decode, zstd_decode
from ..functions.scalar import COLOR_ZSTD, GEOMETRY_ZSTD, PREDICT, SKIP, VALID, affine, yuv_to_rgb
from ..plans.store import dropped, staged, staged_evenly
from ..sources.formats import geometry_bytes
from .codec import Tree
from .octree import inverse_raht, raht, stream_order
from .windows import as_of

LEAVES = "ts int, patch int, depth int, edge double, cx double, cy double, cz double, pid long, key long, x double, y double, z double"
CHANNELS = ("luma", "cb", "cr")


class Leaves:
    """A row for each leaf of the trees in rows of ts, patch, type and geometry; rows without geometry give none."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        for ts, patch, kind, data in zip(*(rows.column(c).to_pylist() for c in ("ts", "patch", "type", "geometry")), strict=True):
            if data is None:
                continue
            tree = Tree.parse(zstd_decode(data) if kind & GEOMETRY_ZSTD else data)
            n, middle = len(tree.keys), tree.centres()
            same = {"ts": pa.array([ts] * n, pa.int32()), "patch": pa.array([patch] * n, pa.int32()), "depth": pa.array([tree.depth] * n, pa.int32()), "edge": pa.array([tree.edge] * n)}
            same |= {f"c{a}": pa.array([float(tree.centre[i])] * n) for i, a in enumerate("xyz")}
            yield pa.table(same | {"pid": pa.array(np.arange(n)), "key": pa.array(tree.keys)} | {a: pa.array(middle[:, i]) for i, a in enumerate("xyz")})


class Geometry:
    """The geometry bytes of the trees whose leaves are a partition, in order of key; not compressed."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.tree: tuple | None = None

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        if rows.num_rows:
            self.tree = tuple(rows.column(c)[0].as_py() for c in ("ts", "patch", "depth", "edge", "cx", "cy", "cz"))
            self.keys.append(rows.column("key").to_numpy())
        yield from ()

    def terminate(self) -> Iterator[pa.Table]:
        if self.tree is None:
            return
        ts, patch, depth, edge, *centre = self.tree
        tree = Tree(np.unique(np.concatenate(self.keys)), depth, np.array(centre), edge)
        data = geometry_bytes(centre, [edge] * 3, depth + 1, b"".join(o.astype(np.uint8).tobytes() for _, o in tree.nodes))
        yield pa.table({"ts": pa.array([ts], pa.int32()), "patch": pa.array([patch], pa.int32()), "geometry": pa.array([data], pa.binary())})


leaves_of = F.arrow_udtf(Leaves, returnType=LEAVES)
geometry_of = F.arrow_udtf(Geometry, returnType="ts int, patch int, geometry binary")


def register(spark: SparkSession) -> None:
    """The table functions by their names in SQL."""
    spark.udtf.register("leaves", leaves_of)
    spark.udtf.register("geometry", geometry_of)


def leaves(slices: DataFrame) -> DataFrame:
    return leaves_of(slices.select("ts", "patch", "type", "geometry").asTable())


def geometry(leaf: DataFrame) -> DataFrame:
    """ts, patch, geometry of the trees with these leaves."""
    named = leaf.select("ts", "patch", "depth", "edge", "cx", "cy", "cz", "key")
    return geometry_of(named.asTable().partitionBy("ts", "patch").orderBy("key"))


def _is(bits: int) -> Column:
    return F.col("type").bitwiseAND(F.lit(bits)) != 0


def with_intra(slices: DataFrame) -> DataFrame:
    """slices with the ts of the intra slice they build on; a predicted one without is an error."""
    light = slices.select("ts", "patch", "type").withColumn("intra", as_of(F.col("ts"), ~_is(PREDICT), ["patch"]))
    missing = F.concat(F.lit(f"{Kind.EMPTY_REFERENCE.name}: patch "), F.col("patch").cast("string"), F.lit(" at "), F.col("ts").cast("string"))
    checked = light.select("ts", "patch", F.when(F.col("intra").isNull(), F.raise_error(missing).cast("int")).otherwise(F.col("intra")).alias("intra"))
    return slices.join(checked, ["ts", "patch"])


def levels(slices: DataFrame) -> DataFrame:
    """ts, patch, intra, pos and the value of each channel: what the slices' colours say, times their step. Slices without colours give none."""
    names = ["ts", "patch", "intra", "type", "size", "qp", "color"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data = zstd_decode(r["color"]) if r["type"] & COLOR_ZSTD else r["color"]
                n = r["size"]
                values = np.array(rlgr_decode(data, 3 * n), float).reshape(3, n) * r["qp"]
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array([r[c]] * n, pa.int32()) for c in ("ts", "patch", "intra")), pa.array(np.arange(n)), *map(pa.array, values)], names=["ts", "patch", "intra", "pos", *CHANNELS]
                    )

    return slices.where(~_is(SKIP)).select(names).mapInArrow(run, "ts int, patch int, intra int, pos long, luma double, cb double, cr double")


def inverse_predicted(coefficients: DataFrame, leaf: DataFrame, frames: DataFrame, *by: str, values: tuple[str, ...] = CHANNELS) -> DataFrame:
    """by..., ts, intra, key and the values of each leaf in each frame.

    frames: by..., ts, intra (the frame whose tree and values it builds on, its own if it is one). coefficients: by...,
    ts, intra and as from raht, none of a frame that repeats what it builds on; leaf: by..., intra, depth, key.
    """
    own = [*by, "intra"]
    spread = frames.select(*own, "ts").join(leaf.select(*own, "depth", "key"), own)
    found = inverse_raht(coefficients, spread, *own, "ts", values=values)
    given = spread.select(*own, "ts", "key").join(found, [*own, "ts", "key"], "left")
    # a leaf meets an ancestor of each level in each frame
    rows = spread.agg(F.sum("depth")).first()[0] or 0
    given = staged_evenly(given.select(*own, "ts", "key", *(F.coalesce(v, F.lit(0.0)).alias(v) for v in values)), "inverse", rows)
    reference = given.where("ts = intra").select(*own, "key", *(F.col(v).alias(f"_{v}") for v in values))
    both = given.join(reference, [*own, "key"], "left")
    out = both.select(*by, "ts", "intra", "key", *((F.col(v) + F.when(F.col("ts") != F.col("intra"), F.col(f"_{v}")).otherwise(0.0)).alias(v) for v in values))
    out = staged_evenly(out, "predicted", rows)
    dropped(given)
    return out


def decode(slices: DataFrame) -> DataFrame:
    """All points of all slices, as codec.decode gives them."""
    rgb = yuv_to_rgb(*CHANNELS)
    return decoded_yuv(slices).select("ts", "patch", "pid", *"xyz", *(c.alias(a) for a, c in zip("rgb", rgb, strict=True)))


def decoded_yuv(slices: DataFrame) -> DataFrame:
    """ts, patch, pid, the points in their frame's place and their colours as they are coded."""
    names = slices.columns
    missing = [n for n in ("ts", "patch", "type", "size", "qp", "mv", "geometry", "color") if n not in names]
    if missing:
        raise EngineError(Kind.BAD_PARAMETERS, f"columns {missing} are missing")
    bad = F.raise_error(F.lit(Kind.BAD_SLICE.name)).cast("short")
    checked = slices.withColumn("type", F.when(_is(VALID) & F.coalesce("geometry", "color").isNotNull(), F.col("type")).otherwise(bad))
    known = staged(with_intra(checked), "with-intra")
    leaf = staged(leaves(known.where(~_is(PREDICT))).withColumnRenamed("ts", "intra"), "leaves")
    tree = ["patch", "intra"]
    # a tree's transform has the same places whatever the values
    places = stream_order(raht(leaf, *tree, values=()), *tree).select(*tree, "pos", "level", "prefix", "idx", "n0", "n1")
    coefficients = levels(known).join(places, [*tree, "pos"])
    colours = inverse_predicted(coefficients, leaf, known.select("patch", "ts", "intra"), "patch")
    at = leaf.select(*tree, "key", "pid", *"xyz")
    out = colours.join(at, [*tree, "key"]).join(known.select("ts", "patch", "mv"), ["ts", "patch"])
    xyz = affine(F.col("mv"), *"xyz")
    return out.select("ts", "patch", "pid", *(c.alias(a) for a, c in zip("xyz", xyz, strict=True)), *CHANNELS)
