"""Decoded frames as display buffers: 24 bytes a point, slices one after another.

A first pass gives each slice its place, the sum of the sizes of its frame's slices before it; a second one puts
each decoded point at the place of its slice and number. A buffer is made in pieces of PIECE points, so a task
holds a piece and not a frame.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import TO_RGB, YUV_SHIFT
from .trees import decoded_yuv
from .windows import offsets

PIECE = 1 << 16
POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "<f4"), ("g", "<f4"), ("b", "<f4")])
#: Slices of fewer points are shown in white.
TINY = 10


def unit_rgb(yuv: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Colours of 0 to 1, neither rounded nor held; white in tiny slices."""
    out = (yuv - YUV_SHIFT) @ TO_RGB.T / 255
    out[size < TINY] = 1.0
    return out


def places(sizes: DataFrame) -> DataFrame:
    """ts, patch, size and where in the frame's buffer the slice begins. sizes: ts, patch, size (points)."""
    return sizes.select("ts", "patch", "size", offsets("size", ["ts"], ["patch"]).cast("long").alias("offset"))


def frame_buffers(slices: DataFrame, piece: int = PIECE) -> DataFrame:
    """ts, piece (from 0), points and data of all frames; the pieces of a frame in order are its buffer."""
    points = decoded_yuv(slices)
    sizes = points.groupBy("ts", "patch").agg(F.count("*").alias("size"))
    at = points.join(places(sizes), ["ts", "patch"]).withColumn("place", F.col("offset") + F.col("pid"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        column = {c: rows[c].to_numpy() for c in rows.column_names}
        out = np.zeros(rows.num_rows, POINT)
        to = column["place"] - key[1].as_py() * piece
        for c in "xyz":
            out[c][to] = column[c]
        rgb = unit_rgb(np.stack([column[c] for c in ("luma", "cb", "cr")], 1), column["size"])
        for i, c in enumerate("rgb"):
            out[c][to] = rgb[:, i]
        return pa.table({"ts": pa.array([key[0].as_py()], pa.int32()), "piece": pa.array([key[1].as_py()], pa.int32()), "points": pa.array([rows.num_rows], pa.int64()), "data": pa.array([out.tobytes()], pa.binary())})

    dealt = at.select("ts", F.floor(F.col("place") / piece).cast("int").alias("piece"), "place", "size", "x", "y", "z", "luma", "cb", "cr")
    return dealt.groupBy("ts", "piece").applyInArrow(run, "ts int, piece int, points long, data binary")
