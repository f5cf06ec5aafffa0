"""Coded octrees as tables, and slices decoded by joins, against the decoder of one patch's slices."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pointweave.functions.scalar import GEOMETRY_ZSTD
from pointweave.functions.entropy import zstd_decode
from pointweave.operators import buffers, codec, trees
from pointweave.params import Params
from pointweave.plans import store
from pointweave.schemas import SLICES
from pointweave.sources.formats import EYE, slice_of


def turned(angle, shift):
    mv = np.eye(4)
    mv[:2, :2] = [[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]]
    mv[:3, 3] = shift
    return mv


@pytest.fixture(scope="module")
def slices(spark):
    """Four patches in groups of three frames; one cloud of a single point, one slice that repeats its intra slice."""
    r, rows = np.random.default_rng(5), []
    for patch in range(4):
        for start in range(patch, 12, 3):
            fitting = np.unique(r.integers(0, 30, (1 if patch == 3 else 80, 3)), axis=0).astype(float)
            members = [(t, fitting + r.random(3), r.integers(0, 256, (len(fitting), 3)).astype(float), turned(0.1 * t, r.random(3))) for t in range(start, start + 3)]
            rows += [tuple(getattr(s, n) for n in SLICES.fieldNames()) for s in codec.encode_gop(patch, fitting, members, Params())]
    rows.append((14, 0, 7, 0, 30, list(EYE), None, b""))  # valid, predicted, without colours
    return spark.createDataFrame(rows, SLICES)


def test_leaves_are_those_of_the_parsed_tree(spark, slices):
    trees.register(spark)
    slices.createOrReplaceTempView("some_slices")
    got = spark.sql("SELECT * FROM leaves(TABLE(SELECT ts, patch, type, geometry FROM some_slices))").toPandas()
    want = 0
    for s in slices.where("geometry is not null").collect():
        tree = codec.Tree.parse(zstd_decode(bytes(s.geometry)) if s.type & GEOMETRY_ZSTD else bytes(s.geometry))
        own = got[(got.ts == s.ts) & (got.patch == s.patch)].sort_values("pid")
        assert own["key"].tolist() == tree.keys.tolist() and np.allclose(own[list("xyz")], tree.centres()) and own["pid"].tolist() == list(range(len(own)))
        want += len(own)
    assert len(got) == want > 500


def test_leaves_and_geometry_are_each_other_s_inverse(spark, slices):
    back = {(r.ts, r.patch): bytes(r.geometry) for r in trees.geometry(trees.leaves(slices).repartition(3)).collect()}
    want = {(s.ts, s.patch): zstd_decode(bytes(s.geometry)) if s.type & GEOMETRY_ZSTD else bytes(s.geometry) for s in slices.where("geometry is not null").collect()}
    assert back == want
    spark.sql("SELECT * FROM geometry(TABLE(SELECT * FROM leaves(TABLE(SELECT ts, patch, type, geometry FROM some_slices))) PARTITION BY (ts, patch) ORDER BY key)").count()


def test_decoding_by_joins_is_decoding_in_order(slices):
    by = ["ts", "patch", "pid"]
    a, b = (f(slices).toPandas().sort_values(by, ignore_index=True) for f in (trees.decode, codec.decode))
    assert len(a) == len(b) > 1500 and (a[by] == b[by]).all(axis=None)
    assert np.allclose(a[list("xyz")], b[list("xyz")], atol=1e-4)
    assert np.abs(a[list("rgb")].to_numpy() - b[list("rgb")].to_numpy()).max() <= 1 and (a[list("rgb")] == b[list("rgb")]).to_numpy().mean() > 0.999


def test_a_slice_without_what_it_builds_on_is_an_error(slices):
    with pytest.raises(PySparkException, match="EMPTY_REFERENCE"):
        trees.decode(slices.where("ts > 0 or type <> 1").where((F.col("patch") != 1) | (F.col("ts") != 1))).collect()
    with pytest.raises(PySparkException, match="BAD_SLICE"):
        trees.decode(slices.withColumn("type", F.when(F.col("ts") == 5, F.lit(2)).otherwise(F.col("type")).cast("short"))).collect()
    assert trees.decode(slices.limit(0)).count() == 0


def test_buffers_are_a_sequential_fill(slices):
    """A frame at a time, slice after slice into one array."""
    want = {}
    decoders = {}
    for s in sorted(slices.collect(), key=lambda s: (s.ts, s.patch)):
        decoder = decoders.setdefault(s.patch, Recorded())
        xyz, _ = decoder.decode(slice_of(s.asDict()))
        rows = np.zeros(len(xyz), buffers.POINT)
        for i, c in enumerate("xyz"):
            rows[c] = xyz[:, i]
        rgb = (decoder.yuv - codec.YUV_SHIFT) @ codec.TO_RGB.T / 255 if len(xyz) >= 10 else np.ones((len(xyz), 3))
        for i, c in enumerate("rgb"):
            rows[c] = rgb[:, i]
        want[s.ts] = np.concatenate([want.get(s.ts, rows[:0]), rows])
    got = {}
    for r in buffers.frame_buffers(slices, piece=50).orderBy("ts", "piece").collect():
        assert r.points <= 50 and len(r.data) == 24 * r.points
        got[r.ts] = got.get(r.ts, b"") + bytes(r.data)
    assert set(got) == set(want)
    for ts, data in got.items():
        own = np.frombuffer(data, buffers.POINT)
        assert len(own) == len(want[ts])
        for c in buffers.POINT.names:
            assert np.allclose(own[c], want[ts][c], atol=1e-4)
    tiny = [ts for ts in got if (np.frombuffer(got[ts], buffers.POINT)["r"] == 1).any()]
    assert tiny


class Recorded(codec.Decoder):
    """Keeps the colours of the last slice as they are coded."""

    def decode(self, s):
        rgb = codec.to_rgb
        codec.to_rgb = lambda yuv: setattr(self, "yuv", yuv) or rgb(yuv)
        try:
            return super().decode(s)
        finally:
            codec.to_rgb = rgb


def test_tasks_grow_in_number_with_rows(spark):
    """Shuffles of a stage have as many partitions as its rows need, and the session's settings stay."""
    before = spark.conf.get(store.PARTITIONS), spark.conf.get(store.TASK_BYTES)
    df = spark.range(4000).groupBy((F.col("id") % 997).alias("k")).agg(F.count("*").alias("n"))
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(store, "staged", lambda d, name: seen.append((spark.conf.get(store.PARTITIONS), spark.conf.get(store.TASK_BYTES))) or d)
        store.staged_evenly(df, "even", 50 * store.TASK_ROWS + 1)
        store.staged_evenly(df, "even", 1)
    assert [int(n) for n, _ in seen] == [51, int(before[0])] and seen[0][1] == "4m"
    assert before == (spark.conf.get(store.PARTITIONS), spark.conf.get(store.TASK_BYTES))
