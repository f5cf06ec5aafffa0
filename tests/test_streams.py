"""Streams whose frames come out of order: the results are those of a batch."""

import random
import time

import numpy as np
import pytest

from pointweave.errors import EngineError, Kind
from pointweave.operators import codec
from pointweave.params import Params
from pointweave.schemas import SLICES
from pointweave.sources.registered import save_as
from pointweave.streaming import frames as st


@pytest.fixture(scope="module")
def slices(spark):
    """Three patches of twelve frames in groups of four, one patch without some frames."""
    r, rows = np.random.default_rng(2), []
    for patch in range(3):
        fitting = np.unique(r.integers(0, 16, (60, 3)), axis=0).astype(float)
        for start in range(0, 12, 4):
            members = [(t, fitting + r.random(3), r.integers(0, 256, (len(fitting), 3)).astype(float), np.eye(4)) for t in range(start, start + 4) if patch < 2 or t % 4 != 2]
            rows += [tuple(getattr(s, n) for n in SLICES.fieldNames()) for s in codec.encode_gop(patch, fitting, members, Params())]
    return spark.createDataFrame(rows, SLICES)


def in_files(spark, df, groups, folder):
    """A file for each group of ts, in this order; then the closing row."""
    for group in groups:
        df.where(df.ts.isin(group)).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)
    st.closing(spark, df).coalesce(1).write.mode("append").parquet(folder)


def key(df):
    return sorted(tuple(r[c] for c in ("ts", "patch", "pid", "x", "y", "z", "r", "g", "b")) for r in df.collect())


ORDERS = {"in order": [[t] for t in range(0, 12)], "near": [[1, 0], [4, 2], [3], [6, 7], [5], [9], [8, 11], [10]], "far": [[11, 3], [7, 2, 9], [0], [10, 5, 1], [8, 4, 6]]}


@pytest.mark.parametrize("order", ORDERS)
def test_frames_in_any_order_decode_as_the_batch(spark, slices, tmp_path, order):
    folder = str(tmp_path / "in")
    in_files(spark, slices, ORDERS[order], folder)
    stream = st.decoded_stream(st.slice_stream(spark, folder, files=1), late={"in order": 0, "near": 2, "far": 12}[order])
    out = st.drain(stream, "decoded")
    assert key(out) == key(codec.decode(slices)) and out.count() > 1000


def test_what_comes_too_late_is_an_error(spark, slices, tmp_path):
    folder = str(tmp_path / "in")
    in_files(spark, slices, [[0, 1], [5, 6], [2, 3], [4]], folder)
    with pytest.raises(EngineError) as e:
        st.drain(st.decoded_stream(st.slice_stream(spark, folder, files=1), late=1), "late")
    assert e.value.kind is Kind.BAD_TIME_STAMP


def test_folder_of_slices_decodes_trigger_by_trigger(spark, slices, tmp_path):
    folder = str(tmp_path / "slices")
    save_as(slices.repartition(5), "slice", folder)
    stream = st.decoded_stream(st.slice_files_stream(spark, folder, frames=5, last=11))
    out = st.drain(stream, "folder", at_once=False)
    assert key(out) == key(codec.decode(slices))
    assert len({f.rsplit("/", 2)[1] for f in out.inputFiles()}) > 2  # rows came in several triggers


def test_groups_are_numbered_in_order(spark, tmp_path):
    rows = [(p, t, 0 if t % 3 == p else 1) for p in range(3) for t in range(-4, 11) if (p, t) != (1, 4)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "patch int, ts int, type int")
    groups = [[t] for t in range(-4, 11)]
    random.Random(4).shuffle(groups)
    in_files(spark, df, groups, str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    got = {(r.patch, r.ts): r.gop for r in st.drain(st.gop_stream(stream, late=20), "groups").collect()}
    want = {}
    for p in range(3):
        gop = None
        for _, t, kind in sorted(r for r in rows if r[0] == p):
            gop = 0 if gop is None else gop + (kind == 0)
            want[p, t] = gop
    assert got == want
