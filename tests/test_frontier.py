"""Fitting clouds level by level against the recursion for one group."""

import numpy as np
import pytest

from pointweave.errors import EngineError
from pointweave.operators.fitting import fitting_cloud
from pointweave.operators.frontier import fitting_clouds
from pointweave.params import Params, SplitMethod


def groups():
    """Clouds that share most of space, some of which miss a corner, and two that are a point each."""
    r, out = np.random.default_rng(7), {}
    for g in range(5):
        base = r.integers(0, 60, (150, 3)).astype(float)
        clouds = [base + r.normal(0, 0.4, base.shape) for _ in range(3)]
        if g == 1:
            clouds[2] = clouds[2][clouds[2][:, 0] < 30]
        if g == 2:
            clouds[1] = clouds[1][(clouds[1] < 30).sum(1) > 1]
        if g == 3:
            clouds = [c[(c[:, 2] < 15) | (c[:, 2] > 45)] for c in clouds]
        out[g] = clouds
    out[5] = [np.ones((1, 3)), np.ones((1, 3))]
    out[6] = [r.integers(0, 9, (40, 3)).astype(float)]
    return out


@pytest.mark.parametrize("method", SplitMethod)
@pytest.mark.parametrize("smallest", [4.0, 16.0])
def test_levels_give_what_the_recursion_gives(spark, method, smallest):
    params = Params().with_(patch={"split_method": method, "clustering_ths": smallest, "max_iter": 6})
    clouds = groups()
    rows = [(g, m, i, *map(float, p)) for g, cs in clouds.items() for m, c in enumerate(cs) for i, p in enumerate(c)]
    df = spark.createDataFrame(rows, "grp int, member int, pid long, x double, y double, z double").repartition(4)
    got = fitting_clouds(df, params, "grp").toPandas()
    for g, cs in clouds.items():
        want = fitting_cloud(cs, params)
        own = got[got["grp"] == g][["x", "y", "z"]].to_numpy()
        assert len(own) == len(want)
        assert np.allclose(own[np.lexsort(own.T)], want[np.lexsort(want.T)])


def test_special_tables(spark):
    none = spark.createDataFrame([], "grp int, member int, pid long, x double, y double, z double")
    assert fitting_clouds(none, Params(), "grp").count() == 0
    with pytest.raises(EngineError):
        fitting_clouds(none, Params().with_(patch={"clustering_ths": 0.5}), "grp")
