"""Tracking of patches on tables against the same on arrays."""

from pathlib import Path

import numpy as np
import pytest

from pointweave.operators import registration, spatial, tracking
from pointweave.params import Icp
from pointweave.plans.store import shared_folder

RNG = np.random.default_rng(11)


def tracked(clouds, target, icp):
    """The patch of each target point and the errors, one frame in memory."""
    if icp.centroid_alignment:
        shift = target.mean(0) - np.concatenate(clouds).mean(0)
        clouds = [c + shift for c in clouds]
    moved, errors = [], []
    for c in clouds:
        c = c + (target[registration.nearest_of(c, target)[0]] - c).mean(0)
        fit = registration.align(c, target, icp)
        moved.append(fit.points)
        errors.append(fit.mse if fit.converged else -1.0)
    points, owner = np.concatenate(moved), np.repeat(np.arange(len(clouds)), [len(c) for c in clouds])
    out = []
    for t in target:
        d2 = ((points - t) ** 2).sum(1)
        near = np.argsort(d2, kind="stable")[:5]
        hit = next((i for i in near if d2[i] < 2 * errors[owner[i]]), near[0])
        out.append(owner[hit])
    return out, errors


@pytest.mark.parametrize("centred", [True, False])
def test_tables_track_as_arrays_do(spark, centred):
    icp, rows, goals, want = Icp(centroid_alignment=centred, iteration_ths=6), [], [], {}
    for ts in range(2):
        clouds = [RNG.uniform(0, 12, (40, 3)) + 10 * np.array([i % 2, i // 2, 0]) for i in range(4)]
        turn = np.array([[np.cos(0.05), -np.sin(0.05), 0], [np.sin(0.05), np.cos(0.05), 0], [0, 0, 1]])
        target = np.concatenate(clouds) @ turn.T + [0.8, -0.5, 0.4] + RNG.normal(0, 0.05, (160, 3))
        pid = 0
        for i, c in enumerate(clouds):
            for p in c:
                rows.append((ts, i, pid, *map(float, p)))
                pid += 1
        goals += [(ts, j, *map(float, p)) for j, p in enumerate(target)]
        want[ts] = tracked(clouds, target, icp)
    patches = spark.createDataFrame(rows, "ts int, patch int, pid long, x double, y double, z double")
    target = spark.createDataFrame(goals, "ts int, pid long, x double, y double, z double")
    out, errors = tracking.track(patches, target, ["ts"], icp)
    got = {(r.ts, r.pid): r.patch for r in out.collect()}
    assert len(got) == 320
    for ts, (owners, mse) in want.items():
        assert [got[ts, j] for j in range(160)] == owners
        found = {r.patch: r.mse for r in errors.where(f"ts = {ts}").collect()}
        assert np.allclose([found[i] for i in range(4)], mse)


def test_patches_without_pairs_keep_their_place(spark):
    icp = Icp(centroid_alignment=False, correspondence_ths=0.5)
    patches = spark.createDataFrame([(0, p, 10 * p + i, 100.0 * p + i, 0.0, 0.0) for p in range(2) for i in range(4)], "ts int, patch int, pid long, x double, y double, z double")
    target = spark.createDataFrame([(0, i, 5.0 * i, 9.0 * i, 0.0) for i in range(4)], "ts int, pid long, x double, y double, z double")
    moved, errors = tracking.registered(patches, target, ["ts"], icp)
    assert {(r.patch, r.mse, r.converged) for r in errors.collect()} == {(0, -1.0, False), (1, -1.0, False)}
    assert sorted(r.x for r in moved.collect()) == sorted(r.x for r in patches.collect())


def test_sums_give_the_rigid_motion():
    a = RNG.uniform(0, 9, (50, 3))
    b = a @ np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]]).T + [1, 2, 3] + RNG.normal(0, 0.1, (50, 3))
    assert np.allclose(tracking.rigid_from_sums(50, a.sum(0), b.sum(0), a.T @ b), registration.rigid(a, b))


def test_rounds_leave_no_stages_behind(spark):
    """What a round staged goes with it; of a track, settled points, errors and hits stay."""
    folder = Path(shared_folder(spark).removeprefix("file://")) / "stages"
    names = lambda: {p.name for p in folder.iterdir()} if folder.exists() else set()
    rows = [(0, i // 20, i, *map(float, p)) for i, p in enumerate(RNG.uniform(0, 12, (40, 3)))]
    patches = spark.createDataFrame(rows, "ts int, patch int, pid long, x double, y double, z double")
    before = names()
    out, errors = tracking.track(patches, patches.drop("patch"), ["ts"], Icp(iteration_ths=3))
    assert {n.split("-")[0] for n in names() - before} <= {"steps", "done", "errors", "hits"}
    assert out.count() == 40 and errors.count() == 2


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_over_borders_of_blocks(spark, k):
    """Against brute force, in groups of several blocks, with ties, far points and negative places."""
    grid = np.array([(x, y, z) for x in range(-12, 12, 2) for y in range(-9, 9, 3) for z in (-4, 0, 4)], float)
    groups = {0: (RNG.integers(-14, 14, (150, 3)).astype(float), grid), 1: (RNG.uniform(-300, 300, (60, 3)), RNG.uniform(-30, 30, (400, 3)))}
    schema = "g int, {0} long, x double, y double, z double"
    queries, targets = (spark.createDataFrame([(g, i, *map(float, p)) for g, both in groups.items() for i, p in enumerate(both[s])], schema.format(n)) for s, n in enumerate(("qid", "tid")))
    got = {(r.g, r.qid, r["rank"]): r.tid for r in spatial.nearest(queries, targets, ("g",), k).collect()}
    for g, (q, t) in groups.items():
        for i, p in enumerate(q):
            d2 = ((t - p) ** 2).sum(1)
            assert [got[g, i, n + 1] for n in range(k)] == np.lexsort((np.arange(len(t)), d2))[:k].tolist()
