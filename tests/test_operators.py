import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.errors import EngineError, Kind
from pointweave.operators import cluster, codec, fitting, registration
from pointweave.params import Icp, IcpType, Params, SplitMethod
from pointweave.plans import stages, store

RNG = np.random.default_rng(3)


def turned(points, angle=0.1, shift=(0.6, -0.4, 0.3)):
    c, s = np.cos(angle), np.sin(angle)
    return points @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T + shift


@pytest.mark.parametrize("kind", IcpType)
def test_registration_finds_a_known_motion(kind):
    grid = np.array([[x, y, (x * y) % 5 + 0.3 * x] for x in range(0, 30, 2) for y in range(0, 30, 2)], float)
    fit = registration.align(turned(grid, 0.02), grid, Icp(type=kind, mse_ths=1e-9, transformation_ths=1e-16, iteration_ths=200))
    assert fit.mse < 1e-3 and np.allclose(fit.mv[3], [0, 0, 0, 1])


def test_registration_rejects_bad_parameters():
    with pytest.raises(EngineError) as e:
        registration.align(np.ones((4, 3)), np.ones((4, 3)), Icp(iteration_ths=1))
    assert e.value.kind is Kind.BAD_PARAMETERS
    assert registration.cloud_mse(np.zeros((0, 3)), np.ones((2, 3))) == -1


def merge_plan(sizes: dict[int, int], close: np.ndarray, most: float) -> dict[int, int]:
    """The rule of cluster.merge_pass on close points themselves: rows (point, its cluster, another cluster, its points near the point).

    From the last cluster back: of the earlier ones with which it fits into `most` points, the first to
    which it is close takes it, and the pass ends at the first cluster that fits with none. A cluster is
    close to another if more than cluster.CLOSE_POINTS of its points have more than cluster.CLOSE_POINTS points of the
    other near them, both taken with all that they have been merged with.
    """
    order, size, into = sorted(sizes), dict(sizes), {c: c for c in sizes}
    point, own, other, hits = close[:, 0], close[:, 1].copy(), close[:, 2].copy(), close[:, 3]
    for cur in reversed(order[1:]):
        fits = [k for k in order if k < cur and size[cur] + size[k] <= most]
        if not fits:
            break
        mine = np.flatnonzero(own == cur)
        pairs, at = np.unique(np.stack((point[mine], other[mine]), 1), axis=0, return_inverse=True)
        dense = np.bincount(at.ravel(), hits[mine], len(pairs)) > cluster.CLOSE_POINTS
        counts = dict(zip(*np.unique(pairs[dense, 1], return_counts=True), strict=True))
        near = [k for k in fits if counts.get(k, 0) > cluster.CLOSE_POINTS]
        if near:
            size[near[0]] += size.pop(cur)
            into = {c: near[0] if k == cur else k for c, k in into.items()}
            own[own == cur] = near[0]
            other[other == cur] = near[0]
    return into


def test_merge_plan():
    near = lambda a, b, points, hits=5: [(100 * a + i, a, b, hits) for i in points]
    plan = lambda sizes, *close: merge_plan(sizes, np.array([r for rows in close for r in rows] or np.zeros((0, 4)), np.int64).reshape(-1, 4), 14)
    assert plan({0: 10, 1: 10, 2: 3}, near(2, 1, range(5)), near(2, 0, range(5))) == {0: 0, 2: 0, 1: 1}
    assert plan({0: 10, 1: 10, 2: 3}, near(2, 1, range(5))) == {0: 0, 1: 1, 2: 1}
    assert plan({0: 10, 1: 10}, near(1, 0, range(5))) == {0: 0, 1: 1}
    assert plan({0: 10, 1: 3}, near(1, 0, range(4))) == plan({0: 10, 1: 3}, near(1, 0, range(9), 4)) == {0: 0, 1: 1}
    # 3 + 3 near points of two members count once these are one cluster, and a point near both members counts once
    assert plan({0: 4, 1: 2, 2: 2, 3: 2}, near(2, 1, range(5)), near(3, 0, range(5), 3), near(3, 1, range(5), 3)) == {0: 0, 1: 1, 2: 1, 3: 3}
    close = near(3, 1, range(5)), near(2, 1, range(3)), near(2, 3, range(9)), near(1, 0, range(3)), near(3, 0, range(3))
    assert plan({0: 9, 1: 2, 2: 2, 3: 2}, *close) == {0: 0, 1: 1, 2: 1, 3: 1}
    assert plan({0: 8, 1: 2, 2: 2, 3: 2}, *close) == {0: 0, 1: 0, 2: 0, 3: 0}


def counted(close: np.ndarray, into: dict[int, int]) -> tuple[np.ndarray, dict]:
    """close with merged clusters, and the exact counts of its cluster pairs."""
    hits: dict[tuple, int] = {}
    for point, own, other, n in close.tolist():
        if into[own] != into[other]:
            hits[point, into[own], into[other]] = hits.get((point, into[own], into[other]), 0) + n
    near: dict[tuple, list] = {}
    for (_, own, other), n in hits.items():
        near.setdefault((own, other), [0, 0])[n <= cluster.CLOSE_POINTS] += 1
    return np.array([(*k, n) for k, n in hits.items()] or np.zeros((0, 4)), np.int64).reshape(-1, 4), {k: cluster.Near(d, d, w) for k, (d, w) in near.items()}


def test_merging_by_counts_of_pairs_is_the_rule():
    """With bounds and counts made anew where these don't tell, as on the close points themselves."""
    rnd, again, merged = np.random.default_rng(8), 0, 0
    for _ in range(1000):
        n = int(rnd.integers(2, 12))
        sizes = {c: int(rnd.integers(1, 12)) for c in rnd.choice(40, n, replace=False).tolist()}
        names = sorted(sizes)
        close = []
        for point in range(int(rnd.integers(0, 120))):
            own = names[rnd.integers(n)]
            close += [(point, own, other, int(rnd.integers(1, 7))) for other in names if other != own and rnd.random() < 0.4]
        close, most = np.array(close or np.zeros((0, 4)), np.int64).reshape(-1, 4), int(rnd.integers(8, 40))
        want = merge_plan(sizes, close, most)
        got, start, now = {c: c for c in sizes}, None, dict(sizes)
        table, near = counted(close, {c: c for c in sizes})
        while True:
            into, start = cluster.merge_pass(now, near, most, start)
            got = {c: into[k] for c, k in got.items()}
            if start is None:
                break
            again += 1
            now = {k: sum(v for c, v in now.items() if into[c] == k) for k in set(into.values())}
            table, near = counted(table, into)
        merged += len(set(got.values())) < n
        assert got == want
    assert again > 30 and merged > 100


def test_merging_is_the_rule_on_point_sets(spark):
    """Small clusters merged as the rule says on the sets themselves, counted again after each merge."""
    points = RNG.uniform(0, 40, (600, 3)).round(3)
    seeds = RNG.uniform(0, 40, (14, 3))
    cluster_of = ((points[:, None] - seeds[None]) ** 2).sum(2).argmin(1)
    num, radius = 100, 9.0
    sets = [points[cluster_of == c] for c in range(14)]
    names = [[c] for c in range(14)]
    at = len(sets) - 1
    while True:
        tried, into = False, None
        for k in range(at - 1, -1, -1):
            if len(sets[at]) + len(sets[k]) > num * (1 + cluster.TOLERANCE):
                continue
            tried = True
            near = (((sets[at][:, None] - sets[k][None]) ** 2).sum(2) <= radius**2).sum(1)
            if (near > 4).sum() > 4:
                into = k
        if not tried:
            break
        if into is not None:
            sets[into] = np.concatenate((sets[into], sets[at]))
            names[into] += names[at]
            del sets[at], names[at]
        at -= 1
    rows = [(1, i, *map(float, p), int(c)) for i, (p, c) in enumerate(zip(points, cluster_of, strict=True))]
    df = spark.createDataFrame(rows, "ts int, pid long, x double, y double, z double, cluster int")
    got = {r.pid: r.patch for r in cluster.merge_small(df, ["ts"], num, radius).collect()}
    want = {c: i for i, cs in enumerate(sorted(names, key=min)) for c in cs}
    assert len(got) == 600 and all(got[i] == want[c] for i, c in enumerate(cluster_of)) and 1 < len(names) < 14


def lloyd(points, centres, rounds, least):
    for _ in range(rounds):
        own = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.stack([points[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        shift, centres = ((new - centres) ** 2).sum(1).mean(), new
        if shift < least:
            break
    return ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)


@pytest.mark.parametrize("most_held", [cluster.MOST_HELD, 5])
def test_k_means_settles_by_cloud(spark, most_held):
    """Centres of the driver's and centres of a table; each cloud ends when its own centres have settled."""
    rnd = np.random.default_rng(4)
    clouds = {1: rnd.uniform(0, 30, (120, 3)).round(2), 2: np.concatenate([rnd.normal(10 * i, 0.1, (20, 3)).round(3) for i in range(3)])}
    seeds = {1: clouds[1][:4], 2: clouds[2][[0, 20, 40]]}
    rows = [(k, i, *map(float, p)) for k, c in clouds.items() for i, p in enumerate(c)]
    centres = [(k, i, *map(float, p)) for k, c in seeds.items() for i, p in enumerate(c)]
    df = spark.createDataFrame(rows, "ts int, pid long, x double, y double, z double")
    out, last = cluster.k_means(df, spark.createDataFrame(centres, "ts int, cluster int, cx double, cy double, cz double"), ["ts"], 6, 0.5, True, 64.0, most_held)
    got = {(r.ts, r.pid): r.cluster for r in out.collect()}
    want = {(k, i): int(c) for k, points in clouds.items() for i, c in enumerate(lloyd(points, seeds[k], 6, 0.5))}
    assert got == want and last.count() == 7


def test_reference_segments_are_k_means(spark):
    points, patch = RNG.uniform(0, 30, (200, 3)).round(2), RNG.integers(0, 4, 200)
    centres = np.stack([points[patch == c].mean(0) for c in range(4)])
    rows = [(1, i, *map(float, p), int(c)) for i, (p, c) in enumerate(zip(points, patch, strict=True))]
    before = spark.createDataFrame(rows, "ts int, pid long, x double, y double, z double, patch int")
    out = cluster.reference_segments(before.drop("patch"), before, ["ts"], rounds=2, edge=32.0).select("pid", "patch").collect()
    own = lloyd(points, centres, 2, 0.01)
    assert {r.pid: r.patch for r in out} == {i: int(c) for i, c in enumerate(own)} and len(out) == 200


def test_segmenting_runs_at_once_is_frame_by_frame(spark):
    """stages.segment against one frame after the other; a frame that the one before matches badly starts anew."""
    rnd = np.random.default_rng(5)
    base = np.unique(rnd.integers(0, 24, (500, 3)), axis=0).astype(float)
    frames = {t: base[: 260 + 9 * t] + [0.2 * t, 0, 0] for t in range(7)}
    frames[4] = base[:260] * [1, 4, 1]  # stretched
    rows = [(t, i, *map(float, p), 1, 2, 3) for t, c in frames.items() for i, p in enumerate(c)]
    df = spark.createDataFrame(rows, "ts int, pid long, x double, y double, z double, r int, g int, b int")
    params = Params().with_(max_keyframe=3, segment={"num": 90, "block_num": 2})
    got = {(r.ts, r.pid): (r.patch, r.type) for r in stages.segment(df, params).collect()}
    dense = lambda now: cluster.result_patches(cluster.dense_segments(now, ["ts"], 90, 2, params.icp.radius_search_ths), ["ts"])
    want, before, kinds = {}, None, []
    for t in range(7):
        now = df.where(F.col("ts") == t)
        kind = 0
        if t % 3:
            moved = cluster.reference_segments(now, before.withColumn("ts", F.lit(t)).select(*now.columns, "patch"), ["ts"])
            fits = registration.register_patches(moved, before.withColumn("ts", F.lit(t)), ["ts", "patch"], params.icp).collect()
            sizes = {r["patch"]: r["count"] for r in moved.groupBy("patch").count().collect()}
            scored = [(sizes[r.patch], r.mse) for r in fits if r.mse is not None]
            kind = int(max(sizes.values()) <= 180 and sum(n * m for n, m in scored) / sum(n for n, _ in scored) <= 10)
        before = store.staged((moved if kind else dense(now)).select(*now.columns, "patch"), "before")
        kinds.append(kind)
        want |= {(t, r.pid): (r.patch, kind) for r in before.collect()}
    assert got == want and kinds[0] == kinds[3] == kinds[6] == 0 and kinds[1] == 1 and kinds[4] == 0 and len({p for p, _ in got.values()}) > 2


@pytest.mark.parametrize("kind", IcpType)
def test_registration_finds_motions_of_several_cells(kind):
    u, v = np.meshgrid(np.arange(0, 40, 1.5), np.arange(0, 40, 1.5))
    hills = np.stack([u.ravel(), v.ravel(), (6 * np.sin(u / 6) + 4 * np.cos(v / 5)).ravel()], 1)
    middle = hills.mean(0)
    away = turned(hills - middle, 0.15, (2.5, -2.0, 1.5)) + middle
    fit = registration.align(away, hills, Icp(type=kind, mse_ths=1e-9, transformation_ths=1e-14, iteration_ths=300))
    assert fit.converged and np.abs(fit.points - hills).max() < 0.05, (kind, fit.mse)
    assert np.allclose(registration.moved(fit.mv, away), fit.points)


def test_damped_steps_reach_the_best_rigid_motion():
    source, noise = RNG.uniform(0, 20, (200, 3)), RNG.normal(0, 0.3, (200, 3))
    target = turned(source, 0.7, (5, -3, 2)) + noise
    assert np.allclose(registration.damped(source, target, 100), registration.rigid(source, target), atol=1e-5)


def test_what_has_no_pairs_does_not_converge():
    for kind in IcpType:
        fit = registration.align(np.arange(60.0).reshape(20, 3), 1000 + np.arange(60.0).reshape(20, 3), Icp(type=kind, correspondence_ths=1.0))
        assert not fit.converged and np.array_equal(fit.mv, np.eye(4)) and fit.mse > 1e5
    cloud = RNG.uniform(0, 9, (50, 3))
    assert registration.align(cloud + 0.5, cloud, Icp(iteration_ths=2, transformation_ths=1e-30, mse_ths=1e-30)).converged


def test_split_cloud_keeps_every_point():
    cloud = RNG.integers(0, 50, (999, 3)).astype(float)
    pieces = fitting.split_cloud(cloud, 100)
    assert max(map(len, pieces)) <= 100 and sorted(map(tuple, np.concatenate(pieces))) == sorted(map(tuple, cloud))
    assert len(fitting.split_cloud(np.ones((50, 3)), 10)) == 1


@pytest.mark.parametrize("method", SplitMethod)
def test_fitting_cloud_stands_for_all(method):
    clouds = [RNG.integers(0, 20, (80 + 10 * i, 3)).astype(float) for i in range(3)]
    fit = fitting.fitting_cloud(clouds, Params().with_(patch={"split_method": method, "max_iter": 5}))
    assert 60 <= len(fit) <= 130 and (fit.min(0) >= 0).all() and (fit.max(0) <= 20).all()
    again = fitting.fitting_cloud(clouds, Params().with_(patch={"split_method": method, "max_iter": 5}))
    assert np.array_equal(fit, again)


def test_gop_breaks_where_a_patch_does_not_fit():
    base = RNG.integers(0, 16, (120, 3)).astype(float)
    gop = fitting.Gop(Params().with_(icp={"mse_ths": 100.0}, patch={"max_iter": 5}))
    assert gop.add(0, base) and gop.add(1, base + [0.2, 0, 0])
    assert not gop.add(2, base[:20]) and not gop.add(3, np.concatenate([base] * 3)) and not gop.add(4, base + 500)


def test_slices_decode_to_the_cloud():
    points = np.unique(RNG.integers(0, 40, (300, 3)), axis=0).astype(float)
    colours = np.stack([points[:, 0] * 6, points[:, 1] * 6, np.full(len(points), 90)], 1)
    params = Params().with_(slice={"qp_i": 1, "qp_p": 1}, patch={"interpolation_num": 1})
    mv = np.eye(4)
    mv[:3, 3] = [1, 2, 3]
    slices = codec.encode_gop(4, points, [(10, points, colours, np.eye(4)), (11, points, colours + 5, mv)], params)
    decoder = codec.Decoder()
    for s, rgb, shift in zip(slices, (colours, colours + 5), (np.zeros(3), np.array([1, 2, 3])), strict=True):
        xyz, out = decoder.decode(s)
        at, d2 = registration.nearest_of(xyz + shift, points)
        assert d2.max() <= 0.76 and np.abs(out - rgb[at]).max() <= 6
    with pytest.raises(EngineError) as e:
        codec.Decoder().decode(slices[1])
    assert e.value.kind is Kind.EMPTY_REFERENCE
