"""Cells of the embedding dedup: the pairs that are compared, and what halved gaps find."""

import numpy as np

from pointweave.llm import embedding_dedup as e


def made(n, dim=64):
    """Groups of eight around random directions, cosines within a group about 0.97."""
    random = np.random.default_rng(n)
    points = np.repeat(random.normal(size=(n // 8, dim)), 8, 0) + random.normal(size=(n, dim)) * 0.17
    return points / np.linalg.norm(points, axis=1)[:, None]


def placed(points, margin):
    cells = max(1, min(e.MOST_CELLS, len(points) // e.CELL_ROWS))
    centres = e.spherical_k_means(points, cells)
    like = points @ centres.T
    home, best = e.nearest_centre(points, centres)
    guest = best[:, None] - like <= e.reach(e.THRESHOLD, margin, points.shape[1]) * e.distances(centres)[home]
    guest[np.arange(len(points)), home] = False
    return home, guest


def test_compared_pairs_do_not_grow_with_the_square():
    work = []
    for n in (2048, 16384):
        home, guest = placed(made(n), e.MARGIN)
        homes = np.bincount(home, minlength=guest.shape[1])
        work.append((homes * (homes / 2 + guest.sum(0))).sum())
    assert work[1] < work[0] * 8**1.35 and work[1] < 0.1 * 16384**2 / 2


def test_each_link_meets_in_a_cell():
    points = made(4096)
    a, b = np.nonzero(np.triu(points @ points.T >= e.THRESHOLD, 1))
    for margin in (e.MARGIN, None):
        home, guest = placed(points, margin)
        assert len(a) > 5000 and (((home[a] == home[b]) | guest[a, home[b]] | guest[b, home[a]])).all()
