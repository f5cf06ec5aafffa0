import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import octree
from pointweave.operators.codec import Tree, leaf_means

RNG = np.random.default_rng(5)
CLOUDS = {
    "cube": [[x, y, z] for x in (0, 2) for y in (0, 2) for z in (0, 2)],
    "single": [[3, 4, 5]],
    "same_place": [[1, 1, 1]] * 4,
    "power_of_two": [[0, 0, 0], [64, 64, 64], [32, 1, 7]],
    "negative": [[-9, -20, -3], [-1, -2, -30], [-5, -5, -5]],
    "fractional": (RNG.integers(0, 40, (60, 3)) * 0.37).tolist(),
    "random": RNG.integers(0, [60, 90, 33], (400, 3)).tolist(),
}


def recursive(points, values, centre, half, depth):
    """(mean coefficient, weight, coefficients) by walking the tree from its leaves up."""
    if depth == 0:
        return values.mean(0) * 1.0, 1, []
    parts, out = {}, []
    code = (points <= centre) @ np.array([4, 2, 1])
    for o in range(8):
        if (code == o).any():
            sign = np.where([o & 4, o & 2, o & 1], -1, 1)
            low, weight, below = recursive(points[code == o], values[code == o], centre + sign * half / 2, half / 2, depth - 1)
            parts[o] = (low, weight)
            out += below
    for bit in (0, 1, 2):
        merged = {}
        for o in sorted(parts):
            merged.setdefault(o >> 1, []).append((o & 1, parts[o]))
        parts = {}
        for o, sides in merged.items():
            if len(sides) == 1:
                parts[o] = sides[0][1]
            else:
                (a, wa), (b, wb) = sides[0][1], sides[1][1]
                out.append((np.sqrt(wa) * b - np.sqrt(wb) * a) / np.sqrt(wa + wb))
                parts[o] = ((np.sqrt(wa) * a + np.sqrt(wb) * b) / np.sqrt(wa + wb), wa + wb)
    return *parts[0], out


@pytest.mark.parametrize("name", CLOUDS)
def test_closed_form_is_the_recursive_tree(name):
    points = np.array(CLOUDS[name], float)
    values = np.random.default_rng(1).random((len(points), 3)) * 255
    tree, leaf = Tree.of(points)
    means = leaf_means(values, leaf, len(tree.keys))
    coefficients = tree.transform(means)
    low, weight, rest = recursive(points, values, tree.centre, tree.edge / 2, tree.depth)
    assert weight == len(tree.keys) == len(coefficients)
    assert np.allclose(coefficients[-1], low)
    own, other = (np.array(sorted(np.round(r, 6).tolist())) for r in (coefficients[:-1], rest))
    assert own.shape == other.reshape(own.shape).shape and np.allclose(own, other.reshape(own.shape), atol=1e-5)
    assert np.allclose((coefficients**2).sum(), (means**2).sum())
    assert np.allclose(tree.inverse(coefficients), means)
    parsed = Tree.parse(tree.geometry())
    assert (parsed.keys == tree.keys).all() and np.allclose(parsed.centres(), tree.centres(), atol=1e-4)
    if tree.depth:
        assert np.abs(points - tree.centres()[leaf]).max() <= tree.edge / 2**tree.depth / 2 + 1e-6


def test_tables_match_the_arrays(spark):
    rows = [(name, float(x), float(y), float(z), float(i % 7), float(i % 5), float(i % 3)) for name, pts in CLOUDS.items() for i, (x, y, z) in enumerate(pts)]
    points = spark.createDataFrame(rows, "cloud string, x double, y double, z double, r double, g double, b double")
    leaf = octree.leaves(octree.leaf_keys(points, octree.tree_frame(points, "cloud"), "cloud"), "cloud")
    coefficients = octree.raht(leaf, "cloud")
    back = octree.inverse_raht(coefficients, leaf, "cloud").withColumnRenamed("r", "r1")
    assert back.join(leaf, ["cloud", "key"]).where(F.abs(F.col("r") - F.col("r1")) > 1e-9).count() == 0
    ordered = octree.stream_order(coefficients, "cloud").toPandas()
    nodes = octree.occupancy(leaf, "cloud").toPandas()
    for name, pts in CLOUDS.items():
        values = np.array([r[4:] for r in rows if r[0] == name])
        tree, at = Tree.of(np.array(pts, float))
        own = ordered[ordered["cloud"] == name].sort_values("pos")[["r", "g", "b"]].to_numpy()
        assert np.allclose(own, tree.transform(leaf_means(values, at, len(tree.keys))))
        of = nodes[nodes["cloud"] == name].sort_values(["level", "prefix"])["occupancy"].tolist()
        assert of == [o for _, level in tree.nodes for o in level.tolist()]
