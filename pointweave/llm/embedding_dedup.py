"""Near duplicates among embeddings: spherical k-means cells, blocked cosines inside them.

Equal vectors are one class from the start, so copies are neither compared nor moved. Each class has
its home in the cell of the nearest centre. Two linked vectors can lie on both sides of a cell's
border. How much better each likes its own centre adds up to what lies between them along one
direction, so one of them is within half of that of the border, and a vector is a guest of every cell
whose border is that near: half of MARGIN times the distance that a linked partner keeps along one
direction (chord / sqrt(dimension)); margin=None takes half the whole chord, with which no partner
can be missed, at a much higher cost. At MARGIN = 4 the recall measured against brute force is 1.0 on the tables here (see the tests); all pairs that are
found are exact, in double precision.

The rows of a cell are dealt into blocks of BLOCK rows, and each pair of home blocks, and each home
and guest block, is one task of bounded size, whatever the size of the cell. A task gives the number
of links it found for each vector and a spanning star for each connected group, never its pairs.

The centres are fitted on at most SAMPLE classes (by hash of the id); every vector is indexed.

Results in special cases: a null or empty vector, one with null or non-finite components, or of zero
length, links with nothing; vectors of different dimensions don't link; rows with one vec_id are one
vector for components; a null vec_id has a null component and is kept if it links with nothing;
repeated rows link with one another; an empty table gives none; only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_kept, keep, table
from .graph import components

THRESHOLD = 0.95
SAMPLE, ROUNDS, MOST_CELLS, CELL_ROWS = 32_768, 12, 2048, 128
MARGIN = 4.0
BLOCK = 1024
#: Rows whose cosines with all centres are held at once: 32 MB for MOST_CELLS.
ROWS = 2048


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centre of the largest cosine for each point, and that cosine."""
    home, best = np.empty(len(points), np.int64), np.empty(len(points))
    for i in range(0, len(points), ROWS):
        like = points[i : i + ROWS] @ centres.T
        home[i : i + ROWS] = at = like.argmax(1)
        best[i : i + ROWS] = like[np.arange(len(at)), at]
    return home, best


def distances(centres: np.ndarray) -> np.ndarray:
    """How far unit centres are apart; a centre is infinitely far from itself, so never its own neighbour."""
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    np.fill_diagonal(apart, np.inf)
    return apart


def reach(threshold: float, margin: float | None, dim: int) -> float:
    """How much better, by distance of centres, a vector may like its own centre to be a guest of another's cell; rounding is allowed for."""
    chord = np.sqrt(2 - 2 * threshold)
    return float((chord if margin is None else margin * chord / np.sqrt(max(dim, 1))) / 2 + 1e-9)


def unit(values: list | np.ndarray | None) -> np.ndarray | None:
    """The vector at length 1 in double precision, or None if it can't link."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()  # so that neither squares nor sums over- or underflow
    return x / np.sqrt(x @ x)


def spherical_k_means(points: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centres; a cell that runs empty takes the point that its centre serves worst."""
    random = np.random.default_rng(seed)
    centres = points[random.choice(len(points), cells, replace=False)]
    for _ in range(rounds):
        home, best = nearest_centre(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, points)
        lengths = np.linalg.norm(sums, axis=1)
        worst = np.argsort(best, kind="stable")
        for i, c in enumerate(np.flatnonzero(lengths < 1e-12)):
            sums[c], lengths[c] = points[worst[i]], 1.0
        moved = sums / lengths[:, None]
        if np.allclose(moved, centres, atol=1e-9):
            break
        centres = moved
    return centres


def _units(vectors: DataFrame) -> DataFrame:
    """vec_id, dim (0: links with nothing), the unit vector as bytes and the raw vector's 128-bit name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unit(v) for v in batch.column("embedding").to_pylist()]
            raw = [b"" if u is None else u.tobytes() for u in found]
            names = [np.frombuffer(xxhash.xxh3_128_digest(r), np.int64) for r in raw]
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column("vec_id"),
                    "dim": pa.array([0 if u is None else len(u) for u in found], pa.int32()),
                    "point": pa.array(raw, pa.binary()),
                    "k1": pa.array([int(n[0]) for n in names], pa.int64()),
                    "k2": pa.array([int(n[1]) for n in names], pa.int64()),
                }
            )

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, dim int, point binary, k1 long, k2 long")


def _placed(classes: DataFrame, dim: int, centres: np.ndarray, near_by: float) -> DataFrame:
    """Each class with its home cell and the cells that it is a guest of; other dimensions have a cell each, -dimension."""
    shared = classes.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = shared.value
        apart = distances(centre)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            homes, guests = -dims.astype(np.int64), [[] for _ in dims]
            own = np.flatnonzero(dims == dim)
            if len(own):
                points = batch.column("point").take(pa.array(own))
                held = np.frombuffer(b"".join(points.to_pylist()), np.float64).reshape(len(own), dim)
                for lo in range(0, len(own), ROWS):
                    mine = own[lo : lo + ROWS]
                    like = held[lo : lo + ROWS] @ centre.T
                    at = like.argmax(1)
                    best = like[np.arange(len(mine)), at]
                    near = (best[:, None] - like) <= near_by * apart[at]
                    near[np.arange(len(mine)), at] = False
                    homes[mine] = at
                    for i, row in zip(mine.tolist(), near, strict=True):
                        guests[i] = np.flatnonzero(row).tolist()
            columns = {n: batch.column(n) for n in ("id", "copies", "dim", "point")}
            yield pa.RecordBatch.from_pydict(columns | {"home": pa.array(homes), "guests": pa.array(guests, pa.list_(pa.int64()))})

    return classes.select("id", "copies", "dim", "point").mapInArrow(run, "id long, copies long, dim int, point binary, home long, guests array<long>")


def _stars(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(node, least) stars over the connected groups of a table of links between ids."""
    a, b = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(a, np.where(links, b[None], top).min(1))
        new_b = np.minimum(b, np.where(links, new_a[:, None], top).min(0))
        if (new_a == a).all() and (new_b == b).all():
            break
        a, b = new_a, new_b
    return sorted({(int(n), int(c)) for n, c in zip(np.concatenate((left, right)), np.concatenate((a, b)), strict=True) if c < n})


def _compare(threshold: float):
    """A task: the links between its left and right rows, as counts and stars."""

    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        ids, copies, homes = (group.column(n).to_numpy() for n in ("id", "copies", "home"))
        guests = group.column("guests").to_pylist()
        dim = group.column("dim")[0].as_py()
        points = np.frombuffer(b"".join(group.column("point").to_pylist()), np.float64).reshape(len(ids), dim)
        order = np.argsort(ids, kind="stable")
        left, right = order[side[order] != 1], order[side[order] != 0]
        links = points[left] @ points[right].T >= threshold
        if (side == 2).any():
            links &= np.triu(np.ones(links.shape, bool), 1)
        elif len(left) and len(right):
            # a pair of different homes may meet in both cells: it counts in the lower one, if its other row is a guest there
            for j in np.flatnonzero(links.any(0) & (homes[right] < homes[left[0]])):
                at = np.flatnonzero(links[:, j])
                links[[i for i in at if homes[right[j]] in guests[left[i]]], j] = False
        n = np.zeros(len(ids), np.int64)
        a, b = np.nonzero(links)
        np.add.at(n, left[a], copies[right[b]])
        np.add.at(n, right[b], copies[left[a]])
        some = np.flatnonzero(n)
        stars = _stars(links, ids[left], ids[right]) if len(some) else []
        return pa.table(
            {
                "id": pa.array(np.concatenate((ids[some], np.array([s[0] for s in stars], np.int64)))),
                "n": pa.array(np.concatenate((n[some], np.zeros(len(stars), np.int64)))),
                "least": pa.array([None] * len(some) + [s[1] for s in stars], pa.int64()),
            }
        )

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, margin: float | None = MARGIN, block: int = BLOCK, cell_rows: int = CELL_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row."""
    own = keep(_units(vectors), "units")
    linked = own.where("dim > 0 and vec_id is not null")
    classes = keep(linked.groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("point").alias("point")), "classes")
    sizes = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim, n = (sizes[0]["dim"], sizes[0]["count"]) if sizes else (0, 0)
    cells = max(1, min(MOST_CELLS, n // cell_rows))
    sample = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("k1"), "k1", "k2").select("point").limit(SAMPLE).collect() if n else []
    centres = spherical_k_means(np.frombuffer(b"".join(bytes(r["point"]) for r in sample), np.float64).reshape(-1, dim), min(cells, len(sample))) if n else np.zeros((1, 1))
    placed = keep(_placed(classes, dim, centres, reach(threshold, margin, dim)), "placed")

    member = placed.select("*", F.explode(F.concat(F.array("home"), F.col("guests"))).alias("cell")).withColumn("guest", F.col("cell") != F.col("home"))
    # one row a cell: at most MOST_CELLS and one for each other dimension
    count = member.groupBy("cell").agg(F.sum((~F.col("guest")).cast("long")).alias("n_home"), F.sum(F.col("guest").cast("long")).alias("n_guest"))
    blocks = count.select("cell", F.ceil(F.col("n_home") / block).alias("homes"), F.ceil(F.col("n_guest") / block).alias("others")).where("homes > 0")
    dealt = member.join(blocks, "cell").withColumn("at", F.when(F.col("guest"), F.pmod(F.xxhash64("id"), "others")).otherwise(F.pmod(F.xxhash64("id"), "homes")))
    tasks = F.expr(
        """case when guest then transform(sequence(0, homes - 1), i -> named_struct('i', i, 'j', homes + at, 'side', 1))
        else concat(
            transform(sequence(0, homes - 1), k -> named_struct('i', least(k, at), 'j', greatest(k, at), 'side', case when k = at then 2 when k > at then 0 else 1 end)),
            transform(if(others = 0, array(), sequence(0, others - 1)), k -> named_struct('i', at, 'j', homes + k, 'side', 0))) end"""
    )
    rows = dealt.select("cell", "id", "copies", "dim", "point", "home", "guests", F.explode(tasks).alias("task")).select("*", "task.*").drop("task")
    found = keep(rows.groupBy("cell", "i", "j").applyInArrow(_compare(threshold), "id long, n long, least long"), "found")
    drop_kept(placed)

    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(found.where("least is not null"), "id", "least")
    named = classes.select("k1", "k2", "id", "copies").join(links, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
    named = named.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    return own.join(named, ["k1", "k2"], "left").select(
        "vec_id",
        F.when(F.col("dim") > 0, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when((F.col("dim") > 0) & F.col("vec_id").isNotNull(), F.col("component")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
