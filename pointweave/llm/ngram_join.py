"""Jaccard join of word-shingle sets by adaptive multi-match prefixes.

Documents with the same set are one class from the start, named by its least doc_id. In any one order
of all shingles, two sets of Jaccard similarity 0.8 or more share at least l of the first
n - ceil(0.8 n) + l shingles of each. Rare shingles come first: an order by how many classes have a
shingle, for the FREQUENT most shared ones, behind all others, which go by hash. Each document picks
the l for which the estimated cost is least: postings read, plus a verification for each candidate,
of which there are at most (postings read) / l. A pair is a candidate when it shares the smaller of
its two l's, and is verified on the whole sets.

Before that, two counts leave out what can't link, and lose nothing. A set's head is its first fifth by hash
and as many shingles more as `ahead` says; so many of the least shingles that two linked sets share lie in both
heads, and a set of whose head other heads have fewer links with none. Of the others whole sets are kept, and a
set's bound is how many of its shingles another of them has: two sets share no more than the smaller of their
bounds, less the bits that one set's signature has and the other's has not. A signature is a map of
64 * SIGNATURE bits in which each of those shingles sets one.

Only connections are asked for, so members of a group need not all be compared. Documents whose two
least shingles, or next two, are the same are linked to the least of them first, if their whole sets
agree that far; the prefix join then skips pairs within a connected group and verifies every other
candidate, so no link between groups is lost and groups of thousands give no pairs of their own.

Results in special cases: a null, empty or blank text has an empty set and stands alone; texts count
whole; rows with one doc_id are one document that links if any of its texts does; a null doc_id
stands alone with a null component; repeated rows give repeated results; an empty table gives none;
only doc_id and text are read. Sets hold 64-bit hashes, taken to be distinct for distinct shingles.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_kept, few, give_back, keep, keep_parts, map_texts, slices, table, texts_of
from .graph import components
from .shingles import shingle_set

PERCENT = 80
#: 64-bit numbers of a signature.
SIGNATURE = 8
#: Shingles that are ordered by their counts, and the least count of one; a bound on what is broadcast, not on results.
FREQUENT, LEAST_COUNT = 1 << 19, 4
#: Parts in which shingles are counted and sets are joined with their bounds, one after the other, so that disk holds the rows of one.
PARTS = 4
#: Least shingles that a round of stars looks at (from the first, how many), and how many a document shares with its centre.
ROUNDS, SHARED = ((1, 6), (7, 6)), 2
#: Cost of verifying a candidate, in postings read, and the count taken for shingles not among the frequent.
VERIFY_COST, RARE_COUNT = 50.0, 1.5
#: Overlap that links sets of n_a and n_b shingles.
OVERLAP = f"({PERCENT} * (n_a + n_b) + {99 + PERCENT}) div {100 + PERCENT}"


def needed(n: int | np.ndarray) -> int | np.ndarray:
    """Shingles that a set of n must share with any set it links to."""
    return (PERCENT * n + 99) // 100


def ahead(n: int) -> int:
    """How many of the least shingles that it shares with a linked set lie in the head of a set of n, if they share so many."""
    return max(12, (n + 15) // 16)


def prefix(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[int, np.ndarray]:
    """(l, the prefix for l) of a set. frequent: sorted shingles, counts: of classes that have them."""
    n = len(shingles)
    if not n:
        return 0, shingles
    at = np.minimum(np.searchsorted(frequent, shingles), max(0, len(frequent) - 1))
    known = frequent[at] == shingles if len(frequent) else np.zeros(n, bool)
    count = np.where(known, counts[at] if len(frequent) else 0, 0)
    order = np.argsort(count, kind="stable")  # shingles are sorted, so ties go by hash
    most = needed(n)
    ends = n - needed(n) + np.arange(1, most + 1)
    read = np.cumsum(np.where(count > 0, count, RARE_COUNT)[order][: ends[-1]])[ends - 1]
    matches = int(np.argmin(read + VERIFY_COST * (read - ends) / np.arange(1, most + 1))) + 1
    return matches, shingles[order[: ends[matches - 1]]]


def _described(docs: DataFrame) -> DataFrame:
    """doc_id, n, the set's 128-bit name (s1, s2) and its head, the first 20 % and some more by hash."""

    def run(texts: list[str], rest: dict) -> dict:
        sets = [shingle_set(x) for x in texts]
        names = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]
        return {
            "doc_id": rest["doc_id"],
            "n": [len(s) for s in sets],
            "s1": [int(x[0]) for x in names],
            "s2": [int(x[1]) for x in names],
            "head": [s[: len(s) - needed(len(s)) + ahead(len(s))] for s in sets],
        }

    return map_texts(texts_of(docs), "text", run, "doc_id long, n int, s1 long, s2 long, head array<long>")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n, set) of the documents with these ids."""

    def run(texts: list[str], rest: dict) -> dict:
        sets = [shingle_set(x) for x in texts]
        return {"id": rest["doc_id"], "n": [len(s) for s in sets], "set": sets}

    asked = docs.select("doc_id", "text").join(few(ids), F.col("doc_id") == F.col("id"), "left_semi")
    return map_texts(asked, "text", run, "id long, n int, set array<long>").where("n > 0")


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The values of a column of arrays without nulls."""
    values, at = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (a, b) of pairs whose whole sets link."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hold = []
            for p, q in zip(_lists(batch.column("set_a")), _lists(batch.column("set_b")), strict=True):
                same = len(np.intersect1d(p, q, assume_unique=True))
                hold.append(100 * same >= PERCENT * (len(p) + len(q) - same) and same > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(hold, pa.bool_()))
        give_back()

    return keep(both.mapInArrow(run, "a long, b long"), "links")


def _of_part(shingles: DataFrame, part: int) -> DataFrame:
    return shingles.where(F.pmod(F.shiftright("shingle", 16), F.lit(PARTS)) == part)


def _repeated(sets: DataFrame, part: int) -> DataFrame:
    """(shingle, classes) of a part of the shingles: those that several of the sets in column `set` have."""
    return _of_part(sets.select(F.explode("set").alias("shingle")), part).groupBy("shingle").agg(F.count("*").alias("classes")).where("classes > 1")


def _shared(sets: DataFrame, repeated: DataFrame, part: int) -> DataFrame:
    """(node, shingle): the repeated shingles of each id, of a part."""
    own = _of_part(sets.select(F.col("id").alias("node"), F.explode("set").alias("shingle")), part)
    return own.join(few(repeated.select("shingle")), "shingle", "left_semi")


def _signature() -> list[Column]:
    """The number of shingles and their signature."""
    bit = F.expr("shiftleft(1L, int(shiftrightunsigned(shingle, 8) & 63))")
    parts = [F.coalesce(F.bit_or(F.when(F.pmod("shingle", F.lit(SIGNATURE)) == i, bit)), F.lit(0)) for i in range(SIGNATURE)]
    return [F.count("*").alias("bound"), F.array(*parts).alias("signature")]


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.union, parts)


def linkable(docs: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets, repeated): id, n, set and bound of the documents that may link with another, and the shingles that several of them have. Drops heads."""
    found = []
    for part in range(PARTS):
        met = keep(_repeated(heads, part), "met")
        found.append(keep(_shared(heads, met, part).groupBy("node").agg(F.count("*").alias("found")), "found"))
        drop_kept(met)
    total = _union(found).groupBy("node").agg(F.sum("found").alias("found")).join(heads.select("id", "n"), F.col("node") == F.col("id"))
    ids = keep(total.where(f"found >= least(greatest(12, (n + 15) div 16), ({PERCENT} * n + 99) div 100)").select("id").distinct(), "ahead")
    for used in (*found, heads):
        drop_kept(used)
    whole = keep_parts(_sets(docs, ids), "whole", "id", PARTS)
    drop_kept(ids)
    repeated, bounds = [], []
    for part in range(PARTS):
        repeated.append(keep(_repeated(_union(whole), part), "repeated"))
        bounds.append(keep(_shared(_union(whole), repeated[-1], part).groupBy("node").agg(*_signature()), "bounds"))
    signature = [F.bit_or(F.col("signature")[i]) for i in range(SIGNATURE)]
    bound = keep(_union(bounds).groupBy("node").agg(F.sum("bound").alias("bound"), F.array(*signature).alias("signature")), "bound")
    sets = []
    for own in whole:
        sets.append(keep(own.join(bound, F.col("id") == F.col("node")).where(f"bound >= ({PERCENT} * n + 99) div 100").select("id", "n", "set", "bound", "signature"), "sets"))
        drop_kept(own)
    for used in (*bounds, bound):
        drop_kept(used)
    return _union(sets), _union(repeated)


def _frequent(repeated: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most shared shingles, sorted, and how many sets have each."""
    top = keep(repeated.where(f"classes >= {LEAST_COUNT}").orderBy(F.desc("classes"), "shingle").limit(FREQUENT), "frequent")
    found = top.toArrow()
    drop_kept(top)
    shingles = found.column("shingle").to_numpy()
    order = np.argsort(shingles)
    return shingles[order], found.column("classes").to_numpy()[order]


def star_pairs(sets: DataFrame, groups: DataFrame | None, first: int, length: int) -> DataFrame:
    """(a, b): each document with a centre of its least shingles in another group, when they share SHARED of those looked at.

    A shingle's centre is the document most of whose shingles are shared: of an original and its changed
    copies, the original, which they are all nearest to.
    """
    keyed = sets.select("id", "n", (1000 - F.expr("1000 * bound div n")).alias("rare"), F.explode(F.slice("set", first, length)).alias("shingle"))
    if groups is None:
        keyed = keyed.withColumn("within", F.col("id"))
    else:
        keyed = keyed.join(groups, F.col("id") == F.col("node"), "left").select("id", "n", "rare", "shingle", F.coalesce("component", "id").alias("within"))
    rank = F.struct(F.col("rare").alias("rank"), F.col("id").alias("a"), F.col("within").alias("centre"), F.col("n").alias("of"))
    centres = keyed.groupBy("shingle").agg(F.min(rank).alias("c"), F.min("within").alias("x"), F.max("within").alias("y")).where("x < y").select("shingle", "c.*")
    met = keyed.join(centres, "shingle").where(f"within <> centre and 100 * least(n, of) >= {PERCENT} * greatest(n, of)")
    shared = met.groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("shared"))
    return shared.where(F.col("shared") >= SHARED).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _joined(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """Groups with more links between them."""
    both = links if groups is None else groups.toDF("a", "b").union(links)
    joined = components(both)
    for used in (links, groups):
        if used is not None:
            drop_kept(used)
    return joined


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs that lie between two groups."""
    side = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.where("coalesce(c_a, a) <> coalesce(c_b, b)").select(*pairs.columns)


def _best(pairs: DataFrame) -> DataFrame:
    """For each document, the pair of it that shares most."""
    ends = pairs.select("a", "b", "shared", F.explode(F.array("a", "b")).alias("of"))
    best = ends.groupBy("of").agg(F.max(F.struct("shared", "a", "b")).alias("p")).select("p.a", "p.b")
    return best.distinct()


def candidates(sets: DataFrame, groups: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(a, b, shared): pairs of sets of different groups that share enough of their prefixes, and how many shingles of them."""
    shared = sets.sparkSession.sparkContext.broadcast(frequent)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "set"):
                found = [prefix(s, *shared.value) for s in _lists(part.column("set"))]
                columns = [*(part.column(c) for c in ("doc", "n", "bound", "signature", "within")), pa.array([m for m, _ in found], pa.int32()), pa.array([p for _, p in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "bound", "signature", "within", "matches", "shingles"])

    named = sets.join(groups, F.col("id") == F.col("node"), "left").select(F.col("id").alias("doc"), "n", "bound", "signature", F.coalesce("component", "id").alias("within"), "set")
    prefixes = named.mapInArrow(cut, "doc long, n int, bound long, signature array<long>, within long, matches int, shingles array<long>")
    postings = prefixes.select("doc", "n", "bound", "signature", "within", "matches", F.posexplode("shingles").alias("pos", "shingle"))
    # a set shares more with a partner at least as large than with any, so a shorter prefix of the smaller of two does
    twice = f"(({2 * PERCENT} * n + {99 + PERCENT}) div {100 + PERCENT} - matches)"
    whole = f"(({PERCENT} * n + 99) div 100 - matches)"
    postings = postings.select("doc", "n", "bound", "signature", "within", "matches", "shingle", F.expr(f"pos < n - {twice}").alias("early"))
    left, right = (postings.select("shingle", *(F.col(c).alias(f"{c}_{side}") for c in ("doc", "n", "bound", "signature", "within", "matches", "early"))) for side in "ab")
    alone = lambda x, y: " + ".join(f"bit_count(signature_{x}[{i}] & ~signature_{y}[{i}])" for i in range(SIGNATURE))
    meet = left.join(
        right,
        (left["shingle"] == right["shingle"])
        & F.expr(
            f"""doc_a < doc_b and within_a <> within_b and if(n_a <= n_b, early_a, early_b)
            and 100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b) and least(bound_a, bound_b) >= {OVERLAP}
            and least(bound_a - ({alone('a', 'b')}), bound_b - ({alone('b', 'a')})) >= {OVERLAP}"""
        ),
    )
    met = meet.groupBy("doc_a", "doc_b", "n_a", "n_b", "matches_a", "matches_b").agg(F.count("*").alias("shared"))
    # beyond what both prefixes share, two sets share no more than the longer of the rests, so a pair needs the difference to the overlap that links it
    of = lambda rest, x: rest.replace("matches", f"matches_{x}").replace("* n ", f"* n_{x} ")
    rest = F.expr(f"if(n_a <= n_b, greatest({of(twice, 'a')}, {of(whole, 'b')}), greatest({of(twice, 'b')}, {of(whole, 'a')}))")
    enough = F.greatest(F.least("matches_a", "matches_b"), F.expr(OVERLAP) - rest)
    return met.where(F.col("shared") >= enough).groupBy(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).agg(F.max("shared").alias("shared"))


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for each row."""
    described = keep_parts(_described(docs), "described", "doc_id", PARTS)
    own = keep(_union(described).select("doc_id", "n", "s1", "s2"), "own")
    classes = keep(own.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("id")), "classes")
    heads = []
    for part in described:
        heads.append(keep(part.where("n > 0").join(classes.select("id").distinct(), F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), "n", F.col("head").alias("set")), "heads"))
        drop_kept(part)
    sets, repeated = linkable(docs, _union(heads))

    groups = None
    for first, length in ROUNDS:
        stars = keep(star_pairs(sets, groups, first, length), "stars")
        groups = _joined(groups, verified(sets, stars))
        drop_kept(stars)
    left_over = keep(candidates(sets, groups, _frequent(repeated)), "candidates")
    for pick in (_best, _best, lambda p: p.select("a", "b")):
        if left_over.isEmpty():
            break
        chosen = keep(pick(left_over), "chosen")
        groups = _joined(groups, verified(sets, chosen))
        rest = keep(_apart(left_over.join(chosen, ["a", "b"], "left_anti"), groups), "left-over")
        for used in (left_over, chosen):
            drop_kept(used)
        left_over = rest
    for used in (sets, repeated, left_over):
        drop_kept(used)

    named = classes.join(groups, F.col("id") == F.col("node"), "left").select("s1", "s2", F.coalesce("component", "id").alias("component"))
    return own.join(named, ["s1", "s2"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    )


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
