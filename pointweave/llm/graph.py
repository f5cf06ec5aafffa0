"""Connected components by alternating star operations on DataFrames.

Edges are rows (node, low) with low < node. A large star hands every node on to the least
neighbour of its low end, a small star joins all low ends of a node to the least of them; both
are one grouped minimum and one equi-join, whose only hot key (the centre of a star) stands on
the large side of a join that adaptive execution may split. Each round is written to the shared
folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_kept, keep


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("node").alias("at")).agg(F.min("low").alias("least"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least id reachable by links, for each id that has a link to another.

    Null ends and loops are no links; order and repeats of links don't matter; no links give no rows.
    """
    edges = keep(
        links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("node"), F.least(a, b).alias("low")).distinct(), "edges"
    )
    while True:
        up = edges.join(_least(edges), F.col("low") == F.col("at"), "left").select("node", F.coalesce("least", "low").alias("low"))
        low = up.join(_least(up).withColumnRenamed("at", "key"), F.col("node") == F.col("key"))
        ends = F.array(F.struct(F.col("node"), F.col("least").alias("low")), F.struct(F.col("low").alias("node"), F.col("least").alias("low")))
        new = low.select(F.explode(ends).alias("e")).select("e.*").where("node <> low").distinct()
        new = keep(new, "stars")
        drop_kept(edges)
        edges = new
        deep = edges.join(edges.select(F.col("node").alias("at")).distinct(), F.col("low") == F.col("at"), "left_semi")
        many = edges.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        if deep.isEmpty() and many.isEmpty():
            return edges.select("node", F.col("low").alias("component"))
