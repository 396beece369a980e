"""Connected components of an edge table, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Edges point from a node to a smaller one. In a round every node keeps the edge to its smallest
    neighbour, its other neighbours get an edge to that one, and each edge then jumps to where its
    end points itself. The smallest neighbour is an aggregate, which each task folds before the
    shuffle; both joins have one row a node on one side, so Spark can split a node of many edges.
    No task holds a component. Rounds end when nothing changes; the edges between rounds are tables
    in the shared folder. A loop edge (a = b) is left out, repeated edges count once.
    """
    links = C.materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = None
    for _ in range(rounds):
        low = C.materialise(links.groupBy("a").agg(F.min("b").alias("low")), "low")
        others = links.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        hooked = low.select("a", F.col("low").alias("b")).union(others)
        jumped = hooked.join(low.select(F.col("a").alias("b"), F.col("low").alias("next")), "b", "left")
        links = C.materialise(jumped.select("a", F.coalesce("next", "b").alias("b")).distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == now:
            roots = links.select(F.col("b").alias("node")).distinct()
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
        state = now
    raise RuntimeError("components did not settle")
