"""Connected components of an edge table by alternating large-star and small-star steps.

Each step joins the edges with the smallest neighbour of each node; neither a node's neighbours nor a
component is ever gathered in one place. Each round is written to the shared folder, in as many files as the edges of
the round before need, as a round makes no more. Before the first round, each node's edges to smaller ones are hung on
the smallest of these in one sorted pass, which leaves few edges where many say the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: distinct (a > b). large: hang larger neighbours on the node's smallest; else smaller ones."""
    if large:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        return near.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _contracted(edges: DataFrame) -> DataFrame:
    """edges: distinct (a > b), a small star of each a; rows are sorted and streamed, not joined."""
    low = F.min("b").over(Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return edges.select(F.when(F.col("b") == low, F.col("a")).otherwise(F.col("b")).alias("a"), low.alias("b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another; component is its smallest reachable node.

    Edges in either direction, repeated edges and loops are allowed; edges with a null end are ignored. No
    edges give no rows.
    """
    x, y = F.col(a), F.col(b)
    now = materialize(edges.filter(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "edges")
    before, now = now, materialize(_contracted(now), "edges", now.count())
    drop_table(before)
    mark = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state[0] == 0 or state == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark, before = state, now
        now = materialize(_star(_star(before, True), False), "edges", state[0])
        drop_table(before)
