"""Connected components of a link table by alternating star steps.

Each round points all larger neighbours of a node at its least neighbour, then all smaller ones; stars
meet in a logarithmic number of rounds, also along chains. A node's least neighbour is a partial
aggregate, so a node with very many links gathers nowhere; the join that hands it back to the links
can be split by Spark where one node is hot. Every round is stored in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Edges (a, b) with a > b, after one star step around each node."""
    around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if larger:
        around = around.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    met = around.join(least.select("u", F.least("u", "m").alias("m")), "u")
    moved = met.where("v > u" if larger else "v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not larger:
        moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, group) for every node of the links (a, b): the group's name is its least node."""
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    while True:
        edges = stored(_star(_star(edges, True), False), "edges")
        state = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("group")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("group")).distinct()
    )
