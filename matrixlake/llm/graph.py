"""Connected components of a link table, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixlake.llm.common import materialize


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one link down and no link's lower end has one: then the lower ends are the components."""
    n, nodes = edges.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
    return n == nodes and edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (two columns of longs): component is the smallest node reachable.

    Large-star and small-star steps alternate until the links are stars.
    A step only needs each node's smallest neighbour, an aggregate, so that a
    node with very many links is never gathered in one row; each round's links
    are written to the shared folder. Self-links keep a node; repeated links and
    links in both directions count once.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    alone = links.where(F.col(a) == F.col(b)).select(F.col(a).alias("node"))
    edges = materialize(edges.where("u <> v"), "links")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialize(small.where("u <> v").distinct(), "links")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    rest = alone.withColumn("component", F.col("node"))
    return found.unionByName(roots).unionByName(rest).groupBy("node").agg(F.min("component").alias("component"))
