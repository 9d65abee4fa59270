"""Trees held as adjacency rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_tree(nodes: DataFrame, by: list[str], levels: int) -> DataFrame:
    """by, node, depth and preorder of a forest (by, node, parent, nth), of at most `levels` levels.

    Paths of sibling numbers grow by one join per level; preorder is their order. A node
    below the last level is left out.
    """
    path = lambda c: F.struct(F.col(c).alias("nth"), F.col("node").alias("node"))
    level = nodes.where("parent is null").select(*by, "node", F.lit(0).alias("depth"), F.array(path("nth")).alias("path"))
    out = level
    for _ in range(1, levels):
        above = level.select(*by, F.col("node").alias("parent"), "depth", F.col("path").alias("above"))
        level = nodes.join(above, [*by, "parent"]).select(*by, "node", (F.col("depth") + 1).alias("depth"), F.concat("above", F.array(path("nth"))).alias("path"))
        out = out.unionByName(level)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*by).orderBy("path")) if by else F.row_number().over(Window.orderBy("path"))
    return out.select(*by, "node", "depth", (place - 1).alias("preorder"))


def inherit(nodes: DataFrame, by: list[str], keys: list[str], levels: int) -> DataFrame:
    """nodes (by, node, parent, keys) with null keys taken from the nearest ancestor that has them, over at most `levels` levels."""
    out = nodes.select(*by, "node", F.col("parent").alias("_up"), *keys)
    above = nodes.select(*by, F.col("node").alias("_up"), F.col("parent").alias("_next"), *[F.col(k).alias(f"_{k}") for k in keys])
    for _ in range(1, levels):
        out = out.join(above, [*by, "_up"], "left").select(*by, "node", F.col("_next").alias("_up"), *[F.coalesce(k, f"_{k}").alias(k) for k in keys])
    return out.drop("_up")
