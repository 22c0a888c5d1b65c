"""Connected components of a table of edges, by alternating large and small stars.

Each round replaces edges by edges to the smallest neighbour; a node's neighbours are never gathered, only their
minimum is. Edges that a task holds easily (`frames.EASY_ROWS`) are dealt by node and get their minimum by a window, two
shuffles a round. Where there are more, the minimum is made before the shuffle in part, and a node that has a large part
of the edges is joined by broadcast. Rounds are checkpointed and end when all components are stars around their smallest
nodes, which a round would leave as they are.

Nulls: an edge with a null end is none. Repeated edges and edges from a node to itself change nothing. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.llm import frames
from marketpulse.llm.frames import checkpointed, join_counted


def _shape(edges: DataFrame) -> tuple[int, int]:
    """The number of rows, and of nodes that have two smaller neighbours, or a smaller and a larger one."""
    none = F.lit(None).cast(edges.schema["a"].dataType)
    up = F.struct(F.col("b").alias("node"), F.col("a").alias("low"), none.alias("high"))
    down = F.struct(F.col("a").alias("node"), none.alias("low"), F.col("b").alias("high"))
    nodes = edges.select(F.inline(F.array(up, down))).groupBy("node")
    nodes = nodes.agg(F.count("low").alias("rows"), F.min("low").alias("m"), F.max("low").alias("low"), F.max("high").alias("high"))
    between = (F.col("m") < F.col("low")) | (F.col("m").isNotNull() & F.col("high").isNotNull())
    total, left = nodes.agg(F.sum("rows"), F.count_if(between)).first()
    return total or 0, left


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") > F.col("a")).alias("rows"))
    least = least.select("a", F.least("a", "m").alias("m"), "rows")
    return join_counted(edges, least, ["a"], "rows", total, frames.EASY_ROWS).select(F.col("m").alias("a"), "b")


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Edges have a < b; the smaller neighbours of b are linked to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("rows"))
    rest = join_counted(edges, least, ["b"], "rows", total, frames.EASY_ROWS).where(F.col("a") != F.col("m"))
    rest = rest.select(F.col("m").alias("a"), F.col("a").alias("b"))
    return rest.union(least.select(F.col("m").alias("a"), "b"))


def _easy_round(edges: DataFrame) -> DataFrame:
    """A large star and a small one; each row (a, b) gives one row, and some may come twice."""
    both = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("next")), F.struct(F.col("b").alias("node"), F.col("a").alias("next")))
    large = edges.select(F.inline(both)).withColumn("m", F.min("next").over(Window.partitionBy("node")))
    large = large.where(F.col("next") > F.col("node")).select(F.least("node", "m").alias("a"), F.col("next").alias("b"))
    small = large.repartition("b").distinct().withColumn("m", F.min("a").over(Window.partitionBy("b")))
    return small.select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node it is connected with) of every node of the edges (a, b)."""
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = checkpointed(edges.select(a, b).where(F.col("a") < F.col("b")).distinct())
    total, left = _shape(edges)
    twice = False
    while left:
        if total <= frames.EASY_ROWS:
            edges, twice = checkpointed(_easy_round(edges)), True
        else:
            large = _large_star(edges, total).distinct()  # at most as many edges as before
            edges = checkpointed(_small_star(large, total).distinct())
        total, left = _shape(edges)
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    leaves = edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return (leaves.distinct() if twice else leaves).union(roots)
