"""Connected components of a graph given as a table of links.

Links are turned into stars around the smallest node by alternating two steps. In the small-star step
every node hands its smaller neighbours, and itself, to the smallest of them; in the large-star step its
larger neighbours go to the smallest node it knows. Each step is one exchange by node and a running
minimum over its sorted rows, which Spark spills where a node has very many. The number of rounds is
logarithmic; they end when every node that has a smaller neighbour has no other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def _reached(rows: DataFrame) -> DataFrame:
    """Distinct ``x, y`` with ``least``, the smallest of x and its neighbours."""
    apart = rows.repartition("x").distinct()  # by x already, so this deals out nothing again
    return apart.withColumn("least", F.least("x", F.min("y").over(Window.partitionBy("x").orderBy("y"))))


def _both(stars: DataFrame) -> DataFrame:
    return stars.union(stars.select("y", "x")).toDF("x", "y")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, comp`` of every end of ``links`` (``x, y``, two different nodes): the smallest node reachable. Each node once."""
    stars = links.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    while True:
        near = _reached(stars)
        # the smallest neighbour takes the others, and the node itself (which its first row brings)
        near = near.select(F.when(F.col("y") == F.col("least"), F.col("x")).otherwise(F.col("y")).alias("x"), F.col("least").alias("y"))
        wide = _reached(_both(near)).where("y > x").select(F.col("y").alias("x"), F.col("least").alias("y"))
        stars = scratch.settle(wide, "stars")
        if _both(stars).groupBy("x").agg(F.min("y").alias("low"), F.max("y").alias("high")).where("low < x AND low <> high").isEmpty():
            break
    # a leaf that several nodes handed over stands more than once, always with its root
    return stars.union(stars.select("y", "y")).toDF("id", "comp").groupBy("id").agg(F.min("comp").alias("comp"))
