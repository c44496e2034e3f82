"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _smallest(edges: DataFrame) -> DataFrame:
    """``u, v`` with the smallest of u and its neighbours as ``m``.

    Minima are combined before the shuffle and stored. The links then meet a table of one
    row per node, which is sent to all tasks when it is small; otherwise adaptive execution
    splits the links of a hub, which it cannot where a join continues an aggregation.
    """
    least = materialise(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _smallest(down)
    own = found.select("u", F.col("m").alias("v"))
    others = found.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(others)


def _unsettled(edges: DataFrame) -> int:
    """How many nodes are not yet the middle of a star, or a leaf with a single link to it.

    Links run down, so the middle of a star is its smallest node. Ends are counted before
    the shuffle, which brings no hub's links together.
    """
    below = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    above = edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    ends = below.unionByName(above).groupBy("node")
    counted = ends.agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return counted.where("down > 1 OR down = 1 AND up = 1").agg(F.count("*")).first()[0]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node with a link; the component is its smallest node.

    Each round rewrites the links towards the smallest nodes and stores them, until they
    form stars, which another round would not change, after a number of rounds that grows
    with the logarithm of the longest path. Only one number per round reaches the driver.
    Links from a node to itself and repeated links are ignored, links with a null end too.
    """
    proper = links.where(F.col(a) != F.col(b))
    down = proper.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = materialise(down.distinct(), "links")
    while _unsettled(edges):
        edges = materialise(
            _small_star(_large_star(edges).where("u <> v")).where("u <> v").distinct(), "stars"
        )
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
