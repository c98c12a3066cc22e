"""Connected components of a table of links, by alternating large and small stars (Kiveris et al., 2014).

Links never reach the driver: each round is joins and aggregations over (a, b) rows, written to the
shared folder. The least neighbours are a table of their own before the join, so that both of its sides
are dealt out anew and adaptive execution can split a star whose centre many rows name. A round's tables go
once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import forget, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links of a large star, and the table that they are joined with."""
    both = _both(edges)
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter(F.col("a") != F.col("b")).distinct(), least


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, root) for every value that is in a link to another: root is the smallest value of its component."""
    at = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before, now = None, _state(at)
    while now != before:  # as many rounds as it takes; stars to begin with take one
        for star in (_large_star, _small_star):
            found, least = star(at)
            following = written(found, "stars")
            forget(at, least)
            at = following
        before, now = now, _state(at)
    return at.select("a", F.col("b").alias("root")).union(at.select(F.col("b").alias("a"), F.col("b").alias("root")).distinct())
