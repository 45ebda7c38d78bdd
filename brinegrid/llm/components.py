"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, met


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the smallest of u and all its partners; a hub's pairs do not meet in one task."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
    return met(pairs, materialise(least, "least"), ["u"]).drop("c")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    star = _star(down)
    return star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of a link (columns a, b); a component is named by its smallest id."""
    edges = materialise(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u != v").distinct(), "links")
    if edges.isEmpty():
        return edges.toDF("id", "component")
    mark = None
    while True:
        edges = materialise(_large(edges).filter("u != v").distinct(), "stars")
        edges = materialise(_small(edges).filter("u != v").distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select("v", "v").toDF("id", "component")).distinct()
        mark = now
