"""Connected components of a link table, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evotrail.staging import drop_staged, staged_table


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (long columns u, v): the smallest node
    reachable from it.

    Each round points the larger neighbours of a node at its smallest neighbour, then
    the node and its smaller neighbours likewise, until nothing changes: every node
    then points at its root. The number of rounds grows with the logarithm of the
    links. A node with very many links is one row per link in splittable joins and
    one row per task in the minimum, never a list. Null ends and loops link nothing.
    Links and results stay in the cluster; the driver sees one count and one sum.
    """
    stars = staged_table(
        links.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    seen = fingerprint(stars)
    while True:
        last, stars = stars, staged_table(small_star(large_star(stars)).distinct())
        drop_staged(last)
        now = fingerprint(stars)
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def large_star(stars: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node at the smallest of node and neighbours."""
    both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    least = least.select("u", F.least("u", "least").alias("least"))
    return (
        both.join(least, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("least").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def small_star(stars: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours at the smallest of them."""
    least = stars.groupBy("u").agg(F.min("v").alias("least"))
    moved = (
        stars.join(least, "u")
        .where(F.col("v") != F.col("least"))
        .select(F.col("v").alias("u"), F.col("least").alias("v"))
    )
    return moved.union(least.select("u", F.col("least").alias("v")))


def fingerprint(links: DataFrame) -> tuple:
    """Count and order-free sum of the links' hashes."""
    code = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(code)).first())
