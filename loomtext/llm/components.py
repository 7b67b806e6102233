"""Connected components of an edge list by alternating large-star and small-star rounds.

Each round is one group and one join; nothing is collected. A star centre with very many neighbours
is a skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(rows: DataFrame, keep_larger: bool) -> DataFrame:
    """rows (u, v): link the neighbours of each u, and u itself, to the least of them all."""
    least = rows.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    joined = rows.join(least, "u")
    if keep_larger:
        linked = joined.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select("u", F.col("low").alias("v")))
    return linked.filter("u <> v").distinct()


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _stars(both, keep_larger=True)


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return _stars(down, keep_larger=False)


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs, either way round, loops and repeats allowed -> (node, root).

    Every node of an edge but the roots gets one row; root is the least node of its component.
    No edges give no rows. Edges with a null end are left out.
    """
    now = cut(edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(pmod(xxhash64(v, u), 1000003))")).first()
        if seen[0] == 0 or tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(seen)
        now = cut(small_star(large_star(now)))
