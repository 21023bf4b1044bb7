"""Connected components of a distributed list of links, by alternating stars.

Large-star links every larger neighbour of a node to the node's least
neighbour, small-star every smaller one; both keep connectivity, and the links
end as a star around each component's least node.  Least neighbours are
aggregated before the shuffle, a hub's links are split by the skew join, and
every round is a written table, so no round is computed twice and a lost
executor costs its own tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written_at


def _least(links: DataFrame, by: str, of: str, floor: bool) -> DataFrame:
    least = F.min(of)
    return links.groupBy(F.col(by).alias("_at")).agg((F.least(least, F.col("_at")) if floor else least).alias("_least"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both, "a", "b", True)
    return both.join(least, both["a"] == least["_at"]).where("b > a").select(F.col("b").alias("a"), F.col("_least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = _least(links, "a", "b", False)
    moved = links.join(least, links["a"] == least["_at"]).where("b <> _least").select(F.col("b").alias("a"), F.col("_least").alias("b"))
    return moved.unionByName(least.select(F.col("_at").alias("a"), F.col("_least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) long -> (node, root) for every node of a link; root is the least node that it reaches."""
    one, other = F.least("a", "b"), F.greatest("a", "b")
    now, path = written_at(links.where("a <> b").select(other.alias("a"), one.alias("b")).distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = seen
        before = path
        now, path = written_at(_small_star(_large_star(now)), "links")
        release(now.sparkSession, before)
