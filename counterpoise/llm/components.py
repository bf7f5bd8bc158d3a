"""Connected components of a link table, without gathering it anywhere.

Alternating large-star and small-star rounds: every node points to the smallest neighbour it
knows, until the links form stars.  Each round is written to the shared scratch area, which cuts
the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.session import spool

MAX_ROUNDS = 100


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest one of the neighbourhood."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low"))
    least = least.select("a", F.least("a", "low").alias("low"))
    return both.filter("b > a").join(least, "a").select(
        F.col("b").alias("a"), F.col("low").alias("b")
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour, and the node itself, is linked to the smallest one."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(least, "a").filter("b > low").select(F.col("b").alias("a"), "low")
    return moved.union(least).select("a", F.col("low").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node reachable.

    ``links`` has two columns a and b of one ordered type; direction, repeats and links from a
    node to itself do not matter.
    """
    now = spool(links.select("a", "b").filter("a <> b").distinct(), "links")
    state = None
    for _ in range(MAX_ROUNDS):
        now = spool(_small_star(_large_star(now)).distinct(), "links")
        n, mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if (n, mark) == state or n == 0:
            break
        state = (n, mark)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
