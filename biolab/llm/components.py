"""Connected components of an edge table by alternating large-star and small-star steps.

All in DataFrame joins and aggregates; each round is written to the shared folder, so a lost
executor costs one round at most. The number of rounds grows with the logarithm of a component's
diameter, not with its size, and no node's neighbours are gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of ``edges`` (a, b) the smallest node it can reach. Loops and nulls are left out."""
    scratch = Scratch(edges.sparkSession, "components")
    hi, lo = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = scratch.put("e0", edges.filter("a <> b").select(hi, lo).distinct())
    seen = None
    for k in range(1, max_rounds + 1):
        # large star: every larger neighbour of a node links to the node's smallest neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        # small star: smaller neighbours of a node, and the node, link to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = scratch.put(f"e{k}", small)
        scratch.drop(f"e{k - 1}")
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no stable components after {max_rounds} rounds")
    # stable: every node links to its component's smallest node
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
