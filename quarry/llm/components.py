"""Connected components by alternating large-star and small-star steps.

Edges live in staged tables, one round at a time; nothing of a component is
gathered in a task or in the driver. A hub's minimum comes from a partial
aggregate, and its neighbours stay where the join's skew handling puts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.staging import discard, stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi") % 1_000_003)).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "edges") -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node reachable.

    Links to oneself are ignored. Each round writes the edges anew and the loop
    ends when they no longer change: then each node hangs on its root.
    """
    pairs = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    pairs = stage(pairs, name)
    before = _state(pairs)
    while before[0]:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = stage(large, name)
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(lowest, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        last, pairs = pairs, stage(moved.unionByName(lowest.select("hi", F.col("m").alias("lo"))).distinct(), name)
        discard(last, large)
        after = _state(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
