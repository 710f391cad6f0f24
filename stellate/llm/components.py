"""Connected components of a graph of links, by randomised contraction.

In each round every node takes, of itself and its neighbours, the one whose hash under
the round's seed is least; nodes with the same choice become one (Boegeholz, Brand and
Todor, "In-database connected component analysis", ICDE 2020). A constant share of the
nodes goes in each round, whatever the graph's shape. Before that, each partition
replaces its links by a spanning star of each of its own components. All steps are
aggregations with partial sums or joins with a side of unique keys; nothing is collected.
When few links are left, which is checked, one task joins them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


#: Links that one task may join at once.
SMALL = 200_000


def _stars(batches):
    """The links of a partition as (node, least node of its part)."""
    parent: dict[int, int] = {}

    def root(x):
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for k in range(0, len(nodes), 20_000):
        part = nodes[k : k + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["a", "b"])


def components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """id and component (the least id of its component) of every node of `links` (a, b: bigint).

    Links may repeat, lie both ways or join a node to itself; rows with a null link nothing.
    """
    pairs = links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a <> b")
    edges = checkpointed(pairs.mapInArrow(_stars, "a bigint, b bigint").distinct())
    nodes, seed = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("at", F.col("id")), 0
    while edges.limit(small + 1).count() > small:
        seed += 1
        edges, nodes = _contract(edges, nodes, seed)
    # What is left is small, by the check above: one task joins it.
    last = edges.repartition(1).mapInArrow(_stars, "a bigint, b bigint").select(F.col("a").alias("at"), F.col("b").alias("to"))
    nodes = checkpointed(nodes.join(last, "at", "left").select("id", F.coalesce("to", "at").alias("at")))
    if not seed:
        return nodes.withColumnRenamed("at", "component")
    least = nodes.groupBy("at").agg(F.min("id").alias("component"))
    return nodes.join(least, "at").select("id", "component")


def _contract(edges: DataFrame, nodes: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """One round: the edges between the chosen nodes, and for each first node where it is now."""
    rank = lambda x: F.struct(F.xxhash64(x, F.lit(seed)).alias("h"), x.alias("to"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("n"))
    chosen = checkpointed(least.select(F.col("a").alias("id"), F.least(F.col("n"), rank(F.col("a")))["to"].alias("to")))
    first, second = (chosen.select(F.col("id").alias(k), F.col("to").alias(f"to_{k}")) for k in "ab")
    moved = edges.join(first, "a").join(second, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
    step = chosen.select(F.col("id").alias("at"), "to")
    return checkpointed(moved.where("a <> b").distinct()), checkpointed(nodes.join(step, "at", "left").select("id", F.coalesce("to", "at").alias("at")))


def brute_force(pairs) -> dict[int, int]:
    """Components on the driver, for tests."""
    least = {x: x for p in pairs for x in p}
    while any(least[a] != least[b] for a, b in pairs):
        for a, b in pairs:
            least[a] = least[b] = int(np.minimum(least[a], least[b]))
    return least
