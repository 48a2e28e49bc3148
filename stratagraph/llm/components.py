"""Connected components of an edge table, by alternating large and small stars.

What a key's rows have in common is found and given back by parts of the rows (``PARTS`` of a key
at most), so no task holds or joins all the edges of a hub.

Defined cases: self loops are dropped (a node met only in those has no row), repeated edges count
once, edges with a null end are dropped, other columns are ignored, no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, forget

PARTS = 256


def with_least(rows: DataFrame, key: str, value: Column, spread: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows with the least value of their key, and (key, name) of all keys; a key's rows are dealt out by ``spread``."""
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(spread), F.lit(PARTS)).cast("int")).repartition(key, "__part")
    by_part = dealt.groupBy(key, "__part").agg(F.min(value).alias(name))
    least = by_part.groupBy(key).agg(F.min(name).alias(name), F.collect_set("__part").alias("__parts"))
    back = least.select(key, name, F.explode("__parts").alias("__part"))
    return dealt.join(back, [key, "__part"]).drop("__part"), least.select(key, name)


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on (u, v)."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, _ = with_least(around, "u", F.least("u", "v"), "v", "m")
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
    around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined, least = with_least(around, "u", F.least("u", "v"), "v", "m")
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of every node of edges (u, v): root is the least node that it reaches.

    Each round is checkpointed, so lost executors cost one round, and the copy of the round
    before is removed; no link leaves the cluster.
    """
    now = checkpoint(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        after = checkpoint(_stars(_stars(now, True), False))
        forget(now)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # After the last round each node but the roots has one edge, to its root.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
