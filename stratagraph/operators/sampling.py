"""Landmark samplers: (node) tables of nodes that stand for a level; n = floor(share * nodes)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import key, uniform
from ..functions.session import checkpoint, numbered
from .graph import drop_loops, in_degree, top_neighbours, vector_product

SAMPLERS: dict[str, Callable] = {}
CELLS = 1024


@dataclass(frozen=True)
class Sampling:
    """What a level is sampled with; a next level is sampled with the same."""

    name: str = "RANDOM"
    share: float = 0.1
    seed: int = 42
    k: int = 10
    n_walks: int = 100
    n_steps: int = 50
    use_share: bool = True
    walks_threshold: float = 1.5
    order: str = "asc"  # of HUBSNN: smallest degrees first, or "desc"

    def __post_init__(self):
        if not 0 < self.share < 1:
            raise ValueError("share must lie between 0 and 1")
        if self.order not in ("asc", "desc"):
            raise ValueError("order is asc or desc")

    def with_(self, **changes) -> Sampling:
        return replace(self, **changes)

    def sample(self, transition: DataFrame, nodes: DataFrame) -> DataFrame:
        return SAMPLERS[self.name](self, transition, nodes)


def sampler(name: str):
    """Registers a strategy f(Sampling, transition, nodes) -> (node)."""

    def put(f):
        SAMPLERS[name] = f
        return f

    return put


def wanted(s: Sampling, nodes: DataFrame) -> int:
    return int(s.share * nodes.count())


@sampler("RANDOM")
def random_nodes(s: Sampling, transition: DataFrame, nodes: DataFrame) -> DataFrame:
    """The n nodes of smallest seeded keys: an exact count in any partitioning."""
    return nodes.select("node").orderBy(key(s.seed, F.col("node")), "node").limit(wanted(s, nodes))


@sampler("HUBS")
def hubs(s: Sampling, transition: DataFrame, nodes: DataFrame) -> DataFrame:
    """The n nodes of largest in-degree, ties to the smaller node; none if n is 0."""
    d = in_degree(transition, nodes)
    return d.orderBy(F.desc(F.round("degree", 9)), "node").limit(wanted(s, nodes)).select("node")


def walk_distribution(transition: DataFrame, nodes: DataFrame, n_steps: int, cut: int = 10) -> DataFrame:
    """(node, w): where walks of n_steps from a uniform start end, scaled to sum 1."""
    n = nodes.count()
    pi = nodes.select("node", F.lit(1.0 / max(n, 1)).alias("w"))
    for step in range(n_steps):
        pi = vector_product(pi, transition)
        if step % cut == cut - 1:
            pi = checkpoint(pi)
    pi = checkpoint(pi)
    total = pi.agg(F.sum("w")).first()[0] or 1.0
    return pi.select("node", (F.col("w") / F.lit(total)).alias("w"))


def cumulative(pi: DataFrame, buckets: int = 256) -> DataFrame:
    """(node, lo, hi) over all nodes in order; sums of buckets come first, so no task holds all rows."""
    b = pi.withColumn("b", F.pmod(F.col("node"), F.lit(buckets)))
    sums = b.groupBy("b").agg(F.sum("w").alias("s"))  # as many rows as buckets
    before = sums.select("b", (F.sum("s").over(Window.orderBy("b")) - F.col("s")).alias("before"))
    inner = b.withColumn("c", F.sum("w").over(Window.partitionBy("b").orderBy("node")))
    return inner.join(F.broadcast(before), "b").select("node", (F.col("before") + F.col("c") - F.col("w")).alias("lo"), (F.col("before") + F.col("c")).alias("hi"), "b")


def walk_counts(s: Sampling, transition: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, visits): where nodes * n_walks draws from the walk distribution fall."""
    spans = cumulative(checkpoint(walk_distribution(transition, nodes, s.n_steps)))
    n = nodes.count()
    draws = nodes.sparkSession.range(n * s.n_walks).select(uniform(s.seed, F.col("id")).alias("u"))
    # Draws and spans meet by cell of the unit interval; with as many cells as nodes, a draw meets few spans.
    cells = max(CELLS, n)
    a = draws.withColumn("cell", F.floor(F.col("u") * cells))
    low, high = F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells))
    # A wide span covers many cells: runs of CELLS first, so that no array grows with the nodes.
    b = spans.withColumn("run", F.explode(F.sequence(F.floor(low / CELLS), F.floor(high / CELLS))))
    b = b.withColumn("cell", F.explode(F.sequence(F.greatest(low, F.col("run") * CELLS), F.least(high, F.col("run") * CELLS + (CELLS - 1)))))
    hit = a.join(b, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return hit.groupBy("node").agg(F.count("*").alias("visits"))


@sampler("RW")
def random_walks(s: Sampling, transition: DataFrame, nodes: DataFrame) -> DataFrame:
    """The n most visited nodes, or all with more than n_walks * threshold visits."""
    visits = walk_counts(s, transition, nodes)
    if s.use_share:
        return visits.orderBy(F.desc("visits"), "node").limit(wanted(s, nodes)).select("node")
    return visits.where(F.col("visits") > s.n_walks * s.walks_threshold).select("node")


def greedy_exclusion(order: DataFrame, excludes: DataFrame, n: int) -> DataFrame:
    """The greedy set of (node, r): by r, a node is taken unless a taken node before it excludes it; the first n.

    A node is settled once all nodes before it that could exclude it are; random orders settle in
    about log(nodes) rounds, and the set is that of the one-by-one loop.
    """
    e = excludes.join(order.select(F.col("node").alias("src"), F.col("r").alias("r1")), "src").join(order.select(F.col("node").alias("dst"), F.col("r").alias("r2")), "dst").where("r1 < r2").select("src", "dst")
    e = checkpoint(e)
    state = order.select("node", "r", F.lit(None).cast("boolean").alias("taken"))
    while True:
        seen = e.join(state.select(F.col("node").alias("src"), "taken"), "src").groupBy("dst").agg(F.max("taken").alias("hit"), F.max(F.col("taken").isNull()).alias("open"))
        now = F.when(F.col("taken").isNotNull(), F.col("taken")).when(F.col("hit"), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True))
        state = checkpoint(state.join(seen, state["node"] == seen["dst"], "left").select("node", "r", now.alias("taken")))
        if not state.where(F.col("taken").isNull()).limit(1).count():
            return state.where("taken").orderBy("r").limit(n).select("node")


def _ranked(df: DataFrame, *by) -> DataFrame:
    """(node, r): r orders as ``by`` does; a struct, so no row is numbered in one task."""
    return df.select("node", F.struct(*by).alias("r"))


@sampler("HUBSNN")
def hubs_apart(s: Sampling, transition: DataFrame, nodes: DataFrame) -> DataFrame:
    """Greedy by in-degree, smallest first (or largest); each taken node excludes its k heaviest out-neighbours."""
    d = in_degree(transition, nodes).withColumn("d", F.round("degree", 9) * (1 if s.order == "asc" else -1))
    return greedy_exclusion(_ranked(d, "d", "node"), top_neighbours(drop_loops(transition), s.k), wanted(s, nodes))


@sampler("RANDOMNN")
def random_apart(s: Sampling, transition: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same in a seeded order."""
    order = nodes.select("node", key(s.seed, F.col("node")).alias("h"))
    return greedy_exclusion(_ranked(order, "h", "node"), top_neighbours(drop_loops(transition), s.k), wanted(s, nodes))


def delete_landmarks(landmarks: DataFrame, gone: DataFrame) -> DataFrame:
    return landmarks.join(gone, "node", "left_anti")


def add_landmarks(landmarks: DataFrame, more: DataFrame) -> DataFrame:
    return landmarks.select("node").union(more.select("node")).distinct()


def indexed(landmarks: DataFrame, level: int) -> DataFrame:
    """(level, lm_idx, parent_idx): positions in the order of the parent's nodes."""
    return numbered(landmarks.select("node"), "node", "lm_idx").select(F.lit(level).alias("level"), "lm_idx", F.col("node").alias("parent_idx"))
