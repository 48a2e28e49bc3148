"""Levels of ever coarser graphs, with ids and labels that lead back to the points."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import checkpoint, numbered
from .communities import Communities
from .connecting import Coarse, Connecting
from .embedding import affinity, principal_components, random_start, tsne
from .graph import graph, knn_graph, normalise
from .sampling import Sampling


@dataclass(frozen=True)
class Level:
    """A level: its landmarks keep the ids of the points, so nothing needs to be traced back by position."""

    level: int
    parent: DataFrame  # edges that were coarsened
    coarse: Coarse
    directed: bool = True
    weighted: bool = False

    @property
    def transition(self) -> DataFrame:
        return self.coarse.transition

    @property
    def landmarks(self) -> DataFrame:
        return self.coarse.landmarks


def connected_graph(name: str, edges: DataFrame, adjacency: DataFrame, directed: bool, weighted: bool) -> DataFrame:
    """The graph that a connector meets: searches and clusters meet edges without loops, symmetric if the
    hierarchy is undirected, and CON those of the adjacency with row length 1; the others the transitions."""
    if name in ("SL-BFS", "LL-BFS"):
        return graph(edges, directed, weighted)
    if name == "CON":
        return graph(adjacency, directed, True)
    return edges


def _level(number: int, edges: DataFrame, adjacency: DataFrame, nodes: DataFrame, sampling: Sampling, connecting: Connecting, weights: DataFrame | None, directed: bool, weighted: bool) -> Level:
    landmarks = checkpoint(sampling.sample(normalise(edges), nodes))
    seen = connected_graph(connecting.name, edges, adjacency, directed, weighted)
    coarse = connecting.connect(seen if seen is edges else checkpoint(seen), landmarks, weights)
    coarse = replace(coarse, transition=checkpoint(coarse.transition), landmarks=checkpoint(coarse.landmarks))
    return Level(number, edges, coarse, directed, weighted)


def build(points: DataFrame, sampling: Sampling, connecting: Connecting, levels: int = 1, k: int = 10, directed: bool = True, weighted: bool = False, edges: DataFrame | None = None) -> list[Level]:
    """The k-NN graph of the points (``edges``, where it is known) and its levels; each is sampled and connected like the first."""
    edges = checkpoint(knn_graph(points, k, directed)) if edges is None else edges
    out = [_level(1, edges, edges, points.select("node"), sampling, connecting, None, directed, weighted)]
    for _ in range(1, levels):
        out.append(next_level(out[-1], sampling, connecting))
    return out


def next_level(level: Level, sampling: Sampling, connecting: Connecting) -> Level:
    """One level more, from a level's transitions; CON meets its counted edges, or transitions where none were counted."""
    adjacency = level.transition if level.coarse.adjacency is None else level.coarse.adjacency
    return _level(level.level + 1, level.transition, adjacency, level.landmarks, sampling, connecting, level.coarse.weights, level.directed, level.weighted)


def transitions_of(levels: list[Level]) -> DataFrame:
    """(level, src, dst, w) of all levels."""
    return reduce(DataFrame.unionByName, (x.transition.select(F.lit(x.level).alias("level"), "src", "dst", "w") for x in levels))


def describe(levels: list[Level]) -> DataFrame:
    """(level, nodes, edges, directed, weighted): what each level has."""
    spark = levels[0].transition.sparkSession
    rows = [(x.level, x.landmarks.count(), x.transition.count(), x.directed, x.weighted) for x in levels]
    return spark.createDataFrame(rows, "level int, nodes long, edges long, directed boolean, weighted boolean")


def landmarks_of(levels: list[Level]) -> DataFrame:
    """(level, lm_idx, node) of all levels."""
    out = None
    for x in levels:
        rows = numbered(x.landmarks.select("node"), "node", "lm_idx").select(F.lit(x.level).alias("level"), "lm_idx", "node")
        out = rows if out is None else out.unionByName(rows)
    return out


def trace(chain: list[DataFrame]) -> DataFrame:
    """(idx, root): positions of the last level followed down tables (lm_idx, parent_idx) to the root."""
    out = chain[-1].select(F.col("lm_idx").alias("idx"), F.col("parent_idx").alias("at"))
    for t in reversed(chain[:-1]):
        out = out.join(t.select(F.col("lm_idx").alias("at"), "parent_idx"), "at").select("idx", F.col("parent_idx").alias("at"))
    return out.select("idx", F.col("at").alias("root"))


def gather(landmarks: DataFrame, table: DataFrame) -> DataFrame:
    """The rows of a table (node, ...) for the landmarks: their points, labels or embeddings."""
    return table.join(landmarks.select("node"), "node", "left_semi")


def encode_labels(labels: DataFrame) -> DataFrame:
    """(node, label, code): codes number the sorted distinct labels from 0; null labels have none and go."""
    codes = numbered(labels.select("label").where(F.col("label").isNotNull()).distinct(), "label", "code")
    return labels.join(codes, "label").select("node", "label", F.col("code").cast("int").alias("code"))


def continuous_labels(labels: DataFrame) -> DataFrame:
    """(node, label double): booleans as 0 and 1, missing ones 0."""
    return labels.select("node", F.coalesce(F.col("label").cast("double"), F.lit(0.0)).alias("label"))


def embed(level: Level, points: DataFrame, random: bool = False, seed: int = 42, **options) -> DataFrame:
    """(level, node, x, y, cost): t-SNE of a level, from components of its points or at random."""
    own = checkpoint(level.landmarks.select("node"))
    start = random_start(own, seed) if random else principal_components(gather(own, points))
    return tsne(affinity(level.transition, own.count()), start, **options).withColumn("level", F.lit(level.level))


def embed_communities(level: Communities, points: DataFrame, **options) -> DataFrame:
    """(level, node, cluster, x, y, cost): t-SNE of clusters, each placed at first by its member's components."""
    own = level.members
    start = principal_components(gather(own, points)).join(own, "node").select(F.col("cluster").alias("node"), "features")
    out = tsne(affinity(level.transition, own.count()), checkpoint(start), **options).withColumnRenamed("node", "cluster")
    return out.join(own, "cluster").withColumn("level", F.lit(level.level))
