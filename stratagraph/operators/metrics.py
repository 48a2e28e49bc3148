"""Quality metrics of graphs, embeddings and clusterings, as small tables."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import key
from ..functions.session import checkpoint
from .graph import BLOCK, drop_loops, knn, undirected_edges
from .sparse import Near, Rows, hop_shares, lowest, lowest_of, path_lengths, path_shares, reached

MOST_EDGES = 5_000_000
#: Clusters whose centres are broadcast; more meet in blocks of a Cartesian product.
MOST_CLUSTERS = 10_000
METRICS: dict[str, Callable[..., DataFrame]] = {}


def metric(name: str):
    """Registers f(...) -> one-row DataFrame with the column ``value``."""

    def put(f):
        METRICS[name] = f
        return f

    return put


def long_table(values: dict[str, DataFrame], **tags) -> DataFrame:
    """(metric, value, tags...) of named one-row results."""
    out = None
    for name, df in values.items():
        row = df.select(F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"), *[F.lit(v).alias(k) for k, v in tags.items()])
        out = row if out is None else out.unionByName(row)
    return out


# Centralities: shortest paths from each node, a row a node; the graph goes to each task.


def sample_nodes(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    return nodes.select("node").orderBy(key(seed, F.col("node")), "node").limit(k)


def _adjacency(edges: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, row starts, columns, weights); the number of edges is checked before they come to the driver."""
    if (n := edges.count()) > MOST_EDGES:
        raise ValueError(f"{n} edges: path metrics take {MOST_EDGES} at most; use a coarser level")
    t = edges.select("src", "dst", "w").toArrow()
    a, b, w = (t[c].to_numpy() for c in ("src", "dst", "w"))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    order = np.lexsort((b, a))
    return ids, np.searchsorted(a[order], np.arange(len(ids) + 1)), b[order], w[order].astype(float)


def _paths(start: int, rows: np.ndarray, cols: np.ndarray, weights: np.ndarray, cutoff: float | None = None):
    """Dijkstra: nodes in order of distance, distances, path counts, predecessors; no path is longer than a cutoff."""
    n, limit = len(rows) - 1, np.inf if cutoff is None else cutoff + 1e-12
    dist, count, back = np.full(n, np.inf), np.zeros(n), [[] for _ in range(n)]
    dist[start], count[start], order, done, heap = 0.0, 1.0, [], np.zeros(n, bool), [(0.0, start)]
    while heap:
        d, v = heapq.heappop(heap)
        if done[v]:
            continue
        done[v] = True
        order.append(v)
        for e in range(rows[v], rows[v + 1]):
            u, far = cols[e], d + weights[e]
            if far > limit:
                continue
            if far < dist[u] - 1e-12:
                dist[u], count[u], back[u] = far, count[v], [v]
                heapq.heappush(heap, (far, u))
            elif abs(far - dist[u]) <= 1e-12 and not done[u]:
                count[u] += count[v]
                back[u].append(v)
    return order, dist, count, back


def _kind(weights: np.ndarray) -> str:
    """What lengths a graph has: "hops" (all the same), "sums", or "other" where some are next to zero and paths go one by one."""
    if not len(weights) or not np.isfinite(weights).all() or weights.min() <= 1e-9:
        return "other"
    return "hops" if weights.min() == weights.max() else "sums"


def _at_once(edges: int, n: int) -> int:
    """Starts whose paths a task follows together."""
    return int(np.clip(32_000_000 // max(edges, 4 * n, 1), 4, 64))


def _parts(spark) -> int:
    return max(16, 6 * spark.sparkContext.defaultParallelism)


def harmonic_centrality(edges: DataFrame, sources: DataFrame, cutoff: float | None = None) -> DataFrame:
    """(node, value): mean inverse distance from all other nodes to each source; weights are lengths, a cutoff bounds paths."""
    ids, rows, cols, weights = _adjacency(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    kind, limit = _kind(weights), np.inf if cutoff is None else cutoff + 1e-12

    def values(starts: np.ndarray, into: Rows | None) -> np.ndarray:
        if kind == "hops":
            n = reached(into, starts)
            return sum((x / (h * weights[0]) for h, x in enumerate(n, 1) if h * weights[0] <= limit), np.zeros(len(starts)))
        d = path_lengths(into, starts, limit) if kind == "sums" else np.array([_paths(s, rows, cols, weights, cutoff)[1] for s in starts]).T
        return np.divide(1.0, d, out=np.zeros_like(d), where=np.isfinite(d) & (d > 0)).sum(0)

    def run(batches):
        into, width = None, 256 if kind == "hops" else _at_once(len(cols), len(ids))
        for b in batches:
            nodes = b.column(0).to_numpy()
            if into is None and kind != "other" and len(nodes):
                into = Rows(len(ids), cols, np.repeat(np.arange(len(ids)), np.diff(rows)), weights)
            at, out = np.searchsorted(ids, nodes), np.zeros(len(nodes))
            known = np.flatnonzero((at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == nodes)) if len(ids) else np.zeros(0, int)
            for k in range(0, len(known), width):
                own = known[k : k + width]
                out[own] = values(at[own], into) / max(len(ids) - 1, 1)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.float64())], ["node", "value"])

    return sources.select("node").repartition(_parts(edges.sparkSession)).mapInArrow(run, "node long, value double")


def betweenness_centrality(edges: DataFrame, targets: DataFrame, directed: bool = True, cutoff: float | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(node, value) of the target nodes: the shares of shortest paths between all pairs of nodes that pass them.

    Shares are propagated back from every node of the graph, also where few nodes are asked for.
    sources: some nodes (node) whose paths stand for all, scaled up; an
    estimate, by choice only.
    """
    ids, rows, cols, weights = _adjacency(edges)
    kind, limit = _kind(weights), np.inf if cutoff is None else cutoff + 1e-12
    spark = edges.sparkSession
    every = spark.createDataFrame(pa.table({"node": pa.array(ids, pa.int64())})) if sources is None else sources.select("node").distinct()
    scale = 1.0 if sources is None else len(ids) / max(every.count(), 1)

    def one(at: int) -> np.ndarray:
        order, _, count, back = _paths(at, rows, cols, weights, cutoff)
        share = np.zeros(len(ids))
        for u in reversed(order):
            for p in back[u]:
                share[p] += count[p] / count[u] * (1 + share[u])
        share[at] = 0
        return share

    def run(batches):
        total, into, out = np.zeros(len(ids)), None, None
        for b in batches:
            nodes = b.column(0).to_numpy()
            at = np.searchsorted(ids, nodes)
            at = at[(at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == nodes)] if len(ids) else at[:0]
            if into is None and kind != "other" and len(at):
                own = np.repeat(np.arange(len(ids)), np.diff(rows))
                given = weights if kind == "sums" else None
                into, out = Near(len(ids), cols, own, given), Near(len(ids), own, cols, given)
            for start in at:
                if kind == "hops":
                    total += hop_shares(into, out, start, np.floor(limit / weights[0]))
                elif kind == "sums":
                    total += path_shares(into, out, start, limit)
                else:
                    total += one(start)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total, pa.float64())], ["node", "value"])

    parts = every.repartition(_parts(spark)).mapInArrow(run, "node long, value double")
    found = parts.groupBy("node").agg((F.sum("value") * (scale if directed else scale / 2)).alias("value"))
    return targets.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("value", F.lit(0.0)).alias("value"))


@metric("kl")
def histogram_divergence(p: DataFrame, q: DataFrame, shared_bins: bool = False) -> DataFrame:
    """KL(P || Q) of (value) tables: equal numbers of bins, each over its own range (or both over one), densities clipped at 1e-10."""
    ends = {}
    for name, df in (("p", p), ("q", q)):
        ends[name] = df.agg(F.count("value").alias("n"), F.min("value").cast("double").alias("lo"), F.max("value").cast("double").alias("hi")).first()
    bins = min(ends["p"]["n"], ends["q"]["n"])
    if not bins:
        return p.sparkSession.createDataFrame([(None,)], "value double")

    span = min(e["lo"] for e in ends.values()), max(e["hi"] for e in ends.values())

    def counted(df, e):
        lo, hi = span if shared_bins and span[1] > span[0] else (e["lo"], e["hi"]) if e["hi"] > e["lo"] else (e["lo"] - 0.5, e["hi"] + 0.5)
        b = F.least(F.floor((F.col("value") - lo) / (hi - lo) * bins), F.lit(bins - 1))
        width = (hi - lo) / bins
        return df.where(F.col("value").isNotNull()).groupBy(b.alias("b")).agg((F.count("*") / (e["n"] * width)).alias("v"))

    a, b = counted(p, ends["p"]).withColumnRenamed("v", "x"), counted(q, ends["q"]).withColumnRenamed("v", "y")
    low = 1e-10
    both = a.join(b, "b", "full").select(F.greatest(F.coalesce("x", F.lit(0.0)), F.lit(low)).alias("x"), F.greatest(F.coalesce("y", F.lit(0.0)), F.lit(low)).alias("y"))
    s = both.agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.count("*").alias("n"), F.sum(F.col("x") * F.log("x")).alias("xlx"), F.sum(F.col("x") * F.log("y")).alias("xly"))
    # Bins that neither has are clipped on both sides, and count in the sums.
    rest = F.lit(float(bins)) - F.col("n")
    sx, sy = F.col("x") + rest * low, F.col("y") + rest * low
    clip = F.lit(float(np.log(low)))
    return s.select(((F.col("xlx") + rest * low * clip - F.col("xly") - rest * low * clip) / sx - F.log(sx) + F.log(sy)).alias("value"))


# Spectra.


def eigenvalues(edges: DataFrame, nodes: DataFrame, k: int, most: int = 4000, steps: int | None = None) -> DataFrame:
    """(rank, value): the k smallest eigenvalues of (M + M') / 2, in order.

    Up to ``most`` nodes the matrix is solved whole; beyond, one task finds the lowest values of
    the sparse matrix (``sparse.lowest_of``; ``steps`` bounds its steps). Beyond MOST_EDGES the
    products are joins, and blocks of vectors come to the driver. What doesn't converge raises.
    """
    spark, n, entries = edges.sparkSession, nodes.count(), edges.select("src", "dst", F.col("w").cast("double").alias("w"))
    if n <= most or entries.count() <= MOST_EDGES:

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            ids = np.unique(b["node"].to_numpy())
            i, j = (np.searchsorted(ids, a[c].to_numpy()) for c in ("src", "dst"))
            i, j, w = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(a["w"].to_numpy() / 2, 2)
            if len(ids) <= most:
                m = np.zeros((len(ids), len(ids)))
                np.add.at(m, (i, j), w)
                values = np.linalg.eigvalsh(m)[:k] if len(ids) else np.zeros(0)
            else:
                values = lowest_of(len(ids), i, j, w, k, steps)
            return pa.table({"rank": pa.array(np.arange(len(values)), pa.int64()), "value": pa.array(values, pa.float64())})

        one = F.lit(0).alias("g")
        found = entries.select("*", one).groupBy("g").cogroup(nodes.select("node", one).groupBy("g")).applyInArrow(run, "rank long, value double").collect()
        return spark.createDataFrame(found, "rank long, value double")
    ids = np.sort(nodes.select("node").toArrow()["node"].to_numpy())
    both = checkpoint(entries.select("src", "dst", (F.col("w") / 2).alias("w")).unionByName(entries.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("w") / 2).alias("w"))))

    def product(x: np.ndarray) -> np.ndarray:
        p = x.shape[1]
        v = spark.createDataFrame(pa.table({"dst": pa.array(ids, pa.int64())} | {f"x{c}": pa.array(x[:, c]) for c in range(p)}))
        t = both.join(v, "dst").groupBy("src").agg(*(F.sum(F.col("w") * F.col(f"x{c}")).alias(f"x{c}") for c in range(p))).toArrow()
        out, at = np.zeros((len(ids), p)), np.searchsorted(ids, t["src"].to_numpy())
        for c in range(p):
            out[at, c] = t[f"x{c}"].to_numpy()
        return out

    values = lowest(product, len(ids), k, steps=steps)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "rank long, value double")


@metric("dspectral")
def spectral_distance(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Euclidean distance of the first k of two spectra (rank, value), each sorted."""

    def first(df):
        own = df.where(F.col("rank") < k)
        return own.select((F.row_number().over(Window.orderBy("value")) - 1).alias("rank"), "value")  # k rows

    both = first(a).join(first(b).withColumnRenamed("value", "other"), "rank")
    return both.agg(F.sqrt(F.coalesce(F.sum((F.col("value") - F.col("other")) ** 2), F.lit(0.0))).alias("value"))


@metric("rel_eigval_e")
def relative_eigenvalue_error(big: DataFrame, small: DataFrame, k: int, eps: float = 1e-6) -> DataFrame:
    both = big.where(F.col("rank") < k).join(small.withColumnRenamed("value", "other"), "rank")
    return both.agg(F.avg(F.abs(F.col("value") - F.col("other")) / (F.abs("other") + eps)).alias("value"))


# Embeddings and clusters.


@metric("kNN-acc")
def knn_accuracy(points: DataFrame, embedding: DataFrame, k: int = 10) -> DataFrame:
    """The mean share of each point's k nearest that are near in the embedding too."""
    n = points.count()
    both = knn(points, k).select("src", "dst").join(knn(embedding, k).select("src", "dst"), ["src", "dst"])
    return both.agg((F.count("*") / F.lit(float(max(k * n, 1)))).alias("value"))


def _blocks(points: DataFrame, other: DataFrame, kernel, schema: str) -> DataFrame:
    """kernel(points, other) of every pair of blocks, as a task each; other's columns begin with other_."""
    n = -(-points.count() // BLOCK) or 1
    own = F.pmod(F.xxhash64("node"), F.lit(n)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = points.select(*[F.col(c).alias(c) for c in points.columns]).withColumn("a", own).withColumn("b", every)
    right = other.select(*[F.col(c).alias(f"other_{c}") for c in other.columns], own.alias("b2")).withColumn("a2", every)
    return left.groupBy("a", "b").cogroup(right.groupBy("a2", "b2")).applyInArrow(kernel, schema)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def distances(p: np.ndarray, q: np.ndarray, at_once: int = 1 << 22):
    """The distances of each row of p to all rows of q, row by row; computed by differences, some rows at once."""
    step = max(1, at_once // max(q.size, 1))
    for i in range(0, len(p), step):
        yield from np.sqrt(((p[i : i + step, None, :] - q[None, :, :]) ** 2).sum(2))


def _before(p: np.ndarray, q: np.ndarray, ids: np.ndarray, other: np.ndarray, owner: np.ndarray, who: np.ndarray, far: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
    """How many rows of q come before each mark: nearer to its owner (a row of p) than ``far``, or (nearly) as near and a smaller node; not the owner itself.

    Distances are compared roughly, by products, and by differences where the rough ones cannot tell.
    """
    out, norms, step = np.zeros(len(owner), np.int64), (q * q).sum(1), max(1, at_once // max(len(q), 1))
    first = np.searchsorted(owner, np.arange(len(p) + 1))
    most = np.diff(first).max() if len(p) else 0
    here = np.minimum(np.searchsorted(other, ids), len(other) - 1)
    here = np.where(other[here] == ids, here, -1)
    for i in range(0, len(p), step):
        own = p[i : i + step]
        mine = (own * own).sum(1)
        rough = own @ q.T
        rough *= -2
        rough += norms
        rough += mine[:, None]
        some = np.arange(len(own))
        held = here[i + some] >= 0
        rough[some[held], here[i + some[held]]] = np.inf
        size = mine + np.fmax.reduce(norms, initial=0.0)
        margin = 1e-9 * np.maximum(1.0, size) + 4e-12 * np.sqrt(size)
        for k in range(most):
            rows = some[first[i + some] + k < first[i + some + 1]]
            mark = first[i + rows] + k
            part = rough if len(rows) == len(own) else rough[rows]
            square = far[mark] ** 2
            sure = part < (square - margin[rows])[:, None]
            out[mark] += np.count_nonzero(sure, axis=1)
            r, c = np.nonzero((part <= (square + margin[rows])[:, None]) ^ sure)
            for a in range(0, len(r), 1 << 14):
                x, y = r[a : a + (1 << 14)], c[a : a + (1 << 14)]
                d, edge = np.sqrt(((own[rows[x]] - q[y]) ** 2).sum(1)), far[mark[x]]
                nearer = (d < edge - 1e-12) | ((d <= edge + 1e-12) & (other[y] < who[mark[x]]))
                out[mark] += np.bincount(x[nearer], minlength=len(rows))
    return out


@metric("trust")
def trustworthiness(points: DataFrame, embedding: DataFrame, k: int = 10) -> DataFrame:
    """1 less the scaled excess of the ranks, among all points, of those that are near in the embedding only."""
    n = points.count()
    k = min(k, n // 2)
    if k < 1:
        return points.sparkSession.createDataFrame([(None,)], "value double")
    if 2 * n - 3 * k - 1 <= 0:  # so few points that each is near every other
        return points.sparkSession.createDataFrame([(1.0,)], "value double")
    near = knn(embedding, k).groupBy("src").agg(F.collect_list("dst").alias("near"))  # k at most
    asked = points.join(near, points["node"] == near["src"]).select("node", "features", "near")
    lookup = points.select(F.col("node").alias("dst"), F.col("features").alias("f"))
    pairs = asked.select("node", "features", F.explode("near").alias("dst")).join(lookup, "dst")
    d2 = F.aggregate(F.zip_with("features", "f", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    marks = pairs.groupBy("node").agg(F.collect_list(F.struct("dst", F.sqrt(d2).alias("d"))).alias("marks"))
    asked = points.join(marks, "node").select("node", "features", "marks")

    def ranks(x: pa.Table, y: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        if x.num_rows and y.num_rows:
            y = y.sort_by("other_node")
            other, q, ids, p = y["other_node"].to_numpy(), _matrix(y["other_features"]), x["node"].to_numpy(), _matrix(x["features"])
            marks = x["marks"].combine_chunks()
            first, who, far = marks.offsets.to_numpy(), marks.values.field("dst").to_numpy(), marks.values.field("d").to_numpy()
            owner = np.repeat(np.arange(len(ids)), np.diff(first))
            out.append((ids[owner], who[first[0] : first[-1]], _before(p, q, ids, other, owner, who[first[0] : first[-1]], far[first[0] : first[-1]])))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("src", "dst", "before"), columns, strict=True)})

    rank = _blocks(asked, points.select("node", "features"), ranks, "src long, dst long, before long").groupBy("src", "dst").agg((F.sum("before") + 1).alias("rank"))
    excess = rank.agg(F.coalesce(F.sum(F.greatest(F.col("rank") - k, F.lit(0))), F.lit(0)).alias("e"))
    return excess.select((1 - F.col("e") * F.lit(2.0 / (n * k * (2 * n - 3 * k - 1)))).alias("value"))


@metric("dbi")
def davies_bouldin(points: DataFrame, labels: DataFrame) -> DataFrame:
    """The mean over clusters of the worst (S_i + S_j) / M_ij, over all pairs of clusters."""
    p = points.join(labels.select("node", F.col("label").alias("c")), "node")
    long = p.select("node", "c", F.posexplode("features").alias("i", "x"))
    centre = long.groupBy("c", "i").agg(F.avg("x").alias("m")).groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    apart = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    spread = p.join(centre, "c").groupBy("c").agg(F.avg(apart("features", "centre")).alias("s"))
    each = checkpoint(centre.join(spread, "c"))
    other = each.alias("b")
    pairs = each.alias("a").join(F.broadcast(other) if each.count() <= MOST_CLUSTERS else other, F.col("a.c") != F.col("b.c"))
    worst = pairs.groupBy("a.c").agg(F.max((F.col("a.s") + F.col("b.s")) / apart("a.centre", "b.centre")).alias("r"))
    return worst.agg(F.avg("r").alias("value"))


def silhouette_samples(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label, s) by Euclidean distances; a cluster of one has 0."""
    p = points.join(labels.select("node", F.col("label").cast("string").alias("label")), "node").select("node", "features", "label")

    def sums(x: pa.Table, y: pa.Table) -> pa.Table:
        ids, names, total = np.zeros(0, np.int64), np.zeros(0, object), np.zeros((0, 0))
        if x.num_rows and y.num_rows:
            names, code = np.unique(np.array(y["other_label"].to_pylist(), object), return_inverse=True)
            ids, one = x["node"].to_numpy(), np.eye(len(names))[code]
            total = np.array([d @ one for d in distances(_matrix(x["features"]), _matrix(y["other_features"]))])
        return pa.table({"node": pa.array(np.repeat(ids, len(names)), pa.int64()), "other": pa.array(np.tile(names, len(ids)), pa.string()), "s": pa.array(total.ravel(), pa.float64())})

    size = p.groupBy(F.col("label").alias("other")).agg(F.count("*").alias("n"))
    total = _blocks(p.select("node", "features"), p, sums, "node long, other string, s double").groupBy("node", "other").agg(F.sum("s").alias("s"))
    each = total.join(size, "other").join(p.select("node", "label"), "node")
    own = F.col("other") == F.col("label")
    a = F.max(F.when(own, F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1))))
    b = F.min(F.when(~own, F.col("s") / F.col("n")))
    return each.groupBy("node", "label").agg(a.alias("a"), b.alias("b")).select("node", "label", F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0)).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))).alias("s"))


@metric("silh")
def silhouette(points: DataFrame, labels: DataFrame) -> DataFrame:
    return silhouette_samples(points, labels).agg(F.avg("s").alias("value"))


def silhouette_clusters(points: DataFrame, labels: DataFrame) -> DataFrame:
    return silhouette_samples(points, labels).groupBy("label").agg(F.avg("s").alias("value"))


# Bundles, distributions and reports.


def embedding_metrics(points: DataFrame, embedding: DataFrame, labels: DataFrame, k: int = 10, **tags) -> DataFrame:
    xy = embedding.select("node", F.array("x", "y").alias("features"))
    return long_table({"kNN-acc": knn_accuracy(points, xy, k), "trust": trustworthiness(points, xy, k), "silh": silhouette(xy, labels), "dbi": davies_bouldin(xy, labels)}, **tags)


def spectral_metrics(big: DataFrame, big_nodes: DataFrame, small: DataFrame, small_nodes: DataFrame, k: int, values: DataFrame | None = None, **tags) -> DataFrame:
    """values: the big graph's eigenvalues (rank, value), where they are known."""
    a, b = eigenvalues(big, big_nodes, k) if values is None else values, eigenvalues(small, small_nodes, k)
    return long_table({"dspectral": spectral_distance(a, b, k), "rel_eigval_e": relative_eigenvalue_error(a, b, k)}, **tags)


def graph_metrics(big: DataFrame, small: DataFrame, k: int = 10_000, seed: int = 42, directed: bool = True, **tags) -> DataFrame:
    """Divergences of the centralities of two graphs, of at most k sampled nodes each."""
    from .connecting import nodes_of

    big, small = checkpoint(big), checkpoint(small)
    a, b = (checkpoint(sample_nodes(nodes_of(g), k, seed)) for g in (big, small))
    # A divergence reads its tables several times, which must not follow all paths again.
    return long_table({
        "closeness": histogram_divergence(checkpoint(harmonic_centrality(big, a)), checkpoint(harmonic_centrality(small, b))),
        "betweeness": histogram_divergence(checkpoint(betweenness_centrality(big, a, directed)), checkpoint(betweenness_centrality(small, b, directed))),
    }, **tags)


def label_distribution(levels: DataFrame, labels: DataFrame) -> DataFrame:
    """(level, label, n, share) of landmarks (level, node)."""
    n = levels.join(labels, "node").groupBy("level", "label").agg(F.count("*").alias("n"))
    total = n.groupBy("level").agg(F.sum("n").alias("t"))
    return n.join(total, "level").select("level", "label", "n", (F.col("n") / F.col("t")).alias("share"))


def label_spread(levels: DataFrame, labels: DataFrame) -> DataFrame:
    """(level, std) of the label counts of each level, over all labels that any level has (population std)."""
    n = label_distribution(levels, labels)
    every = n.select("level").distinct().crossJoin(F.broadcast(n.select("label").distinct()))  # levels x labels: a report's size
    full = every.join(n, ["level", "label"], "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))
    return full.groupBy("level").agg(F.stddev_pop("n").alias("std"))


def report(metrics: DataFrame) -> DataFrame:
    """(metric, max, mean, min, std) of a long table."""
    v = F.col("value")
    return metrics.groupBy("metric").agg(F.max(v).alias("max"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.stddev_samp(v).alias("std"))


def latex_rows(table: DataFrame, digits: int = 3) -> list[str]:
    """Rows of a LaTeX table from a report; its size is the number of metrics."""
    show = lambda x: "--" if x is None else f"{x:.{digits}f}"
    return [f"{r['metric']} & " + " & ".join(show(r[c]) for c in ("max", "mean", "min", "std")) + r" \\" for r in table.orderBy("metric").collect()]


# The frames behind figures.


def plot_points(embedding: DataFrame, labels: DataFrame) -> DataFrame:
    return embedding.join(labels, "node", "left").select("node", "x", "y", "label")


def plot_segments(edges: DataFrame, embedding: DataFrame, cutoff: float = 0.0) -> DataFrame:
    """(x1, y1, x2, y2, w) of the edges over a cutoff, each once."""
    a = embedding.select(F.col("node").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = embedding.select(F.col("node").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return undirected_edges(drop_loops(edges)).where(F.col("w") > cutoff).join(a, "src").join(b, "dst").select("x1", "y1", "x2", "y2", "w")


def radar(metrics: DataFrame) -> DataFrame:
    """Each metric's values scaled by its largest."""
    top = metrics.groupBy("metric").agg(F.max("value").alias("top"))
    return metrics.join(top, "metric").withColumn("value", F.col("value") / F.col("top")).drop("top")


def box_mean(points: DataFrame, embedding: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """(i, mean, median) of the features of points whose embedding lies in a box."""
    inside = embedding.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).select("node")
    long = points.join(inside, "node", "left_semi").select(F.posexplode("features").alias("i", "v"))
    return long.groupBy("i").agg(F.avg("v").alias("mean"), F.expr("percentile(v, 0.5)").alias("median"))
