"""Graphs as edge tables (src, dst, w): construction and matrix algebra.

points: (node long, features array<double>); edges may repeat nowhere; a missing edge is a zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import key
from ..functions.session import checkpoint

BLOCK = 4096
#: Stretches of the node numbers that a row's walk table is summed by.
STRETCHES = 64
#: States and landmarks of a dense block of a gram matrix; mean landmarks a state from which blocks are met.
GRAM_STATES, GRAM_MARKS, GRAM_DENSE = 1024, 2048, 64


def _rows(column) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _nearest_kernel(k: int):
    """f(points, others) -> (src, dst, d): the k nearest others of each point, ties to the smaller node."""

    def near(x: pa.Table, y: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
        if x.num_rows and y.num_rows:
            y = y.sort_by("other")
            ids, other, p, q = x["node"].to_numpy(), y["other"].to_numpy(), _rows(x["features"]), _rows(y["f"])
            norms, take = (q * q).sum(1), min(len(other), k + 9)  # some to spare, for the rough distances' rounding and the point itself
            for i in range(0, len(ids), 512):
                who, mine = ids[i : i + 512], p[i : i + 512]
                rough = norms[None, :] - 2 * mine @ q.T
                edge = np.partition(rough, take - 1, 1)[:, take - 1]
                r, c = np.nonzero(rough <= (edge + 1e-9 * np.maximum(1.0, np.abs(edge)))[:, None])
                keep = other[c] != who[r]
                r, c = r[keep], c[keep]
                d = ((q[c] - mine[r]) ** 2).sum(1)
                order = np.lexsort((other[c], d, r))
                r, c, d = r[order], c[order], d[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                best = place < k
                out.append((who[r[best]], other[c[best]], np.sqrt(d[best])))
        src, dst, d = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "d": pa.array(d, pa.float64())})

    return near


def _best(met: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("src", "dst", "d")


def knn(points: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(src, dst, d): the k nearest other points by Euclidean distance, ties to the smaller node.

    Points are dealt into blocks, and each pair of blocks is one task that keeps k rows a point;
    so memory is bounded by two blocks, and only k rows a point and block are ranked again. There
    are at least as many pairs as cores. All pairs are compared: see ``knn_near`` for many points.
    """
    rows = points.count()
    cores = points.sparkSession.sparkContext.defaultParallelism
    n = max(-(-rows // block), min(int(np.ceil(cores**0.5)), -(-rows // 256))) or 1
    own = F.pmod(F.xxhash64("node"), F.lit(n)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = points.select(F.col("node").alias("node"), F.col("features").alias("features"), own.alias("a")).withColumn("b", every)
    right = points.select(F.col("node").alias("other"), F.col("features").alias("f"), own.alias("b2")).withColumn("a2", every)
    left, right = left.repartition(n * n, "a", "b"), right.repartition(n * n, "a2", "b2")  # small rows would be packed into one task
    return _best(left.groupBy("a", "b").cogroup(right.groupBy("a2", "b2")).applyInArrow(_nearest_kernel(k), "src long, dst long, d double"), k)


def knn_near(points: DataFrame, k: int = 10, probes: int = 8, cell: int = 1024, seed: int = 42, most: int = 4096) -> DataFrame:
    """(src, dst, d): nearest points found in the cells around each point, instead of among all points.

    Cells belong to pivots, points of smallest seeded keys, one for ``cell`` points (``most`` at
    most). A point lies in its nearest pivot's cell and meets the cells of its ``probes`` nearest
    pivots; a cell of many points is dealt to several tasks. The cost is that of probes cells a
    point; recall depends on the data (tests measure it), and all points are in the result.
    """
    rows = points.count()
    n = int(min(most, max(1, rows // cell)))
    if n <= probes:
        return knn(points, k)
    pivots = np.array([r["features"] for r in points.orderBy(key(seed, F.col("node")), "node").limit(n).select("features").collect()], float)
    norms = (pivots * pivots).sum(1)

    def cells(batches):
        for b in batches:
            if b.num_rows:
                rough = norms[None, :] - 2 * _rows(pa.chunked_array([b.column(1)])) @ pivots.T
                order = np.argsort(rough, 1, kind="stable")[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(order.tolist(), pa.list_(pa.int32()))], ["node", "features", "cells"])

    placed = checkpoint(points.select(F.col("node").cast("long"), F.col("features").cast("array<double>")).mapInArrow(cells, "node long, features array<double>, cells array<int>"))
    parts = placed.groupBy(F.col("cells")[0].alias("c")).agg(F.ceil(F.count("*") / (4 * cell)).cast("int").alias("parts"))  # a row a pivot
    right = placed.select(F.col("node").alias("other"), F.col("features").alias("f"), F.col("cells")[0].alias("c")).join(F.broadcast(parts), "c")
    right = right.select("other", "f", F.col("c").alias("c2"), F.pmod(F.xxhash64("other"), F.col("parts")).cast("int").alias("part2"))
    left = placed.select("node", "features", F.explode("cells").alias("c")).join(F.broadcast(parts), "c").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return _best(left.groupBy("c", "part").cogroup(right.groupBy("c2", "part2")).applyInArrow(_nearest_kernel(k), "src long, dst long, d double"), k)


def knn_graph(points: DataFrame, k: int = 10, directed: bool = True) -> DataFrame:
    edges = knn(points, k).select("src", "dst", F.lit(1.0).alias("w"))
    return edges if directed else symmetrise(edges)


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def symmetrise(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, with weight 1."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    return both.distinct().withColumn("w", F.lit(1.0))


def symmetrise_max(edges: DataFrame) -> DataFrame:
    """Both directions, with the larger weight."""
    return edges.select("src", "dst", "w").unionByName(reverse(edges)).groupBy("src", "dst").agg(F.max("w").alias("w"))


def _scaled(edges: DataFrame, total) -> DataFrame:
    sums = edges.groupBy("src").agg(total.alias("__t"))
    return edges.join(sums, "src").where(F.col("__t") != 0).select("src", "dst", (F.col("w") / F.col("__t")).alias("w"))


def normalise(edges: DataFrame) -> DataFrame:
    """Rows scaled to sum of absolute values 1; zero rows stay away. Sums are pre-aggregated, so hubs don't meet in one task."""
    return _scaled(edges, F.sum(F.abs("w")))


def normalise_l2(edges: DataFrame) -> DataFrame:
    return _scaled(edges, F.sqrt(F.sum(F.col("w") * F.col("w"))))


def drop_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") != F.col("dst"))


def graph(edges: DataFrame, directed: bool = True, weighted: bool = False) -> DataFrame:
    """Edges without loops, symmetric if undirected; weights scaled to row length 1, or all 1."""
    edges = drop_loops(edges)
    edges = edges if directed else symmetrise_max(edges)
    return normalise_l2(edges) if weighted else edges.withColumn("w", F.lit(1.0))


def undirected_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") < F.col("dst"))


def walk_table(edges: DataFrame, uniform_weights: bool = False, close: bool = False) -> DataFrame:
    """(src, dst, lo, hi): each row's distribution as bounds, by dst; ``close`` sets the last bound to 1.

    Rows are summed by stretches of the node numbers first, so a hub's edges are no single task's.
    """
    edges = drop_loops(edges)
    t = checkpoint(normalise(edges.withColumn("w", F.lit(1.0)) if uniform_weights else edges))
    low, high = t.agg(F.min("dst"), F.max("dst")).first()
    if low is None:
        return t.select("src", "dst", F.col("w").alias("lo"), F.col("w").alias("hi"))
    width = (high - low) // STRETCHES + 1
    t = t.withColumn("__s", F.floor((F.col("dst") - low) / width).cast("int"))
    sums = t.groupBy("src", "__s").agg(F.sum("w").alias("__w"))
    by = Window.partitionBy("src").orderBy("__s")
    ahead = sums.select("src", "__s", F.coalesce(F.lag("__w").over(by), F.lit(0.0)).alias("__b"), F.lead("__s").over(by).isNull().alias("__end"))
    ahead = ahead.select("src", "__s", F.sum("__b").over(by).alias("__before"), "__end")
    inside = Window.partitionBy("src", "__s").orderBy("dst")
    out = t.join(ahead, ["src", "__s"]).withColumn("__sum", F.sum("w").over(inside))
    hi, lo = F.col("__before") + F.col("__sum"), F.col("__before") + F.coalesce(F.lag("__sum").over(inside), F.lit(0.0))
    if close:
        hi = F.when(F.col("__end") & F.lead("dst").over(inside).isNull(), F.lit(1.0)).otherwise(hi)
    return out.select("src", "dst", lo.alias("lo"), hi.alias("hi"))


def laplacian(edges: DataFrame) -> DataFrame:
    """D - A: row sums on the diagonal."""
    a = edges.select("src", "dst", (-F.col("w")).alias("w"))
    d = edges.groupBy("src").agg(F.sum("w").alias("w")).select("src", F.col("src").alias("dst"), "w")
    return a.unionByName(d).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def walk_laplacian(transition: DataFrame, nodes: DataFrame) -> DataFrame:
    """I - T over all nodes (node)."""
    one = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w"))
    return transition.select("src", "dst", (-F.col("w")).alias("w")).unionByName(one).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def in_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree): column sums; 0 without an edge."""
    d = edges.groupBy("dst").agg(F.sum("w").alias("degree"))
    return nodes.join(d, nodes["node"] == d["dst"], "left").select("node", F.coalesce("degree", F.lit(0.0)).alias("degree"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sparse matrix product of edge tables."""
    b = b.select(F.col("src").alias("__k"), F.col("dst").alias("__j"), F.col("w").alias("__v"))
    return a.join(b, a["dst"] == b["__k"]).groupBy("src", "__j").agg(F.sum(F.col("w") * F.col("__v")).alias("w")).withColumnRenamed("__j", "dst")


def vector_product(vector: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, w) of the row vector (node, w) times the matrix."""
    v = vector.select(F.col("node").alias("src"), F.col("w").alias("__v"))
    return edges.join(v, "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col("__v")).alias("w"))


def gram(influence: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """I' diag(W) I of (state, lm, p), as edges between landmarks; a missing W is ones.

    Where a state has so many landmarks (a tenth of all, and GRAM_DENSE on average) that their pairs
    would be too many rows, blocks of states and landmarks are multiplied as matrices, and summed.
    """
    left = influence if weights is None else influence.join(weights, "state").withColumn("p", F.col("p") * F.col("w")).drop("w")
    rows, states, marks = influence.agg(F.count("*"), F.count_distinct("state"), F.count_distinct("lm")).first()
    if rows >= GRAM_DENSE * states and 10 * rows >= states * marks:
        return _gram_by_blocks(left, influence, states, marks)
    right = influence.select("state", F.col("lm").alias("dst"), F.col("p").alias("q"))
    return left.join(right, "state").groupBy(F.col("lm").alias("src"), "dst").agg(F.sum(F.col("p") * F.col("q")).alias("w"))


def _gram_by_blocks(left: DataFrame, right: DataFrame, states: int, marks: int) -> DataFrame:
    """Sums of the products of blocks: of GRAM_STATES states and two times GRAM_MARKS landmarks, about."""
    parts, blocks = -(-states // GRAM_STATES), -(-marks // GRAM_MARKS)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    part, block = F.pmod(F.xxhash64("state"), F.lit(parts)).cast("int"), F.pmod(F.xxhash64("lm"), F.lit(blocks)).cast("int")
    a = left.select("state", "lm", "p", part.alias("s"), block.alias("a")).withColumn("b", every)
    b = right.select(F.col("state").alias("other_state"), F.col("lm").alias("other_lm"), F.col("p").alias("other_p"), part.alias("s2"), block.alias("b2")).withColumn("a2", every)
    a, b = a.repartition(parts * blocks * blocks, "s", "a", "b"), b.repartition(parts * blocks * blocks, "s2", "a2", "b2")

    def dense(x: pa.Table, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, at = np.unique(x["lm"].to_numpy(), return_inverse=True)
        out = np.zeros((len(ids), len(own)))
        np.add.at(out, (np.searchsorted(ids, x["state"].to_numpy()), at), x["p"].to_numpy())
        return own, out

    def met(x: pa.Table, y: pa.Table) -> pa.Table:
        y = y.rename_columns([c.removeprefix("other_") for c in y.column_names])
        ids = np.intersect1d(x["state"].to_numpy(), y["state"].to_numpy())
        (src, p), (dst, q) = (dense(z.filter(pc.is_in(z["state"], pa.array(ids))), ids) for z in (x, y))
        w, some = p.T @ q, (p != 0).astype(np.float32).T @ (q != 0).astype(np.float32)
        i, j = np.nonzero(some)
        return pa.table({"src": pa.array(src[i], pa.int64()), "dst": pa.array(dst[j], pa.int64()), "w": pa.array(w[i, j], pa.float64())})

    return a.groupBy("s", "a", "b").cogroup(b.groupBy("s2", "a2", "b2")).applyInArrow(met, "src long, dst long, w double").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def sparsify(edges: DataFrame, threshold: float) -> DataFrame:
    return edges.where(F.col("w") >= threshold)


def top_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """Each row's k largest weights; of equal weights the later columns stay."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), F.desc("dst")))
    return edges.withColumn("__r", rank).where(F.col("__r") <= k).drop("__r")


def weak_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the least node that is linked in any direction; least labels travel and jump."""
    both = checkpoint(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    label = nodes.select("node", F.col("node").alias("c"))
    while True:
        near = both.join(label, both["dst"] == label["node"]).groupBy("src").agg(F.min("c").alias("m"))
        new = label.join(near, label["node"] == near["src"], "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("old"))
        jump = new.select(F.col("node").alias("k"), F.col("c").alias("j"))
        new = checkpoint(new.join(jump, new["c"] == jump["k"]).select("node", "old", F.least("c", "j").alias("c")))
        if not new.where(F.col("c") != F.col("old")).limit(1).count():
            return new.select("node", F.col("c").alias("component"))
        label = new.select("node", "c")


def _spread(edges: DataFrame, start: DataFrame, inside: DataFrame) -> DataFrame:
    """(node, c) with the least c of (node, c) starts that reach it along edges, among ``inside`` (node, group) of equal groups."""
    label = start
    kept = checkpoint(edges.join(inside.select(F.col("node").alias("src"), F.col("g").alias("g1")), "src").join(inside.select(F.col("node").alias("dst"), F.col("g").alias("g2")), "dst").where("g1 = g2").select("src", "dst"))
    while True:
        near = kept.join(label, kept["src"] == label["node"]).groupBy("dst").agg(F.min("c").alias("m"))
        new = checkpoint(label.join(near, label["node"] == near["dst"], "left").select("node", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c")))
        if not new.where(F.col("c") != F.col("old")).limit(1).count():
            return new.select("node", "c")
        label = new.select("node", "c")


def _strong(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's strong component): two depth-first passes, without recursion."""
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    n, half = len(ids), len(src)

    def rows(a, b):
        order = np.argsort(a, kind="stable")
        return np.searchsorted(a[order], np.arange(n + 1)), b[order]

    def visit(start, seen, first, cols, out):
        stack = [(start, first[start])]
        seen[start] = True
        while stack:
            v, e = stack.pop()
            while e < first[v + 1] and seen[cols[e]]:
                e += 1
            if e < first[v + 1]:
                stack += [(v, e + 1), (u := cols[e], first[u])]
                seen[u] = True
            else:
                out.append(v)

    done: list[int] = []
    out, seen = rows(at[:half], at[half:]), np.zeros(n, bool)
    for v in range(n):
        if not seen[v]:
            visit(v, seen, *out, done)
    back, label, seen = rows(at[half:], at[:half]), np.zeros(n, np.int64), np.zeros(n, bool)
    for v in reversed(done):
        if not seen[v]:
            group: list[int] = []
            visit(v, seen, *back, group)
            label[group] = min(group)
    return ids, ids[label]


def strong_components(edges: DataFrame, nodes: DataFrame, small: int = 1_000_000) -> DataFrame:
    """(node, component): the least node that is reached both ways.

    Up to ``small`` edges, counted first, one task does it. Beyond, rounds of colouring: the least
    node that reaches a node colours it; what reaches back to the colour's owner inside the colour
    is its component, and the rest goes on.
    """
    if edges.count() <= small:

        def whole(t: pa.Table) -> pa.Table:
            ids, label = _strong(t["src"].to_numpy(), t["dst"].to_numpy())
            return pa.table({"node": pa.array(ids, pa.int64()), "component": pa.array(label, pa.int64())})

        found = edges.select("src", "dst", F.lit(0).alias("g")).groupBy("g").applyInArrow(whole, "node long, component long")
        return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    left, done = nodes.select("node", F.lit(0).cast("long").alias("g")), None
    while True:
        colour = _spread(edges, left.select("node", F.col("node").alias("c")), left)
        owner = colour.withColumnRenamed("c", "g")
        far = F.lit((1 << 63) - 1)
        back = _spread(reverse(edges.withColumn("w", F.lit(1.0))).select("src", "dst"), owner.select("node", F.when(F.col("node") == F.col("g"), F.col("g")).otherwise(far).alias("c")), owner)
        found = back.where(F.col("c") != far).select("node", F.col("c").alias("component"))
        done = checkpoint(found if done is None else done.unionByName(found))
        left = checkpoint(owner.join(done, "node", "left_anti"))
        if not left.limit(1).count():
            return done


def submatrix(edges: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Edges whose src is in rows (node) and whose dst is in columns (node)."""
    out = edges.join(rows.select(F.col("node").alias("src")), "src", "left_semi")
    return out.join(columns.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "w")


def perplexity_graph(neighbours: DataFrame, perplexity: float) -> DataFrame:
    """Gaussian weights of (src, dst, d), with each row's bandwidth found by bisection to the given perplexity."""

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("dst")
        d2 = t["d"].to_numpy() ** 2
        lo, hi = 0.0, np.inf
        beta = 1.0
        for _ in range(100):
            p = np.exp(-(d2 - d2.min()) * beta)
            p /= p.sum()
            gap = -(p * np.log(np.maximum(p, 1e-300))).sum() - np.log(min(perplexity, len(d2)))
            if abs(gap) < 1e-4:
                break
            lo, hi = (beta, hi) if gap > 0 else (lo, beta)
            beta = beta * 2 if hi == np.inf else (lo + hi) / 2
        return pa.table({"src": t["src"], "dst": t["dst"], "w": pa.array(p)})

    return neighbours.select("src", "dst", "d").groupBy("src").applyInArrow(fit, "src long, dst long, w double")
