"""Landmark connectors: coarse transition matrices between landmarks.

State-to-landmark connectors also give influence (state, lm, p) and the next level's weights.
Landmarks are (node); coarse edges are (src, dst, w) between landmark nodes of the parent level.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import key, uniform
from ..functions.session import checkpoint
from .graph import drop_loops, gram, normalise, sparsify, strong_components, walk_table, weak_components
from .sparse import Rows, Slabs, components, potentials, settled

CONNECTORS: dict[str, Callable] = {}
MAX_STEPS = 1000
#: Rows of a state's walk table in a stretch: a walker meets about so many, also on a hub.
WIDE = 64


@dataclass(frozen=True)
class Connecting:
    """What a level is connected with."""

    name: str = "EXACT"
    k: int = 10
    n_walks: int = 100
    seed: int = 42
    use_distances: bool = False
    contain_self: bool = True
    threshold_i: float = 0.0
    threshold_t: float = 0.0
    tolerance: float = 1e-9
    max_steps: int = MAX_STEPS
    solver: str = "best"  # of EXACT: "direct", "iterative", or direct up to MOST_DIRECT states
    use_gambler: bool = True  # of EXACT: gambler's ruin, or the linear system of the unknown rows; they agree
    max_nodes: int | None = None  # of the BFS connectors: nodes that a search takes from its queue at most
    weight_order: str = "asc"  # of CON: of the edges that claim a node, the lightest wins, or "desc"

    def with_(self, **changes) -> Connecting:
        return replace(self, **changes)

    def connect(self, graph: DataFrame, landmarks: DataFrame, weights: DataFrame | None = None) -> Coarse:
        return CONNECTORS[self.name](self, graph, landmarks, weights)


@dataclass(frozen=True)
class Coarse:
    """A connector's result; weights and influence are None for landmark-to-landmark connectors."""

    transition: DataFrame
    landmarks: DataFrame
    influence: DataFrame | None = None
    weights: DataFrame | None = None
    adjacency: DataFrame | None = None  # counts before scaling, where the connector counts edges


def connector(name: str):
    """Registers a strategy f(Connecting, graph, landmarks, weights) -> Coarse."""

    def put(f):
        CONNECTORS[name] = f
        return f

    return put


# Breadth-first search.


def hops(edges: DataFrame, starts: DataFrame, landmarks: DataFrame, k: int, max_hops: int = MAX_STEPS, max_nodes: int | None = None) -> DataFrame:
    """(state, lm, h): each start's k hop-nearest landmarks other than itself, ties to the smaller one.

    All starts search together; a start stops once it has k, or nothing new is reached, or with
    max_nodes once it has taken so many nodes from its queue, its own first, nearer and then
    smaller ones before others.
    """
    out_edges = drop_loops(edges).select("src", "dst").distinct()
    seen = front = starts.select(F.col("node").alias("state"), "node")
    found = None
    if max_nodes is not None and max_nodes <= 1:
        return starts.select(F.col("node").alias("state"), F.col("node").alias("lm"), F.lit(0).alias("h")).limit(0)
    for h in range(1, max_hops + 1):
        front = front.join(out_edges, front["node"] == out_edges["src"]).select("state", F.col("dst").alias("node")).distinct()
        front = front.join(seen, ["state", "node"], "left_anti")
        if max_nodes is not None:
            place = F.row_number().over(Window.partitionBy("state").orderBy("node"))
            count = seen.groupBy("state").agg(F.count("*").alias("__had"))
            front = front.withColumn("__place", place).join(count, "state").where(F.col("__had") + F.col("__place") <= max_nodes).select("state", "node")
        front = checkpoint(front)
        hit = front.join(landmarks, "node", "left_semi").select("state", F.col("node").alias("lm"), F.lit(h).alias("h"))
        found = checkpoint(hit if found is None else found.unionByName(hit))
        enough = found.groupBy("state").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        front = front.join(enough, "state", "left_anti")
        if not front.limit(1).count():
            break
        seen = checkpoint(seen.unionByName(front))
    rank = F.row_number().over(Window.partitionBy("state").orderBy("h", "lm"))
    return found.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def _influence_to_coarse(c: Connecting, influence: DataFrame, landmarks: DataFrame, weights: DataFrame | None, prune: bool = True) -> Coarse:
    """T = norm(I' diag(W) I); with ``prune`` landmarks that nothing leads to are dropped everywhere."""
    influence = checkpoint(influence)
    t = normalise(gram(influence, weights))
    if c.threshold_t > 0:
        t = normalise(sparsify(t, c.threshold_t))
    t = checkpoint(t)
    if not prune:
        return Coarse(t, landmarks, influence, next_weights(influence, weights))
    alive = t.select(F.col("src").alias("node")).distinct()
    kept = influence.join(alive, influence["lm"] == alive["node"], "left_semi")
    return Coarse(t, landmarks.join(alive, "node", "left_semi"), kept, next_weights(kept, weights))


def next_weights(influence: DataFrame, weights: DataFrame | None) -> DataFrame:
    """(state, w) of the next level: W I; without weights each state counts 1."""
    w = influence if weights is None else influence.join(weights, "state").withColumn("p", F.col("p") * F.col("w"))
    return w.groupBy(F.col("lm").alias("state")).agg(F.sum("p").alias("w"))


def hop_influence(edges: DataFrame, nodes: DataFrame, landmarks: DataFrame, k: int, max_nodes: int | None = None) -> DataFrame:
    """(state, lm, p): equal shares of each state's k nearest landmarks."""
    near = checkpoint(hops(edges, nodes, landmarks, k, max_nodes=max_nodes))
    n = near.groupBy("state").agg(F.count("*").alias("n"))
    return near.join(n, "state").select("state", "lm", (F.lit(1.0) / F.col("n")).alias("p"))


@connector("SL-BFS")
def state_bfs(c: Connecting, graph: DataFrame, landmarks: DataFrame, weights: DataFrame | None) -> Coarse:
    return _influence_to_coarse(c, hop_influence(graph, nodes_of(graph), landmarks, c.k, c.max_nodes), landmarks, weights)


@connector("LL-BFS")
def landmark_bfs(c: Connecting, graph: DataFrame, landmarks: DataFrame, weights: DataFrame | None) -> Coarse:
    near = checkpoint(hops(graph, landmarks, landmarks, c.k, max_nodes=c.max_nodes))
    if c.use_distances:
        far = near.agg(F.max("h")).first()[0] or 0
        w = (F.lit(far + 1) - F.col("h")).cast("double")
    else:
        w = F.lit(1.0)
    return Coarse(normalise(near.select(F.col("state").alias("src"), F.col("lm").alias("dst"), w.alias("w"))), landmarks)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


# Random walks.


def _stretched(table: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The walk table by stretches of [0, 1), and the states of several (__s, __parts), or None.

    A walker is compared with the rows of its draw's stretch alone: with all rows of a hub, the
    walkers there would cost the square of its edges.
    """
    wide = checkpoint(table.groupBy(F.col("src").alias("__s")).agg(F.ceil(F.count("*") / WIDE).alias("__parts")).where("__parts > 1"))
    if not wide.limit(1).count():
        return table, None
    rows = table.join(wide, table["src"] == wide["__s"], "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    last = F.col("__parts") - 1
    at = F.sequence(F.least(F.floor(F.col("lo") * F.col("__parts")), last), F.least(F.floor(F.col("hi") * F.col("__parts")), last))
    return checkpoint(rows.withColumn("stretch", F.explode(at)).select("src", "stretch", "dst", "lo", "hi")), wide


def walks(table: DataFrame, starts: DataFrame, n_walks: int, stops: DataFrame, seed: int, max_steps: int = MAX_STEPS, allow_start: bool = True, cut: int = 8) -> DataFrame:
    """(state, walk, node, steps) of walks that reach a stop; each takes a step at least.

    starts: (node[, own]); stops: (node[, own]). With ``own``, a walk stops where own differs from
    its start's. All walks step together by a range lookup in the walk table, ``cut`` steps a job;
    a walk that meets a dead end or takes more than max_steps is dropped.
    """
    by_cluster = "own" in starts.columns
    own = ["own"] if by_cluster else []
    ends = stops.select(F.col("node").alias("__n"), *([F.col("own").alias("__own")] if by_cluster else [F.lit(True).alias("__own")]))
    table, wide = _stretched(table)
    table = table.withColumnsRenamed({"src": "__src", "dst": "__dst"})
    on = starts.select(F.col("node").alias("state"), "node", *own, F.explode(F.sequence(F.lit(0), F.lit(n_walks - 1))).alias("walk"))
    done = None
    for first in range(1, max_steps + 1, cut):
        now = on.withColumn("steps", F.lit(None).cast("int"))  # null while a walk goes on
        for step in range(first, min(first + cut, max_steps + 1)):
            goes = F.col("steps").isNull()
            now = now.withColumn("__u", F.when(goes, uniform(seed, F.col("state"), F.col("walk"), F.lit(step))))
            meets = (F.col("node") == F.col("__src")) & (F.col("__u") >= F.col("lo")) & (F.col("__u") < F.col("hi"))
            if wide is not None:
                now = now.join(wide, F.col("node") == F.col("__s"), "left").withColumn("__at", F.floor(F.col("__u") * F.coalesce("__parts", F.lit(1)))).drop("__s", "__parts")
                meets &= F.col("__at") == F.col("stretch")
            now = now.join(table, meets, "left").where(~goes | F.col("__dst").isNotNull()).withColumn("node", F.when(goes, F.col("__dst")).otherwise(F.col("node")))
            now = now.join(ends, goes & (F.col("node") == F.col("__n")), "left")
            if by_cluster:
                stop = F.col("__own").isNotNull() & (F.col("__own") != F.col("own"))
            else:
                stop = F.col("__own").isNotNull() & (F.lit(allow_start) | (F.col("node") != F.col("state")))
            now = now.select("state", "walk", "node", *own, F.when(goes & stop, F.lit(step)).otherwise(F.col("steps")).alias("steps"))
        now = checkpoint(now)
        over = now.where(F.col("steps").isNotNull()).select("state", "walk", "node", "steps")
        done = over if done is None else done.unionByName(over)
        on = now.where(F.col("steps").isNull()).drop("steps")
        if (first // cut) % cut == cut - 1:
            done = checkpoint(done)
        if not on.limit(1).count():
            break
    return done


def walk_shares(found: DataFrame) -> DataFrame:
    """(src, dst, w): how many walks of each start ended where."""
    return found.groupBy(F.col("state").alias("src"), F.col("node").alias("dst")).agg(F.count("*").cast("double").alias("w"))


@connector("LL-RW")
def landmark_walks(c: Connecting, graph: DataFrame, landmarks: DataFrame, weights: DataFrame | None) -> Coarse:
    found = walks(checkpoint(walk_table(graph)), landmarks, c.n_walks, landmarks, c.seed, c.max_steps, allow_start=False)
    return Coarse(normalise(walk_shares(found)), landmarks)


@connector("SL-RW")
def state_walks(c: Connecting, graph: DataFrame, landmarks: DataFrame, weights: DataFrame | None) -> Coarse:
    found = walks(checkpoint(walk_table(graph)), nodes_of(graph), c.n_walks, landmarks, c.seed, c.max_steps, allow_start=c.contain_self)
    i = normalise(walk_shares(found)).select(F.col("src").alias("state"), F.col("dst").alias("lm"), F.col("w").alias("p"))
    return _influence_to_coarse(c, i, landmarks, weights)


# Absorption.


#: States of a system that one task solves; their matrix is square.
MOST_DIRECT = 3000
#: Entries of a system that every task has a copy of, and numbers of a task's columns.
MOST_COPIED, MOST_COLUMNS = 5_000_000, 3_000_000


def absorption(transition: DataFrame, landmarks: DataFrame, steps: int = MAX_STEPS, tolerance: float = 1e-9, cut: int = 5, solver: str = "best") -> DataFrame:
    """(state, lm, p): where walks are absorbed; landmarks absorb themselves.

    Gambler's ruin reads the rows as absorption, the linear system of the unknown rows gives the
    same ones. Up to MOST_DIRECT states that reach a landmark one task solves (I - T_UU) X = T_UL.
    Beyond, X <- T_UU X + T_UL is iterated until in no state more than ``tolerance`` of the walks
    is still under way, which bounds the error of every entry; after ``steps`` rounds without
    that it raises. Up to MOST_COPIED entries each task has the system and some landmarks'
    columns; beyond, a round is a join. States that reach no landmark have no row.
    """
    return _absorbed(transition, landmarks, steps, tolerance, cut, solver)[0]


def _absorbed(transition: DataFrame, landmarks: DataFrame, steps: int, tolerance: float, cut: int = 5, solver: str = "best") -> tuple[DataFrame, _System | None]:
    """The same, and the system where tasks solve it by blocks of landmarks."""
    if solver not in ("best", "direct", "iterative"):
        raise ValueError("solver is best, direct or iterative")
    t = checkpoint(transition.join(landmarks.select(F.col("node").alias("src")), "src", "left_anti"))
    own = landmarks.select(F.col("node").alias("state"), F.col("node").alias("lm"), F.lit(1.0).alias("p"))
    into = t.join(landmarks.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("state"), F.col("dst").alias("lm"), F.col("w").alias("p")).where("p != 0")
    inner = t.join(landmarks.select(F.col("node").alias("dst")), "dst", "left_anti").where("w != 0")
    reach = checkpoint(_reaching(inner, into.select(F.col("state").alias("node")).distinct()))
    inner = inner.join(reach.select(F.col("node").alias("src")), "src", "left_semi").join(reach.select(F.col("node").alias("dst")), "dst", "left_semi")
    inner, into = checkpoint(inner.select("src", "dst", "w")), checkpoint(into)
    states = reach.count()
    if solver == "direct" and states > MOST_DIRECT:
        raise ValueError(f"{states} states: a direct solution takes {MOST_DIRECT} at most")
    if solver == "direct" or (solver == "best" and states <= MOST_DIRECT):
        return _solved(inner, into).unionByName(own), None
    if inner.count() + into.count() <= MOST_COPIED:
        system = _System(inner, into, steps, tolerance)
        return _iterated(system, inner.sparkSession).unionByName(own), system
    x, going = into, reach.select("node", F.lit(1.0).alias("u"))
    for step in range(1, steps):
        spread = inner.join(x, inner["dst"] == x["state"]).select(F.col("src").alias("state"), "lm", (F.col("w") * F.col("p")).alias("p"))
        x = spread.unionByName(into).groupBy("state", "lm").agg(F.sum("p").alias("p"))
        going = inner.join(going, inner["dst"] == going["node"]).groupBy(F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("u")).alias("u"))
        if step % cut == 0:
            x, going = checkpoint(x), checkpoint(going)
            if (going.agg(F.max("u")).first()[0] or 0.0) <= tolerance:
                return x.unionByName(own), None
    if (going.agg(F.max("u")).first()[0] or 0.0) <= tolerance:
        return x.unionByName(own), None
    raise RuntimeError(f"absorption has not converged to {tolerance} in {steps} rounds")


def _reaching(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(node) of the ends and of all that leads to them."""
    done = front = checkpoint(ends)
    back = checkpoint(edges.select("src", "dst").distinct())
    while True:
        front = back.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct()
        front = checkpoint(front.join(done, "node", "left_anti"))
        if not front.limit(1).count():
            return done
        done = checkpoint(done.unionByName(front))


def _solved(inner: DataFrame, into: DataFrame) -> DataFrame:
    """(state, lm, p) of (I - T_UU) X = T_UL, where every state reaches a landmark; in one task, on a checked size."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        ids = np.unique(np.concatenate([a["src"].to_numpy(), a["dst"].to_numpy(), b["state"].to_numpy()]))
        marks, to = np.unique(b["lm"].to_numpy(), return_inverse=True)
        m, right = np.eye(len(ids)), np.zeros((len(ids), len(marks)))
        np.subtract.at(m, (np.searchsorted(ids, a["src"].to_numpy()), np.searchsorted(ids, a["dst"].to_numpy())), a["w"].to_numpy())
        np.add.at(right, (np.searchsorted(ids, b["state"].to_numpy()), to), b["p"].to_numpy())
        x = np.linalg.solve(m, right) if len(ids) else right
        i, j = np.nonzero(x > 0)
        return pa.table({"state": pa.array(ids[i], pa.int64()), "lm": pa.array(marks[j], pa.int64()), "p": pa.array(x[i, j], pa.float64())})

    one = F.lit(0).alias("g")
    return inner.select("src", "dst", "w", one).groupBy("g").cogroup(into.select("state", "lm", "p", one).groupBy("g")).applyInArrow(run, "state long, lm long, p double")


class _System:
    """The unknown rows of a transition matrix, for tasks that each solve for some landmarks.

    Where the matrix is similar to a symmetric one (an undirected graph), Chebyshev steps settle the system
    until the residual times the most steps that a walk takes on average, over all landmarks, is within the tolerance;
    else as many plain rounds as leave no more than the tolerance of any state's walks under way.
    """

    def __init__(self, inner: DataFrame, into: DataFrame, steps: int, tolerance: float):
        a, b = inner.select("src", "dst", "w").toArrow(), into.select("state", "lm", "p").toArrow()
        self.ids = np.unique(np.concatenate([a["src"].to_numpy(), a["dst"].to_numpy(), b["state"].to_numpy()]))
        self.marks, to = np.unique(b["lm"].to_numpy(), return_inverse=True)
        self.i, self.j, self.w = np.searchsorted(self.ids, a["src"].to_numpy()), np.searchsorted(self.ids, a["dst"].to_numpy()), a["w"].to_numpy()
        order, n = np.argsort(to, kind="stable"), len(self.ids)
        self.state, self.to, self.p = np.searchsorted(self.ids, b["state"].to_numpy())[order], to[order], b["p"].to_numpy()[order]
        t, going, taken, rounds, self.radius = Rows(n, self.i, self.j, self.w), np.ones((n, 1)), np.zeros((n, 1)), 0, 0.5
        while n and going.max() > tolerance:
            if rounds == steps:
                raise RuntimeError(f"absorption has not converged to {tolerance} in {steps} rounds")
            taken += going
            new = t.of(going)
            going, rounds, self.radius = new, rounds + 1, new.max() / going.max()
        self.tolerance, self.rounds, left = tolerance, rounds, going.max() if n else 0.0
        self.longest = taken.max() / (1 - left) if n and left < 0.5 else 0.0
        even = len(self.w) and tolerance > 1e-14 * self.longest > 0 and self.w.min() > 0 and len(np.unique(self.i * n + self.j)) == len(self.i)
        self.d = potentials(n, self.i, self.j, self.w) if even else None
        self.radius = float(np.clip(1 - 0.99 * (1 - self.radius), 0.05, 1 - 1e-6))
        self.part = components(n, self.i, self.j) if self.d is not None else None
        cores = inner.sparkSession.sparkContext.defaultParallelism
        self.width = max(1, min(MOST_COLUMNS // max(n, 1), -(-len(self.marks) // (4 * cores))))
        self.blocks = -(-len(self.marks) // self.width)

    def matrix(self) -> Slabs:
        return Slabs(len(self.ids), self.i, self.j, self.w, self.width)

    def own(self, block: int) -> tuple[int, int, slice]:
        """(first landmark, last one, their entries) of a block."""
        first, last = block * self.width, min(len(self.marks), (block + 1) * self.width)
        return first, last, slice(*np.searchsorted(self.to, [first, last]))

    def solve(self, m: Slabs, block: int) -> np.ndarray:
        """Columns of the block's landmarks; rows in the matrix's order."""
        first, last, own = self.own(block)
        right = np.zeros((m.n, last - first))
        np.add.at(right, (m.rank[self.state[own]], self.to[own] - first), self.p[own])
        if self.d is not None:
            # Of a state, all landmarks' errors together are within the tolerance; 4e-15 is what double precision can tell.
            most = max(self.tolerance / (self.longest * len(self.marks)), 4e-15)
            return settled(m, right, self.radius, lambda r: max(float(r.max()), -float(r.min())) / most)
        return self.plain(m, right)

    def plain(self, m: Slabs, right: np.ndarray) -> np.ndarray:
        x, out = right.copy(), np.empty_like(right)
        for _ in range(self.rounds):
            m.of(x, out)
            out += right
            x, out = out, x
        return x

    def reach(self, states: np.ndarray) -> np.ndarray:
        """Of an undirected system, the states in the components of these."""
        met = np.zeros(len(self.ids), bool)
        met[self.part[states]] = True
        return met[self.part]


def _iterated(system: _System, spark) -> DataFrame:
    """(state, lm, p) of the unknown rows, a block of landmarks a task."""

    def run(batches):
        m = None
        for batch in batches:
            for block in batch.column(0).to_pylist():
                m = m or system.matrix()
                first, last, own = system.own(block)
                x = system.solve(m, block)
                for c in range(last - first):
                    p = x[m.rank, c]
                    if system.d is None:
                        at = np.flatnonzero(p > 0)
                    else:  # what rounding leaves of next to nothing stays over 0
                        at = np.flatnonzero(system.reach(system.state[own][system.to[own] == first + c]))
                        p = np.maximum(p, 1e-300)
                    yield pa.RecordBatch.from_arrays([pa.array(system.ids[at], pa.int64()), pa.array(np.full(len(at), system.marks[first + c]), pa.int64()), pa.array(p[at], pa.float64())], ["state", "lm", "p"])

    return spark.range(0, system.blocks, 1, max(1, system.blocks)).mapInArrow(run, "state long, lm long, p double")


def _coarse_rows(system: _System, landmarks: DataFrame) -> DataFrame:
    """norm(I' I) without I: a task solves for some landmarks, then back for the states' shares of them, and has whole rows.

    With X = (I - T)^-1 B of the unknown rows, X' X is B' (I - T')^-1 X; landmarks add 1 on the diagonal.
    """
    spark = landmarks.sparkSession

    def run(batches):
        m = back = None
        for batch in batches:
            for block in batch.column(0).to_pylist():
                m = m or system.matrix()
                first, last, own = system.own(block)
                x = system.solve(m, block)
                if system.d is not None:
                    d = system.d[m.order][:, None]
                    total = np.abs(x).sum(0)
                    x /= d
                    y = settled(m, x, system.radius, lambda r: max(float((d[:, 0] @ np.abs(r[:, c : c + 1]))[0] / t) for c, t in enumerate(total)) / system.tolerance)
                    y = (y * d)[m.rank]
                else:
                    back = back or Slabs(m.n, system.j, system.i, system.w, system.width)
                    y = system.plain(back, x[m.rank][back.order])[back.rank]
                for c in range(last - first):
                    w = np.bincount(system.to, system.p * y[system.state, c], len(system.marks))
                    if system.d is None:
                        at = w > 0
                    else:
                        at = np.zeros(len(w), bool)
                        at[system.to[system.reach(system.state[own][system.to[own] == first + c])[system.state]]] = True
                        w = np.where(at, np.maximum(w, 1e-300), 0.0)
                    at[first + c] = True
                    w[first + c] += 1
                    at, w = np.flatnonzero(at), w / w.sum()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), system.marks[first + c]), pa.int64()), pa.array(system.marks[at], pa.int64()), pa.array(w[at], pa.float64())], ["src", "dst", "w"])

    alone = landmarks.select("node").join(spark.createDataFrame(pa.table({"node": pa.array(system.marks, pa.int64())})), "node", "left_anti")
    found = spark.range(0, system.blocks, 1, max(1, system.blocks)).mapInArrow(run, "src long, dst long, w double")
    return found.unionByName(alone.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w")))


@connector("EXACT")
def exact(c: Connecting, graph: DataFrame, landmarks: DataFrame, weights: DataFrame | None) -> Coarse:
    i, system = _absorbed(normalise(graph), landmarks, c.max_steps, c.tolerance, solver=c.solver)
    if system is not None and weights is None and c.threshold_i <= 0:
        # The influence can have so many rows that it is not kept, but computed where it is asked for.
        t = _coarse_rows(system, landmarks)
        return Coarse(normalise(sparsify(t, c.threshold_t)) if c.threshold_t > 0 else t, landmarks, i, next_weights(i, None))
    if c.threshold_i > 0:
        i = i.where(F.col("p") >= c.threshold_i)
    return _influence_to_coarse(c, i, landmarks, weights, prune=False)


# Clusters.


def connectivity(edges: DataFrame, clusters: DataFrame, mode: str = "all") -> DataFrame:
    """(src, dst, w): edges between different clusters (node, cluster), counted outward or both ways."""
    a = clusters.select(F.col("node").alias("src"), F.col("cluster").alias("a"))
    b = clusters.select(F.col("node").alias("dst"), F.col("cluster").alias("b"))
    pairs = drop_loops(edges).join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    if mode == "all":
        pairs = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def grow_clusters(edges: DataFrame, seeds: DataFrame, seed: int, mode: str = "all", order: str = "asc") -> DataFrame:
    """(node, cluster): clusters grow from seeds along edges, in both directions or outward, a hop a round.

    Of the edges that claim a node in a round the lightest wins (or the heaviest), of equal ones
    the least key of round and cluster. Nodes that no seed reaches stay out.
    """
    near = drop_loops(edges).select("src", "dst", "w")
    near = near.unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")) if mode == "all" else near
    best = F.min("w") if order == "asc" else F.max("w")
    near = checkpoint(near.groupBy("src", "dst").agg((best if order == "asc" else -best).alias("w")))
    done = front = seeds.select("node", F.col("node").alias("cluster")) if "cluster" not in seeds.columns else seeds.select("node", "cluster")
    step = 0
    while True:
        step += 1
        claims = near.join(front, near["src"] == front["node"]).select(F.col("dst").alias("node"), "cluster", "w")
        claims = claims.join(done, "node", "left_anti").groupBy("node", "cluster").agg(F.min("w").alias("w")).withColumn("h", key(seed, F.lit(step), F.col("cluster")))
        front = checkpoint(claims.groupBy("node").agg(F.min_by("cluster", F.struct("w", "h", "cluster")).alias("cluster")))
        if not front.limit(1).count():
            return done
        done = checkpoint(done.unionByName(front))


def cover_clusters(edges: DataFrame, marks: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(node, cluster) of all nodes, and the landmarks: clusters grow outward; what they don't reach is
    reached in both directions, and each component that is left gets its least node as a landmark."""
    own = grow_clusters(edges, marks, seed, mode="out")
    every = nodes_of(edges)
    if not every.join(own, "node", "left_anti").limit(1).count():
        return own, marks
    own = grow_clusters(edges, own, seed, mode="all")
    left = checkpoint(every.join(own, "node", "left_anti"))
    inside = edges.select("src", "dst", "w").join(left.select(F.col("node").alias("src")), "src", "left_semi")
    parts = checkpoint(weak_components(inside.select("src", "dst"), left).select("node", F.col("component").alias("cluster")))
    return checkpoint(own.unionByName(parts)), marks.unionByName(parts.select(F.col("cluster").alias("node")).distinct())


def covered(edges: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Landmarks, and the least node of each strong component without one."""
    every = nodes_of(edges).union(landmarks.select("node")).distinct()
    parts = strong_components(edges, every)
    have = parts.join(landmarks, "node", "left_semi").select("component").distinct()
    extra = parts.join(have, "component", "left_anti").groupBy("component").agg(F.min("node").alias("node")).select("node")
    return landmarks.select("node").union(extra)


@connector("CON")
def cluster_connectivity(c: Connecting, graph: DataFrame, landmarks: DataFrame, weights: DataFrame | None) -> Coarse:
    marks = checkpoint(covered(graph, landmarks))
    counts = checkpoint(connectivity(graph, grow_clusters(graph, marks, c.seed, order=c.weight_order)))
    return Coarse(normalise(counts), marks, adjacency=counts)


@connector("CLUSTERRW")
def cluster_walks(c: Connecting, graph: DataFrame, landmarks: DataFrame, weights: DataFrame | None) -> Coarse:
    own, marks = cover_clusters(graph, checkpoint(landmarks.select("node")), c.seed)
    own = own.withColumnRenamed("cluster", "own")
    found = walks(checkpoint(walk_table(graph)), own, c.n_walks, own, c.seed, c.max_steps)
    a = own.select(F.col("node").alias("state"), F.col("own").alias("src"))
    b = own.select("node", F.col("own").alias("dst"))
    counts = found.join(a, "state").join(b, "node").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    return Coarse(normalise(counts), marks)


def pick_members(clusters: DataFrame, seed: int) -> DataFrame:
    """(cluster, node): one seeded member of each cluster."""
    return clusters.groupBy("cluster").agg(F.min_by("node", F.struct(key(seed, F.col("node")), "node")).alias("node"))


def pick_columns(c: DataFrame, rows: DataFrame, seed: int) -> DataFrame:
    """(row, node): one seeded non-zero column of each row of the coarsening matrix; an empty row raises."""
    full = c.where(F.col("w") != 0)
    if rows.join(full.select(F.col("src").alias("row")), "row", "left_anti").limit(1).count():
        raise ValueError("a row of the coarsening matrix is empty")
    return full.groupBy(F.col("src").alias("row")).agg(F.min_by("dst", F.struct(key(seed, F.col("src"), F.col("dst")), "dst")).alias("node"))
