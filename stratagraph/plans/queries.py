"""Registered queries over the test tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as feats
from ..functions.hashing import sql_uniform
from ..functions.session import checkpoint, numbered, table
from ..operators import communities as X
from ..operators import connecting as C
from ..operators import embedding as E
from ..operators import experiments as EX
from ..operators import graph as G
from ..operators import hierarchy as H
from ..operators import metrics as M
from ..operators import sampling as S
from ..sources import datasets as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
K, SEED = 10, 42


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def tidy(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles rounded (and without a negative zero), so that both engines write them alike."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(F.col(n), digits) + F.lit(0.0)).alias(n) if kinds[n] == "double" else F.col(n) for n in names or df.columns])


def tidy_shares(df: DataFrame, name: str, digits: int = 6) -> DataFrame:
    """The same for a column between 0 and 1 of very many rows: by arithmetic, as rounding by decimals takes longer than writing the rows."""
    return df.withColumn(name, F.floor(F.col(name) * 10.0**digits + 0.5) / 10.0**digits)


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("features"), F.col("label"))


def knn(spark, sf, k=K):
    return G.knn(points(spark, sf).select("node", "features"), k)


def und(spark, sf):
    return checkpoint(G.symmetrise(knn(spark, sf)))


def weighted(spark, sf):
    return knn(spark, sf).select("src", "dst", (1 / (1 + F.col("d"))).alias("w"))


def supply(spark, sf):
    """Supplier to part group, by quantity."""
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 200).alias("dst"), "l_quantity")
    return rows.groupBy("src", "dst").agg(F.sum("l_quantity").alias("w"))


def nodes(spark, sf):
    return points(spark, sf).select("node")


def random_landmarks(spark, sf, share=0.1):
    return S.Sampling("RANDOM", share, SEED).sample(None, nodes(spark, sf))


# SQL building blocks.
PTS = "pts AS (SELECT vec_id AS node, embedding::DOUBLE[] AS f, label FROM embeddings)"


def sql_knn(name="knn", k=K, of="pts", f="f"):
    return f"{name} AS (SELECT src, dst, d FROM (SELECT a.node AS src, b.node AS dst, list_distance(a.{f}, b.{f}) AS d, row_number() OVER (PARTITION BY a.node ORDER BY list_distance(a.{f}, b.{f}), b.node) AS r FROM {of} a JOIN {of} b ON a.node <> b.node) WHERE r <= {k})"


KNN = f"{PTS}, {sql_knn()}"
UND = f"{KNN}, und AS (SELECT src, dst, 1.0::DOUBLE AS w FROM knn UNION SELECT dst, src, 1.0::DOUBLE FROM knn)"
TRANS = f"{UND}, t AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM und)"
WK = f"{KNN}, wk AS (SELECT src, dst, 1 / (1 + d) AS w FROM knn)"
SUPPLY = "sp AS (SELECT l_suppkey AS src, l_partkey % 200 AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY ALL)"
DEGREE = f"{TRANS}, deg AS (SELECT p.node, coalesce(sum(t.w), 0) AS degree FROM pts p LEFT JOIN t ON t.dst = p.node GROUP BY p.node)"


def sql_random(share=0.1, name="lm", of="pts"):
    return f"{name} AS (SELECT node FROM {of} ORDER BY md5('{SEED}:' || node), node LIMIT (SELECT floor({share} * count(*))::BIGINT FROM {of}))"


def w(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


R = lambda c, a=None: f"round({c}, 6) + 0.0 AS {a or c}"

# Graphs.


@query(w(KNN) + f"SELECT src, dst, {R('d')} FROM knn")
def g1_knn(spark, sf):
    return tidy(knn(spark, sf))


@query(w(UND) + "SELECT src, dst, w FROM und")
def g2_symmetrise(spark, sf):
    return G.symmetrise(knn(spark, sf))


@query(w(WK) + f"SELECT src, dst, {R('max(w)', 'w')} FROM (SELECT * FROM wk UNION ALL SELECT dst, src, w FROM wk) GROUP BY src, dst")
def g3_symmetrise_max(spark, sf):
    return tidy(G.symmetrise_max(weighted(spark, sf)))


@query(w(WK) + f"SELECT src, dst, {R('w / sum(w) OVER (PARTITION BY src)', 'w')} FROM wk")
def g4_normalise(spark, sf):
    return tidy(G.normalise(weighted(spark, sf)))


@query(w(SUPPLY) + "SELECT src, dst, w FROM sp WHERE src <> dst")
def g5_drop_loops(spark, sf):
    return G.drop_loops(supply(spark, sf))


@query(w(SUPPLY) + f", s AS (SELECT src, dst, max(w) AS w FROM (SELECT * FROM sp UNION ALL SELECT dst, src, w FROM sp) WHERE src <> dst GROUP BY src, dst) SELECT src, dst, {R('w / sqrt(sum(w * w) OVER (PARTITION BY src))', 'w')} FROM s")
def g6_weighted_graph(spark, sf):
    return tidy(G.graph(supply(spark, sf), directed=False, weighted=True))


@query(w(UND) + "SELECT src, dst, w FROM und WHERE src < dst")
def g7_undirected_edges(spark, sf):
    return G.undirected_edges(G.symmetrise(knn(spark, sf)))


def _sql_table(of: str, weight: str, last: str) -> str:
    return f", n AS (SELECT src, dst, {weight} AS w FROM {of} WHERE src <> dst), c AS (SELECT src, dst, sum(w) OVER (PARTITION BY src ORDER BY dst) AS hi, lead(dst) OVER (PARTITION BY src ORDER BY dst) AS nxt FROM n) SELECT src, dst, {R('coalesce(lag(hi) OVER (PARTITION BY src ORDER BY dst), 0)', 'lo')}, {R(last, 'hi')} FROM c"


@query(w(WK) + _sql_table("wk", "w / sum(w) OVER (PARTITION BY src)", "hi"))
def g8_walk_table(spark, sf):
    return tidy(G.walk_table(weighted(spark, sf)))


@query(w(WK) + _sql_table("wk", "1.0::DOUBLE / count(*) OVER (PARTITION BY src)", "CASE WHEN nxt IS NULL THEN 1.0 ELSE hi END"))
def g9_uniform_walk_table(spark, sf):
    return tidy(G.walk_table(weighted(spark, sf), uniform_weights=True, close=True))


@query(w(UND) + "SELECT src, dst, -w AS w FROM und UNION ALL SELECT src, src, sum(w) FROM und GROUP BY src")
def g10_laplacian(spark, sf):
    return G.laplacian(G.symmetrise(knn(spark, sf)))


@query(w(TRANS) + f"SELECT src, dst, {R('-w', 'w')} FROM t UNION ALL SELECT node, node, 1.0 FROM pts")
def g11_walk_laplacian(spark, sf):
    return tidy(G.walk_laplacian(G.normalise(G.symmetrise(knn(spark, sf))), nodes(spark, sf)))


@query(w(DEGREE) + f"SELECT node, {R('degree')} FROM deg")
def g12_in_degree(spark, sf):
    return tidy(G.in_degree(G.normalise(G.symmetrise(knn(spark, sf))), nodes(spark, sf)))


@query(w(TRANS) + f"SELECT a.src, b.dst, {R('sum(a.w * b.w)', 'w')} FROM t a JOIN t b ON a.dst = b.src GROUP BY a.src, b.dst")
def g13_product(spark, sf):
    t = checkpoint(G.normalise(und(spark, sf)))
    return tidy(G.product(t, t))


@query(w(TRANS) + f"SELECT dst AS node, {R('sum(w * (dst * 0 + src % 7))', 'w')} FROM t GROUP BY dst")
def g13_vector_product(spark, sf):
    v = nodes(spark, sf).select("node", (F.col("node") % 7).cast("double").alias("w"))
    return tidy(G.vector_product(v, G.normalise(G.symmetrise(knn(spark, sf)))))


@query(w(TRANS) + f"SELECT src, dst, {R('w')} FROM t WHERE w >= 0.08")
def g14_sparsify(spark, sf):
    return tidy(G.sparsify(G.normalise(G.symmetrise(knn(spark, sf))), 0.08))


@query(w(SUPPLY) + "SELECT src, dst, w FROM sp QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst DESC) <= 3")
def g15_top_neighbours(spark, sf):
    return G.top_neighbours(supply(spark, sf), 3)


_REACH = ", reach(a, b) AS (SELECT node, node FROM pts UNION SELECT a, dst FROM reach JOIN e ON e.src = b)"


@query(w(PTS, sql_knn("k1", 1)) + ", e AS (SELECT src, dst FROM k1 UNION SELECT dst, src FROM k1)" + _REACH + " SELECT b AS node, min(a) AS component FROM reach GROUP BY b")
def g16_weak_components(spark, sf):
    return G.weak_components(knn(spark, sf, 1), nodes(spark, sf))


@query(w(PTS, sql_knn("e", 2)) + _REACH + " SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def g16_strong_components(spark, sf):
    return G.strong_components(checkpoint(knn(spark, sf, 2).withColumn("w", F.lit(1.0))), nodes(spark, sf))


@query(w(PTS, sql_random()) + "SELECT node, node IN (SELECT node FROM lm) AS is_landmark FROM pts")
def g17_is_landmark(spark, sf):
    lm = random_landmarks(spark, sf).withColumn("hit", F.lit(True))
    return nodes(spark, sf).join(lm, "node", "left").select("node", F.coalesce("hit", F.lit(False)).alias("is_landmark"))


@query(w(TRANS, sql_random()) + f"SELECT src, dst, {R('w')} FROM t WHERE src NOT IN (SELECT node FROM lm) AND dst IN (SELECT node FROM lm)")
def g18_submatrix(spark, sf):
    lm = checkpoint(random_landmarks(spark, sf))
    return tidy(G.submatrix(G.normalise(und(spark, sf)), S.delete_landmarks(nodes(spark, sf), lm), lm))


_FIT = (
    ", g AS (SELECT src, dst, d * d - min(d * d) OVER (PARTITION BY src) AS e FROM near), "
    "fit(src, step, beta, lo, hi, gap) AS (SELECT DISTINCT src, 0, 1.0::DOUBLE, 0.0::DOUBLE, 'inf'::DOUBLE, NULL::DOUBLE FROM g UNION ALL "
    "SELECT src, step + 1, CASE WHEN abs(gap) < 1e-4 THEN beta WHEN (CASE WHEN gap > 0 THEN hi ELSE beta END) = 'inf'::DOUBLE THEN beta * 2 ELSE ((CASE WHEN gap > 0 THEN beta ELSE lo END) + (CASE WHEN gap > 0 THEN hi ELSE beta END)) / 2 END, "
    "CASE WHEN gap > 0 THEN beta ELSE lo END, CASE WHEN gap > 0 THEN hi ELSE beta END, gap FROM ("
    "SELECT f.src, f.step, f.beta, f.lo, f.hi, ln(sum(exp(-e * beta))) + beta * sum(e * exp(-e * beta)) / sum(exp(-e * beta)) - ln(10.0) AS gap FROM fit f JOIN g USING (src) WHERE f.step < 100 AND coalesce(abs(f.gap), 1) >= 1e-4 GROUP BY f.src, f.step, f.beta, f.lo, f.hi)), "
    "best AS (SELECT src, arg_max(beta, step) AS beta FROM fit GROUP BY src)"
)


@query(w(PTS, sql_knn("near", 30)) + _FIT + f" SELECT src, dst, {R('exp(-e * beta) / sum(exp(-e * beta)) OVER (PARTITION BY src)', 'w')} FROM g JOIN best USING (src)")
def g19_perplexity_graph(spark, sf):
    return tidy(G.perplexity_graph(knn(spark, sf, 30), 10.0))


@query()
def g1_knn_near(spark, sf):
    """Nearest points among cells of pivots: what g1_knn finds among all, mostly; tests measure the share."""
    return tidy(G.knn_near(points(spark, sf).select("node", "features"), K, probes=4, cell=64))


# Samplers.


@query(w(PTS, sql_random()) + "SELECT node FROM lm")
def l1_random(spark, sf):
    return random_landmarks(spark, sf)


@query(w(DEGREE) + "SELECT node FROM deg ORDER BY round(degree, 9) DESC, node LIMIT (SELECT floor(0.1 * count(*))::BIGINT FROM pts)")
def l2_hubs(spark, sf):
    return S.Sampling("HUBS").sample(G.normalise(und(spark, sf)), nodes(spark, sf))


def sql_pi(steps: int) -> str:
    out = ", ".join(["p0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM pts) AS w FROM pts)"] + [f"p{k} AS (SELECT dst AS node, sum(p.w * t.w) AS w FROM p{k - 1} p JOIN t ON t.src = p.node GROUP BY dst)" for k in range(1, steps + 1)])
    return out + f", pi AS MATERIALIZED (SELECT node, w / sum(w) OVER () AS w FROM p{steps})"


@query(w(TRANS, sql_pi(50)) + f"SELECT node, {R('w')} FROM pi")
def l3_walk_distribution(spark, sf):
    return tidy(S.walk_distribution(checkpoint(G.normalise(und(spark, sf))), nodes(spark, sf), 50))


_VISITS = f", spans AS (SELECT node, sum(w) OVER (ORDER BY node % 256, node) AS hi, w FROM pi), draws AS (SELECT {sql_uniform(f"'{SEED}:' || i")} AS u FROM range((SELECT count(*) * 100 FROM pts)) x(i)), visits AS (SELECT node, count(*) AS visits FROM draws JOIN spans ON u >= hi - w AND u < hi GROUP BY node)"


@query(w(TRANS, sql_pi(50)) + _VISITS + " SELECT node FROM visits ORDER BY visits DESC, node LIMIT (SELECT floor(0.1 * count(*))::BIGINT FROM pts)")
def l3_random_walks(spark, sf):
    return S.Sampling("RW").sample(checkpoint(G.normalise(und(spark, sf))), nodes(spark, sf))


def _sql_greedy(order: str, base: str) -> str:
    return w(base) + (
        f", top AS (SELECT src, list(dst) AS l FROM (SELECT src, dst FROM t WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst DESC) <= 3) GROUP BY src), ord AS ({order}), "
        "loop(r, taken, gone) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL "
        "SELECT o.r, CASE WHEN list_contains(gone, o.node) THEN taken ELSE list_append(taken, o.node) END, CASE WHEN list_contains(gone, o.node) THEN gone ELSE list_concat(gone, coalesce(top.l, [])) END "
        "FROM loop JOIN ord o ON o.r = loop.r + 1 LEFT JOIN top ON top.src = o.node WHERE len(taken) < (SELECT floor(0.1 * count(*)) FROM pts)) "
        "SELECT unnest(taken) AS node FROM (SELECT taken FROM loop ORDER BY r DESC LIMIT 1)"
    )


@query(_sql_greedy("SELECT node, row_number() OVER (ORDER BY round(degree, 9), node) AS r FROM deg", DEGREE))
def l4_hubs_apart(spark, sf):
    return S.Sampling("HUBSNN", k=3).sample(checkpoint(G.normalise(und(spark, sf))), nodes(spark, sf))


@query(_sql_greedy("SELECT node, row_number() OVER (ORDER BY -round(degree, 9), node) AS r FROM deg", DEGREE))
def l4_hubs_apart_largest_first(spark, sf):
    return S.Sampling("HUBSNN", k=3, order="desc").sample(checkpoint(G.normalise(und(spark, sf))), nodes(spark, sf))


@query(_sql_greedy(f"SELECT node, row_number() OVER (ORDER BY md5('{SEED}:' || node), node) AS r FROM pts", TRANS))
def l5_random_apart(spark, sf):
    return S.Sampling("RANDOMNN", k=3).sample(checkpoint(G.normalise(und(spark, sf))), nodes(spark, sf))


@query(w(PTS, sql_random()) + ", kept AS (SELECT node FROM lm WHERE node % 3 <> 0 UNION SELECT node FROM pts WHERE node < 5) SELECT 1 AS level, row_number() OVER (ORDER BY node) - 1 AS lm_idx, node AS parent_idx FROM kept")
def l6_maintain_landmarks(spark, sf):
    lm = random_landmarks(spark, sf)
    kept = S.delete_landmarks(lm, nodes(spark, sf).where("node % 3 = 0"))
    return S.indexed(S.add_landmarks(kept, nodes(spark, sf).where("node < 5")), 1)


# Connectors.


def sql_hops(starts: str, k: int, deep: int = 4) -> str:
    return (
        f", bfs(state, node, h) AS (SELECT node, node, 0 FROM {starts} UNION SELECT state, dst, h + 1 FROM bfs JOIN und ON src = bfs.node WHERE src <> dst AND h < {deep}), "
        f"first AS (SELECT state, node, min(h) AS h FROM bfs GROUP BY state, node), near AS (SELECT state, node AS lm, h FROM first WHERE node IN (SELECT node FROM lm) AND node <> state QUALIFY row_number() OVER (PARTITION BY state ORDER BY h, node) <= {k})"
    )


_GRAM = ", gram AS (SELECT a.lm AS src, b.lm AS dst, sum(a.p * b.p) AS w FROM infl a JOIN infl b ON a.state = b.state GROUP BY a.lm, b.lm), tc AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM gram)"


@query(w(UND, sql_random()) + sql_hops("lm", 5) + " SELECT state, lm, h FROM near")
def c1_hops(spark, sf):
    lm = checkpoint(random_landmarks(spark, sf))
    return C.hops(und(spark, sf), lm, lm, 5)


_SLBFS = w(UND, sql_random()) + sql_hops("pts", 3) + ", infl AS (SELECT state, lm, 1.0::DOUBLE / count(*) OVER (PARTITION BY state) AS p FROM near)" + _GRAM


@query(_SLBFS + f" SELECT src, dst, {R('w')} FROM tc")
def c2_state_bfs(spark, sf):
    return tidy(C.Connecting("SL-BFS", k=3).connect(und(spark, sf), checkpoint(random_landmarks(spark, sf))).transition)


@query(_SLBFS + f" SELECT lm AS state, {R('sum(p)', 'w')} FROM infl GROUP BY lm")
def c2_next_weights(spark, sf):
    return tidy(C.Connecting("SL-BFS", k=3).connect(und(spark, sf), checkpoint(random_landmarks(spark, sf))).weights)


@query(w(UND, sql_random()) + sql_hops("lm", 5) + f", v AS (SELECT state AS src, lm AS dst, (max(h) OVER () + 1 - h)::DOUBLE AS w FROM near) SELECT src, dst, {R('w / sum(w) OVER (PARTITION BY src)', 'w')} FROM v")
def c3_landmark_bfs(spark, sf):
    return tidy(C.Connecting("LL-BFS", k=5, use_distances=True).connect(und(spark, sf), checkpoint(random_landmarks(spark, sf))).transition)


_TABLE = ", wt AS (SELECT src, dst, sum(w) OVER (PARTITION BY src ORDER BY dst) AS hi, sum(w) OVER (PARTITION BY src ORDER BY dst) - w AS lo FROM t), wtab AS (SELECT src, dst, hi, coalesce(lag(hi) OVER (PARTITION BY src ORDER BY dst), 0) AS lo FROM wt)"


def sql_walks(starts: str, n: int, stop: str, deep: int = 1000, own: str = "0", own_from: str = "") -> str:
    u = sql_uniform(f"'{SEED}:' || x.state || ':' || x.walk || ':' || (x.steps + 1)")
    return _TABLE + (
        f", walk(state, walk, node, steps, own, stop) AS (SELECT s.node, i, s.node, 0, {own}, false FROM {starts} s, range({n}) r(i) UNION ALL "
        f"SELECT x.state, x.walk, wtab.dst, x.steps + 1, x.own, {stop} FROM (SELECT *, {u} AS u FROM walk x WHERE NOT stop AND steps < {deep}) x JOIN wtab ON wtab.src = x.node AND x.u >= wtab.lo AND x.u < wtab.hi{own_from}), "
        "ended AS (SELECT state, walk, node, steps FROM walk WHERE stop)"
    )


_IN_LM = "wtab.dst IN (SELECT node FROM lm)"


@query(w(TRANS, sql_random(0.2)) + sql_walks("lm", 100, _IN_LM + " AND wtab.dst <> x.state") + " SELECT state, walk, node, steps FROM ended")
def c5_walks(spark, sf):
    lm, c = checkpoint(random_landmarks(spark, sf, 0.2)), C.Connecting()
    out = C.walks(checkpoint(G.walk_table(und(spark, sf))), lm, c.n_walks, lm, SEED, c.max_steps, allow_start=False)
    return out.select("state", F.col("walk").cast("long").alias("walk"), "node", "steps")


@query(w(TRANS, sql_random(0.2)) + sql_walks("lm", 100, _IN_LM + " AND wtab.dst <> x.state") + f" SELECT state AS src, node AS dst, round(count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY state), 9) + 0.0 AS w FROM ended GROUP BY state, node")
def c6_landmark_walks(spark, sf):
    return tidy(C.Connecting("LL-RW").connect(und(spark, sf), checkpoint(random_landmarks(spark, sf, 0.2))).transition, digits=9)


@query(w(TRANS, sql_random(0.2)) + sql_walks("pts", 100, _IN_LM) + ", infl AS (SELECT state, node AS lm, count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY state) AS p FROM ended GROUP BY state, node)" + _GRAM + f" SELECT src, dst, round(w, 9) + 0.0 AS w FROM tc")
def c7_state_walks(spark, sf):
    return tidy(C.Connecting("SL-RW").connect(und(spark, sf), checkpoint(random_landmarks(spark, sf, 0.2))).transition, digits=9)


_ABSORB = (
    "into_lm AS (SELECT src AS state, dst AS lm, w AS p FROM t WHERE src NOT IN (SELECT node FROM lm) AND dst IN (SELECT node FROM lm)), inner_t AS MATERIALIZED (SELECT * FROM t WHERE src NOT IN (SELECT node FROM lm) AND dst NOT IN (SELECT node FROM lm)), "
    "part(state, lm, p) AS (SELECT state, lm, p FROM into_lm UNION ALL SELECT i.src, x.lm, sum(i.w * x.p) FROM part x JOIN inner_t i ON x.state = i.dst GROUP BY i.src, x.lm HAVING sum(i.w * x.p) > 1e-13), "
    "infl AS (SELECT state, lm, sum(p) AS p FROM part GROUP BY state, lm UNION ALL SELECT node, node, 1.0 FROM lm)"
)


@query(w(TRANS, sql_random(), _ABSORB) + f"SELECT state, lm, {R('p')} FROM infl")
def c8_absorption(spark, sf):
    """The fixed point: a linear solution here, rounds until nothing is left under way in SQL."""
    return tidy_shares(C.absorption(G.normalise(und(spark, sf)), checkpoint(random_landmarks(spark, sf))), "p")


@query(w(TRANS, sql_random(0.5), _ABSORB) + f"SELECT state, lm, {R('p')} FROM infl")
def c8_absorption_rounds(spark, sf):
    """The same by rounds of joins until it has converged, the way beyond MOST_DIRECT states; with more landmarks, as each round is a job."""
    return tidy_shares(C.absorption(G.normalise(und(spark, sf)), checkpoint(random_landmarks(spark, sf, 0.5)), solver="iterative"), "p")


@query(w(TRANS, sql_random(), _ABSORB) + _GRAM + f" SELECT src, dst, {R('w')} FROM tc")
def c8_exact(spark, sf):
    return tidy_shares(C.Connecting("EXACT").connect(und(spark, sf), checkpoint(random_landmarks(spark, sf))).transition, "w")


_GROW = (
    ", grow(step, node, cluster) AS (SELECT 0, node, node FROM lm UNION ALL (WITH claims AS ("
    f"SELECT e.dst AS node, arg_min(g.cluster, md5('{SEED}:' || (g.step + 1) || ':' || g.cluster)) AS cluster, max(g.step) AS step FROM grow g JOIN und e ON e.src = g.node WHERE e.src <> e.dst AND e.dst NOT IN (SELECT node FROM grow) "
    "GROUP BY e.dst) SELECT step + 1, node, cluster FROM claims UNION ALL SELECT step + 1, node, cluster FROM grow WHERE EXISTS (SELECT 1 FROM claims))), "
    "own AS (SELECT node, cluster FROM grow WHERE step = (SELECT max(step) FROM grow))"
)


@query(w(UND, sql_random()) + _GROW + " SELECT node, cluster FROM own")
def c9_grow_clusters(spark, sf):
    return C.grow_clusters(und(spark, sf), checkpoint(random_landmarks(spark, sf)), SEED)


@query(w(UND, sql_random()) + _GROW + f", cc AS (SELECT a.cluster AS src, b.cluster AS dst, 2.0 * count(*) AS w FROM und JOIN own a ON a.node = und.src JOIN own b ON b.node = und.dst WHERE a.cluster <> b.cluster GROUP BY ALL) SELECT src, dst, {R('w / sum(w) OVER (PARTITION BY src)', 'w')} FROM cc")
def c9_cluster_connectivity(spark, sf):
    return tidy(C.Connecting("CON", seed=SEED).connect(und(spark, sf), checkpoint(random_landmarks(spark, sf))).transition)


_GROW_WEIGHTED = (
    ", lm AS (SELECT node FROM pts ORDER BY md5('42:' || node), node LIMIT (SELECT floor(0.1 * count(*))::BIGINT FROM pts)), e AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, w FROM wk UNION ALL SELECT dst, src, w FROM wk) GROUP BY ALL), "
    "grow(step, node, cluster) AS (SELECT 0, node, node FROM lm UNION ALL (WITH claims AS ("
    f"SELECT e.dst AS node, (list(g.cluster ORDER BY e.w DESC, md5('{SEED}:' || (g.step + 1) || ':' || g.cluster)))[1] AS cluster, max(g.step) AS step FROM grow g JOIN e ON e.src = g.node WHERE e.dst NOT IN (SELECT node FROM grow) "
    "GROUP BY e.dst) SELECT step + 1, node, cluster FROM claims UNION ALL SELECT step + 1, node, cluster FROM grow WHERE EXISTS (SELECT 1 FROM claims))) "
    "SELECT node, cluster FROM grow WHERE step = (SELECT max(step) FROM grow)"
)


@query(w(WK) + _GROW_WEIGHTED)
def c9_grow_by_weight(spark, sf):
    """On directed edges, met in both directions; the heaviest edge to a node wins it."""
    return C.grow_clusters(checkpoint(weighted(spark, sf)), checkpoint(random_landmarks(spark, sf)), SEED, order="desc")


@query("SELECT s.s_nationkey::BIGINT AS src, 100 + p_size AS dst, count(*)::DOUBLE AS w FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) l JOIN supplier s ON s.s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def c9_connectivity_out(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 10_000_000).alias("dst")).distinct().withColumn("w", F.lit(1.0))
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").cast("long").alias("cluster"))
    b = table(spark, sf, "part").select((F.col("p_partkey") + 10_000_000).alias("node"), (F.col("p_size") + 100).cast("long").alias("cluster"))
    out = C.connectivity(e, a.unionByName(b), mode="out")
    return out.select("src", F.col("dst").cast("int").alias("dst"), "w")


@query(w(TRANS, sql_random()) + _GROW + sql_walks("own", 100, "o.cluster <> x.own", own="s.cluster", own_from=" JOIN own o ON o.node = wtab.dst") + f", cc AS (SELECT a.cluster AS src, b.cluster AS dst, count(*) * 1.0::DOUBLE AS w FROM ended JOIN own a ON a.node = ended.state JOIN own b ON b.node = ended.node GROUP BY ALL) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 9) + 0.0 AS w FROM cc")
def c10_cluster_walks(spark, sf):
    return tidy(C.Connecting("CLUSTERRW", seed=SEED).connect(und(spark, sf), checkpoint(random_landmarks(spark, sf))).transition, digits=9)


def _communities(levels) -> DataFrame:
    """(level, src, dst, w) of coarse graphs of clusters."""
    return tidy(H.transitions_of(levels))


@query()
def c12_walktrap(spark, sf):
    e = und(spark, sf)
    n = C.nodes_of(e).count()
    return _communities(X.community_levels(e, lambda g, level: X.walktrap(g, max(2, n // 10**level)), 2))


@query()
def c13_leiden(spark, sf):
    return _communities(X.community_levels(und(spark, sf), lambda g, level: X.leiden(g, (8.0, 2.0)[level - 1]), 2))


@query()
def c14_local_variation(spark, sf):
    return _communities(X.community_levels(und(spark, sf), lambda g, level: X.local_variation(g, 0.5, method="edges"), 2))


@query()
def c14_local_variation_neighbourhoods(spark, sf):
    return _communities(X.community_levels(und(spark, sf), lambda g, level: X.local_variation(g, 0.5, method="neighborhood"), 2))


@query(f"SELECT c_nationkey::BIGINT AS cluster, arg_min(c_custkey, md5('{SEED}:' || c_custkey)) AS node FROM customer GROUP BY c_nationkey")
def c15_pick_members(spark, sf):
    return C.pick_members(table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").cast("long").alias("cluster")), SEED)


@query(w(SUPPLY) + f"SELECT src AS row, arg_min(dst, md5('{SEED}:' || src || ':' || dst)) AS node FROM sp GROUP BY src")
def c16_pick_columns(spark, sf):
    e = supply(spark, sf)
    return C.pick_columns(e, e.select(F.col("src").alias("row")).distinct(), SEED)


# Hierarchies and embeddings.


def sql_coarse(level: int, edges: str, states: str, weights: str | None, k: int) -> str:
    """CTEs of a level by hops: lm{level} of states, influence i, coarse graph c and its next weights v."""
    share = f"JOIN {weights} q ON q.state = a.state" if weights else ""
    by = " * q.w" if weights else ""
    return (
        sql_random(0.1, f"lm{level}", states) + f", f{level}(state, node, h) AS (SELECT node, node, 0 FROM {states} UNION SELECT state, dst, h + 1 FROM f{level} JOIN {edges} ON src = f{level}.node WHERE src <> dst AND h < 5), "
        f"n{level} AS (SELECT state, node AS lm, min(h) AS h FROM f{level} WHERE node IN (SELECT node FROM lm{level}) AND node <> state GROUP BY state, node QUALIFY row_number() OVER (PARTITION BY state ORDER BY min(h), node) <= {k}), "
        f"i{level} AS (SELECT state, lm, 1.0::DOUBLE / count(*) OVER (PARTITION BY state) AS p FROM n{level}), m{level} AS (SELECT a.lm AS src, b.lm AS dst, sum(a.p * b.p{by}) AS w FROM i{level} a JOIN i{level} b ON a.state = b.state {share} GROUP BY a.lm, b.lm), "
        f"c{level} AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM m{level}), v{level} AS (SELECT lm AS state, sum(p{by}) AS w FROM i{level} a {share} GROUP BY lm)"
    )


_LEVELS = w(UND, sql_coarse(1, "und", "pts", None, 3)) + ", und2 AS (SELECT src, dst FROM c1 WHERE src <> dst UNION SELECT dst, src FROM c1 WHERE src <> dst), s2 AS (SELECT DISTINCT src AS node FROM c1), " + sql_coarse(2, "und2", "s2", "v1", 2)
_LEVELS += " SELECT * FROM (" + " UNION ALL ".join(f"SELECT {x} AS level, 'edge' AS part, src, dst, {R('w')} FROM c{x} UNION ALL SELECT {x}, 'weight', state, state, {R('w')} FROM v{x} WHERE state IN (SELECT src FROM c{x})" for x in (1, 2)) + ")"


@query(_LEVELS)
def h2_levels(spark, sf):
    """Two levels by hops: their coarse transitions, and the weights that the next level counts its states with."""
    first = H.build(points(spark, sf).select("node", "features"), S.Sampling("RANDOM", 0.1, SEED), C.Connecting("SL-BFS", k=3), k=K, directed=False)[0]
    levels = [first, H.next_level(first, S.Sampling("RANDOM", 0.1, SEED), C.Connecting("SL-BFS", k=2))]
    parts = [x.transition.select(F.lit(x.level).alias("level"), F.lit("edge").alias("part"), "src", "dst", "w") for x in levels]
    parts += [x.coarse.weights.select(F.lit(x.level).alias("level"), F.lit("weight").alias("part"), F.col("state").alias("src"), F.col("state").alias("dst"), "w") for x in levels]
    return tidy(reduce(DataFrame.unionByName, parts))


@query(w(PTS, sql_random(), sql_random(0.1, "lm2", "lm")) + "SELECT 1 AS level, row_number() OVER (ORDER BY node) - 1 AS lm_idx, node FROM lm UNION ALL SELECT 2, row_number() OVER (ORDER BY node) - 1, node FROM lm2")
def h4_landmarks(spark, sf):
    levels = H.build(points(spark, sf).select("node", "features"), S.Sampling("RANDOM", 0.1, SEED), C.Connecting("LL-BFS", k=3), levels=2, k=K, directed=False)
    return H.landmarks_of(levels)


_CHAIN = ", a AS (SELECT row_number() OVER (ORDER BY node) - 1 AS lm_idx, node AS parent_idx FROM lm), b AS (SELECT row_number() OVER (ORDER BY lm_idx) - 1 AS lm_idx, lm_idx AS parent_idx FROM a WHERE lm_idx % 4 = 1)"


@query(w(PTS, sql_random()) + _CHAIN + " SELECT b.lm_idx AS idx, a.parent_idx AS root FROM b JOIN a ON a.lm_idx = b.parent_idx")
def h5_trace(spark, sf):
    a = checkpoint(S.indexed(random_landmarks(spark, sf), 1))
    b = S.indexed(a.where("lm_idx % 4 = 1").select(F.col("lm_idx").alias("node")), 2)
    return H.trace([a, b])


@query(w(PTS, sql_random()) + ", codes AS (SELECT label, dense_rank() OVER (ORDER BY label)::INT - 1 AS code, node FROM pts) SELECT node, label, code FROM codes WHERE node IN (SELECT node FROM lm)")
def h6_landmark_labels(spark, sf):
    return H.gather(random_landmarks(spark, sf), H.encode_labels(points(spark, sf).select("node", "label")))


@query("SELECT d.doc_id AS node, coalesce(l.quality, 0)::DOUBLE AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def h6_continuous_labels(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return H.continuous_labels(docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("node"), F.col("quality").alias("label")))


@query(w(TRANS) + f"SELECT src, dst, {R('sum(w) / (2 * (SELECT count(*) FROM pts))', 'w')} FROM (SELECT * FROM t UNION ALL SELECT dst, src, w FROM t) GROUP BY src, dst")
def e1_affinity(spark, sf):
    return tidy(E.affinity(und(spark, sf), nodes(spark, sf).count()))


@query()
def e2_components(spark, sf):
    return E.principal_components(points(spark, sf).select("node", "features"))


@query()
def e3_tsne(spark, sf):
    p = points(spark, sf).select("node", "features")
    n = p.count()
    return E.tsne(E.affinity(und(spark, sf), n), E.principal_components(p))


@query()
def e5_level_embedding(spark, sf):
    p = points(spark, sf).select("node", "features")
    level = H.build(p, S.Sampling("HUBS", 0.2), C.Connecting("SL-BFS", k=5), directed=False)[0]
    return H.embed(level, p)


@query()
def e5_community_embedding(spark, sf):
    p, e = points(spark, sf).select("node", "features"), und(spark, sf)
    n = p.count()
    return H.embed_communities(X.community_levels(e, lambda g, level: X.walktrap(g, n // 5), 1)[0], p)


# Features.


@query(
    "WITH terms AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]{2,}')) AS term FROM documents), tf AS (SELECT doc, term, count(*) AS tf FROM terms GROUP BY ALL), "
    "d AS (SELECT term, count(*) AS df FROM tf GROUP BY term), raw AS (SELECT doc, term, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (df + 1)) + 1) AS w FROM tf JOIN d USING (term)) "
    f"SELECT doc, term, {R('w / sqrt(sum(w * w) OVER (PARTITION BY doc))', 'weight')} FROM raw"
)
def f1_tfidf(spark, sf):
    return tidy(feats.tfidf(table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")))


_LONG = "long AS (SELECT node, unnest(range(len(f))) AS i, unnest(f) AS x FROM pts)"
_U = sql_uniform(f"'{SEED}:' || node || ':' || i")


@query(w(PTS, _LONG) + f"SELECT node, i::INT AS i, {R(f'CASE WHEN {_U} < 0.1 THEN 0.0 WHEN {_U} > 0.9 THEN 255.0 ELSE greatest(least(x, 255.0), 0.0) END', 'x')} FROM long")
def f2_salt_and_pepper(spark, sf):
    out = feats.salt_and_pepper(points(spark, sf).select("node", "features"), 0.2, SEED)
    return tidy(out.select("node", F.posexplode("features").alias("i", "x")))


def _sql_normal(parts: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {sql_uniform(parts + " || ':u'")})) * cos(2 * pi() * {sql_uniform(parts + " || ':v'")}))"


_Z = _sql_normal(f"'{SEED}:' || node || ':' || i")


@query(w(PTS, _LONG) + f"SELECT node, i::INT AS i, {R(f'x + {_Z} * 2.0 * (max(x) OVER (PARTITION BY i) - min(x) OVER (PARTITION BY i)) / 40', 'x')} FROM long")
def f3_gaussian_noise(spark, sf):
    out = feats.add_noise(points(spark, sf).select("node", "features"), 2.0, SEED)
    return tidy(out.select("node", F.posexplode("features").alias("i", "x")))


# Metrics. The first two dimensions stand for an embedding.


def plane(spark, sf):
    return points(spark, sf).select("node", F.slice("features", 1, 2).alias("features"))


PLANE = f"{PTS}, xy AS (SELECT node, f[1:2] AS f, label FROM pts)"


_HOPS = ", far(state, node, h) AS (SELECT node, node, 0 FROM pts UNION SELECT state, dst, h + 1 FROM far JOIN und ON src = far.node WHERE h < 10), dist AS MATERIALIZED (SELECT state, node, min(h) AS h FROM far GROUP BY ALL)"


@query(w(UND) + _HOPS + f" SELECT state AS node, {R('sum(1.0 / h) / ((SELECT count(*) FROM pts) - 1)', 'value')} FROM dist WHERE h > 0 GROUP BY state")
def m1_harmonic(spark, sf):
    return tidy(M.harmonic_centrality(und(spark, sf), nodes(spark, sf)))


@query(w(UND) + _HOPS + f" SELECT state AS node, {R('sum(CASE WHEN h <= 2 THEN 1.0 / h ELSE 0 END) / ((SELECT count(*) FROM pts) - 1)', 'value')} FROM dist WHERE h > 0 GROUP BY state")
def m1_harmonic_cutoff(spark, sf):
    return tidy(M.harmonic_centrality(und(spark, sf), nodes(spark, sf), cutoff=2.0))


_PATHS = (
    ", ways(state, node, h, c) AS (SELECT node, node, 0, 1.0::DOUBLE FROM pts UNION ALL SELECT x.state, u.dst, x.h + 1, sum(x.c) FROM ways x JOIN und u ON u.src = x.node JOIN dist d ON d.state = x.state AND d.node = u.dst AND d.h = x.h + 1 GROUP BY x.state, u.dst, x.h), "
    f"few AS (SELECT node FROM pts ORDER BY md5('{SEED}:' || node), node LIMIT 50)"
)


@query(w(UND) + _HOPS + _PATHS + f" SELECT few.node, {R('coalesce(sum(a.c * b.c / st.c), 0)', 'value')} FROM few LEFT JOIN ways a ON a.node = few.node AND a.h > 0 LEFT JOIN ways b ON b.state = few.node AND b.h > 0 LEFT JOIN ways st ON st.state = a.state AND st.node = b.node WHERE st.h = a.h + b.h GROUP BY few.node")
def m2_betweenness(spark, sf):
    """Of fifty sampled nodes, from paths between all pairs of nodes; hops are the lengths."""
    return tidy(M.betweenness_centrality(und(spark, sf), M.sample_nodes(nodes(spark, sf), 50, SEED)))


@query()
def m2_betweenness_weighted(spark, sf):
    """Of all nodes of the directed graph, with weights as lengths."""
    return tidy(M.betweenness_centrality(weighted(spark, sf), nodes(spark, sf)))


def _sql_bins(name: str, cond: str) -> str:
    return f", {name}s AS (SELECT value AS v FROM events WHERE {cond} AND value IS NOT NULL), {name}e AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi FROM {name}s)"


@query(
    "WITH one AS (SELECT 1)" + _sql_bins("p", "user_id % 2 = 0") + _sql_bins("q", "user_id % 2 = 1") + ", bins AS (SELECT least(pe.n, qe.n) AS b FROM pe, qe)"
    + "".join(f", {x}h AS (SELECT least(floor((v - lo) / (hi - lo) * b), b - 1)::BIGINT AS k, count(*) / (max(n) * ((max(hi) - max(lo)) / max(b))) AS d FROM {x}s, {x}e, bins GROUP BY 1)" for x in "pq")
    + ", z AS (SELECT greatest(coalesce(ph.d, 0), 1e-10) AS x, greatest(coalesce(qh.d, 0), 1e-10) AS y FROM (SELECT unnest(range(b)) AS k FROM bins) r LEFT JOIN ph ON ph.k = r.k LEFT JOIN qh ON qh.k = r.k), s AS (SELECT sum(x) AS sx, sum(y) AS sy FROM z) "
    + "SELECT round(sum(x / sx * ln((x / sx) / (y / sy))), 5) + 0.0 AS value FROM z, s"
)
def m3_kl(spark, sf):
    e = table(spark, sf, "events")
    return tidy(M.histogram_divergence(e.where("user_id % 2 = 0").select("value"), e.where("user_id % 2 = 1").select("value")), digits=5)


@query()
def m4_eigenvalues(spark, sf):
    t = G.normalise(und(spark, sf))
    return tidy(M.eigenvalues(G.walk_laplacian(t, nodes(spark, sf)), nodes(spark, sf), 20))


def _ring(spark, sf, name: str, col: str) -> tuple[DataFrame, DataFrame]:
    """The walk Laplacian of a ring through a table's rows, and its nodes; its spectrum is known in closed form."""
    own = checkpoint(numbered(table(spark, sf, name).select(F.col(col).cast("long").alias("k")), "k", "node").select("node"))
    n = own.count()
    step = lambda by: own.select(F.col("node").alias("src"), F.pmod(F.col("node") + by, F.lit(n)).alias("dst"), F.lit(0.5).alias("w"))
    return G.walk_laplacian(step(1).unionByName(step(-1)), own), own


def _sql_ring(name: str, of: str, k: int) -> str:
    return f"{name} AS (SELECT row_number() OVER (ORDER BY x) - 1 AS rank, x AS value FROM (SELECT 1 - cos(2 * pi() * i / n) AS x FROM (SELECT count(*) AS n FROM {of}) s, range((SELECT count(*) FROM {of})) r(i)) QUALIFY row_number() OVER (ORDER BY x) <= {k})"


@query("WITH " + _sql_ring("a", "embeddings", 20) + f" SELECT rank, {R('value')} FROM a")
def m4_ring_eigenvalues(spark, sf):
    return tidy(M.eigenvalues(*_ring(spark, sf, "embeddings", "vec_id"), 20))


_RINGS = "WITH " + _sql_ring("a", "embeddings", 10) + ", " + _sql_ring("b", "supplier", 10)


@query(_RINGS + " SELECT round(sqrt(sum((a.value - b.value) ** 2)), 6) + 0.0 AS value FROM a JOIN b USING (rank)")
def m5_spectral_distance(spark, sf):
    a, b = (M.eigenvalues(*_ring(spark, sf, *x), 10) for x in (("embeddings", "vec_id"), ("supplier", "s_suppkey")))
    return tidy(M.spectral_distance(a, b, 10))


@query(_RINGS + " SELECT round(avg(abs(a.value - b.value) / (abs(b.value) + 1e-6)), 6) + 0.0 AS value FROM a JOIN b USING (rank) WHERE rank > 0")
def m6_relative_error(spark, sf):
    """Without the zero that every connected graph has, whose rounding would be divided by next to nothing."""
    a, b = (M.eigenvalues(*_ring(spark, sf, *x), 10).where("rank > 0") for x in (("embeddings", "vec_id"), ("supplier", "s_suppkey")))
    return tidy(M.relative_eigenvalue_error(a, b, 10))


@query(w(PLANE, sql_knn("ka"), sql_knn("kb", K, "xy")) + f"SELECT {R('count(*) / (10.0 * (SELECT count(*) FROM pts))', 'value')} FROM ka JOIN kb ON ka.src = kb.src AND ka.dst = kb.dst")
def m7_knn_accuracy(spark, sf):
    return tidy(M.knn_accuracy(points(spark, sf).select("node", "features"), plane(spark, sf), K))


@query(w(PLANE, sql_knn("ranks", 1000000), sql_knn("kb", K, "xy")) + f", numbered AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS r FROM ranks), n AS (SELECT count(*) AS n FROM pts) SELECT {R('1 - 2.0 / (max(n) * 10 * (2 * max(n) - 31)) * sum(greatest(r - 10, 0))', 'value')} FROM kb JOIN numbered USING (src, dst), n")
def m8_trustworthiness(spark, sf):
    return tidy(M.trustworthiness(points(spark, sf).select("node", "features"), plane(spark, sf), K))


@query(w(PLANE) + f", c AS (SELECT label, avg(f[1]) AS x, avg(f[2]) AS y FROM xy GROUP BY label), s AS (SELECT c.label, any_value(x) AS x, any_value(y) AS y, avg(sqrt((f[1] - x) ** 2 + (f[2] - y) ** 2)) AS s FROM xy JOIN c USING (label) GROUP BY c.label), m AS (SELECT a.label, max((a.s + b.s) / sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS r FROM s a JOIN s b ON a.label <> b.label GROUP BY a.label) SELECT {R('avg(r)', 'value')} FROM m")
def m9_davies_bouldin(spark, sf):
    return tidy(M.davies_bouldin(plane(spark, sf), points(spark, sf).select("node", "label")))


_SILH = w(PLANE) + ", s AS (SELECT a.node, a.label, b.label AS other, sum(list_distance(a.f, b.f)) AS s, count(*) AS n FROM xy a JOIN xy b ON true GROUP BY ALL), ab AS (SELECT node, label, max(CASE WHEN label = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN label <> other THEN s / n END) AS b FROM s GROUP BY node, label), sil AS (SELECT node, label::VARCHAR AS label, CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"


@query(_SILH + f" SELECT node, label, {R('s')} FROM sil")
def m10_silhouette_samples(spark, sf):
    return tidy(M.silhouette_samples(plane(spark, sf), points(spark, sf).select("node", "label")))


@query(_SILH + f" SELECT label, {R('avg(s)', 'value')} FROM sil GROUP BY label")
def m10_silhouette_clusters(spark, sf):
    return tidy(M.silhouette_clusters(plane(spark, sf), points(spark, sf).select("node", "label")))


@query()
def m11_metric_bundles(spark, sf):
    p = points(spark, sf)
    xy = p.select("node", F.element_at("features", 1).alias("x"), F.element_at("features", 2).alias("y"))
    big = G.normalise(und(spark, sf))
    level = H.build(p.select("node", "features"), S.Sampling("HUBS", 0.2), C.Connecting("SL-BFS", k=5), directed=False)[0]
    out = M.embedding_metrics(p.select("node", "features"), xy, p.select("node", "label"), K)
    out = out.unionByName(M.spectral_metrics(G.walk_laplacian(big, p.select("node")), p.select("node"), G.walk_laplacian(level.transition, level.landmarks), level.landmarks, 20))
    return tidy(out.unionByName(M.graph_metrics(checkpoint(big), level.transition)))


@query(w(PTS, sql_random()) + ", l AS (SELECT 1 AS level, node FROM lm UNION ALL SELECT 0, node FROM pts) SELECT level, label, count(*) AS n, " + R("count(*) / sum(count(*)) OVER (PARTITION BY level)", "share") + " FROM l JOIN pts USING (node) GROUP BY level, label")
def m12_label_distribution(spark, sf):
    p = points(spark, sf).select("node", "label")
    levels = random_landmarks(spark, sf).select(F.lit(1).alias("level"), "node").unionByName(p.select(F.lit(0).alias("level"), "node"))
    return tidy(M.label_distribution(levels, p))


@query(w(PTS, sql_random()) + ", l AS (SELECT 1 AS level, node FROM lm UNION ALL SELECT 0, node FROM pts), c AS (SELECT level, label, count(*) AS n FROM l JOIN pts USING (node) GROUP BY ALL), e AS (SELECT level, label, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT level FROM c) CROSS JOIN (SELECT DISTINCT label FROM c) LEFT JOIN c USING (level, label)) SELECT level, " + R("stddev_pop(n)", "std") + " FROM e GROUP BY level")
def m12_label_spread(spark, sf):
    p = points(spark, sf).select("node", "label")
    levels = random_landmarks(spark, sf).select(F.lit(1).alias("level"), "node").unionByName(p.select(F.lit(0).alias("level"), "node"))
    return tidy(M.label_spread(levels, p))


def _sql_subset(seed: int, name: str, of: str) -> str:
    return f"{name} AS (SELECT node, f FROM {of} ORDER BY md5('{seed}:' || node), node LIMIT (SELECT floor(0.1 * count(*))::BIGINT FROM {of}))"


@query(
    w(PTS, *(x for s in range(5) for x in (_sql_subset(s, f"s{s}", "pts"), _sql_subset(s, f"u{s}", f"s{s}"), sql_knn(f"k{s}", 3, f"s{s}"), sql_knn(f"l{s}", 3, f"u{s}"))))
    + " UNION ALL ".join(f"SELECT {s} AS seed, {level} AS level, src, dst, {R('1.0 / count(*) OVER (PARTITION BY src)', 'w')} FROM {t}{s}" for s in range(5) for level, t in ((1, "k"), (2, "l")))
)
def m13_random_graphs(spark, sf):
    """The graphs of the random baseline: five seeds, two nested levels, transitions of each subset's own neighbours."""
    p = points(spark, sf).select("node", "features")
    out = []
    for seed in range(5):
        for level, own in enumerate(EX.random_subsets(p, seed, 0.1, 2), 1):
            out.append(G.normalise(G.knn_graph(own, 3)).select(F.lit(seed).alias("seed"), F.lit(level).alias("level"), "src", "dst", "w"))
    return tidy(reduce(DataFrame.unionByName, out))


@query()
def m13_random_baseline(spark, sf):
    p = points(spark, sf)
    return tidy(EX.random_baseline(p.select("node", "features"), p.select("node", "label"), seeds=(0,), share=0.3, directed=(False,), k=5, kinds=("embedding", "spectral")))


@query('SELECT event_type AS metric, round(max(value), 6) + 0.0 AS "max", round(avg(value), 6) + 0.0 AS mean, round(min(value), 6) + 0.0 AS "min", round(stddev_samp(value), 6) + 0.0 AS std FROM events GROUP BY event_type')
def m14_report(spark, sf):
    return tidy(M.report(table(spark, sf, "events").select(F.col("event_type").alias("metric"), "value")))


_REDUCTIONS = (0.5, 0.3, 0.1)


def _sql_reduction(share: float) -> str:
    n = int(share * 10)
    own = f"h{n} AS (SELECT p.node, f, label FROM pts p JOIN deg USING (node) ORDER BY round(degree, 9) DESC, p.node LIMIT (SELECT floor({share} * count(*))::BIGINT FROM pts)), x{n} AS (SELECT node, f[1:2] AS f, label FROM h{n})"
    dbi = f"z{n} AS (SELECT label, avg(f[1]) AS x, avg(f[2]) AS y FROM x{n} GROUP BY label), q{n} AS (SELECT z.label, any_value(z.x) AS x, any_value(z.y) AS y, avg(sqrt((f[1] - z.x) ** 2 + (f[2] - z.y) ** 2)) AS s FROM x{n} JOIN z{n} z USING (label) GROUP BY z.label), r{n} AS (SELECT max((a.s + b.s) / sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS r FROM q{n} a JOIN q{n} b ON a.label <> b.label GROUP BY a.label)"
    return f"{own}, {sql_knn(f'a{n}', 5, f'h{n}')}, {sql_knn(f'b{n}', 5, f'x{n}')}, {dbi}"


@query(
    w(DEGREE, *(_sql_reduction(s) for s in _REDUCTIONS))
    + " UNION ALL ".join(
        f"SELECT {s}::DOUBLE AS reduction, 'kNN-acc' AS metric, {R(f'count(*) / (5.0 * (SELECT count(*) FROM h{int(s * 10)}))', 'value')} FROM a{int(s * 10)} a JOIN b{int(s * 10)} b ON a.src = b.src AND a.dst = b.dst UNION ALL SELECT {s}::DOUBLE, 'dbi', {R('avg(r)', 'value')} FROM r{int(s * 10)}" for s in _REDUCTIONS
    )
)
def m15_reduction_sweep(spark, sf):
    """Levels of several reductions; their points' first two dimensions stand for the embedding that is measured."""
    p = points(spark, sf)
    place = lambda level, own: H.gather(level.landmarks, own).select("node", F.element_at("features", 1).alias("x"), F.element_at("features", 2).alias("y"))
    out = EX.sweep(p.select("node", "features"), p.select("node", "label"), [C.Connecting("LL-BFS", k=3)], _REDUCTIONS, k=K, kinds=("embedding",), place=place, measured=5)
    return tidy(out.where(F.col("metric").isin("kNN-acc", "dbi")).select("reduction", "metric", "value"))


@query()
def m15_connector_sweep(spark, sf):
    """Two connectors over two levels of noisy points, with their t-SNE embeddings and spectra."""
    p = points(spark, sf)
    return tidy(EX.sweep(p.select("node", "features"), p.select("node", "label"), [C.Connecting("SL-BFS", k=5), C.Connecting("CON")], (0.3,), (0.2,), levels=2, k=5, kinds=("embedding", "spectral")))


@query("SELECT c_nationkey::BIGINT AS cluster, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS nodes FROM customer GROUP BY c_nationkey")
def u1_cluster_lists(spark, sf):
    clusters = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").cast("long").alias("cluster"))
    lists = feats.clusters_to_lists(feats.lists_to_clusters(feats.clusters_to_lists(clusters)))
    return lists.select("cluster", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ",").alias("nodes"))


@query(w(UND) + "SELECT round(a.f[1], 6) + 0.0 AS x1, round(a.f[2], 6) + 0.0 AS y1, round(b.f[1], 6) + 0.0 AS x2, round(b.f[2], 6) + 0.0 AS y2, w FROM und JOIN pts a ON a.node = src JOIN pts b ON b.node = dst WHERE src < dst")
def p1_segments(spark, sf):
    xy = points(spark, sf).select("node", F.element_at("features", 1).alias("x"), F.element_at("features", 2).alias("y"))
    return tidy(M.plot_segments(und(spark, sf), xy))


@query(w(PTS, _LONG) + ", inside AS (SELECT node FROM pts WHERE f[1] BETWEEN -0.1 AND 0.1 AND f[2] BETWEEN -0.1 AND 0.1) SELECT i::INT AS i, " + R("avg(x)", "mean") + ", " + R("median(x)", "median") + " FROM long WHERE node IN (SELECT node FROM inside) GROUP BY i")
def p1_box_mean(spark, sf):
    p = points(spark, sf).select("node", "features")
    xy = p.select("node", F.element_at("features", 1).alias("x"), F.element_at("features", 2).alias("y"))
    return tidy(M.box_mean(p, xy, -0.1, 0.1, -0.1, 0.1))


@query("SELECT event_type, round(coalesce(sum(CASE WHEN user_id % 2 = 0 THEN value END), 0), 4) + 0.0 AS even, round(coalesce(sum(CASE WHEN user_id % 2 = 1 THEN value END), 0), 4) + 0.0 AS odd FROM events GROUP BY event_type")
def r1_pivot(spark, sf):
    side = F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")
    return tidy(table(spark, sf, "events").withColumn("side", side).groupBy("event_type").pivot("side", ["even", "odd"]).agg(F.coalesce(F.sum("value"), F.lit(0.0))), digits=4)


# Shapes.


def _shape(df: DataFrame) -> DataFrame:
    return tidy(df.select("node", *[F.col("features")[k].alias(c) for k, c in enumerate("xyz")], "label"))


def _sql_shape(inner: str) -> str:
    return f"SELECT node, {R('x')}, {R('y')}, {R('z')}, {R('label')} FROM ({inner})"


_T = f"(2.5 * pi() * (1 + 2 * {sql_uniform(f"'{SEED}:' || i || ':t'")}))"


@query(_sql_shape(f"SELECT i AS node, {_T} * cos({_T}) AS x, 21 * {sql_uniform(f"'{SEED}:' || i || ':h'")} AS y, {_T} * sin({_T}) AS z, {_T} AS label FROM range(5000) r(i)"))
def s7_swissroll(spark, sf):
    return _shape(D.load_dataset(spark, "SWISSROLL"))


@query(_sql_shape("SELECT s * 500 + i AS node, cos(t + s * pi()) AS x, sin(t + s * pi()) AS y, t AS z, t AS label FROM (SELECT i, s, i * 4 * pi() / 499 AS t FROM range(500) r(i), range(2) q(s))"))
def s8_doublehelix(spark, sf):
    return _shape(D.load_dataset(spark, "DOUBLEHELIX"))


@query(
    _sql_shape(
        "SELECT s * 1200 + i AS node, cos(t + s * pi()) AS x, sin(t + s * pi()) AS y, t * 2 / (4 * pi()) - 1 AS z, t AS label FROM (SELECT i, s, i * 4 * pi() / 1199 AS t FROM range(1200) r(i), range(2) q(s)) UNION ALL "
        "SELECT 2400 + k * 800 + j, cos(t) + j / 799.0 * (cos(t + pi()) - cos(t)), sin(t) + j / 799.0 * (sin(t + pi()) - sin(t)), t * 2 / (4 * pi()) - 1, t FROM (SELECT k, j, round_even(k * 1199 / 11.0, 0) * 4 * pi() / 1199 AS t FROM range(12) r(k), range(800) q(j))"
    )
)
def s9_dna(spark, sf):
    return _shape(D.load_dataset(spark, "DNA"))


@query(_sql_shape("SELECT i AS node, (1 + 0.3 * cos(v)) * cos(u) AS x, (1 + 0.3 * cos(v)) * sin(u) AS y, 0.3 * sin(v) AS z, 0.3 * sin(v) AS label FROM (SELECT i, (i % 50) * 2 * pi() / 49 AS u, (i // 50) * 2 * pi() / 49 AS v FROM range(2500) r(i))"))
def s10_torus(spark, sf):
    return _shape(D.load_dataset(spark, "TORUS"))


def _n(k):
    return _sql_normal(f"'{SEED}:' || i || ':{k}'")


@query(_sql_shape(f"SELECT i AS node, 2.0 * {_n(0)} AS x, 0.5 * {_n(0)} + sqrt(0.75) * {_n(1)} AS y, {_n(2)} AS z, 0.0 AS label FROM range(300) r(i) UNION ALL SELECT i, 5 + {_n(0)}, 5 + {_n(1)}, 5 + {_n(2)}, 1.0 FROM range(300, 500) r(i)"))
def s11_gaussians(spark, sf):
    cov = [[4.0, 1.0, 0.0], [1.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    eye = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    return _shape(D.load_dataset(spark, "GAUSSIANS", means=[[0.0] * 3, [5.0] * 3], covariances=[cov, eye], n=[300, 200]))


@query("WITH m AS (SELECT max(vec_id) + 1 AS n FROM embeddings) SELECT vec_id AS node, label FROM embeddings UNION ALL SELECT vec_id + n, label FROM embeddings, m")
def s12_combine(spark, sf):
    p = points(spark, sf).select("node", "label")
    return D.combine(p, p)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """A two-level hierarchy of the embeddings."""
    return h2_levels(spark, sf)


