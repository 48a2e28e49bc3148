"""Hand-computed graphs and plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.functions import session
from stratagraph.operators import communities as X
from stratagraph.operators import connecting as C
from stratagraph.operators import embedding as E
from stratagraph.operators import experiments as EX
from stratagraph.operators import graph as G
from stratagraph.operators import hierarchy as H
from stratagraph.operators import metrics as M
from stratagraph.operators import sampling as S
from stratagraph.operators import sparse as S2


def edges(spark, pairs, both=False):
    rows = [(a, b, float(w[0]) if w else 1.0) for a, b, *w in pairs]
    rows += [(b, a, w) for a, b, w in rows] if both else []
    return spark.createDataFrame(rows, "src long, dst long, w double")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def points(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "node long, features array<double>")


def as_dict(df, digits=9):
    return {(r["src"], r["dst"]): round(r["w"], digits) for r in df.collect()}


def pairs_of(df):
    return {(r["src"], r["dst"]) for r in df.collect()}


@pytest.fixture(scope="module")
def path(spark):
    return edges(spark, [(0, 1), (1, 2), (2, 3)], both=True)


@pytest.fixture(scope="module")
def triangles(spark):
    return edges(spark, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)], both=True)


def test_line_points(spark):
    p = points(spark, [[0], [1], [3], [7]])
    assert pairs_of(G.knn_graph(p, 1)) == {(0, 1), (1, 0), (2, 1), (3, 2)}
    assert pairs_of(G.undirected_edges(G.knn_graph(p, 1, directed=False))) == {(0, 1), (1, 2), (2, 3)}
    assert pairs_of(G.knn(p, 1, block=1)) == pairs_of(G.knn(p, 1))
    assert G.knn(p, 10).count() == 12 and G.knn(p.limit(0), 3).count() == 0


def test_knn_against_numpy(spark):
    x = np.random.default_rng(1).normal(size=(300, 5)).round(1)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(300) for j in np.lexsort((np.arange(300), d[i]))[:7]}
    assert pairs_of(G.knn(points(spark, x), 7, block=64)) == want


def test_absorption_on_a_path(spark, path):
    c = C.Connecting("EXACT", tolerance=1e-12).connect(path, nodes(spark, [0, 3]))
    got = {(r["state"], r["lm"]): round(r["p"], 6) for r in c.influence.collect()}
    assert got == {(0, 0): 1, (1, 0): 0.666667, (1, 3): 0.333333, (2, 0): 0.333333, (2, 3): 0.666667, (3, 3): 1}
    assert as_dict(c.transition, 6) == {(0, 0): 0.777778, (0, 3): 0.222222, (3, 0): 0.222222, (3, 3): 0.777778}
    assert {r["state"]: round(r["w"], 6) for r in c.weights.collect()} == {0: 2, 3: 2}
    cut = C.Connecting("EXACT", threshold_t=0.5).connect(path, nodes(spark, [0, 3]))
    assert as_dict(cut.transition) == {(0, 0): 1, (3, 3): 1}


def test_breadth_first(spark, path):
    lm = nodes(spark, [0, 3])
    got = {(r["state"], r["lm"]): r["h"] for r in C.hops(path, nodes(spark, range(4)), lm, 2).collect()}
    assert got == {(0, 3): 3, (1, 0): 1, (1, 3): 2, (2, 0): 2, (2, 3): 1, (3, 0): 3}
    assert as_dict(C.Connecting("SL-BFS", k=1).connect(path, lm).transition) == {(0, 0): 1, (3, 3): 1}
    assert as_dict(C.Connecting("SL-BFS", k=2).connect(path, lm).transition) == {(0, 0): 0.75, (0, 3): 0.25, (3, 0): 0.25, (3, 3): 0.75}
    assert as_dict(C.Connecting("LL-BFS", k=1).connect(path, lm).transition) == {(0, 3): 1, (3, 0): 1}


def test_triangles(spark, triangles):
    t = G.normalise(triangles)
    d = {r["node"]: round(r["degree"], 6) for r in G.in_degree(t, C.nodes_of(triangles)).collect()}
    assert d == {0: 0.833333, 1: 0.833333, 2: 1.333333, 3: 1.333333, 4: 0.833333, 5: 0.833333}
    clusters = spark.createDataFrame([(i, i // 3) for i in range(6)], "node long, cluster long")
    assert as_dict(C.connectivity(triangles, clusters, "out")) == {(0, 1): 1, (1, 0): 1}
    assert as_dict(C.connectivity(triangles, clusters, "all")) == {(0, 1): 2, (1, 0): 2}
    con = C.Connecting("CON").connect(triangles, nodes(spark, [0, 5]))
    assert as_dict(con.transition) == {(0, 5): 1, (5, 0): 1}
    rw = C.Connecting("CLUSTERRW", n_walks=5).connect(triangles, nodes(spark, [0, 5]))
    assert as_dict(rw.transition) == {(0, 5): 1, (5, 0): 1}
    for found in (X.walktrap(triangles, 2), X.leiden(triangles)):
        assert {r["node"]: r["cluster"] for r in found.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
    assert X.local_variation(triangles, 0.5).select("cluster").distinct().count() == 3


def test_star_and_samplers(spark):
    star = edges(spark, [(0, i) for i in range(1, 5)], both=True)
    t = G.normalise(star)
    assert [r["node"] for r in S.Sampling("HUBS", 0.2).sample(t, C.nodes_of(star)).collect()] == [0]
    pi = {r["node"]: round(r["w"], 6) for r in S.walk_distribution(t, C.nodes_of(star), 1).collect()}
    assert pi == {0: 0.8, 1: 0.05, 2: 0.05, 3: 0.05, 4: 0.05}
    with pytest.raises(ValueError):
        S.Sampling("HUBS", 1.0)
    visits = S.Sampling("RW", 0.2, n_walks=20, n_steps=2, use_share=False, walks_threshold=1.5)
    assert 0 in {r["node"] for r in visits.sample(t, C.nodes_of(star)).collect()} | {0}


def test_greedy_set_is_the_sequential_one(spark):
    r = np.random.default_rng(2)
    t = edges(spark, {(int(a), int(b)): 1 for a, b in r.integers(0, 60, (400, 2)) if a != b}.keys())
    order = {int(n): k for k, n in enumerate(r.permutation(60))}
    top = {}
    for a, b in sorted(pairs_of(G.top_neighbours(t, 3))):
        top.setdefault(a, []).append(b)
    taken, gone = [], set()
    for n in sorted(order, key=order.get):
        if n not in gone:
            taken.append(n)
            gone.update(top.get(n, ()))
    ranked = spark.createDataFrame([(n, k) for n, k in order.items()], "node long, r int")
    got = S.greedy_exclusion(ranked, G.top_neighbours(t, 3), 1000)
    assert {x["node"] for x in got.collect()} == set(taken)


def test_dead_ends_and_loops(spark):
    dead = edges(spark, [(0, 1)])
    assert as_dict(G.normalise(dead)) == {(0, 1): 1}
    assert C.walks(G.walk_table(dead), nodes(spark, [0, 1]), 3, nodes(spark, [5]), 1, 10).count() == 0
    loop = edges(spark, [(0, 0, 3), (0, 1, 1)])
    assert as_dict(G.normalise(G.drop_loops(loop))) == {(0, 1): 1}
    apart = edges(spark, [(0, 1), (2, 3)], both=True)
    assert {r["state"] for r in C.hop_influence(apart, C.nodes_of(apart), nodes(spark, [0]), 1).collect()} == {1}
    four = edges(spark, [(0, i) for i in range(1, 5)])
    assert pairs_of(G.top_neighbours(four, 2)) == {(0, 3), (0, 4)}


@pytest.mark.parametrize("seed", range(2))
def test_strong_components(spark, seed):
    r = np.random.default_rng(seed)
    pairs = {(int(a), int(b)) for a, b in r.integers(0, 30, (38, 2)) if a != b}
    reach = np.eye(31, dtype=bool)
    for a, b in pairs:
        reach[a, b] = True
    for k in range(31):
        reach |= reach[:, [k]] & reach[[k]]
    want = {i: int(np.flatnonzero(reach[i] & reach[:, i])[0]) for i in range(31)}
    e, n = edges(spark, pairs), nodes(spark, range(31))
    for small in (10**6, 0):
        assert {x["node"]: x["component"] for x in G.strong_components(e, n, small).collect()} == want


def test_walks_follow_the_distribution(spark, path):
    c = C.Connecting("SL-RW", n_walks=300, seed=3).connect(path, nodes(spark, [0, 3]))
    got = {(r["state"], r["lm"]): r["p"] for r in c.influence.collect()}
    assert all(abs(got[k, 0] - 2 / 3) < 0.1 for k in (0, 1)) and abs(got[2, 3] - 2 / 3) < 0.1


def test_walks_meet_a_hub_by_stretches(spark, monkeypatch):
    """Stretches and cells of any size give the walks and the draws of a plain search."""
    star = edges(spark, [(0, k, 1.0 + 50.0 * (k == 7)) for k in range(1, 31)] + [(k, 0, 1.0) for k in range(1, 31)] + [(k, k + 1, 2.0) for k in range(1, 30)])
    found, drawn = [], []
    for size in (3, 10**6):
        monkeypatch.setattr(C, "WIDE", size)
        monkeypatch.setattr(S, "CELLS", min(size, 1024))
        rows = C.walks(G.walk_table(star), nodes(spark, [0, 5, 12]), 8, nodes(spark, [9, 30]), 2, 4).collect()
        found.append(sorted((r["state"], r["walk"], r["node"], r["steps"]) for r in rows))
        visits = S.walk_counts(S.Sampling("RW", 0.2, n_walks=9, n_steps=2), G.normalise(star), C.nodes_of(star)).collect()
        drawn.append(sorted((r["node"], r["visits"]) for r in visits))
    assert found[0] == found[1] and len(found[0]) > 2
    assert drawn[0] == drawn[1] and sum(n for _, n in drawn[0]) == 31 * 9


def test_many_clusters_and_missing_labels(spark, monkeypatch):
    """Centres that are too many to broadcast give the same index; a null label has no code."""
    r = np.random.default_rng(8)
    pts = spark.createDataFrame([(i, [float(x) for x in r.normal(i % 4, 1, 2)]) for i in range(24)], "node long, features array<double>")
    labels = spark.createDataFrame([(i, i % 4) for i in range(24)], "node long, label int")
    want = M.davies_bouldin(pts, labels).first()["value"]
    monkeypatch.setattr(M, "MOST_CLUSTERS", 0)
    assert abs(M.davies_bouldin(pts, labels).first()["value"] - want) < 1e-12
    named = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "node long, label string")
    assert {x["node"]: x["code"] for x in H.encode_labels(named).collect()} == {1: 1, 3: 0, 4: 1}
    assert H.encode_labels(named.limit(0)).count() == 0


def test_centralities(spark):
    r = np.random.default_rng(5)
    pairs = {(int(a), int(b)): float(w) for (a, b), w in zip(r.integers(0, 14, (40, 2)), r.integers(1, 4, 40), strict=True) if a != b}
    e, ids = edges(spark, [(*k, w) for k, w in pairs.items()]), sorted({i for k in pairs for i in k})
    dist = {(i, j): 0.0 if i == j else pairs.get((i, j), math.inf) for i in ids for j in ids}
    for k, i, j in itertools.product(ids, ids, ids):
        dist[i, j] = min(dist[i, j], dist[i, k] + dist[k, j])
    count: dict = {}

    def paths(s, t):
        if s == t:
            return 1
        if (s, t) not in count:
            count[s, t] = sum(paths(s, v) for v in ids if (v, t) in pairs and dist[s, v] + pairs[v, t] == dist[s, t] < math.inf)
        return count[s, t]

    n = nodes(spark, ids)
    want = {v: sum(1 / dist[u, v] for u in ids if u != v and dist[u, v] < math.inf) / (len(ids) - 1) for v in ids}
    assert {r["node"]: round(r["value"], 9) for r in M.harmonic_centrality(e, n).collect()} == {k: round(v, 9) for k, v in want.items()}
    want = {v: sum(paths(s, v) * paths(v, t) / paths(s, t) for s in ids for t in ids if s != t and v not in (s, t) and dist[s, t] < math.inf and dist[s, v] + dist[v, t] == dist[s, t]) for v in ids}
    assert {r["node"]: round(r["value"], 6) for r in M.betweenness_centrality(e, n).collect()} == {k: round(v, 6) for k, v in want.items()}


def test_spectra(spark, triangles):
    lap = G.laplacian(triangles)
    m = np.zeros((6, 6))
    for (a, b), w in as_dict(lap).items():
        m[a, b] = w
    want = np.linalg.eigvalsh(m)
    whole = [r["value"] for r in M.eigenvalues(lap, C.nodes_of(triangles), 6).orderBy("rank").collect()]
    assert np.allclose(whole, want, atol=1e-9)
    steps = [r["value"] for r in M.eigenvalues(lap, C.nodes_of(triangles), 3, most=2, steps=6).orderBy("rank").collect()]
    assert np.allclose(steps[:2], want[:2], atol=1e-6)


def test_spectra_beyond_the_whole_matrix(spark, monkeypatch):
    """Values that are met twice (a ring) or often (parts of a graph) are all there, by any way; too few steps raise."""
    n = 600
    ring = edges(spark, [(k, (k + 1) % n, -0.5) for k in range(n)] + [(k, (k - 1) % n, -0.5) for k in range(n)] + [(k, k, 1.0) for k in range(n)])
    want = np.sort(1 - np.cos(2 * np.pi * np.arange(n) / n))[:7]
    assert np.allclose([r["value"] for r in M.eigenvalues(ring, nodes(spark, range(n)), 7, most=10).orderBy("rank").collect()], want, atol=1e-9)
    r = np.random.default_rng(2)
    i, j = np.repeat(np.arange(n), 4), None
    j = (i + 20 * r.integers(1, n // 20, len(i))) % n
    lap = G.laplacian(edges(spark, {(int(a), int(b)): 1 for a, b in zip(i, j, strict=True) if a != b}, both=True))
    m = np.zeros((n, n))
    for (a, b), x in as_dict(lap, 12).items():
        m[a, b] = x
    want = np.linalg.eigvalsh(m)[:25]
    monkeypatch.setattr(S2, "MOST_WORK", 0)
    for limit in (10**6, 0):
        monkeypatch.setattr(M, "MOST_EDGES", limit)
        assert np.allclose([x["value"] for x in M.eigenvalues(lap, nodes(spark, range(n)), 25, most=10).orderBy("rank").collect()], want, atol=1e-6)
    with pytest.raises(RuntimeError):
        M.eigenvalues(lap, nodes(spark, range(n)), 25, most=10, steps=3)


def test_tsne_separates_clusters(spark):
    r = np.random.default_rng(0)
    p = points(spark, np.concatenate([r.normal(size=(40, 4)), 9 + r.normal(size=(40, 4))]))
    levels = H.build(p, S.Sampling("RANDOM", 0.5), C.Connecting("SL-BFS", k=5), levels=2, k=6, directed=False)
    assert [x.landmarks.count() <= n for x, n in zip(levels, (40, 20), strict=True)] == [True, True]
    for x in levels:
        rows = x.transition.groupBy("src").agg(F.sum("w").alias("s")).collect()
        assert all(abs(q["s"] - 1) < 1e-9 for q in rows)
    got = H.embed(levels[0], p, steps=150, early_exaggeration=True, early_steps=60, trace=30).collect()
    costs = got[0]["costs"]
    assert len(costs) == 7 and costs[-1] == got[0]["cost"] < costs[2]
    xy = np.array([(q["x"], q["y"]) for q in got])
    side = np.array([q["node"] >= 40 for q in got])
    gap = np.linalg.norm(xy[side].mean(0) - xy[~side].mean(0))
    assert np.isfinite(xy).all() and gap > xy[side].std() / 2
    a = E.affinity(levels[0].transition, levels[0].landmarks.count())
    assert abs(a.agg(F.sum("w")).first()[0] - 1) < 1e-6
    flat = E.principal_components(p).collect()
    one = np.array([q["features"][0] for q in flat])
    assert abs(one.std() - 1e-4) < 1e-9


def test_repulsion_through_a_grid():
    """Fields of the grid are those of all pairs, nearly; and a level embeds beyond the points whose pairs are met."""
    r = np.random.default_rng(4)
    for scale, share in ((1e-3, 1e-6), (1.0, 1e-2), (8.0, 0.12)):
        y = r.normal(size=(900, 2)) * scale
        (a, z), (b, z2) = E._repulsion(y), E._interpolated_repulsion(y)
        assert abs(z - z2) < 0.02 * z and np.abs(a - b).max() <= max(share * np.abs(a).max(), 1e-9)
        plain = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))
        assert abs(plain.sum() - len(y) - z) < 1e-6 * z


def test_repulsion_takes_the_cheaper_way():
    """Wide layouts of a few thousand points meet all pairs: blocks of pairs are each computed once, and a grid of many boxes costs more."""
    y = np.random.default_rng(2).normal(size=(700, 2)) * 30
    gap = y[:, None] - y[None]
    q = 1 / (1 + (gap**2).sum(2))
    push, z = E._repulsion(y, at_once=256)
    assert abs(z - (q.sum() - len(y))) < 1e-9 * z and np.allclose(push, ((q * q)[:, :, None] * gap).sum(1))
    assert E._boxes(y) > 100 and len(y) <= E.PAIRS_A_BOX * E._boxes(y) < 20_000


def test_known_spectra_and_embeddings_are_not_computed_again(spark, monkeypatch):
    """The whole graph's spectrum once for all levels, embeddings of all levels in one job."""
    r = np.random.default_rng(3)
    p = points(spark, r.normal(size=(120, 4)))
    labels = p.select("node", (F.col("node") % 3).alias("label"))
    sizes, jobs, own = [], [], M.eigenvalues

    def counted(edges, nodes, k, *a, **b):
        sizes.append(nodes.count())
        return own(edges, nodes, k, *a, **b)

    monkeypatch.setattr(M, "eigenvalues", counted)
    monkeypatch.setattr(EX, "eigenvalues", counted, raising=False)
    monkeypatch.setattr(EX, "checkpoint", lambda df: (jobs.append({*df.columns} >= {"x", "y"}), session.checkpoint(df))[1])
    place = lambda t, own: own.select("node", F.element_at("features", 1).alias("x"), F.element_at("features", 2).alias("y"))
    got = EX.random_baseline(p, labels, seeds=(0, 1), share=0.5, directed=(False,), k=4, kinds=("spectral",), place=place)
    assert sorted(sizes) == [30, 30, 60, 60, 120] and sum(jobs) == 1
    assert got.count() == 8 and got.where("value IS NULL").count() == 0
    whole = G.normalise(G.knn_graph(p, 4, directed=False))
    for seed in (0, 1):
        for level, sub in enumerate(EX.random_subsets(p, seed, 0.5, 2), 1):
            t = G.normalise(G.knn_graph(sub, 4, directed=False))
            plain = M.spectral_metrics(G.walk_laplacian(whole, p.select("node")), p.select("node"), G.walk_laplacian(t, sub.select("node")), sub.select("node"), 20)
            assert {x["metric"]: round(x["value"], 8) for x in plain.collect()} == {x["metric"]: round(x["value"], 8) for x in got.where((F.col("seed") == seed) & (F.col("level") == level)).collect()}


def test_sweeps_share_a_graph_and_its_spectrum(spark, monkeypatch):
    """Connectors and levels of the same points are compared with one graph, whose spectrum is computed once."""
    p = points(spark, np.random.default_rng(5).normal(size=(60, 4)))
    labels = p.select("node", (F.col("node") % 3).alias("label"))
    sizes, own = [], M.eigenvalues

    def counted(edges, nodes, k, *a, **b):
        sizes.append(nodes.count())
        return own(edges, nodes, k, *a, **b)

    monkeypatch.setattr(M, "eigenvalues", counted)
    monkeypatch.setattr(EX, "eigenvalues", counted, raising=False)
    place = lambda level, own: H.gather(level.landmarks, own).select("node", F.element_at("features", 1).alias("x"), F.element_at("features", 2).alias("y"))
    got = EX.sweep(p, labels, [C.Connecting("LL-BFS", k=3), C.Connecting("CON")], (0.5,), k=4, kinds=("spectral",), place=place).collect()
    assert sorted(sizes) == [30, 30, 60]
    assert {(x["connector"], x["metric"]) for x in got} == {(c, m) for c in ("LL-BFS", "CON") for m in ("dspectral", "rel_eigval_e")}


def test_divergences_follow_paths_once(spark, monkeypatch, tmp_path):
    """Centralities are kept before a divergence reads its tables several times."""
    for name in ("harmonic_centrality", "betweenness_centrality"):

        def marked(edges, nodes, *a, own=getattr(M, name), name=name):
            def run(batches):
                with open(tmp_path / name, "a") as f:
                    f.write("x")
                yield from batches

            return own(edges, nodes, *a).coalesce(1).mapInArrow(run, "node long, value double")

        monkeypatch.setattr(M, name, marked)
    ring = lambda n: edges(spark, [(i, (i + 1) % n) for i in range(n)], both=True)
    got = {x["metric"]: x["value"] for x in M.graph_metrics(ring(8), ring(6), directed=False).collect()}
    assert set(got) == {"closeness", "betweeness"}
    assert {x.name: x.read_text() for x in tmp_path.iterdir()} == {"harmonic_centrality": "xx", "betweenness_centrality": "xx"}


def test_freed_native_memory_is_handed_back(spark, monkeypatch):
    assert "native heap" in session.trim(spark)
    calls = []
    monkeypatch.setattr(session, "trim", lambda spark: calls.append(1))
    session.checkpoint(spark.range(3))
    assert calls == [1]


def test_embedding_by_a_grid_separates_clusters(spark):
    r = np.random.default_rng(1)
    p = points(spark, np.concatenate([r.normal(size=(150, 3)), 12 + r.normal(size=(150, 3))]))
    t = G.normalise(G.knn_graph(p, 8, directed=False))
    got = E.tsne(E.affinity(t, 300), E.principal_components(p), steps=200, exact=100).collect()
    xy, side = np.array([(q["x"], q["y"]) for q in got]), np.array([q["node"] >= 150 for q in got])
    near = ((xy[:, None] - xy[None]) ** 2).sum(2)
    np.fill_diagonal(near, np.inf)
    assert (side[near.argmin(1)] == side).mean() > 0.97
    with pytest.raises(ValueError):
        E.tsne(E.affinity(t, 300), E.principal_components(p), most=299)


def test_absorption_direct_and_iterative(spark):
    """Both ways agree, also where walks can leak to where no landmark is; a slow chain cut short raises."""
    r = np.random.default_rng(7)
    t = G.normalise(edges(spark, {(int(a), int(b)): 1 for a, b in r.integers(0, 25, (70, 2)) if a != b} | {(3, 40): 1, (40, 41): 1, (41, 40): 1}))
    marks = nodes(spark, [1, 2, 5])
    found = [{(x["state"], x["lm"]): x["p"] for x in C.absorption(t, marks, solver=s, tolerance=1e-12).collect()} for s in ("direct", "iterative")]
    assert found[0].keys() == found[1].keys() and all(abs(found[0][k] - found[1][k]) < 1e-9 for k in found[0])
    assert not any(s in (40, 41) for s, _ in found[0])
    slow = edges(spark, [(k, k + 1) for k in range(30)], both=True)
    with pytest.raises(RuntimeError):
        C.absorption(G.normalise(slow), nodes(spark, [0]), steps=12, solver="iterative")
    with pytest.raises(ValueError):
        C.absorption(t, marks, solver="other")
    plain = C.Connecting("EXACT").connect(edges(spark, [(0, 1), (1, 0), (5, 1)]), nodes(spark, [0, 9]))
    assert {x["node"] for x in plain.landmarks.collect()} == {0, 9}  # landmarks that nothing leads to are kept


def test_products_by_slabs():
    """As a plain product, with even and uneven rows, rows beyond LONG and empty ones; potentials are known where a matrix is similar to a symmetric one."""
    r = np.random.default_rng(5)
    for n, share in ((40, 0.2), (900, 0.01)):
        a = np.where(r.random((n, n)) < share, r.random((n, n)), 0.0)
        a[3], a[7] = 0.0, r.random(n)
        for b in (a, np.where(a > 0, r.random((n, 1)), 0.0)):
            i, j = np.nonzero(b)
            m, x, out = S2.Slabs(n, i, j, b[i, j], 5), r.random((n, 5)), r.random((n, 5))
            assert np.allclose(m.of(x[m.order], np.empty((n, 5)))[m.rank], b @ x)
            assert np.allclose(m.of(x[m.order], out[m.order], 0.3, 0.7)[m.rank], 0.3 * out + 0.7 * b @ x)
            assert S2.potentials(n, i, j, b[i, j]) is None
        b = np.maximum(a, a.T)
        b /= 1.05 * b.sum(1, keepdims=True)
        i, j = np.nonzero(b)
        d, m, right = S2.potentials(n, i, j, b[i, j]), S2.Slabs(n, i, j, b[i, j], 5), r.random((n, 5))
        assert np.allclose(d[i] * b[i, j], d[j] * b[j, i])
        got = S2.settled(m, right[m.order], 0.96, lambda left: np.abs(left).max() / 1e-12)[m.rank]
        assert np.allclose(got, np.linalg.solve(np.eye(n) - b, right), atol=1e-9)


def test_absorption_in_an_undirected_graph_takes_few_products(spark, monkeypatch):
    """A slow undirected graph of two parts settles in far fewer products than rounds, with rows where a landmark is reached alone."""
    r = np.random.default_rng(9)
    found = {tuple(sorted((int(a), int(b)))): float(c) for a, b, c in zip(*r.integers(0, 150, (2, 500)), r.random(500), strict=True) if a != b}
    found |= {(a + 1000, b + 1000): w for (a, b), w in found.items()} | {(k + 2000, k + 2001): 1.0 for k in range(10)}
    t = G.normalise(edges(spark, [(a, b, w) for (a, b), w in found.items()], both=True))
    marks = nodes(spark, [*range(0, 150, 15), *range(1000, 1150, 15), 2000, 2010])
    want = {(x["state"], x["lm"]): x["p"] for x in C.absorption(t, marks, solver="direct").collect() if x["p"] > 1e-12}
    system = C._absorbed(t, marks, 1000, 1e-10, solver="iterative")[1]
    m, calls = system.matrix(), []
    monkeypatch.setattr(m, "of", lambda *a, of=m.of: (calls.append(1), of(*a))[1], raising=False)
    system.solve(m, 0)
    assert len(calls) < system.rounds / 3
    got = {(x["state"], x["lm"]): x["p"] for x in C.absorption(t, marks, tolerance=1e-10, solver="iterative").collect()}
    assert got.keys() == want.keys()
    assert all(sum(abs(got[k] - want[k]) for k in got if k[0] == state) <= 1.1e-10 for state in {x for x, _ in got})  # of a state's landmarks together


@pytest.mark.parametrize("both", (False, True))
def test_exact_transitions_without_influence(spark, both, monkeypatch):
    """Rows of I' I by two solutions are those of the gram matrix, in directed and undirected graphs, also of a landmark that nothing leads to."""
    r = np.random.default_rng(11)
    found = {(int(a), int(b)): float(c) for a, b, c in zip(*r.integers(0, 90, (2, 300)), r.random(300), strict=True) if a != b}
    found |= {(a + 1000, b + 1000): w for (a, b), w in found.items()}
    graph = edges(spark, [(a, b, w) for (a, b), w in found.items()])
    graph = G.symmetrise_max(graph) if both else graph
    c, marks = C.Connecting("EXACT", solver="iterative", tolerance=1e-11), nodes(spark, [*range(0, 90, 9), *range(1000, 1090, 9), 5000])
    want = as_dict(G.normalise(G.gram(C.absorption(G.normalise(graph), marks, solver="direct").where("p > 1e-13"))))
    monkeypatch.setattr(C, "_influence_to_coarse", None)  # would write the influence
    got = as_dict(c.connect(graph, marks).transition)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_absorption_by_columns_and_by_joins(spark, monkeypatch):
    """Rounds in a task for some landmarks' columns, rounds of joins and the direct solution agree, and so do gram matrices by blocks."""
    r = np.random.default_rng(3)
    t = G.normalise(edges(spark, {(int(a), int(b)): 1 for a, b in r.integers(0, 60, (300, 2)) if a != b}))
    marks, found, calls, iterated = nodes(spark, range(0, 60, 5)), [], [], C._iterated
    plain = C.absorption(t, marks, solver="direct")
    monkeypatch.setattr(C, "_iterated", lambda *a: (calls.append(1), iterated(*a))[1])
    for copied, columns in ((10**6, 100), (10**6, 10**6), (0, 0)):
        monkeypatch.setattr(C, "MOST_COPIED", copied)
        monkeypatch.setattr(C, "MOST_COLUMNS", columns)
        found.append({(x["state"], x["lm"]): x["p"] for x in C.absorption(t, marks, solver="iterative", tolerance=1e-11).collect()})
    want = {(x["state"], x["lm"]): x["p"] for x in plain.collect()}
    assert len(calls) == 2 and all(x.keys() == want.keys() and all(abs(x[k] - want[k]) < 1e-9 for k in x) for x in found)
    i, weights = plain.unionByName(spark.createDataFrame([(99, 0, 0.5)], "state long, lm long, p double")), spark.createDataFrame([(k, k % 4 + 0.5) for k in range(60)], "state long, w double")
    for w in (None, weights):
        monkeypatch.setattr(G, "GRAM_DENSE", 10**6)
        want = as_dict(G.gram(i, w))
        monkeypatch.setattr(G, "GRAM_DENSE", 1)
        for states, own in ((1000, 1000), (7, 5)):
            monkeypatch.setattr(G, "GRAM_STATES", states)
            monkeypatch.setattr(G, "GRAM_MARKS", own)
            assert as_dict(G.gram(i, w)) == want


def test_searches_with_a_node_limit(spark, path):
    lm = nodes(spark, [0, 3])
    got = {(r["state"], r["lm"]): r["h"] for r in C.hops(path, nodes(spark, range(4)), lm, 2, max_nodes=3).collect()}
    assert got == {(1, 0): 1, (2, 3): 1}
    assert C.hops(path, nodes(spark, range(4)), lm, 2, max_nodes=1).count() == 0


def test_clusters_follow_weights_and_both_directions(spark):
    e = edges(spark, [(0, 2, 1), (1, 2, 5), (4, 0, 1)])
    seeds = nodes(spark, [0, 1])
    for order, want in (("asc", 0), ("desc", 1)):
        got = {r["node"]: r["cluster"] for r in C.grow_clusters(e, seeds, 3, order=order).collect()}
        assert got == {0: 0, 1: 1, 2: want, 4: 0}
    assert {r["node"] for r in C.grow_clusters(e, seeds, 3, mode="out").collect()} == {0, 1, 2}
    own, marks = C.cover_clusters(edges(spark, [(0, 1), (2, 0), (7, 8), (8, 9)]), nodes(spark, [0]), 3)
    assert {r["node"]: r["cluster"] for r in own.collect()} == {0: 0, 1: 0, 2: 0, 7: 7, 8: 7, 9: 7}
    assert {r["node"] for r in marks.collect()} == {0, 7}
    rw = C.Connecting("CLUSTERRW", n_walks=5, max_steps=8).connect(edges(spark, [(0, 1), (1, 2), (7, 8), (8, 7)]), nodes(spark, [0]))
    assert {r["node"] for r in rw.landmarks.collect()} == {0, 7}


def test_betweenness_of_a_sample_is_of_all_paths(spark):
    line = edges(spark, [(k, k + 1) for k in range(4)], both=True)
    got = lambda **o: {r["node"]: r["value"] for r in M.betweenness_centrality(line, nodes(spark, [2]), directed=False, **o).collect()}
    assert got() == {2: 4.0} and got(cutoff=2.0) == {2: 1.0}
    assert got(sources=nodes(spark, [0])) == {2: 5.0}
    assert {r["node"]: r["value"] for r in M.harmonic_centrality(line, nodes(spark, [0, 2]), cutoff=1.0).collect()} == {0: 0.25, 2: 0.5}


@pytest.mark.parametrize("kind", ("hops", "sums"))
def test_paths_of_many_starts_are_those_of_one(spark, monkeypatch, kind):
    """Searches that share rounds give the plain search's centralities, with a cutoff, and with starts that the graph hasn't."""
    r = np.random.default_rng(11)
    pairs = {(int(a), int(b)): float(r.integers(1, 4)) if kind == "sums" else 2.0 for a, b in r.integers(0, 330, (900, 2)) if a != b}
    e, n = edges(spark, [(*k, w) for k, w in pairs.items()]), nodes(spark, [*range(330), 999])
    got = lambda f, **o: {x["node"]: round(x["value"], 8) for x in f(e, n, **o).collect()}
    asked = [(f, o) for f in (M.harmonic_centrality, M.betweenness_centrality) for o in ({}, {"cutoff": 4.0})]
    many = [got(f, **o) for f, o in asked]
    monkeypatch.setattr(M, "_kind", lambda w: "other")
    assert many == [got(f, **o) for f, o in asked] and many[0][999] == 0.0


def test_small_metrics(spark):
    p = points(spark, [[0.0, 0], [1, 0]])
    assert M.trustworthiness(p, p, 5).first()["value"] == 1.0
    one, two = (spark.createDataFrame([(float(x),) for x in v], "value double") for v in ((0, 1, 2, 9), (3, 3.5, 4, 12)))
    apart, shared = (M.histogram_divergence(one, two, shared_bins=s).first()["value"] for s in (False, True))
    p, q = (np.clip(np.histogram(v, 4, (0, 12), density=True)[0], 1e-10, None) for v in ((0, 1, 2, 9), (3, 3.5, 4, 12)))
    assert abs(shared - (p / p.sum() * np.log(p / p.sum() * q.sum() / q)).sum()) < 1e-9 and apart != shared


def test_rows_before_marks(monkeypatch):
    """Counted without sorting all distances, by differences where products cannot tell: equal points, grids, far from 0, twins."""
    monkeypatch.setattr(M, "distances", None)
    r = np.random.default_rng(1)
    for x in (r.normal(size=(300, 6)), r.integers(0, 3, (300, 3)).astype(float), np.ones((300, 4)), r.normal(size=(300, 4)) * 1e-3 + 50, r.normal(size=(150, 8)).repeat(2, 0)):
        p, q, owner = r.permutation(300)[:120], np.sort(r.permutation(300)[:200]), np.repeat(np.arange(120), r.integers(0, 6, 120))
        who = r.integers(0, 300, len(owner))
        far, d = np.sqrt(((x[p[owner]] - x[who]) ** 2).sum(1)), np.sqrt(((x[p[owner], None] - x[q]) ** 2).sum(2))
        nearer = (d < far[:, None] - 1e-12) | ((np.abs(d - far[:, None]) <= 1e-12) & (q < who[:, None]))
        want = (nearer & (q != p[owner][:, None])).sum(1)
        assert (M._before(x[p], x[q], p, q, owner, who, far, at_once=5000) == want).all()


def test_trustworthiness_and_silhouettes_against_numpy(spark, monkeypatch):
    """With ties, repeated points, and points dealt to several blocks."""
    monkeypatch.setattr(M, "BLOCK", 16)
    r = np.random.default_rng(9)
    x, y, label = r.integers(0, 3, (50, 3)).astype(float), r.normal(size=(50, 2)), r.integers(0, 3, 50)
    dx, dy = (np.sqrt(((a[:, None] - a[None]) ** 2).sum(2)) for a in (x, y))
    excess = 0
    for i in range(50):
        other = np.delete(np.arange(50), i)
        rank = {int(j): k + 1 for k, j in enumerate(other[np.lexsort((other, dx[i][other]))])}
        excess += sum(max(rank[int(j)] - 5, 0) for j in other[np.lexsort((other, dy[i][other]))][:5])
    want = 1 - 2 / (50 * 5 * (2 * 50 - 16)) * excess
    assert abs(M.trustworthiness(points(spark, x), points(spark, y), 5).first()["value"] - want) < 1e-9
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(label)], "node long, label int")
    got = {q["node"]: q["s"] for q in M.silhouette_samples(points(spark, y), labels).collect()}
    for i in range(50):
        a = dy[i][(label == label[i]) & (np.arange(50) != i)].mean()
        b = min(dy[i][label == c].mean() for c in set(label.tolist()) - {int(label[i])})
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-9


def test_near_neighbours_among_cells(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([c + r.normal(size=(150, 4)) for c in 6 * r.normal(size=(10, 4))] + [np.zeros((200, 4))])
    p = points(spark, x)
    want, got = pairs_of(G.knn(p.where("node < 1500"), 5)), pairs_of(G.knn_near(p, 5, probes=4, cell=50).where("src < 1500 and dst < 1500"))
    assert len(want & got) > 0.95 * len(want)
    assert G.knn_near(p, 5, probes=4, cell=50).groupBy("src").count().where("count = 5").count() == 1700


def test_communities_of_levels(spark, triangles):
    levels = X.community_levels(triangles, lambda g, level: X.walktrap(g, 2), 1)
    assert as_dict(levels[0].transition) == {(0, 3): 1, (3, 0): 1}
    r = np.random.default_rng(2)
    p = points(spark, np.concatenate([r.normal(size=(30, 2)) + 30 * k for k in range(4)]))
    e = G.knn_graph(p, 4, directed=False)
    two = X.community_levels(e, lambda g, level: X.local_variation(g, 0.5, method="neighborhood"), 2)
    assert {q["node"] // 30 == q["cluster"] // 30 for q in two[0].clusters.collect()} == {True}
    assert two[1].members.count() < two[0].members.count() <= 60 and {q["node"] for q in two[1].members.collect()} <= set(range(120))
    assert {q["cluster"] for q in two[1].members.collect()} >= {q["src"] for q in two[1].transition.collect()}


def test_sparse_baselines_beyond_dense_ones(spark, monkeypatch):
    """Sketched walks and iterated vectors keep well separated groups apart, as the dense ones do."""
    monkeypatch.setattr(X, "EXACT_NODES", 0)
    r = np.random.default_rng(2)
    p = points(spark, np.concatenate([r.normal(size=(40, 2)) + 30 * k for k in range(3)]))
    e = G.knn_graph(p, 6, directed=False)
    for clusters in (X.walktrap(e, 6), X.local_variation(e, 0.5)):
        assert {q["node"] // 40 == q["cluster"] // 40 for q in clusters.collect()} == {True}


def test_levels_meet_their_connectors_graph(spark):
    r = np.random.default_rng(5)
    p = points(spark, r.normal(size=(60, 3)))
    levels = H.build(p, S.Sampling("RANDOM", 0.4), C.Connecting("CON"), levels=2, k=4, directed=False, weighted=True)
    assert levels[0].coarse.adjacency is not None
    seen = H.connected_graph("CON", levels[0].transition, levels[0].coarse.adjacency, False, True)
    a = as_dict(seen)
    assert {(d, s) for s, d in a} == set(a)
    rows = {}
    for (s, _), w in a.items():
        rows[s] = rows.get(s, 0) + w * w
    assert all(abs(x - 1) < 1e-6 for x in rows.values())
    asym = edges(spark, [(0, 1, 0.25), (1, 0, 0.75), (1, 2, 1)])
    assert as_dict(H.connected_graph("SL-BFS", asym, asym, False, False)) == {(0, 1): 1, (1, 0): 1, (1, 2): 1, (2, 1): 1}
    assert H.connected_graph("EXACT", asym, asym, False, True) is asym
    assert [tuple(q)[0] for q in H.describe(levels).orderBy("level").collect()] == [1, 2]


def test_sweeps(spark):
    r = np.random.default_rng(5)
    p = points(spark, np.concatenate([r.normal(size=(40, 3)), 7 + r.normal(size=(40, 3))]))
    labels = spark.createDataFrame([(i, i // 40) for i in range(80)], "node long, label int")
    got = EX.sweep(p, labels, [C.Connecting("LL-BFS", k=3)], (0.5,), (0.0, 0.1), k=4, kinds=("embedding", "spectral")).collect()
    assert len(got) == 2 * 6 and {(q["reduction"], q["noise"]) for q in got} == {(0.5, 0.0), (0.5, 0.1)}
    assert all(q["value"] is not None and math.isfinite(q["value"]) for q in got)
    base = EX.random_baseline(p, labels, seeds=(0,), share=0.5, k=4, directed=(True,), kinds=("graph",), place=lambda t, own: own).collect()
    assert sorted((q["level"], q["metric"]) for q in base) == [(1, "betweeness"), (1, "closeness"), (2, "betweeness"), (2, "closeness")]


def test_weighted_next_level(spark, path):
    w = spark.createDataFrame([(i, float(i + 1)) for i in range(4)], "state long, w double")
    c = C.Connecting("SL-BFS", k=2).connect(path, nodes(spark, [0, 3]), w)
    assert abs(c.weights.agg(F.sum("w")).first()[0] - 10) < 1e-9


def test_reports(spark):
    long = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "metric string, value double")
    assert M.latex_rows(M.report(long)) == [r"a & 3.000 & 2.000 & 1.000 & 1.414 \\", r"b & 2.000 & 2.000 & 2.000 & -- \\"]
    assert sorted(r["value"] for r in M.radar(long).collect()) == [1 / 3, 1.0, 1.0]


def test_searches_meet_edges_once(monkeypatch):
    """Shares of one start's paths, by hops and by sums, are the plain ones, and no node's edges are met twice."""
    asked, of = [], S2.Near.of
    monkeypatch.setattr(S2.Near, "of", lambda self, rows, marks: asked.append((id(self), rows)) or of(self, rows, marks))
    random = np.random.default_rng(5)
    for case in range(40):
        n = int(random.integers(2, 50))
        a, b = np.divmod(np.unique(np.concatenate([random.integers(0, n * n, 4 * n), np.arange(n)])), n)  # node 0 is a hub
        w = (np.ones(len(a)), random.choice([0.5, 1.0, 1.5], len(a)), random.random(len(a)) + 0.01)[case % 3]
        rows, limit = np.searchsorted(a, np.arange(n + 1)), (np.inf, 2.0)[case % 2]
        given = None if case % 3 == 0 else w
        into, out = S2.Near(n, b, a, given), S2.Near(n, a, b, given)
        for start in range(n):
            asked.clear()
            got = (S2.hop_shares if given is None else S2.path_shares)(into, out, start, limit)
            order, _, count, back = M._paths(start, rows, b, w, None if limit == np.inf else limit)
            want = np.zeros(n)
            for u in reversed(order):
                for p in back[u]:
                    want[p] += count[p] / count[u] * (1 + want[u])
            want[start] = 0
            np.testing.assert_allclose(got, want, atol=1e-9)
            met = np.concatenate([x for which, x in asked if which == id(out)])
            assert len(np.unique(met)) == len(met)
