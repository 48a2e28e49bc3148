"""Queries with their operators' default limits, against plain versions."""

import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from stratagraph.plans.queries import QUERIES


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    """The first 80 vectors."""
    out = tmp_path_factory.mktemp("small")
    pq.write_table(pq.read_table("/root/testdata/sf0.001/embeddings.parquet").slice(0, 80), out / "embeddings.parquet")
    return str(out)


@pytest.fixture(scope="module")
def graph(spark, sf):
    """Node ids, and the dense transition matrix that the queries walk on."""
    e = QUERIES["g2_symmetrise"](spark, sf).toPandas()
    ids = np.unique(e.src)
    a = np.zeros((len(ids), len(ids)))
    a[np.searchsorted(ids, e.src), np.searchsorted(ids, e.dst)] = e.w
    return ids, a / a.sum(1, keepdims=True)


def solved(ids, t, marks):
    """Where walks are absorbed, by a linear solve; landmarks absorb themselves."""
    at = np.isin(ids, marks)
    x = np.eye(len(ids))[:, at]
    x[~at] = np.linalg.solve(np.eye((~at).sum()) - t[np.ix_(~at, ~at)], t[np.ix_(~at, at)])
    return ids[at], x


def dense(rows, left, right):
    out = np.zeros((len(left), len(right)))
    for a, b, w in rows.collect():
        out[np.searchsorted(left, a), np.searchsorted(right, b)] = w
    return out


def test_absorption_is_the_linear_solve(spark, sf, graph):
    marks = np.array(sorted(r["node"] for r in QUERIES["l1_random"](spark, sf).collect()))
    marks, want = solved(*graph, marks)
    got = dense(QUERIES["c8_absorption"](spark, sf).select("state", "lm", "p"), graph[0], marks)
    assert np.allclose(got, want, atol=2e-6) and np.allclose(got.sum(1), 1, atol=1e-4)
    gram = want.T @ want
    got = dense(QUERIES["c8_exact"](spark, sf).select("src", "dst", "w"), marks, marks)
    assert np.allclose(got, gram / gram.sum(1, keepdims=True), atol=2e-6)


def uniform(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12], 16) / 2**48


def walked(ids, t, starts, stop):
    """(state, walk, node, steps) of 100 walks of each start, one after the other."""
    high, out = np.cumsum(t, 1), []
    for s in starts:
        for walk in range(100):
            at = s
            for step in range(1, 1001):
                at = ids[np.searchsorted(high[np.searchsorted(ids, at)], uniform(42, s, walk, step), "right")]
                if stop(s, at):
                    out.append((s, walk, at, step))
                    break
    return out


def rates(found, left, right, name=lambda x: x):
    out = np.zeros((len(left), len(right)))
    for s, _, e, _ in found:
        out[np.searchsorted(left, name(s)), np.searchsorted(right, name(e))] += 1
    return out / out.sum(1, keepdims=True)


def test_walks_are_the_plain_walks(spark, sf, graph):
    ids, t = graph
    order = sorted(ids, key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    marks = np.array(sorted(order[: len(ids) // 5]))
    held = set(marks)
    want = walked(ids, t, marks, lambda s, e: e in held and e != s)
    assert len(want) == 100 * len(marks) and max(x[3] for x in want) > 12
    assert {tuple(r) for r in QUERIES["c5_walks"](spark, sf).collect()} == set(want)
    got = dense(QUERIES["c6_landmark_walks"](spark, sf).select("src", "dst", "w"), marks, marks)
    assert np.allclose(got, rates(want, marks, marks), atol=2e-6)
    x = rates(walked(ids, t, ids, lambda s, e: e in held), ids, marks)
    gram = x.T @ x
    got = dense(QUERIES["c7_state_walks"](spark, sf).select("src", "dst", "w"), marks, marks)
    assert np.allclose(got, gram / gram.sum(1, keepdims=True), atol=2e-6)


def test_cluster_walks_are_the_plain_walks(spark, sf, graph):
    own = {r["node"]: r["cluster"] for r in QUERIES["c9_grow_clusters"](spark, sf).collect()}
    names = np.unique(list(own.values()))
    want = rates(walked(*graph, sorted(own), lambda s, e: own[e] != own[s]), names, names, own.get)
    got = dense(QUERIES["c10_cluster_walks"](spark, sf).select("src", "dst", "w"), names, names)
    assert np.allclose(got, want, atol=2e-6)


def test_most_visited_nodes_by_the_plain_distribution(spark, sf, graph):
    ids, t = graph
    order = np.lexsort((ids, ids % 256))
    w = (np.full(len(ids), 1 / len(ids)) @ np.linalg.matrix_power(t, 50))[order]
    high = np.cumsum(w / w.sum())
    hits = np.bincount(np.searchsorted(high, [uniform(42, i) for i in range(100 * len(ids))], "right"), minlength=len(ids))
    most = sorted(zip(-hits, ids[order], strict=True))[: len(ids) // 10]
    assert sorted(r["node"] for r in QUERIES["l3_random_walks"](spark, sf).collect()) == sorted(n for _, n in most)


def shortest(a):
    """All distances by Floyd and Warshall; a: lengths, infinite where there is no edge."""
    d = np.where(np.eye(len(a), dtype=bool), 0, a)
    for k in range(len(d)):
        d = np.minimum(d, d[:, k : k + 1] + d[k])
    return d


def test_centralities_have_all_nodes(spark, sf, graph):
    ids, t = graph
    d = shortest(np.where(t > 0, 1.0, np.inf))
    want = np.where(d > 0, 1 / np.where(d > 0, d, 1), 0).sum(0) / (len(ids) - 1)
    got = dict(QUERIES["m1_harmonic"](spark, sf).select("node", "value").collect())
    assert sorted(got) == ids.tolist() and np.allclose([got[i] for i in ids], want, atol=2e-6)
    e = QUERIES["g1_knn"](spark, sf).toPandas()
    a = np.full((len(ids), len(ids)), np.inf)
    a[np.searchsorted(ids, e.src), np.searchsorted(ids, e.dst)] = 1 / (1 + e.d)
    d = shortest(a)
    want = [sum((d[:, v : v + 1] + d[v] <= d + 1e-9)[np.ix_(o, o)][np.isfinite(d[np.ix_(o, o)]) & ~np.eye(len(o), dtype=bool)].sum() for o in [np.delete(np.arange(len(ids)), v)]) for v in range(len(ids))]
    got = dict(QUERIES["m2_betweenness_weighted"](spark, sf).select("node", "value").collect())
    assert np.abs(np.array([got[i] for i in ids]) - want).max() <= 2 and sum(want) > 1000


def test_metric_bundles_take_all_nodes(spark, sf, monkeypatch):
    from stratagraph.operators import metrics

    sources, plain = [], metrics.harmonic_centrality
    monkeypatch.setattr(metrics, "harmonic_centrality", lambda g, s: (sources.append(s.count()), plain(g, s))[1])
    assert QUERIES["m11_metric_bundles"](spark, sf).count() > 0
    assert sources[0] == 80
