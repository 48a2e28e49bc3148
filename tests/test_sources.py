import inspect
import io
import pickle
import struct

import numpy as np
import pytest

from stratagraph import cli
from stratagraph.functions.features import add_noise
from stratagraph.sources import datasets as D
from stratagraph.streaming.refresh import refresh


def test_idx_files(spark, tmp_path):
    for k, name in enumerate(("train", "t10k")):
        x = np.arange(12, dtype=np.uint8) + k
        (tmp_path / f"{name}-images.idx3-ubyte").write_bytes(struct.pack(">IIII", 2051, 3, 2, 2) + x.tobytes())
        (tmp_path / f"{name}-labels.idx1-ubyte").write_bytes(struct.pack(">II", 2049, 3) + bytes([7, 8, 9]))
    rows = D.load_dataset(spark, "mnist", directory=str(tmp_path)).orderBy("node").collect()
    assert [r["node"] for r in rows] == list(range(6)) and [r["label"] for r in rows] == [7, 8, 9] * 2
    assert rows[4]["features"] == [5.0, 6.0, 7.0, 8.0]
    with pytest.raises(ValueError):
        D.parse_idx(struct.pack(">II", 7, 0))


def test_csv_files(spark, tmp_path):
    for k, name in enumerate(("train", "test")):
        (tmp_path / f"fashion-mnist_{name}.csv").write_text("label,pixel1,pixel2\n" + "".join(f"{k},{i},{i + 1}\n" for i in range(3)))
    rows = D.load_dataset(spark, "FMNIST", directory=str(tmp_path)).orderBy("node").collect()
    assert [(r["node"], r["label"], r["features"]) for r in rows] == [(3 * k + i, k, [i, i + 1]) for k in range(2) for i in range(3)]


def test_pickle_files(spark, tmp_path):
    for k, name in enumerate([f"data_batch_{j}" for j in range(1, 6)] + ["test_batch"]):
        (tmp_path / name).write_bytes(pickle.dumps({b"data": np.full((2, 3), k, np.uint8), b"labels": [k, k]}))
    rows = D.load_dataset(spark, "CIFAR", directory=str(tmp_path)).orderBy("node").collect()
    assert [(r["node"], r["label"], r["features"][0]) for r in rows] == [(i, i // 2, i // 2) for i in range(12)]
    with pytest.raises(pickle.UnpicklingError):
        D._Plain(io.BytesIO(pickle.dumps(print))).load()


def test_array_files(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.arange(6.0).reshape(3, 2))
    np.save(tmp_path / "t.npy", np.array(["b", "a", "b"]))
    np.save(tmp_path / "c.npy", np.array(["red", "blue", "green"]))
    rows = D.load_dataset(spark, "TASIC", points=f"{tmp_path}/x.npy", types=f"{tmp_path}/t.npy", colors=f"{tmp_path}/c.npy").orderBy("node").collect()
    assert [(r["features"], r["label"], r["type"], r["color"]) for r in rows] == [([0, 1], 1, "b", "red"), ([2, 3], 0, "a", "blue"), ([4, 5], 1, "b", "red")]


def test_names_and_noise(spark):
    with pytest.raises(ValueError):
        D.load_dataset(spark, "nothing")
    roll = D.load_dataset(spark, "SWISSROLL", n=20, noise=0.1)
    assert add_noise(roll, 0, 1) is roll and add_noise(roll, 1.0, 1).count() == 20
    assert all(0 <= x <= 255 for r in add_noise(roll, 0.5, 1, "MNIST").collect() for x in r["features"])


def test_cache(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for config in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert D.cache_table(spark, str(tmp_path), config, make).count() == 3
    assert len(made) == 2


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(D.DATASETS, "TORUS", lambda s: D.torus(s, 100))
    cli.run(spark, ["--dataset", "TORUS", "--sampling", "HUBS", "--connection", "SL-BFS", "--level", "2", "--output", str(tmp_path / "out"), "--k", "5", "--reduction", "0.3", "--no-directed"])
    got = D.load_levels(spark, str(tmp_path / "out"), "embedding").groupBy("level").count().collect()
    assert {r["level"] for r in got} == {1, 2}


def test_command_line_choices(spark, tmp_path, monkeypatch):
    """Datasets of files load from a directory, weights reach the graphs, and every choice has what it needs."""
    np.save(tmp_path / "tasic-pca50.npy", np.random.default_rng(0).normal(size=(40, 3)))
    np.save(tmp_path / "tasic-ttypes.npy", np.array(["a", "b"] * 20))
    np.save(tmp_path / "tasic-colors.npy", np.array(["red", "blue"] * 20))
    for group in ("alt.x", "sci.y"):
        (tmp_path / "news" / group).mkdir(parents=True)
        for k in range(12):
            (tmp_path / "news" / group / f"{k}").write_bytes(f"post {k} of {group} with words{k % 5} caf\xe9".encode("latin-1"))
    seen, plain = [], cli.build
    monkeypatch.setattr(cli, "build", lambda *a: (seen.append(a[5:]), plain(*a))[1])
    for name, directory in (("TASIC", tmp_path), ("20NEWSGROUP", tmp_path / "news")):
        cli.run(spark, ["--dataset", name, "--directory", str(directory), "--connection", "LL-BFS", "--output", str(tmp_path / f"out-{name}"), "--k", "3", "--reduction", "0.5"])
        assert D.load_levels(spark, str(tmp_path / f"out-{name}"), "embedding").count() > 5
    assert seen == [(False, True)] * 2
    news = D.load_dataset(spark, "20NEWSGROUP", directory=str(tmp_path / "news"), dims=64).orderBy("node").collect()
    assert [r["label"] for r in news] == [0.0] * 12 + [1.0] * 12 and all(len(r["features"]) == 64 for r in news)
    given = {"directory"}
    for name in set(D.DATASETS) - {"GAUSSIANS"}:
        need = {k for k, p in inspect.signature(D.DATASETS[name]).parameters.items() if p.default is inspect.Parameter.empty} - {"spark"}
        assert need <= given


def test_dna_of_several_circles(spark):
    rows = D.load_dataset(spark, "DNA", num_points=500, n_per_strand=10, n_circles=3).orderBy("node").collect()
    x = np.array([r["features"] for r in rows])
    side = (500 - 18 * 10) // 2
    t = np.linspace(0, 6 * np.pi, side)
    assert np.allclose(x[:side], np.stack([np.cos(t), np.sin(t), 2 * t / (6 * np.pi) - 1], 1)) and len(rows) == 2 * side + 180
    assert np.isclose(rows[side - 1]["label"], 6 * np.pi)


def test_stream_of_edges(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(0, 1, 1.0), (0, 1, 3.0)], "src long, dst long, w double").coalesce(1).write.parquet(source)
    args = lambda: (spark.readStream.schema("src long, dst long, w double").parquet(source), str(tmp_path / "out"), str(tmp_path / "cp"))
    refresh(*args()).awaitTermination()
    spark.createDataFrame([(0, 1, 2.0), (1, 2, 5.0)], "src long, dst long, w double").coalesce(1).write.mode("append").parquet(source)
    refresh(*args()).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out" / "version=1")).collect()
    assert {(r["src"], r["dst"], r["w"]) for r in rows} == {(0, 1, 3.0), (1, 2, 5.0)}
