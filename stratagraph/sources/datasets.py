"""Datasets: readers of image, table and array files, generators of toy shapes, and sinks.

All give (node, features array<double>[, label]); files are read by Spark's readers only.
"""

from __future__ import annotations

import hashlib
import io
import json
import pickle
import struct
from collections.abc import Callable
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.features import tfidf
from ..functions.hashing import normal, uniform
from ..functions.session import numbered

DATASETS: dict[str, Callable] = {}
POINTS = "node long, features array<double>, label double"
# Class names by code.
FASHION = ("T-shirt/top", "Trouser", "Pullover", "Dress", "Coat", "Sandal", "Shirt", "Sneaker", "Bag", "Ankle boot")
CIFAR10 = ("airplane", "automobile", "bird", "cat", "deer", "dog", "frog", "horse", "ship", "truck")


def dataset(name: str):
    def put(f):
        DATASETS[name] = f
        return f

    return put


def load_dataset(spark: SparkSession, kind: str, **options) -> DataFrame:
    """A dataset by name; an unknown name raises."""
    if kind.upper() not in DATASETS:
        raise ValueError(f"unknown dataset {kind}: {sorted(DATASETS)}")
    return DATASETS[kind.upper()](spark, **options)


def combine(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two splits as one, the second's nodes numbered after the first's."""
    n = first.agg(F.coalesce(F.max("node") + 1, F.lit(0))).first()[0]
    return first.unionByName(second.withColumn("node", F.col("node") + n))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def parse_idx(data: bytes) -> np.ndarray:
    """An IDX file of unsigned bytes: labels (magic 2049) or images (magic 2051)."""
    magic = struct.unpack_from(">I", data)[0]
    if magic not in (2049, 2051):
        raise ValueError(f"magic number {magic}, 2049 or 2051 expected")
    dims = magic & 255
    shape = struct.unpack_from(f">{dims}I", data, 4)
    return np.frombuffer(data, np.uint8, int(np.prod(shape)), 4 + 4 * dims).reshape(shape[0], -1)


def _numbered(spark, images: str, labels: str, parse) -> DataFrame:
    """Points of an image file and labels of a label file, joined by position."""

    def run(batches):
        for b in batches:
            for data in b.column(1).to_pylist():
                rows = parse(data)
                for i in range(0, len(rows), 1000):
                    part = rows[i : i + 1000].astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part))), pa.array(part.tolist(), pa.list_(pa.float64()))], ["node", "features"])

    x = _files(spark, images).mapInArrow(run, "node long, features array<double>")
    y = _files(spark, labels).mapInArrow(run, "node long, features array<double>").select("node", F.element_at("features", 1).alias("label"))
    return x.join(y, "node")


@dataset("MNIST")
def mnist(spark: SparkSession, directory: str) -> DataFrame:
    parts = [_numbered(spark, f"{directory}/{p}-images*", f"{directory}/{p}-labels*", parse_idx) for p in ("train", "t10k")]
    return combine(*parts)


@dataset("FMNIST")
def fmnist(spark: SparkSession, directory: str) -> DataFrame:
    """CSV files with the column label, then pixels by position; train first."""

    def one(name: str) -> DataFrame:
        df = spark.read.csv(f"{directory}/{name}", header=True)
        pixels = [c for c in df.columns if c != "label"]
        rows = df.select(F.monotonically_increasing_id().alias("at"), F.col("label").cast("double").alias("label"), F.array(*[F.col(f"`{c}`").cast("double") for c in pixels]).alias("features"))
        return _dense(rows, "at")

    return combine(one("fashion-mnist_train.csv"), one("fashion-mnist_test.csv"))


def _dense(rows: DataFrame, order: str) -> DataFrame:
    """Nodes 0..n-1 in the order of a partition-wise id (its high bits are the partition)."""
    part = F.shiftright(order, 33)
    sizes = rows.groupBy(part.alias("p")).agg(F.count("*").alias("n"))
    before = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))  # a row a partition
    low = F.col(order).bitwiseAND((1 << 33) - 1)
    return rows.withColumn("p", part).join(F.broadcast(before), "p").withColumn("node", F.col("before") + low).drop("p", "before", order)


class _Plain(pickle.Unpickler):
    """Reads pickles of plain data and numpy arrays only."""

    ALLOWED = {("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("_codecs", "encode")}

    def find_class(self, module, name):
        if (module, name) not in self.ALLOWED:
            raise pickle.UnpicklingError(f"{module}.{name} is not plain data")
        return super().find_class(module, name)


@dataset("CIFAR")
def cifar(spark: SparkSession, directory: str) -> DataFrame:
    """Batch files of rows and labels; only plain data is unpickled."""

    def run(batches):
        for b in batches:
            for data in b.column(1).to_pylist():
                d = _Plain(io.BytesIO(data), encoding="bytes").load()
                x = np.asarray(d[b"data"], float)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(np.asarray(d[b"labels"], float))], ["node", "features", "label"])

    parts = [_files(spark, f"{directory}/{name}").mapInArrow(run, POINTS) for name in [f"data_batch_{k}" for k in range(1, 6)] + ["test_batch"]]
    out = parts[0]
    for p in parts[1:]:
        out = combine(out, p)
    return out


@dataset("TASIC")
def tasic(spark: SparkSession, directory: str | None = None, points: str = "tasic-pca50.npy", types: str = "tasic-ttypes.npy", colors: str = "tasic-colors.npy") -> DataFrame:
    """Three .npy files, of a directory if it is named; also the class name, its code among the sorted names and its first colour."""
    points, types, colors = (f"{directory}/{x}" if directory else x for x in (points, types, colors))

    def run(batches):
        for b in batches:
            for data in b.column(1).to_pylist():
                a = np.load(io.BytesIO(data), allow_pickle=False)
                a = a.reshape(len(a), -1).astype(str)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(a))), pa.array(a.tolist(), pa.list_(pa.string()))], ["node", "v"])

    x, t, c = (_files(spark, p).mapInArrow(run, "node long, v array<string>") for p in (points, types, colors))
    named = t.select("node", F.element_at("v", 1).alias("type")).join(c.select("node", F.element_at("v", 1).alias("own_color")), "node")
    classes = named.groupBy("type").agg(F.min_by("own_color", "node").alias("color"))
    classes = classes.withColumn("label", (F.row_number().over(Window.orderBy("type")) - 1).cast("double"))  # classes are few
    return x.select("node", F.col("v").cast("array<double>").alias("features")).join(named, "node").join(F.broadcast(classes), "type").select("node", "features", "label", "type", "color")


@dataset("20NEWSGROUP")
def newsgroups(spark: SparkSession, directory: str, dims: int = 1024) -> DataFrame:
    """(node, features, label, type) of text files in a folder for each group, numbered by path; labels by sorted group.

    features: TF-IDF weights added up, with a sign, in ``dims`` places that the terms' hashes name;
    products of documents keep their values on average. ``newsgroup_terms`` has the terms themselves.
    """
    docs = _posts(spark, directory)
    place = F.xxhash64("term")
    cells = newsgroup_terms(spark, directory).groupBy(F.col("doc").alias("node"), F.pmod(place, F.lit(dims)).cast("int").alias("i")).agg(F.sum(F.when(F.shiftright(place, 40) % 2 == 0, F.col("weight")).otherwise(-F.col("weight"))).alias("x"))
    held = cells.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
    zeros = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    features = F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), dims)).otherwise(zeros)
    return docs.join(held, "node", "left").select("node", features.alias("features"), "label", "type")


def newsgroup_terms(spark: SparkSession, directory: str) -> DataFrame:
    """(doc, term, weight): the sparse TF-IDF of the same documents."""
    return tfidf(_posts(spark, directory).select(F.col("node").alias("doc"), "text"))


def _posts(spark: SparkSession, directory: str) -> DataFrame:
    """(node, text, label, type) of directory/group/file; bytes are read as Latin-1, as posts have no common encoding."""
    files = spark.read.format("binaryFile").load(f"{directory}/*/*").select("path", F.decode("content", "ISO-8859-1").alias("text"))
    files = numbered(files, "path", "node").withColumn("type", F.element_at(F.split("path", "/"), -2))
    groups = files.select("type").distinct()
    return files.join(F.broadcast(numbered(groups, "type", "label")), "type").select("node", "text", F.col("label").cast("double").alias("label"), "type")


@dataset("SWISSROLL")
def swissroll(spark: SparkSession, n_circles: float = 2.5, n: int = 5000, noise: float = 0.0, seed: int = 42) -> DataFrame:
    ids = spark.range(n).withColumnRenamed("id", "node")
    t = F.lit(n_circles * pi) * (1 + 2 * uniform(seed, F.col("node"), "t"))
    rows = ids.select("node", t.alias("t"), (21 * uniform(seed, F.col("node"), "h")).alias("h"))
    shake = [normal(seed, F.col("node"), k) * noise if noise else F.lit(0.0) for k in range(3)]
    xyz = (F.col("t") * F.cos("t"), F.col("h"), F.col("t") * F.sin("t"))
    return rows.select("node", F.array(*[c + s for c, s in zip(xyz, shake, strict=True)]).alias("features"), F.col("t").alias("label"))


def _helix(spark: SparkSession, n: int, n_circles: int = 2) -> DataFrame:
    """(strand, i, t, x, y, z) of two strands with n points each, t in [0, 2 pi n_circles]."""
    i = spark.range(n).withColumnRenamed("id", "i")
    rows = i.select("i", (F.col("i") * (2 * pi * n_circles) / max(n - 1, 1)).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("strand"))
    angle = F.col("t") + F.col("strand") * pi
    return rows.select("strand", "i", "t", F.cos(angle).alias("x"), F.sin(angle).alias("y"), F.col("t").alias("z"))


@dataset("DOUBLEHELIX")
def doublehelix(spark: SparkSession, num_points: int = 500) -> DataFrame:
    return _helix(spark, num_points).select((F.col("strand") * num_points + F.col("i")).alias("node"), F.array("x", "y", "z").alias("features"), F.col("t").alias("label"))


@dataset("DNA")
def dna(spark: SparkSession, num_points: int = 12000, n_per_strand: int = 800, n_connections_per_circle: int = 6, n_circles: int = 2) -> DataFrame:
    """Two strands and straight rungs between them; z is scaled to end 1 above its start at -1."""
    rungs = n_circles * n_connections_per_circle
    side = (num_points - rungs * n_per_strand) // 2
    helix = _helix(spark, side, n_circles)
    strands = helix.select((F.col("strand") * side + F.col("i")).alias("node"), "x", "y", "z", F.col("t").alias("label"))
    at = [round(k * (side - 1) / max(rungs - 1, 1)) for k in range(rungs)]
    marks = spark.createDataFrame(list(enumerate(at)), "rung long, i long")
    ends = helix.join(F.broadcast(marks), "i")
    a, b = (ends.where(F.col("strand") == s).select("rung", *[F.col(c).alias(f"{c}{s}") for c in "xyz"], F.col("t").alias(f"t{s}")) for s in (0, 1))
    steps = F.explode(F.sequence(F.lit(0), F.lit(n_per_strand - 1)))
    line = a.join(b, "rung").withColumn("j", steps).withColumn("f", F.col("j") / max(n_per_strand - 1, 1))
    rows = line.select((2 * side + F.col("rung") * n_per_strand + F.col("j")).alias("node"), *[(F.col(f"{c}0") + F.col("f") * (F.col(f"{c}1") - F.col(f"{c}0"))).alias(c) for c in "xyz"], F.col("t0").alias("label"))
    every = strands.unionByName(rows)
    top, low = 2 * pi * n_circles, 0.0
    return every.select("node", F.array("x", "y", F.col("z") * 2 / top - low - 1).alias("features"), "label")


@dataset("TORUS")
def torus(spark: SparkSession, num_points: int = 2500, big: float = 1.0, small: float = 0.3) -> DataFrame:
    side = int(num_points**0.5)
    step = 2 * pi / max(side - 1, 1)
    rows = spark.range(side * side).select(F.col("id").alias("node"), (F.col("id") % side * step).alias("u"), (F.floor(F.col("id") / side) * step).alias("v"))
    ring = F.lit(big) + small * F.cos("v")
    z = small * F.sin("v")
    return rows.select("node", F.array(ring * F.cos("u"), ring * F.sin("u"), z).alias("features"), z.alias("label"))


@dataset("GAUSSIANS")
def gaussians(spark: SparkSession, means: list[list[float]], covariances: list, n: int | list[int], seed: int = 42) -> DataFrame:
    """n points of each normal distribution (or as many as listed), labelled by its number."""
    counts = [n] * len(means) if isinstance(n, int) else n
    out, first = None, 0
    for k, (mean, cov, count) in enumerate(zip(means, covariances, counts, strict=True)):
        lower = np.linalg.cholesky(np.array(cov, float))
        ids = spark.range(first, first + count).withColumnRenamed("id", "node")
        z = [normal(seed, F.col("node"), j) for j in range(len(mean))]
        xs = [sum((F.lit(float(lower[i, j])) * z[j] for j in range(i + 1)), F.lit(float(mean[i]))) for i in range(len(mean))]
        rows = ids.select("node", F.array(*xs).alias("features"), F.lit(float(k)).alias("label"))
        out, first = rows if out is None else out.unionByName(rows), first + count
    return out


# Sinks and caches.


def save_levels(levels, path: str) -> None:
    """Each level's tables as Parquet, partitioned by level."""
    for x in levels:
        for name, df in (("transition", x.transition), ("landmarks", x.landmarks), ("influence", x.coarse.influence), ("weights", x.coarse.weights)):
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}/level={x.level}")


def load_levels(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def cache_table(spark: SparkSession, path: str, config: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """A Parquet table under the hash of its configuration: reread if it was finished, else made."""
    at = f"{path}/{hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
