"""Helpers that the corpus operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import give_back

#: Rows in an Arrow batch: whole texts can be long, so a batch must stay small.
BATCH_ROWS = 2000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, by a path that Spark's readers open."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) under internal names; a null text counts as empty, other columns go."""
    return df.select(
        df[id_col].cast("long").alias("__id"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).alias("__text"),
    )


def sha256_hex(col: Column) -> Column:
    return F.sha2(col, 256)


def checkpoint_dir(spark: SparkSession) -> None:
    """Cluster's shared checkpoint folder if it names one, else one for this machine (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(folder or "/tmp/checkpoints")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable copy in the shared folder."""
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    give_back(df.sparkSession)
    return out


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Removes the copy that ``checkpoint`` made, once nothing will read it again; of another frame, nothing.

    The driver's collector runs too: it tells Spark which shuffles of earlier steps can be removed.
    """
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return
    file = plan.rdd().getCheckpointFile()
    if file.isDefined():
        remove(df.sparkSession, file.get())
        give_back(df.sparkSession, 0)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random odd-mixed 64-bit value for each byte, from a rule.
BYTE_VALUES = mix64((np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
#: Base of the polynomial hashes, odd and so invertible modulo 2**64.
BASE = 0xD6E8FEB86659FD93
BASE_INVERSE = pow(BASE, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next call."""
    out = _POWERS.get(base, np.ones(1, np.uint64))
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    _POWERS[base] = out
    return out[:n]


class SpanHash:
    """Hashes of any spans of a byte array; equal bytes, equal hash, wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers(BASE, n), dtype=np.uint64, out=self.prefix[1:])
        self.inverse = powers(BASE_INVERSE, n + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        return mix64(raw + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
