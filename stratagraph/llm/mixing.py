"""Mixing sources to target weights by Pfair scheduling.

Rows of a source, in the order of a seeded hash, form blocks. With the exact share w of a
source (its weight over the sum of the weights, as whole numbers, not rounded), block j may
start at slot floor(j/w) and must be done by slot ceil((j+1)/w); of the blocks that may start,
the one with the earliest deadline gets the slot. All slots are taken and every deadline is
met, so after any number of slots each source is less than one block from its share. When a
source runs out, the others go on in a new phase with their weights scaled up, so every row
gets a place; the bound holds in each phase from its start.

The schedule is made on the driver, a step a block, and kept as two bytes a block; blocks have
``BLOCK`` rows, or as many more as keep the steps at ``MOST_STEPS``, so the driver's part has a
bound. Spark gets it as a table of (source, block, slot), which is broadcast up to
``BROADCAST_BLOCKS`` rows.

The order within a source hashes the id and all other columns, so null ids and repeated ids are
dealt out like others.

Defined cases: a null source is a source of its own (its weight is that of the key None); null
ids and texts are kept; rows equal in all columns are interchangeable; empty tables give empty
results; sources without a weight raise, and so do columns with reserved names (``__block`` and
such). The number of sources must be at most MOST_SOURCES: their counts are kept on the driver,
and checked.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, SEED, MOST_SOURCES, BUCKET_ROWS, MOST_STEPS = 64, 17, 2000, 2000, 4_000_000
#: Blocks whose slots are broadcast; more are joined by a shuffle.
BROADCAST_BLOCKS = 200_000


def whole(weights: dict) -> dict:
    """Whole numbers in exactly the ratio of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * scale) for s, x in exact.items()}


def one_phase(n: list[int], left: list[int], out: array) -> None:
    """Appends the sources of the slots, earliest deadline first, until one has no block left; n: whole weights."""
    total, at, t = sum(n), [0] * len(n), 0
    waiting, ready = [(0, k) for k in range(len(n))], []
    while True:
        while waiting and waiting[0][0] <= t:
            k = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(at[k] + 1) * total // n[k]), at[k], k))
        deadline, j, k = heapq.heappop(ready)
        if t >= deadline:
            raise AssertionError("a deadline was missed")
        out.append(k)
        t += 1
        at[k] = j + 1
        if at[k] == left[k]:
            break
        heapq.heappush(waiting, ((j + 1) * total // n[k], k))
    for k, done in enumerate(at):
        left[k] -= done


def plan(blocks: dict, weights: dict) -> tuple[list, array]:
    """The sources in order, and for every slot the place of its source in them."""
    names = sorted((s for s, b in blocks.items() if b > 0), key=str)
    n = whole({s: weights[s] for s in names}) if names else {}
    left, order = {k: blocks[s] for k, s in enumerate(names)}, array("H")
    while left:
        now, ks = array("H"), list(left)
        rest = list(left.values())
        one_phase([n[names[k]] for k in ks], rest, now)
        order.extend(array("H", (ks[k] for k in now)))
        left = {k: b for k, b in zip(ks, rest, strict=True) if b}
    return names, order


def slots_of(names: list, order: array) -> pa.Table:
    """(__name, __of, __slot): the slot of each block of each source."""
    at = np.frombuffer(order, np.uint16) if len(order) else np.empty(0, np.uint16)
    slot = np.argsort(at, kind="stable")
    source = at[slot]
    first = np.searchsorted(source, source, "left") if len(source) else source
    return pa.table({
        "__name": pa.array(names, pa.string()).take(pa.array(source)),
        "__of": pa.array(np.arange(len(slot)) - first, pa.int64()),
        "__slot": pa.array(slot, pa.int64()),
    })


def tempered(counts: dict, power: float = 0.5) -> dict:
    """Target weights that lift small sources: rows to the given power."""
    return {s: max(n, 1) ** power for s, n in counts.items()}


def _hashed(df: DataFrame, source_col: str, id_col: str, seed: int) -> DataFrame:
    every = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns)))
    return df.withColumns({"__source": df[source_col].cast("string"), "__hash": F.xxhash64(F.lit(seed), df[id_col], every)})


def mix(df: DataFrame, weights: dict | None = None, source_col: str = "source", id_col: str = "doc_id", block: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows with __block (of their source), __slot and __position; sorting by position mixes them.

    weights: source to target weight; None: the square roots of the row counts. block: rows of a block.
    """
    spark = df.sparkSession
    clash = {"__source", "__hash", "__bucket", "__high", "__row", "__block", "__slot", "__position", "__name", "__of", "__at"}.intersection(df.columns)
    if clash:
        raise ValueError(f"reserved column names: {sorted(clash)}")
    rows = _hashed(df, source_col, id_col, seed)
    total = {r["__source"]: r["n"] for r in rows.groupBy("__source").agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(total) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    weights = tempered(total) if weights is None else weights
    if missing := [s for s in total if not weights.get(s, 0) > 0]:
        raise ValueError(f"no positive weight for {missing}")
    block = block or max(BLOCK, -(-sum(total.values()) // MOST_STEPS))
    steps = slots_of(*plan({s: -(-n // block) for s, n in total.items()}, weights))
    few = steps.num_rows <= BROADCAST_BLOCKS
    steps = spark.createDataFrame(steps, "__name string, __of long, __slot long")
    # A row's number in its source: rows before its hash range, and its place in the range. Ranges
    # are summed in two steps, so that the sums of a source's ranges are no single task's.
    bits = max(0, math.ceil(math.log2(max(1, max(total.values(), default=0) / BUCKET_ROWS))))
    bucket = F.shiftrightunsigned("__hash", 64 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn("__bucket", bucket)
    sizes = rows.groupBy("__source", "__bucket").agg(F.count("*").alias("n")).withColumn("__high", F.shiftright("__bucket", bits // 2))
    ahead = lambda *by: F.sum("n").over(Window.partitionBy("__source", *by[:-1]).orderBy(by[-1])) - F.col("n")
    high = sizes.groupBy("__source", "__high").agg(F.sum("n").alias("n")).select(F.col("__source").alias("__name"), F.col("__high").alias("__of"), ahead("__high").alias("above"))
    low = sizes.withColumn("below", ahead("__high", "__bucket"))
    before = low.join(high, F.col("__source").eqNullSafe(F.col("__name")) & (F.col("__high") == F.col("__of"))).select("__source", "__bucket", (F.col("above") + F.col("below")).alias("before"))
    rows = rows.withColumn("__row", F.row_number().over(Window.partitionBy("__source", "__bucket").orderBy(F.shiftrightunsigned("__hash", 32), "__hash", id_col)) - 1)
    rows = rows.alias("r").join(before.alias("b"), F.col("r.__source").eqNullSafe(F.col("b.__source")) & (F.col("r.__bucket") == F.col("b.__bucket"))).select("r.*", (F.col("b.before") + F.col("r.__row")).alias("__at"))
    rows = rows.withColumn("__block", F.floor(F.col("__at") / block).cast("long"))
    joined = rows.join(F.broadcast(steps) if few else steps, F.col("__source").eqNullSafe(F.col("__name")) & (F.col("__block") == F.col("__of")))
    out = joined.select(*[F.col(f"`{c}`") for c in df.columns], "__block", "__slot", "__at")
    return out.withColumn("__position", F.col("__slot") * block + F.col("__at") % block).drop("__at")


def mixed(df: DataFrame, **options) -> DataFrame:
    """The rows in mixed order, with their own columns; written as files, ``places`` reads the order back."""
    return mix(df, **options).orderBy("__position").drop("__block", "__slot", "__position")


def places(df: DataFrame, name: str = "position") -> DataFrame:
    """The rows of a table of Parquet files with their place (from 0) in the order that they were written in.

    Files are written in order, numbered in their names, and have numbered rows; rows before a
    file are a sum over files. Rows that come from no file have no place (null).
    """
    try:
        at = df.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return df.withColumn(name, F.lit(None).cast("long"))
    number = F.regexp_extract("__file", r"part-(\d+)", 1)
    files = at.groupBy("__file").agg(F.count("*").alias("n"))
    files = files.select("__file", (F.sum("n").over(Window.orderBy(F.length(number), number, "__file")) - F.col("n")).alias("__before"))
    small = files.count() <= BROADCAST_BLOCKS
    return at.join(F.broadcast(files) if small else files, "__file").withColumn(name, F.col("__before") + F.col("__row")).drop("__file", "__row", "__before")
