"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and the residual codebooks are fitted on at most ``SAMPLE`` vectors (smallest
hashes first); every vector is indexed by its cell and the codes of its residual. A query visits
its nearest cells until they hold a share of all rows (``LEAST`` rows at least), reads distances
from its table of products with the codes, and the best ``RERANK`` rows are ranked again by
exact distances of the original vectors. The share is measured on the sample: it is what
``TARGET`` of the exact neighbours of ``TRIED`` sampled vectors need. Vectors in clusters need a
small share; vectors without structure a large one, whatever the index.

Cells are packed into blocks of about ``BLOCK_ROWS`` rows; a larger cell is dealt to several
blocks, so equal vectors or a hot cell make no large task. Equal vectors have equal codes, and
ties go to smaller ids, before the reranking as after it.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do null ids; vectors of different lengths have no distance, so each length is searched
by itself; rows that repeat an id are candidates each, also of one another, and each is a query
with its own ten rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

SAMPLE, LISTS, ROUNDS, SEED = 20_000, 2048, 8, 23
SUB_DIMS, CODES = 4, 256
TARGET, TRIED = 0.96, 400
LEAST, RERANK, BLOCK_ROWS, QUERY_BLOCK = 2000, 300, 20_000, 20_000
RESULT = "query_id long, rank int, vec_id long, score double"


def valid(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v, h, n): usable vectors as doubles, with a hash of the vector; n rows have this id and vector."""
    v = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    return v.groupBy("id", "v").agg(F.count("*").alias("n")).select("id", "v", F.xxhash64("v").alias("h"), "n")


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = np.argmin((c * c).sum(1)[None, :] - 2 * x[i : i + 4096] @ c.T, 1)
    return out


def kmeans(x: np.ndarray, k: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of distinct starting rows; a centroid that loses all its rows stays where it is."""
    rows = np.unique(x, axis=0)
    c = rows[np.random.default_rng(seed).permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        a = _nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        starts = (np.cumsum(n) - n)[n > 0]
        c[n > 0] = np.add.reduceat(x[np.argsort(a, kind="stable")], starts) / n[n > 0, None]
    return c


class Index:
    """Coarse centroids, residual codebooks and the share of rows to visit; its size does not depend on the rows.

    sample: a row a vector, one at least; equal vectors make fewer centroids, and a sample too small
    to have neighbours asks for all rows.
    """

    def __init__(self, sample: np.ndarray, rows: int):
        self.dims = sample.shape[1]
        self.cells = kmeans(sample, int(min(LISTS, max(1, round(4 * rows**0.5)), max(1, len(sample) // 8))))
        own = _nearest(sample, self.cells)
        residual = sample - self.cells[own]
        self.parts = [slice(i, min(i + SUB_DIMS, self.dims)) for i in range(0, self.dims, SUB_DIMS)]
        self.books = [kmeans(residual[:, p], CODES, SEED + 1 + k) for k, p in enumerate(self.parts)]
        self.share = self._needed(sample, own)

    def _needed(self, sample: np.ndarray, own: np.ndarray, k: int = 10) -> float:
        """Share of the sample that the nearest cells hold when TARGET of the exact neighbours of some are among them."""
        sizes, squares, needed = np.bincount(own, minlength=len(self.cells)), (sample * sample).sum(1), []
        for i in range(min(TRIED, len(sample))):
            d = squares - 2 * (sample @ sample[i])
            d[i] = np.inf
            near = np.argpartition(d, k)[:k] if len(d) > k else np.flatnonzero(np.isfinite(d))
            order = self.order(sample[i])
            held = np.empty(len(order))
            held[order] = np.cumsum(sizes[order])
            needed.append(held[own[near]])
        needed = np.sort(np.concatenate(needed))
        return float(needed[min(len(needed) - 1, int(TARGET * len(needed)))] / len(sample)) if len(needed) else 1.0

    def order(self, q: np.ndarray) -> np.ndarray:
        """Cells, nearest first."""
        return np.argsort(((self.cells - q) ** 2).sum(1), kind="stable")

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(x, self.cells)
        residual = x - self.cells[cell]
        return cell, np.stack([_nearest(residual[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], 1).astype(np.uint8)

    def constants(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the squared distance of a coded row to any query has of the row alone: |r|^2 + 2 c.r."""
        out = np.zeros(len(cell))
        for k, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            r = b[codes[:, k]]
            out += ((r + 2 * self.cells[cell][:, p]) * r).sum(1)
        return out

    def table(self, q: np.ndarray) -> np.ndarray:
        """-2 q.r for each code of each part; with the constants and |q - c|^2 it gives squared distances."""
        out = np.zeros((len(self.parts), CODES))
        for k, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            out[k, : len(b)] = -2 * (b @ q[p])
        return out


def fit(vectors: DataFrame, rows: int) -> Index | None:
    """An index model from the sample, or None without vectors."""
    got = vectors.orderBy(F.xxhash64(F.lit(SEED), "id", "h"), "id", "h").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    if not len(got):
        return None
    return Index(got.values.to_numpy(zero_copy_only=False).reshape(len(got), -1), rows)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(counts: dict[int, int]) -> list[tuple[int, int, int]]:
    """(cell, first block, blocks of its own): small cells share a block, large ones have several."""
    out, block, held = [], 0, 0
    for cell, n in sorted(counts.items()):
        if n > BLOCK_ROWS:
            block += held > 0
            own = -(-n // BLOCK_ROWS)
            out.append((cell, block, own))
            block, held = block + own, 0
        else:
            if held + n > BLOCK_ROWS:
                block, held = block + 1, 0
            out.append((cell, block, 1))
            held += n
    return out


def search(df: DataFrame, k: int = 10, query_step: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by query_step."""
    vectors = checkpoint(valid(df, id_col, vector_col))
    lengths = sorted((r[0], r[1]) for r in vectors.groupBy(F.size("v")).count().collect())
    every = [_search(vectors.where(F.size("v") == n) if len(lengths) > 1 else vectors, rows, k, query_step) for n, rows in lengths]
    return reduce(DataFrame.unionAll, every) if every else df.sparkSession.createDataFrame([], RESULT)


def _search(vectors: DataFrame, rows: int, k: int, query_step: int) -> DataFrame:
    """``search`` among vectors of one length."""
    spark = vectors.sparkSession
    index = fit(vectors, rows)

    def indexed(batches):
        for b in batches:
            if b.num_rows:
                cell, codes = index.encode(_matrix(b.column(2)))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], ["cell", "id", "h", "codes"])

    coded = checkpoint(vectors.select("id", "h", "v").mapInArrow(indexed, "cell int, id long, h long, codes binary"))
    counts = {r["cell"]: r["n"] for r in coded.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # LISTS rows at most
    packed = _blocks(counts)
    places = spark.createDataFrame(packed, "cell int, first int, own int")
    sizes = np.zeros(len(index.cells))
    for cell, n in counts.items():
        sizes[cell] = n
    first = {cell: (a, n) for cell, a, n in packed}
    cover = min(rows, max(index.share * rows, LEAST))

    def visited(q: np.ndarray) -> np.ndarray:
        order = index.order(q)
        return order[: int(np.searchsorted(np.cumsum(sizes[order]), cover - 1e-6)) + 1]

    def probes(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for i, h, q in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _matrix(b.column(2)) if b.num_rows else (), strict=True):
                for block in sorted({x for c in visited(q) if sizes[c] for x in range(first[c][0], sum(first[c]))}):
                    for column, x in zip(out, (block, i, h, q.tolist()), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64())), strict=True)], ["block", "query_id", "qh", "q"])

    queries = vectors.where(F.col("id") % query_step == 0)
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    deal = F.pmod(F.xxhash64("query_id", "qh"), F.lit(parts)).cast("int").alias("part")
    asked = queries.select("id", "h", "v").mapInArrow(probes, "block int, query_id long, qh long, q array<double>").select("block", deal, "query_id", "qh", "q")
    held = coded.join(F.broadcast(places), "cell").select((F.col("first") + F.pmod(F.xxhash64("id", "h"), F.col("own"))).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "cell", "id", "h", "codes")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0),)]
        if left.num_rows and right.num_rows:
            cell, ids, hs = (left.column(c).to_numpy() for c in ("cell", "id", "h"))
            codes = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1).astype(np.int64)
            own = index.constants(cell, codes)
            flat = np.ascontiguousarray((codes + np.arange(codes.shape[1]) * CODES).T)
            for i, h, q in zip(right.column("query_id").to_pylist(), right.column("qh").to_pylist(), _matrix(right.column("q")), strict=True):
                base = np.full(len(sizes), np.inf)
                near = visited(q)
                base[near] = ((index.cells[near] - q) ** 2).sum(1)
                at = np.flatnonzero(np.isfinite(base[cell]))
                d, table = base[cell[at]] + own[at], index.table(q).ravel()
                for codes_of_part in flat:
                    d += table[codes_of_part[at]]
                if len(d) > RERANK:
                    few = np.flatnonzero(d <= np.partition(d, RERANK - 1)[RERANK - 1])
                    d, at = d[few], at[few]
                best = np.lexsort((hs[at], ids[at], d))[:RERANK]
                found.append((np.full(len(best), i), np.full(len(best), h), ids[at[best]], hs[at[best]], d[best]))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("query_id", "qh", "id", "h", "near"), columns, (*[pa.int64()] * 4, pa.float64()), strict=True)})

    # As many tasks as groups: the codes are small, and would be packed into one task otherwise.
    groups = parts * max((first + own for _, first, own in packed), default=1)
    held, asked = (x.repartition(groups, "block", "part") for x in (held, asked))
    met = held.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(meet, "query_id long, qh long, id long, h long, near double")
    order = Window.partitionBy("query_id", "qh").orderBy("near", "id", "h")
    short = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= RERANK).select("query_id", "qh", "id", "h")
    asking = queries.select(F.col("id").alias("query_id"), F.col("h").alias("qh"), F.col("v").alias("q"), F.col("n").alias("copies"))
    exact = short.join(vectors, ["id", "h"]).join(asking, ["query_id", "qh"])
    squares = F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    others = F.col("n") - ((F.col("id") == F.col("query_id")) & (F.col("h") == F.col("qh"))).cast("long")
    exact = exact.withColumn("others", others).where(F.col("others") > 0)
    scored = exact.select("query_id", "qh", "copies", F.col("id").alias("vec_id"), F.sqrt(squares).alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), F.least("others", F.lit(k)))).alias("copy"))
    rank = F.row_number().over(Window.partitionBy("query_id", "qh").orderBy("score", "vec_id", "copy"))
    top = scored.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("asked")).drop("asked")
