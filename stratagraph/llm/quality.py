"""Quality classifier: a byte-level convolutional network in numpy.

Bytes go through filters of ``SPAN`` bytes at every second byte. Each filter is max-pooled over
chunks of ``CHUNK`` bytes that overlap by half and together cover the whole document; the mean
and the maximum over the chunks of each pooled filter go through one logistic layer.

The network is fitted on the driver with a bounded sample of labelled rows (``SAMPLE`` of each
label at most, smallest hashes of their ids first, also where many rows have one id); it learns
from all chunks of their whole texts, and every text is scored whole. Rows of the hold-out fold
never reach the fit. Labels, lang, source and ids are not inputs of a score.

Defined cases: null and empty texts are scored as one chunk of zero bytes; null ids are kept and
never learnt from; repeated rows are kept, and count each in the sample; contradicting labels of
one id are both learnt from; without both labels in the sample the score is the share of label 1
(0.5 without labels).
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

FILTERS, SPAN, STRIDE, CHUNK = 16, 4, 2, 256
SAMPLE, STEPS, BATCH, SEED, FOLDS, THRESHOLD = 600, 400, 32, 11, 5, 0.3


class Network:
    """tables: SPAN x 256 x FILTERS, what each byte adds to each filter; weights: of means, then of maxima."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.tables = r.normal(0, 0.3, (SPAN, 256, FILTERS)).astype(np.float32)
        self.weights = r.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.bias = np.float32(0)
        self.constant: float | None = None

    def pooled(self, text: bytes, where: bool = False):
        """Chunks x filters: the maxima of each chunk, and where they are if asked."""
        n = max(len(text), CHUNK)
        half = CHUNK // 2 // STRIDE
        places = -(-n // (CHUNK // 2)) * half  # whole half-chunks
        data = np.zeros(places * STRIDE + SPAN, np.uint8)
        data[: len(text)] = np.frombuffer(text, np.uint8)
        out = []
        for begin in range(0, places, 1 << 16):  # 64 k places at once: bounded memory
            stop = min(places, begin + (1 << 16))
            part = sum(self.tables[k].take(data[begin * STRIDE + k : stop * STRIDE + k : STRIDE], axis=0) for k in range(SPAN))
            part = part.reshape(-1, half, FILTERS)
            out.append((part.max(1), part.argmax(1) + np.arange(len(part))[:, None] * half + begin) if where else (part.max(1), None))
        top = np.concatenate([x for x, _ in out])
        low = top[:-1] >= top[1:] if len(top) > 1 else None
        chunks = np.maximum(top[:-1], top[1:]) if len(top) > 1 else top
        if not where:
            return chunks
        at = np.concatenate([x for _, x in out])
        return chunks, (np.where(low, at[:-1], at[1:]) if low is not None else at), data

    def features(self, text: bytes) -> np.ndarray:
        c = np.tanh(self.pooled(text))
        return np.concatenate([c.mean(0), c.max(0)])

    def score(self, text: bytes) -> float:
        if self.constant is not None:
            return self.constant
        z = float(self.features(text) @ self.weights + self.bias)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def step(self, batch: list[tuple[bytes, int, float]], rate: float, state: dict) -> None:
        """One Adam step on (text, label, weight) rows."""
        g_tables, g_weights, g_bias = np.zeros_like(self.tables), np.zeros_like(self.weights), 0.0
        for text, label, weight in batch:
            chunks, at, data = self.pooled(text, where=True)
            c = np.tanh(chunks)
            best = c.argmax(0)
            f = np.concatenate([c.mean(0), c.max(0)])
            p = 1 / (1 + np.exp(-np.clip(f @ self.weights + self.bias, -30, 30)))
            d = np.float32((p - label) * weight)
            g_weights += d * f
            g_bias += d
            g = np.repeat((d * self.weights[:FILTERS] / len(c))[None, :], len(c), 0)
            g[best, np.arange(FILTERS)] += d * self.weights[FILTERS:]
            g *= 1 - c * c
            column = np.broadcast_to(np.arange(FILTERS), at.shape)
            for k in range(SPAN):
                np.add.at(g_tables[k], (data[at * STRIDE + k], column), g)
        state["t"] = t = state.get("t", 0) + 1
        for name, g in (("tables", g_tables), ("weights", g_weights), ("bias", np.float32(g_bias))):
            g = g / len(batch) + 1e-4 * getattr(self, name)
            m, v = state.get(name, (0, 0))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            state[name] = (m, v)
            setattr(self, name, (getattr(self, name) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32))


def fit(rows: list[tuple[bytes, int]], seed: int = SEED, steps: int = STEPS) -> Network:
    """Adam on the logistic loss, as many steps for any sample; both labels weigh as much as each other."""
    net, r = Network(seed), np.random.default_rng(seed)
    share = float(np.mean([y for _, y in rows])) if rows else 0.5
    if not rows or share in (0.0, 1.0):
        net.constant = share
        return net
    weight = {1: 0.5 / share, 0: 0.5 / (1 - share)}
    state: dict = {}
    order: list[int] = []
    for step in range(steps):
        while len(order) < BATCH:
            order += r.permutation(len(rows)).tolist()
        batch, order = order[:BATCH], order[BATCH:]
        net.step([(rows[k][0], rows[k][1], weight[rows[k][1]]) for k in batch], 0.02 if step < steps * 2 // 3 else 0.005, state)
    return net


def fold(doc_id) -> object:
    """crc32 of the id's decimal text modulo FOLDS; null ids have no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Network:
    """The network, fitted on at most ``sample`` rows of each label outside the hold-out fold."""
    marked = labels.select(labels[id_col].cast("long").alias("__id"), labels[label_col].cast("int").alias("__y"))
    marked = marked.where(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & (fold(F.col("__id")) != 0)).distinct()
    order = F.xxhash64(F.lit(SEED), "__id")
    chosen = reduce(DataFrame.unionAll, (marked.where(F.col("__y") == y).orderBy(order, "__id").limit(sample) for y in (0, 1)))
    rows = texts(docs, id_col, text_col).join(F.broadcast(chosen), "__id").select("__y", order.alias("__order"), "__id", "__text")
    got = [(r["__text"].encode(), r["__y"]) for y in (0, 1) for r in rows.where(F.col("__y") == y).orderBy("__order", "__id", "__text").limit(sample).collect()]
    return fit(got)


def score(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text."""
    names = ["doc_id", "held_out", "score", "predicted"]

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            s = [net.score(t.encode()) for t in b.column(1).to_pylist()]
            held = [None if i is None else zlib.crc32(str(i).encode()) % FOLDS == 0 for i in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.bool_()), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], names)

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(df: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The rows that the network does not reject, with their columns as they are."""
    names = df.columns
    at = names.index(text_col)

    def run(batches):
        for b in batches:
            ok = [net.score((t or "").encode()) >= THRESHOLD for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(ok, pa.bool_()))

    return df.mapInArrow(run, df.schema)
