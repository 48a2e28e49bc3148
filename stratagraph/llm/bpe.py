"""Byte-level BPE by recursive queries of DuckDB, one database per Python worker.

A text is split by the pattern; each distinct piece is encoded once and remembered. Pieces that
are tokens stand for themselves. The others become token-position rows; a recursive query joins
neighbouring rows with the merge table and contracts each piece's leftmost pair of least rank
until no pair is left, and an ordered aggregation writes the ids of a piece. Decoding is an
ordered aggregation over the token-position rows of each document's own ids. The merge table has
every split of every token into two tokens, because neighbours merge whenever their joined bytes
are a token.

The rows of a piece are rewritten once a merge, so a piece of n bytes costs n * n; pieces over
``LONG`` bytes get the same contraction with a heap instead, in n * log(n).

Defined cases: null texts are empty (no ids); null ids and repeated rows are kept; other columns
are ignored, or carried where asked for. The memory of pieces outlives a task, not a query, as
tasks share most of the pieces that recur: when it has met ``REMEMBERED`` of them or
``REMEMBERED_BYTES``, what was not met since the last such time goes. Queries take ``AT_ONCE`` bytes of pieces or
``DECODED`` ids at a time, so a worker's memory follows its longest text, not its rows; the
database never spills to a local folder.
"""

from __future__ import annotations

import base64
import contextlib
import ctypes
import hashlib
import heapq
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

LONG, REMEMBERED, REMEMBERED_BYTES, AT_ONCE, DECODED = 200, 600_000, 1 << 24, 1 << 18, 1 << 20

CONTRACT = """
CREATE OR REPLACE TEMP TABLE done AS
WITH RECURSIVE steps(done, w, pos, id, right_id, right_pos) AS (
  SELECT false, w, pos, id, lead(id) OVER (PARTITION BY w ORDER BY pos), lead(pos) OVER (PARTITION BY w ORDER BY pos) FROM start
  UNION ALL
  (WITH best AS (
     SELECT w, min(rank * 65536 + pos) AS at, arg_min(right_pos, rank * 65536 + pos) AS gone
     FROM steps JOIN merges ON id = l AND right_id = r WHERE NOT done GROUP BY w),
   made AS (
     SELECT best.w, best.at % 65536 AS pos, best.at // 65536 AS id, best.gone, g.right_id, g.right_pos
     FROM best JOIN steps g ON g.w = best.w AND g.pos = best.gone)
   SELECT m.w IS NULL, s.w, s.pos,
     CASE WHEN s.pos = m.pos THEN m.id ELSE s.id END,
     CASE WHEN s.pos = m.pos THEN m.right_id WHEN s.right_pos = m.pos THEN m.id ELSE s.right_id END,
     CASE WHEN s.pos = m.pos THEN m.right_pos ELSE s.right_pos END
   FROM steps s LEFT JOIN made m ON s.w = m.w WHERE NOT s.done AND (m.gone IS NULL OR s.pos <> m.gone)))
SELECT w, pos, id FROM steps WHERE done UNION ALL SELECT w, pos, id FROM whole
"""
WRITE = """
SELECT w, list(id ORDER BY pos) AS ids FROM done GROUP BY w ORDER BY w
"""
DECODE = """
SELECT w, string_agg(hex, '' ORDER BY pos) AS hex FROM asked JOIN tokens USING (id) GROUP BY w ORDER BY w
"""


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder with one in-memory database."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.ranks = ranks
        self.split = regex.compile(_white(pattern)).findall
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        merged = [(ranks[t[:k]], ranks[t[k:]], v) for t, v in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        a = np.array(merged, np.int64).reshape(-1, 3)
        self._table("merges", l=a[:, 0], r=a[:, 1], rank=a[:, 2])
        self._table("tokens", id=np.fromiter(ranks.values(), np.int64), hex=[t.hex() for t in ranks])
        self.names = {v: str(v) for v in ranks.values()}
        #: Piece to its ids, as bytes of 32-bit numbers; older: those met before the last time that known was full.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bytes, self.query = 0, ""

    def _table(self, name: str, **columns) -> None:
        view = pa.table(columns)
        self.db.register(f"{name}_in", view)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM {name}_in")
        self.db.unregister(f"{name}_in")

    def _rows(self, lists: list, at: list[int], ids: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Token-position rows (w, pos, id) of id lists that stand at the given numbers."""
        sizes = np.array([len(x) for x in lists], np.int64)
        ends = np.cumsum(sizes)
        pos = np.arange(sizes.sum()) - np.repeat(ends - sizes, sizes)
        return {"w": np.repeat(np.array(at, np.int64), sizes), "pos": pos, "id": np.fromiter(chain.from_iterable(lists), np.int64) if ids is None else ids}

    def contract(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces, as bytes of 32-bit numbers, by the recursive query."""
        get = self.ranks.get
        direct = [(get(p),) if p in self.ranks else self._heap(p) if len(p) > LONG else None for p in pieces]
        known = [k for k, x in enumerate(direct) if x is not None]
        other = [k for k, x in enumerate(direct) if x is None]
        self._table("whole", **self._rows([direct[k] for k in known], known))
        raw = [pieces[k] for k in other]
        self._table("start", **self._rows(raw, other, self.single[np.frombuffer(b"".join(raw), np.uint8)]))
        self.db.execute(CONTRACT)
        ids = self.db.sql(WRITE).to_arrow_table().column("ids").combine_chunks()
        flat = ids.values.to_numpy().astype("<i4").tobytes()
        ends = 4 * ids.offsets.to_numpy()
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _heap(self, piece: bytes) -> list[int]:
        """Ids of a long piece: the same contraction, leftmost pair of least rank first."""
        get, n = self.ranks.get, len(piece)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        end, alive = list(range(1, n + 1)), [True] * n
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, to = heapq.heappop(heap)
            j = nxt[k] if alive[k] else n
            if j >= n or end[j] != to:
                continue
            alive[j], end[k], nxt[k] = False, to, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = k
                if (r := get(piece[k : end[nxt[j]]])) is not None:
                    heapq.heappush(heap, (r, k, end[nxt[j]]))
            if prv[k] >= 0 and (r := get(piece[prv[k] : to])) is not None:
                heapq.heappush(heap, (r, prv[k], to))
        return [self.ranks[piece[k : end[k]]] for k in range(n) if alive[k]]

    def decode_ids(self, lists: list[np.ndarray]) -> list[bytes]:
        """The bytes of each array of ids, by ordered aggregation; no ids are no bytes. Long arrays go in stretches."""
        out: list[list[bytes]] = [[] for _ in lists]
        stretches = [(w, x[i : i + DECODED]) for w, x in enumerate(lists) for i in range(0, len(x), DECODED)]
        at = 0
        while at < len(stretches):
            stop, held = at + 1, len(stretches[at][1])
            while stop < len(stretches) and held + len(stretches[stop][1]) <= DECODED:
                held += len(stretches[stop][1])
                stop += 1
            part = stretches[at:stop]
            sizes = np.array([len(x) for _, x in part])
            ends = np.cumsum(sizes)
            self._table("asked", w=np.repeat(np.arange(len(part)), sizes), pos=np.arange(ends[-1]) - np.repeat(ends - sizes, sizes), id=np.concatenate([x for _, x in part]).astype(np.int64))
            got = self.db.sql(DECODE).to_arrow_table()
            for k, x in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                out[part[k][0]].append(bytes.fromhex(x))
            at = stop
        return [b"".join(x) for x in out]

    def learn(self, pieces: set[str]) -> None:
        """Encodes the pieces that are not known yet."""
        part, raw, held, new = [], [], 0, pieces.difference(self.known)
        if self.older:
            again = {p: self.older[p] for p in new if p in self.older}
            self.known.update(again)
            self.bytes += sum(map(len, again))
            new.difference_update(again)
        for p in sorted(new):
            part.append(p)
            raw.append(p.encode("utf-8", "replace"))
            held += len(raw[-1])
            if held >= AT_ONCE:
                self.known.update(zip(part, self.contract(raw), strict=True))
                self.bytes += held
                part, raw, held = [], [], 0
        if part:
            self.known.update(zip(part, self.contract(raw), strict=True))
            self.bytes += held

    def begin(self, query: str) -> None:
        """Drops what is remembered of another query."""
        if query != self.query:
            self.known, self.older, self.bytes, self.query = {}, {}, 0, query

    def rest(self) -> None:
        """Hands freed memory back, so that an idle worker holds little beside what it remembers."""
        with contextlib.suppress(OSError, AttributeError):  # only where the C library can
            ctypes.CDLL(None).malloc_trim(0)

    def ids(self, pieces: list[str]) -> np.ndarray:
        """The ids of a text's pieces."""
        return np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), "<i4")

    def ids_text(self, ids: np.ndarray) -> str:
        """Ids in decimal, joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [self.split(t) for t in batch]
        own: set[str] = set()
        for s in split:
            own.update(s)
        if len(self.known) + len(own) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self.known, self.older, self.bytes = {}, self.known, 0
        self.learn(own)
        return [self.ids(s) for s in split]


def _white(pattern: str) -> str:
    r"""The pattern with \s and \S spelt out as Unicode's White_Space, as the public library has them."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec, made once."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _batches(batches, first: int):
    """(columns before ``first``, texts), a thousand rows or some megabytes of text at a time."""
    for b in batches:
        rows, held, size = [], [], 0
        others = [b.column(k).to_pylist() for k in range(b.num_columns) if k != first]
        for k, t in enumerate(b.column(first).to_pylist()):
            rows.append(tuple(x[k] for x in others))
            held.append(t)
            size += len(t)
            if len(held) == 1000 or size > 1 << 21:
                yield rows, held
                rows, held, size = [], [], 0
        if held:
            yield rows, held


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of whole texts."""
    query = uuid.uuid4().hex

    def run(batches):
        c = codec(path, pattern)
        c.begin(query)
        for rows, held in _batches(batches, 1):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(c.encode(held), pa.list_(pa.int64()))], ["doc_id", "ids"])
        c.rest()

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<long>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes) of id lists; null lists decode to no bytes, unknown ids raise."""

    def run(batches):
        c = codec(path, pattern)
        known = np.array(sorted(c.names))
        for b in batches:
            lists = [np.array(x or [], np.int64) for x in b.column(1).to_pylist()]
            if not all(np.isin(x, known).all() for x in lists):
                raise ValueError("an id is not in the vocabulary")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.decode_ids(lists), pa.binary())], ["doc_id", "bytes"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].cast("array<long>").alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """doc_id, n_tokens, the digests of the ids and of the bytes decoded from them, and a long column carried along if named."""
    more = [carry] if carry else []
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *more]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *(pa.int64() for _ in more)]
    query = uuid.uuid4().hex

    def run(batches):
        c = codec(path, pattern)
        c.begin(query)
        for rows, held in _batches(batches, 1):
            ids = c.encode(held)
            out = [
                (r[0], len(x), hashlib.sha256(c.ids_text(x).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest(), *r[1:])
                for r, x, decoded in zip(rows, ids, c.decode_ids(ids), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
        c.rest()

    rows = df.select(df[id_col].cast("long").alias("__id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("__text"), *(df[x].cast("long") for x in more))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {x} long" for x in more))
