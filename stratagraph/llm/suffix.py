"""Suffix-array dedup: bytes that a LENGTH-byte string covers which also starts earlier are removed.

A longest-previous-factor array says how long a string at a position also starts earlier;
previous and next smaller positions in suffix order give it (``factors``). Over a corpus, only
windows of LENGTH bytes matter (LPF >= LENGTH), and windows that may be equal are brought
together first:

1. Equal texts become one, under their smallest id.
2. Each window is named by the least hash of its GRAM-byte strings, leftmost if tied, so equal
   windows have equal names. Consecutive windows of one name place form a stretch. Of the equal
   stretches (by a 128-bit BLAKE2b digest) of some megabytes of text all but the first are repeats
   outright; the others are dealt out by name, packed in columns, and of those that are equal all
   but the first are repeats.
3. Of a name with different stretches, the first of each is fetched with its bytes. Their windows
   are put in suffix order, to the depth LENGTH; common prefixes with the neighbours and the
   previous and next smaller positions, earlier documents first, give the factors, also to that
   depth. A window whose factor is LENGTH is a repeat.
4. The repeats of each text are merged and cut out.

Nothing is compared pairwise, so a passage that a third of all texts share costs a row of each
chunk of texts that has it. Different stretches of one name meet in one task, 36 bytes each, and
those of a name with several are fetched with their bytes (168 at most each).

Defined cases: null texts are empty; null ids come after all others; texts under LENGTH bytes
keep all; rows of one id and text are one document, so neither is earlier; other columns are
ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, texts

#: UNIT: bytes that common prefixes are counted in; it divides LENGTH.
LENGTH, GRAM, UNIT = 100, 32, 4
#: Bytes of text hashed at once, and of a long text's pieces (which overlap); bytes of stretches ordered at once.
CHUNK, PIECE, ORDERED = 1 << 20, 1 << 21, 1 << 22
_PLACE = np.uint64((1 << 24) - 1)
DIGEST = np.dtype([("s0", "<u8"), ("s1", "<u8")])
NO_ID = (1 << 63) - 1


def suffix_ranks(data: np.ndarray, depth: int | None = None, unit: int = 1) -> list[np.ndarray]:
    """Ranks of the suffixes in order of their first 1, 2, 4 .. units of bytes, at least ``depth`` bytes or, without one, until all differ."""
    n = len(data)
    padded, word = np.append(data, np.zeros(unit, np.uint8)), np.zeros(n, np.int64)
    for k in range(unit):
        word = word * 257 + padded[k : k + n] + (np.arange(n) + k < n)  # a byte, or 0 past the end
    rank = np.unique(word, return_inverse=True)[1].astype(np.int64) + 1
    out, step = [rank], unit
    while n and (step < depth if depth else rank.max() < n):
        after = np.zeros(n, np.int64)
        if step < n:
            after[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        out.append(rank)
        step *= 2
    return out


def common_prefixes(ranks: list[np.ndarray], one: np.ndarray, other: np.ndarray, depth: int, unit: int = 1) -> np.ndarray:
    """Bytes, in whole units up to ``depth``, that the suffixes at two places share, by halving steps through the ranks."""
    n, out = len(ranks[0]), np.zeros(len(one), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        a, b = one + out, other + out
        inside = (a < n) & (b < n) & (out < depth)
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        # Equal ranks stand for equal bytes, or for both suffixes ending alike, which two different ones don't.
        out += np.where(inside & (ranks[k][a] == ranks[k][b]), unit << k, 0)
    return np.minimum(out, depth)


def smaller(place: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of a suffix order the last one before it with a smaller place (-1: none), and the bytes shared with it.

    place: numbers in the order of the text; lcp: bytes shared with the entry before. All
    entries jump at once, over what earlier jumps have passed, until each meets a smaller place.
    """
    n = len(place)
    at, shared = np.arange(-1, n - 1), lcp.copy()
    if n:
        shared[0] = 0
    open_ = np.flatnonzero((at >= 0) & (place[np.maximum(at, 0)] >= place) & (shared > 0))
    while len(open_):
        via = at[open_]
        shared[open_] = np.minimum(shared[open_], shared[via])
        at[open_] = at[via]
        open_ = open_[(at[open_] >= 0) & (place[np.maximum(at[open_], 0)] >= place[open_]) & (shared[open_] > 0)]
    shared[at < 0] = 0
    return at, shared


def factors(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each entry of a suffix order the longest string there that also starts at a smaller place.

    Of all smaller places the previous and the next one in suffix order share the most.
    """
    before = smaller(place, lcp)[1]
    turned = np.append(lcp[1:], 0)[::-1]
    return np.maximum(before, smaller(place[::-1], turned)[1][::-1])


def longest_previous_factors(data: bytes) -> np.ndarray:
    """For each position of a string, the longest string there that also starts earlier."""
    a = np.frombuffer(data, np.uint8)
    ranks = suffix_ranks(a)
    order = np.argsort(ranks[-1], kind="stable")
    out = np.zeros(len(a), np.int64)
    if len(a):
        lcp = np.append(0, common_prefixes(ranks, order[1:], order[:-1], len(a)))
        out[order] = factors(order, lcp)
    return out


def _stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(start, windows, name, digest) of the stretches of texts laid end to end."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, DIGEST))
    spans, grams = SpanHash(data), n - GRAM + 1
    at = np.arange(grams)
    value = (spans.spans(at, at + GRAM) & ~_PLACE) | at.astype(np.uint64)
    least, width, need = value, 1, LENGTH - GRAM + 1
    while width * 2 <= need:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < need:
        least = np.minimum(least[: n - LENGTH + 1], least[need - width : need - width + n - LENGTH + 1])
    place = (least & _PLACE).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    inside = np.cumsum(inside[: n - LENGTH + 1]) > 0
    new = inside.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new)
    stop = np.flatnonzero(inside & np.append(~inside[1:] | new[1:], True)) + 1
    raw, digest = data.tobytes(), hashlib.blake2b
    same = b"".join([digest(raw[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), (stop - 1 + LENGTH).tolist(), strict=True)])
    return first, stop - first, value[place[first]] & ~_PLACE, np.frombuffer(same, DIGEST)


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays of equal or different lengths in one compressed value."""
    head = struct.pack("<H", len(arrays))
    for name, a in arrays.items():
        head += struct.pack("<8s8sQ", name.encode(), a.dtype.str.encode(), len(a))
    return zstandard.compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values()), 1)


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.decompress(blob)
    out, at = {}, 2
    shapes = []
    for _ in range(struct.unpack_from("<H", raw)[0]):
        name, kind, n = struct.unpack_from("<8s8sQ", raw, at)
        shapes.append((name.rstrip(b"\0").decode(), np.dtype(kind.rstrip(b"\0").decode()), n))
        at += 24
    for name, kind, n in shapes:
        out[name] = np.frombuffer(raw, kind, n, at)
        at += n * kind.itemsize
    return out


KEY = np.dtype([("k0", "<u8"), ("k1", "<u8"), ("doc", "<i8")])


def _keyed(keys: list[bytes], docs: list[int]) -> np.ndarray:
    out = np.empty(len(keys), KEY)
    k = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    out["k0"], out["k1"], out["doc"] = k[:, 0], k[:, 1], docs
    return out


def _pieces(text: bytes):
    """(offset, bytes) of a text, in overlapping pieces if it is long: each window lies in one."""
    for i in range(0, max(1, len(text) - LENGTH + 1), PIECE):
        yield i, text[i : i + PIECE + LENGTH - 1]


def _chunks(batches, columns):
    """Lists of rows of about CHUNK bytes of text."""
    held, size = [], 0
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            held.append(row)
            size += len(row[-1])
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _name_stretches(parts: int):
    """Texts to (part, blob): the stretches of a chunk of texts, by part of their name."""

    def run(batches):
        for rows in _chunks(batches, ("key", "rep", "text")):
            owner, offset, data = [], [], []
            for d, (_, _, text) in enumerate(rows):
                raw = text.encode()
                if len(raw) >= LENGTH:
                    for o, piece in _pieces(raw):
                        owner.append(d)
                        offset.append(o)
                        data.append(piece)
            if not data:
                continue
            sizes = np.array([len(x) for x in data])
            keys = _keyed([r[0] for r in rows], [r[1] for r in rows])
            cut, at = 0, 0
            out = []
            while cut < len(data):  # long pieces go one by one
                stop = cut + 1
                while stop < len(data) and sizes[cut : stop + 1].sum() <= 2 * CHUNK:
                    stop += 1
                ends = np.cumsum(sizes[cut:stop])
                starts = ends - sizes[cut:stop]
                first, n, name, same = _stretches(np.frombuffer(b"".join(data[cut:stop]), np.uint8), starts, ends)
                piece = np.searchsorted(ends, first, "right")
                out.append((np.array(owner[cut:stop])[piece], first - starts[piece] + np.array(offset[cut:stop])[piece], n, name, same))
                cut = stop
            doc, start, n, name, same = (np.concatenate(x) for x in zip(*out, strict=True))
            again = _repeats(keys["doc"][doc], start, same)[1]
            # What is first here goes to its name's part, what repeats here is done, and travels by its text.
            part = np.where(again, keys["k0"][doc] % np.uint64(parts), (name >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((again, part))
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            ids, blobs = [], []
            for p in np.flatnonzero(edges[1:] > edges[:-1]):
                o = order[edges[p] : edges[p + 1]]
                first = o[~again[o]]
                used, doc_at = np.unique(doc[o], return_inverse=True)
                ids.append(int(p))
                blobs.append(_pack(keys=keys[used].view("<u8"), doc=doc_at.astype("<u4"), start=start[o].astype("<u4"), n=n[o].astype("<u1"), name=(name[first] >> np.uint64(32)).astype("<u4"), same=same[first].view("<u8")))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    return run


FOUND = "key binary, part int, ask boolean, data binary"


def _by_text(keys: np.ndarray, ask: np.ndarray, part: int, **arrays):
    """Rows of FOUND: for each text and kind, its places."""
    if not len(keys):
        return None
    order = np.lexsort((arrays["start"], ask, keys["k1"], keys["k0"]))
    k, ask = keys[order], ask[order]
    new = np.ones(len(order), bool)
    new[1:] = (k["k0"][1:] != k["k0"][:-1]) | (k["k1"][1:] != k["k1"][:-1]) | (ask[1:] != ask[:-1])
    cuts = np.append(np.flatnonzero(new), len(order))
    columns = [a[order] for a in arrays.values()]
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows.append((struct.pack("<QQ", int(k["k0"][a]), int(k["k1"][a])), part, bool(ask[a]), b"".join(c[a:b].tobytes() for c in columns)))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int32(), pa.bool_(), pa.binary()))], ["key", "part", "ask", "data"])


def _repeats(doc: np.ndarray, start: np.ndarray, same: np.ndarray, *names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (names, digest, document, start); which entries repeat an earlier equal one; which are first of an equal run.

    Not earlier: the same place of the same id (rows that repeat an id with another text). The
    order's marks are given in the entries' own order.
    """
    order = np.lexsort((start, doc, same["s1"], same["s0"], *names))
    head = np.ones(len(order), bool)
    head[1:] = same[order][1:] != same[order][:-1]
    first = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    again, heads = np.zeros(len(order), bool), np.zeros(len(order), bool)
    again[order] = ~head & ((doc[order] != doc[first]) | (start[order] != start[first]))
    heads[order] = head
    return order, again, heads


def _first_stretches(batches):
    """Blobs to FOUND: repeated stretches (ask false), and first ones whose name has others (ask true)."""
    by_part: dict[int, list[bytes]] = {}
    for b in batches:
        for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by_part.setdefault(p, []).append(blob)
    for p in sorted(by_part):
        got = [_unpack(x) for x in by_part.pop(p)]
        fresh = [len(g["name"]) for g in got]  # those that are first in their chunk stand before its repeats
        keys, done = [], []
        for g, k in zip(got, fresh, strict=True):
            own = g["keys"].view(KEY)[g["doc"]]
            keys.append(own[:k])
            done.append(own[k:])
        rest = np.concatenate(done)
        out = _by_text(rest, np.zeros(len(rest), bool), p, start=np.concatenate([g["start"][k:] for g, k in zip(got, fresh, strict=True)]), n=np.concatenate([g["n"][k:] for g, k in zip(got, fresh, strict=True)]), name=np.zeros(len(rest), "<u4"))
        if out is not None:
            yield out
        keys = np.concatenate(keys)
        start, n = (np.concatenate([g[x][:k] for g, k in zip(got, fresh, strict=True)]) for x in ("start", "n"))
        name, same = np.concatenate([g["name"] for g in got]), np.concatenate([g["same"].view(DIGEST) for g in got])
        del got
        order, repeat, head = _repeats(keys["doc"], start, same, name)
        group = np.ones(len(order), bool)
        group[1:] = name[order][1:] != name[order][:-1]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(group) - 1
        ask = head & (np.bincount(which, head)[which] > 1) if len(order) else head
        take = repeat | ask
        out = _by_text(keys[take], ask[take], p, start=start[take], n=n[take], name=name[take])
        if out is not None:
            yield out


def _places(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = len(data) // 9
    return np.frombuffer(data, "<u4", k), np.frombuffer(data, "<u1", k, 4 * k).astype(np.int64), np.frombuffer(data, "<u4", k, 5 * k)


def _fetch(batches):
    """(key, rep, text, asked) to (part, blob) with the bytes of the asked stretches."""
    for rows in _chunks(batches, ("key", "rep", "asked", "text")):
        by_part: dict[int, list] = {}
        for key, rep, asked, text in rows:
            raw = text.encode()
            for a in asked:
                start, n, name = _places(a["data"])
                by_part.setdefault(a["part"], []).append((key, rep, start, n, name, [raw[s : s + w - 1 + LENGTH] for s, w in zip(start.tolist(), n.tolist(), strict=True)]))
        ids, blobs = [], []
        for p, got in by_part.items():
            count = [len(g[2]) for g in got]
            ids.append(p)
            blobs.append(_pack(
                keys=_keyed([g[0] for g in got], [g[1] for g in got]).view("<u8"), doc=np.repeat(np.arange(len(got)), count).astype("<u4"),
                start=np.concatenate([g[2] for g in got]), n=np.concatenate([g[3] for g in got]).astype("<u1"), name=np.concatenate([g[4] for g in got]),
                bytes=np.frombuffer(b"".join(x for g in got for x in g[5]), np.uint8),
            ))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


def repeated_windows(stretches: list[bytes], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, window start in its text) of windows with LPF >= LENGTH; order is by (doc, start)."""
    sizes = np.array([len(s) for s in stretches])
    n = sizes - LENGTH + 1
    ends = np.cumsum(sizes)
    which = np.repeat(np.arange(len(n)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    where, who = start[which].astype(np.int64) + inside, doc[which]
    text = (ends - sizes)[which] + inside  # places in the stretches laid end to end
    ranks = suffix_ranks(np.frombuffer(b"".join(stretches), np.uint8), (LENGTH + 1) // 2, UNIT)
    step = UNIT << (len(ranks) - 1)  # half of LENGTH at least, and under it
    # Suffix order to the depth LENGTH: by the first bytes, then by the last ones, which overlap them.
    order = np.lexsort((ranks[-1][text + LENGTH - step], ranks[-1][text]))
    lcp = np.append(0, common_prefixes(ranks, text[order][1:], text[order][:-1], LENGTH, UNIT))
    # Equal windows at one place of one id (rows that repeat an id with another text) have one place.
    by_place = np.lexsort((where, who))
    new = np.ones(len(by_place), bool)
    new[1:] = (who[by_place][1:] != who[by_place][:-1]) | (where[by_place][1:] != where[by_place][:-1])
    place = np.empty(len(by_place), np.int64)
    place[by_place] = np.cumsum(new)
    again = np.sort(order[factors(place[order], lcp) >= LENGTH])
    return which[again], where[again]


def _order_stretches(batches):
    """Blobs with bytes to FOUND: repeated windows, as stretches of them."""
    by_part: dict[int, list[bytes]] = {}
    for b in batches:
        for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by_part.setdefault(p, []).append(blob)
    for p in sorted(by_part):
        got = [_unpack(x) for x in by_part.pop(p)]
        keys = np.concatenate([g["keys"].view(KEY)[g["doc"]] for g in got])
        start, n, name = (np.concatenate([g[x] for g in got]) for x in ("start", "n", "name"))
        data = b"".join(g["bytes"].tobytes() for g in got)
        sizes = n.astype(np.int64) - 1 + LENGTH
        ends = np.cumsum(sizes)
        slices = -(-len(data) // ORDERED)  # equal windows have equal names, so they stay together
        share = name % np.uint32(slices)
        for k in range(slices):
            own = np.flatnonzero(share == k)
            if len(own) < 2:
                continue
            which, where = repeated_windows([data[ends[i] - sizes[i] : ends[i]] for i in own], keys["doc"][own], start[own])
            if not len(which):
                continue
            new = np.ones(len(which), bool)
            new[1:] = (which[1:] != which[:-1]) | (where[1:] != where[:-1] + 1)
            cut = np.flatnonzero(new)
            count = np.diff(np.append(cut, len(which)))
            owner = own[which[cut]]
            out = _by_text(keys[owner], np.zeros(len(cut), bool), p, start=where[cut].astype("<u4"), n=count.astype("<u1"), name=name[owner])
            if out is not None:
                yield out


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals that overlap or touch become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1]


CUT = "key binary, rep long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<struct<start:long,end:long>>"


def _cut(batches):
    """(key, rep, repeats, text) to CUT."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = [x.split(" ")[0] for x in CUT.split(", ")]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), span]
    for rows in _chunks(batches, ("key", "rep", "repeats", "text")):
        out = []
        for key, rep, repeats, text in rows:
            raw = text.encode()
            kept, spans = raw, []
            if repeats:
                places = [_places(r) for r in repeats]
                s = np.concatenate([x[0] for x in places]).astype(np.int64)
                a, b = merged(s, s + np.concatenate([x[1] for x in places]) - 1 + LENGTH)
                spans = list(zip(a.tolist(), b.tolist(), strict=True))
                kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
            out.append((key, rep, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, [dict(start=x, end=y) for x, y in spans]))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep`` the bytes kept and the spans removed too."""
    spark = df.sparkSession
    parts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 16)
    docs = texts(df, id_col, text_col).withColumn("key", key(F.col("__text")))
    docs = docs.where(F.col("key").isNotNull())  # always so; said here, or joins would add it and shuffle the texts anew
    distinct = docs.groupBy("key").agg(F.min(F.coalesce("__id", F.lit(NO_ID))).alias("rep"), F.min("__text").alias("text"))
    named = distinct.select("key", "rep", "text").mapInArrow(_name_stretches(parts), "part int, blob binary")
    found = named.repartition(parts, "part").mapInArrow(_first_stretches, FOUND)
    asked = found.where("ask").groupBy("key").agg(F.collect_list(F.struct("part", "data")).alias("asked"))
    bytes_of = distinct.join(asked, "key").select("key", "rep", "asked", "text").mapInArrow(_fetch, "part int, blob binary")
    more = bytes_of.repartition(parts, "part").mapInArrow(_order_stretches, FOUND)
    repeats = found.where(~F.col("ask")).select("key", "data").unionByName(more.select("key", "data"))
    repeats = repeats.groupBy("key").agg(F.collect_list("data").alias("repeats"))
    cut = distinct.join(repeats, "key", "left").select("key", "rep", "repeats", "text").mapInArrow(_cut, CUT)
    if not keep:
        cut = cut.drop("kept", "removed")
    all_gone = (F.coalesce("__id", F.lit(NO_ID)) != F.col("rep")) & (F.col("n_bytes") >= LENGTH)
    out = docs.select("__id", "key").join(cut, "key")
    columns = [
        F.col("__id").alias("doc_id"), "n_bytes", F.when(all_gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(all_gone, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    ]
    if keep:
        whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
        columns += [F.when(all_gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"), F.when(all_gone, whole).otherwise(F.col("removed")).alias("removed")]
    return out.select(*columns)
