"""Media columns: GIF files written, read, rendered and described.

Frames are palette indices with a delay, a disposal rule and an optional transparent index.
``decode`` reads any GIF stream (local and global palettes, interlace, deferred clear codes);
``render`` applies palettes, transparency and disposal and gives timed RGB frames. A screen or
frame of more than ``PIXELS`` pixels is refused before anything of its size is allocated.

``text_media`` stores texts: the UTF-8 bytes, padded with zeros to a positive multiple of 64,
are the samples of 64-pixel rows under a grey palette, in frames of at most ROWS rows. They are
read back, like the feature, from what the stored file's frames render to.
Defined cases: a null text is empty, so its payload is 64 zero bytes; equal texts give equal
values; null ids and repeated rows are kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

WIDTH, ROWS = 64, 1024
#: Levels of a colour in the feature's histogram.
LEVELS = 16
CLEAR_ROOM = 4096
#: Pixels of a screen or frame that are rendered at most, against headers that claim gigabytes.
PIXELS = 1 << 26
#: Grey, so that an index is its own colour.
GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


@dataclass
class Frame:
    indices: np.ndarray  # rows x columns, uint8
    left: int = 0
    top: int = 0
    delay: int = 0  # hundredths of a second
    disposal: int = 0
    transparent: int | None = None
    palette: np.ndarray | None = None  # its own, n x 3


def _widths(first: int, bits: int, n: int) -> np.ndarray:
    """Bits of the n codes after a clear code: the reader's table grows by one a code from the second on."""
    room = first + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.floor(np.log2(room)).astype(np.int64) + 1, bits + 1, 12)


_BITS: dict[int, np.ndarray] = {}


def _offsets(bits: int, n: int = 1 << 14) -> np.ndarray:
    """Bits before each of the codes that follow a clear code."""
    if bits not in _BITS:
        _BITS[bits] = np.concatenate([[0], np.cumsum(_widths((1 << bits) + 2, bits, n))])
    return _BITS[bits]


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """A GIF code stream, without its sub-blocks; the table is cleared when it is full."""
    clear, end, first = 1 << bits, (1 << bits) + 1, (1 << bits) + 2
    runs: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    find, emit, room = table.get, codes.append, first
    if data:
        it = iter(data)
        w = next(it)
        for c in it:
            k = w << 8 | c
            x = find(k)
            if x is None:
                emit(w)
                if room < CLEAR_ROOM:
                    table[k] = room
                    room += 1
                else:
                    emit(clear)
                    runs.append(codes)
                    codes = []
                    emit = codes.append
                    table.clear()
                    room = first
                w = c
            else:
                w = x
        emit(w)
    emit(end)
    runs.append(codes)
    offsets = _offsets(bits)
    widths = [np.array([bits + 1])] + [np.diff(offsets[: len(r) + 1]) for r in runs]
    values = np.concatenate([[clear], *runs]).astype(np.int64)
    ends = np.cumsum(np.concatenate(widths))
    at = np.concatenate([[0], ends[:-1]])
    shifted, byte, size = values << (at & 7), at >> 3, int(ends[-1] + 7) // 8 + 3
    out = sum(np.bincount(byte + k, (shifted >> (8 * k)) & 255, size) for k in range(3))
    return out[: int(ends[-1] + 7) // 8].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, bits: int = 8) -> bytes:
    """The samples of a GIF code stream."""
    clear, end, first = 1 << bits, (1 << bits) + 1, (1 << bits) + 2
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int64)
    words, total, at = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16, len(data) * 8, 0
    singles = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    offsets = _offsets(bits)
    table, prev, done = singles.copy(), b"", 0
    while True:
        if done:  # a full table that has not been cleared: 12 bits a code
            steps = np.arange(len(offsets)) * 12
        else:
            steps = offsets
        place = at + steps
        n = int(np.searchsorted(place, total - 1, "right")) - 1
        n = min(n, len(steps) - 1)
        if n <= 0:
            break
        wide = np.diff(steps[: n + 1])
        pos = place[:n]
        codes = (words[np.minimum(pos >> 3, len(words) - 1)] >> (pos & 7)) & ((1 << wide) - 1)
        codes = codes[place[1 : n + 1] <= total]
        stop = np.flatnonzero((codes == clear) | (codes == end))
        k = int(stop[0]) if len(stop) else len(codes)
        add, room, emit = table.append, len(table), out.append
        for c in codes[:k].tolist():
            if c < room:
                e = table[c]
                if prev and room < CLEAR_ROOM:
                    add(prev + e[:1])
                    room += 1
            else:
                e = prev + prev[:1]
                if room < CLEAR_ROOM:
                    add(e)
                    room += 1
            emit(e)
            prev = e
        if not len(stop):
            at, done = int(place[len(codes)]), 1
            if at >= total:
                break
            continue
        at = int(place[k + 1])
        if codes[k] == end:
            break
        table, prev, done = singles.copy(), b"", 0
    return b"".join(out)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(part := data[i : i + 255])]) + part for i in range(0, len(data), 255)) + b"\0"


def encode(frames: list[Frame], width: int, height: int, palette: np.ndarray = GREY) -> bytes:
    """A GIF89a file with a global palette of 256 colours."""
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.astype(np.uint8).tobytes()]
    for f in frames:
        rows, columns = f.indices.shape
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", f.disposal << 2 | (f.transparent is not None), f.delay, f.transparent or 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, columns, rows, 0x87 if f.palette is not None else 0))
        if f.palette is not None:
            out.append(f.palette.astype(np.uint8).tobytes())
        out.append(b"\x08" + _blocks(lzw_encode(f.indices.tobytes())))
    return b"".join(out) + b"\x3b"


def decode(data: bytes) -> tuple[int, int, np.ndarray | None, list[Frame]]:
    """(width, height, global palette, frames) of a GIF file."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > PIXELS:
        raise ValueError(f"a screen of {width} x {height}")
    at, common, frames = 13, None, []

    def colours(flags: int, at: int):
        n = 2 << (flags & 7)
        return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n

    def blocks(at: int):
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    if flags & 0x80:
        common, at = colours(flags, at)
    control = (0, 0, None)
    while data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = blocks(at + 2)
            if kind == 0xF9:
                bits, delay, see = struct.unpack("<BHB", body[:4])
                control = (delay, bits >> 2 & 7, see if bits & 1 else None)
            continue
        left, top, columns, rows, bits = struct.unpack_from("<HHHHB", data, at + 1)
        if columns * rows > PIXELS:
            raise ValueError(f"a frame of {columns} x {rows}")
        at, own = at + 10, None
        if bits & 0x80:
            own, at = colours(bits, at)
        body, after = blocks(at + 1)
        pixels = np.frombuffer(lzw_decode(body, data[at])[: rows * columns].ljust(rows * columns, b"\0"), np.uint8).reshape(rows, columns)
        if bits & 0x40:
            order = np.concatenate([np.arange(a, rows, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(pixels)
            straight[order] = pixels
            pixels = straight
        frames.append(Frame(pixels, left, top, control[0], control[1], control[2], own))
        control, at = (0, 0, None), after
    return width, height, common, frames


def render(data: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start in hundredths of a second, delay, RGB canvas) of each frame in turn.

    Disposal 2 clears the frame's box to the background (black), 3 restores what was there.
    """
    return timed(*decode(data))


def timed(width: int, height: int, common: np.ndarray | None, frames: list[Frame]) -> Iterator[tuple[int, int, np.ndarray]]:
    """What ``render`` gives, of a decoded file."""
    canvas, now = np.zeros((height, width, 3), np.uint8), 0
    for f in frames:
        palette = f.palette if f.palette is not None else common if common is not None else GREY
        rows, columns = f.indices.shape
        box = (slice(f.top, min(f.top + rows, height)), slice(f.left, min(f.left + columns, width)))
        before = canvas[box].copy()
        seen = f.indices[: before.shape[0], : before.shape[1]]
        drawn = palette[np.minimum(seen, len(palette) - 1)]
        canvas[box] = drawn if f.transparent is None else np.where((seen == f.transparent)[..., None], before, drawn)
        yield now, f.delay, canvas.copy()
        now += f.delay
        if f.disposal == 2:
            canvas[box] = 0
        elif f.disposal == 3:
            canvas[box] = before


def histogram(rgb: np.ndarray, bins: int = 4) -> np.ndarray:
    """Counts of the bins x bins x bins colour cells."""
    q = rgb.reshape(-1, 3).astype(np.int64) * bins // 256
    return np.bincount((q[:, 0] * bins + q[:, 1]) * bins + q[:, 2], minlength=bins**3)


def gif_frames(df: DataFrame, media_col: str, id_col: str) -> DataFrame:
    """A row for each rendered frame: id, frame, start and delay, size, RGB bytes, colour histogram.

    A null or unreadable file, or one without frames, has one row, with its error and null
    columns. Frames go out one by one, so a task holds one canvas of a file.
    """
    schema = "id long, frame int, start_cs long, delay_cs int, width int, height int, rgb binary, histogram array<long>, error string"

    def shots(i, data):
        none, found = dict.fromkeys(FRAMES.names), False
        try:
            for k, (s, d, c) in enumerate(render(data or b"")):
                found = True
                yield dict(id=i, frame=k, start_cs=s, delay_cs=d, width=c.shape[1], height=c.shape[0], rgb=c.tobytes(), histogram=histogram(c).tolist(), error=None)
            if not found:
                yield none | {"id": i, "error": "no frames"}
        except (ValueError, IndexError, struct.error) as e:
            yield none | {"id": i, "error": str(e)}

    def run(batches):
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for row in shots(i, data):
                    yield pa.RecordBatch.from_pylist([row], schema=FRAMES)

    return df.select(df[id_col].cast("long").alias("id"), df[media_col].alias("media")).mapInArrow(run, schema)


FRAMES = pa.schema([("id", pa.int64()), ("frame", pa.int32()), ("start_cs", pa.int64()), ("delay_cs", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("rgb", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())])


def store(text: bytes) -> bytes:
    """The GIF file that holds a text's padded bytes."""
    payload = np.frombuffer(text.ljust(max(WIDTH, -(-len(text) // WIDTH) * WIDTH), b"\0"), np.uint8).reshape(-1, WIDTH)
    frames = [Frame(payload[i : i + ROWS], delay=10) for i in range(0, len(payload), ROWS)]
    return encode(frames, WIDTH, min(ROWS, len(payload)))


def seen(media: bytes) -> tuple[bytes, str]:
    """The payload of a file that ``store`` made, and its feature, from its rendered frames.

    A frame's samples are what the canvas shows in the frame's box, under a palette of greys. The
    feature is their number, delays, and the filled cells of their colour histogram, such as
    ``2:10,10:0=64,273=5``; a cell is (16 red + green) 16 + blue, of 16 levels each.
    """
    width, height, common, frames = decode(media)
    samples, delays, cells = [], [], np.zeros(LEVELS**3, np.int64)
    for f, (_, delay, canvas) in zip(frames, timed(width, height, common, frames), strict=True):
        rows, columns = f.indices.shape
        samples.append(canvas[f.top : f.top + rows, f.left : f.left + columns, 0].tobytes())
        delays.append(delay)
        cells += histogram(canvas, LEVELS)
    return b"".join(samples), f"{len(delays)}:{','.join(map(str, delays))}:{','.join(f'{k}={cells[k]}' for k in np.flatnonzero(cells))}"


def load(media: bytes) -> bytes:
    """The payload of a file that ``store`` made."""
    return seen(media)[0]


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """doc_id, sizes, digests and a feature of each text's GIF, and the file itself if kept."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media

    def one(text: bytes) -> tuple:
        media = store(text)
        payload, feature = seen(media)
        return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, media

    def run(batches):
        for b in batches:
            rows = [(i, *one(t.encode()))[: 8 + keep_media] for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()][: 8 + keep_media]
    names = [x.split()[0] for x in schema.split(", ")]
    return texts(df, id_col, text_col).mapInArrow(run, schema)
