"""Plain versions of the contracts, written from their wording."""

from __future__ import annotations

import hashlib
import re
from collections import Counter


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def repeats(rows):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256); ids are distinct."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(kept))
    return out


def shingle_set(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def near(rows):
    """doc_id -> (n_shingles, component_id, kept)."""
    sets = {d: shingle_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    posted: dict = {}
    for d in sorted(sets):
        both = Counter(e for s in sets[d] for e in posted.get(s, ()))
        for e, k in both.items():
            if 100 * k >= 75 * (len(sets[d]) + len(sets[e]) - k):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
        for s in sets[d]:
            posted.setdefault(s, []).append(d)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def _luhn(d):
    s = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d)))
    return s % 10 == 0


def personal(t):
    t = t or ""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and _luhn(digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]
    return out


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licenses(t):
    """(n_words, n_base, first_word, last_word, base_labels)."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def chats(rows):
    """conv_id -> (n_turns, turns_sha256, loss_chars, loss_sha256)."""
    by: dict = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        lost = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(lost), sha(lost))
    return out


def neighbours(rows, k=10, step=100):
    """query -> [(id, distance)], by exact search."""
    import numpy as np

    rows = [(i, np.array(v, float)) for i, v in rows]
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for i, v in rows:
        if i % step == 0:
            d = np.sqrt(((m - v) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out
