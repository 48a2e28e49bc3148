"""Personal data: base patterns, and further spans chosen by boosted trees.

Base spans (email, ip, card, phone) are pattern matches with checks. High-recall generators
propose further, overlapping spans (secret, ssn, iban, phone-like, card-like, masked email);
boosted trees score each from its format and its context, Platt scaling makes the score a
probability, and each kind has the smallest threshold that reaches ``PRECISION`` on held-out
examples. The training examples are generated here by rule from a fixed seed (``EXAMPLES`` of
them), so nothing of the corpus is sampled. Of overlapping proposals the likeliest stays (of
equally likely ones the first by kind as the generators list them, then by start), and none may
overlap a base span, so base spans always stay.

Every search walks a text once: runs of digits, of mail characters and of tokens are met whole
and by their first character only, and spans are compared with their neighbours in order.

Defined cases: null texts are empty (no spans); null ids and repeated rows are kept; other
columns are ignored; offsets are code points, ends exclusive; runs of any length are allowed.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("secret", "ssn", "iban", "phone2", "card2", "email2")
KINDS = BASE_KINDS + MORE_KINDS
EXAMPLES, PRECISION, SEED = 6000, 0.98, 7

# The base patterns, by the first character of a run: what starts later in it could not match either.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Code points of 19 digits with a separator between each two.
CARD_WIDEST = 37
DIGIT_RUN = re.compile(r"[0-9]+")

MAIL_CHARS = frozenset(string.ascii_letters + string.digits + "._%+-")


#: Digit to the digit that counts in every other place.
DOUBLED = str.maketrans("0123456789", "0246813579")


def luhn(digits: str) -> bool:
    back = digits[::-1]
    places = back[::2] + back[1::2].translate(DOUBLED)
    return sum(k * places.count(str(k)) for k in range(1, 10)) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Mail addresses: an @ with the run of mail characters before it and a dotted name after it."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in MAIL_CHARS:
            start -= 1
        done = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            found.append((start, done))
        at = text.find("@", done)
    return found


def _digits(s: str) -> str:
    return "".join(DIGIT_RUN.findall(s))


def _byte(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed, then by start."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= CARD_WIDEST:
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


NUMBERS = (
    ("ssn", re.compile(r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}")),
    ("phone2", re.compile(r"\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-][0-9]{3,4}")),
    ("card2", re.compile(r"(?<![0-9])[0-9](?:[ .-]?[0-9]){12,18}(?![0-9])")),
)
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: What stands for the @ of a masked address with the name after it; the name before it is walked back to.
MASKED = re.compile(r" ?[\[(] ?at ?[\])] ?[\w-]++(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[\w-]++)+", re.I)
#: Words before a span that speak for a kind.
CONTEXT = {
    "secret": ("password", "passwd", "pwd", "secret", "token", "key", "credential", "bearer", "auth"),
    "ssn": ("ssn", "social security", "tax id"),
    "iban": ("iban", "account", "konto", "bank"),
    "phone2": ("tel", "phone", "call", "fax", "mobile"),
    "card2": ("card", "visa", "mastercard", "amex", "credit"),
    "email2": ("mail", "contact", "write", "reach"),
}
EDGE = "\"'`,;:.!?()[]{}<>"
AROUND = 32
HEXES = frozenset("0123456789abcdef")
IBAN_FORM = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that any generator proposes; they may overlap."""
    out: list[tuple[str, int, int]] = []
    done = 0
    for m in DIGIT_RUN.finditer(text):  # whole tokens that hold digits and letters
        if m.start() < done:
            continue
        a, b = m.span()
        while a > done and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        done = b
        eq = max(text.rfind("=", a, b - 4), text.rfind(":", a, b - 4))
        a = eq + 1 if eq >= 0 else a
        while a < b and text[a] in EDGE:
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if b - a >= 8:
            token = text[a:b]
            if token.isascii() and any(c.isalpha() for c in token):
                out.append(("secret", a, b))
    if done:
        for kind, pattern in NUMBERS:
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
        out += [("iban", *m.span()) for m in IBAN.finditer(text)]
    low = text.lower() if "(" in text or "[" in text else ""
    if "at)" in low or "at]" in low or "at )" in low or "at ]" in low:
        done = 0
        for m in MASKED.finditer(text):
            a = m.start()
            while a > done and (text[a - 1].isalnum() or text[a - 1] in "_.+-"):
                a -= 1
            if a < m.start():
                out.append(("email2", a, m.end()))
            done = m.end()
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a span."""
    span, before = text[start:end], text[max(0, start - AROUND) : start].lower()
    n, counts = len(span), Counter(span)
    digits, plain = _digits(span), span.lower()
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    left, right = text[start - 1 : start], text[end : end + 1]
    groups = [len(x) for x in DIGIT_RUN.findall(span)]
    switches = 2 * len(groups) - (span[0].isdecimal() and span[0].isascii()) - (span[-1].isdecimal() and span[-1].isascii())
    own = CONTEXT[kind]
    rows = [kind == k for k in MORE_KINDS]
    rows += [n, len(digits), sum(k for c, k in counts.items() if c.isupper()), sum(k for c, k in counts.items() if c.islower()), len(digits) / n, entropy, len(counts)]
    rows += [bool(digits) and luhn(digits), len(groups), max(groups, default=0), min(groups, default=0), HEXES.issuperset(plain)]
    rows += [any(w in before for w in own), any(w in before[-12:] for w in own), before.rstrip(" \"'")[-1:] in ("=", ":") and bool(before), left.isalnum(), right.isalnum(), left in "-.+/" and bool(left), right in "-.+/" and bool(right)]
    rows += [_iban_ok(span), not counts.keys().isdisjoint("/\\._"), switches / n, digits[:3] in ("000", "666") or digits[:1] == "9", "-" in counts, sum(c in counts for c in string.digits)]
    return [float(x) for x in rows]


def _iban_ok(span: str) -> bool:
    s = span.replace(" ", "")
    if not IBAN_FORM.fullmatch(s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label) of candidates in sentences made by rule."""
    r = random.Random(seed)
    pick = lambda s, k: "".join(r.choices(s, k=k))
    hexes, alnum, dig = "0123456789abcdef", string.ascii_letters + string.digits, string.digits
    word = lambda: "".join(r.choice(("an", "the", "re", "ti", "on", "sch", "que", "eau", "os", "in", "ble")) for _ in range(r.randint(1, 4)))
    fill = lambda: " ".join(word() for _ in range(r.randint(2, 8)))

    def card() -> str:
        d = pick(dig, 15)
        return next(d + c for c in dig if luhn(d + c))

    def iban() -> str:
        land, body = r.choice(("DE", "FR", "ES", "GB", "NL")), pick(dig, 18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        return f"{land}{check:02d}{body}"

    good = [
        lambda: f"{r.choice(('password', 'passwd', 'api_key', 'secret', 'token', 'auth'))}{r.choice(('=', ': ', ' = '))}{r.choice(('', chr(34)))}{pick(hexes if r.random() < 0.6 else alnum, r.randint(10, 44))}9a{r.choice(('', chr(34)))}",
        lambda: f"{r.choice(('AKIA', 'ghp_', 'sk_live_'))}{pick(string.ascii_uppercase + dig, 16)}7Q",
        lambda: f"{r.choice(('SSN ', 'ssn: ', 'social security number '))}{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}",
        lambda: f"{r.choice(('IBAN ', 'account ', ''))}{iban()}",
        lambda: f"{r.choice(('tel. ', 'call ', 'phone: ', 'fax '))}{r.choice(('({}) {}-{}', '{}-{}-{}', '{}.{}.{}')).format(r.randint(200, 999), r.randint(200, 999), r.randint(1000, 9999))}",
        lambda: f"{r.choice(('card ', 'visa ', 'credit card: '))}{(lambda c: r.choice((c, '.'.join((c[:4], c[4:8], c[8:12], c[12:])))))(card())}",
        lambda: f"{r.choice(('mail ', 'contact ', 'write to ', ''))}{word()}{r.choice((' (at) ', '[at]', ' [at] '))}{word()}{r.choice((' (dot) ', '.', '[dot]'))}{r.choice(('com', 'org', 'net'))}",
    ]
    bad = [
        lambda: f"{word()}{pick(dig, r.randint(1, 4))}{word()}{word()}",
        lambda: f"version {pick(dig, 2)}.{pick(dig, 2)}.{pick(dig, 4)}-{word()}",
        lambda: f"{r.randint(1900, 2099)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}",
        lambda: f"https://{word()}.org/{word()}/{pick(dig, 5)}/{word()}.html",
        lambda: f"order {pick(dig, 3)}-{pick(dig, 2)}-{pick(dig, 4)}{pick(dig, 3)}",
        lambda: f"no. {pick(dig, r.randint(13, 19))}",
        lambda: f"isbn 978{pick(dig, 10)}",
        lambda: f"pages {r.randint(100, 400)} {r.randint(100, 400)} {r.randint(100, 999)}",
        lambda: f"sum {pick(dig, 3)} {pick(dig, 3)} {pick(dig, 3)} and {pick(dig, 3)}.{pick(dig, 3)}.{pick(dig, 3)}",
        lambda: f"meet {word()} (at) noon.{word()}",
        lambda: f"{word()}_{pick(dig, 4)}_{word()}.txt",
        lambda: f"AB{pick(dig, 2)} {pick(string.ascii_uppercase, 4)} {pick(string.ascii_uppercase + dig, 4)} {pick(string.ascii_uppercase, 4)}",
    ]
    out: list[tuple[str, str, int, int, int]] = []
    while len(out) < n:
        label = r.random() < 0.5
        made, head = r.choice(good if label else bad)(), fill() + " "
        text = f"{head}{made} {fill()}."
        for kind, a, b in candidates(text):
            if a >= len(head) - 1 and b <= len(head) + len(made) + 1:
                right = label and (b - a >= 0.4 * len(made) or kind == "secret") and not (kind == "phone2" and "ssn" in made.lower()) and not (kind == "secret" and ("at" in made and "@" not in made and ("[" in made or "(" in made)))
                out.append((text, kind, a, b, int(right)))
    return out[:n]


@dataclass
class Trees:
    """Boosted regression trees on binned features, all of one depth."""

    cuts: list[np.ndarray]
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] | None = None

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(math.log2(inner + 1))):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-(a * self.margin(x) + b)))


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 24, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss with greedy splits on histograms."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    inner = 2**depth - 1
    model = Trees(cuts, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, inner + 1)), math.log(p / (1 - p)))
    b, score = model.binned(x), np.full(len(x), model.base)
    feature, cut, leaf = np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), bins + 1), np.zeros((n_trees, inner + 1))
    for t in range(n_trees):
        q = 1 / (1 + np.exp(-score))
        g, h = y - q, q * (1 - q)
        node = np.zeros(len(x), np.int64)
        for k in range(inner):
            here = np.flatnonzero(node == k)
            best = (1e-6, 0, bins + 1)
            if len(here) > 10:
                gs, hs = g[here], h[here]
                whole = gs.sum() ** 2 / (hs.sum() + ridge)
                for j in range(x.shape[1]):
                    gl = np.cumsum(np.bincount(b[here, j], gs, bins + 1))
                    hl = np.cumsum(np.bincount(b[here, j], hs, bins + 1))
                    gain = gl**2 / (hl + ridge) + (gl[-1] - gl) ** 2 / (hl[-1] - hl + ridge) - whole
                    c = int(np.argmax(gain))
                    if gain[c] > best[0]:
                        best = (gain[c], j, c)
            feature[t, k], cut[t, k] = best[1:]
            node[here] = 2 * k + 1 + (b[here, best[1]] > best[2])
        at = node - inner
        leaf[t] = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        score += leaf[t][at]
    model.feature, model.cut, model.leaf = feature, cut, leaf
    return model


def train(n: int = EXAMPLES, precision: float = PRECISION, seed: int = SEED) -> Trees:
    """Trees from two thirds of the examples; the last third calibrates them and sets thresholds."""
    made = examples(n, seed)
    x = np.array([features(t, k, a, b) for t, k, a, b, _ in made])
    y = np.array([label for *_, label in made], float)
    cut = len(made) * 2 // 3
    model = fit_trees(x[:cut], y[:cut])
    m, held = model.margin(x[cut:]), y[cut:]
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt scaling by gradient steps
        p = 1 / (1 + np.exp(-(a * m + b)))
        a += 0.5 * np.mean((held - p) * m) / max(np.mean(m * m), 1e-9) * 4
        b += 0.5 * np.mean(held - p)
    model.scale = (float(a), float(b))
    p, kinds = model.probability(x[cut:]), np.array([k for _, k, *_ in made[cut:]])
    model.thresholds = {}
    for kind in MORE_KINDS:
        own = kinds == kind
        order = np.argsort(-p[own])
        right = np.cumsum(held[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= precision)
        model.thresholds[kind] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.1
    return model


def _apart(found: list[tuple[str, int, int]], spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Those found that overlap none of the spans."""
    bounds = sorted((a, b) for _, a, b in spans)
    starts, reach = [a for a, _ in bounds], list(accumulate((b for _, b in bounds), max))
    out = []
    for c in found:
        k = bisect_left(starts, c[2])
        if not k or reach[k - 1] <= c[1]:
            out.append(c)
    return out


def more_spans(text: str, base: list[tuple[str, int, int]], model: Trees) -> list[tuple[str, int, int]]:
    """Spans that the trees add; none overlaps a base span or another one."""
    found = candidates(text)
    if base:
        found = _apart(found, base)
    if not found:
        return []
    p = model.probability(np.array([features(text, *c) for c in found]))
    limits = np.array([model.thresholds[kind] for kind, _, _ in found])
    taken: list[tuple[str, int, int]] = []
    starts: list[int] = []
    ends: list[int] = []  # of the taken spans, which lie apart, so both lists rise
    for k in np.argsort(-p, kind="stable"):
        _, a, b = found[k]
        if p[k] < limits[k]:
            continue
        at = bisect_left(starts, b)
        if not at or ends[at - 1] <= a:
            starts.insert(at, a)
            ends.insert(at, b)
            taken.append(found[k])
    return sorted(taken, key=lambda s: (KINDS.index(s[0]), s[1]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with [KIND] for each span; overlapping spans become one, named after the first."""
    out, done = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[done:a], f"[{kind.rstrip('2').upper()}]"]
        done = b
    return "".join(out) + text[done:]


def find(df: DataFrame, model: Trees | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts and digest, all spans, base ones and added ones, and their number."""
    model = model or train()

    def one(text: str) -> tuple:
        base = base_spans(text)
        n = Counter(k for k, _, _ in base)
        spans = base + more_spans(text, base, model)
        return *(n[k] for k in BASE_KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans)

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"]

    def run(batches):
        for b in batches:
            rows = [(i, *one(t)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (5, 6) else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], names)

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(df: DataFrame, model: Trees | None = None, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span replaced in the text; a null text stays null."""
    model = model or train()

    @F.pandas_udf("string")
    def cleaned(column):
        def one(text):
            base = base_spans(text)
            spans = base + more_spans(text, base, model)
            return redacted(text, spans) if spans else text

        return column.map(one, na_action="ignore")

    return df.withColumn(text_col, cleaned(df[text_col]))
