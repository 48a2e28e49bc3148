"""License scans: an exact set-similarity join of text blocks with license templates.

Words are runs of ASCII letters and digits or other letters, A-Z lower-cased. A block is a
window of consecutive words of the whole text, line breaks and marks between words ignored, as
many as the template has; it matches a template if it holds at least ``threshold`` of the
template's distinct words. So notices that wrap are found, also behind comment marks, and words
that are dealt over a longer stretch are not. Of windows that overlap and match, the first of
those that hold most counts.

Tokens are ordered by how many documents hold them, rarest first, counted over all documents. A
template's prefix must meet the text (prefix filter), the text must have enough of the
template's words (length filter), and a meeting place must leave enough words on both sides
(positional filter); of what is left every window is counted exactly. Blocks are never compared
pairwise: the template side is a fixed list, so nothing grows with a group of equal lines.

Defined cases: null texts are empty (no words, no labels, score 0); null ids and repeated rows
are kept, other columns are ignored; the word counts of an empty table are empty.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

# Phrases and labels of the base scan.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices and paragraphs of well-known licenses, in their usual words.
TEMPLATES = {
    "agpl-header": "GNU Affero General Public License as published by the Free Software Foundation, either version",
    "agpl-notice": "licensed under the GNU Affero General Public License",
    "apache-2.0-conditions": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "boost-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-warranty": "ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-notice": "licensed under a Creative Commons Attribution ShareAlike license",
    "cc0-deed": "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    "gpl-3-notice": "licensed under the GNU General Public License, version 3",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-warranty": "THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "lgpl-header": "GNU Lesser General Public License as published by the Free Software Foundation, either version",
    "lgpl-notice": "licensed under the GNU Lesser General Public License",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-notice": "Released under the MIT License",
    "mit-rights": "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-warranty": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-2.0-header": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "unlicense-rights": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "unlicense-text": "This is free and unencumbered software released into the public domain",
    "zlib-rights": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib-warranty": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}
THRESHOLD = 0.9
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def base_places(words: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(word index, label) of every place where a phrase's words stand in a row, in order."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases.items():
        needle = b" " + phrase.encode() + b" "
        at = joined.find(needle)
        seen = index = 0
        while at >= 0:
            index += joined.count(b" ", seen, at)
            seen = at
            found.append((index, label))
            at = joined.find(needle, at + 1)
    return sorted(found)


def document_counts(df: DataFrame, vocabulary: set[bytes], id_col: str = "doc_id", text_col: str = "text") -> dict[bytes, int]:
    """Documents that hold each word of the vocabulary: at most a row a word comes back."""

    def run(batches):
        total: Counter = Counter()
        for b in batches:
            for t in b.column(1).to_pylist():
                total.update(vocabulary.intersection(words_of(t)))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k.decode() for k in total]), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = texts(df, id_col, text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in rows.collect()}


class ContainmentIndex:
    """Templates under a global token order, ready to meet blocks."""

    def __init__(self, templates: dict[str, str], counts: dict[bytes, int], threshold: float = THRESHOLD):
        vocabulary = {w for t in templates.values() for w in words_of(t)}
        self.rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
        self.templates, self.prefix, self.lengths = [], defaultdict(list), []
        for label, text in templates.items():
            tokens = sorted(self.rank[w] for w in set(words_of(text)))
            if not tokens:
                continue
            need = max(1, math.ceil(threshold * len(tokens) - 1e-9))
            k = len(self.templates)
            self.templates.append((label, tokens, frozenset(tokens), need))
            self.lengths.append(len(words_of(text)))
            for at, token in enumerate(tokens[: len(tokens) - need + 1]):
                self.prefix[token].append((k, at))
        names = {k: w for w, k in self.rank.items()}
        self.openers = {names[k] for k in self.prefix}
        self.shortest = min((t[3] for t in self.templates), default=1)

    def near(self, words) -> list[tuple[int, int]]:
        """(template, shared words) of the templates that pass the filters and have enough words among these."""
        tokens = sorted({self.rank[w] for w in words if w in self.rank})
        if len(tokens) < self.shortest:
            return []
        held, out, tried = set(tokens), [], set()
        for token in tokens:
            for k, at in self.prefix.get(token, ()):
                if k in tried:
                    continue
                _, own, own_set, need = self.templates[k]
                if len(tokens) < need or 1 + min(len(own) - at - 1, len(tokens) - bisect_right(tokens, token)) < need:
                    continue
                tried.add(k)
                both = len(held & own_set)
                if both >= need:
                    out.append((k, both))
        return out

    def matches(self, words) -> list[tuple[str, float]]:
        """(label, containment) of the templates that a block of any length meets."""
        return [(self.templates[k][0], both / len(self.templates[k][1])) for k, both in self.near(words)]

    def windows(self, words: list[bytes], held: set[bytes]) -> list[tuple[int, str, float]]:
        """(first word, label, containment) of the runs of words that meet a template, as many words as it has."""
        near = self.near(held)
        if not near:
            return []
        tokens = {w: self.rank[w] for w in held.intersection(self.rank)}
        places = [(at, tokens[w]) for at, w in enumerate(words) if w in tokens]
        out = []
        for k, _ in near:
            label, _, need_set, need = self.templates[k]
            wide = self.lengths[k]
            hits = [x for x in places if x[1] in need_set]
            inside: Counter = Counter()
            last, best = 0, None  # the run of overlapping windows that match: its best one
            for at, token in hits:
                inside[token] += 1
                while hits[last][0] <= at - wide:
                    gone = hits[last][1]
                    inside[gone] -= 1
                    if not inside[gone]:
                        del inside[gone]
                    last += 1
                if len(inside) < need:
                    continue
                found = (hits[last][0], at + 1, label, len(inside) / len(need_set))
                if best and found[0] < best[1]:
                    best = found if found[3] > best[3] else best
                else:
                    out += [best] if best else []
                    best = found
            out += [best] if best else []
        return sorted((a, label, share) for a, _, label, share in out)


def scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, word and place counts, labels, score, and the blocks (first word, label, containment).

    score: the largest containment found, 1 where a base phrase stands, else 0.
    """
    vocabulary = {w for t in templates.values() for w in words_of(t)}
    index = ContainmentIndex(templates, document_counts(df, vocabulary, id_col, text_col), threshold)

    def one(text: str) -> tuple:
        words = words_of(text)
        held = set(words)
        places = base_places(words) if b"license" in held or b"cc" in held else []
        blocks = index.windows(words, held) if not index.openers.isdisjoint(held) else []
        base = sorted({x for _, x in places})
        every = sorted({*base, *(x for _, x, _ in blocks)})
        score = 1.0 if places else max((x for _, _, x in blocks), default=0.0)
        return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base), ",".join(every), score, [dict(word=n, label=x, containment=s) for n, x, s in blocks]

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<word:long,label:string,containment:double>>"
    block = pa.struct([("word", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.list_(block)]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows = [(i, *one(t)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return texts(df, id_col, text_col).mapInArrow(run, schema)
