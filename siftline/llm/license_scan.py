"""License scans: an exact set-similarity join of text blocks with license templates.

A template is a list of word sequences with a label. Its tokens are (word, occurrence)
pairs, so repeats count, ordered by how often their words occur in all documents, rarest
first. A text block is a run of as many words as the template has; it meets the template
if it contains at least the template's share ``threshold`` of its tokens. Three filters
find every such block without looking at the others:

* prefix: of m tokens, need = ceil(threshold * m) must be there, so a block holds one of
  the m - need + 1 rarest; only places of those words open candidates;
* length: a document shorter than ``need`` words can't hold a block;
* positional: with its first prefix token at template rank i, a block can share at most
  m - i tokens, and the candidate windows are those that cover that place.

Candidates are verified by counting. Phrases with threshold 1 are then verified in
sequence ("places"); templates give labels and the best containment as score. Every window
that meets a template counts; of windows that overlap, the best (then the earliest) is its
block, so repeated notices give a block each.

Defined results: null and empty texts have no words, no labels and score 0. Repeated
texts get equal values; extra columns are ignored. Texts shorter than a template can
still meet it if they hold enough of its tokens.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import map_batches, narrow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
THRESHOLD = 0.8

# Phrases whose places are reported, and notices found by containment.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
NOTICES = [
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike 4 0 international license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
]


def words_of(text: str | None) -> list[str]:
    text = text or ""
    return WORD.findall(text.lower() if text.isascii() else text.translate(UPPER))


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    exact: bool  # a phrase: all words, in order
    threshold: float

    @property
    def need(self) -> int:
        return max(1, math.ceil(round((1.0 if self.exact else self.threshold) * len(self.words), 9)))


def templates(phrases: list[tuple[str, str]], notices: list[tuple[str, str]], threshold: float) -> list[Template]:
    both = [(x, y, True) for x, y in phrases] + [(x, y, False) for x, y in notices]
    return [Template(label, tuple(words_of(text)), exact, threshold) for label, text, exact in both]


class Scanner:
    """Templates with tokens in global frequency order, and their prefixes by word."""

    def __init__(self, found: list[Template], counts: dict[str, int]):
        self.templates = found
        self.by_word: dict[str, list[tuple[int, int]]] = {}
        self.sets = [Counter(t.words) for t in found]
        for k, t in enumerate(found):
            ranked = sorted(t.words, key=lambda w: (counts.get(w, 0), w))  # equal words stay together: occurrences
            for rank, w in enumerate(ranked[: len(ranked) - t.need + 1]):
                entries = self.by_word.setdefault(w, [])
                if (k, rank) not in entries and all(e[0] != k for e in entries):
                    entries.append((k, rank))

    def scan(self, words: list[str]) -> tuple[dict[int, list[int]], dict[int, tuple[int, int, float]]]:
        """Places of phrases, and of each other template the best block (start, end, containment)."""
        places, blocks = self.scan_all(words)
        return places, {k: max(v, key=lambda b: b[2]) for k, v in blocks.items()}

    def scan_all(self, words: list[str]) -> tuple[dict[int, list[int]], dict[int, list[tuple[int, int, float]]]]:
        """Places of phrases, and of each other template all blocks in order."""
        places: dict[int, list[int]] = {}
        windows: dict[int, dict[int, int]] = {}
        met = self.by_word.keys() & set(words)
        if not met:
            return places, {}
        for p, w in enumerate(words):
            if w not in met:
                continue
            for k, rank in self.by_word[w]:
                t, m = self.templates[k], len(self.templates[k].words)
                if len(words) < t.need or m - rank < t.need:  # length and positional filters
                    continue
                if t.exact:
                    for at in (i for i, x in enumerate(t.words) if x == w):
                        start = p - at
                        if start >= 0 and tuple(words[start : start + m]) == t.words:
                            places.setdefault(k, []).append(start)
                else:
                    self.meet(words, p, k, windows)
        return {k: sorted(set(v)) for k, v in places.items()}, {k: self.apart(len(words), k, v) for k, v in windows.items()}

    def apart(self, n: int, k: int, found: dict[int, int]) -> list[tuple[int, int, float]]:
        """The blocks of n words: windows taken best first, earlier ones first, that overlap none taken."""
        m, taken, out = len(self.templates[k].words), bytearray(n), []
        for start, shared in sorted(found.items(), key=lambda x: (-x[1], x[0])):
            end = min(n, start + m)
            if not (taken[start] or taken[end - 1]):
                taken[start:end] = b"\1" * (end - start)
                out.append((start, end, shared / m))
        return sorted(out)

    def meet(self, words: list[str], p: int, k: int, windows: dict[int, dict[int, int]]) -> None:
        """Adds all windows that cover place p and reach the threshold, as start: shared tokens."""
        t, m, want = self.templates[k], len(self.templates[k].words), self.sets[k]
        first = max(0, p - m + 1)
        have = Counter(words[first : first + m])
        shared = sum(min(n, have[w]) for w, n in want.items())
        start = first
        if shared >= t.need:
            windows.setdefault(k, {})[start] = shared
        while start < p and start + m < len(words):
            out, into = words[start], words[start + m]
            start += 1
            if out in want:
                shared -= have[out] <= want[out]
            have[out] -= 1
            have[into] += 1
            if into in want:
                shared += have[into] <= want[into]
            if shared >= t.need:
                windows.setdefault(k, {})[start] = shared


def word_counts(docs: DataFrame, vocabulary: set[str], text: str = "text") -> dict[str, int]:
    """How often each template word occurs in all documents; as many rows as the templates have words."""
    wanted = frozenset(vocabulary)

    def make():
        def f(text):
            total: Counter = Counter()
            for t in text:
                w = words_of(t)
                if not wanted.isdisjoint(w):
                    total.update(x for x in w if x in wanted)
            return {"word": list(total), "n": list(total.values())}

        return f

    rows = map_batches(narrow(docs, text=text), make, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in rows.collect()}


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks) of every document.

    ``blocks`` lists all blocks of each notice as (label, start word, end word, containment).
    """
    found = templates(phrases, notices, threshold)
    counts = word_counts(docs, {w for t in found for w in t.words}, text)

    def make():
        scanner = Scanner(found, counts)

        def f(key, text):
            names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks")
            out: dict[str, list] = {"key": key} | {n: [] for n in names}
            for t in text:
                words = words_of(t)
                places, blocks = scanner.scan_all(words)
                starts = [p for ps in places.values() for p in ps]
                base = {found[k].label for k in places}
                more = base | {found[k].label for k in blocks}
                score = max([1.0] * bool(starts) + [b[2] for bs in blocks.values() for b in bs], default=0.0)
                listed = [{"label": found[k].label, "start": b[0], "end": b[1], "containment": b[2]} for k, bs in sorted(blocks.items()) for b in bs]
                row = (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(more)), score, listed)
                for n, v in zip(names, row):
                    out[n].append(v)
            return out

        return f

    rows = narrow(docs, key=key, text=text)
    schema = f"key {dict(rows.dtypes)['key']}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, blocks array<struct<label:string,start:bigint,end:bigint,containment:double>>"
    return map_batches(rows, make, schema).withColumnRenamed("key", key)
