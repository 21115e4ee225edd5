"""Licence scans: passages against licence templates by Dice coefficient over word bigrams.

Text and templates are normalised alike: lower case, runs of letters and digits are the words. Compared are the whole text, its
paragraphs, lines and sentences, and every window of words up to (2-t)/t times as long as a template, across line ends, so a
notice amid other prose is compared by itself. A passage of n bigrams can reach a coefficient t only with templates of n*t/(2-t) to
n*(2-t)/t bigrams; the others are pruned by bisection over sizes. It must also share t/(2-t) of a template's bigrams, so
of any larger remainder it holds at least one: texts without a word of those, and templates of which a text (or the window
ahead) has fewer bigrams, are skipped, which loses nothing. Of overlapping finds the best is kept (then passages before windows,
the shorter passage or the longer window, then the earlier, then by name).

Full texts of licences (``license_texts/``) are compared first, by windows alone; what they cover is not searched for notices, as
they quote notices and share clauses with each other.

Null text counts as empty; an empty text, or one of a single word, has no bigrams and no finds. Texts of any length are scanned whole. Of licences
with one coefficient on one span the first by name is reported. Repeated rows are scanned
each. Ids may be null. Only id and text are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.batches import bounded

THRESHOLD = 0.8
#: Statements and notices of common licences; callers may pass their own.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "agpl-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    # The opening clause is that of all BSD licences.
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "bsd-2-clause": ("Licensed under the BSD 2-Clause License.",),
    "bsd-3-clause": ("Licensed under the BSD 3-Clause License.",),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0-1.0": ("Released under CC0 1.0 Universal.",),
    "epl-1.0": ("Licensed under the Eclipse Public License, Version 1.0.",),
    "epl-2.0": ("Licensed under the Eclipse Public License, Version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    "bsl-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "lgpl-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "lgpl-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
}
_WORD = re.compile(r"[^\W_]+")
_PARAGRAPH = re.compile(r"(?:(?!\n[ \t]*\n).)+", re.S)
_LINE = re.compile(r"[^\n]+")
_SENTENCE = re.compile(r"[^\n]+?(?:(?<=[.!?])(?=\s)|$|(?=\n))")


def full_texts() -> dict[str, tuple[str, ...]]:
    """The packaged texts of whole licences, by name."""
    return {p.stem: (p.read_text("utf-8"),) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    words = _WORD.findall(text.lower())
    return frozenset(zip(words, words[1:], strict=False))


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def passages(text: str) -> set[tuple[int, int]]:
    """Spans of the whole text, its paragraphs, lines and sentences."""
    spans = {(0, len(text))}
    for pattern in (_PARAGRAPH, _LINE, _SENTENCE):
        spans.update(m.span() for m in pattern.finditer(text))
    return spans


class Words:
    """The words of a text with their spans, and its bigrams by position."""

    def __init__(self, text: str):
        low = text.lower()
        found = [(m.group(), *m.span()) for m in _WORD.finditer(low)]
        words, self.start, self.end = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
        if len(low) != len(text):  # some characters have two in lower case
            at = [i for i, c in enumerate(text) for _ in c.lower()]
            self.start, self.end = [at[i] for i in self.start], [at[i - 1] + 1 for i in self.end]
        self.pairs: dict[tuple[str, str], int] = {}
        self.ids = np.array([self.pairs.setdefault(p, len(self.pairs)) for p in zip(words, words[1:], strict=False)], np.int64)
        last = np.full(len(self.pairs), -1)
        #: Where the same bigram stood before, or -1.
        self.before = np.empty(len(self.ids), np.int64)
        for i, k in enumerate(self.ids):
            self.before[i], last[k] = last[k], i


class Windows:
    """The best window of one text for one template from each start. One that begins or ends with another bigram is never better."""

    def __init__(self, words: Words, name: str, template: frozenset, length: int, threshold: float):
        self.words, self.name, self.size, self.threshold = words, name, len(template), threshold
        self.longest = int(length * (2 - threshold) / threshold + 1e-9)
        self.shared = np.fromiter((p in template for p in words.pairs), bool, len(words.pairs))[words.ids]

    def starts(self) -> Iterator[int]:
        total = np.concatenate([[0], np.cumsum(self.shared)])
        ahead = total[np.minimum(np.arange(len(self.shared)) + self.longest, len(self.shared))] - total[:-1]
        return iter(np.nonzero(self.shared & (ahead >= needed(self.size, self.threshold)))[0].tolist())

    def best(self, i: int, stop: int | None = None) -> tuple | None:
        """The entry in the heap of the best window from bigram ``i`` that ends before bigram ``stop``."""
        end = min(i + self.longest, len(self.shared) if stop is None else stop)
        if end <= i:
            return None
        new = self.words.before[i:end] < i
        score = 2 * np.cumsum(new & self.shared[i:end]) / (np.cumsum(new) + self.size)
        if score.max() < self.threshold:
            return None
        # Bigrams that came before leave the score as it is; the longest window is taken.
        k = int(np.nonzero((score == score.max()) & self.shared[i:end])[0][-1])
        a, b = self.words.start[i], self.words.end[i + k + 1]
        return (-float(score[k]), 1, a - b, a, self.name, b, self.size, i, self)


def needed(size: int, threshold: float) -> int:
    """How many of a template's bigrams any passage that reaches the threshold has."""
    return math.ceil(threshold / (2 - threshold) * size - 1e-9)


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float, full: dict[str, tuple[str, ...]] | None = None):
        self.threshold = threshold
        lengths = {b: len(_WORD.findall(t.lower())) - 1 for group in (templates, full or {}) for texts in group.values() for t in texts if (b := bigrams(t))}
        known, whole = (sorted(((len(b), name, b) for name, texts in group.items() for b in {bigrams(t) for t in texts} if b), key=lambda x: x[:2]) for group in (templates, full or {}))
        #: Sizes of notices; full texts have the numbers after them.
        self.sizes, self.notices = [n for n, _, _ in known], len(known)
        known += whole
        self.templates = [(name, b) for _, name, b in known]
        self.lengths = [lengths[b] for _, _, b in known]
        self.least = [needed(n, threshold) for n, _, _ in known]
        #: The templates that have a bigram.
        self.having: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i, (_, _, b) in enumerate(known):
            for pair in b:
                self.having[pair].append(i)
        self.anchors: set[str] = set()
        for n, _, b in known:
            spare = n - needed(n, threshold) + 1
            # Long words are rare words: any choice of ``spare`` bigrams would do.
            for pair in sorted(b, key=lambda p: (-max(map(len, p)), p))[:spare]:
                self.anchors.add(max(pair, key=lambda w: (len(w), w)))
        self.anchor = ahocorasick.Automaton()
        for a in self.anchors:
            self.anchor.add_word(a, a)
        self.anchor.make_automaton()

    def may_hold(self, text: str) -> bool:
        """Whether the text has one of the words without which no passage reaches the threshold."""
        return bool(self.anchors) and next(self.anchor.iter(text.lower()), None) is not None

    def candidates(self, n: int) -> range:
        """Which templates a passage of n bigrams can match, by size."""
        t = self.threshold
        return range(bisect_left(self.sizes, n * t / (2 - t) - 1e-9), bisect_right(self.sizes, n * (2 - t) / t + 1e-9))

    def possible(self, text: str) -> set[int]:
        """The templates of which the text has as many bigrams as any find must have."""
        words = _WORD.findall(text.lower())
        seen = Counter(i for pair in self.having.keys() & set(zip(words, words[1:], strict=False)) for i in self.having[pair])
        return {i for i, n in seen.items() if n >= self.least[i]}

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(licence, start, end, coefficient) of the finds, by start; offsets count code points."""
        text = text or ""
        if not self.may_hold(text) or not (possible := self.possible(text)):
            return []
        words, kept = Words(text), []

        def windows(numbers: list[int]) -> list[tuple]:
            every = [Windows(words, *self.templates[i], self.lengths[i], self.threshold) for i in numbers]
            return [f for w in every for at in w.starts() if (f := w.best(at))]

        notices = sorted(i for i in possible if i < self.notices)
        _choose(windows(sorted(possible.difference(notices))), kept)
        heap = windows(notices)
        for start, end in passages(text) if notices else ():
            own = bigrams(text[start:end])
            heap += [(-score, 0, end - start, start, self.templates[i][0], end) for i in self.candidates(len(own)) if i in possible and (score := dice(own, self.templates[i][1])) >= self.threshold]
        _choose(heap, kept)
        return [(name, start, end, score) for start, end, name, score in kept]


def _choose(heap: list[tuple], kept: list[tuple[int, int, str, float]]) -> None:
    """Adds the best finds that overlap no kept one, best first. A window that does is tried again as far as the next kept find."""
    heap = [(*f[:6], *(f[6:] or (0, 0, None))) for f in heap]
    heap = [(*f[:8], n, f[8]) for n, f in enumerate(heap)]
    heapify(heap)
    while heap:
        minus, _, _, start, name, end, _, i, n, windows = heappop(heap)
        at = bisect_right(kept, start, key=lambda k: k[0])
        after = kept[at][0] if at < len(kept) else end
        if at and kept[at - 1][1] > start:
            continue
        if end <= after:
            insort(kept, (start, end, name, -minus))
        elif windows is not None and (f := windows.best(i, bisect_right(windows.words.end, after) - 1)):
            heappush(heap, (*f[:8], n, windows))


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, license, start, end, score)`` of every find; a map without a shuffle. Templates of a caller's own stand for all."""
    chosen, full = templates or TEMPLATES, None if templates else full_texts()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(chosen, threshold, full)
        for part in parts:
            rows = [(d, *f) for d, t in zip(part["doc_id"], part["text"], strict=True) for f in scanner.scan(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "start", "end", "score"])

    rows = bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # An id that may be null must not pass through a float column.
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    found = rows.mapInPandas(run, "doc_id string, license string, start long, end long, score double")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
