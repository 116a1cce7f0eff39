"""License scans: named phrases, and an exact set-similarity join of text blocks with notice templates.

A-Z are lower-cased; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A block is a window of 2 L words, one every L words,
where L is the longest template's word count, so a stretch of L words lies whole in some block. A block matches a template
if it holds at least ``threshold`` of the template's distinct words, and all those that name its license: without them a
short notice would match any other one of the same wording.

The join orders a template's words by their frequency in the whole corpus, rarest first. A match shares ``need`` of the n
words, hence one of the first n - need + 1 (prefix filter): only texts with such a word are cut into blocks. A block needs
``need`` distinct words itself (length filter), and is given up as soon as the template words still to come are too few
(positional filter). Nothing is sampled, so every matching block is found.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import bounded, chunks, text_bytes
from ._scan import Block

WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
BREAK = bytes(b if WORD[b] else 32 for b in range(256))
THRESHOLD = 0.8

# Phrases that name a license, and its label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices of common licenses, by label.
TEMPLATES = {
    "agpl": ["GNU Affero General Public License as published by the Free Software Foundation", "Released under the AGPL License"],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License",
        "Released under the Apache License",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Released under the BSD License",
    ],
    "cc-by": ["Licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "Released under the GPL License",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License"],
    "lgpl": ["Released under the LGPL License", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "Released under the MIT License",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Released under the MPL License"],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced"],
}
# The words that name a license. A template that holds some of its label's matches no block without them.
NAMES = {
    "agpl": "affero agpl",
    "apache": "apache file compliance basis",
    "bsd": "bsd",
    "cc-by": "attribution by",
    "cc-by-nc": "nc noncommercial",
    "cc-by-sa": "sa sharealike",
    "gpl": "gnu gpl hope",
    "isc": "isc fee",
    "lgpl": "lesser lgpl",
    "mit": "mit",
    "mpl": "mozilla mpl",
    "proprietary": "rights publication",
}
#: A template of fewer distinct words matches only whole.
SHORT = 6
MATCH = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("template", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("containment", T.DoubleType()), T.StructField("best", T.BooleanType())]))

MATCH_FIELDS = ("label", "template", "first_word", "containment", "best")


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(BREAK).split()


def word_frequencies(docs: DataFrame, vocabulary: list[bytes], text_col: str = "text") -> dict[bytes, int]:
    """Occurrences of the vocabulary's words over all texts; only they come to the driver."""
    wanted = frozenset(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for part in chunks(batches):
            _, off, view = text_bytes(part.column(0))
            whole = Counter(words_of(b" ".join(bytes(view[i:j]) for i, j in zip(off, off[1:], strict=False))))
            total.update({w: whole[w] for w in wanted if w in whole})
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counts = docs.select(docs[text_col].cast("string").alias("text")).transform(bounded).mapInArrow(run, "word binary, n long")
    return {bytes(r[0]): r[1] for r in counts.groupBy("word").agg(F.sum("n")).collect()}


class Templates:
    """Templates as word lists in the corpus's frequency order, with an index of their prefixes."""

    def __init__(self, templates: dict[str, list[str]], threshold: float, frequency: dict[bytes, int], names: dict[str, str] = NAMES):
        self.rows, self.number, self.own, self.named, self.index, longest = [], [], [], [], defaultdict(list), 1
        for label, texts in sorted(templates.items()):
            for number, text in enumerate(texts):
                longest = max(longest, len(words_of(text.encode())))
                ordered = sorted(set(words_of(text.encode())), key=lambda w: (frequency.get(w, 0), w))
                need = len(ordered) if len(ordered) < SHORT else math.ceil(threshold * len(ordered) - 1e-9)
                for word in ordered[: len(ordered) - need + 1] if ordered else ():
                    self.index[word].append(len(self.rows))
                self.rows.append((label, ordered, need))
                self.number.append(number)
                self.own.append(frozenset(ordered))
                self.named.append(frozenset(words_of(names.get(label, "").encode())) & self.own[-1])
        self.longest = longest

    def containment(self, block: set[bytes], k: int) -> float:
        """Of template k in the block; 0 where the length, the names or the positional filter rule a match out."""
        _, ordered, need = self.rows[k]
        if len(block) < need or not self.named[k] <= block:
            return 0.0
        shared = 0
        for place, word in enumerate(ordered):
            shared += word in block
            if shared + len(ordered) - place - 1 < need:
                return 0.0
        return shared / len(ordered)

    def matches(self, words: list[bytes]) -> list[tuple[str, int, int, float, bool]]:
        """(label, template, first word, containment, best) of every template and block that match, by template and block.

        ``template`` counts a label's templates as listed. ``best`` is false where another label's template fits the same
        words better, as lgpl does where gpl is found in it: each stretch with ``need`` of the match's words lies mostly
        inside a stretch of the other, with no word of its own. Notices beside each other are all best.
        """
        step, found = self.longest, []
        hits = defaultdict(set)
        for at, word in enumerate(words):
            for k in self.index.get(word, ()):
                hits[at // step * step].add(k)
                if at >= step:
                    hits[at // step * step - step].add(k)
        whole = defaultdict(dict)
        for first in sorted(hits):
            block = set(words[first : first + 2 * step])
            for k in sorted(hits[first]):
                if part := self.containment(block, k):
                    found.append((k, first, part))
                    whole[first][k] = self._whole(words, first, k, len(block & self.own[k]))
        # the end of a notice and the start of the next one make a whole of their own, which gives way to the shorter one
        kept = {
            first: {k: x for k, x in part.items() if not any(k in (o := whole.get(other, {})) and o[k][0] < x[1] and x[0] < o[k][1] and _rank(o[k]) < _rank(x) for other in (first - step, first + step))}
            for first, part in whole.items()
        }
        out = []
        for k, first, part in found:
            near = [(j, x) for other in (first - step, first, first + step) for j, x in kept.get(other, {}).items() if self.rows[j][0] != self.rows[k][0]]
            better = [(a, b, self.own[j]) for j, (a, b, shared) in near if self._fit(j, shared) > self._fit(k, len(self.own[k].intersection(words[a:b])))]
            best = not better or any(
                all(2 * (min(b, d) - max(a, c)) <= b - a or not self.own[k].intersection(words[a:b]) <= other for c, d, other in better)
                for a, b in self._stretches(words, first, k, self.rows[k][2])
            )
            out.append((self.rows[k][0], self.number[k], first, part, best))
        return [m for _, m in sorted(zip(((k, first) for k, first, _ in found), out, strict=True))]

    def _fit(self, k: int, shared: int) -> tuple[int, float]:
        return shared, shared / len(self.own[k])

    def _stretches(self, words: list[bytes], first: int, k: int, least: int) -> list[tuple[int, int]]:
        """Stretches of the block with ``least`` distinct words of template k, none of which holds another one."""
        out, last = [], {}
        for at in range(first, min(first + 2 * self.longest, len(words))):
            if words[at] in self.own[k]:
                last[words[at]] = at
                if len(last) >= least and (start := sorted(last.values())[-least]) > (out[-1][0] if out else -1):
                    out.append((start, at + 1))
        return out

    def _whole(self, words: list[bytes], first: int, k: int, shared: int) -> tuple[int, int, int]:
        """The shortest stretch of the block with all its ``shared`` words of template k, and their number."""
        return (*min(self._stretches(words, first, k, shared), key=lambda x: x[1] - x[0]), shared)


def _rank(stretch: tuple[int, int, int]) -> tuple[int, int, int]:
    """Most words first, then the shortest, then the earliest."""
    start, end, shared = stretch
    return -shared, end - start, start


def vocabulary(templates: dict[str, list[str]]) -> list[bytes]:
    return sorted({w for texts in templates.values() for t in texts for w in words_of(t.encode())})


def phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    lasts = {p[-1] for p, _ in phrases}
    return [(at - len(p) + 1, label) for at, w in enumerate(words) if w in lasts for p, label in phrases if at + 1 >= len(p) and words[at - len(p) + 1 : at + 1] == p]


def find_licenses(
    docs: DataFrame,
    keep: list[str] | None = None,
    text_col: str = "text",
    templates: dict[str, list[str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The ``keep`` columns of docs (default: all) with n_words, n_base, first_word, last_word, base_labels, matches.

    n_base counts the places of phrases, first_word and last_word are the least and greatest of them (else null);
    base_labels are distinct and sorted; matches are all pairs of a template and a block that match. A null text reads as empty: no
    words, no matches. Columns of docs named like the new ones are replaced. Templates and phrases are parameters of the
    scan and go to every task; texts are read whole.
    """
    added = T.StructType.fromDDL("n_words long, n_base long, first_word long, last_word long, base_labels array<string>").add("matches", MATCH)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added.names]
    schema = T.StructType([*(docs.schema[c] for c in keep), *added])
    index = Templates(templates, threshold, word_frequencies(docs, vocabulary(templates), text_col))
    named = [(words_of(p.encode()), label) for p, label in phrases.items()]
    triggers = sorted({*index.index, *(p[-1] for p, _ in named)})
    list_type, match_type = pa.list_(pa.string()), pa.list_(pa.struct([("label", pa.string()), ("template", pa.int64()), ("first_word", pa.int64()), ("containment", pa.float64()), ("best", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "__text"):
            _, off, view = text_bytes(part.column(len(keep)))
            block = Block([bytes(view[i:j]).lower() for i, j in zip(off, off[1:], strict=False)])
            inside = WORD[block.bytes]
            begins = np.concatenate([[0], np.cumsum(inside & ~np.concatenate([[False], inside[:-1]]))])
            n_words = np.diff(begins[block.starts])
            places, labels, matches = ([[] for _ in block.texts] for _ in range(3))
            hits = [k for word in triggers for k in block.finds(word)]
            for row in set(block.rows(hits).tolist()) if hits else ():
                words = words_of(block.texts[row])
                found = phrase_places(words, named)
                places[row], labels[row] = [a for a, _ in found], sorted({b for _, b in found})
                matches[row] = [dict(zip(MATCH_FIELDS, m, strict=True)) for m in index.matches(words)]
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[: len(keep)],
                    pa.array(n_words, pa.int64()),
                    pa.array([len(p) for p in places], pa.int64()),
                    pa.array([min(p, default=None) for p in places], pa.int64()),
                    pa.array([max(p, default=None) for p in places], pa.int64()),
                    pa.array(labels, list_type),
                    pa.array(matches, match_type),
                ],
                names=schema.names,
            )

    return docs.select(*keep, docs[text_col].cast("string").alias("__text")).transform(bounded).mapInArrow(run, schema)
