"""License scans by an exact set-similarity join of stretches of text with license templates.

A stretch of words, whatever lines and sentences it runs over, meets a template if it holds at least `threshold` of the template's
distinct words, is no longer than the template divided by the threshold, holds no word by which another license is told, and those by
which the template's own is told stand where they do in the template (`CC BY-NC` holds all words of `CC BY`, and most of `CC BY-NC-SA`). Template words are ordered by how many documents of the corpus hold them, rarest first, and
a text's words are put in that order too. A text with a stretch that meets a template holds a word of the template's prefix in
that order. Length: a text with too few listed words meets none. Position: what is matched so far and what follows the shared
word on both sides bounds the overlap still possible. What is left is verified stretch by stretch.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, cut, documents, nullable_ints, slices

#: Fixed phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Statements by which works name their license, and short licenses as a whole, with their labels.
TEMPLATES = (
    ("Released under the MIT License.", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache"),
    ("You may not use this file except in compliance with the License.", "apache"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("GNU Lesser General Public License", "lgpl"),
    ("GNU Library General Public License", "lgpl"),
    ("GNU Affero General Public License", "agpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Mozilla Public License, Version 2.0", "mpl"),
    ("Licensed under CC BY 4.0.", "cc-by"),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Licensed under CC BY-ND 4.0.", "cc-by-nd"),
    ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa"),
    ("Licensed under CC BY-NC-ND 4.0.", "cc-by-nc-nd"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "cc-by-nc-nd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl"),
    ("All rights reserved.", "all-rights-reserved"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "mit",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "isc",
    ),
    (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "gpl",
    ),
)
_SHARE, _TRADE, _CHANGE = ("sa", "sharealike"), ("nc", "noncommercial"), ("nd", "noderivatives", "noderivs")
#: Words by which another license than a template's own is told; no stretch that meets the template holds one.
WITHOUT = {
    "cc-by": (*_SHARE, *_TRADE, *_CHANGE),
    "cc-by-sa": (*_TRADE, *_CHANGE),
    "cc-by-nc": (*_SHARE, *_CHANGE),
    "cc-by-nd": (*_SHARE, *_TRADE),
    "cc-by-nc-sa": _CHANGE,
    "cc-by-nc-nd": _SHARE,
    "gpl": ("lesser", "library", "affero"),
    "lgpl": ("affero",),
    "agpl": ("lesser", "library"),
}
THRESHOLD = 0.9
#: Bound of what is broadcast at a time: words of templates. A longer list is met in several passes over the documents.
PASS_WORDS = 200_000


@dataclass
class Template:
    words: list[bytes]  # distinct, rarest first
    label: str
    need: int
    span: int  # words of text, of whatever lines and sentences, that may hold the template
    without: frozenset[bytes]
    behind: dict[bytes, set[bytes]]  # own words that tell the license from others, and what stands before them

    @property
    def prefix(self) -> list[bytes]:
        return self.words[: len(self.words) - self.need + 1]


@dataclass
class Templates:
    """Templates in one order of their words: `order` ranks all words, `index` finds templates and places by a prefix word's rank."""

    all: list[Template]
    order: dict[bytes, int]
    index: dict[int, list[tuple[int, int]]]
    starts: set[bytes]


def prepare(templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float, without: dict[str, tuple[str, ...]] | None = None) -> Templates:
    words = sorted({w for text, _ in templates for w in alnum_words(text)}, key=lambda w: (frequency.get(w, 0), w))
    order = {w: i for i, w in enumerate(words)}
    telling = {w.encode() for words_ in (without or {}).values() for w in words_}
    made, index = [], {}
    for text, label in templates:
        every = alnum_words(text)
        own = sorted(set(every), key=order.__getitem__)
        if own:
            barred = frozenset(w.encode() for w in (without or {}).get(label, ())) - set(own)
            behind = {w: {b for a, b in zip(every[1:], every, strict=False) if a == w} for w in telling.intersection(own)}
            t = Template(own, label, max(1, math.ceil(threshold * len(own) - 1e-9)), math.ceil(len(every) / threshold - 1e-9), barred, behind)
            for place, w in enumerate(t.prefix):
                index.setdefault(order[w], []).append((len(made), place))
            made.append(t)
    return Templates(made, order, index, {words[r] for r in index})


def join_block(words: Iterable[bytes], templates: Templates, tally: Counter | None = None) -> Iterator[tuple[Template, float]]:
    """Templates that the block meets, with their containment. `tally` counts what each filter drops."""
    own = set(words)
    ranks = sorted(templates.order[w] for w in own & templates.order.keys())
    shared: dict[int, int] = {}
    for j, rank in enumerate(ranks):
        for i, place in templates.index.get(rank, ()):
            t, so_far = templates.all[i], shared.get(i, 0)
            if so_far < 0:
                continue
            if len(ranks) < t.need:
                why = "length"
            elif so_far + 1 + min(len(t.words) - place - 1, len(ranks) - j - 1) < t.need:
                why = "position"
            else:
                shared[i] = so_far + 1
                continue
            shared[i] = -1
            if tally is not None:
                tally[why] += 1
    for i, so_far in shared.items():
        if so_far > 0:
            t = templates.all[i]
            held = sum(w in own for w in t.words)
            if tally is not None:
                tally["verified"] += 1
            if held >= t.need:
                yield t, held / len(t.words)


def join_spans(words: list[bytes], templates: Templates) -> Iterator[tuple[Template, int, int]]:
    """Templates that some stretch of `span` words meets, wherever lines and sentences end, with the first of those that hold most: its distinct words and its first word's place."""
    for t, _ in join_block(words, templates):
        wanted, held = set(t.words), dict.fromkeys(t.words, 0)
        at = [i for i, w in enumerate(words) if w in t.without or (w in wanted and (w not in t.behind or (i and words[i - 1] in t.behind[w])))]
        first = distinct = best = start = 0
        for j, i in enumerate(at):
            if words[i] in t.without:
                held, distinct, first = dict.fromkeys(t.words, 0), 0, j + 1
                continue
            distinct += not held[words[i]]
            held[words[i]] += 1
            while at[first] <= i - t.span:
                held[words[at[first]]] -= 1
                distinct -= not held[words[at[first]]]
                first += 1
            if distinct > best and all(held[w] for w in t.behind):
                best, start = distinct, at[first]
        if best >= t.need:
            yield t, best, start


def passes(templates: list[tuple[str, str]], bound: int) -> list[list[tuple[str, str]]]:
    """The list in parts of at most `bound` words, but at least one template."""
    out: list[list[tuple[str, str]]] = [[]]
    held = 0
    for t in templates:
        n = len(alnum_words(t[0]))
        if out[-1] and held + n > bound:
            out.append([])
            held = 0
        out[-1].append(t)
        held += n
    return out


def word_frequency(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Documents that hold each of the words, counted over the whole table; one row per word and task is shuffled."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = dict.fromkeys(vocabulary, 0)
        for f in frames:
            for text in f["text"]:
                for w in vocabulary.intersection(alnum_words(text)):
                    totals[w] += 1
        yield pd.DataFrame({"word": list(totals), "n": list(totals.values())})

    rows = documents(docs).select("text").mapInPandas(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()}


def places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand consecutively."""
    own = set(words)
    found = []
    for phrase, label in phrases:
        if own.issuperset(phrase):
            rest = phrase[1:]
            found += [(i, label) for i, w in enumerate(words) if w == phrase[0] and words[i + 1 : i + len(phrase)] == rest]
    return found


BLOCKS = "blocks array<struct<first:bigint,label:string,containment:double>>"


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, base: tuple[tuple[str, str], ...] = BASE, threshold: float = THRESHOLD, pass_words: int = PASS_WORDS, without: dict[str, tuple[str, ...]] = WITHOUT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and blocks (first word, label, containment).

    A block is the stretch that holds most of a template it meets. score is 1 with a base phrase, else the best containment, else 0. Null or empty texts have no words, labels ''
    and score 0. Repeated rows are each scanned; other columns are left out, whatever their names. Templates
    are broadcast in parts of `pass_words` words, one at a time; what they meet is written between the passes.
    """
    phrases = [(alnum_words(p), label) for p, label in base]
    parts = passes(list(templates if templates is not None else TEMPLATES), pass_words)
    rows = documents(docs)
    for i, part in enumerate(parts):
        ready = prepare(part, word_frequency(docs, {w for text, _ in part for w in alnum_words(text)}), threshold, without)
        shared = docs.sparkSession.sparkContext.broadcast(ready)
        if i < len(parts) - 1:
            rows = cut(rows.mapInPandas(_meet(shared), f"doc_id bigint, text string, {BLOCKS}"))
            shared.unpersist()
    columns = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    return rows.mapInPandas(_report(shared, phrases), columns + BLOCKS)


def _found(words: list[bytes], templates: Templates) -> list[dict]:
    if templates.starts.isdisjoint(words):
        return []
    return [{"first": start, "label": t.label, "containment": held / len(t.words)} for t, held, start in join_spans(words, templates)]


def _before(f: pd.DataFrame) -> list[list[dict]]:
    """Blocks that passes before have found."""
    return [list(b) for b in f["blocks"]] if "blocks" in f else [[] for _ in range(len(f))]


def _meet(shared):  # noqa: ANN001, ANN202
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in slices(frames, 1024):
            blocks = [b + _found(alnum_words(t), shared.value) for t, b in zip(f["text"], _before(f), strict=True)]
            yield pd.DataFrame({"doc_id": nullable_ints(f["doc_id"]), "text": f["text"], "blocks": blocks})

    return run


def _report(shared, phrases: list[tuple[list[bytes], str]]):  # noqa: ANN001, ANN202
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in slices(frames, 1024):
            rows = []
            for doc_id, text, before in zip(f["doc_id"], f["text"], _before(f), strict=True):
                words = alnum_words(text)
                own = places(words, phrases)
                blocks = before + _found(words, shared.value)
                at = [a for a, _ in own]
                base_labels = {label for _, label in own}
                labels = base_labels | {b["label"] for b in blocks}
                score = 1.0 if own else max((b["containment"] for b in blocks), default=0.0)
                rows.append((doc_id, len(words), len(own), min(at, default=None), max(at, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, blocks))
            out = pd.DataFrame(rows, columns=columns)
            yield out.assign(**{c: nullable_ints(out[c]) for c in ("doc_id", "first_word", "last_word")})

    return run


def op5_license_scan(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("blocks")
