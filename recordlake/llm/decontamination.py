"""Benchmark decontamination by an FM-index of each training shard.

A shard is a batch of documents as word numbers of the benchmark's vocabulary. Runs of such words that are
too short for any window can't hold one and are left out; the rest is indexed: suffix array, Burrows-Wheeler
transform, wavelet matrix. All windows are searched backwards at once, occurrences located through sampled
suffix positions, and their words merged into spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, carried, carried_schema, cut, documents, nullable_ints, slices

WINDOW = 10
#: Bytes of benchmark text searched for at a time; more is searched in blocks.
BLOCK_BYTES = 64 << 20
#: Documents of a shard, and bytes after which a shard is closed earlier.
SHARD_ROWS, SHARD_BYTES = 4_000, 16 << 20
SAMPLE = 8
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit plane per binary digit."""

    def __init__(self, values: np.ndarray, n_symbols: int) -> None:
        self.n_bits = max(1, int(n_symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for b in range(self.n_bits - 1, -1, -1):
            bit = (values >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int64)]))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place `at`."""
        lo = np.zeros_like(at)
        for ones, zeros, b in zip(self.ones, self.zeros, range(self.n_bits - 1, -1, -1), strict=True):
            up = ((symbols >> b) & 1).astype(bool)
            lo = np.where(up, zeros + ones[lo], lo - ones[lo])
            at = np.where(up, zeros + ones[at], at - ones[at])
        return at - lo


def suffix_array(values: np.ndarray) -> np.ndarray:
    """By prefix doubling, for a sequence that ends with its only smallest symbol."""
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    span = 1
    while True:
        following = np.zeros(n, np.int64)
        following[: n - span] = rank[span:] + 1 if span < n else 0
        key = rank * (n + 2) + following
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        span *= 2


class FMIndex:
    def __init__(self, values: np.ndarray, n_symbols: int) -> None:
        sa = suffix_array(values)
        self.n = len(values)
        self.bwt = values[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(values, minlength=n_symbols))])
        self.wavelet = WaveletMatrix(self.bwt, n_symbols)
        self.marked = sa % SAMPLE == 0
        self.sampled = np.where(self.marked, sa, -1)[self.marked]
        self.nth_mark = np.cumsum(self.marked) - 1

    def step(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.first[symbols] + self.wavelet.rank(symbols, rows)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns, all of one length, searched backwards together."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j]
            lo[alive], hi[alive] = self.step(c, lo[alive]), self.step(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
            if not len(alive):
                break
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the rows' suffixes: steps back through the text until a sampled place is met."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            hit = self.marked[rows[open_]]
            at = open_[hit]
            out[at] = self.sampled[self.nth_mark[rows[at]]] + steps[at]
            open_ = open_[~hit]
            rows[open_] = self.step(self.bwt[rows[open_]], rows[open_])
            steps[open_] += 1
        return out


@dataclass
class Phrases:
    """Windows of benchmark items over a vocabulary numbered from 1, by length."""

    vocabulary: dict[bytes, int]
    windows: dict[int, np.ndarray]
    items: dict[int, list[list[int]]]

    @property
    def shortest(self) -> int:
        return min(self.windows, default=0)


def phrases(items: list[tuple[int, str]], window: int = WINDOW) -> Phrases:
    """Windows of `window` consecutive words of each item; an item of fewer words, but not none, is one window."""
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[int]] = {}
    for item, text in items:
        numbers = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in alnum_words(text)]
        for at in range(max(1, len(numbers) - window + 1) if numbers else 0):
            found.setdefault(tuple(numbers[at : at + window]), set()).add(item)
    by: dict[int, list[tuple[int, ...]]] = {}
    for w in sorted(found):
        by.setdefault(len(w), []).append(w)
    return Phrases(vocabulary, {n: np.array(w, np.int64) for n, w in by.items()}, {n: [sorted(found[x]) for x in w] for n, w in by.items()})


def search_shard(numbers: list[np.ndarray], p: Phrases) -> list[tuple[int, int, int, list[int]]]:
    """(document, first word, length, items) of every occurrence in the documents, given as word numbers (0: not in the vocabulary)."""
    if not p.windows:
        return []
    sizes = np.array([len(x) + 1 for x in numbers], np.int64)
    flat = np.zeros(int(sizes.sum()), np.int64)
    starts = np.cumsum(sizes) - sizes
    for at, x in zip(starts, numbers, strict=True):
        flat[at : at + len(x)] = x
    zero = np.flatnonzero(flat == 0)
    begin = np.concatenate([[0], zero[:-1] + 1])
    length = zero - begin
    use = length >= p.shortest
    begin, length = begin[use], length[use]
    if not len(begin):
        return []
    # The kept runs, each with the 0 that ends it.
    where = np.repeat(begin - np.concatenate([[0], np.cumsum(length + 1)[:-1]]), length + 1) + np.arange(int((length + 1).sum()))
    # One up, so that the end's 0 is the only one: only then do steps backwards hold for every symbol.
    index = FMIndex(np.append(flat[where] + 1, 0), len(p.vocabulary) + 2)
    out = []
    for n, patterns in p.windows.items():
        lo, hi = index.search(patterns + 1)
        hits = np.flatnonzero(lo < hi)
        if not len(hits):
            continue
        counts = hi[hits] - lo[hits]
        rows = np.repeat(lo[hits] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        at = where[index.locate(rows)]
        doc = np.searchsorted(starts, at, side="right") - 1
        for d, a, w in zip(doc.tolist(), (at - starts[doc]).tolist(), np.repeat(hits, counts).tolist(), strict=True):
            out.append((d, a, n, p.items[n][w]))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.lower())]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def _shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in slices(frames, SHARD_ROWS):
        part = (f["text"].str.len().cumsum() // SHARD_BYTES).to_numpy()
        for k in np.unique(part):
            yield f[part == k].reset_index(drop=True)


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[tuple[Phrases, bool]]:
    """Phrases of one block of items after the other, and whether it is the last; each is collected when its turn comes."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("text")).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text").cast("bigint"))).head()[0] or 0
    n = math.ceil(size / block_bytes) or 1
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield phrases([(r["item_id"], r["text"]) for r in own], window), k == n - 1


SPANS = "spans array<struct<first:bigint,end:bigint>>"


def _numbers(text: str, vocabulary: dict[bytes, int]) -> np.ndarray:
    words = alnum_words(text)
    return np.fromiter(map(vocabulary.get, words, repeat(0)), np.int32, len(words))


def _search(f: pd.DataFrame, p: Phrases) -> tuple[list[int], list[list[tuple[int, int]]], list[set[int]]]:
    """Of each document of a shard: number of words, merged spans and items, with those that blocks before have found."""
    # Four bytes a word; a shard's words as objects would take ten times its text.
    numbers = [_numbers(t, p.vocabulary) for t in f["text"]]
    before = "spans" in f
    spans = [[(x["first"], x["end"]) for x in s] for s in f["spans"]] if before else [[] for _ in numbers]
    items = [set(x) for x in f["items"]] if before else [set() for _ in numbers]
    for d, at, n, own in search_shard(numbers, p):
        spans[d].append((at, at + n))
        items[d].update(own)
    return list(map(len, numbers)), [_merged(s) if s else s for s in spans], items


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, clean: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (word ranges) and clean_text, if asked for, else null.
    Columns named in `carry` come along as carry_0, ...; others are left out, whatever their names.

    Benchmark items are the stated query set: they are searched for in blocks of `block_bytes`, each broadcast and dropped
    before the next, with a pass over the documents per block; spans are written between passes. Items
    without id, text or words match nothing; items that share an id count once. Null text has no words. Repeated
    documents are judged each alike. Nothing is shuffled.
    """
    sc = docs.sparkSession.sparkContext
    rows = documents(docs, carry)
    also = carried(rows)
    more = carried_schema(rows)
    as_rows = lambda merged: [[{"first": a, "end": b} for a, b in s] for s in merged]

    def collect_spans(shared):  # noqa: ANN001, ANN202
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in _shards(frames):
                _, merged, items = _search(f, shared.value)
                out = pd.DataFrame({"doc_id": nullable_ints(f["doc_id"]), "text": f["text"], "spans": as_rows(merged), "items": [sorted(s) for s in items]})
                yield out.assign(**{c: f[c] for c in also})

        return run

    def report(shared):  # noqa: ANN001, ANN202
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in _shards(frames):
                words, merged, items = _search(f, shared.value)
                out = pd.DataFrame(
                    {
                        "doc_id": nullable_ints(f["doc_id"]),
                        "n_words": words,
                        "n_hit": [sum(b - a for a, b in s) for s in merged],
                        "n_items": [len(s) for s in items],
                        "items_sha256": [hashlib.sha256(",".join(sorted(map(str, s))).encode()).hexdigest() for s in items],
                        "contaminated": [bool(s) for s in merged],
                        "spans": as_rows(merged),
                        "clean_text": [_without(t, s) if clean and s else t if clean else None for t, s in zip(f["text"], merged, strict=True)],
                    }
                )
                yield out.assign(**{c: f[c] for c in also})

        return run

    for block, last in _blocks(benchmark, window, block_bytes):
        shared = sc.broadcast(block)
        if last:
            columns = f"doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, {SPANS}, clean_text string"
            return rows.mapInPandas(report(shared), columns + more)
        rows = cut(rows.mapInPandas(collect_spans(shared), f"doc_id bigint, text string, {SPANS}, items array<bigint>{more}"))
        shared.unpersist()
    raise AssertionError("there is always a last block")


def op10_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontaminate(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
