"""Suffix sorting by external induced sorting, for shards that may be larger than memory.

The suffixes at local minima (LMS) are sorted first, by recursion on their names, and all others follow from them: a
suffix's place tells the place of the one that begins a symbol earlier. Suffix tuples wait in priority queues keyed by
their first symbol. As tuples arrive in the order of their tails, tuples of one symbol leave in the order in which
they came, so a queue is a list of runs per symbol; runs beyond the memory bound go to a file. All steps work on whole
runs. The order is given as a stream, largest suffix first.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples that the queues of one pass hold in memory before they write runs to disk.
MEMORY_TUPLES = 8_000_000
#: Names up to this number are sorted in memory instead of by a further recursion.
BASE_SYMBOLS = 4_000_000


class RunQueue:
    """Priority queue of suffix places by first symbol, with its runs on disk when they are many."""

    def __init__(self, memory: int) -> None:
        self.memory, self.held = memory, 0
        self.runs: dict[int, list[np.ndarray | tuple[int, int]]] = {}
        self.order: list[int] = []
        self.file = None

    def push(self, symbols: np.ndarray, places: np.ndarray, descending: bool) -> None:
        if not len(places):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, places = symbols[order], places[order]
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)], strict=True):
            self.add(int(symbols[a]), places[a:b], descending)

    def add(self, symbol: int, places: np.ndarray, descending: bool) -> None:
        if symbol not in self.runs:
            self.runs[symbol] = []
            heapq.heappush(self.order, -symbol if descending else symbol)
        self.runs[symbol].append(places)
        self.held += len(places)
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        """All runs in memory to the file; it has no name, so it goes with the task."""
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for symbol, runs in self.runs.items():
            for i, run in enumerate(runs):
                if isinstance(run, np.ndarray):
                    runs[i] = self.file.tell(), len(run)
                    self.file.write(run.astype(np.int64).tobytes())
            self.runs[symbol] = runs
        self.held = 0

    def first(self) -> int | None:
        return abs(self.order[0]) if self.order else None

    def take(self, symbol: int) -> Iterator[np.ndarray]:
        """Runs of the first symbol, also those that are added meanwhile."""
        while runs := self.runs.get(symbol):
            if isinstance(runs[0], tuple):
                at, n = runs.pop(0)
                self.file.seek(at)
                yield np.frombuffer(self.file.read(8 * n), np.int64)
            else:
                k = next((i for i, r in enumerate(runs) if isinstance(r, tuple)), len(runs))
                part = runs[0] if k == 1 else np.concatenate(runs[:k])
                del runs[:k]
                self.held -= len(part)
                yield part
        if self.runs.pop(symbol, None) is not None:
            heapq.heappop(self.order)

    def close(self) -> None:
        if self.file:
            self.file.close()


def small_type(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The text ends with its only least symbol."""
    change = np.flatnonzero(text[1:] != text[:-1])
    out = np.ones(len(text), bool)
    out[:-1] = np.repeat(text[change] < text[change + 1], np.diff(change, prepend=-1))
    return out


def induce(text: np.ndarray, small: np.ndarray, minima: np.ndarray, memory: int = MEMORY_TUPLES) -> Iterator[np.ndarray]:
    """All suffixes from the largest on, given `minima`, the LMS places, in order (or in any order for their substrings' order)."""
    seeds, large = RunQueue(memory), RunQueue(memory)
    done = RunQueue(memory)  # large-type suffixes by symbol, for the way back
    seeds.push(text[minima], minima, False)
    while (c := min((x for x in (seeds.first(), large.first()) if x is not None), default=None)) is not None:
        sources = ([(large, True)] if large.first() == c else []) + [(seeds, False)]
        for queue, keep in sources:
            if queue.first() != c:
                continue
            for run in queue.take(c):
                if keep:
                    done.add(c, run, True)
                before = run[run > 0] - 1
                before = before[~small[before]]
                large.push(text[before], before, False)
    waiting = RunQueue(memory)
    waiting.add(int(text[-1]), np.array([len(text) - 1], np.int64), True)
    while (c := max((x for x in (waiting.first(), done.first()) if x is not None), default=None)) is not None:
        if waiting.first() == c:
            for run in waiting.take(c):
                yield run
                before = run[run > 0] - 1
                before = before[small[before]]
                waiting.push(text[before], before, True)
        if done.first() == c:
            for run in list(done.take(c))[::-1]:
                run = run[::-1]
                yield run
                before = run[run > 0] - 1
                before = before[small[before]]
                waiting.push(text[before], before, True)
    for queue in (seeds, large, done, waiting):
        queue.close()


def _names(text: np.ndarray, minima: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A number for each LMS substring, by their order; equal substrings share it. `order` lists them ascending."""
    end = np.full(len(text), len(text) - 1, np.int64)
    end[minima[:-1]] = minima[1:]
    length = end[order] - order + 1
    same = length[1:] == length[:-1]
    a, b, size = order[:-1], order[1:], length[:-1]
    live = np.flatnonzero(same)
    at = 0
    while len(live):
        live = live[size[live] > at]
        differ = text[a[live] + at] != text[b[live] + at]
        same[live[differ]] = False
        live = live[~differ]
        at += 1
    names = np.zeros(len(text), np.int64)
    names[order] = np.concatenate([[0], np.cumsum(~same)])
    return names[minima]


def _sort_in_memory(names: np.ndarray) -> np.ndarray:
    """Ranks by doubling: suffixes of the names, ascending."""
    n, rank, span = len(names), names, 1
    while True:
        after = np.zeros(n, np.int64)
        if span < n:
            after[:-span] = rank[span:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if rank[order[-1]] == n - 1:
            return order
        span *= 2


def suffixes(text: np.ndarray, memory: int = MEMORY_TUPLES, base: int = BASE_SYMBOLS) -> Iterator[np.ndarray]:
    """Places of all suffixes of `text`, largest first, in runs. The text ends with its only least symbol, 0."""
    small = small_type(text)
    minima = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(minima) < 2:
        yield from induce(text, small, minima if len(minima) else np.array([len(text) - 1]), memory)
        return
    is_minimum = np.zeros(len(text), bool)
    is_minimum[minima] = True
    order = np.concatenate([run[is_minimum[run]] for run in induce(text, small, minima, memory)])[::-1]
    names = _names(text, minima, order)
    if names.max() == len(minima) - 1:
        ranked = order
    elif len(minima) <= base:
        ranked = minima[_sort_in_memory(names)]
    else:
        ranked = minima[np.concatenate(list(suffixes(names, memory, base)))[::-1]]
    yield from induce(text, small, ranked, memory)


def equal_windows(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether `length` bytes from places a and from places b are the same; 8 bytes at a time."""
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    same = np.ones(len(a), bool)
    for at in [*range(0, length - 7, 8), length - 8]:
        same &= words[a + at] == words[b + at]
    return same


def window_groups(data: np.ndarray, text: np.ndarray, valid: np.ndarray, length: int, **bounds: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of two and more valid places with the same `length` bytes, as (places, group starts), in suffix order.

    A place's common prefix with its neighbour is carried as whether it reaches `length`. The last
    group of a run stays open, as the next run may go on with it.
    """
    rest = np.zeros(0, np.int64)

    def cut(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.concatenate([[True], ~equal_windows(data, places[:-1], places[1:], length)])
        return places, np.flatnonzero(new)

    for run in suffixes(text, **bounds):
        run = run[valid[run]]
        if not len(run):
            continue
        rest = np.concatenate([rest, run])
        if len(rest) < 1 << 16:
            continue
        places, starts = cut(rest)
        if len(starts) > 1:
            yield places[: starts[-1]], starts[:-1]
            rest = places[starts[-1] :]
    if len(rest):
        yield cut(rest)
