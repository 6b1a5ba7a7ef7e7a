"""Weighted finite-state transducers over symbols: composition, and the best path of an input.

A transducer reads one symbol and writes one per arc. Weights are added along a path, and of several paths the
heaviest counts. An arc may take the weight of the word that is read.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Arc:
    target: Hashable
    out: str
    weight: float = 0.0
    takes: bool = False


@dataclass
class Transducer:
    start: Hashable
    finals: set[Hashable]
    arcs: dict[Hashable, dict[str, list[Arc]]] = field(default_factory=dict)

    def add(self, state: Hashable, symbol: str, target: Hashable, out: str | None = None, weight: float = 0.0, takes: bool = False) -> None:
        self.arcs.setdefault(state, {}).setdefault(symbol, []).append(Arc(target, symbol if out is None else out, weight, takes))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that feeds what `first` writes to `second`; only states that can be reached are made."""
    start = (first.start, second.start)
    made = Transducer(start, set())
    open_, seen = [start], {start}
    while open_:
        state = open_.pop()
        a, b = state
        if a in first.finals and b in second.finals:
            made.finals.add(state)
        for symbol, arcs in first.arcs.get(a, {}).items():
            for x in arcs:
                for y in second.arcs.get(b, {}).get(x.out, ()):
                    target = (x.target, y.target)
                    made.add(state, symbol, target, y.out, x.weight + y.weight, x.takes or y.takes)
                    if target not in seen:
                        seen.add(target)
                        open_.append(target)
    return made


def numbered(machine: Transducer) -> Transducer:
    """The same with states numbered from 0, without those from which no final state can be reached."""
    back: dict[Hashable, set[Hashable]] = {}
    for state, arcs in machine.arcs.items():
        for x in (x for some in arcs.values() for x in some):
            back.setdefault(x.target, set()).add(state)
    alive, open_ = set(machine.finals), list(machine.finals)
    while open_:
        for state in back.get(open_.pop(), ()):
            if state not in alive:
                alive.add(state)
                open_.append(state)
    number = {machine.start: 0}
    made = Transducer(0, set())
    for state in [machine.start, *(s for s in machine.arcs if s != machine.start), *machine.finals]:
        if state in alive:
            number.setdefault(state, len(number))
    made.finals = {number[s] for s in machine.finals}
    for state, arcs in machine.arcs.items():
        for symbol, some in arcs.items():
            for x in some:
                if state in number and x.target in number:
                    made.add(number[state], symbol, number[x.target], x.out, x.weight, x.takes)
    return made


def best(machine: Transducer, symbols: Iterable[tuple[str, float]]) -> float | None:
    """Weight of the heaviest path that reads all symbols, given with their words' weights, and ends in a final state."""
    at = {machine.start: 0.0}
    for symbol, own in symbols:
        after: dict[Hashable, float] = {}
        for state, weight in at.items():
            for x in machine.arcs.get(state, {}).get(symbol, ()):
                w = weight + x.weight + (own if x.takes else 0.0)
                if w > after.get(x.target, float("-inf")):
                    after[x.target] = w
        at = after
    return max((w for s, w in at.items() if s in machine.finals), default=None)
