"""Lexicons with context: all phrases of all rules in one automaton, run once over a text, and what stands around a hit may take it back.

Phrases are rows: rule, rank (the rules' order), phrase. A hit is a whole phrase without regard to case: no word character stands
beside it. Hits come with their places, so context and order are column expressions afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HITS = "array<struct<rank: int, start: int, length: int>>"
#: Fixed numbers of characters before and behind a hit that count as its context.
BEFORE, BEHIND = 70, 65


@lru_cache(maxsize=4)
def automaton(phrases: tuple[tuple[int, str], ...]) -> ahocorasick.Automaton:
    """Of rank and phrase; a phrase of several rules leads to all of them."""
    ranks: dict[str, list[int]] = {}
    for rank, phrase in phrases:
        ranks.setdefault(phrase.lower(), []).append(rank)
    out = ahocorasick.Automaton()
    for phrase, own in ranks.items():
        out.add_word(phrase, (len(phrase), own))
    out.make_automaton()
    return out


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def find(text: str | None, machine: ahocorasick.Automaton) -> list[dict]:
    """Hits in the order of their places, the rules' order among hits of one place."""
    low = "".join(c if len(x := c.lower()) != 1 else x for c in text or "")  # one character each, so that places hold
    out = []
    for end, (length, ranks) in machine.iter(low):
        start = end - length + 1
        if (start == 0 or not _is_word(low[start - 1])) and (end + 1 == len(low) or not _is_word(low[end + 1])):
            out += [{"rank": r, "start": start, "length": length} for r in ranks]
    return sorted(out, key=lambda h: (h["start"], h["rank"], h["length"]))


def hits(phrases: list[tuple[int, str]]) -> Callable[[Column], Column]:
    """A function from a text to its hits (start from 0). The phrases are a rule book, which is small, and travel with the function."""
    own = tuple((r, p) for r, p in phrases if p)

    @F.pandas_udf(HITS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = automaton(own) if own else None
        for texts in batches:
            yield texts.map(lambda t: find(t, machine) if machine else [])

    return run


def context(text: Column, hit: Column) -> tuple[Column, Column]:
    """What stands before and behind a hit, lower-cased."""
    start = hit["start"]
    first = F.greatest(F.lit(0), start - BEFORE)
    return F.lower(F.substring(text, first + 1, start - first)), F.lower(F.substring(text, start + hit["length"] + 1, F.lit(BEHIND)))


def standing(text: Column, found: Column, denied: dict[int, tuple[str | None, str | None]]) -> Column:
    """The hits that their context leaves: `denied` has, by rank, patterns of what before or behind a hit takes it back."""

    def keep(h: Column) -> Column:
        before, behind = context(text, h)
        out = F.lit(True)
        for rank, (left, right) in denied.items():
            bad = F.lit(False)
            if left:
                bad = bad | before.rlike(f"(?:{left})$")
            if right:
                bad = bad | behind.rlike(f"^(?:{right})")
            out = out & ~((h["rank"] == rank) & bad)
        return out

    return F.filter(found, keep)


def _placed(text: Column, found: Column, nth: int, field: str, by_rank: dict) -> Column:
    """The standing hits of one field, with its number and name and what was matched."""
    matched = lambda h: F.left(F.substring(text, h["start"] + 1, h["length"]), F.lit(BEFORE))
    return F.transform(standing(text, found, by_rank), lambda h: F.struct(h["rank"].alias("rank"), F.lit(nth).alias("nth"), h["start"].alias("start"), F.lit(field).alias("field"), matched(h).alias("matched")))


def review_signals(records: DataFrame, fields: list[str], rules: list[tuple[str, str]], denied: dict[str, tuple[str | None, str | None]]) -> DataFrame:
    """id, rule, field, matched: of each rule (named in pairs of rule and phrase, in order) the first standing hit, in the fields' order."""
    names = list(dict.fromkeys(r for r, _ in rules))
    run = hits([(names.index(r), p) for r, p in rules])
    by_rank = {names.index(r): d for r, d in denied.items()}
    own = records.select("id", *fields, *(run(F.coalesce(F.col(f), F.lit(""))).alias(f"hits_{i}") for i, f in enumerate(fields)))
    each = [_placed(F.coalesce(F.col(f), F.lit("")), F.col(f"hits_{i}"), i, f, by_rank) for i, f in enumerate(fields)]
    # Of one place the shorter text comes first; per rule the least by field and place counts.
    rows = own.select("id", F.explode(F.concat(*each)).alias("h"))
    first = rows.groupBy("id", "h.rank").agg(F.min(F.struct("h.nth", "h.start", "h.field", "h.matched")).alias("m"))
    return first.select("id", F.get(F.array(*map(F.lit, names)), F.col("rank")).alias("rule"), "m.field", "m.matched")


def context_flags(text: Column, rules: list[tuple[str, str]], needs: dict[str, tuple[str, tuple[str, ...]]]) -> Column:
    """A struct of booleans: whether each rule has a hit, and for each of `needs` whether its first rule and any of the others have."""
    names = list(dict.fromkeys(r for r, _ in rules))
    ranks = F.transform(hits([(names.index(r), p) for r, p in rules])(text), lambda h: h["rank"])
    has = {n: F.array_contains(ranks, i) for i, n in enumerate(names)}
    also = {n: has[first] & F.exists(F.array(*(has[o] for o in others)), lambda x: x) for n, (first, others) in needs.items()}
    return F.struct(*(c.alias(n) for n, c in (has | also).items()))


def clues(text: Column, opening: Column, traits: list[tuple[str, str]], places: list[tuple[str, str]], most: int = 5) -> Column:
    """traits: the first `most` traits in rule order that the text has; place: the first place in rule order that the opening has."""

    def named(rules: list[tuple[str, str]], x: Column) -> tuple[list[str], Column]:
        names = list(dict.fromkeys(r for r, _ in rules))
        ranks = F.array_sort(F.array_distinct(F.transform(hits([(names.index(r), p) for r, p in rules])(x), lambda h: h["rank"])))
        return names, ranks

    own, ranks = named(traits, text)
    first = F.transform(F.slice(ranks, 1, most), lambda r: F.get(F.array(*map(F.lit, own)), r))
    where, at = named(places, opening)
    return F.struct(first.alias("traits"), F.get(F.array(*map(F.lit, where)), F.get(at, 0)).alias("place"))
