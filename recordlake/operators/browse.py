"""Faceted browse: filters composed as predicates, sorts, pages, and two-phase text search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions.text import snippet


@dataclass(frozen=True)
class FilterSpec:
    """What a reader asks for. Exclusions always win; an unknown language matches no language choice."""

    query: str = ""
    query_columns: tuple[str, ...] = ()
    equal: tuple[tuple[str, object], ...] = ()
    not_equal: tuple[tuple[str, object], ...] = ()
    at_least: tuple[tuple[str, object], ...] = ()
    tags: str = "tags"
    include: tuple[str, ...] = ()
    match_all: bool = True
    exclude: tuple[str, ...] = ()

    def predicate(self) -> Column:
        out = F.lit(True)
        for column, value in self.equal:
            out &= F.coalesce(F.col(column) == value, F.lit(False))
        for column, value in self.not_equal:
            out &= F.coalesce(F.col(column) != value, F.lit(False))
        for column, value in self.at_least:
            out &= F.coalesce(F.col(column) >= value, F.lit(False))
        if self.include or self.exclude:
            out &= tag_match(F.col(self.tags), self.include, self.exclude, self.match_all)
        if self.query:
            out &= F.lower(F.concat_ws(" ", *self.query_columns)).contains(self.query.lower())
        return out


def tag_match(tags: Column, include: tuple[str, ...], exclude: tuple[str, ...], match_all: bool) -> Column:
    """Any or all of the included tags and none of the excluded; no tags at all count as an empty list."""
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    out = F.lit(True)
    if include:
        wanted = F.array(*(F.lit(x) for x in include))
        out &= F.size(F.array_intersect(tags, wanted)) == len(set(include)) if match_all else F.arrays_overlap(tags, wanted)
    if exclude:
        out &= ~F.arrays_overlap(tags, F.array(*(F.lit(x) for x in exclude)))
    return out


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of one page (from 1); numbers below 1 give the first page."""
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def search(rows: DataFrame, text: str, tokens: tuple[str, ...] = (), phrase: str = "") -> Column:
    """Predicate of the second phase: all tokens, or the phrase, as substrings of the lower-cased text."""
    low = F.lower(F.col(text))
    if phrase:
        return low.contains(phrase.lower())
    out = F.lit(True)
    for t in tokens:
        out &= low.contains(t.lower())
    return out


def with_snippet(rows: DataFrame, text: str, needle: str, width: int = 220) -> DataFrame:
    return rows.withColumn("snippet", snippet(F.col(text), needle.lower(), width))
