"""Quality rules, line first, in DataFrame functions alone.

Every line is judged by punctuation, navigation and boilerplate rules. Lines that
fail are removed; a document that loses too much of its text is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

SYMBOLS = tuple("#*$%&|<>")
SEPARATORS = tuple("|»›•")
#: Fixed phrases of page furniture; a short line that holds one is boilerplate.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "subscribe to our newsletter",
    "click here",
    "enable javascript",
    "skip to content",
    "lorem ipsum",
)


@dataclass(frozen=True)
class QualityRules:
    """Thresholds. Shares are in percent, so that all tests are on whole numbers."""

    min_words: int = 50
    max_repeat_pct: int = 50
    max_separator_pct: int = 15
    max_symbol_pct: int = 8
    min_shout_bytes: int = 20
    max_double_marks: int = 2
    max_unpunctuated_words: int = 80
    min_distinct_pct: int = 20
    min_distinct_of_words: int = 12
    boilerplate_words: int = 20
    max_lost_pct: int = 40


def _count(text: Column, needles: tuple[str, ...]) -> Column:
    """Occurrences of the needles; plain byte replacement, far cheaper than a pattern."""
    counts = [(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(x), F.lit("")))) / len(x.encode()) for x in needles]
    return sum(counts[1:], counts[0]).cast("bigint")


def _words(line: Column) -> Column:
    """Words of one line. The separators become blanks first, since splitting at one character needs no pattern."""
    for c in "\t\x0b\x0c\r":
        line = F.replace(line, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(line, " "), "")


def _bad(e: Column, r: QualityRules) -> Column:
    """Whether a line fails a rule. Cheap tests stand first; patterns only run on lines they can reject."""
    line, n_words, n_bytes = e["line"], F.size(e["w"]), F.octet_length(e["line"])
    navigation = _count(line, SEPARATORS) * 100 > n_words * r.max_separator_pct
    symbols = _count(line, SYMBOLS) * 100 > n_bytes * r.max_symbol_pct
    shouting = (n_bytes >= r.min_shout_bytes) & (F.upper(line) == line) & (F.lower(line) != line)
    marks = _count(line, ("!!", "??", ",,", ";;")) > r.max_double_marks
    stuffing = (n_words >= r.min_distinct_of_words) & (F.size(F.array_distinct(e["w"])) * 100 < n_words * r.min_distinct_pct)
    unpunctuated = (n_words > r.max_unpunctuated_words) & ~line.rlike("[.,;:!?。、]")
    boilerplate = (n_words <= r.boilerplate_words) & F.lower(line).rlike("|".join(BOILERPLATE))
    return navigation | symbols | shouting | marks | stuffing | unpunctuated | boilerplate


def quality(docs: DataFrame, text: str = "text", rules: QualityRules | None = None, clean: bool = True) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and, if `clean`, clean_text.

    Any columns of `docs` stay, but those of the names just listed are replaced.
    Null text counts as empty: no words, base_failed, not kept, clean_text ''.
    A repeated row is judged as its twin is. Nothing is shuffled: each row is judged by
    itself, so size and skew of the table don't matter. Word windows are compared by 64-bit hash
    inside one text.
    """
    r = rules or QualityRules()
    extra = [c for c in docs.columns if c.lower() not in OUTPUTS]
    own = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(extra)]
    zero = F.lit(0).cast("bigint")
    step = docs.select(*own, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    step = step.withColumn("lines", F.transform(lines, lambda x: F.struct(x.alias("line"), _words(x).alias("w"))))
    step = step.withColumns(
        {
            "w": F.flatten(F.transform("lines", lambda e: e["w"])),
            "raw": F.transform("lines", lambda e: e["line"]),
            "n_symbols": _count(F.col("t"), SYMBOLS),
            "judged": F.transform("lines", lambda e: F.struct(e["line"].alias("line"), _bad(e, r).alias("bad"))),
        }
    ).drop("lines")
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    step = step.withColumns(
        {
            "n_words": F.size("w").cast("bigint"),
            "word_chars": F.length(F.array_join("w", "")).cast("bigint"),
            "h": F.when(F.size("w") >= 3, grams).otherwise(F.array().cast("array<bigint>")),
            "n_dup_lines": (F.size("raw") - F.size(F.array_distinct("raw"))).cast("bigint"),
        }
    ).drop("w", "raw")
    # Only texts in which a window recurs are sorted: windows by hash, then equal neighbours by place.
    pairs = F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    step = step.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(pairs)))
    twin = lambda e, i: F.coalesce(F.get("s", i - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get("s", i + 1)["x"] == e["x"], F.lit(False))
    step = step.withColumn("p", F.array_sort(F.transform(F.filter("s", twin), lambda e: e["i"])))
    covered = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("p", k + 1), x + 3) - x)), zero, lambda a, x: a + x)
    step = step.withColumns(
        {
            "n_repeat_words": F.coalesce(covered, zero),
            "lost": F.aggregate("judged", zero, lambda a, x: a + F.when(x["bad"], F.octet_length(x["line"])).otherwise(0)),
            "total": F.aggregate("judged", zero, lambda a, x: a + F.octet_length(x["line"])),
            "clean_text": F.array_join(F.transform(F.filter("judged", lambda x: ~x["bad"]), lambda x: x["line"]), "\n"),
        }
    )
    failed = (F.col("n_words") < r.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * r.max_repeat_pct)
    step = step.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("lost") * 100 <= F.col("total") * r.max_lost_pct)
    outputs = [c for c in OUTPUTS if clean or c != "clean_text"]
    # The results pass a generator of one row: a filter on them would else be pushed below the steps above, and arrays be
    # made anew for each of their elements.
    made = F.explode(F.array(F.struct(*(kept.alias(c) if c == "kept" else F.col(c) for c in outputs))))
    step = step.select(*(f"__{i}" for i in range(len(extra))), made.alias("made"))
    return step.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(extra)), *(F.col(f"made.{c}").alias(c) for c in outputs))


OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text")


def op7_quality(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed and kept."""
    return quality(docs.select("doc_id", "text"), clean=False).select("doc_id", *OUTPUTS[:-1])
