"""Collocations by vertical positional inverted lists.

The corpus is cut into blocks of some BLOCK_WORDS words. A block is held as an inverted index: of each word the sorted
positions at which it stands; a position is skipped between pieces and documents, so no phrase spans them. A phrase's list
is extended by merging it with the lists of the words one position further on. List lengths summed over all blocks are the
exact frequency, and only frequent phrases get lists, as every part of a frequent phrase is frequent too.

A level takes one shuffle of counts (phrase, block, length) by phrase, and one of lists by block. What grows with the corpus
are the numbers of blocks and of counts, never a task: a block is bounded, and a phrase has one count a block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, documents, drop, slices

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: Words of a block; a document is never divided, so a block holds at most one document more.
BLOCK_WORDS = 4_000_000
#: Pairs of words are counted in so many passes, each for a share of the first words, so that their counts aren't all on disk at once.
PASSES = 3

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: Separators become dots, which thus stand in no word.
_DOTTED = bytes(0x2E if b in _SEPARATORS else b for b in range(256))
_WORDS = "block bigint, lang string, word string, n bigint, gaps binary"
_LISTS = "block bigint, key bigint, prefix bigint, word bigint, n bigint, gaps binary"


def piece_words(text: str) -> list[bytes]:
    """The words of the text's pieces with A-Z lower-cased, as UTF-8, and a dot between pieces."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_DOTTED).replace(b".", b" . ").split()


def _packed(numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The numbers, seven bits a byte with the lowest first and the eighth set where more follow; and where each one ends."""
    size = 1 + sum((numbers >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        has = size > k
        out[(ends - size)[has] + k] = (numbers[has] >> 7 * k) & 127 | (size[has] > k + 1) << 7
    return out.tobytes(), ends


def _unpacked(raw: bytes) -> np.ndarray:
    own = np.frombuffer(raw, np.uint8)
    if not len(own):
        return np.zeros(0, np.int64)
    begins = np.r_[0, np.flatnonzero(own < 128)[:-1] + 1]
    nth = np.arange(len(own)) - np.repeat(begins, np.diff(np.r_[begins, len(own)]))
    return np.add.reduceat((own & 127).astype(np.int64) << 7 * nth, begins)


def _lists(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Distinct ids, the lengths of their lists and the lists: the packed gaps between sorted positions."""
    order = np.argsort(ids, kind="stable")
    ids, at = ids[order], at[order]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    gaps = np.diff(at, prepend=0)
    gaps[starts] = at[starts]
    raw, bounds = _packed(gaps)
    ends = np.r_[starts[1:], len(ids)]
    stops = bounds[ends - 1].tolist()
    return ids[starts], ends - starts, [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]


class _Block:
    """Words of some documents as numbers by lang, in the order of their positions; -1 stands between pieces."""

    def __init__(self) -> None:
        self.numbers: dict[str, dict[bytes, int]] = defaultdict(dict)
        self.names: list[tuple[str, bytes]] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: str) -> None:
        numbers, names, found = self.numbers[lang], self.names, []
        for w in piece_words(text):
            i = -1 if w == b"." else numbers.get(w, -2)
            if i == -2:
                i = numbers[w] = len(names)
                names.append((lang, w))
            found.append(i)
        self.parts.append(np.array([*found, -1], np.int32))
        self.size += len(found) + 1

    def rows(self, block: int) -> Iterator[pd.DataFrame]:
        ids = np.concatenate(self.parts)
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return
        found, lengths, gaps = _lists(ids[at], at)
        langs, words = zip(*(self.names[i] for i in found.tolist()), strict=True)
        out = pd.DataFrame({"block": block, "lang": langs, "word": [w.decode("utf-8", "surrogatepass") for w in words], "n": lengths, "gaps": gaps})
        totals = out.groupby("lang", as_index=False)["n"].sum().assign(block=block, word=None, gaps=None)
        yield totals[["block", "lang", "word", "n", "gaps"]]
        for a in range(0, len(out), 50_000):
            yield out.iloc[a : a + 50_000]


def word_lists(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """block, lang, word, n and gaps: each block's inverted index. A row without a word has the block's words of a lang."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for f in slices(frames, 1024):
            for text, lang in zip(f["text"], f["carry_0"], strict=True):
                block.add(lang, text)
                if block.size >= block_words:
                    yield from block.rows(number)
                    number, block = number + 1, _Block()
        if block.size:
            yield from block.rows(number)

    return docs.mapInPandas(run, _WORDS)


class _Index:
    """All lists of a block's rows, merged by position."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.keys = rows["key"].to_numpy(np.int64)
        lengths = rows["n"].to_numpy(np.int64)
        gaps = _unpacked(b"".join(rows["gaps"]))
        run = np.cumsum(gaps)
        starts = np.cumsum(lengths) - lengths
        at = run - np.repeat(run[starts] - gaps[starts], lengths) if len(gaps) else gaps
        order = np.argsort(at, kind="stable")
        self.at, self.which = at[order], np.repeat(np.arange(len(lengths)), lengths)[order]

    def found(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted positions: which of them are in some list, and the numbers of those lists."""
        if not len(self.at):
            return np.zeros(len(at), bool), np.zeros(0, np.int64)
        i = np.minimum(np.searchsorted(self.at, at), len(self.at) - 1)
        there = self.at[i] == at
        return there, self.which[i[there]]


def _extended(phrases: _Index, words: _Index, length: int, both: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of phrases that a word of the index follows, with the numbers of phrase and word.

    With `both`, one position further on a phrase of the same length must stand too, or the longer one can't be frequent.
    """
    there, word = words.found(phrases.at + length)
    at, phrase = phrases.at[there], phrases.which[there]
    if both and length > 1:
        keep, _ = phrases.found(at + 1)
        at, phrase, word = at[keep], phrase[keep], word[keep]
    return at, phrase, word


def _numbers(keys: np.ndarray, wanted: pd.Series) -> np.ndarray:
    """Places of the wanted keys, which all are among `keys`."""
    return pd.Index(keys).get_indexer(wanted.to_numpy(np.int64)).astype(np.int64)


def _level(length: int, share: int | None = None):  # noqa: ANN202
    """For one block: from its words' lists, its lists of phrases of `length` - 1 words and the frequent phrases of `length`
    words, the lists of the latter; and of all phrases one word longer, whose parts are frequent, the lengths of their lists.

    With `share`, only of those phrases whose beginning falls to that pass.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        block, kind = rows["block"].iloc[0], rows["kind"].to_numpy()
        words = _Index(rows[kind == 0])
        out, phrases = [], words
        if length > 1:
            before = words if length == 2 else _Index(rows[kind == 1])
            wanted = rows[kind == 2]
            at, phrase, word = _extended(before, words, length - 1, False)
            codes = _numbers(before.keys, wanted["prefix"]) * len(words.keys) + _numbers(words.keys, wanted["word"])
            which = pd.Index(codes).get_indexer(phrase * np.int64(len(words.keys)) + word)
            known = which >= 0
            if known.any():
                found, lengths, gaps = _lists(which[known], at[known])
                lists = wanted.iloc[found][["key", "prefix", "word"]].reset_index(drop=True).assign(block=block, n=lengths, gaps=gaps)
                out.append(lists)
            else:
                lists = rows[:0]
            phrases = _Index(lists)
        _, phrase, word = _extended(phrases, words, length, True)
        if share is not None:
            own = phrases.keys[phrase] % PASSES == share
            phrase, word = phrase[own], word[own]
        pair, counts = np.unique(phrase * np.int64(len(words.keys)) + word, return_counts=True)
        if len(pair):
            prefix, word = np.divmod(pair, len(words.keys))
            out.append(pd.DataFrame({"block": block, "key": 0, "prefix": phrases.keys[prefix], "word": words.keys[word], "n": counts, "gaps": None}))
        columns = ["block", "key", "prefix", "word", "n", "gaps"]
        return pd.concat([o[columns] for o in out], ignore_index=True) if out else pd.DataFrame(columns=columns)

    return run


def _kind(rows: DataFrame, kind: int) -> DataFrame:
    """The rows with all columns of `_LISTS`; missing numbers are 0, as pandas has no whole numbers beside nulls."""
    columns = [F.col(c) if c in rows.columns else F.lit(None if t == "binary" else 0).cast(t).alias(c) for c, t in (f.split() for f in _LISTS.split(", "))]
    return rows.select(F.lit(kind).alias("kind"), *columns)


def _frequent(counts: DataFrame, least: int) -> DataFrame:
    """The counts of frequent phrases, block by block, with a, the frequency; a written table."""
    a = F.sum("n").over(Window.partitionBy("prefix", "word"))
    found = counts.select("block", "prefix", "word", "n").withColumn("a", a).where(F.col("a") >= least)
    return cut(found.select("block", F.xxhash64("prefix", "word").alias("key"), "prefix", "word", "a"))


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """lang, n (its words), words (array), keys (of the words), key and a of every phrase of up to `max_words` words, single words too, that stands at least `min_count` times; a written table."""
    texts = documents(docs, ("lang",)).withColumn("carry_0", F.coalesce("carry_0", F.lit("und")))
    a = F.sum("n").over(Window.partitionBy("lang", "word"))
    found = word_lists(texts, block_words).withColumn("a", a).where((F.col("a") >= min_count) | F.col("word").isNull())
    found = cut(found.withColumn("key", F.when(F.col("word").isNotNull(), F.xxhash64("lang", "word"))))
    totals = found.where("word is null").groupBy("lang").agg(F.sum("n").alias("lang_words")).withColumnRenamed("lang", "of")
    words = found.where("word is not null")
    single = words.groupBy("key").agg(F.any_value("lang").alias("lang"), F.any_value("word").alias("w"), F.any_value("a").alias("a"))
    levels = [cut(single.join(F.broadcast(totals) if totals.count() < 10_000 else totals, F.col("lang") == F.col("of")).select("lang", F.col("lang_words").alias("n"), F.array("w").alias("words"), F.array("key").alias("keys"), "key", "a"))]
    names = levels[0].select(F.col("key").alias("word"), F.col("words").alias("next_words"))

    base = _kind(words.select("block", "key", "n", "gaps"), 0)
    owns = [_frequent(base.groupBy("block").applyInPandas(_level(1, share), _LISTS), min_count) for share in range(PASSES)]
    own, extended = reduce(DataFrame.unionByName, owns), None
    for length in range(2, max_words + 1):
        before = levels[-1].select(F.col("key").alias("prefix"), "lang", "n", "words", "keys")
        distinct = own.groupBy("key", "prefix", "word").agg(F.any_value("a").alias("a"))
        longer = distinct.join(before, "prefix").join(names, "word")
        levels.append(cut(longer.select("lang", "n", F.concat("words", "next_words").alias("words"), F.concat("keys", F.array("word")).alias("keys"), "key", "a")))
        past, past_owns = extended, owns
        if length < max_words:
            parts = base.unionByName(_kind(own, 2))
            parts = parts if past is None else parts.unionByName(_kind(past.where("gaps is not null"), 1))
            extended = cut(parts.groupBy("block").applyInPandas(_level(length), _LISTS))
            owns = [own := _frequent(extended.where("gaps is null"), min_count)]
        drop(*past_owns, *([past] if past is not None else []))
    out = cut(reduce(DataFrame.unionByName, levels))
    drop(found, *levels)
    return out


def _key(keys: Column, first: Column, length: Column, max_words: int) -> Column:
    """The key of `length` of the words from `first` (from 1): each further word is hashed onto the key of those before."""
    part = F.slice(keys, first, length)
    out = F.get(part, 0)
    for i in range(1, max_words):
        out = F.when(length > i, F.xxhash64(out, F.get(part, i))).otherwise(out)
    return out


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each lang's first `top` phrases that hold together, by their weakest cut.

    Null text is empty, null lang is `und`. Repeated rows count each. Ties go by frequency, then by the phrase's bytes. A lang
    without frequent phrases, or an empty table, gives no rows. Other columns, named as they may be, are left out.
    """
    every = phrases(docs, min_count, max_words, block_words)
    size = F.size("keys")
    several = every.where(size > 1)
    # A phrase that only stands within a longer one stands within one that is a single word longer.
    within = every.where(size > 2).select("a", F.explode(F.array(_key(F.col("keys"), F.lit(1), size - 1, max_words), _key(F.col("keys"), F.lit(2), size - 1, max_words))).alias("key"))
    within = within.groupBy("key").agg(F.max("a").alias("longer"))
    free = several.join(within, "key", "left").where("longer is null or longer < a")

    cuts = free.select("lang", "n", "words", "key", "keys", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left_key": _key(F.col("keys"), F.lit(1), F.col("k"), max_words), "right_key": _key(F.col("keys"), F.col("k") + 1, size - F.col("k"), max_words)})
    left = every.select(F.col("key").alias("left_key"), F.col("a").alias("l"))
    right = every.select(F.col("key").alias("right_key"), F.col("a").alias("r"))
    cuts = cuts.join(left, "left_key").join(right, "right_key")
    score = F.expr("cast(1000 * cast(a as decimal(38,0)) * cast(n as decimal(38,0)) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0))) as bigint)")
    cuts = cuts.withColumn("score", score)
    weakest = cuts.groupBy("key").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), *(F.any_value(c).alias(c) for c in ("lang", "n", "words", "a")))
    scored = weakest.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(docs: DataFrame) -> DataFrame:
    """Each lang's first 2,000 collocations of 2 to 5 words; see `collocations`."""
    return collocations(docs)
