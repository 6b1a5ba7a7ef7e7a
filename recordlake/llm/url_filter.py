"""URL filters by a Bloom filter cascade: exact membership of listed keys without a join.

A rule is a host with a path prefix. Every url yields the keys under which a rule
could list it: each host suffix joined with the path's prefixes of the lengths that
rules have. The first level of a cascade encodes the listed keys, the second the keys of
the corpus that pass the first by mistake, the third the listed keys that pass the second
by mistake, and so on until none is left. As the levels were built over all keys of the
corpus, a lookup is exact for each of them. A list too long for one filter of bounded size is dealt out over several
cascades by hash, which are broadcast one after the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

LISTS = ("block", "allow")
#: Levels after which a cascade is built anew with other hashes, as two keys must share both of their hashes then.
ROUNDS = 64
#: Bytes of a filter's page, the rows in which it reaches the driver.
PAGE = 8192


def positions(h1: np.ndarray, h2: np.ndarray, seed: int, j: int, n_bits: int) -> np.ndarray:
    """Bit j of each key in a filter of this seed; levels have their own seeds, or mistakes would recur in all of them."""
    x = (h1 ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15 | 1) + np.uint64(j) * (h2 | np.uint64(1))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) % np.uint64(n_bits)


@dataclass
class Level:
    """A Bloom filter; the bits of a key are taken from two 64-bit hashes."""

    seed: int
    n_bits: int
    n_hashes: int
    bits: np.ndarray

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), bool)
        for j in range(self.n_hashes):
            at = positions(h1, h2, self.seed, j, self.n_bits)
            found &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return found


def passes(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether the cascade lists each key: the first level that refuses decides by its parity."""
    listed = np.zeros(len(h1), bool)
    open_ = np.ones(len(h1), bool)
    for i, level in enumerate(levels):
        hit = level.has(h1, h2)
        listed[open_ & ~hit] = i % 2 == 1
        open_ &= hit
    listed[open_] = len(levels) % 2 == 1
    return listed


def _filled(keys: DataFrame, seed: int, n_bits: int, n_hashes: int) -> DataFrame:
    """A filter's pages that have bits: `page`, `bytes`. Bits are set where the keys are and put together page by page."""

    def set_bits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            h1, h2 = f["h1"].to_numpy().view(np.uint64), f["h2"].to_numpy().view(np.uint64)
            at = np.concatenate([positions(h1, h2, seed, j, n_bits) for j in range(n_hashes)])
            yield pd.DataFrame({"at": (at >> np.uint64(3)).astype(np.int64), "byte": (np.uint64(1) << (at & np.uint64(7))).astype(np.int32)})

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        page = np.zeros(PAGE, np.uint8)
        page[f["at"].to_numpy() % PAGE] = f["byte"].to_numpy()
        return pd.DataFrame({"page": f["page"].iloc[:1], "bytes": [page.tobytes()]})

    filled = keys.select("h1", "h2").mapInPandas(set_bits, "at bigint, byte int").groupBy("at").agg(F.bit_or("byte").alias("byte"))
    return filled.withColumn("page", F.floor(F.col("at") / PAGE)).groupBy("page").applyInPandas(pack, "page bigint, bytes binary")


def _bits(n: int, rate: float) -> int:
    return max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))


def _level(keys: DataFrame, seed: int, n: int, rate: float) -> Level:
    n_bits = _bits(n, rate)
    n_hashes = min(16, max(1, round(n_bits / max(n, 1) * math.log(2))))
    bits = np.zeros((n_bits // 8 // PAGE + 1) * PAGE, np.uint8)
    for row in _filled(keys, seed, n_bits, n_hashes).toLocalIterator(prefetchPartitions=True):
        bits[row["page"] * PAGE : (row["page"] + 1) * PAGE] = np.frombuffer(row["bytes"], np.uint8)
    return Level(seed, n_bits, n_hashes, bits[: n_bits // 8 + 1])


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[shared.value.has(f["h1"].to_numpy().view(np.uint64), f["h2"].to_numpy().view(np.uint64))]

    return keys.mapInPandas(keep, keys.schema)


def hashes(key: Column, salt: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(2 * salt), key), F.xxhash64(F.lit(2 * salt + 1), key)


def _hashed(keys: DataFrame, salt: int = 0) -> DataFrame:
    h1, h2 = hashes(F.col("key"), salt)
    return keys.select("key", h1.alias("h1"), h2.alias("h2"))


def first_rate(n_yes: int, n_all: int) -> float:
    """Error rate of the first level at which about as many corpus keys pass by mistake as there are listed keys."""
    return min(0.5, max(1e-9, n_yes / max(n_all, 1) / 2))


class NotClosed(RuntimeError):
    """Two keys share both hashes."""


def build_cascade(listed: DataFrame, universe: DataFrame, salt: int = 0) -> list[Level]:
    """Levels for the column `key` of both tables; `universe` holds every key that will be looked up.

    Sizes follow the list, not the corpus. Raises NotClosed if keys can't be told apart under this salt.
    """
    yes = _hashed(listed.select("key").distinct(), salt)
    n_yes = yes.count()
    if not n_yes:
        return []
    n_all = universe.count()
    # Listed keys aren't in the universe that passes by mistake: the cascade itself tells which of them it is asked for.
    no = _hashed(universe.select("key").join(listed.select("key"), "key", "left_anti"), salt)
    levels: list[Level] = []
    inside, outside, n_in = yes, no, n_yes
    for i in range(ROUNDS):
        levels.append(_level(inside, 7919 * (i + 1), n_in, first_rate(n_yes, n_all) if i == 0 else 0.01))
        wrong = cut(_passing(outside, levels[-1]))
        n_wrong = wrong.count()
        if not n_wrong:
            return levels
        inside, outside, n_in = wrong, inside, n_wrong
    raise NotClosed


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from there up to `?`, `#` or the end."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, upper, lower), path


def _keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys under which a rule could list the url, the longest first, of equal length the greatest text first."""
    labels = F.split(host, "\\.")
    suffixes = F.when(host != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))
    own = F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.length(path))
    prefixes = F.transform(own, lambda n: F.struct(n.alias("n"), F.substring(path, F.lit(1), n).alias("p")))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct((F.length(s) + p["n"]).alias("o"), F.concat(s, p["p"]).alias("k")))))
    return F.transform(F.sort_array(pairs, asc=False), lambda x: x["k"])


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", max_bytes: int = 64 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of `pages` (page_id, url).

    `rules` has host, path and action (block or allow); it may be long. A rule fits its host and all
    subdomains if the path starts with the rule's; the longest (host and path together) wins, of equally long
    ones the greatest text, block before allow where both list one key. Urls without a rule get `default`: the cascade proves them unlisted.
    Null urls or urls without `://` have empty host and path, no rule and the default. Repeated rows stay;
    empty tables give empty results; other columns are left out, whatever their names. Only cascades are broadcast, with
    filters up to `max_bytes`; a longer list takes several passes, each with the keys of one share of the hashes.
    """
    listed = rules.select(F.concat(F.lower("host"), F.coalesce(F.col("path"), F.lit(""))).alias("key"), F.length(F.coalesce(F.col("path"), F.lit(""))).alias("n"), "action").where("key is not null").distinct()
    lengths = [r["n"] for r in listed.select("n").distinct().collect()]  # no more than the longest path has characters
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = base.withColumn("keys", _keys(F.col("host"), F.col("path"), lengths))
    universe = cut(keyed.select(F.explode("keys").alias("key")).distinct())
    n_all, n_listed = universe.count(), max([r["n"] for r in listed.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()], default=0)
    shares = max(1, math.ceil(_bits(n_listed, first_rate(n_listed, n_all)) / 8 / max_bytes)) if n_listed else 1
    for salt in count():
        try:
            return _judged(keyed, listed, universe, default, shares, salt)
        except NotClosed:
            continue
    raise AssertionError("count() doesn't end")


def _judged(keyed: DataFrame, listed: DataFrame, universe: DataFrame, default: str, shares: int, salt: int) -> DataFrame:
    spark = keyed.sparkSession
    base = [f for f in keyed.schema.fields if f.name != "keys"]
    share = lambda key: F.pmod(F.xxhash64(F.lit(-1), key), F.lit(shares)).cast("int")
    state = keyed
    for k in range(shares):
        in_share = lambda df: df.where(share(F.col("key")) == k) if shares > 1 else df  # noqa: E731, B023
        cascades = {a: build_cascade(in_share(listed.where(F.col("action") == a)), in_share(universe), salt) for a in LISTS}
        shared = spark.sparkContext.broadcast(cascades)
        hashed = state.withColumn("h1", F.transform("keys", lambda x: hashes(x, salt)[0])).withColumn("h2", F.transform("keys", lambda x: hashes(x, salt)[1]))
        if shares > 1:
            hashed = hashed.withColumn("own", F.transform("keys", lambda x: share(x) == k))  # noqa: B023
        if k == shares - 1:
            schema = T.StructType([*base, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
            return hashed.mapInPandas(_judge(shared, default, [f.name for f in base], True), schema)
        fields = [*keyed.schema.fields, T.StructField("first", T.LongType()), T.StructField("verdict", T.StringType())]
        state = cut(hashed.mapInPandas(_judge(shared, default, [f.name for f in keyed.schema.fields], False), T.StructType(fields)))
        shared.unpersist()
    raise AssertionError("there is always a last share")


def _judge(shared, default: str, columns: list[str], last: bool):  # noqa: ANN001, ANN202
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sizes = f["h1"].map(len).to_numpy()
            begun = "first" in f
            first = f["first"].to_numpy(np.int64).copy() if begun else np.full(len(f), -1, np.int64)
            verdict = f["verdict"].to_numpy(object).copy() if begun else np.full(len(f), default, object)
            if sizes.sum():
                h1, h2 = (np.concatenate(f[c].to_list()).astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
                hits = {a: passes(c, h1, h2) if c else np.zeros(len(h1), bool) for a, c in shared.value.items()}
                found = hits["block"] | hits["allow"]
                if "own" in f:
                    found &= np.concatenate(f["own"].to_list()).astype(bool)
                row = np.repeat(np.arange(len(f)), sizes)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                found &= (first[row] < 0) | (nth < first[row])
                at = np.flatnonzero(found)[::-1]
                first[row[at]] = nth[at]  # written from the shortest to the longest, so the longest stays
                verdict[row[at]] = np.where(hits["block"][at], "block", "allow")
            own = f[columns].assign(verdict=verdict)
            yield own.assign(rule=[k[i] if i >= 0 else None for k, i in zip(f["keys"], first, strict=True)]) if last else own.assign(first=first)

    return run


#: Fixed rules of the query: host, path, action.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op1_url_filter(pages: DataFrame) -> DataFrame:
    rules = pages.sparkSession.createDataFrame(list(RULES), "host string, path string, action string")
    return judge_urls(pages.select("page_id", "url"), rules)
