"""Near-duplicates by Jaccard similarity of word shingles: SimHash groups first, then MinHash bands, each pair verified.

Texts whose SimHash fingerprints link, by the bit-sliced comparison of `simhash`, are compared with the least of their
group and joined if similar. What 64 bits can't tell comes from MinHash: of a similar pair's BANDS bands of ROWS minima
some agree but with a probability of `(1 - 0.8 ** ROWS) ** BANDS` at most, which is 3 in a million.

Sets that meet in a band are compared by a byte of each of their minima, without their texts: at first with about HEADS of
the band, by a hash that is new in each round. A hot band is dealt out in parts that all get its heads. Pairs whose bytes
agree as often as a similar pair's do, but with a probability of some 5 in a million, are candidates; of each set's the best
ones are verified by the whole sets. When such a round joins less than a tenth of what it tries, all sets of a band that are still apart
are compared, a large band as pairs of its parts. This tells which sets have candidates at all; only their whole shingles then go to
the bands, where every candidate is verified at once, by the first band that its sets share. No candidate is dropped and none
is a row: what comes out is a row per set of a band, then the links that join the similar ones. Of a large band's largest
joined group no two sets are dealt out together. Only sets of very many different groups that share a band take comparisons
by the square of their number, in bounded memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, carried_schema, cut, documents, drop, nullable_ints, slices, space_words
from .simhash import components, fingerprint_roots, majority

SHINGLE, NUM, DEN, SEED = 5, 4, 5, 42
BANDS, ROWS = 24, 4
#: Sets of a band that the others are compared with at first, sets of a part of a band, and candidates of a set that are verified a round at first.
HEADS, PART, TRIES = 256, 4096, 2
#: Bands of the first round, which joins most of what is similar, so that few sets are apart in the others.
FIRST = 4
#: Bytes of a sketch that agree in a candidate; of a similar pair's 96 it is 77 on average, with a deviation of 4.
AGREE = 60
#: Rounds with heads end when fewer than one in so many tries joins.
GAIN = 10
#: Shingles of the sets of a part of a band, at 8 bytes each, where whole sets are compared.
WORDS = 1 << 20
#: Sets that are looked up by a broadcast of their names, 16 bytes each; more are looked up by a shuffle.
LOOKED_UP = 500_000

_FACTORS = np.random.default_rng(5).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def all_shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the shingles in the text's order; fewer words make one shingle, none make none."""
    words = space_words(text)
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    h = xxhash.xxh64_intdigest
    last = ends[min(shingle, len(words)) - 1 :]
    return np.array([h(line[a : b - 1], seed=SEED) for a, b in zip([0, *ends], last, strict=False)], np.uint64)


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles in ascending order."""
    return np.unique(all_shingles(text, shingle))


def minima(own: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set. Long sets are taken in stretches, so memory is bounded."""
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(own), 4096):
        x = own[at : at + 4096, None] * _FACTORS
        low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=0))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """A key per band: XXH64 of the band's number and minima."""
    raw = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(raw[i].tobytes(), seed=i) for i in range(BANDS)], np.uint64).view(np.int64)


def bands(own: np.ndarray) -> np.ndarray:
    return band_keys(minima(own))


def _sets(texts: DataFrame) -> DataFrame:
    """doc_id, node (names the set), its size, text_key, fp (its SimHash), keys of its bands, a byte of each minimum and the carried columns of each row."""
    also = carried(texts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in slices(frames, 1024):
            rows = []
            for t in f["text"]:
                every = all_shingles(t)
                own = np.unique(every)
                node = np.int64(xxhash.xxh64_intdigest(own.tobytes(), seed=SEED) - (1 << 63))
                low = minima(own)
                rows.append((node, len(own), np.uint64(majority(every)).view(np.int64), band_keys(low) if len(own) else np.zeros(0, np.int64), low.astype(np.uint8).tobytes()))
            out = pd.DataFrame(rows, columns=["node", "size", "fp", "keys", "sketch"])
            out.insert(0, "doc_id", nullable_ints(f["doc_id"]))
            yield out.assign(text_key=f["text_key"], **{c: f[c] for c in also})

    return texts.mapInPandas(run, "doc_id bigint, node bigint, size int, fp bigint, keys array<bigint>, sketch binary, text_key bigint" + carried_schema(texts))


def _texts_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node and a text of it for the wanted ones of nodes, a written table; as a written table."""
    named = cut(wanted.select("node").distinct().join(nodes.select("node", "text_key"), "node"))
    keys = F.broadcast(named) if named.count() <= LOOKED_UP else named
    whole = cut(texts.select("text_key", "text").join(keys, "text_key").groupBy("node").agg(F.any_value("text").alias("text")))
    drop(named)
    return whole


def _similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs a, b of nodes, a written table, that are similar enough, by their whole sets, which are made again from the texts."""
    whole = _texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), nodes, texts)
    both = pairs.join(whole.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    both = both.join(whole.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in slices(frames, 1024):
            own = {t: shingles(t) for t in set(f["x"]) | set(f["y"])}
            keep = []
            for x, y in zip(f["x"], f["y"], strict=True):
                u, v = own[x], own[y]
                same = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(DEN * same >= NUM * (len(u) + len(v) - same))
            yield f.loc[keep, ["a", "b"]]

    near = cut(both.select("a", "b", "x", "y").mapInPandas(run, "a bigint, b bigint"), rows=256)
    drop(whole)
    return near


def _agreeing(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places a, b and agreeing bytes of pairs: of whole groups, each with its heads first, members with the heads of other roots, if enough agree."""
    g, kind, root = (frame[c].to_numpy(np.int64) for c in ("g", "kind", "root"))
    sketch = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(len(frame), -1)
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    sizes = np.diff(np.r_[starts, len(g)])
    heads = np.repeat(np.add.reduceat((kind < 2).astype(np.int64), starts), sizes)
    heads[kind == 0] = 0  # copies of heads are compared in their own part
    for lo, hi in _stretches(heads, 200_000):
        b = np.repeat(np.arange(lo, hi), heads[lo:hi])
        ends = np.cumsum(heads[lo:hi])
        a = np.repeat(np.repeat(starts, sizes)[lo:hi], heads[lo:hi]) + np.arange(len(b)) - np.repeat(ends - heads[lo:hi], heads[lo:hi])
        keep = (root[a] != root[b]) & ((kind[b] == 2) | (kind[a] == 0) | (a < b))
        a, b = a[keep], b[keep]
        agree = (sketch[a] == sketch[b]).sum(axis=1)
        keep = agree >= AGREE
        yield a[keep], b[keep], agree[keep].astype(np.int32)


def _best(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """a, b, agree: each member's best head."""
    node = frame["node"].to_numpy(np.int64)
    for a, b, agree in _agreeing(frame):
        order = np.lexsort((-agree, b))
        a, b, agree = a[order], b[order], agree[order]
        best = np.r_[True, b[1:] != b[:-1]][: len(b)]
        yield pd.DataFrame({"a": node[a[best]], "b": node[b[best]], "agree": agree[best]})


def _each(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """a, b and their places i, j: all pairs that can be similar by their sizes and sketches, but for those that an earlier band of theirs has too."""
    node, band, size = (frame[c].to_numpy(np.int64) for c in ("node", "band", "size"))
    keys = np.stack(frame["keys"].to_numpy())
    for a, b, _ in _agreeing(frame):
        earlier = ((keys[a] == keys[b]) & (np.arange(BANDS) < band[a][:, None])).any(axis=1)
        keep = ~earlier & (DEN * np.minimum(size[a], size[b]) >= NUM * np.maximum(size[a], size[b]))
        a, b = a[keep], b[keep]
        yield pd.DataFrame({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b]), "i": a, "j": b})


def _with_candidates(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """key, band, node: the members that have a candidate, once each, however many they have."""
    has = np.zeros(len(frame), bool)
    for pairs in _each(frame):
        has[pairs["i"]] = has[pairs["j"]] = True
    f = frame.loc[has, ["keys", "band", "node"]]
    yield pd.DataFrame({"key": [k[b] for k, b in zip(f["keys"], f["band"], strict=True)], "band": f["band"], "node": f["node"]}).astype({"key": np.int64})


def _links(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """a, b: of the candidates those similar by their whole sets, and of these a forest, which joins what all of them do."""
    node = frame["node"].to_numpy(np.int64)
    own = [np.frombuffer(x, np.uint64) for x in frame["whole"]]
    size = np.array([len(x) for x in own])
    ends = np.cumsum(size)
    names, word = np.unique(np.concatenate(own), return_inverse=True)
    words = [word[e - n : e] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
    label = np.unique(frame["root"].to_numpy(np.int64), return_inverse=True)[1]
    inside = np.zeros(len(names), bool)
    links = []
    for pairs in _each(frame):
        pairs = pairs.sort_values("j", kind="stable")
        i, j = pairs["i"].to_numpy(), pairs["j"].to_numpy()
        starts = np.flatnonzero(np.r_[True, j[1:] != j[:-1]][: len(j)]).tolist()
        for lo, hi in zip(starts, [*starts[1:], len(j)], strict=True):
            b = int(j[lo])
            a = i[lo:hi]
            a = a[label[a] != label[b]]
            if not len(a):
                continue
            inside[words[b]] = True
            same = np.add.reduceat(inside[np.concatenate([words[x] for x in a.tolist()])].astype(np.int64), np.r_[0, np.cumsum(size[a])[:-1]])
            inside[words[b]] = False
            for x in a[DEN * same >= NUM * (size[a] + size[b] - same)].tolist():
                if label[x] != label[b]:
                    label[label == label[b]] = label[x]
                    links.append((node[x], node[b]))
    yield pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["a", "b"])


def _by_group(dealt: DataFrame, pairs: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What `pairs` makes of whole groups g, heads first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            g = f["g"].to_numpy()
            last = int(np.searchsorted(g, g[-1])) if len(f) else 0
            if last:
                yield from pairs(f.iloc[:last])
            rest = f.iloc[last:]
        if rest is not None and len(rest):
            yield from pairs(rest)

    return dealt.repartition("g").sortWithinPartitions("g", "kind").mapInPandas(run, schema)


def _stretches(heads: np.ndarray, pairs: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many pairs each."""
    at = np.concatenate([[0], np.cumsum(heads)])
    lo = 0
    while lo < len(heads):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + pairs, "right")) - 1)
        yield lo, hi
        lo = hi


def _heads_first(rows: DataFrame, turn: int) -> DataFrame:
    """Members of bands dealt out in parts, all of which get the band's heads: g, kind, node, root, sketch."""
    parts = F.ceil(F.col("n") / PART).cast("int")
    # A hash in [0, 1) chooses the heads; of a band with no more than HEADS sets all are.
    chance = F.pmod(F.xxhash64("node", "key", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumns({"head": chance * F.col("n") < HEADS, "own": F.pmod(F.xxhash64("key", "node"), parts).cast("int"), "parts": parts})
    copies = F.when(F.col("head"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
    dealt = rows.select("key", "node", "root", "sketch", "head", "own", F.explode(copies).alias("part"))
    kind = F.when(~F.col("head"), 2).when(F.col("own") == F.col("part"), 1).otherwise(0)
    return dealt.select(F.xxhash64("key", "part").alias("g"), kind.alias("kind"), "node", "root", "sketch")


def _every_pair(rows: DataFrame, words: str | None = None) -> DataFrame:
    """Members of bands dealt out as pairs of parts, so that any two of a band with different roots meet in one group: g, kind, and the columns of `rows`.

    A large band's most frequent root has parts of its own, which don't meet each other. `words` names a column that bounds parts beside their number of members.
    """
    weight = F.col(words) if words else F.lit(0)
    of_root = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("words"))
    of_key = of_root.groupBy("key").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max(F.struct("n", "root", "words")).alias("most"))
    parts = lambda n, w: F.greatest(F.ceil(n / PART), F.ceil(w / WORDS), F.lit(1)).cast("int")
    large = parts(F.col("n"), F.col("words")) > 1
    own_parts = F.when(large, parts(F.col("most.n"), F.col("most.words"))).otherwise(0)
    rest = F.when(large, parts(F.col("n") - F.col("most.n"), F.col("words") - F.col("most.words"))).otherwise(1)
    of_key = of_key.select("key", F.when(large, F.col("most.root")).alias("most"), own_parts.alias("own_parts"), rest.alias("rest"))
    among = F.coalesce(F.col("root") == F.col("most"), F.lit(False))
    place = F.xxhash64("key", "node")
    own = F.when(among, F.pmod(place, F.greatest("own_parts", F.lit(1)))).otherwise(F.col("own_parts") + F.pmod(place, F.col("rest"))).cast("int")
    others = F.sequence(F.when(among, F.col("own_parts")).otherwise(0), F.col("own_parts") + F.col("rest") - 1)
    pair = F.transform(others, lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    dealt = rows.join(of_key, "key").withColumn("own", own).select(*rows.columns, "own", F.explode(pair).alias("p"))
    kind = F.when(F.col("p.i") == F.col("p.j"), 1).when(F.col("own") == F.col("p.i"), 0).otherwise(2)
    return dealt.select(F.xxhash64("key", "p.i", "p.j").alias("g"), kind.alias("kind"), *rows.columns)


def _apart(met: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets of bands in which several roots meet, with their root and the band's number n of sets; and the written table that this reads."""
    apart = cut(met.join(roots, "node", "left").select("key", "band", "node", "sketch", F.coalesce("root", "node").alias("root")))
    several = apart.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("key", "n")
    return apart.join(several, "key"), apart


def _tries(met: DataFrame, roots: DataFrame, tried: DataFrame | None, turn: int) -> DataFrame:
    """Pairs a, b of sets and heads of a band that have different roots and agreeing sketches, and weren't tried: the best of each set."""
    rows, apart = _apart(met, roots)
    found = cut(_by_group(_heads_first(rows, turn), _best, "a bigint, b bigint, agree int"))
    new = found.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "b", "agree")
    if tried is not None:
        new = new.join(tried.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_anti")
    # A set has at most one pair of each part of its bands.
    best = new.groupBy("b").agg(F.slice(F.sort_array(F.collect_set(F.struct("agree", "x", "y")), False), 1, TRIES).alias("best"))
    out = cut(best.select(F.inline("best")).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    drop(apart, found)
    return out


def _apart_but_similar(met: DataFrame, nodes: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """Links a, b that join what all similar pairs do of sets that meet in a band and have different roots, as a written table.

    Candidates are told by sketches first; the sets that have any are then compared as a whole, in the bands where they have some.
    """
    rows, apart = _apart(met, roots)
    members = rows.select("key", "band", "node", "root", "sketch").join(nodes.select("node", "size", "keys"), "node")
    some = cut(_by_group(_every_pair(members), _with_candidates, "key bigint, band int, node bigint").distinct())
    members = some.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(nodes.select("node", "sketch", "size", "keys"), "node")
    of_some = _texts_of(some, nodes, texts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in slices(frames, 1024):
            yield pd.DataFrame({"node": f["node"], "whole": [shingles(t).tobytes() for t in f["text"]]})

    whole = cut(of_some.mapInPandas(run, "node bigint, whole binary"), rows=1024)
    near = cut(_by_group(_every_pair(members, "size").join(whole, "node"), _links, "a bigint, b bigint").distinct(), rows=256)
    drop(apart, some, of_some, whole)
    return near


def _joined(roots: DataFrame, near: DataFrame) -> DataFrame:
    """The roots after further pairs are linked; those before are dropped."""
    after = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(near))
    drop(roots)
    return after


def near_sets(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, node, component and carry_0, ... for each row of `docs`, as a written table: rows whose sets are linked by similar pairs share a component.

    Equal sets have one node. Nodes and shingles are 64-bit hashes. Texts without words are equal to each other alone. Null
    text is empty, repeated rows stay, columns that aren't carried are left out.
    """
    texts = documents(docs, carry).withColumn("text_key", F.xxhash64("text"))
    sets = cut(_sets(texts), rows=1024)
    nodes = cut(sets.groupBy("node").agg(*(F.min(c).alias(c) for c in ("text_key", "size", "fp", "keys", "sketch"))))

    # SimHash groups: each member against the least of its group.
    prints = cut(nodes.select("fp").distinct())
    linked = nodes.select("node", "fp").join(fingerprint_roots(prints), "fp").withColumnRenamed("root", "group")
    heads = linked.groupBy("group").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("members")).where("members > 1")
    first = cut(linked.join(heads, "group").where("node <> a").select("a", F.col("node").alias("b")))
    near = _similar(first, nodes, texts)
    roots = components(near)
    drop(first, near)

    # Bands in which several sets meet.
    rows = nodes.select("node", "sketch", F.posexplode("keys").alias("band", "key"))
    met = cut(rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "key"))
    tried, turn, joined = None, 0, True
    while turn < 2 or joined:
        tries = _tries(met if turn else met.where(F.col("band") < FIRST), roots, tried, turn)
        near = _similar(tries, nodes, texts)
        links = near.count()
        roots = _joined(roots, near) if links else roots
        joined = links > 0 and GAIN * links >= tries.count()
        past, tried = tried, tries if tried is None else cut(tried.unionByName(tries))
        drop(near, *([past, tries] if past is not None else []))
        turn += 1
    # What heads have not told.
    near = _apart_but_similar(met, nodes, roots, texts)
    roots = _joined(roots, near) if near.head(1) else roots
    drop(near)
    out = cut(sets.join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("component"), *carried(sets)))
    drop(sets, nodes, prints, met, roots, tried)
    return out
