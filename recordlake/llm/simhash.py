"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most `radius` bits agree on enough of their blocks of bits, so each goes to one
bucket per choice of blocks. In a bucket the bit planes are stored vertically: one machine word holds a
bit of 64 fingerprints. Distances of many pairs grow together in carry-save counters that overflow just
beyond the radius, and a block of pairs is left once all have overflowed. Only distinct
fingerprints are compared, and each compared block gives a star of links rather than all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, cut, documents, drop, nullable_ints, slices, space_words

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Links, of 16 bytes each, that one task may join.
SMALL_LINKS = 3_000_000
#: Fingerprints of a bucket that are compared as one block; larger buckets are dealt out as pairs of blocks.
BLOCK = 512
#: Fingerprints that a bucket should hold on average.
BUCKET = 128


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Bit by bit the majority of the shingles' XXH64, repeats included; fewer words make one shingle, none give zero."""
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed=SEED)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    h = xxhash.xxh64_intdigest
    return majority(np.array([h(line[a : b - 1], seed=SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Each bit that more than half of the hashes have."""
    hashes = hashes.astype(">u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (64 bits as a signed integer) of each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in slices(frames, 1024):
            fp = np.array([fingerprint(space_words(t), shingle) for t in f["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": nullable_ints(f["doc_id"]), "fp": fp})

    return documents(docs).mapInPandas(run, "doc_id bigint, fp bigint")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """[BITS, words]: plane b holds bit b of 64 fingerprints per word."""
    n = -(-len(fps) // 64) * 64
    rows = np.zeros(n, np.uint64)
    rows[: len(fps)] = fps
    bits = np.unpackbits(rows.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(queries: np.ndarray, fps: np.ndarray, radius: int, allowed: np.ndarray | None = None) -> np.ndarray:
    """Boolean [queries, fps]: pairs at most `radius` bits apart, among `allowed` ones (bit-packed like the planes).

    Counters of k bits start at 2**k - (radius + 1), so that the carry out of the last marks a pair that is too far.
    """
    planes = bit_planes(fps)
    k = max(1, (radius).bit_length())
    shape = (len(queries), planes.shape[1])
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    counters = [np.full(shape, ones if ((1 << k) - radius - 1) >> i & 1 else 0, np.uint64) for i in range(k)]
    beyond = np.zeros(shape, np.uint64) if allowed is None else ~allowed
    for b in range(BITS):
        carry = planes[b][None, :] ^ np.where(queries >> np.uint64(b) & np.uint64(1), ones, np.uint64(0))[:, None]
        for i in range(k):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        beyond |= carry
        if b % 4 == 3 and (beyond == ones).all():
            return np.zeros((len(queries), len(fps)), bool)
    near = np.unpackbits(np.ascontiguousarray(~beyond).view(np.uint8), axis=1, bitorder="little")
    return near[:, : len(fps)].astype(bool)


def _stars(a: np.ndarray, b: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
    """Links between places a and b as links of each place to the least fingerprint of its part."""
    label = np.arange(len(fps))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(fps)))
    return pd.DataFrame({"a": fps[own].view(np.int64), "b": fps[label[own]].view(np.int64)})


def _compare(f: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Links in a stretch of whole groups (`g` numbers them); a group of two sides is only compared across."""
    fps, g, side = f["fp"].to_numpy().view(np.uint64), f["g"].to_numpy(), f["side"].to_numpy()
    same = g[:, None] == g[None, :]
    same &= (side[:, None] == 2) | (side[:, None] < side[None, :])
    n = -(-len(fps) // 64) * 64
    wide = np.zeros((len(fps), n), bool)
    wide[:, : len(fps)] = same
    near = within(fps, fps, radius, np.packbits(wide, axis=1, bitorder="little").view(np.uint64))
    a, b = np.nonzero(near)
    keep = a != b
    return _stars(a[keep], b[keep], fps)


def links(nodes: DataFrame, n_nodes: int, radius: int = RADIUS) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that join the same fingerprints as all close pairs do.

    The number of bit blocks grows with the table: of `blocks` blocks, `blocks - radius` agree in a close pair.
    """
    blocks = radius + 1
    while blocks < 2 * radius + 4 and n_nodes >> (BITS * (blocks - radius) // blocks) > BUCKET:
        blocks += 1
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in c) for c in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("choice", "key"))
    full = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = keyed.join(full, ["choice", "key"])
    # A bucket of k blocks of BLOCK fingerprints is dealt out as its pairs of blocks.
    k = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp", "choice"), k).cast("int")
    pair = F.transform(F.sequence(F.lit(0), k - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    dealt = sized.withColumn("own", own).select("choice", "key", "fp", "own", F.explode(pair).alias("p"))
    dealt = dealt.select(F.xxhash64("choice", "key", "p.i", "p.j").alias("g"), "fp", F.when(F.col("p.i") == F.col("p.j"), 2).when(F.col("own") == F.col("p.i"), 0).otherwise(1).cast("int").alias("side"))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for group in by_key(frames, ["g"]):
            if rows and rows + len(group) > BLOCK:
                yield _compare(pd.concat(held, ignore_index=True), radius)
                held, rows = [], 0
            held.append(group)
            rows += len(group)
        if held:
            yield _compare(pd.concat(held, ignore_index=True), radius)

    return dealt.repartition("g").sortWithinPartitions("g").mapInPandas(compare, "a bigint, b bigint").distinct()


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All links u, v of a task: each node that isn't the least of its part, with the least."""
    held = [f[["u", "v"]].to_numpy(np.int64) for f in frames]
    if not held:
        return
    names, at = np.unique(np.concatenate(held), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    label = np.arange(len(names))
    while True:
        # Hooking roots and jumping pointers: rounds follow the logarithm of the longest chain.
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    own = np.flatnonzero(label != np.arange(len(names)))
    yield pd.DataFrame({"node": names[own], "root": names[label[own]]})


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each node's part, as a written table; nodes that are roots or without links don't appear.

    Up to SMALL_LINKS links, by their number, are joined by one task. More alternate large-star and small-star steps: each makes links point at least neighbours, keeps the number of links
    and what they join, and ends in stars. Each step's minimum is aggregated before it is joined back, so a
    node with very many links is no task's own. Steps follow the logarithm of the number of nodes.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.limit(SMALL_LINKS + 1).count() <= SMALL_LINKS:
        roots = cut(edges.repartition(1).mapInPandas(_joined, "node bigint, root bigint"))
        drop(edges)
        return roots
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        drop(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())
        drop(large)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if now == before or not now[0]:
            # In a star a node has one link, to the root.
            roots = cut(edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node"))
            drop(edges)
            return roots
        before = now


def fingerprint_roots(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, root for each of the distinct fingerprints: those that links join share a root."""
    roots = components(links(prints, prints.count(), radius))
    return prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id for each row of `docs` (doc_id, text).

    component_id is the least doc_id that links reach, itself included; null ids never are one, and a component
    of null ids alone has none. Null and empty texts have the fingerprint zero and link like any other. Repeated rows stay.
    """
    prints = cut(fingerprints(docs, shingle))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = cut(nodes.join(fingerprint_roots(nodes.select("fp"), radius), "fp"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(groups, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
