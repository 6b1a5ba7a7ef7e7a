"""Removal of long byte strings that an earlier document has too, by suffix sorting of shards.

Every 50-byte window belongs to one anchor, the 16-byte string in it with the least hash, so equal windows belong to equal
anchors. Anchors that only one document has can't hold a repeat. For the others the text around them
goes to a shard chosen by the anchor's hash, where all its windows meet. A shard is suffix-sorted by external
induced sorting (see `induced`); neighbours with a common prefix of 50 bytes form groups, and of each group
all but the smallest document lose the window. Before both shuffles equal entries of a batch are merged, so
a string that very many documents share takes one entry a batch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import induced
from .common import carried, carried_schema, documents

WINDOW, ANCHOR = 50, 16
#: Bytes of text per shard, about; at most this many bytes are hashed at a time.
SHARD_BYTES, STRETCH = 4 << 20, 1 << 18
#: Windows of a long text that are handled at a time.
SEGMENT = 1 << 20

_TABLE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_LOW = np.uint64(63)


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of each string of `size` bytes (a power of two), by doubling."""
    h, step, span = _TABLE[data], _STEP, 1
    while span < size:
        h = h[:-span] * np.uint64(step) + h[span:]
        step, span = step * step % 2**64, span * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchored(data: np.ndarray, starts: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor, of texts that begin at `starts` in `data`: text, hash, first and last window."""
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none.view(np.uint64), none, none
    h = _hashes(data, anchor)
    places = np.arange(len(h), dtype=np.uint64)
    least, span, width = (h & ~_LOW) | (places & _LOW), 1, window - anchor + 1
    while span * 2 <= width:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < width:
        least = np.minimum(least[: -(width - span)], least[width - span :])
    at = np.arange(len(least))
    chosen = at + (((least & _LOW).astype(np.int64) - at) & 63)
    ends = np.append(starts[1:], len(data))
    inside = np.ones(len(data), bool)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        inside[max(a, b - window + 1) : b] = False
    at = np.flatnonzero(inside[: len(least)])
    if not len(at):
        return none, none.view(np.uint64), none, none
    chosen = chosen[at]
    new = (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)
    first, last = at[np.append(True, new)], at[np.append(new, True)]
    return np.searchsorted(starts, first, side="right") - 1, h[chosen[np.append(True, new)]], first, last


def stretches(texts: list[bytes]) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, int]]:
    """Texts joined to stretches of some STRETCH bytes, long ones in segments of SEGMENT windows: first text, bytes, starts, array, shift."""
    held: list[bytes] = []
    first = size = 0

    def joined() -> tuple[int, bytes, np.ndarray, np.ndarray, int]:
        raw = b"".join(held)
        return first, raw, np.cumsum([0, *map(len, held)])[:-1], np.frombuffer(raw, np.uint8), 0

    for i, t in enumerate(texts):
        if len(t) > SEGMENT + WINDOW:
            if held:
                yield joined()
            for at in range(0, len(t) - WINDOW + 1, SEGMENT):
                part = t[at : at + SEGMENT + WINDOW - 1]
                yield i, part, np.zeros(1, np.int64), np.frombuffer(part, np.uint8), at
            held, size, first = [], 0, i + 1
            continue
        held.append(t)
        size += len(t)
        if size >= STRETCH:
            yield joined()
            held, size, first = [], 0, i + 1
    if held:
        yield joined()


def _encode(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def _split_rows(keys: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of equal values in sorted keys."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True)) if len(keys) else []


def _shards(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _short(hashes: np.ndarray) -> np.ndarray:
    """Low 32 bits: enough to tell anchors of one shard apart, as a mistaken match only costs a comparison."""
    return hashes.astype(np.uint32)


def _packed(values: np.ndarray) -> bytes:
    """Ascending integers as compressed differences."""
    return zlib.compress(np.diff(values, prepend=0).astype(np.int64).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw), np.int64))


def _anchor_entries(n_shards: int):  # noqa: ANN202
    """Per batch: entries of anchors by shard; anchors of two and more documents of the batch also come back as shared."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, texts = f["doc_id"].to_numpy(np.int64), _encode(f["text"])
            parts = [(ids[first + text], h) for first, _, starts, data, _ in stretches(texts) for text, h, _, _ in [anchored(data, starts)]]
            if not parts:
                continue
            doc, h = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(doc):
                continue
            order = np.lexsort((doc, h))
            doc, h = doc[order], h[order]
            fresh = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
            doc, h = doc[fresh], h[fresh]
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            ends = np.append(starts[1:], len(h)) - 1
            many = ends > starts
            # Of each anchor the least and the greatest document stand for all of the batch.
            entry_h, entry_doc = np.concatenate([h[starts], h[ends[many]]]), np.concatenate([doc[starts], doc[ends[many]]])
            shard = _shards(entry_h, n_shards)
            order = np.lexsort((entry_doc, shard))
            shard, entry_h, entry_doc = shard[order], _short(entry_h[order]), entry_doc[order]
            rows = [(int(shard[a]), None, entry_h[a:b].tobytes(), _packed(entry_doc[a:b])) for a, b in _split_rows(shard)]
            shared = np.repeat(many, ends - starts + 1)
            order = np.argsort(doc[shared], kind="stable")
            doc, h = doc[shared][order], _short(h[shared][order])
            rows += [(int(doc[a]) % n_shards, int(doc[a]), h[a:b].tobytes(), None) for a, b in _split_rows(doc)]
            out = pd.DataFrame(rows, columns=["shard", "doc_id", "hashes", "docs"])
            yield out.astype({"doc_id": "Int64"})

    return run


def _shared_anchors(n_shards: int):  # noqa: ANN202
    """Of one shard: the anchors that two and more documents have, packed by buckets of documents; entries known as shared go along."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        known = f[f["doc_id"].notna()]
        rest = f[f["doc_id"].isna()]
        doc = np.repeat(known["doc_id"].to_numpy(np.int64), [len(x) // 4 for x in known["hashes"]])
        h = np.frombuffer(b"".join(known["hashes"]), np.uint32)
        if len(rest):
            entry = np.frombuffer(b"".join(rest["hashes"]), np.uint32)
            own = np.concatenate([_unpacked(x) for x in rest["docs"]])
            order = np.argsort(entry, kind="stable")
            entry, own = entry[order], own[order]
            starts = np.flatnonzero(np.append(True, entry[1:] != entry[:-1]))
            several = np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)
            use = np.repeat(several, np.diff(starts, append=len(entry)))
            doc, h = np.concatenate([doc, own[use]]), np.concatenate([h, entry[use]])
        bucket = doc % n_shards
        order = np.lexsort((doc, bucket))
        bucket, doc, h = bucket[order], doc[order], h[order]
        return pd.DataFrame([(int(bucket[a]), _packed(doc[a:b]), h[a:b].tobytes()) for a, b in _split_rows(bucket)], columns=["bucket", "docs", "hashes"])

    return run


def _per_document(f: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: the shared anchors of each document in one row."""
    doc = np.concatenate([_unpacked(x) for x in f["docs"]])
    h = np.frombuffer(b"".join(f["hashes"]), np.uint32)
    order = np.argsort(doc, kind="stable")
    doc, h = doc[order], h[order]
    return pd.DataFrame([(int(doc[a]), h[a:b].tobytes()) for a, b in _split_rows(doc)], columns=["doc_id", "hashes"])


def _fragments(n_shards: int):  # noqa: ANN202
    """Per batch: text around shared anchors by shard, once for its least document; documents after it lose it at once."""
    columns = ["shard", "hashes", "text", "sizes", "docs", "texts", "places"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.sort_values("doc_id", kind="stable", ignore_index=True)
            ids, keys, texts = f["doc_id"].to_numpy(np.int64), f["text_key"].to_numpy(np.int64), _encode(f["text"])
            wanted = [np.frombuffer(x, np.uint32) for x in f["hashes"]]
            least: dict[bytes, int] = {}
            own: list[tuple[int, bytes, int, int, int]] = []
            lost: list[tuple[int, int, int, int]] = []
            for first, raw, starts, data, shift in stretches(texts):
                text, h, a, b = anchored(data, starts)
                if not len(text):
                    continue
                mix = lambda doc, x: x.astype(np.uint64) | (doc.astype(np.uint64) << np.uint64(32))
                count = range(first, first + len(starts))
                ask = np.concatenate([mix(np.full(len(wanted[i]), i), wanted[i]) for i in count])
                use = np.flatnonzero(np.isin(mix(first + text, _short(h)), ask))
                for i, x, p, q, s in zip((first + text[use]).tolist(), h[use].tolist(), a[use].tolist(), b[use].tolist(), starts[text[use]].tolist(), strict=True):
                    piece, doc = raw[p : q + WINDOW], int(ids[i])
                    if least.setdefault(piece, doc) == doc:
                        own.append((x, piece, doc, int(keys[i]), p - s + shift))
                    else:
                        lost.append((doc, int(keys[i]), p - s + shift, q - s + shift + WINDOW))
            rows = []
            if own:
                shard = _shards(np.array([x[0] for x in own], np.uint64), n_shards)
                order = np.argsort(shard, kind="stable")
                shard = shard[order]
                for a, b in _split_rows(shard):
                    part = [own[i] for i in order[a:b]]
                    h, piece, doc, key, at = zip(*part, strict=True)
                    packed = (np.array(x, t).tobytes() for x, t in (([len(y) for y in piece], np.int32), (doc, np.int64), (key, np.int64), (at, np.int32)))
                    rows.append((int(shard[a]), np.array(h, np.uint64).tobytes(), zlib.compress(b"".join(piece), 1), *packed))
            if lost:
                # The same document's stretches, joined where they touch.
                lost.sort()
                merged: list[list[int]] = []
                for doc, key, a, b in lost:
                    if merged and merged[-1][0] == doc and merged[-1][1] == key and a <= merged[-1][3]:
                        merged[-1][3] = max(merged[-1][3], b)
                    else:
                        merged.append([doc, key, a, b])
                m = np.array(merged, np.int64)
                rows.append((int(m[0, 0]) % n_shards, None, None, (m[:, 3] - m[:, 2]).astype(np.int32).tobytes(), m[:, 0].tobytes(), m[:, 1].tobytes(), m[:, 2].astype(np.int32).tobytes()))
            yield pd.DataFrame(rows, columns=columns)

    return run


def _sort_shard(f: pd.DataFrame) -> pd.DataFrame:
    """Of one shard: doc_id, text_key, begin, stop of bytes that a document with a smaller id has too."""
    unpack = lambda c, t, g: np.frombuffer(b"".join(g[c]), t).astype(np.int64)
    out: list[np.ndarray] = []
    passed = f[f["hashes"].isna()]
    if len(passed):
        at = unpack("places", np.int32, passed)
        out.append(np.stack([unpack("docs", np.int64, passed), unpack("texts", np.int64, passed), at, at + unpack("sizes", np.int32, passed)], axis=1))
    f = f[f["hashes"].notna()]
    if len(f):
        raw = b"".join(map(zlib.decompress, f["text"]))
        sizes, doc, key, at = unpack("sizes", np.int32, f), unpack("docs", np.int64, f), unpack("texts", np.int64, f), unpack("places", np.int32, f)
        h = np.frombuffer(b"".join(f["hashes"]), np.uint64)
        ends = np.cumsum(sizes)
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(raw[e - n : e], len(number)) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)])
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, which, doc)
        later = doc > least[which]
        out.append(np.stack([doc, key, at, at + sizes], axis=1)[later])
        # Different fragments are only sorted where an anchor has several.
        anchor = np.empty(len(number), np.uint64)
        anchor[which] = h
        _, back, count = np.unique(anchor, return_inverse=True, return_counts=True)
        use = np.flatnonzero(count[back] > 1)
        if len(use):
            texts = list(number)
            marks = _sort_fragments([texts[i] for i in use], least[use])
            place = np.full(len(number), -1)
            place[use] = np.arange(len(use))
            first = np.flatnonzero(~later & (place[which] >= 0))
            for i in first.tolist():
                for a, b in marks.get(int(place[which[i]]), ()):
                    out.append(np.array([[doc[i], key[i], at[i] + a, at[i] + b]]))
    rows = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
    return pd.DataFrame(rows, columns=["doc_id", "text_key", "begin", "stop"])


def _sort_fragments(texts: list[bytes], doc: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Byte ranges of each fragment that a fragment of a smaller document has too, from the shard's suffix order."""
    raw = b"\x00".join(texts) + b"\x00" * 9
    data = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    symbols = data[: int(starts[-1] + sizes[-1]) + 2].astype(np.int16) + 2
    symbols[starts + sizes] = 1  # a separator is below all bytes, zero bytes too
    symbols[-1] = 0
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    offset = np.arange(len(owner)) - starts[owner]
    valid = np.zeros(len(symbols), bool)
    valid[: len(owner)] = offset + WINDOW <= sizes[owner]
    gone = np.zeros(len(owner), bool)
    for places, first in induced.window_groups(data, symbols, valid, WINDOW):
        own = doc[owner[places]]
        least = np.minimum.reduceat(own, first)
        gone[places[own > np.repeat(least, np.diff(first, append=len(places)))]] = True
    at = np.flatnonzero(gone)
    out: dict[int, list[tuple[int, int]]] = {}
    if len(at):
        new = np.append(True, at[1:] != at[:-1] + 1)
        for a, b in zip(at[new].tolist(), at[np.append(new[1:], True)].tolist(), strict=True):
            out.setdefault(int(owner[a]), []).append((int(offset[a]), int(offset[b]) + WINDOW))
    return out


def _identified(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    return documents(docs, carry).where("doc_id is not null").withColumn("text_key", F.xxhash64("text"))


def repeated_ranges(own: DataFrame) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), begin, stop: byte ranges covered by WINDOW-byte strings of smaller documents.

    `own`: doc_id, text, text_key.
    """
    n_bytes = own.agg(F.sum(F.octet_length("text").cast("bigint"))).head()[0] or 0
    n_shards = max(8, n_bytes // SHARD_BYTES)
    entries = own.select("doc_id", "text").mapInPandas(_anchor_entries(n_shards), "shard bigint, doc_id bigint, hashes binary, docs binary")
    shared = entries.groupBy("shard").applyInPandas(_shared_anchors(n_shards), "bucket bigint, docs binary, hashes binary")
    wanted = shared.groupBy("bucket").applyInPandas(_per_document, "doc_id bigint, hashes binary")
    columns = "shard bigint, hashes binary, text binary, sizes binary, docs binary, texts binary, places binary"
    fragments = own.join(wanted, "doc_id").mapInPandas(_fragments(n_shards), columns)
    return fragments.groupBy("shard").applyInPandas(_sort_shard, "doc_id bigint, text_key bigint, begin int, stop int")


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) for each row of `docs`.

    Texts count as UTF-8; null text as empty. Strings of rows without a doc_id neither remove nor go. Rows that share a
    doc_id are one document's texts: they don't remove from each other. Strings are judged on the input. kept may not
    be valid UTF-8, as strings may begin and end inside a character. Columns named in `carry` come along as carry_0, ...
    """
    # The texts are dealt out by doc_id twice, to find fragments and to cut; both joins take the same columns, so that
    # Spark shuffles the texts once.
    own = _identified(docs, carry)
    also = carried(own)
    spans = repeated_ranges(own).groupBy("doc_id").agg(F.collect_list("text_key").alias("keys"), F.collect_list("begin").alias("begin"), F.collect_list("stop").alias("stop"))
    nameless = documents(docs, carry).where("doc_id is null").withColumn("text_key", F.xxhash64("text"))
    empty = {"keys": "array<bigint>", "begin": "array<int>", "stop": "array<int>"}
    flat = own.join(spans, "doc_id", "left")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc_id, text, key, keys, begin, stop in zip(f["doc_id"], _encode(f["text"]), f["text_key"], f["keys"], f["begin"], f["stop"], strict=True):
                kept, spans = text, 0
                mine = np.asarray(keys) == key if keys is not None else np.zeros(0, bool)
                if mine.any():
                    a, b = np.asarray(begin)[mine], np.asarray(stop)[mine]
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    new = np.append(True, a[1:] > b[:-1])
                    a, b = a[new], b[np.append(new[1:], True)]
                    spans = len(a)
                    kept = b"".join(text[p:q] for p, q in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True))
                rows.append((doc_id, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            yield out.astype({"doc_id": "Int64"}).assign(**{c: f[c] for c in also})

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary" + carried_schema(own)
    whole = nameless.withColumns({c: F.lit(None).cast(t) for c, t in empty.items()}).select(*flat.columns)
    return flat.mapInPandas(cut, schema).unionByName(whole.mapInPandas(cut, schema))


def op3_suffix_dedup(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).drop("kept")
