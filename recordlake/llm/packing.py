"""Packing: shortest pack first over the histogram of lengths.

Texts become token ids with an end id and are cut into pieces of at most a sequence. Only the
histogram of piece lengths, one row per length, reaches the driver. Lengths are placed longest first
into the pack pattern with the least in it, on counts of patterns. The patterns' places are
then joined back to the pieces by their rank among pieces of one length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, documents
from .tokens import VOCABULARY, text_slices, words_of

SEQUENCE, END_ID = 2048, 1
#: Pieces of one length that are ranked in one group, about.
GROUP_ROWS = 50_000


@dataclass
class Place:
    """`times` pieces of `length` side by side from `offset` in each sequence of a pattern."""

    length: int
    offset: int
    times: int


def shortest_pack_first(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, list[Place]]]:
    """Patterns as (number of sequences, places). All pieces are placed; their work follows the lengths, not the pieces."""
    open_: list[tuple[int, int, int, list[Place]]] = []  # filled, serial, count, places
    serial = 0
    done: list[tuple[int, list[Place]]] = []

    def push(filled: int, count: int, places: list[Place]) -> None:
        nonlocal serial
        serial += 1
        if filled >= size:
            done.append((count, places))
        else:
            heapq.heappush(open_, (filled, serial, count, places))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not open_ or open_[0][0] + length > size:
                # None fits: new packs take as many of this length as a sequence holds, if enough are left.
                times = size // length if left >= size // length else left
                packs = left // times
                push(times * length, packs, [Place(length, 0, times)])
                left -= packs * times
                continue
            filled, _, count, places = heapq.heappop(open_)
            if count <= left:
                times = min((size - filled) // length, left // count)
                push(filled + times * length, count, [*places, Place(length, filled, times)])
                left -= count * times
            else:
                push(filled, count - left, places)
                push(filled + length, left, [*places, Place(length, filled, 1)])
                left = 0
    return done + [(count, places) for _, _, count, places in open_]


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each text's ids with the end id, cut every `size` ids.

    Null or empty text: only the end id. Repeated rows are cut each for itself. Other columns are left out, whatever their names.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(vocabulary)
        for batch in text_slices(batches):
            ids, first = words.encode(batch.column("text"))
            n = np.diff(first) + 1
            end = np.cumsum(n)
            whole = np.full(int(end[-1]), end_id, "<u4")
            whole[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
            count = -(-n // size)
            doc = np.repeat(np.arange(len(n)), count)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * size
            length = np.minimum(size, n[doc] - start)
            at = (end - n)[doc] + start
            raw = memoryview(whole).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, n[doc]))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return documents(docs).mapInArrow(tokenize, ", ".join(f"{c} bigint" for c in names))


def pack(cut_pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """`cut_pieces` (doc_id, start, length, ...) with sequence_id and offset.

    Sequences are filled from 0 without gaps. Copies of a row are packed each for itself. The rank among pieces of
    one length is made of a salted group's offset and the rank in that group, so a length that many pieces share is
    spread over many groups. The pieces should be a written table, as they are read three times.
    """
    spark = cut_pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `size` rows at most
    salts = max(16, sum(histogram.values()) // GROUP_ROWS)
    slots, serial, used = [], 0, dict.fromkeys(histogram, 0)
    for count, places in shortest_pack_first(histogram, size):
        for p in places:
            slots.append((p.length, used[p.length], used[p.length] + count * p.times, serial, count, p.offset))
            used[p.length] += count * p.times
        serial += count
    schema = "length bigint, lo bigint, hi bigint, first bigint, packs bigint, at bigint"
    patterns = spark.createDataFrame(slots, schema)
    salted = cut_pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(inside)).join(groups, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth") - 1)
    # The patterns are bounded by the number of lengths, whatever the number of pieces.
    small = F.broadcast(patterns) if len(slots) <= 64 * size else patterns
    placed = ranked.join(small.withColumnRenamed("length", "l"), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    sequence = F.col("first") + nth % F.col("packs")
    offset = F.col("at") + F.floor(nth / F.col("packs")) * F.col("length")
    return placed.select(*cut_pieces.columns, sequence.alias("sequence_id"), offset.cast("bigint").alias("offset"))


def op8_packing(docs: DataFrame) -> DataFrame:
    """Pieces of all documents with their sequence and place. Null text: only the end id."""
    return pack(cut(pieces(docs)))
