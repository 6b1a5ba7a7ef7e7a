"""Search of current and former texts in two phases: a signature of 256 bits per record narrows, the texts themselves decide.

A signature has the bits of all search tokens of a record's texts, four a token, so a record with all tokens of a query always
passes. It is four whole numbers beside the id: the first phase reads 40 bytes a record, and only what passes is joined to texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions.text import FNV_OFFSET, FNV_PRIME, TOKEN

#: Fixed size of a signature, in words of 64 bits, and bits of a token.
WORDS, SEEDS = 4, 4
NAMES = tuple(f"w{i}" for i in range(WORDS))
#: Tokens whose bits a worker remembers at once.
MEMO = 200_000


def _low_byte(text: str, state: int = FNV_OFFSET & 0xFF) -> int:
    """The lowest byte of a text's FNV-1a, which is all that a position among 256 depends on; it depends on lowest bytes alone."""
    for b in text.encode():
        state = (state ^ b) * (FNV_PRIME & 0xFF) & 0xFF
    return state


def _bits(tokens: list[str]) -> dict[str, int]:
    """Each token with its bits, as one number of 256 bits. Tokens are ASCII; all of one length or more take a step together."""
    tokens = sorted(tokens, key=len, reverse=True)
    raw = np.frombuffer("".join(tokens).encode(), np.uint8)
    sizes = np.array([len(t) for t in tokens], np.int64)
    starts = np.cumsum(sizes) - sizes
    state = np.tile(np.array([_low_byte(f"{s}:") for s in range(SEEDS)], np.uint8), (len(tokens), 1))
    for i in range(sizes[0] if len(tokens) else 0):
        n = int(np.searchsorted(-sizes, -i))
        state[:n] = (state[:n] ^ raw[starts[:n] + i, None]) * np.uint8(FNV_PRIME & 0xFF)
    words = np.zeros((len(tokens), WORDS), np.uint64)
    for s in range(SEEDS):
        words[np.arange(len(tokens)), state[:, s] >> 6] |= np.uint64(1) << (state[:, s] & 63).astype(np.uint64)
    data = words.astype("<u8").tobytes()
    return dict(zip(tokens, (int.from_bytes(data[at : at + 8 * WORDS], "little") for at in range(0, len(data), 8 * WORDS)), strict=True))


def signatures(values: DataFrame) -> DataFrame:
    """id and w0 to w3 over all values (id, value) of a record, current and former ones; null and empty values add nothing.

    A text becomes its four words in one Arrow pass, so what is shuffled is a row per text and not per token. A worker
    remembers the bits of some MEMO tokens.
    """
    own = values.select("id", F.lower(F.coalesce("value", F.lit(""))).alias("value"))
    kind = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        token = re.compile(TOKEN)
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            texts = [set(token.findall(t.replace("’", "'"))) for t in batch.column(1).to_pylist()]
            if len(memo) > MEMO:
                memo.clear()
            memo |= _bits(list(set().union(*texts) - memo.keys()))
            signed = [reduce(or_, (memo[t] for t in own), 0).to_bytes(8 * WORDS, "little") for own in texts]
            words = np.frombuffer(b"".join(signed), "<i8").reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(words[:, i]) for i in range(WORDS))], names=["id", *NAMES])

    made = own.mapInArrow(run, f"id {kind}, " + ", ".join(f"{w} bigint" for w in NAMES))
    return made.groupBy("id").agg(*(F.bit_or(w).alias(w) for w in NAMES))


def query_tokens(query: str) -> list[str]:
    return list(dict.fromkeys(t.replace("’", "'") for t in re.findall(TOKEN, query.lower())))


def masks(query: str) -> list[int]:
    """The words that a record's signature must have in full, as signed numbers."""
    words = [0] * WORDS
    for token in query_tokens(query):
        for s in range(SEEDS):
            p = _low_byte(f"{s}:{token}")
            words[p >> 6] |= 1 << (p & 63)
    return [w - (1 << 64) if w >> 63 else w for w in words]


def _passes(query: str) -> Column:
    found = reduce(lambda a, b: a & b, (F.col(w).bitwiseAND(F.lit(m).cast("bigint")) == F.lit(m).cast("bigint") for w, m in zip(NAMES, masks(query), strict=True)))
    return found & F.lit(bool(query_tokens(query)))


def candidates(signed: DataFrame, query: str) -> DataFrame:
    """Rows of a table with signatures that may hold all tokens of the query; none for a query without a token."""
    return signed.where(_passes(query))


def search(signed: DataFrame, values: DataFrame, query: str, exact: bool = False) -> DataFrame:
    """Rows of `signed` (id, at, w0 to w3, ...) whose values hold the query, to be read newest first by (at, id).

    Each token must stand somewhere in some value, or with `exact` the query as it is, without regard to case, in one value.
    """
    own = candidates(signed, query).drop(*NAMES)
    if not query_tokens(query):
        return own
    texts = values.join(own.select("id"), "id", "left_semi").select("id", F.lower("value").alias("v"))
    needles = [query.lower()] if exact else query_tokens(query)
    found = texts.groupBy("id").agg(*(F.bool_or(F.coalesce(F.contains("v", F.lit(n)), F.lit(False))).alias(f"has_{i}") for i, n in enumerate(needles)))
    whole = reduce(lambda a, b: a & b, (F.col(f"has_{i}") for i in range(len(needles))))
    return own.join(found.where(whole).select("id"), "id", "left_semi")


def skipped(signed: DataFrame, query: str) -> DataFrame:
    """One row: records, candidates, and the share of records whose texts aren't looked at; signatures are made once."""
    both = signed.select(*NAMES).agg(F.count(F.lit(1)).alias("records"), F.count_if(_passes(query)).alias("candidates"))
    return both.withColumn("skipped", F.when(F.col("records") > 0, 1 - F.col("candidates") / F.col("records")))
