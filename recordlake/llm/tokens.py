"""Token counts with overlap resynchronisation, and token ids for packing.

Huge texts are encoded in overlapping chunks with offsets. Neighbouring chunks are spliced where both start a token at
the same place, behind a border of pre-tokens that no context can move, and agree around it; if no such place exists,
the overlap is widened, and a chunk without any border is lengthened up to behind the next one. White space ends a
pre-token in the tokenizers at hand, and so does a change from letters or digits to marks; no merge crosses pre-tokens,
so such a boundary is stable.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

VOCABULARY = "word_bpe_49k.json"
#: Characters of a chunk and of its first overlap; texts up to CHUNK are encoded whole.
CHUNK, OVERLAP = 32_768, 256
#: Tokens before and after a boundary that both chunks must agree on.
GUARD = 2
#: Units whose tokens a worker remembers; beyond it starts anew, which bounds its memory.
MEMO_UNITS = 600_000
#: Letter words that are encoded as one text.
JOINED = 2_000
#: Rows and bytes of text that are handled at a time.
SLICE_ROWS, SLICE_BYTES = 4_096, 4 << 20
#: Marks that may follow a letter word; they are a pre-token of their own.
MARKS = b".,;:!?"

Encoded = tuple[np.ndarray, np.ndarray, np.ndarray]

#: Kinds of bytes: ASCII white space, letters (ASCII, and the bytes of letters below U+0250), marks, all others.
_SPACE, _LETTER, _MARK, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123), *range(0xC3, 0xC9), *range(0x80, 0xC0)]] = _LETTER
_KIND[list(MARKS)] = _MARK


def vocabulary_path(name: str) -> str:
    """A path as it is, or a file of the installed public vocabularies, resolved where the task runs."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(name: str):  # noqa: ANN202
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(name))


@lru_cache(maxsize=2)
def _model_alone(name: str):  # noqa: ANN202
    """The library's tokenizer without normalization, for lower-case letter words between blanks."""
    from tokenizers import Tokenizer, pre_tokenizers

    alone = Tokenizer(_tokenizer(name).model)
    alone.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return alone


def drops_white_space(config: dict) -> bool:
    """Whether the tokenizer splits at white space and drops it, so that words encode independently."""
    pre = config.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers", [pre])
    cuts = any(p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert") and "\\s" in str(p.get("pattern")) for p in parts)
    return cuts and not any(t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"]) for t in config.get("added_tokens", []))


def parts_letters(config: dict) -> bool:
    """Whether letter runs are pre-tokens by themselves, in lower case, and no added token consists of letters and marks."""
    pre = config.get("pre_tokenizer") or {}
    runs = any("[\\p{L}]+|" in (p.get("pattern") or {}).get("Regex", "") for p in pre.get("pretokenizers", [pre]))
    lowers = any(x.get("type") == "Lowercase" for x in (config.get("normalizer") or {}).get("normalizers", []))
    return runs and lowers and all((_KIND[list(t["content"].encode())] == _OTHER).any() for t in config.get("added_tokens", []))


def units(data: np.ndarray, bounds: np.ndarray, letters: bool) -> tuple[pa.Array, np.ndarray]:
    """Stretches of the texts `data[bounds[i] : bounds[i + 1]]` that encode independently, and where each text's begin.

    These are the words between ASCII white space. With `letters`, a word of letters with marks behind them is two
    units, its letters in ASCII lower case. All steps work on whole arrays.
    """
    kind = _KIND[data]
    solid = kind != _SPACE
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    first = bounds[:-1][bounds[:-1] < len(data)]
    start[first] = solid[first]
    if letters:
        number = np.cumsum(start, dtype=np.int32)
        word = lambda at: number[at] - 1
        letter, mark, inner = kind == _LETTER, kind == _MARK, ~start[1:]
        # Two-byte characters that are no letters, or whose lower case isn't one letter.
        lead, tail = data[:-1], data[1:]
        odd = (lead == 0xC3) & ((tail == 0x97) | (tail == 0xB7)) | (lead == 0xC4) & (tail == 0xB0)
        mixed = np.zeros(number[-1] if len(number) else 0, bool)
        for at in (kind == _OTHER, odd, mark[:-1] & letter[1:] & inner):
            mixed[word(np.flatnonzero(at))] = True
        border = np.flatnonzero(letter[:-1] & mark[1:] & inner) + 1
        start[border[~mixed[word(border)]]] = True
        upper = np.flatnonzero((data >= 65) & (data <= 90))
        data = data.copy()
        data[upper[~mixed[word(upper)]]] |= 32
    at = np.flatnonzero(start)
    offsets = np.append((np.cumsum(solid, dtype=np.int32) - 1)[at], np.count_nonzero(solid)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[solid]))])
    return words, np.searchsorted(at, bounds)


class Words:
    """Ids of texts by their units, which are remembered between batches. All ids come from the library."""

    def __init__(self, name: str) -> None:
        self.tokenizer = _tokenizer(name)
        with open(vocabulary_path(name)) as f:
            config = json.load(f)
        self.free = drops_white_space(config)
        self.letters = self.free and parts_letters(config)
        suffix = config["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.model = _model_alone(name)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.ids, self.at = np.zeros(1 << 20, "<u4"), np.zeros(1 << 18, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, end = len(self.rows), int(self.at[len(self.rows)])
        while end + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[end : end + len(ids)] = ids
        self.at[n + 1 : n + 1 + len(words)] = end + np.cumsum(sizes)
        self.rows.update(zip(words, range(n, n + len(words)), strict=True))

    def _learn(self, words: list[bytes]) -> None:
        plain, others = [], []
        for w in words:
            if self.letters and w.isalpha():
                plain.append((w, w.decode()))
                continue
            t = w.decode("utf-8", "replace")
            low = t.lower()
            (plain if self.letters and t.isalpha() and max(t) < "\u0250" and low.isalpha() else others).append((w, low))
        # Words of one pre-token each pass the library's model alone, many at a time, and are cut behind the tokens that end a word.
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            ids = np.array(self.model.encode_batch_fast([" ".join(t for _, t in some).lower()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                self._add([w for w, _ in some], ids, np.diff(ends, prepend=0))
            else:
                others += some
        for at in range(0, len(others), 20_000):
            some = [w for w, _ in others[at : at + 20_000]]
            found = self._ids([w.decode("utf-8", "replace") for w in some])
            self._add(some, np.array([i for ids in found for i in ids], "<u4"), np.array([len(x) for x in found], np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin; the same as the library gives for the whole texts."""
        if not self.free:
            found = self._ids(texts.to_pylist())
            return np.array([i for ids in found for i in ids], "<u4"), np.cumsum([0, *map(len, found)])
        data, bounds = _bytes(texts)
        words, first = units(data, bounds, self.letters)
        coded = words.dictionary_encode()
        own = _values(coded.dictionary)
        if len(self.rows) + len(own) > MEMO_UNITS:
            self._forget()
        new = [w for w in own if w not in self.rows]
        if new:
            self._learn(new)
        row = np.fromiter(map(self.rows.__getitem__, own), np.int64, len(own))[coded.indices.to_numpy()]
        begin, sizes = self.at[row], self.at[row + 1] - self.at[row]
        end = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[np.repeat(begin - end[:-1], sizes) + np.arange(int(end[-1]))], end[first]


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts without nulls, and where each text begins."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, raw = texts.buffers()
    bounds = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def _values(words: pa.Array) -> list[bytes]:
    _, offsets, raw = words.buffers()
    at, raw = np.frombuffer(offsets, np.int32)[: len(words) + 1].tolist(), raw.to_pybytes() if raw is not None else b""
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to SLICE_ROWS rows and about SLICE_BYTES bytes of their column `text`; one text alone may be larger."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = _bytes(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, min(int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES)), at + SLICE_ROWS, batch.num_rows))
            yield batch.slice(at, stop - at)
            at = stop


@lru_cache(maxsize=2)
def words_of(name: str) -> Words:
    return Words(name)


def encode_with_offsets(name: str) -> Callable[[str], Encoded]:
    tokenizer = _tokenizer(name)

    def encode(text: str) -> Encoded:
        e = tokenizer.encode(text, add_special_tokens=False)
        at = np.array(e.offsets, np.int64).reshape(-1, 2)
        return np.array(e.ids, np.uint32), at[:, 0], at[:, 1]

    return encode


def is_border(before: str, after: str) -> bool:
    """Whether a pre-token ends between two characters whatever stands around them.

    Behind white space, and where a letter or digit is followed by a mark or digit, or a digit by a letter. Combining marks
    never follow a border, as normalization may join them with what is before them.
    """
    if before.isspace():
        return not unicodedata.category(after).startswith("M")
    a, b = unicodedata.category(before)[0], unicodedata.category(after)[0]
    return (a in "LN" and b in "PSN") or (a == "N" and b == "L")


def next_border(text: str, at: int) -> int:
    """The first border at or behind `at`; the text's end if none follows."""
    return next((i for i in range(max(at, 1), len(text)) if is_border(text[i - 1], text[i])), len(text))


def _boundary(text: str, left: Encoded, right: Encoded, lo: int, hi: int) -> tuple[int, int] | None:
    """Indices of the same token in both encodings, behind a border, with GUARD agreeing tokens on either side."""
    li = np.flatnonzero((left[1] >= lo) & (left[1] < hi))
    where = {int(s): i for i, s in reversed(list(enumerate(right[1]))) if lo <= s < hi}  # bytes of one character share its start: the first counts
    for i in sorted(li.tolist(), key=lambda i: abs(int(left[1][i]) - (lo + hi) // 2)):
        s = int(left[1][i])
        j = where.get(s)
        if j is None or i < GUARD or left[1][i - 1] == s or not is_border(text[s - 1], text[s]) or j < GUARD or i + GUARD > len(left[0]) or j + GUARD > len(right[0]):
            continue
        a, b = slice(i - GUARD, i + GUARD), slice(j - GUARD, j + GUARD)
        if len(left[0][a]) == len(right[0][b]) and all(np.array_equal(x[a], y[b]) for x, y in zip(left, right, strict=True)):
            return i, j
    return None


def encode_spliced(text: str, encode: Callable[[str], Encoded], chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Ids of the text, encoded chunk by chunk; equal to encoding it whole. Holds two chunks' offsets at a time.

    Where a whole chunk has no stable boundary, its end moves behind the next borders, twice as far each time, so a
    text's work stays linear whatever it is made of.
    """
    if len(text) <= chunk:
        return encode(text)[0]
    shift = lambda e, by: (e[0], e[1] + by, e[2] + by)
    out: list[np.ndarray] = []
    begin, end, reach = 0, chunk, chunk
    left = encode(text[:end])
    while end < len(text):
        wide = overlap
        while True:
            start = max(end - wide, begin)
            if start == begin:
                # No stable place in the whole chunk: it goes on up to behind the next border, at least as long again.
                reach *= 2
                end = min(len(text), next_border(text, end + reach) + overlap)
                left = shift(encode(text[begin:end]), begin)
                break
            stop = min(len(text), start + max(chunk, 2 * wide))
            right = shift(encode(text[start:stop]), start)
            found = _boundary(text, left, right, start, end)
            if found:
                i, j = found
                out.append(left[0][:i])
                begin, reach = int(right[1][j]), chunk
                left, end = tuple(x[j:] for x in right), stop
                break
            wide *= 2
    return np.concatenate([*out, left[0]])


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of `docs` (doc_id, text).

    Null or empty text has no bytes and no tokens. Repeated rows are each counted. Long texts are spliced from
    chunks, never cut off. Other columns are left out, whatever their names. Nothing is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(vocabulary)
        encode = encode_with_offsets(vocabulary)
        for batch in text_slices(batches):
            texts = batch.column("text")
            n_bytes = np.diff(_bytes(texts)[1])
            n = np.zeros(len(texts), np.int64)
            long = np.zeros(len(texts), bool)
            for i in np.flatnonzero(n_bytes > CHUNK).tolist():
                text = texts[i].as_py()
                if len(text) > CHUNK:
                    long[i], n[i] = True, len(encode_spliced(text, encode))
            n[~long] = np.diff(words.encode(texts.filter(pa.array(~long)))[1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents(docs).mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op2_token_counts(docs: DataFrame) -> DataFrame:
    return count_tokens(docs)
