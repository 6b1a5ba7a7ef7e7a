from __future__ import annotations

import random
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

from recordlake.llm import packing, tokens

from .brute import crc

ODD = [None, "", " ", "a", "\x1c\x85 　x", "é ́x y's it's", "<|endoftext|> <|startoftext|>x", "日本語 テキスト", "ÄÖÜ ß İ Σς", "word nbsp line 12345 $$$ ###"]


def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def texts(n: int = 40) -> list[str]:
    r = random.Random(5)
    syllables = ["the", "an", "ing", "é", "tion", "ß", ".", ",", "'s", "12", "ñ"]
    return ["".join(r.choice(syllables) + r.choice(["", "", " ", "\n"]) for _ in range(r.randrange(1, 4000))) for _ in range(n)]


def test_counts_equal_the_library(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, *texts(), ("the thing " * 9000) + "end"])] + [(None, "null id"), (1, "twice"), (1, "twice")]
    lib = library()
    want = Counter((i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows)
    got = tokens.op2_token_counts(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, n_bytes string")).collect()
    assert Counter(tuple(r) for r in got) == want
    assert tokens.op2_token_counts(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_splicing_widens_and_is_exact():
    encode = tokens.encode_with_offsets("word_bpe_49k.json")
    for text in [*texts(12), "x" * 900 + " tail of words here", "no" * 300 + " " + "break" * 200]:
        for chunk, overlap in ((64, 8), (200, 16), (1000, 4)):
            assert tokens.encode_spliced(text, encode, chunk, overlap).tolist() == encode(text)[0].tolist()


def test_long_texts_without_white_space_are_spliced_in_linear_work():
    work = 0
    whole = tokens.encode_with_offsets("word_bpe_49k.json")

    def encode(text):
        nonlocal work
        work += len(text)
        return whole(text)

    for text in ("日本語、テキスト。" * 9_000, "ab1cd,ef" * 12_000, "x" * 70_000, "ab" * 20_000 + "'s it's " + "e\u0301," * 20_000, "<|endoftext|>" * 6_000):
        work = 0
        assert tokens.encode_spliced(text, encode).tolist() == whole(text)[0].tolist()
        assert work < 4 * len(text) + 4 * tokens.CHUNK


def test_units_of_mixed_words(spark):
    marks = ["The.", "THE", "É,", "É", "İ.", "x×", "×x", "a.b", "..a", "a..", "A!?", "ǅ;", "ß:", "é́.", "don't.", "x", "<|ENDOFTEXT|>", "日本。", ""]
    rows = [(i, " ".join([a, b, a])) for i, (a, b) in enumerate((a, b) for a in marks for b in marks)]
    lib = library()
    got = tokens.op2_token_counts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_packing_covers_every_id_once(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, *texts(60), "the " * 9000])] + [(7, "twice"), (7, "twice")]
    lib = library()
    want = Counter()
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want.update((i, at, len(ids[at : at + 2048]), crc(ids[at : at + 2048]), len(ids)) for at in range(0, len(ids), 2048))
    got = packing.op8_packing(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    at: dict[int, int] = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048
    clashing = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id bigint, text string, start int, length string")
    assert [tuple(r)[:3] for r in packing.op8_packing(clashing).collect()] == [(1, 0, 3)]
    assert packing.op8_packing(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_histogram_packing_places_all_and_pads_little():
    r = random.Random(1)
    for _ in range(20):
        histogram = dict(Counter(min(2048, int(r.lognormvariate(5.5, 1)) + 1) for _ in range(5000)))
        placed, total, n = Counter(), 0, 0
        for count, places in packing.shortest_pack_first(histogram):
            filled = 0
            for p in places:
                assert p.offset == filled
                filled += p.length * p.times
                placed[p.length] += count * p.times
            assert filled <= 2048
            total += count * filled
            n += count
        assert placed == Counter(histogram)
        assert total / (n * 2048) > 0.97
