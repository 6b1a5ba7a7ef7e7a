from __future__ import annotations

import hashlib
import math
import re

import pytest

from recordlake.llm import mixing
from recordlake.llm.mixing import mix, op11_mixing

SCHEMA = "doc_id bigint, text string, source string, key string, bin int"


def rows() -> list[tuple]:
    out = [(i, " ".join(f"w{j}{'#' * (i % 4)}" for j in range(i * 7 % 50)), ["big", "tiny", None, "é", ""][0 if i % 3 == 0 else i % 5], "k", 1) for i in range(300)]
    return [*out, *out[:20], *([(None, "no id at all", "big", "k", 1)] * 5), (7, None, "tiny", None, None), (8, " \t ", "big", None, None), (9, "x" * 5000, "odd", None, None)]


def brute(docs: list[tuple], weights=(5, 2, 1), cap=3) -> list[tuple]:
    def words(t):
        return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]

    def key(i, t):
        t = t or ""
        h = hashlib.md5(f"{'' if i is None else i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()
        size = len(words(t))
        symbols = len(re.findall(r"[#$%&*|<>{}\\]", t))
        quality = max(0.05, 1 - 10 * symbols / len(t)) * (1 if 3 <= len("".join(words(t))) / size <= 12 else 0.25) if size else 1
        return -math.log((int(h[:13], 16) + 0.5) / 2**52) / quality, quality

    own = [(d[2], d[0], len(words(d[1])), *key(d[0], d[1])) for d in docs]
    sources = sorted({d[2] for d in docs}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(o[2] for o in own if o[0] == s) for s in sources}
    w = {s: weights[i % 3] for i, s in enumerate(sources)}
    total, capped, target = sum(sizes.values()), set(), {}
    while True:
        free = [s for s in sources if s not in capped]
        rest, weight = total - sum(cap * sizes[s] for s in capped), sum(w[s] for s in free)
        target = {s: cap * sizes[s] if s in capped else rest * w[s] / weight for s in sources}
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in sources:
        quota = math.floor(target[s] + 0.5)
        epochs, rest = divmod(quota, sizes[s]) if sizes[s] else (0, 0)
        for _, i, size, _, _ in sorted((o for o in own if o[0] == s), key=lambda o: (o[3], o[1] is not None, o[1] or 0, o[2], o[4])):
            part = max(0, min(size, rest))
            rest -= part
            out.append((i, size, sizes[s], target[s], epochs * size + part))
    return out


def plain(r) -> tuple:
    return (r[0], r[1], r[2], round(r[3], 6), r[4])


@pytest.mark.parametrize("bin_rows", [mixing.BIN_ROWS, 2])
def test_equals_brute_force(spark, monkeypatch, bin_rows):
    monkeypatch.setattr(mixing, "BIN_ROWS", bin_rows)
    docs = rows()
    got = sorted(map(plain, op11_mixing(spark.createDataFrame(docs, SCHEMA)).collect()), key=repr)
    assert got == sorted(map(plain, brute(docs)), key=repr)
    assert all(taken <= 3 * size for _, size, _, _, taken in got)
    assert sum(r[4] for r in got) == pytest.approx(sum(r[1] for r in got), abs=5)


def test_reruns_agree_whatever_the_partitions(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    a, b = (sorted(map(tuple, op11_mixing(d).collect()), key=repr) for d in (docs, docs.repartition(7)))
    assert a == b


def test_empty_tables_and_texts(spark):
    assert op11_mixing(spark.createDataFrame([], SCHEMA)).count() == 0
    got = op11_mixing(spark.createDataFrame([(1, None, None, None, None), (2, "", "a", None, None)], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_share_above_what_there_is_is_capped(spark):
    got = mix(spark.createDataFrame([(1, "a b c", "x", None, None), (2, "d", None, None, None)], SCHEMA), share=9.0).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == [(1, 9), (2, 3)]


def test_better_documents_come_first(spark):
    docs = [(i, "word " * 10 + ("" if i % 2 else "# " * 10), "a", None, None) for i in range(400)] + [(1000, "word " * 20000, "b", None, None)]
    got = mix(spark.createDataFrame(docs, SCHEMA), weights=(1,), share=0.1).where("source = 'a' and taken > 0").collect()
    clean = sum(r.doc_id % 2 for r in got)
    assert clean > 3 * (len(got) - clean)
