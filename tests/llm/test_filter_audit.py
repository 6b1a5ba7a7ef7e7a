from __future__ import annotations

import re
from itertools import permutations

from recordlake.llm.filter_audit import op13_filter_audit

SCHEMA = "doc_id bigint, text string, lang string, mask int, digest string"
LABELS = "doc_id bigint, quality int, toxic int"
GOOD = " ".join(f"word{i}" for i in range(120))
TEXTS = [GOOD, GOOD + " #", "one two", None, "", "A B C " * 50, GOOD.upper(), "same same " * 60, GOOD + "\x0b\x0cend", "é" * 3]


def rows() -> list[tuple]:
    out = [(i, TEXTS[i % len(TEXTS)], ["en", "fr", None, ""][i % 4], 99, "x") for i in range(60)]
    return [*out, *out[:3], (None, GOOD, "en", 0, ""), (None, GOOD, "en", 0, ""), (3, "other text", "de", 0, None)]


def brute(docs: list[tuple], labels: list[tuple]) -> set[tuple]:
    least, good, toxic = {}, {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    fails = []
    for i, t, *_ in docs:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        own = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fails.append({f for f, bad in own.items() if bad})
    out = set()
    for part in {d[2] or "" for d in docs}:
        own = [(d, f) for d, f in zip(docs, fails, strict=True) if (d[2] or "") == part]
        removed_in, rows_ = {}, []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removed_in[f] = removed_in.get(f, 0) + len(gone)
                total = sum(f in x[1] for x in own)
                counts = (len(left), len(gone), total - len(gone), sum(x[1] == {f} for x in own), sum(x[0][0] in good for x in gone), sum(x[0][0] in toxic for x in gone))
                rows_.append((part, "".join(order), step, *counts, f))
        out |= {(*r[:-1], removed_in[r[-1]]) for r in rows_}
    return out


def test_equals_brute_force(spark):
    docs, labels = rows(), [(i, i % 2, i % 3) for i in range(0, 50, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1)]
    got = op13_filter_audit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS))
    assert [f.dataType.simpleString() for f in got.schema][2:] == ["int", *["bigint"] * 7]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) == 600 * 4
    assert set(got) == brute(docs, labels)


def test_empty_and_unlabelled(spark):
    labels = spark.createDataFrame([], LABELS)
    assert op13_filter_audit(spark.createDataFrame([], SCHEMA), labels).count() == 0
    one = op13_filter_audit(spark.createDataFrame([(1, None, None, 0, None)], SCHEMA), labels)
    assert {tuple(r)[3:] for r in one.where("filter_order = 'ABCDE' and step = 1").collect()} == {(0, 1, 0, 1, 0, 0, 120)}


def test_very_long_text(spark):
    docs = [(1, "w " * 300_000, "en", 0, None), (2, GOOD * 2000, "en", 0, None)]
    got = op13_filter_audit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], LABELS))
    assert {tuple(r) for r in got.collect()} == brute(docs, [])
