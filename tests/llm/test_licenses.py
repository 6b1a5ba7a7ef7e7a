from __future__ import annotations

import math
import random
from collections import Counter

from recordlake.llm import licenses, queries

from . import brute


def brute_scan(docs, templates, threshold, without=licenses.WITHOUT):
    """From the words alone: every stretch of a template's length, parted at words of other licenses."""
    phrases = [(p.split(), label) for p, label in licenses.BASE]
    telling = {x for own in without.values() for x in own}
    ready = [(w, math.ceil(len(w) / threshold - 1e-9), label) for t, label in templates for w in [brute.alnum(t)]]
    out = {}
    for doc_id, text in docs:
        w = brute.alnum(text)
        base = [(i, label) for p, label in phrases for i in range(len(w)) if w[i : i + len(p)] == p]
        met = []
        for every, span, label in ready:
            words, pairs = set(every), set(zip(every, every[1:], strict=False))
            barred, parts = set(without.get(label, ())) - words, [[]]
            for i, x in enumerate(w):
                if x in barred:
                    parts.append([])
                else:
                    parts[-1].append(x if x not in telling or x not in words or (i and (w[i - 1], x) in pairs) else "")
            for part in parts:
                for own in (set(part[i : i + span]) for i in range(len(part))):
                    if len(own & words) >= max(1, math.ceil(threshold * len(words) - 1e-9)) and own >= words & telling:
                        met.append((label, len(own & words) / len(words)))
        at = [i for i, _ in base]
        own_labels = sorted({x for _, x in base})
        score = 1.0 if base else max((s for _, s in met), default=0.0)
        out[doc_id] = (len(w), len(base), min(at, default=None), max(at, default=None), ",".join(own_labels), ",".join(sorted(set(own_labels) | {x for x, _ in met})), score)
    return out


def documents():
    r = random.Random(8)
    lines = [t for t, _ in licenses.TEMPLATES] + ["mit license", "the MIT-License apache license", "general public general public license", "ordinary words, here.", "É licensed under 4.0"]
    docs = []
    for i in range(150):
        parts = []
        for _ in range(r.randrange(0, 5)):
            w = r.choice(lines).split()
            for _ in range(r.randrange(0, max(2, len(w) // 8))):
                w[r.randrange(len(w))] = r.choice(["x", "license", "version", "the", "and. then"])
            parts.append("".join(x + r.choice([" "] * 8 + ["\n", ". "]) for x in w))
        docs.append((i, r.choice(["\n", " ", "; "]).join(parts)))
    docs += [(500 + i, t) for i, (t, _) in enumerate(licenses.TEMPLATES)]
    docs.append((800, "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated files"))
    docs.append((801, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"))
    docs.append((802, "All of the following. " + "Other words stand here between the two. " * 3 + "rights are reserved."))
    docs.append((803, "Copyright. All rights\nreserved."))
    return [*docs, (900, None), (901, ""), (902, "word " * 60_000 + "All rights reserved. " + "word " * 60_000)]


def test_equal_to_brute_force(spark):
    docs = documents()
    d = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id bigint, text string, score double").repartition(3)
    short = [x for x in docs if x[0] != 902]
    got = {x[0]: tuple(x)[1:] for x in licenses.op5_license_scan(d).collect()}
    long = got.pop(902)
    assert got == brute_scan(short, licenses.TEMPLATES, licenses.THRESHOLD)
    assert long == (120_003, 0, None, None, "", "all-rights-reserved", 1.0)
    for i, (_, label) in enumerate(licenses.TEMPLATES):
        assert label in got[500 + i][5].split(",") and got[500 + i][6] == 1.0
    assert (got[800][5], got[801][5], got[802][5], got[803][5]) == ("mit", "bsd", "", "all-rights-reserved")
    loose = {x[0]: tuple(x)[1:8] for x in licenses.scan(d.where("doc_id <> 902"), threshold=0.6).collect()}
    assert loose == brute_scan(short, licenses.TEMPLATES, 0.6)
    assert licenses.op5_license_scan(d.limit(0)).count() == 0


def test_a_license_within_another_is_not_its_own(spark):
    cases = {
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "licensed under cc by-nd 4.0": "cc-by-nd",
        "Licensed under CC BY-SA 4.0": "cc-by-sa",
        "Licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa",
        "Licensed under CC BY-NC-ND 4.0, text. Licensed under CC BY 4.0": "cc-by,cc-by-nc-nd",
        "Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "gpl,lgpl",  # gpl by its base phrase
        "This work is licensed under the GNU Affero General-Public, License, version 3.": "agpl,gpl",
        "nc Licensed under CC BY 4.0. nd": "cc-by",
        " ".join(["All", *["word"] * 6000, "rights", *["word"] * 3, "reserved"]): "",
    }
    d = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    assert {x.doc_id: x.labels for x in licenses.op5_license_scan(d).collect()} == dict(enumerate(cases.values()))


def test_a_list_beyond_the_bound_takes_several_passes(spark):
    docs = documents()[:60]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert len(licenses.passes(list(licenses.TEMPLATES), 200)) > 3
    got = {x[0]: tuple(x)[1:8] for x in licenses.scan(d, pass_words=200).collect()}
    assert got == brute_scan(docs, licenses.TEMPLATES, licenses.THRESHOLD)


def test_length_and_position_drop_candidates_and_lose_none():
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    templates = [(" ".join(r.sample(vocab, r.randrange(3, 20))), str(i)) for i in range(40)]
    ready = licenses.prepare(templates, {w.encode(): r.randrange(9) for w in vocab}, 0.7)
    tally = Counter()
    for _ in range(400):
        block = r.sample(vocab, r.randrange(1, 30))
        got = {t.label for t, _ in licenses.join_block([w.encode() for w in block], ready, tally)}
        assert got == {label for t, label in templates if len(set(t.split()) & set(block)) >= math.ceil(0.7 * len(t.split()) - 1e-9)}
    assert tally["length"] > 100 and tally["position"] > 100


def test_registered(spark, tmp_path):
    spark.createDataFrame([(1, "Released under\nthe MIT License.")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.QUERIES["op5_license_scan"](spark, str(tmp_path)).head().labels == "mit"
