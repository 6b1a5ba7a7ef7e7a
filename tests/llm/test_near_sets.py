from __future__ import annotations

import random
import re

from recordlake.llm import near_sets, stages

from . import brute


def jaccard(x, y):
    return 1.0 if x == y else len(x & y) / len(x | y)


def survivors(docs):
    """The least doc_id of each group of texts linked by a Jaccard similarity of 0.8 or more of five-word shingles."""
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", brute.lower(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    return {min(d for (d, _), x in zip(docs, label, strict=True) if x == own) for own in set(label)}, sets


def test_stage_equal_to_brute_force_jaccard(spark, tmp_path, monkeypatch):
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(300)]
    passage = " ".join(r.choice(vocab) for _ in range(30))
    base = [" ".join(r.choice(vocab) for _ in range(r.randrange(40, 160))) for _ in range(15)]
    docs = [(i, t) for i, t in enumerate(base)] + [(100 + i, f"{passage} " + " ".join(r.choice(vocab) for _ in range(60))) for i in range(15)]
    for i in range(150):
        w = r.choice(base).split()
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = r.choice(vocab)
        docs.append((1000 - i, " ".join(w)))
    docs += [(2000, None), (2001, " \n"), (2002, "a b c"), (2003, "A  b c"), (2004, "a b c d e f"), (2005, "a b c d e")]
    want, sets = survivors(docs)
    close = [jaccard(x, y) for i, x in enumerate(sets) for y in sets[:i] if x and y]
    assert sum(0.8 <= x < 0.95 for x in close) > 50 and sum(0.6 < x < 0.8 for x in close) > 50
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, lang string").repartition(5)
    assert {x.doc_id for x in stages.near_duplicate_groups(spark, d, str(tmp_path)).collect()} == want
    monkeypatch.setattr(near_sets, "LOOKED_UP", 1)
    assert {x.doc_id for x in stages.near_duplicate_groups(spark, d, str(tmp_path)).collect()} == want
    assert stages.near_duplicate_groups(spark, d.limit(0), str(tmp_path)).count() == 0


def test_one_id_with_several_texts(spark, tmp_path):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (7, c), (7, c), (5, a), (9, c), (9, "only here " + b.upper().replace("B", "z"))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted((x.doc_id, x.text) for x in stages.near_duplicate_groups(spark, d, str(tmp_path)).collect())
    assert got == sorted([(1, a), (1, b), (7, c), (9, rows[-1][1])])
    swapped = spark.createDataFrame([(5, a), (5, b), (3, b)], "doc_id bigint, text string")
    assert sorted((x.doc_id, x.text) for x in stages.near_duplicate_groups(spark, swapped, str(tmp_path)).collect()) == [(3, b), (5, a)]


def test_bands_tell_similar_sets_from_others():
    r = random.Random(3)
    met = []
    for share in (0.8, 0.5, 0.1):
        hits = 0
        for _ in range(200):
            union = [r.getrandbits(64) for _ in range(100)]
            same = int(100 * share)
            half = (100 - same) // 2
            x, y = union[: same + half], union[:same] + union[same + half :]
            keys = [set(near_sets.bands(near_sets.np.array(sorted(s), near_sets.np.uint64)).tolist()) for s in (x, y)]
            hits += bool(keys[0] & keys[1])
        met.append(hits)
    assert met[0] == 200 and met[2] < 10


def test_no_candidate_is_dropped_in_a_band_of_many(spark, tmp_path, monkeypatch):
    """Sets that share bands and are nearly similar, of which no head is compared with: the rounds over all pairs find what is similar."""
    r = random.Random(9)
    common = [f"c{i}" for i in range(70)]
    docs = []
    for i in range(40):
        tail = [f"t{i}_{k}" for k in range(22)]
        docs += [(i, " ".join(common + tail)), (100 + i, " ".join(common + tail[:12] + [f"u{i}_{k}" for k in range(6)]))]
    r.shuffle(docs)
    want, sets = survivors(docs)
    monkeypatch.setattr(near_sets, "HEADS", 0)
    monkeypatch.setattr(near_sets, "PART", 16)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert 1 < len(want) < len(docs)
    assert {x.doc_id for x in stages.near_duplicate_groups(spark, d, str(tmp_path)).collect()} == want


def test_a_candidate_is_made_once_however_many_bands_it_shares():
    r, np = random.Random(4), near_sets.np
    common = [r.getrandbits(64) for _ in range(90)]
    sets = [np.array(sorted(common[: r.randrange(70, 91)] + [r.getrandbits(64) for _ in range(r.randrange(40))]), np.uint64) for _ in range(30)]
    low = [near_sets.minima(s) for s in sets]
    keys = [near_sets.band_keys(x) for x in low]
    rows = [(keys[i][b], 1, i, i, low[i].astype(np.uint8).tobytes(), b, len(sets[i]), keys[i]) for i in range(30) for b in range(near_sets.BANDS)]
    frame = near_sets.pd.DataFrame(sorted(rows, key=lambda x: (x[0], x[2])), columns=["g", "kind", "node", "root", "sketch", "band", "size", "keys"])
    got = [(a, b) for f in near_sets._each(frame) for a, b in zip(f["a"], f["b"], strict=True)]
    agree = lambda i, j: (low[i].astype(np.uint8) == low[j].astype(np.uint8)).sum() >= near_sets.AGREE
    fits = lambda i, j: 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j]))
    shared = {(i, j): (keys[i] == keys[j]).sum() for j in range(30) for i in range(j)}
    assert len(got) == len(set(got)) and set(got) == {(i, j) for (i, j), n in shared.items() if n and agree(i, j) and fits(i, j)}
    assert sum(shared[p] > 1 for p in got) > 20


def test_nearly_similar_sets_make_no_row_a_pair(spark, tmp_path, monkeypatch):
    """Sets that share bands and are all nearly similar: rows follow the sets and not their pairs, and what is similar is joined."""
    r = random.Random(12)
    common = [f"c{i}" for i in range(70)]
    docs = []
    for i in range(240):
        tail = [f"t{i}_{k}" for k in range(13)]
        docs.append((i, " ".join(common + tail)))
        if i % 6 == 0:
            docs.append((1000 + i, " ".join(common + tail[:9] + [f"u{i}_{k}" for k in range(4)])))
    r.shuffle(docs)
    want, sets = survivors(docs)
    assert 1 < len(want) < len(docs) and sum(0.65 < jaccard(x, y) < 0.8 for i, x in enumerate(sets) for y in sets[:i]) > 30_000
    made, cut = [], near_sets.cut

    def counted(df, rows=None):
        out = cut(df, rows)
        made.append(out.count())
        return out

    monkeypatch.setattr(near_sets, "cut", counted)
    monkeypatch.setattr(near_sets, "HEADS", 0)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(near_sets, "PART", 96)
    monkeypatch.setattr(near_sets, "WORDS", 4000, raising=False)
    assert {x.doc_id for x in stages.near_duplicate_groups(spark, d, str(tmp_path)).collect()} == want
    assert max(made) <= near_sets.BANDS * len(docs)


def test_sets_that_are_joined_are_not_dealt_out_against_each_other(spark, monkeypatch):
    monkeypatch.setattr(near_sets, "PART", 16)
    roots = [0] * 300 + list(range(1, 41))
    rows = [(7, 2, i, roots[i], b"", 90, [], len(roots)) for i in range(len(roots))] + [(8, 2, 1000 + i, i, b"", 90, [], 3) for i in range(3)]
    d = spark.createDataFrame(rows, "key bigint, band int, node bigint, root bigint, sketch binary, size int, keys array<bigint>, n bigint")
    dealt = near_sets._every_pair(d).select("g", "kind", "node", "root").collect()
    groups, met = {}, []
    for x in dealt:
        groups.setdefault(x.g, []).append(x)
    for g in groups.values():
        met += [frozenset((a.node, b.node)) for a in g for b in g if a.root != b.root and (a.kind, b.kind) in ((0, 2), (1, 1)) and (a.kind == 0 or a.node < b.node)]
    want = {frozenset((i, j)) for j in range(len(roots)) for i in range(j) if roots[i] != roots[j]}
    want |= {frozenset((1000 + i, 1000 + j)) for j in range(3) for i in range(j)}
    assert set(met) == want and len(met) == len(want)
    assert len(dealt) <= 300 * 3 + 40 * 22 + 3
