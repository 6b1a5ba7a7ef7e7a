from __future__ import annotations

import itertools
import math
import random
import zlib

from recordlake.llm import toxicity as tx
from recordlake.llm import transducers as ts


def memo(**words):
    return tx.Memo(tx.Lexicon(words={**tx.INSULTS, **words}))


def paths(t, symbols):
    """Every path of a transducer as (what it writes, weight, place of the word that it takes)."""
    found = [(t.start, (), 0.0, None)]
    for i, s in enumerate(symbols):
        found = [(x.target, (*out, x.out), w + x.weight, i if x.takes else at) for state, out, w, at in found for x in t.arcs.get(state, {}).get(s, ())]
    return [(out, w, at) for state, out, w, at in found if state in t.finals]


def brute(classes, contexts):
    """The heaviest path through the transducers one after the other, none composed, by trying all."""
    ways = [(tuple(k for k, _ in classes), 0.0, None)]
    for t in tx.parts(contexts):
        ways = [(out, w + v, at if at is not None else before) for written, w, before in ways for out, v, at in paths(t, written)]
    return max((w + (classes[at][1] if at is not None else 0.0) for _, w, at in ways), default=None)


def test_composed_machine_equals_all_paths():
    r = random.Random(4)
    contexts = tx.Contexts(0.7, -2.3, -2.1)
    machine = tx.grammar(contexts)
    for _ in range(400):
        classes = [(k, r.uniform(-1, 3) if k in "IH" else 0.0) for k in r.choices("IHTNRO", (3, 2, 2, 2, 2, 4), k=r.randrange(1, 9))]
        want, got = brute(classes, contexts), ts.best(machine, classes)
        assert (want is None) == (got is None) and (want is None or math.isclose(want, got, abs_tol=1e-9))
    for gaps in itertools.product((0, 3, 4, 5, 6, 7, 40), repeat=3):
        classes = [c for k, n in zip("NITR", (*gaps, 2)) for c in [(k, 1.5 if k == "I" else 0.0), *[("O", 0.0)] * n]] + [("H", 1.0)]
        assert ts.best(machine, classes) == ts.best(machine, tx.shortened(classes))


def test_numbering_drops_dead_ends():
    t = ts.Transducer("a", {"b"})
    t.add("a", "x", "b", "y", 1.0)
    t.add("a", "x", "dead", weight=9.0)
    t.add("b", "x", "b", weight=0.5)
    made = ts.numbered(t)
    assert ts.best(made, [("x", 0.0), ("x", 0.0)]) == 1.5 and sum(len(a) for s in made.arcs.values() for a in s.values()) == 2
    assert ts.best(ts.numbered(ts.Transducer("a", set())), [("x", 0.0)]) is None


def test_clauses_not_words():
    m = memo()
    plain = tx.score("that was stupid", m)
    assert plain >= 0.7
    assert tx.score("you are stupid", m) > plain
    assert tx.score("that was not stupid at all", m) < 0.7
    assert tx.score("she said it was not a stupid idea", m) < 0.5
    assert tx.score("i will hurt you", m) >= 0.7
    assert max(tx.score("my feet hurt", m), tx.score("i will never hurt you", m), tx.score("", m)) < 0.03
    assert tx.score("not now, idiot", m) >= 0.7  # a negation ends with its clause
    assert tx.score("he called it stupid", m) < 0.7 <= tx.score("he called me. stupid", m)


def test_grammar_beats_single_words():
    """On sentences whose words alone say nothing of who means whom."""
    cases = [(f"{a} {b} {w} {c}", toxic) for w in ("idiot", "scum", "trash") for a, b, c, toxic in (("you", "are", "here", 1), ("what", "an", "he is", 1), ("you are", "not an", "at all", 0), ("he", "wrote", "on a wall", 0), ("nobody", "was", "then", 0))]
    cases += [("we will destroy them all", 1), ("i want to hurt you", 1), ("the waves destroy the beach", 0), ("my feet hurt", 0), ("i would never hurt you", 0)]
    m = memo()
    words = lambda text: int(any(m[w][0] in "IH" for w in text.split()))
    right = lambda f: sum(f(text) == toxic for text, toxic in cases)
    assert right(lambda t: int(tx.score(t, m) >= 0.7)) == len(cases) > right(words)


def test_nulls_split_stems_and_held_out_accuracy(spark):
    words = "lorem ipsum dolor sit amet moreover distance closed".split()
    docs = [(i, " ".join(words[(i + j) % 8] for j in range(30)) + (f" zorgu{'abc'[i % 3]}x here moron disgusting" if i % 4 == 0 else "")) for i in range(400)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (3, 1, None), (0, 0, 0)]
    long = "word " * 100_000 + "zorguax " + "word " * 100_000
    d = spark.createDataFrame([(*r, "x") for r in [*docs, (None, "x"), (1000, None), (1001, ""), (5, docs[5][1]), (1002, long)]], "doc_id bigint, text string, score string")
    t = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    lexicon = tx.learn(d, t)
    assert "zorgu" in lexicon.stems and not any(s.startswith(("mor", "dis", "clo")) for s in lexicon.stems)
    assert lexicon.contexts.target >= 0 >= max(lexicon.contexts.negated, lexicon.contexts.reported)
    got = tx.op6_toxicity(d, t).collect()
    assert len(got) == 405
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id < 400:
            assert r.predicted == int(r.doc_id % 4 == 0)
        if r.doc_id == 1002:
            assert r.predicted == 1
    assert tx.op6_toxicity(d.limit(0), t.limit(0)).count() == 0
