"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are mapped to classes: insult, threat, target, negation, report, other. Transducers for these run over a clause's
classes: one picks an insult or threat, one discounts what is negated, one what is reported speech, one looks for
a target before or behind. They are composed into one machine, and a clause scores what its heaviest
match does. A text's score joins its clauses' as independent evidence. Insults come from a fixed list and from
labelled texts: words and word stems that mark toxic texts, learned from words that no list has. The weights
of the contexts are fitted on the same texts, starting from fixed ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import nullable_ints, slices
from .transducers import Transducer, best, compose, numbered

#: Fixed word lists: insults with their weights, and the classes that change what an insult counts for.
INSULTS = dict.fromkeys("idiot moron stupid trash clown loser scum pathetic disgusting worthless imbecile dumb filth vermin".split(), 0.9)
THREATS = frozenset("kill hurt destroy beat strangle stab burn smash töten umbringen verletzen zerstören tuer frapper détruire brûler matar golpear destruir quemar".split())
TARGETS = frozenset("you your you're yourself u tu te toi vous ton votre du dich dir ihr euch usted ustedes ti tus he she they him her them".split())
NEGATIONS = frozenset("not never isn't aren't don't nobody hardly nicht kein keine jamais pas nunca jamas".split())
REPORTS = frozenset("said says called calls reported wrote quoted claimed alleged dit écrit sagte schrieb dijo escribió".split())
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "IHTNRO"

#: No single word is surer than this.
MAX_WEIGHT = 0.95
THREAT_WEIGHT = 0.85
#: Words for which a negation, a report or a target stays open.
REACH, REPORT_REACH, TARGET_REACH = 3, 5, 4
BASE_SCORE = 0.02

#: Fitting. TRAIN_ROWS bounds the labelled rows that words and weights are learned from (lowest hash of doc_id first).
TRAIN_ROWS = 20_000
STEMS = (5, 6, 7, 8)
MIN_TEXTS, MIN_SHARE, MIN_PRECISION = 5, 0.013, 0.9
#: Matched clauses that the fixed weight of a context counts for in the fit.
PRIOR_CLAUSES = 20
SPLIT, HELD_OUT = 3, 1

_CLAUSE = re.compile(r"[.!?;:,()\n\"«»]")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def logit(p: float) -> float:
    return math.log(p / (1 - p))


@dataclass
class Contexts:
    """What is added to an insult's log-odds where it has a target, is negated or is reported."""

    target: float = math.log(2.0)
    negated: float = math.log(0.1)
    reported: float = math.log(0.12)


@dataclass
class Lexicon:
    """Weights of whole words and of word stems, as the share of toxic texts among those that have them, and of contexts."""

    words: dict[str, float] = field(default_factory=lambda: dict(INSULTS))
    stems: dict[str, float] = field(default_factory=dict)
    contexts: Contexts = field(default_factory=Contexts)

    def insult(self, word: str) -> float:
        weight = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) >= n:
                weight = max(weight, self.stems.get(word[:n], 0.0))
        return min(weight, MAX_WEIGHT)


class Memo(dict):
    """Class and log-odds of each word met, remembered. Bounded, so that a worker's memory is."""

    LIMIT = 500_000

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon
        self.machine = grammar(lexicon.contexts)

    def __missing__(self, word: str) -> tuple[str, float]:
        weight = self.lexicon.insult(word)
        lists = ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS))
        kind = INSULT if weight else next((k for k, words in lists if word in words), OTHER)
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = kind, logit(weight) if weight else logit(THREAT_WEIGHT) if kind == THREAT else 0.0
        return self[word]


def pick() -> Transducer:
    """Picks one insult or threat of the clause, with its word's weight; all others become other words."""
    t = Transducer(0, {1})
    for state in (0, 1):
        for symbol in (INSULT, THREAT):
            t.add(state, symbol, state, OTHER)
        for symbol in (TARGET, NEGATION, REPORT, OTHER):
            t.add(state, symbol, state)
    t.add(0, INSULT, 1, takes=True)
    t.add(0, THREAT, 1, takes=True)
    return t


def opened(by: str, reach: int, weight: float) -> Transducer:
    """An insult at most `reach` words behind the symbol `by` weighs `weight` more; a threat there isn't matched."""
    t = Transducer(0, set(range(reach + 1)))
    for left in range(reach + 1):
        after = max(0, left - 1)
        for symbol in (TARGET, NEGATION, REPORT, OTHER):
            t.add(left, symbol, reach if symbol == by else after)
        t.add(left, INSULT, after, weight=weight if left else 0.0)
        if not left:
            t.add(left, THREAT, after)
    return t


def targeted(reach: int, weight: float) -> Transducer:
    """An insult with a target at most `reach` words before or behind it weighs `weight` more; a threat needs one.

    What stands behind is guessed: a path that promises a target ends nowhere unless one comes in time.
    """
    t = Transducer(("before", 0), {"done", *(("before", k) for k in range(reach + 1))})
    plain = (NEGATION, REPORT, OTHER)
    for left in range(reach + 1):
        state, after = ("before", left), ("before", max(0, left - 1))
        for symbol in plain:
            t.add(state, symbol, after)
        t.add(state, TARGET, ("before", reach))
        t.add(state, INSULT, "done", weight=weight if left else 0.0)
        if left:
            t.add(state, THREAT, "done")
        else:
            t.add(state, INSULT, ("promised", reach), weight=weight)
            t.add(state, THREAT, ("promised", reach))
    for left in range(1, reach + 1):
        t.add(("promised", left), TARGET, "done")
        if left > 1:
            for symbol in plain:
                t.add(("promised", left), symbol, ("promised", left - 1))
    for symbol in (TARGET, *plain):
        t.add("done", symbol, "done")
    return t


def parts(c: Contexts) -> list[Transducer]:
    return [pick(), opened(NEGATION, REACH, c.negated), opened(REPORT, REPORT_REACH, c.reported), targeted(TARGET_REACH, c.target)]


def grammar(c: Contexts) -> Transducer:
    """All transducers composed into one machine."""
    made, *others = parts(c)
    for t in others:
        made = compose(made, t)
    return numbered(made)


def shortened(classes: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """Without other words beyond the reach of everything: nothing stays open over so many, so no path's weight changes."""
    longest, run, out = max(REACH, REPORT_REACH, TARGET_REACH) + 1, 0, []
    for c in classes:
        run = run + 1 if c[0] == OTHER else 0
        if run <= longest:
            out.append(c)
    return out


def clause_score(classes: list[tuple[str, float]], machine: Transducer) -> float:
    """Probability of the clause's heaviest match; 0 if none matches."""
    weight = best(machine, shortened(classes))
    return 0.0 if weight is None else 1 / (1 + math.exp(-weight))


def clauses(text: str, memo: Memo) -> Iterator[list[tuple[str, float]]]:
    """Classes of the words of each clause that has an insult or threat."""
    low = text.lower()
    if any(memo[w][0] in (INSULT, THREAT) for w in set(_WORD.findall(low))):
        for clause in _CLAUSE.split(low):
            classes = [memo[w] for w in _WORD.findall(clause)]
            if any(k in (INSULT, THREAT) for k, _ in classes):
                yield classes


def score(text: str, memo: Memo) -> float:
    """1 - (1 - base) * product of (1 - clause scores); the base score if no clause matches."""
    clean = 1 - BASE_SCORE
    for classes in clauses(text, memo):
        clean *= 1 - clause_score(classes, memo.machine)
    return 1 - clean


def held_out(doc_id):  # noqa: ANN001, ANN201
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(SPLIT)) == HELD_OUT, F.lit(False))


def _training(docs: DataFrame, labels: DataFrame, train_rows: int) -> tuple[DataFrame, int]:
    """text, toxic of at most `train_rows` labelled rows that aren't held out, and how many of the labels are toxic."""
    own = labels.select(F.col("doc_id").cast("bigint").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where("label_id is not null and toxic is not null")
    own = own.where(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    own = own.orderBy(F.xxhash64("label_id"), "label_id").limit(train_rows)  # bounded, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(own), texts["doc_id"] == own["label_id"]).select("text", "toxic")
    return rows, own.agg(F.sum("toxic")).head()[0] or 0


def _fit_contexts(rows: DataFrame, lexicon: Lexicon) -> Contexts:
    """Log-odds of matched clauses being in toxic texts, by context against none, where the fixed weights count for PRIOR_CLAUSES."""
    fixed = Contexts()
    # Of these machines each matches only what is in its context.
    tests = {"target": targeted(TARGET_REACH, 1.0), "negated": opened(NEGATION, REACH, 1.0), "reported": opened(REPORT, REPORT_REACH, 1.0)}
    machines = {name: compose(pick(), t) for name, t in tests.items()}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(lexicon)
        seen = {name: [0, 0] for name in ("none", *machines)}
        for f in frames:
            for text, toxic in zip(f["text"], f["toxic"], strict=True):
                for classes in clauses(text, memo):
                    classes = shortened([(k, 0.0) for k, _ in classes if k != THREAT])
                    own = [name for name, m in machines.items() if (best(m, classes) or 0.0) > 0.5]
                    for name in own or ["none"]:
                        seen[name][toxic] += 1
        yield pd.DataFrame([(k, *v) for k, v in seen.items()], columns=["context", "clean", "toxic"])

    counted = rows.mapInPandas(count, "context string, clean bigint, toxic bigint").groupBy("context").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = {r["context"]: (r["clean"], r["toxic"]) for r in counted.collect()}  # four rows
    plain = 0.9
    odds = lambda name, p: logit(min(0.99, max(0.01, (n.get(name, (0, 0))[1] + PRIOR_CLAUSES * p) / (sum(n.get(name, (0, 0))) + PRIOR_CLAUSES))))
    expected = {name: 1 / (1 + math.exp(-(logit(plain) + getattr(fixed, name)))) for name in machines}
    shift = {name: odds(name, p) - odds("none", plain) for name, p in expected.items()}
    # A target never speaks against an insult, a negation or report never for it.
    return Contexts(max(0.0, shift["target"]), min(0.0, shift["negated"]), min(0.0, shift["reported"]))


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Lexicon:
    """Words and stems whose texts are toxic, and weights of contexts, from at most `train_rows` labelled rows that aren't held out.

    A label given twice counts as toxic if one of them says so. Words of the fixed lists teach no stems, so that no stem of
    theirs stands for other words. A mark must stand in MIN_SHARE of the toxic texts, so what reaches the driver is
    bounded by the marks of one text divided by that share. Without labels the fixed lists remain.
    """
    rows, n_toxic = _training(docs, labels, train_rows)
    listed = INSULTS.keys() | THREATS | TARGETS | NEGATIONS | REPORTS

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in slices(frames, 2000):
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(f["text"], f["toxic"], strict=True):
                words = set(_WORD.findall(text.lower())) - listed
                for m in {"=" + w for w in words} | {w[:n] for w in words for n in STEMS if len(w) >= n}:
                    seen.setdefault(m, [0, 0])[toxic] += 1
            yield pd.DataFrame({"mark": list(seen), "clean": [x[0] for x in seen.values()], "toxic": [x[1] for x in seen.values()]})

    counts = rows.mapInPandas(count, "mark string, clean bigint, toxic bigint").groupBy("mark").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # Or among so many marks some would stand in a few toxic texts by chance.
    least = max(MIN_TEXTS, MIN_SHARE * n_toxic)
    good = counts.where((F.col("toxic") >= least) & (F.col("toxic") >= MIN_PRECISION * (F.col("toxic") + F.col("clean"))))
    lexicon = Lexicon()
    for r in good.collect():
        weight = (r["toxic"] + 0.5) / (r["toxic"] + r["clean"] + 1)
        if r["mark"][0] == "=":
            lexicon.words[r["mark"][1:]] = weight
        else:
            lexicon.stems[r["mark"]] = weight
    lexicon.contexts = _fit_contexts(rows, lexicon)
    return lexicon


def toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs`.

    Null and empty texts get the base score; a null doc_id isn't held out. Repeated rows are scored alike; other columns are
    left out, whatever their names. Texts are scored whole, in work that follows their length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(shared.value)
        for f in slices(frames, 2000):
            s = np.array([score(t, memo) for t in f["text"]], float)
            yield pd.DataFrame({"doc_id": nullable_ints(f["doc_id"]), "held_out": f["held_out"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    doc_id = F.col("doc_id").cast("bigint")
    own = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return own.mapInPandas(run, "doc_id bigint, held_out boolean, score double, predicted int")


def op6_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity(docs, learn(docs, labels))
