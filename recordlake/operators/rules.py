"""Rule-based signals: whole-phrase rules over normalized titles, review decisions, mentions and preset decisions.

Rules are data: tables with one row per phrase, whose number is checked before they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions.text import canonical, phrase_in

MAX_BROADCAST_RULES = 20_000


def small(rules: DataFrame) -> DataFrame:
    """Rules to broadcast, if they are few; a longer table is left to Spark."""
    return F.broadcast(rules) if rules.limit(MAX_BROADCAST_RULES + 1).count() <= MAX_BROADCAST_RULES else rules


def mentions(titles: DataFrame, phrases: DataFrame) -> DataFrame:
    """id, phrase_id for each whole phrase (phrase_id, phrase) in a title (id, title).

    Phrases are joined by their first word, so a title only meets phrases that can occur in it.
    """
    words = titles.withColumn("norm", canonical(F.col("title"))).select("id", "norm", F.explode(F.array_distinct(F.split("norm", " "))).alias("word"))
    own = phrases.withColumn("p", canonical(F.col("phrase"))).where("p <> ''").select("phrase_id", "p", F.element_at(F.split("p", " "), 1).alias("word"))
    return words.join(small(own), "word").where(phrase_in(F.col("norm"), F.col("p"))).select("id", "phrase_id").distinct()


def rule_signals(titles: DataFrame, rules: DataFrame) -> DataFrame:
    """id, rule_id of rules whose groups all have a phrase in the title and whose denials have none.

    `rules`: rule_id, grp (null for a denial), phrase.
    """
    numbered = rules.withColumn("phrase_id", F.concat_ws("/", "rule_id", F.coalesce(F.col("grp").cast("string"), F.lit("-")), "phrase"))
    hits = mentions(titles, numbered).join(small(numbered.select("phrase_id", "rule_id", "grp")), "phrase_id")
    found = hits.groupBy("id", "rule_id").agg(F.count_distinct("grp").alias("groups"), F.count_if(F.col("grp").isNull()).alias("denied"))
    needed = rules.where("grp is not null").groupBy("rule_id").agg(F.count_distinct("grp").alias("needed"))
    return found.join(small(needed), "rule_id").where("denied = 0 and groups = needed").select("id", "rule_id")


def fingerprint(*values: Column) -> Column:
    """First 24 hex digits of the SHA-256 of the values, by which decisions are bound to what was reviewed."""
    return F.left(F.sha2(F.to_json(F.array(*(F.coalesce(v, F.lit("")) for v in values))), 256), F.lit(24))


def reviewed(signals: DataFrame, decisions: DataFrame) -> DataFrame:
    """id, rule_id, kind: a decision with the same fingerprint confirms or removes a candidate; the last one counts.

    `signals`: id, rule_id, fingerprint; `decisions`: id, rule_id, fingerprint, decision, pos.
    """
    last = decisions.groupBy("id", "rule_id").agg(F.max_by(F.struct("fingerprint", "decision"), "pos").alias("d")).select("id", "rule_id", F.col("d.fingerprint").alias("seen"), "d.decision")
    both = signals.join(last, ["id", "rule_id"], "left")
    valid = F.coalesce(F.col("seen") == F.col("fingerprint"), F.lit(False))
    kind = F.when(valid & (F.col("decision") == "approve"), "reviewed").when(valid & (F.col("decision") == "reject"), None).otherwise("rule-candidate")
    return both.select("id", "rule_id", kind.alias("kind")).where("kind is not null")


def suffix_candidates(titles: DataFrame, after: str, min_hits: int, stop_words: tuple[str, ...], limit: int) -> DataFrame:
    """Text of 1 to 4 words and 5 to 48 letters behind `after`, by number of titles."""
    tail = F.regexp_extract(F.col("title"), f"(?i){after}[ :,-]+([a-z]+(?: [a-z]+){{0,3}})", 1)
    own = titles.select("id", F.lower(tail).alias("suffix")).where(F.length("suffix").between(5, 48) & ~F.col("suffix").isin(*stop_words))
    return own.distinct().groupBy("suffix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_hits).orderBy(F.desc("n"), "suffix").limit(limit)
