"""Preset cards: whether a title belongs to a preset of names, and whether a reader who hides that preset hides it.

The catalogue is rows: kind (theme, franchise, group, character, variant), owner (a name of the theme, franchise, group or character),
franchise, gender, phrase, strength. A contextual character phrase only counts beside a strong phrase of its franchise; groups and
themes only have strong ones. Variants are wordings that say that a character isn't played as it is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions.text import preset_norm
from recordlake.operators.rules import mentions, small

CATALOGUE = "kind string, owner string, franchise string, gender string, phrase string, strength string"
#: Modes of hiding, with the gender that each keeps.
KEPT_GENDERS = {"all": None, "keep-female": "female", "keep-male": "male", "custom": None}
GENDERS = ("female", "male", "nonbinary")


def normalized(title: Column) -> Column:
    """Words split where a capital follows a small letter, marks of Latin letters taken off, lower-cased, all else blanks."""
    plain = F.translate(title, "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy")
    return preset_norm(plain)


def matches(titles: DataFrame, catalogue: DataFrame, franchise: str) -> DataFrame:
    """id, strong, group, variant, theme and the characters (owner, gender) of each title (id, title), for one franchise or theme."""
    own = catalogue.where((F.col("franchise") == franchise) | (F.col("kind") == "variant") | ((F.col("kind") == "theme") & (F.col("owner") == franchise)))
    numbered = own.select("kind", "owner", "gender", "strength", normalized(F.col("phrase")).alias("phrase")).where("phrase <> ''").distinct()
    numbered = numbered.withColumn("phrase_id", F.concat_ws("/", "kind", "owner", F.coalesce("strength", F.lit("")), "phrase"))
    hits = mentions(titles.select("id", normalized(F.col("title")).alias("title")), numbered).join(small(numbered.drop("phrase")), "phrase_id")
    kind, strong = F.col("kind"), F.coalesce(F.col("strength"), F.lit("strong")) == "strong"
    character = F.when(kind == "character", F.struct("owner", "gender", strong.alias("strong")))
    found = hits.groupBy("id").agg(
        F.bool_or((kind == "theme") & strong).alias("theme"),
        F.bool_or((kind == "franchise") & strong).alias("strong"),
        F.bool_or((kind == "group") & strong).alias("group"),
        F.bool_or(kind == "variant").alias("variant"),
        F.collect_set(character).alias("named"),  # as many as the catalogue has at most
    )
    told = F.array_distinct(F.transform(F.filter("named", lambda c: c["strong"] | F.col("strong")), lambda c: F.struct(c["owner"].alias("owner"), c["gender"].alias("gender"))))
    return found.select("id", "theme", "strong", "group", "variant", F.array_sort(told).alias("characters"))


def decide(matched: DataFrame, mode: str = "all", keep_characters: tuple[str, ...] = (), keep_genders: tuple[str, ...] = ()) -> DataFrame:
    """id, matched, hide, reason, characters (names), gender of each title that a preset's phrases were found in.

    In order: a theme hides; without a strong franchise, group or character nothing is matched; a kept character stays; `all` hides;
    a variant wording stays, and so does anything but one character whose gender is known; what is left is hidden.
    """
    if mode not in KEPT_GENDERS:
        raise ValueError(f"unknown mode: {mode}")
    genders = [g for g in (KEPT_GENDERS[mode], *(keep_genders if mode == "custom" else ())) if g]
    names = F.transform("characters", lambda c: c["owner"])
    kept = F.exists("characters", lambda c: c["owner"].isin(*keep_characters) | c["gender"].isin(*genders)) if keep_characters or genders else F.lit(False)
    eligible = F.col("strong") | F.col("group") | (F.size("characters") > 0)
    single = (F.size("characters") == 1) & F.coalesce(F.get("characters", 0)["gender"].isin(*GENDERS), F.lit(False))
    reason = (
        F.when(F.col("theme"), "theme")
        .when(~eligible, "no match")
        .when(kept, "kept")
        .when(F.lit(mode == "all"), "any name")
        .when(F.col("variant"), "variant")
        .when(~single, "not one known character")
        .otherwise("one character")
    )
    gender = F.when(~F.col("variant") & (F.size("characters") == 1) & ~F.col("theme"), F.get("characters", 0)["gender"])
    own = matched.withColumn("reason", reason)
    return own.select("id", (F.col("reason") != "no match").alias("matched"), F.col("reason").isin("theme", "any name", "one character").alias("hide"), "reason", F.array_join(names, ",").alias("characters"), F.coalesce(gender, F.lit("unknown")).alias("gender"))
