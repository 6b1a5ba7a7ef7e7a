"""Which side of a title's pair plays which role, read from a small grammar over classes of words.

Every word becomes one letter by the table below, so a title is a short string of letters and the grammar is four patterns
over it, whatever words a class holds. A side with two different roles has none.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlake.functions.text import fold

#: Fixed words of each class: roles, sides, and what may stand between them.
DOMINANT = ("dom", "dominant", "domme")
SUBMISSIVE = ("sub", "submissive")
BOT_SIDE = ("bot", "bots", "character", "characters", "ai", "ais")
USER_SIDE = ("user", "users", "player", "players", "you")
LINK = ("is", "are", "as")
ARTICLE = ("the", "a", "an")
ADDRESS = ("you're",)
OWNER = ("your",)
DEGREE = ("very", "super")
RELATION = (
    "girlfriend", "boyfriend", "wife", "husband", "partner", "lover", "roommate", "boss", "teacher", "friend", "crush", "neighbor", "neighbour", "master", "mistress",
    "owner", "alpha", "wolf", "werewolf", "vampire", "dragon", "maid", "assistant", "bully", "roomie", "queen", "king", "demon", "angel", "goddess", "god",
)
#: Fixed characters that part words as blanks do.
PARTING = "!|×:;—–-_/"

_CLASSES = {"D": DOMINANT, "S": SUBMISSIVE, "b": BOT_SIDE, "u": USER_SIDE, "l": LINK, "a": ARTICLE, "c": ADDRESS, "o": OWNER, "v": DEGREE, "r": RELATION}
#: Sides and the patterns that give them a role: it stands before the side, or behind it with a link; `you're` or `your` tell the side as well.
_GRAMMAR = {"bot": ("([DS])b", "bla?([DS])", "ov?([DS])r"), "user": ("([DS])u", "ula?([DS])", "ca?([DS])")}


@F.pandas_udf(T.StringType())
def compatible(values: pd.Series) -> pd.Series:
    """Compatibility forms, as full-width letters are written in titles."""
    return values.map(lambda v: fold(v, "NFKC"))


def word_classes(title: Column) -> Column:
    """A letter per word: its class, else a dot. Other punctuation marks are words of their own, as they part what they stand between."""
    plain = F.when(title.rlike("^[\\x00-\\x7F]*$"), F.lower(title)).otherwise(compatible(title))
    named = F.regexp_replace(plain, r"\{\{\s*user\s*\}\}", " user ")
    words = F.regexp_extract_all(F.translate(named, PARTING, " " * len(PARTING)), F.lit(r"[\w']+|[^\w'\s]"), F.lit(0))
    letters = F.create_map(*(F.lit(x) for letter, own in _CLASSES.items() for w in own for x in (w, letter)))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(letters, w), F.lit("."))), "")


def title_roles(title: Column) -> dict[str, Column]:
    """bot, user: dominant or submissive where the title's wording gives the side just one of them, else null."""
    letters = word_classes(title)
    out = {}
    for side, patterns in _GRAMMAR.items():
        found = F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(letters, F.lit(p), F.lit(1)) for p in patterns))))
        role = F.get(found, 0)
        out[side] = F.when(F.size(found) == 1, F.when(role == "D", "dominant").otherwise("submissive"))
    return out
