"""Text normalizers, hashing, tokens and snippets as column expressions.

The normalizers differ on purpose: labels, canonical phrases and preset phrases each have their own rule.
Compatibility forms and case folding of non-ASCII text have no built-in; `normalize_dictionary` maps the distinct
values once in an Arrow function and joins them back.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed 32-bit FNV-1a offset and prime.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
#: Fixed token pattern of the text search.
TOKEN = "[a-z0-9][a-z0-9_'’-]{2,}"


def collapse(x: Column) -> Column:
    """White space runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def norm_label(x: Column) -> Column:
    return F.lower(collapse(x))


def canonical(x: Column) -> Column:
    """Lower-cased, everything but letters and digits to one blank."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def preset_norm(x: Column) -> Column:
    """Canonical form with words split where a capital follows a small letter."""
    return canonical(F.regexp_replace(x, "([a-z])([A-Z])", "$1 $2"))


def phrase_in(text: Column, phrase: Column | str) -> Column:
    """Whether a normalized text holds a whole normalized phrase."""
    phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))


def fnv1a32(x: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, as a bigint."""
    raw = F.encode(x, "UTF-8")
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("bigint")
    step = lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(F.octet_length(x) == 0, F.lit(FNV_OFFSET).cast("bigint")).otherwise(F.aggregate(F.sequence(F.lit(1), F.octet_length(x)), F.lit(FNV_OFFSET).cast("bigint"), step))


def tokens(x: Column) -> Column:
    """Distinct search tokens of the lower-cased text, curly apostrophes straightened."""
    found = F.regexp_extract_all(F.lower(x), F.lit(TOKEN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.replace(t, F.lit("’"), F.lit("'"))))


def snippet(x: Column, needle: Column | str, width: int = 220) -> Column:
    """A window of the text with the first hit at about a third of it; its beginning if there is none."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    at = F.instr(F.lower(x), needle)
    start = F.greatest(F.lit(1), at - int(width * 0.35))
    return F.when(at > 0, F.substring(x, start, F.lit(width))).otherwise(F.substring(x, F.lit(1), F.lit(width)))


def truncate(x: Column, size: int) -> Column:
    return F.when(F.length(x) > size, F.concat(F.left(x, F.lit(size - 1)), F.lit("…"))).otherwise(x)


def id_prefix(x: Column) -> Column:
    """First two hex digits of an id without dashes, `__` for other ids."""
    two = F.substring(F.replace(x, F.lit("-"), F.lit("")), 1, 2)
    return F.when(two.rlike("^[0-9a-f]{2}$"), two).otherwise(F.lit("__"))


def json_digest(x: Column) -> Column:
    """SHA-256 of a JSON text with its keys in order and no blanks; null for what isn't JSON."""
    return F.sha2(F.to_json(F.try_parse_json(x)), 256)


def fold(value: str | None, form: str, strip_marks: bool = False) -> str | None:
    """Compatibility form, case fold and, if asked for, without combining marks."""
    if value is None:
        return None
    text = unicodedata.normalize(form, value).casefold()
    return "".join(c for c in text if not unicodedata.combining(c)) if strip_marks else text


def normalize_dictionary(df: DataFrame, column: str, out: str, form: str = "NFKC", strip_marks: bool = False) -> DataFrame:
    """`df` with `out`, the folded form of `column`; each distinct value is folded once."""

    @F.pandas_udf("string")
    def folded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: fold(v, form, strip_marks))

    words = df.select(F.col(column).alias("__value")).where("__value is not null").distinct().withColumn(out, folded("__value"))
    return df.join(words, F.col(column) == F.col("__value"), "left").drop("__value")
