"""Row-level cleaning: urls, aliases, categories, languages, lists, roles, times and guarded numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordlake.functions.values import any_time, first_meaningful

#: Fixed names of languages with their codes.
LANGUAGES = {
    "english": "en", "eng": "en", "spanish": "es", "español": "es", "french": "fr", "français": "fr", "german": "de", "deutsch": "de",
    "italian": "it", "portuguese": "pt", "português": "pt", "japanese": "ja", "korean": "ko", "chinese": "zh", "russian": "ru", "polish": "pl",
    "dutch": "nl", "turkish": "tr", "arabic": "ar", "thai": "th", "vietnamese": "vi", "indonesian": "id",
}
#: Fixed scripts that English text doesn't use.
FOREIGN_SCRIPTS = ("Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Devanagari", "Thai", "Georgian", "Hiragana", "Katakana", "Han", "Hangul")
#: The tag by which an owner says that a text is foreign.
FOREIGN_TAG = "non-english"
#: Fixed schemes of urls that an image never has.
REFUSED_SCHEMES = ("javascript", "data", "file", "blob")
#: Days of the named periods.
PERIODS = {"1d": 1, "7d": 7, "30d": 30, "90d": 90, "1y": 365}


def asset_url(x: Column, base: str, folder: str, query: str = "") -> Column:
    """Protocol-relative urls get https, paths in `folder` the base and query, others stay; blanks are null."""
    clean = F.nullif(F.trim(x), F.lit(""))
    inside = F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(clean, F.lit("/")), F.lit(query))
    return F.when(clean.startswith("//"), F.concat(F.lit("https:"), clean)).when(F.ltrim(clean, F.lit("/")).startswith(f"{folder}/"), inside).otherwise(clean)


def aliased(names: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """Canonical fields, each the first meaningful of its aliases."""
    return {name: first_meaningful(*(F.col(c) for c in columns)) for name, columns in names.items()}


def category_of(leaf: Column, categories: dict[str, tuple[str, ...]], other: str = "other") -> Column:
    out = F.lit(other)
    for name, leaves in reversed(categories.items()):
        out = F.when(leaf.isin(*leaves), name).otherwise(out)
    return out


def language_code(x: Column) -> Column:
    """The code of a language name, or of a code without its region; blanks are empty."""
    clean = F.replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), F.lit("_"), F.lit("-"))
    known = F.create_map(*(F.lit(v) for pair in LANGUAGES.items() for v in pair))
    return F.coalesce(F.try_element_at(known, clean), F.substring_index(clean, "-", 1))


def may_need_translation(text: Column, tags: Column | None = None) -> Column:
    """Whether a text of two characters or more is tagged as foreign, or has a letter of a foreign script or an accented Latin one."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    scripts = "".join(f"\\p{{Is{name}}}" for name in FOREIGN_SCRIPTS)
    foreign = clean.rlike(f"[{scripts}]|[\\p{{IsLatin}}&&[\\u00C0-\\u017E]]")
    if tags is not None:
        foreign = foreign | F.coalesce(F.exists(tags, lambda t: F.lower(t) == FOREIGN_TAG), F.lit(False))
    return (F.length(clean) >= 2) & foreign


def comma_list(x: Column) -> Column:
    """Items of a comma-joined list: trimmed, not blank, each once without regard to case, in order."""
    items = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")
    low = F.transform(items, lambda v: F.lower(v))
    return F.filter(items, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)


def first_time(now: Column, *columns: Column) -> Column:
    """Milliseconds of the first column that is a valid time."""
    return F.coalesce(*(any_time(c, now) for c in columns))


def within_period(at: Column, now: Column, period: str) -> Column:
    return at >= now - F.expr(f"INTERVAL {PERIODS[period]} DAYS")


def age_text(at: Column, now: Column) -> Column:
    """Whole hours, one at least, below a day; whole days below 60; else months of 30.44 days with one decimal. The future is no age."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(at)) / 86_400_000_000)
    hours = F.greatest(F.lit(1), F.floor(days * 24))
    return (
        F.when(at.isNull(), "Unknown")
        .when(days < 1, F.concat(hours.cast("string"), F.lit(" hours")))
        .when(days < 60, F.concat(F.floor(days).cast("string"), F.lit(" days")))
        .otherwise(F.concat(F.format_string("%.1f", days / 30.44), F.lit(" months")))
    )


def image_reference(*candidates: Column) -> Column:
    """The first text of up to 2048 characters that isn't of a refused scheme; empty if there is none."""
    usable = [F.when((F.trim(c) != "") & (F.length(F.trim(c)) <= 2048) & ~F.lower(F.trim(c)).rlike(f"^({'|'.join(REFUSED_SCHEMES)}):"), F.trim(c)) for c in candidates]
    return F.coalesce(*usable, F.lit(""))


def guarded_int(x: Column, low: int, high: int) -> Column:
    """A whole number within bounds; null for what is none."""
    n = x.try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n), F.greatest(F.lit(low), F.least(F.lit(high), F.floor(n)))).cast("bigint")


def bounded_list(x: Column, items: int, size: int) -> Column:
    """The first items of a list, each cut to a size."""
    return F.transform(F.slice(F.coalesce(x, F.array().cast("array<string>")), 1, items), lambda v: F.left(v, F.lit(size)))


def only_keys(x: Column, allowed: tuple[str, ...]) -> Column:
    """Whether a map has no key but the allowed ones."""
    return F.size(F.array_except(F.map_keys(x), F.array(*(F.lit(a) for a in allowed)))) == 0


def meaningful_deep(x: Column) -> Column:
    """Whether a JSON text holds anything but nulls, blank strings and empty lists and objects, at any depth."""
    bare = F.regexp_replace(F.to_json(F.try_parse_json(x)), r'"(?:[^"\\]|\\.)*"\s*:', "")
    return F.coalesce(F.regexp_replace(F.regexp_replace(bare, "\"(?:[ \\t]|\\\\[nrt])*\"|null", ""), r"[\[\]{},\s]", "") != "", F.lit(False))


def public_text(sections: dict[str, Column], size: int) -> Column:
    """Sections that hold something, with their titles, in order, cut to a size."""
    parts = [F.when(F.trim(c) != "", F.concat(F.lit(f"{name}: "), F.trim(c))) for name, c in sections.items()]
    return F.left(F.concat_ws("\n", *parts), F.lit(size))


def latest_flag(flags: list[Column], older: Column) -> Column:
    """shared or private by the first flag that is given, else what was known before, else unknown."""
    flag = F.coalesce(*flags)
    return F.when(flag.isNotNull(), F.when(flag, "shared").otherwise("private")).otherwise(F.coalesce(older, F.lit("unknown")))


def latest_slot(now: Column, weekdays: tuple[int, ...], hour: int, minute: int) -> Column:
    """The newest time of the given weekdays (0: Monday), hour and minute that isn't after now."""
    days = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda d: F.date_sub(F.to_date(now), d))
    slots = F.transform(F.filter(days, lambda d: F.weekday(d).isin(*weekdays)), lambda d: d.cast("timestamp") + F.expr(f"INTERVAL '{hour}:{minute:02d}' HOUR TO MINUTE"))
    return F.array_max(F.filter(slots, lambda s: s <= now))


def payload_state(x: Column, volatile: tuple[str, ...]) -> Column:
    """empty for nothing, an empty list or object; volatile-only for an object of volatile keys alone; else content; invalid for no JSON."""
    v = F.try_parse_json(x)
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    bare = F.coalesce(F.trim(x), F.lit("")).isin("", "null", "[]", "{}")
    return F.when(bare, "empty").when(v.isNull(), "invalid").when(F.size(keys) == 0, "empty").when(F.size(F.array_except(keys, F.array(*(F.lit(k) for k in volatile)))) == 0, "volatile-only").otherwise("content")
