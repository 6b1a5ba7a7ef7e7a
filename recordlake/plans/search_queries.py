"""Queries of two-phase search and of lexicons with context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.functions.text import FNV_PRIME
from recordlake.operators import lexicon, search

from .registry import Tables, query

QUERY, PHRASE = "License released", "license"

# A record is a document with its current text; turns of the conversation of its number are former ones.
VALUES = """vals AS (SELECT doc_id AS id, text AS v FROM documents UNION ALL SELECT conv_id, c.text FROM conversations c JOIN documents ON doc_id = conv_id),
toks AS (SELECT DISTINCT id, replace(t, '’', '''') AS t FROM (SELECT id, unnest(regexp_extract_all(lower(coalesce(v, '')), '[a-z0-9][a-z0-9_''’-]{2,}')) AS t FROM vals)),"""
_STATES = ", ".join(str(search._low_byte(f"{s}:")) for s in range(search.SEEDS))
SIGNED = (
    "WITH "
    + VALUES
    + f"""
bits AS (SELECT id, list_reduce(list_prepend(s, list_transform(string_split(t, ''), lambda c: ascii(c))), lambda x, y: (xor(x, y) * {FNV_PRIME & 0xFF}) & 255) AS p FROM toks, (SELECT unnest([{_STATES}]) AS s)),
signed AS (SELECT d.doc_id AS id, d.n_chars AS "at", """
    + ", ".join(f"coalesce(bit_or(CASE WHEN p >> 6 = {w} THEN CASE WHEN p & 63 = 63 THEN -9223372036854775808 ELSE 1::BIGINT << (p & 63) END ELSE 0 END), 0)::BIGINT AS w{w}" for w in range(search.WORDS))
    + " FROM documents d LEFT JOIN bits b ON b.id = d.doc_id GROUP BY 1, 2)"
)
_PASSES = " AND ".join(f"w{i} & ({m}) = {m}" for i, m in enumerate(search.masks(QUERY)))
_PASSES_PHRASE = " AND ".join(f"w{i} & ({m}) = {m}" for i, m in enumerate(search.masks(PHRASE)))
_HAS = " AND ".join(f"bool_or(contains(lower(v), '{t}'))" for t in search.query_tokens(QUERY))


def _values(t: Tables) -> DataFrame:
    now = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("value"))
    past = t.conversations.select(F.col("conv_id").alias("id"), F.col("text").alias("value")).join(t.documents.select(F.col("doc_id").alias("id")), "id", "left_semi")
    return now.unionByName(past)


def _signed(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("at")).join(search.signatures(_values(t)), "id")


@query(SIGNED + " SELECT id, w0, w1, w2, w3 FROM signed")
def text_signatures(t: Tables) -> DataFrame:
    """The signatures bit for bit; the SQL computes each position from the characters."""
    return search.signatures(_values(t))


@query(SIGNED + f', cand AS (SELECT * FROM signed WHERE {_PASSES}) SELECT c.id, "at" FROM cand c JOIN vals USING (id) GROUP BY c.id, "at" HAVING {_HAS}')
def signature_search(t: Tables) -> DataFrame:
    return search.search(_signed(t), _values(t), QUERY)


@query(SIGNED + f""", cand AS (SELECT * FROM signed WHERE {_PASSES_PHRASE}) SELECT c.id, "at" FROM cand c JOIN vals USING (id) GROUP BY c.id, "at" HAVING bool_or(contains(lower(v), '{PHRASE}')) ORDER BY "at" DESC, c.id LIMIT 25""")
def signature_page(t: Tables) -> DataFrame:
    """The newest 25 records with a phrase: a page is the feature."""
    return search.search(_signed(t), _values(t), PHRASE, exact=True).orderBy(F.desc("at"), "id").limit(25)


@query(SIGNED + f" SELECT count(*) AS records, count(*) FILTER ({_PASSES}) AS candidates, 1 - count(*) FILTER ({_PASSES}) / count(*) AS skipped FROM signed")
def signature_skipped(t: Tables) -> DataFrame:
    return search.skipped(_signed(t), QUERY)


# Rules in order; a hit of `terms` is taken back behind a denial, one of `notice` before a reservation.
REVIEW = [("terms", "license"), ("terms", "public license"), ("terms", "warranty"), ("notice", "copyright"), ("notice", "rights"), ("harm", "worthless"), ("harm", "idiot")]
DENIED = {"terms": ("(?:without|no|under|the)[^a-z]*", None), "notice": (None, r"[^a-z]*(?:\(c\)|reserved|holders?)"), "harm": (r"not\s+(?:\w+\s+){0,2}", None)}
FIELDS = ["source", "text"]
_RANKS = list(dict.fromkeys(r for r, _ in REVIEW))


def _denials(h: str) -> str:
    out = []
    for rule, (left, right) in DENIED.items():
        if left:
            out.append(f"({h}.rule = '{rule}' AND regexp_matches(before, '(?:{left})$'))")
        if right:
            out.append(f"({h}.rule = '{rule}' AND regexp_matches(behind, '^(?:{right})'))")
    return " OR ".join(out)


# Places of a phrase: the parts between its occurrences, and their lengths summed.
HITS = f"""rules(rank, rule, phrase) AS (VALUES {", ".join(f"({_RANKS.index(r)}, '{r}', '{p}')" for r, p in REVIEW)}),
fields AS (SELECT doc_id AS id, 0 AS nth, 'source' AS field, coalesce(source, '') AS t FROM documents UNION ALL SELECT doc_id, 1, 'text', coalesce(text, '') FROM documents),
parts AS (SELECT id, nth, field, t, rank, rule, phrase, string_split(lower(t), phrase) AS s FROM fields, rules WHERE contains(lower(t), phrase)),
places AS (SELECT id, nth, field, t, rank, rule, phrase, unnest(range(1, len(s))) AS i, list_transform(s, lambda x: length(x)) AS n FROM parts),
at_ AS (SELECT *, CAST(list_sum(n[1:i]) + (i - 1) * length(phrase) AS BIGINT) AS start FROM places),
around AS (SELECT *, lower(substr(t, greatest(0, start - {lexicon.BEFORE}) + 1, start - greatest(0, start - {lexicon.BEFORE}))) AS before, lower(substr(t, start + length(phrase) + 1, {lexicon.BEHIND})) AS behind FROM at_),
hits AS (SELECT * FROM around WHERE NOT regexp_matches(right(before, 1), '[\\w\\p{{L}}\\p{{N}}]') AND NOT regexp_matches(left(behind, 1), '[\\w\\p{{L}}\\p{{N}}]'))"""


@query("WITH " + HITS + f"""
SELECT id, rule, field, matched FROM (SELECT id, rule, field, substr(t, start + 1, length(phrase)) AS matched, row_number() OVER (PARTITION BY id, rule ORDER BY nth, start, length(phrase)) AS k FROM hits h WHERE NOT ({_denials("h")})) WHERE k = 1""")
def review_signals(t: Tables) -> DataFrame:
    """The first hit of each rule that nothing around it takes back, with the field it stands in."""
    records = t.documents.select(F.col("doc_id").alias("id"), "source", "text")
    return lexicon.review_signals(records, FIELDS, REVIEW, DENIED)


@query("WITH " + HITS + """, has AS (SELECT id, bool_or(rule = 'terms') AS terms, bool_or(rule = 'notice') AS notice, bool_or(rule = 'harm') AS harm FROM hits WHERE field = 'text' GROUP BY id)
SELECT doc_id AS id, coalesce(terms, false) AS terms, coalesce(notice, false) AS notice, coalesce(harm, false) AS harm, coalesce(harm AND (terms OR notice), false) AS restricted FROM documents LEFT JOIN has ON id = doc_id""")
def context_flags(t: Tables) -> DataFrame:
    own = lexicon.context_flags(F.coalesce("text", F.lit("")), REVIEW, {"restricted": ("harm", ("terms", "notice"))})
    return t.documents.select(F.col("doc_id").alias("id"), own.alias("f")).select("id", "f.*")


TRAITS = [("warm", "with"), ("warm", "und"), ("bold", "not"), ("bold", "que"), ("calm", "which"), ("calm", "pour"), ("keen", "her"), ("keen", "las"), ("dry", "that"), ("dry", "die"), ("odd", "license"), ("odd", "of")]
PLACES = [("shop", "los"), ("shop", "des"), ("park", "you"), ("park", "le"), ("home", "the"), ("home", "der")]
_TRAIT_NAMES, _PLACE_NAMES = (list(dict.fromkeys(r for r, _ in rules)) for rules in (TRAITS, PLACES))


def _has(text: str, phrase: str) -> str:
    return f"regexp_matches(lower({text}), '(^|[^\\w\\p{{L}}\\p{{N}}]){phrase}($|[^\\w\\p{{L}}\\p{{N}}])')"


_TRAIT_SQL = ", ".join(f"CASE WHEN {' OR '.join(_has('t', p) for r, p in TRAITS if r == n)} THEN '{n}' END" for n in _TRAIT_NAMES)
_PLACE_SQL = " ".join(f"WHEN {' OR '.join(_has('left(t, 200)', p) for r, p in PLACES if r == n)} THEN '{n}'" for n in _PLACE_NAMES)


@query(f"SELECT id, array_to_string(list_filter([{_TRAIT_SQL}], lambda x: x IS NOT NULL)[1:5], ',') AS traits, CASE {_PLACE_SQL} END AS place FROM (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents)")
def recovery_clues(t: Tables) -> DataFrame:
    """Five traits at most, in the rules' order; the place is sought in the opening, which is the first 200 characters."""
    text = F.coalesce("text", F.lit(""))
    own = lexicon.clues(text, F.left(text, F.lit(200)), TRAITS, PLACES)
    return t.documents.select(F.col("doc_id").alias("id"), own.alias("c")).select("id", F.array_join("c.traits", ",").alias("traits"), "c.place")
