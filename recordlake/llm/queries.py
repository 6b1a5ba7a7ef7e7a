"""Queries of the training-data operators, each over its whole table, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chat_tools, collocations, decontamination, filter_audit, licenses, mixing, packing, quality, simhash, suffix_dedup, tokens, toxicity, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


QUERIES: dict[str, Query] = {
    "op1_url_filter": _over("pages", url_filter.op1_url_filter),
    "op2_token_counts": _over("documents", tokens.op2_token_counts),
    "op3_suffix_dedup": _over("documents", suffix_dedup.op3_suffix_dedup),
    "op4_simhash": _over("documents", simhash.op4_simhash),
    "op5_license_scan": _over("documents", licenses.op5_license_scan),
    "op6_toxicity": lambda spark, sf_dir: toxicity.op6_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op7_quality": _over("documents", quality.op7_quality),
    "op8_packing": _over("documents", packing.op8_packing),
    "op9_tool_calls": _over("conversations", chat_tools.op9_tool_calls),
    "op10_decontamination": lambda spark, sf_dir: decontamination.op10_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op11_mixing": _over("documents", mixing.op11_mixing),
    "op12_collocations": _over("documents", collocations.op12_collocations),
    "op13_filter_audit": lambda spark, sf_dir: filter_audit.op13_filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in url_filter.RULES)

URL_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS r FROM u),
rules(rule_host, rule_path, action) AS (VALUES {_RULES}),
best AS (SELECT r, arg_max((rule_host || rule_path, action), length(rule_host || rule_path)) AS b FROM h JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r)
SELECT page_id, host, path, b[1] AS rule, coalesce(b[2], 'allow') AS verdict FROM h LEFT JOIN best USING (r)"""

_SPACE = r"[^\x20\x09-\x0D]"
_Q = quality.QualityRules()


def _count_sql(x: str, needles: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"(strlen({x}) - strlen(replace({x}, '{n}', ''))) // {len(n.encode())}" for n in needles) + ")"


_BAD = f"""({_count_sql('x', quality.SEPARATORS)} * 100 > len(lw) * {_Q.max_separator_pct}
  OR {_count_sql('x', quality.SYMBOLS)} * 100 > strlen(x) * {_Q.max_symbol_pct}
  OR (strlen(x) >= {_Q.min_shout_bytes} AND upper(x) = x AND lower(x) <> x)
  OR {_count_sql('x', ('!!', '??', ',,', ';;'))} > {_Q.max_double_marks}
  OR (len(lw) >= {_Q.min_distinct_of_words} AND len(list_distinct(lw)) * 100 < len(lw) * {_Q.min_distinct_pct})
  OR (len(lw) > {_Q.max_unpunctuated_words} AND NOT regexp_matches(x, '[.,;:!?。、]'))
  OR (len(lw) <= {_Q.boilerplate_words} AND regexp_matches(lower(x), '{'|'.join(quality.BOILERPLATE)}')))"""

QUALITY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE}+') AS w FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, range(3) x(o) GROUP BY r),
l AS (SELECT r, x, regexp_extract_all(x, '{_SPACE}+') AS lw FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{_SPACE}')),
lines AS (SELECT r, count(*) - count(DISTINCT x) AS dup, sum(strlen(x)) AS total, coalesce(sum(strlen(x)) FILTER ({_BAD}), 0) AS lost FROM l GROUP BY r),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({_count_sql('t', quality.SYMBOLS)} AS BIGINT) AS n_symbols,
  CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost, coalesce(total, 0) AS total
  FROM d LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)),
f AS (SELECT *, n_words < {_Q.min_words} OR 100 * n_repeat_words > {_Q.max_repeat_pct} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost * 100 <= total * {_Q.max_lost_pct} AS kept FROM f"""

_NO_CALL = "CAST(NULL AS VARCHAR) AS name, CAST(NULL AS BIGINT) AS level, '' AS problems, CAST(NULL AS BIGINT) AS result_turn, CAST(0 AS BIGINT) AS n_results"
TOOL_SQL = f"""
WITH calls AS (SELECT conv_id, turn, conv_id || ':' || turn AS id, text FROM conversations WHERE role = 'user'),
answers AS (SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS id, text FROM conversations WHERE role = 'assistant')
SELECT 'call' AS kind, c.conv_id, c.id AS call_id, c.turn, 'reply' AS name, CAST(0 AS BIGINT) AS level, CASE WHEN a.turn IS NULL THEN 'no result' ELSE '' END AS problems, a.turn AS result_turn,
  CAST(CASE WHEN a.turn IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_results,
  '{{"arguments":{{"prompt":' || to_json(c.text)::VARCHAR || '}},"id":"' || c.id || '","name":"reply"' || CASE WHEN a.text IS NULL THEN '' ELSE ',"result":' || to_json(a.text)::VARCHAR END || '}}' AS json
FROM calls c LEFT JOIN answers a USING (conv_id, id)
UNION ALL
SELECT CASE WHEN c.id IS NULL THEN 'message' ELSE 'result' END AS kind, a.conv_id, c.id AS call_id, a.turn, {_NO_CALL},
  '{{"content":' || to_json(a.text)::VARCHAR || CASE WHEN c.id IS NULL THEN ',"role":"assistant"}}' ELSE ',"tool_call_id":"' || c.id || '"}}' END AS json
FROM answers a LEFT JOIN calls c USING (conv_id, id)
UNION ALL
SELECT 'message' AS kind, conv_id, CAST(NULL AS VARCHAR) AS call_id, turn, {_NO_CALL}, '{{"content":' || to_json(text)::VARCHAR || ',"role":"' || role || '"}}' AS json
FROM conversations WHERE role NOT IN ('user', 'assistant')"""

CHAIN_TOOL = ("ship", ["where", "amount"], {"where": "object", "amount": "integer", "flag": "string"})


def tool_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as conversations: each order a JSON call that needs the order before; some lack an argument, give it a wrong type or have no result."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = orders.withColumns({"turn": F.row_number().over(own).cast("bigint"), "before": F.lag("o_orderkey").over(own)})
    amount = F.floor("o_totalprice").cast("string")
    status = F.col("o_orderstatus")
    given = F.when(status == "F", "").when(status == "P", F.concat(F.lit('"amount":"'), amount, F.lit('",'))).otherwise(F.concat(F.lit('"amount":'), amount, F.lit(",")))
    call = F.concat(
        F.lit('{"name":"ship","arguments":{'),
        given,
        F.concat(F.lit('"where":{"zone":1.50,"customer":'), F.col("o_custkey"), F.lit('}},"id":"o'), F.col("o_orderkey")),
        F.coalesce(F.concat(F.lit('","depends_on":["o'), F.col("before"), F.lit('"]}')), F.lit('"}')),
    )
    result = F.concat(F.lit('{"tool_call_id":"o'), F.col("o_orderkey"), F.lit('","content":"done"}'))
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    talk = orders.select(F.col("o_custkey").alias("conv_id"), "turn", F.inline(F.array(said("assistant", call), said("tool", F.when(F.col("o_orderpriority") != "1-URGENT", result)))))
    return chat_tools.format_turns(talk.where("text is not null"), spark.createDataFrame([CHAIN_TOOL], chat_tools.SCHEMAS))


CHAIN_SQL = f"""
WITH l AS (SELECT o_custkey AS conv_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS turn, 'o' || o_orderkey AS id, o_orderpriority <> '1-URGENT' AS done, CAST(floor(o_totalprice) AS BIGINT) AS q, o_orderstatus AS f FROM orders)
SELECT 'call' AS kind, conv_id, id AS call_id, turn, 'ship' AS name, turn - 1 AS level,
  concat_ws('; ', CASE WHEN f = 'F' THEN 'missing: amount' WHEN f = 'P' THEN 'type: amount' END, CASE WHEN NOT done THEN 'no result' END) AS problems,
  CASE WHEN done THEN turn END AS result_turn, CAST(done AS BIGINT) AS n_results,
  '{{"arguments":{{' || CASE f WHEN 'F' THEN '' WHEN 'P' THEN '"amount":"' || q || '",' ELSE '"amount":' || q || ',' END || '"where":{{"customer":' || conv_id || ',"zone":1.5}}}},"id":"' || id || '","name":"ship"' || CASE WHEN done THEN ',"result":"done"' ELSE '' END || '}}' AS json
FROM l
UNION ALL
SELECT 'result' AS kind, conv_id, id AS call_id, turn, {_NO_CALL}, '{{"content":"done","tool_call_id":"' || id || '"}}' AS json FROM l WHERE done"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_N = decontamination.WINDOW
DECONTAMINATION_SQL = f"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(w[i:i + {_N - 1}]) AS n, w[i:i + {_N - 1}] AS g FROM (SELECT *, unnest(range(1, greatest(1, len(w) - {_N - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS w FROM documents),
dw AS (SELECT r, i, n, w[i:i + n - 1] AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

_WEIGHTS = f"[{', '.join(map(str, mixing.WEIGHTS))}]"
_BLANK = r"[\x20\x09-\x0D]+"
MIX_SQL = f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t, CAST(len(regexp_extract_all(coalesce(text, ''), '{_SPACE}+')) AS BIGINT) AS size FROM documents),
q AS (SELECT doc_id, source, size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(t)) AS h, CASE WHEN size > 0 THEN
  greatest(0.05::DOUBLE, 1 - 10 * (length(t) - length(regexp_replace(t, '{mixing.SYMBOLS}', '', 'g'))) / length(t)::DOUBLE)
  * CASE WHEN length(regexp_replace(t, '{_BLANK}', '', 'g')) / size::DOUBLE BETWEEN 3 AND 12 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END ELSE 1.0::DOUBLE END AS quality FROM t),
k AS (SELECT doc_id, source, size, -ln((CAST('0x' || substr(h, 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / quality AS key, quality FROM q),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, {_WEIGHTS}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight FROM k GROUP BY source),
o AS (SELECT *, {mixing.CAP} * source_size / weight::DOUBLE AS ratio, CAST(sum(source_size) OVER () - {mixing.CAP} * (sum(source_size) OVER w - source_size) AS DOUBLE) / CAST(sum(weight) OVER () - (sum(weight) OVER w - weight) AS DOUBLE) AS level
  FROM s WINDOW w AS (ORDER BY {mixing.CAP} * source_size / weight::DOUBLE, source ROWS UNBOUNDED PRECEDING)),
l AS (SELECT arg_min(level, ratio) AS level FROM o WHERE level <= ratio),
g AS (SELECT source, source_size, least({mixing.CAP} * source_size::DOUBLE, weight * level) AS target FROM s, l),
r AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM g),
p AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS epochs, CASE WHEN source_size > 0 THEN quota % source_size ELSE 0 END AS rest,
  sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size, quality ROWS UNBOUNDED PRECEDING) - size AS before FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM p"""

_MIN, _TOP, _PIECE = collocations.MIN_COUNT, collocations.TOP, r"[.,;:!?\x0A-\x0D]"
COLLOCATION_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_PIECE}')), '[^\\x20\\x09]+') AS w FROM documents),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS (SELECT lang, g, count(*) AS a FROM (SELECT lang, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) x(k))) GROUP BY ALL HAVING count(*) >= {_MIN}),
inside AS (SELECT DISTINCT s.lang, s.g FROM (SELECT lang, a, unnest([g[1:len(g) - 1], g[2:len(g)]]) AS g FROM f WHERE len(g) > 2) q JOIN f s ON s.lang = q.lang AND s.g = q.g AND 100 * q.a >= 100 * s.a),
c AS (SELECT f.lang, f.g, f.a, unnest(range(1, len(f.g))) AS k FROM f ANTI JOIN inside USING (lang, g) WHERE len(f.g) > 1),
s AS (SELECT c.lang, c.g, c.a, c.k, l.a AS l, r.a AS r, n, CAST((1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:c.k] JOIN f r ON r.lang = c.lang AND r.g = c.g[c.k + 1:len(c.g)] JOIN total ON total.lang = c.lang),
m AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM m QUALIFY rank <= {_TOP}"""

AUDIT_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE}+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS x FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(q, 0) AS q, coalesce(x, 0) AS x, count(*) AS n, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM d JOIN firsts USING (t) LEFT JOIN marks USING (doc_id) GROUP BY ALL),
f(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT s.c || t.c || u.c || v.c || w.c AS filter_order, [s.b, t.b, u.b, v.b, w.b] AS bits FROM f s, f t, f u, f v, f w WHERE s.b + t.b + u.b + v.b + w.b = 31 AND len(list_distinct([s.b, t.b, u.b, v.b, w.b])) = 5),
steps AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS past FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (past + bit) = 0) AS kept, sum(n) FILTER (mask & past = 0 AND mask & bit > 0) AS removed, sum(n) FILTER (mask & past > 0 AND mask & bit > 0) AS redundant,
  sum(n) FILTER (mask = bit) AS unique_fails, sum(n * q) FILTER (mask & past = 0 AND mask & bit > 0) AS good_lost, sum(n * x) FILTER (mask & past = 0 AND mask & bit > 0) AS toxic_lost FROM m, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""

QUERIES["tool_chains"] = tool_chains

#: The other operators need a tokenizer, XXH64, byte windows, templates or fitted weights; tests hold them against brute-force versions.
SQL: dict[str, str] = {
    "op1_url_filter": URL_SQL,
    "op7_quality": QUALITY_SQL,
    "op9_tool_calls": TOOL_SQL,
    "op10_decontamination": DECONTAMINATION_SQL,
    "op11_mixing": MIX_SQL,
    "op12_collocations": COLLOCATION_SQL,
    "op13_filter_audit": AUDIT_SQL,
    "tool_chains": CHAIN_SQL,
}
