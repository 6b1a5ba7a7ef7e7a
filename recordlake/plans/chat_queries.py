"""Conversations exported in several forms and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.sources import chats

from .registry import Tables, query

BOT = "Ada Bot"

# What an export can hold: turns with text, trimmed as the parser does; a form needs two. HTML tells a message once. Text has no roles but speakers.
SAID = """said AS (SELECT conv_id, turn, role, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM conversations WHERE trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> ''),
named AS (SELECT *, CASE role WHEN 'assistant' THEN 'character' ELSE role END AS who, CASE role WHEN 'assistant' THEN 'Ada Bot' WHEN 'user' THEN 'You' ELSE 'Narrator' END AS speaker FROM said),
forms(form) AS (VALUES ('json'), ('html'), ('text')),
every AS (SELECT *, CASE WHEN form = 'text' AND who = 'system' THEN 'unknown' ELSE who END AS r, lag(who) OVER w = who AND lag(text) OVER w = text AS same FROM named, forms WINDOW w AS (PARTITION BY conv_id, form ORDER BY turn)),
told AS (SELECT * FROM every QUALIFY form <> 'html' OR row_number() OVER (PARTITION BY conv_id, form, r, text ORDER BY turn) = 1),
full_ AS (SELECT *, count(*) OVER (PARTITION BY conv_id, form) AS n FROM told)"""


def _exports(t: Tables) -> DataFrame:
    """Each conversation as JSON below two wrappers beside another list, as HTML, and as lines with speakers."""
    one = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("m"))
    who = lambda r: F.when(r == "assistant", BOT).when(r == "user", "You").otherwise("Narrator")
    items = F.transform("m", lambda x: F.struct(F.struct(x["text"]).alias("message"), x["role"].alias("role"), who(x["role"]).alias("name")))
    as_json = F.to_json(F.struct(F.struct(F.array(F.struct(items.alias("turns"))).alias("pages"), F.lit(2).alias("v")).alias("data"), F.array(F.lit("x")).alias("history")))
    escaped = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    node = lambda x: F.concat(F.lit('<div class="row message" data-role="'), x["role"], F.lit('"><b class="name">'), who(x["role"]), F.lit('</b><br><p class="content">'), escaped(x["text"]), F.lit("</p></div>\n"))
    as_html = F.concat(F.lit('<!doctype html><script type="application/json">{"a": [1]}</script><body>'), F.array_join(F.transform("m", node), ""), F.lit("</body>"))
    as_text = F.array_join(F.transform("m", lambda x: F.concat(who(x["role"]), F.lit(": "), x["text"])), "\n")
    forms = F.array(*(F.struct(F.lit(f).alias("form"), x.alias("text")) for f, x in (("json", as_json), ("html", as_html), ("text", as_text))))
    return one.select("conv_id", F.inline(forms), F.lit(BOT.lower()).alias("bot"))


@query("WITH " + SAID + " SELECT conv_id, form, CAST(row_number() OVER (PARTITION BY conv_id, form ORDER BY turn) - 1 AS INTEGER) AS pos, r AS role, speaker, text, who = 'system' AND form <> 'text' AS ooc, form = 'json' AND coalesce(same, false) AS regen FROM full_ WHERE n >= 2")
def parsed_conversations(t: Tables) -> DataFrame:
    own = _exports(t)
    return chats.messages(own.withColumn("form", chats.form_of(F.col("text"))), ("conv_id", "form")).drop("at")


@query("WITH " + SAID + " SELECT form, count(DISTINCT conv_id) AS exports, count(*) AS messages, CAST(sum(CASE WHEN r = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS users FROM full_ WHERE n >= 2 GROUP BY 1")
def parsed_forms(t: Tables) -> DataFrame:
    own = chats.messages(_exports(t), ("conv_id", "form"))
    return own.groupBy("form").agg(F.count_distinct("conv_id").alias("exports"), F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("users"))
