"""Chat formatting: tool calls linked with their results, in DataFrame functions alone.

Calls and results are hash-joined by identifier, ordered topologically by the calls they refer to, checked against the
tools' argument schemas and written as canonical JSON. Arguments stay variants throughout, so numbers, truth values and
nested objects keep their types; a variant keeps the keys of every object in order.
"""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir

#: Types that a schema may name, with the beginnings of what `schema_of_variant` says of such a value.
TYPES = {
    "string": ("STRING",),
    "integer": ("BIGINT",),  # and numbers of any width or notation whose fraction is zero
    "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
    "null": ("VOID",),
}
KEY = ["conv", "id"]
#: Tools whose schemas are broadcast; more are joined by a shuffle.
TOOLS = 10_000


def canonical_json(pairs: dict[str, Column]) -> Column:
    """A JSON object with its keys in order, without blanks and null members."""
    return F.to_json(F.struct(*(pairs[k].alias(k) for k in sorted(pairs))))


def place(*content: Column) -> Column:
    """A number that orders rows by turn, rows of one turn by a hash of their content; null turns come last."""
    after = F.lit(Decimal(2**63))
    turn = F.coalesce(F.col("turn").cast("decimal(19,0)"), after)
    return (turn * after).cast("decimal(38,0)") + F.shiftrightunsigned(F.xxhash64(*content), 1).cast("decimal(38,0)")


def _chains(single: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the chains of calls with one need end, by pointer jumping: conv, id, to, far; and those that run in circles."""
    rounds = max(1, single.count()).bit_length() + 1
    jumps = cut(single.select("conv", "id", F.col("needs").alias("to"), F.lit(1).cast("bigint").alias("far")))
    for _ in range(rounds):
        after = jumps.select("conv", F.col("id").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
        step = cut(jumps.join(after, ["conv", "to"], "left"))
        if not step.where("next is not null").head(1):
            return jumps, jumps.where("false")
        jumps = step.select("conv", "id", F.coalesce("next", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"))
    on = jumps.select("conv", F.col("id").alias("to"))
    return cut(jumps.join(on, ["conv", "to"], "left_anti")), cut(jumps.join(on, ["conv", "to"], "left_semi"))


def levels(edges: DataFrame) -> DataFrame:
    """Topological level of each call that has needs: conv, id, level; null for calls on or behind a cycle.

    `edges`: conv, id, needs. A call's level is one above the highest of its needs; calls without needs have level 0 and
    aren't listed. Chains of calls with one need each are followed by pointer jumping, in rounds by the
    logarithm of their length; further rounds follow the longest path of calls with several needs. No depth is too great.
    """
    edges = cut(edges.distinct())
    counts = edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    single = edges.join(counts.where("n = 1").drop("n"), KEY, "left_semi")
    ends, circles = _chains(single)
    to = ends.select("conv", F.col("id").alias("needs"), F.col("to"), F.col("far"))
    round_ = circles.select("conv", F.col("id").alias("needs"), F.lit(True).alias("never"))
    forks = edges.join(counts.where("n > 1").drop("n"), KEY, "left_semi").join(to, ["conv", "needs"], "left").join(round_, ["conv", "needs"], "left")
    forks = cut(forks.select(*KEY, F.coalesce("to", "needs").alias("needs"), (F.coalesce("far", F.lit(0)) + 1).alias("far"), F.coalesce("never", F.lit(False)).alias("never")))
    path = f"{shared_dir(edges.sparkSession).rstrip('/')}/levels-{uuid.uuid4().hex}"
    spark = edges.sparkSession
    forks.select(*KEY, F.col("far").alias("level")).where("false").write.parquet(path)
    placed = lambda: spark.read.schema("conv " + forks.schema["conv"].dataType.simpleString() + ", id string, level bigint").parquet(path)
    left = forks
    while left.head(1):
        waiting = left.select("conv", F.col("id").alias("needs"), F.lit(True).alias("waits")).distinct()
        known = placed().select("conv", F.col("id").alias("needs"), "level")
        state = left.join(waiting, ["conv", "needs"], "left").join(known, ["conv", "needs"], "left")
        done = state.groupBy(*KEY).agg(F.max(F.coalesce("waits", F.lit(False)) | F.col("never")).alias("held"), F.max(F.coalesce("level", F.lit(0)) + F.col("far")).alias("level"))
        ready = cut(done.where("not held").select(*KEY, "level"))
        if not ready.head(1):
            break
        ready.write.mode("append").parquet(path)
        left = cut(left.join(ready.select(*KEY), KEY, "left_anti"))
    forked = placed()
    never = left.select(*KEY).distinct().withColumn("level", F.lit(None).cast("bigint"))
    high = forked.unionByName(never).select("conv", F.col("id").alias("to"), F.col("level"), F.lit(True).alias("fork"))
    chained = ends.join(high, ["conv", "to"], "left").select(*KEY, F.when(F.col("fork").isNull(), F.col("far")).otherwise(F.col("level") + F.col("far")).alias("level"))
    return forked.unionByName(never).unionByName(chained).unionByName(circles.select(*KEY, F.lit(None).cast("bigint").alias("level")))


def argument_problems(arguments: Column, required: Column, types: Column) -> list[Column]:
    """What is wrong with a call's arguments, a variant: null where nothing is. `types`: map of argument to type name."""
    given = F.coalesce(F.try_variant_get(arguments, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    names = F.map_keys(given)
    say = lambda found, text: F.when(F.size(found) > 0, F.concat(F.lit(text), F.array_join(F.array_sort(found), ",")))
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))

    def fits(entry: Column) -> Column:
        want = F.try_element_at(types, entry["key"])
        tests = [(want == name) & F.substring_index(F.substring_index(kind(entry["value"]), "<", 1), "(", 1).isin(*begins) for name, begins in TYPES.items()]
        value = entry["value"]
        real = F.try_variant_get(value, "$", "double")
        whole = F.when(kind(value).startswith("DECIMAL"), F.try_variant_get(value, "$", "string").rlike(r"^-?[0-9]+(\.0*)?$")).when(kind(value).isin("DOUBLE", "FLOAT"), real == F.rint(real))
        return want.isNull() | F.array_contains(F.array(*tests), F.lit(True)) | F.coalesce((want == "integer") & whole, F.lit(False))

    wrong = F.transform(F.filter(F.map_entries(given), lambda e: ~fits(e)), lambda e: e["key"])
    return [
        F.when(arguments.isNotNull() & ~F.schema_of_variant(arguments).startswith("OBJECT"), F.lit("arguments: no object")),
        say(F.array_except(required, names), "missing: "),
        say(F.array_except(names, F.map_keys(types)), "unknown: "),
        say(wrong, "type: "),
    ]


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per row of `calls`: conv, id, turn, name, level, problems, result_turn, n_results and canonical JSON.

    `calls`: conv, turn, id, name, arguments (variant), depends_on (array of ids). `results`: conv, turn, id, content.
    `schemas`: tool, required (array of names), types (map of argument name to a name of TYPES), one row per tool.
    Results belong to the first call of their id in the conversation, by turn, calls of one turn by a hash of name and
    arguments; other calls of that id have the problem `duplicate id`, no level and no result. Rows that are equal are
    each linked alike. Of results that share an id the first turn counts, results of one turn by a hash of their content;
    n_results tells how many rows there were. Calls without an id or conversation have the problem `no id`. References to
    calls that don't exist are listed as problems and don't bind. Empty tables give an empty result.
    """
    text = F.to_json(F.col("arguments"))
    c = calls.select("conv", "turn", "id", "name", "arguments", "depends_on").withColumn("place", place(F.col("name"), text))
    firsts = c.where("id is not null and conv is not null").groupBy(*KEY).agg(F.min("place").alias("first"))
    c = c.join(firsts.hint("shuffle_hash"), KEY, "left").withColumn("own", F.coalesce(F.col("place") == F.col("first"), F.lit(False)))
    r = results.where("id is not null and conv is not null").select("conv", "turn", "id", "content").withColumn("place", place(F.col("content")))
    best = r.groupBy(*KEY).agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n_results"))
    best = r.join(best.hint("shuffle_hash"), [*KEY, "place"]).select(*KEY, F.col("turn").alias("result_turn"), "content", "n_results").distinct()
    linked = c.join(best.withColumn("own", F.lit(True)).hint("shuffle_hash"), [*KEY, "own"], "left")
    needs = c.where("own and depends_on is not null").select(*KEY, F.explode("depends_on").alias("needs")).where("needs is not null").distinct()
    if c.where("size(depends_on) > 0").head(1) and needs.head(1):
        known = firsts.select("conv", F.col("id").alias("needs"), F.lit(True).alias("known"))
        bound = cut(needs.join(known.hint("shuffle_hash"), ["conv", "needs"], "left"))
        missing = bound.where("known is null").groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_list("needs")), ",").alias("missing"))
        high = levels(bound.where("known").select(*KEY, "needs")).withColumn("waits", F.lit(True))
        linked = linked.join(missing, KEY, "left").join(high, KEY, "left")
        level = F.when(F.col("own") & F.col("waits").isNull(), F.lit(0)).when(F.col("own"), F.col("level"))
        linked = linked.withColumn("level", level.cast("bigint"))
    else:
        linked = linked.withColumns({"missing": F.lit(None).cast("string"), "level": F.when(F.col("own"), F.lit(0)).cast("bigint")})
    tools = schemas.select(F.col("tool").alias("name"), "required", "types")
    # One tool may have most calls, so a list of few tools isn't left to a shuffle by name.
    linked = linked.join(F.broadcast(tools) if tools.limit(TOOLS + 1).count() <= TOOLS else tools, "name", "left")
    problems = F.array_compact(
        F.array(
            F.when(F.col("first").isNull(), "no id").when(~F.col("own"), "duplicate id"),
            F.when(F.col("required").isNull(), "unknown tool"),
            *argument_problems(F.col("arguments"), F.col("required"), F.col("types")),
            F.concat(F.lit("unresolved: "), F.col("missing")),
            F.when(F.col("own") & F.col("level").isNull(), "cycle"),
            F.when(F.col("n_results").isNull(), "no result"),
        )
    )
    json = canonical_json({"arguments": F.col("arguments"), "id": F.col("id"), "name": F.col("name"), "result": F.col("content")})
    return linked.select(*KEY, "turn", "name", "level", F.array_join(problems, "; ").alias("problems"), "result_turn", F.coalesce("n_results", F.lit(0).cast("bigint")).alias("n_results"), json.alias("json"))


def turns(conversations: DataFrame, tool: str = "reply") -> DataFrame:
    """Each turn as kind (call, result, answer or message), conv, turn, role, text, id, name, arguments, depends_on, content.

    In any role, a JSON object with `id` and `name` is a call and one with `tool_call_id` is a result; a list of such calls, or of such
    results, gives a row each. An object that repeats a key is no JSON object here and stays text. Of other texts, a
    user's turn is a call of `tool` with its text as the argument `prompt` and the id `conversation:turn`; an
    assistant's turn is the answer to the turn before. All others, as a system's, are messages.
    """
    own = conversations.select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    listed = F.when(F.ltrim("text").startswith("["), F.try_variant_get(F.try_parse_json("text"), "$", "array<variant>"))
    has = lambda v, *names: F.array_size(F.array_compact(F.array(*(F.try_variant_get(v, f"$.{n}", "string") for n in names)))) == len(names)
    alike = (F.size("listed") > 0) & (F.forall("listed", lambda v: has(v, "id", "name")) | F.forall("listed", lambda v: has(v, "tool_call_id")))
    one = F.when(F.ltrim("text").startswith("{"), F.try_parse_json("text"))
    own = own.withColumn("listed", listed).select("conv", "turn", "role", "text", F.explode(F.when(alike, F.col("listed")).otherwise(F.array(one))).alias("v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    place_id = lambda back: F.concat(F.col("conv").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))
    is_call = get("$.id", "string").isNotNull() & get("$.name", "string").isNotNull()
    is_result = get("$.tool_call_id", "string").isNotNull()
    kind = F.when(is_call, "call").when(is_result, "result").when(F.col("role") == "user", "prompt").when(F.col("role") == "assistant", "answer").otherwise("message")
    own = own.withColumn("kind", kind)
    k = F.col("kind")
    prompt = F.to_variant_object(F.map_filter(F.create_map(F.lit("prompt"), F.col("text")), lambda _, v: v.isNotNull()))
    content = get("$.content", "variant")
    return own.select(
        F.when(k == "prompt", "call").otherwise(k).alias("kind"),
        "conv",
        "turn",
        "role",
        "text",
        F.when(k == "call", get("$.id", "string")).when(k == "result", get("$.tool_call_id", "string")).when(k == "prompt", place_id(0)).when(k == "answer", place_id(1)).alias("id"),
        F.when(k == "call", get("$.name", "string")).when(k == "prompt", tool).alias("name"),
        F.when(k == "call", F.coalesce(get("$.arguments", "variant"), F.parse_json(F.lit("{}")))).when(k == "prompt", prompt).alias("arguments"),
        F.when(k == "call", get("$.depends_on", "array<string>")).alias("depends_on"),
        F.when(k == "result", F.coalesce(get("$.content", "string"), F.to_json(content))).when(k == "answer", F.col("text")).alias("content"),
    )


def format_turns(conversations: DataFrame, schemas: DataFrame, tool: str = "reply") -> DataFrame:
    """One row per row of `conversations` (conv_id, turn, role, text), or per call or result of a list of them: kind, call_id, name, level, problems, result_turn, n_results, json.

    Calls are linked as in `link_tool_calls`. A result whose call doesn't exist has the problem `no call`; an assistant's turn
    that answers no call is a message. Null texts are calls without a prompt, answers and messages without content. Turns
    without a conversation or number link to nothing. Repeated rows stay, each judged alike. Other columns are
    left out, whatever their names.
    """
    own = turns(conversations, tool)
    if own.where("size(depends_on) > 0").head(1):
        own = cut(own)  # levels read the calls many times over, so the texts are parsed once
    calls = own.where("kind = 'call'")
    answers = own.where("kind in ('result', 'answer')")
    called = calls.where("id is not null and conv is not null").select(*KEY).distinct().withColumn("called", F.lit(True))
    judged = answers.join(called.hint("shuffle_hash"), KEY, "left").withColumn("kind", F.when((F.col("kind") == "answer") & F.col("called").isNull(), "message").otherwise("result"))
    results = judged.where("called")
    linked = link_tool_calls(calls, results, schemas).select(F.lit("call").alias("kind"), F.col("conv").alias("conv_id"), F.col("id").alias("call_id"), "turn", "name", "level", "problems", "result_turn", "n_results", "json")
    loose = judged.unionByName(own.where("kind = 'message'").withColumn("called", F.lit(None).cast("boolean")))
    is_result = F.col("kind") == "result"
    message = canonical_json({"content": F.col("text"), "role": F.col("role")})
    answer = canonical_json({"content": F.col("content"), "tool_call_id": F.col("id")})
    none = lambda kind: F.lit(None).cast(kind)
    loose = loose.select(
        "kind",
        F.col("conv").alias("conv_id"),
        F.when(is_result, F.col("id")).alias("call_id"),
        "turn",
        none("string").alias("name"),
        none("bigint").alias("level"),
        F.when(is_result & F.col("called").isNull(), "no call").otherwise("").alias("problems"),
        none("bigint").alias("result_turn"),
        F.lit(0).cast("bigint").alias("n_results"),
        F.when(is_result, answer).otherwise(message).alias("json"),
    )
    return linked.unionByName(loose)


#: Fixed schema of the query's tool: arguments with their types, and those required.
REPLY = ("reply", ["prompt"], {"prompt": "string", "style": "string"})
SCHEMAS = "tool string, required array<string>, types map<string,string>"


def op9_tool_calls(conversations: DataFrame) -> DataFrame:
    return format_turns(conversations, conversations.sparkSession.createDataFrame([REPLY], SCHEMAS))
