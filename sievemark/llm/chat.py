"""Chat formatting: linking tool calls with their results, in DataFrame functions only.

A message's text may be a JSON object. An object with "tool_calls": [{"id", "name", "arguments",
"depends_on"}] holds calls; one with "tool_call_id" is a result. Calls and results are hash-joined by
conversation and identifier, after each side has been reduced to one row per identifier (the first call's
turn, the last result's), so a repeated identifier can't multiply rows; each call and each result then
compares its own turn with the other side's. Calls are ordered topologically by what they depend on, level by level;
arguments are validated against the tools' schemas; every message becomes canonical JSON (keys sorted, no
white space): {"content": ..., "role": ...}, where content is the text, or the object that holds calls or
a result, so that no key of it meets one of the message's. Numbers take their shortest form (1.50 becomes
1.5, 1.0e2 becomes 100). All results are rows of one message or call: no conversation is gathered in a
task, and (conv_id, level, turn, position) orders it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import checkpointed


def canonical(json: Column) -> Column:
    """The JSON text with sorted keys and without white space; null if it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def parsed(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, calls (array or null), result_of (identifier or null) of each message.

    A null text is plain, empty content. What is no JSON object, or has neither key, is plain content.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), text.alias("text"))
    is_object = F.col("text").rlike(r"^\s*\{") & F.col("text").rlike('"tool_call')
    rows = rows.withColumn("_v", F.when(is_object, F.try_parse_json("text")))
    calls = F.try_variant_get("_v", "$.tool_calls", "array<variant>")
    return rows.withColumn("calls", calls).withColumn("result_of", F.try_variant_get("_v", "$.tool_call_id", "string")).drop("_v")


def calls_of(messages: DataFrame) -> DataFrame:
    """conv_id, turn, position, call_id, name, arguments (variant), depends_on of each call in parsed messages."""
    one = messages.where("calls is not null").select("conv_id", "turn", F.posexplode("calls").alias("position", "_c"))
    get = lambda path, kind: F.try_variant_get("_c", path, kind)
    return one.select("conv_id", "turn", F.col("position").cast("long"), get("$.id", "string").alias("call_id"), get("$.name", "string").alias("name"), F.try_variant_get("_c", "$.arguments", "variant").alias("arguments"), F.coalesce(get("$.depends_on", "array<string>"), F.array().cast("array<string>")).alias("depends_on"))


def _type_ok(kind: Column, value: Column) -> Column:
    is_a = F.schema_of_variant(value)
    whole, number = is_a == "BIGINT", is_a.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return (
        F.when(kind == "integer", whole).when(kind == "number", number).when(kind == "string", is_a == "STRING").when(kind == "boolean", is_a == "BOOLEAN")
        .when(kind == "array", is_a.startswith("ARRAY")).when(kind == "object", is_a.startswith("OBJECT")).when(kind == "null", is_a == "VOID").otherwise(True)
    )


def validated(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """calls with errors: the reasons why the arguments break their tool's schema, sorted; empty if they hold it.

    tools has name and schema (JSON: properties with types, required, additionalProperties). A call to a
    tool without schema has the error "unknown tool"; of a tool that comes twice the smaller schema text counts.
    """
    schemas = tools.where("name is not null").groupBy("name").agg(F.min("schema").alias("_s")).withColumn("_s", F.try_parse_json("_s"))
    schemas = schemas.select(F.col("name").alias("_tool"), F.try_variant_get("_s", "$.properties", "map<string,variant>").alias("_props"), F.coalesce(F.try_variant_get("_s", "$.required", "array<string>"), F.array().cast("array<string>")).alias("_need"), F.coalesce(F.try_variant_get("_s", "$.additionalProperties", "boolean"), F.lit(True)).alias("_more"))
    rows = calls.join(schemas, F.col("name") == F.col("_tool"), "left").withColumn("_args", F.try_variant_get("arguments", "$", "map<string,variant>"))
    keys = F.coalesce(F.map_keys("_args"), F.array().cast("array<string>"))
    props = F.coalesce(F.col("_props"), F.create_map().cast("map<string,variant>"))
    missing = F.transform(F.array_except("_need", keys), lambda k: F.concat(F.lit("missing "), k))
    extra = F.when(F.col("_more"), F.array().cast("array<string>")).otherwise(F.transform(F.array_except(keys, F.map_keys(props)), lambda k: F.concat(F.lit("unexpected "), k)))
    wrong = F.transform(
        F.filter(F.array_intersect(keys, F.map_keys(props)), lambda k: ~_type_ok(F.try_variant_get(F.element_at(props, k), "$.type", "string"), F.element_at(F.col("_args"), k))),
        lambda k: F.concat(F.lit("type of "), k),
    )
    errors = F.when(F.col("_tool").isNull(), F.array(F.lit("unknown tool"))).when(F.col("_args").isNull(), F.array(F.lit("arguments are no object"))).otherwise(F.sort_array(F.concat(missing, extra, wrong)))
    return rows.withColumn("errors", errors).drop("_tool", "_props", "_need", "_more", "_args")


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of each identified call: 0 without dependencies, else one above the highest of them.

    Dependencies on unknown identifiers don't count. Calls on or behind a cycle have level null. Calls
    with one dependency point to the nearest call with none or several by doubling, so a chain of n
    calls takes log2(n) rounds; the others are levelled round by round until a round adds nothing.
    """
    key = ["conv_id", "call_id"]
    known = calls.where("call_id is not null and conv_id is not null")
    nodes = known.select(*key).distinct()
    edges = known.select(*key, F.explode("depends_on").alias("needs")).distinct()
    edges = checkpointed(edges.join(nodes.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_semi"))
    nodes = checkpointed(nodes)
    if edges.isEmpty():
        return nodes.withColumn("level", F.lit(0).cast("long"))
    needed = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("needs").alias("needs"))
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    # A pointer is open while it ends at a call that has one dependency itself.
    hops = nodes.join(needed, key, "left").select(*key, F.when(one, F.col("needs")).otherwise(F.col("call_id")).alias("to"), F.when(one, 1).otherwise(0).cast("long").alias("steps"), one.alias("single"), F.coalesce("n", F.lit(0)).alias("n"))
    ends = hops.where("single").select("conv_id", F.col("call_id").alias("to"), F.lit(True).alias("open"))
    hops = checkpointed(hops.join(ends, ["conv_id", "to"], "left").withColumn("open", F.coalesce("open", F.lit(False))))
    before, left = -1, hops.where("open").count()
    while left and left != before:  # what stays open runs in a cycle
        next_hop = hops.where("single").select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("open").alias("_open"))
        moved = hops.where("open").join(next_hop, ["conv_id", "to"]).select(*key, F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps"), "single", "n", F.col("_open").alias("open"))
        hops = checkpointed(hops.where("not open").select(moved.columns).unionByName(moved))
        before, left = left, hops.where("open").count()
    ended = hops.where("not open")
    several = edges.join(hops.where("n > 1").select(*key), key, "left_semi")
    several = several.join(ended.select("conv_id", F.col("call_id").alias("needs"), "to", "steps"), ["conv_id", "needs"], "left")
    several = several.select(*key, "to", (F.col("steps") + 1).alias("steps"))
    done = new = checkpointed(hops.where("n = 0").select(*key, F.lit(0).cast("long").alias("level")))
    waits = checkpointed(several.groupBy("conv_id", "call_id", "to").agg(F.max("steps").alias("steps"), F.count("*").alias("k")))
    # Of a call that waits: how many of its dependencies are levelled, and the highest level so far.
    open_ = checkpointed(waits.groupBy(*key).agg(F.sum("k").alias("n")).select(*key, "n", F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("level")))
    while not open_.isEmpty():  # each round joins what the last one has levelled, and nothing else
        met = waits.join(new.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("_l")), ["conv_id", "to"]).groupBy(*key).agg(F.sum("k").alias("_m"), F.max(F.col("_l") + F.col("steps")).alias("_level"))
        moved = checkpointed(open_.join(met, key, "left").select(*key, "n", (F.col("m") + F.coalesce("_m", F.lit(0))).alias("m"), F.greatest("level", "_level").alias("level")))
        new = moved.where("n = m").select(*key, "level")
        if new.isEmpty():
            break
        done, open_ = done.unionByName(new), moved.where("n <> m")
    ended = ended.join(done.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("_l")), ["conv_id", "to"])
    return nodes.join(ended.select(*key, (F.col("_l") + F.col("steps")).alias("level")), key, "left")


def linked(messages: DataFrame, tools: DataFrame | None = None, **columns: str) -> DataFrame:
    """One row per message, and one per call: conv_id, turn, position, kind, role, call_id, linked, level, errors, json.

    kind is message, result or call; position is -1 for messages and results, the place in its message
    for calls. linked: a call has a later or equal-turn result, a result has an earlier or equal-turn call
    (null for messages). Repeated rows come out each; an empty table gives no rows; an empty set of tools
    makes every call one of an unknown tool, tools = None leaves arguments unvalidated.
    """
    rows = parsed(messages, **columns)
    calls = calls_of(rows)
    key = ["conv_id", "call_id"]
    asked = calls.where("call_id is not null").groupBy(*key).agg(F.min("turn").alias("_asked"))
    answered = rows.where("result_of is not null").groupBy("conv_id", F.col("result_of").alias("call_id")).agg(F.max("turn").alias("_answered"))
    turns = asked.hint("shuffle_hash").join(answered, key)
    none = F.lit(None)
    kind = F.when(F.col("result_of").isNotNull(), "result").otherwise("message")
    structured = F.col("calls").isNotNull() | F.col("result_of").isNotNull()
    role = F.to_json(F.struct("role"))
    json = F.when(structured, F.concat(F.lit('{"content":'), canonical(F.col("text")), F.lit(","), F.substring(role, 2, 2**31 - 1))).otherwise(F.to_json(F.struct(F.col("text").alias("content"), "role")))
    plain = rows.select("conv_id", "turn", F.lit(-1).cast("long").alias("position"), kind.alias("kind"), "role", F.col("result_of").alias("call_id"), none.cast("array<string>").alias("errors"), json.alias("json"))
    checked = validated(calls, tools) if tools is not None else calls.withColumn("errors", none.cast("array<string>"))
    called = checked.select("conv_id", "turn", "position", F.lit("call").alias("kind"), F.lit("assistant").alias("role"), "call_id", "errors", canonical(F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json("arguments"), F.lit("null")), F.lit(","), F.substring(F.to_json(F.struct(F.col("call_id").alias("id"), "name")), 2, 2**31 - 1))).alias("json"))
    identified = plain.where("kind = 'result'").unionByName(called)
    level = levels(calls)
    meets = F.when(F.col("kind") == "call", F.col("turn") <= F.col("_answered")).otherwise(F.col("_asked") <= F.col("turn"))
    identified = identified.join(turns, key, "left").join(level, key, "left").withColumn("linked", F.coalesce(meets, F.lit(False)))
    whole = plain.where("kind = 'message'").withColumns({"linked": none.cast("boolean"), "level": none.cast("long")})
    names = ["conv_id", "turn", "position", "kind", "role", "call_id", "linked", "level", "errors", "json"]
    return whole.select(names).unionByName(identified.select(names))
