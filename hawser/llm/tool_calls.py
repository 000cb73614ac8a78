"""Chat formatting by linking tool calls to their results; DataFrame functions only.

Calls and results are hash-joined by the call's identifier, ordered so that a call stands after every call that it
depends on, checked against the tool's schema, and written as canonical JSON (sorted keys, no white space).

A message is read as calls when it is JSON of the form {"tool_calls": [{"id", "name", "arguments", "after"}]}, as a
result when it is {"tool_call_id", "content"}. Plain turns are linked the same way: a user's turn asks the tool
`reply` under the identifier conversation:turn, an assistant's turn answers the one before it, and each question
comes after the one that the turn before it answered. Other turns are passed on as plain messages, and so is what
stands beside calls or a result in their JSON. No message is left out: calls and results that repeat an identifier
are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, delete, table, written

REPLY = "reply"
#: (tool, parameter, type, required); a tool without parameters here is unknown and its calls are invalid.
SCHEMAS = [(REPLY, "prompt", "string", True), (REPLY, "turn", "integer", True), (REPLY, "style", "string", False)]

#: JSON Schema type names and the variant types that they allow.
_TYPES = {
    "string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$",
    "object": "^OBJECT<.*", "array": "^ARRAY<.*", "null": "^VOID$",
}
_CALL = "array<struct<id: string, name: string, arguments: variant, after: array<string>>>"


def calls_and_results(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls (_row, conv_id, turn, call_id, tool, arguments, after), results (_row, conv_id, turn, call_id, content), other turns.

    _row numbers the messages. Plain turns without conversation or turn have no identifier.
    """
    rows = messages.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("_row"), F.try_parse_json(F.when(F.col("text").rlike(r"^\s*\{"), F.col("text"))).alias("v"))
    listed = rows.select("*", F.expr(f"try_variant_get(v, '$.tool_calls', '{_CALL}')").alias("calls"), F.expr("try_variant_get(v, '$.tool_call_id', 'string')").alias("answers"))
    is_call, is_result = F.col("calls").isNotNull(), F.col("calls").isNull() & F.col("answers").isNotNull()
    plain = ~is_call & ~is_result
    back = lambda n: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - n).cast("string"))
    written = listed.where(is_call).select("_row", "conv_id", "turn", F.explode("calls").alias("c")).select(
        "_row", "conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("tool"), F.col("c.arguments").alias("arguments"), F.coalesce("c.after", F.array()).alias("after")
    )
    asked = listed.where(plain & F.col("role").eqNullSafe("user")).select(
        "_row", "conv_id", "turn", back(0).alias("call_id"), F.lit(REPLY).alias("tool"),
        F.try_parse_json(F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))).alias("arguments"),
        F.when(F.col("turn") > 1, F.array(back(2))).otherwise(F.array().cast("array<string>")).alias("after"),
    )
    results = listed.where(is_result).select("_row", "conv_id", "turn", F.col("answers").alias("call_id"), F.expr("try_variant_get(v, '$.content', 'variant')").alias("content"))
    answered = listed.where(plain & F.col("role").eqNullSafe("assistant")).select("_row", "conv_id", "turn", back(1).alias("call_id"), F.to_variant_object(F.struct(F.col("text").alias("text"))).alias("content"))
    message = F.to_json(F.struct(F.col("text").alias("content"), "role"))
    other = listed.where(plain & ~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))).select("conv_id", "turn", message.alias("json"))
    # an object's text beside calls or a result is the message; with other fields, or without any call, the whole rest is
    fields = F.expr("map_filter(try_cast(v as map<string, variant>), (k, x) -> NOT (k = 'tool_calls' AND size(calls) > 0) AND NOT (calls IS NULL AND k IN ('tool_call_id', 'content')))")
    only_content = (F.size("rest") == 1) & F.map_contains_key("rest", "content")
    content = F.when(only_content, F.try_element_at("rest", F.lit("content"))).otherwise(F.to_variant_object("rest"))
    beside = listed.where(is_call | is_result).withColumn("rest", fields).where(F.size("rest") > 0).select("conv_id", "turn", F.to_json(F.struct(content.alias("content"), "role")).alias("json"))
    return written.union(asked), results.union(answered), other.union(beside)


def levels(calls: DataFrame) -> DataFrame:
    """(key, level) for each key of `calls` (key, after): 0 without known dependencies, else one more than the largest.

    Each key follows one of its dependencies, at first the last one listed; the lengths of all these chains come from
    pointer jumping, in rounds that grow with the logarithm of the longest. Then each key turns to its dependency of
    the highest level, and the chains are measured again, until no dependency is violated. Keys whose chain never
    ends are on a cycle; these, and all that depend on one, get a null level. A cycle that no chain follows yet shows
    as a violation, so it is found, too. Dependencies on unknown keys, on itself and null ones are left out.
    """
    known = calls.select("key").distinct()
    arcs = calls.select("key", F.posexplode("after").alias("at", "dep")).where("key <> dep").groupBy("key", "dep").agg(F.max("at").alias("at"))
    arcs = cut(arcs.join(known.withColumnRenamed("key", "dep"), "dep", "left_semi").select("key", "dep", "at"))
    state = written(known.select("key", F.lit(0).cast("long").alias("level"), F.lit(False).alias("cyclic")))
    while True:
        of_dep = state.select(F.col("key").alias("dep"), F.col("cyclic").alias("_cyclic"), F.col("level").alias("_level"))
        best = arcs.join(of_dep, "dep").groupBy("key").agg(F.max(F.struct("_cyclic", "_level", "at", "dep")).alias("best"))
        held = written(state.join(best, "key", "left"))
        violated = ~F.col("cyclic") & (F.col("best._cyclic") | (F.col("best._level") + 1 > F.col("level")))
        if held.where(violated).isEmpty():
            return state.select("key", F.when(~F.col("cyclic"), F.col("level")).alias("level"))
        up = F.when(~F.col("cyclic"), F.col("best.dep"))
        delete(state)
        state = _measured(held.select("key", up.alias("up"), F.when(up.isNull(), 0).otherwise(1).cast("long").alias("level"), "cyclic"))


def _measured(state: DataFrame) -> DataFrame:
    """(key, level, cyclic) from (key, up, level, cyclic): the length of each key's chain, by pointer jumping."""
    state, before = written(state), None
    while (rest := state.where("up is not null").count()) and rest != before:
        over = state.select(F.col("key").alias("up"), F.col("up").alias("above"), F.col("level").alias("more"), F.col("cyclic").alias("_cyclic"))
        jumped = state.join(over, "up", "left")
        cyclic = F.col("cyclic") | F.coalesce("_cyclic", F.lit(False))
        last, state = state, written(jumped.select("key", F.col("above").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"), cyclic.alias("cyclic")))
        delete(last)
        before = rest
    # a round that ends no chain leaves only those without end: else one of the next length would have ended in it
    return written(state.select("key", "level", (F.col("cyclic") | F.col("up").isNotNull()).alias("cyclic")))


def _problems(schemas) -> tuple[Column, Column]:
    """The types that `arguments` has by name, and from them (as `_given`) what is wrong for `tool`: array<string>."""
    given = F.expr("transform_values(try_cast(arguments as map<string, variant>), (k, x) -> schema_of_variant(x))")
    out = F.array(F.lit("unknown tool"))
    for tool in sorted({s[0] for s in schemas}):
        params = [s for s in schemas if s[0] == tool]
        found = []
        for _, name, kind, required in params:
            has = F.array_contains(F.map_keys("_given"), name)
            wrong = F.when(has & ~F.try_element_at("_given", F.lit(name)).rlike(_TYPES[kind]), F.lit(f"{name} is no {kind}"))
            found.append(wrong.when(~has, F.lit(f"{name} is missing")) if required else wrong)
        extra = F.transform(F.array_sort(F.array_except(F.map_keys("_given"), F.array(*(F.lit(p[1]) for p in params)))), lambda k: F.concat(k, F.lit(" is unknown")))
        checked = F.when(F.col("_given").isNull(), F.array(F.lit("arguments are no object"))).otherwise(F.concat(F.array_compact(F.array(*found)), extra))
        out = F.when(F.col("tool") == tool, checked).otherwise(out)
    return given, out


def _numbered(rows: DataFrame, json: str) -> DataFrame:
    """`rows` with key, _nth (1 for the earliest of a key, ties: the smaller JSON) and _of, the number of the key's rows.

    Rows without call_id have no key. A message without conversation is one of its own.
    """
    scope = F.when(F.col("conv_id").isNull(), F.concat(F.lit("row "), F.col("_row").cast("string"))).otherwise(F.concat(F.lit("conv "), F.col("conv_id").cast("string")))
    rows = rows.withColumns({"scope": scope, "key": F.concat_ws("\x1f", scope, F.col("call_id"))})
    named = rows.where("call_id is not null")
    by_key = Window.partitionBy("key")
    named = named.withColumns({"_nth": F.row_number().over(by_key.orderBy("turn", json, "_row")), "_of": F.count("*").over(by_key)})
    alone = rows.where("call_id is null").withColumns({"key": F.lit(None).cast("string"), "_nth": F.lit(1), "_of": F.lit(1).cast("long")})
    return named.unionByName(alone)


def link(messages: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """One row per call, per result without a call, and per other turn.

    conv_id, turn, call_id, tool, level, status, problems, json. Identifiers hold within a conversation; without one,
    within the message. Of calls that share one, and of results of one call, the earliest is linked (ties: the smaller
    JSON) and has the number of the rest in `repeated`; each of the rest is a row `duplicate` with its own JSON.
    Status: ok, invalid (see problems), unanswered, cyclic, orphan (a result without call), duplicate, message.
    Null texts give a missing prompt; null ids never match; an empty table gives an empty result.
    """
    calls, results, other = calls_and_results(messages)
    # arguments are written as JSON first, as variants can't be sorted; cut, as rows are numbered
    calls = cut(_numbered(calls.withColumn("arguments_json", F.to_json("arguments")).drop("arguments"), "arguments_json"))
    results = cut(_numbered(results.withColumn("content_json", F.to_json("content")).drop("content"), "content_json"))
    none = F.lit(None).cast("string")
    again_called = calls.where("_nth > 1").withColumn("arguments", F.try_parse_json("arguments_json"))
    given, problems = _problems(schemas)
    duplicate = F.lit("duplicate").alias("status")
    duplicates = again_called.withColumn("_given", given).withColumn("problems", problems).select(
        "conv_id", "turn", "call_id", "tool", F.lit(None).cast("long").alias("level"), duplicate, F.array_join("problems", "; ").alias("problems"), F.lit(0).cast("long").alias("repeated"),
        F.to_json(F.struct("arguments", F.col("call_id").alias("id"), F.col("tool").alias("name"), duplicate)).alias("json"),
    ).union(
        results.where("_nth > 1").select(
            "conv_id", "turn", "call_id", none, F.lit(None).cast("long"), duplicate, none, F.lit(0).cast("long"),
            F.to_json(F.struct(F.col("call_id").alias("id"), F.try_parse_json("content_json").alias("result"), duplicate)),
        )
    )
    calls = calls.where("_nth = 1").select("key", "scope", "conv_id", "call_id", (F.col("_of") - 1).alias("repeated"), "turn", "arguments_json", "tool", "after")
    results = results.where("_nth = 1").select(
        "key", F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"), (F.col("_of") - 1).alias("r_repeated"), F.col("turn").alias("r_turn"), "content_json", F.lit(True).alias("r_is")
    )
    in_conversation = F.transform("after", lambda a: F.concat_ws("\x1f", "scope", a))
    named, answers = calls.where("key is not null"), results.where("key is not null")
    ordered = levels(named.select("key", in_conversation.alias("after")))
    both = named.join(ordered, "key", "left").join(answers, "key", "full")
    # what has no identifier matches nothing, so it stays out of the join
    for alone in (calls, results):
        both = both.unionByName(alone.where("key is null"), allowMissingColumns=True)
    both = both.withColumn("arguments", F.try_parse_json("arguments_json"))
    both = both.withColumn("_given", given)
    has_call = F.col("repeated").isNotNull()
    both = both.withColumn("problems", F.when(has_call, problems))
    status = (
        F.when(~has_call, "orphan").when(F.size("problems") > 0, "invalid").when(F.col("level").isNull() & F.col("call_id").isNotNull(), "cyclic")
        .when(F.col("r_is").isNull(), "unanswered").otherwise("ok")
    )
    json = F.to_json(F.struct("arguments", F.coalesce("call_id", "r_call").alias("id"), "level", F.col("tool").alias("name"), F.try_parse_json("content_json").alias("result"), F.col("status").alias("status")))
    linked = both.withColumn("status", status).select(
        F.coalesce("conv_id", "r_conv").alias("conv_id"), F.coalesce("turn", "r_turn").alias("turn"), F.coalesce("call_id", "r_call").alias("call_id"), "tool", "level", "status",
        F.when(has_call, F.array_join("problems", "; ")).alias("problems"), (F.coalesce("repeated", F.lit(0)) + F.coalesce("r_repeated", F.lit(0))).alias("repeated"), json.alias("json"),
    )
    # duplicates come first, so that the linked rows of an identifier are the last ones read
    return duplicates.union(linked).union(other.select("conv_id", "turn", none, none, F.lit(None).cast("long"), F.lit("message"), none, F.lit(0).cast("long"), "json"))


def op5_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of `conversations`, linked; see `link` for nulls, repeated rows, ties and empty tables."""
    return link(table(spark, sf_dir, "conversations"))
