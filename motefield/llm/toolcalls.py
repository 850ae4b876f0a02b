"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

Calls and results are hash-joined by conversation and identifier, each side first reduced to
one row for these by a partial aggregate (the least by turn, then name or content), so that a
repeated identifier links once; ``repeats`` counts the calls and results that it stands for
beyond the first of each. Equal identifiers of two conversations are two calls. A call may name
a parent call of its conversation whose result it uses; pointer
doubling over equi-joins gives each call the number of calls above it, its ``level``, in as many
rounds as the logarithm of the longest chain. Ordering by conversation, level, turn and
identifier is a topological order, in which ``in_order`` range-partitions and sorts the rows.
Arguments are parsed as a variant: what is no JSON object,
lacks a required argument, has one of another type or out of range, or one that the schema
does not name, is reported in ``violations``. The record is canonical JSON: object keys sorted,
no white space, nulls written.

``status`` is linked, pending (no result), orphan (a result without a call). Rows whose
conversation or identifier is null are left out of joins and appear as they are with status
unidentified. A
parent that does not exist makes a call a root; calls on a cycle, or under one, have a null
level. Tools without a schema give the violation ``unknown tool``. Empty tables give no rows;
other columns are not carried. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.storage import forget, materialize

#: Names of the types of arguments, and of Spark's variant types that fit them.
KINDS = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT<",
    "array": "^ARRAY<",
}


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls (conv_id, call_id, parent_id), the first two unique:
    the number of calls above."""
    known = calls.select(F.col("conv_id").alias("_v"), F.col("call_id").alias("_id"))
    first = calls.join(known, (F.col("conv_id") == F.col("_v")) & (F.col("parent_id") == F.col("_id")), "left")
    state = materialize(first.select("conv_id", "call_id", F.col("_id").alias("up"), F.when(F.col("_id").isNull(), 0).otherwise(1).cast("long").alias("level")), "levels")
    # a chain is no longer than there are calls; what stays open then lies on or under a cycle
    for _ in range(state.count().bit_length() + 1):
        if not state.where("up is not null").limit(1).count():
            break
        above = state.select(F.col("conv_id").alias("_v"), F.col("call_id").alias("_c"), F.col("up").alias("_up"), F.col("level").alias("_level"))
        after = state.join(above, (F.col("conv_id") == F.col("_v")) & (F.col("up") == F.col("_c")), "left")
        old, state = state, materialize(after.select("conv_id", "call_id", F.col("_up").alias("up"), (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level")), "levels")
        forget(old)
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def violations(arguments: Column, schema: Column) -> Column:
    """What is wrong with a variant of arguments under an array of argument rules."""
    given = arguments.cast("map<string,variant>")

    def broken(rule: Column) -> Column:
        value = F.element_at(given, rule["argument"])
        kind = F.schema_of_variant(value)
        number = F.try_variant_get(value, "$", "double")
        fits = F.lit(False)
        for name, pattern in KINDS.items():
            fits = fits | ((rule["type"] == name) & kind.rlike(pattern))
        return (
            F.when(value.isNull(), F.when(rule["required"], F.concat(F.lit("missing "), rule["argument"])))
            .when(~fits, F.concat(F.lit("type of "), rule["argument"]))
            .when(F.coalesce(number < rule["minimum"], F.lit(False)) | F.coalesce(number > rule["maximum"], F.lit(False)), F.concat(F.lit("range of "), rule["argument"]))
        )

    unknown = F.transform(F.array_except(F.map_keys(given), F.transform(schema, lambda r: r["argument"])), lambda k: F.concat(F.lit("unknown "), k))
    told = F.array_sort(F.concat(F.filter(F.transform(schema, broken), lambda v: v.isNotNull()), unknown))
    return (
        F.when(schema.isNull(), F.array(F.lit("unknown tool")))
        .when(F.coalesce(~F.schema_of_variant(arguments).startswith("OBJECT<"), F.lit(True)), F.array(F.lit("not an object")))
        .otherwise(told)
    )


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each conversation and identifier of ``calls`` (conv_id, turn, call_id,
    parent_id, name, arguments: JSON text) and ``results`` (conv_id, turn, call_id, content),
    under ``schemas`` (tool, argument, type, required, minimum, maximum).
    """
    named = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()
    call = calls.where(named).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "parent_id")).alias("c"), (F.count("*") - 1).alias("more"))
    call = materialize(call.select("conv_id", "call_id", F.col("c.turn").alias("turn"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.parent_id").alias("parent_id"), "more"), "calls")
    result = results.where(named).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), (F.count("*") - 1).alias("r_more")).withColumn("found", F.lit(True))
    # no more entries than the rules of one tool; written, so that the join can split the calls of a very common tool
    tools = materialize(schemas.groupBy(F.col("tool").alias("name")).agg(F.collect_list(F.struct("argument", "type", F.coalesce("required", F.lit(False)).alias("required"), "minimum", "maximum")).alias("schema")), "tools")
    linked = (
        call.withColumn("called", F.lit(True)).join(levels(call.select("conv_id", "call_id", "parent_id")), ["conv_id", "call_id"]).join(tools, "name", "left")
        .join(result.hint("shuffle_hash"), ["conv_id", "call_id"], "full")
        .withColumn("parsed", F.try_parse_json("arguments"))
        .withColumn("status", F.when(F.col("called").isNull(), "orphan").when(F.col("found").isNull(), "pending").otherwise("linked"))
        .withColumn("violations", F.when(F.col("called"), violations(F.col("parsed"), F.col("schema"))))
        .withColumn("repeats", F.coalesce("more", F.lit(0)) + F.coalesce("r_more", F.lit(0)))
        .select("conv_id", "call_id", "name", "parent_id", "turn", F.col("r.turn").alias("result_turn"), "level", "status", "violations", "repeats", "parsed", F.col("r.content").alias("result"))
    )
    absent = {"turn": "long", "result_turn": "long", "level": "long", "name": "string", "parent_id": "string", "violations": "array<string>", "result": "string"}
    null = {c: F.lit(None).cast(kind).alias(c) for c, kind in absent.items()}
    lost = calls.where(~named).select("conv_id", "call_id", "name", "parent_id", "turn", null["result_turn"], null["level"], F.lit("unidentified").alias("status"), null["violations"], F.lit(0).cast("long").alias("repeats"), F.try_parse_json("arguments").alias("parsed"), null["result"])
    stray = results.where(~named).select("conv_id", "call_id", null["name"], null["parent_id"], null["turn"], F.col("turn").alias("result_turn"), null["level"], F.lit("unidentified").alias("status"), null["violations"], F.lit(0).cast("long").alias("repeats"), F.try_parse_json(F.lit(None).cast("string")).alias("parsed"), F.col("content").alias("result"))
    rows = linked.unionByName(lost).unionByName(stray)
    # a variant's own text has its keys sorted; the outer keys are named in order
    record = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("parsed"), F.lit("null")),
        F.lit(',"id":'), text_json("call_id"), F.lit(',"level":'), F.coalesce(F.col("level").cast("string"), F.lit("null")),
        F.lit(',"name":'), text_json("name"), F.lit(',"result":'), text_json("result"), F.lit("}"),
    )
    return rows.withColumn("record", record).withColumn("valid", F.size("violations") == 0).drop("parsed", "result")


def in_order(linked: DataFrame) -> DataFrame:
    """The rows of ``link_tool_calls`` in topological order: a conversation's calls by level, so
    each behind its parent, then by turn and identifier; calls without a level come last."""
    return linked.orderBy("conv_id", F.col("level").asc_nulls_last(), F.coalesce("turn", "result_turn"), "call_id")


def text_json(name: str) -> Column:
    """A string column as a JSON string, null as null."""
    held = F.to_json(F.struct(F.col(name).alias("v")))
    return F.when(F.col(name).isNull(), F.lit("null")).otherwise(held.substr(F.lit(6), F.length(held) - 6))


def conversation_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of plain conversations: each user turn calls ``answer``, or ``explain``
    where it is over 200 code points, with its text, its length and its opening words as
    arguments, and follows the user turn two before it; the assistant turn after it holds the
    result. Turns of other roles are neither.
    """
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    turn, text = F.col("turn").cast("long"), F.coalesce("text", F.lit(""))
    user = messages.where("role = 'user'").select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), name(F.col("turn")).alias("call_id"), name(F.col("turn") - 2).alias("parent_id"),
        F.when(F.length(text) > 200, "explain").otherwise("answer").alias("name"),
        F.to_json(F.struct(text.alias("prompt"), F.length(text).alias("chars"), F.substring(text, 1, 16).alias("opening"))).alias("arguments"),
    )
    assistant = messages.where("role = 'assistant'").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return user, assistant
