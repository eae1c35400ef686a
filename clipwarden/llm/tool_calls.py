"""Chat formatting: tool calls linked to their results, ordered, checked and written as canonical JSON.

Calls and results meet in a hash join on (conversation, identifier).  A call
may name calls it waits for; calls are ordered by rounds of a join that settles
all calls whose predecessors are settled.  A conversation of any length spreads
over all tasks, as no step gathers one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clipwarden.operators.ordered import with_position

from .text import stored

def canonical(json_text: Column) -> Column:
    """JSON with sorted keys and no blanks; null for what is no JSON."""
    return F.to_json(F.try_parse_json(json_text))


def _kind(name: str) -> Column:
    """JSON type of a field of the arguments, null where the field is absent."""
    kind = F.schema_of_variant(F.try_variant_get(F.col("_args"), f"$['{name}']", "variant"))
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind == "BIGINT", "integer").when(kind == "VOID", "null")
        .when(kind.startswith("DECIMAL(") & kind.endswith(",0)"), "integer").when(kind.isNotNull(), "number")
    )


def complaints(tool: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with the arguments in ``_args``, sorted.

    ``schemas`` maps a tool to its fields as (type, required); a number may be
    an integer.  Fields a schema does not name are allowed.
    """
    found = F.when(~F.coalesce(tool.isin(*schemas), F.lit(False)), F.array(F.lit("unknown tool")))
    for name, fields in schemas.items():
        checks = []
        for field, (kind, required) in sorted(fields.items()):
            is_ = _kind(field)
            bad = (is_ != kind) & ~((F.lit(kind) == "number") & (is_ == "integer"))
            if required:
                checks.append(F.when(is_.isNull(), F.lit(f"{field}: missing")).when(bad, F.lit(f"{field}: not {kind}")))
            else:
                checks.append(F.when(bad, F.lit(f"{field}: not {kind}")))
        checks = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
        found = found.when((tool == name) & F.col("_args").isNull(), F.array(F.lit("arguments: no JSON"))).when(tool == name, checks)
    return found


def topological_levels(calls: DataFrame) -> DataFrame:
    """(conv, call, level) of ``calls`` (conv, call, after: array of calls of the same conversation).

    Level 0 waits for nothing.  Predecessors that do not exist are ignored; a
    call on a cycle, or behind one, has no row.
    """
    names = calls.select("conv", "call").distinct()
    waits = (
        calls.select("conv", "call", F.explode(F.array_distinct("after")).alias("on"))
        .join(names.withColumnRenamed("call", "on"), ["conv", "on"]).distinct()
    )
    waits = stored(waits)
    settled = stored(names.join(waits.select("conv", "call").distinct(), ["conv", "call"], "left_anti").withColumn("level", F.lit(0)))
    level, fresh, open_ = 0, settled, waits
    out = settled
    while True:
        # what waits for the calls just settled loses those reasons; who has none left is next
        open_ = stored(open_.join(fresh.select("conv", F.col("call").alias("on")), ["conv", "on"], "left_anti"))
        still = open_.select("conv", "call").distinct()
        freed = waits.join(fresh.select("conv", F.col("call").alias("on")), ["conv", "on"], "left_semi").select("conv", "call").distinct()
        level += 1
        fresh = stored(freed.join(still, ["conv", "call"], "left_anti").withColumn("level", F.lit(level)))
        if fresh.isEmpty():
            return out
        out = out.unionByName(fresh)


def format_calls(
    calls: DataFrame,
    results: DataFrame,
    schemas: dict[str, dict[str, tuple[str, bool]]],
) -> DataFrame:
    """One row per identifier of a conversation: conv, position, call, tool, level, valid, problems, n_calls, n_results, json.

    ``calls``: conv, call, turn, tool, arguments (JSON text), after (array of
    calls); ``results``: conv, call, turn, content.  ``position`` counts from 0
    in a conversation, by (level, turn, call); identifiers without a level come
    last.  Of several calls with one identifier the first by (turn, tool,
    arguments) counts and its problems end with "repeated call"; of several
    results the first by (turn, content).  ``n_calls`` and ``n_results`` tell
    how many there are.  A call without a result has ``result`` null in its
    JSON; results without a call are a row of their own with the problem
    "no call", no tool and no arguments.  Rows with a null conversation or
    identifier are left out, as nothing can link to them.
    """
    named = calls.filter(F.col("conv").isNotNull() & F.col("call").isNotNull())
    one = named.groupBy("conv", "call").agg(
        F.min_by(F.struct("turn", "tool", "arguments", "after"), F.struct("turn", "tool", "arguments")).alias("c"), F.count(F.lit(1)).alias("n_calls")
    ).select("conv", "call", "n_calls", "c.*")
    answers = (
        results.filter(F.col("conv").isNotNull() & F.col("call").isNotNull()).groupBy("conv", "call")
        .agg(F.min_by("content", F.struct("turn", "content")).alias("content"), F.min("turn").alias("_turn"), F.count(F.lit(1)).alias("n_results"))
    )
    zero = F.lit(0).cast("long")
    linked = one.join(answers, ["conv", "call"], "full").withColumns({
        "n_calls": F.coalesce("n_calls", zero), "n_results": F.coalesce("n_results", zero), "turn": F.coalesce("turn", "_turn"),
    })
    levels = topological_levels(one.select("conv", "call", "after"))
    checked = linked.join(levels, ["conv", "call"], "left").withColumn("_args", F.try_parse_json("arguments"))
    repeated = F.when(F.col("n_calls") > 1, F.array(F.lit("repeated call"))).otherwise(F.array().cast("array<string>"))
    problems = F.when(F.col("n_calls") == 0, F.array(F.lit("no call"))).otherwise(F.concat(complaints(F.col("tool"), schemas), repeated))
    text = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("_args"), F.lit("null")),
        F.lit(',"id":'), _json_string("call"), F.lit(',"name":'), _json_string("tool"),
        F.lit(',"result":'), _json_string("content"), F.lit("}"),
    )
    rows = stored(
        checked.select(
            "conv", "call", "tool", "turn", "level", problems.alias("problems"), "n_calls", "n_results", text.alias("json"),
        )
    )
    place = F.coalesce("level", F.lit(2**31 - 1))
    # levels keep the order, and hold about as many calls as turns do; a level of one conversation is cut by turn
    placed = with_position(
        rows.withColumn("_level", place), ["conv"], ["_level", "turn", "call"],
        F.struct("_level", F.floor(F.coalesce("turn", F.lit(0)) / 512).alias("_t")), "position",
    )
    return placed.select(
        "conv", F.col("position").cast("long").alias("position"), "call", "tool", "level",
        (F.size("problems") == 0).alias("valid"), "problems", "n_calls", "n_results", "json",
    )


def _json_string(name: str) -> Column:
    """A column of strings as JSON strings, null as null."""
    listed = F.to_json(F.array(F.col(name)))
    return F.when(F.col(name).isNull(), F.lit("null")).otherwise(F.substring(listed, F.lit(2), F.length(listed) - 2))
