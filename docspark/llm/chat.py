"""Chat formatting: linking tool calls with their results.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stored
from .mixing import n_words

_MESSAGE = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>,tool_call_id:string,content:string>"
#: The JSON types a schema may ask for, and what Spark calls them.
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DECIMAL.*|DOUBLE|FLOAT)", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def _argument_problems(args: Column, params: Column) -> Column:
    """Array of 'missing:p', 'type:p', 'unexpected:p' for a map of variants against an array of {name, type, required}."""
    def type_ok(p: Column) -> Column:
        kind = F.schema_of_variant(F.element_at(args, p["name"]))
        out = F.lit(False)
        for name, pattern in _TYPES.items():
            out = F.when(p["type"] == name, kind.rlike(f"^{pattern}$")).otherwise(out)
        return out

    has = lambda p: F.array_contains(F.map_keys(args), p["name"])
    missing = F.transform(F.filter(params, lambda p: p["required"] & ~has(p)), lambda p: F.concat(F.lit("missing:"), p["name"]))
    wrong = F.transform(F.filter(params, lambda p: has(p) & ~type_ok(p)), lambda p: F.concat(F.lit("type:"), p["name"]))
    extra = F.transform(F.array_except(F.map_keys(args), F.transform(params, lambda p: p["name"])), lambda k: F.concat(F.lit("unexpected:"), k))
    return F.concat(F.sort_array(missing), F.sort_array(wrong), F.sort_array(extra))


def _late_order(edges: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Where calls and results go that wait for something later than themselves: (conv_id, at, after, depth), and (conv_id, at) of those in or behind a cycle.

    ``edges`` (conv_id, at, dep): places that must come after others.  Where all depend on earlier places only, these are an order already: None.  Otherwise the stretch between
    the first place that waits and the last one waited for is peeled in rounds: a place whose dependencies are all known follows the last of them, ``depth`` of them in a row.
    There are as many rounds as places in the longest chain of such a stretch; what no round reaches is cyclic.
    """
    stretch = edges.where("dep >= at").groupBy("conv_id").agg(F.min("at").alias("lo"), F.max("dep").alias("hi"))
    if stretch.isEmpty():
        return None
    left = stored(edges.join(stretch, "conv_id").where("at >= lo and at <= hi and dep >= lo").select("conv_id", "at", "dep").distinct(), "waiting")
    placed = stored(left.limit(0).select("conv_id", "at", F.col("at").alias("after"), F.lit(0).alias("depth")), "placed")
    while True:
        waiting = left.select("conv_id", F.col("at").alias("dep"), F.lit(1).alias("open")).distinct()
        known = placed.select("conv_id", F.col("at").alias("dep"), "after", "depth")
        best = F.max(F.struct(F.coalesce("after", "dep").alias("after"), F.coalesce("depth", F.lit(0)).alias("depth")))
        ready = left.join(waiting, ["conv_id", "dep"], "left").join(known, ["conv_id", "dep"], "left").groupBy("conv_id", "at").agg(F.count("open").alias("n"), best.alias("best")).where("n = 0")
        behind = F.col("best.after") > F.col("at")
        ready = stored(ready.select("conv_id", "at", F.when(behind, F.col("best.after")).otherwise(F.col("at")).alias("after"), F.when(behind, F.col("best.depth") + 1).otherwise(0).alias("depth")), "ready")
        if ready.isEmpty():
            return placed.where("depth > 0"), left.select("conv_id", "at").distinct()
        placed = stored(placed.unionByName(ready), "placed")
        left = stored(left.join(ready, ["conv_id", "at"], "left_anti"), "waiting")


def link_tool_calls(messages: DataFrame, tools: DataFrame, block: int = 1000, broadcast_tools: int = 10_000) -> DataFrame:
    """A row per call, per result and per other message: conv_id, turn, idx, role, kind, call_id, problems, seq, json.

    ``messages`` (conv_id, turn, role, text): an assistant's text may be JSON with tool_calls [{id, name, arguments}], a tool's one with
    tool_call_id and content; ``tools`` (name, params: array of {name, type, required}), sent to all tasks if ``broadcast_tools`` rows at most.  A tool listed twice counts with the least of its parameter lists.
    Calls and results of a conversation are joined by id.  An argument "$id" refers to the result of that call.  ``seq`` is the place in a topological order:
    results after their calls, calls after the results (or, unanswered, the calls) they refer to; each row stays at its place (turn, kind, idx, id) unless it waits for a later one, which it then follows.
    Calls in or behind a cycle of references stay in place and are flagged.  Places are counted from block counts (``block`` turns each), so that no conversation is sorted whole in one task.
    ``problems`` (sorted parts, comma-joined, empty if none): bad json, unknown tool, missing/type/unexpected:argument, reference:id (of no call), cycle, no result, duplicate id for
    calls; orphan, duplicate id for results.  ``json``: canonical, keys sorted: the call with arguments and result, or the message.

    Null text is an empty message, null turn or conv_id sorts first; a null conv_id links with no call; duplicates of an id are kept and flagged, the first call of an id and
    its first result with the least content count.
    """
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("m", F.when(F.col("role").isin("assistant", "tool") & F.col("text").startswith("{"), F.from_json("text", _MESSAGE)))
    is_call = F.coalesce((F.col("role") == "assistant") & (F.size("m.tool_calls") > 0), F.lit(False))
    is_result = F.coalesce((F.col("role") == "tool") & F.col("m.tool_call_id").isNotNull(), F.lit(False))
    none = F.lit(None).cast("string")
    item = lambda idx, kind, call_id, name, arguments, text: F.struct(idx.cast("int").alias("idx"), F.lit(kind).alias("kind"), call_id.alias("call_id"), name.alias("name"), arguments.alias("arguments"), text.alias("text"))
    items = F.when(is_call, F.transform("m.tool_calls", lambda c, i: item(i, "call", c["id"], c["name"], c["arguments"], none)))
    items = items.when(is_result, F.array(item(F.lit(0), "result", F.col("m.tool_call_id"), none, none, F.coalesce("m.content", F.lit("")))))
    items = items.otherwise(F.array(item(F.lit(0), "message", none, none, none, F.col("text"))))
    # Parsed once, as a table; calls, results and messages are read from it.
    items = stored(rows.select("conv_id", "turn", "role", F.explode(items).alias("i")).select("conv_id", "turn", "role", "i.*"), "items")
    calls, results, others = (items.where(F.col("kind") == k).drop("kind") for k in ("call", "result", "message"))
    at = lambda turn, kind, idx, call_id: F.struct(turn.cast("long").alias("turn"), F.lit(kind).alias("kind"), idx.cast("int").alias("idx"), F.coalesce(call_id, F.lit("")).alias("id"))

    by_call = stored(calls.groupBy("conv_id", "call_id").agg(F.count("*").alias("n_calls"), F.min(F.struct("turn", "idx")).alias("first")), "calls")
    by_result = stored(results.groupBy("conv_id", "call_id").agg(F.count("*").alias("n_results"), F.min(F.struct("turn", "text")).alias("result")), "results")
    calls = calls.withColumn("json", F.try_parse_json("arguments"))
    calls = calls.withColumn("args", F.coalesce(F.col("json").try_cast("map<string,variant>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))))
    known = tools.groupBy("name").agg(F.min("params").alias("params"))
    if known.count() <= broadcast_tools:
        known = F.broadcast(known)
    calls = calls.join(known, "name", "left")
    strings = F.filter(F.transform(F.map_values("args"), lambda v: F.try_variant_get(v, "$", "string")), lambda s: s.startswith("$"))
    calls = calls.withColumn("refs", F.sort_array(F.array_distinct(F.transform(strings, lambda s: F.substring(s, 2, 1_000_000)))))
    no = F.array().cast("array<string>")
    one = lambda test, text: F.when(test, F.array(F.lit(text))).otherwise(no)
    schema_faults = F.concat(
        one(~F.coalesce(F.schema_of_variant("json").startswith("OBJECT"), F.lit(False)), "bad json"),
        one(F.col("params").isNull(), "unknown tool"),
        F.coalesce(_argument_problems(F.col("args"), F.col("params")), no),
    )
    calls = calls.select("conv_id", "turn", "idx", "role", "call_id", "name", "refs", F.to_json("json").alias("arguments"), schema_faults.alias("faults"))
    calls = stored(calls.withColumn("at", at(F.col("turn"), "call", F.col("idx"), F.col("call_id"))), "checked")
    # References, resolved by id: one row per (call, reference), then back to the call as an array of those that fail.
    wanted = calls.select("conv_id", "at", F.explode("refs").alias("ref"))
    found = wanted.join(by_call.select("conv_id", F.col("call_id").alias("ref"), "first").hint("shuffle_hash"), ["conv_id", "ref"], "left")
    found = stored(found.join(by_result.select("conv_id", F.col("call_id").alias("ref"), F.col("result.turn").alias("answered")).hint("shuffle_hash"), ["conv_id", "ref"], "left"), "references")
    failed = found.where("first is null").groupBy("conv_id", "at").agg(F.sort_array(F.collect_set("ref")).alias("failed"))
    results = results.withColumn("at", at(F.col("turn"), "result", F.col("idx"), F.col("call_id")))
    results = results.join(by_call.select("conv_id", "call_id", "first").hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    dep = F.when(F.col("answered").isNotNull(), at(F.col("answered"), "result", F.lit(0), F.col("ref"))).otherwise(at(F.col("first.turn"), "call", F.col("first.idx"), F.col("ref")))
    edges = found.where("first is not null").select("conv_id", "at", dep.alias("dep"))
    edges = edges.unionByName(results.where("first is not null").select("conv_id", "at", at(F.col("first.turn"), "call", F.col("first.idx"), F.col("call_id")).alias("dep")))
    late = _late_order(edges)

    calls = calls.join(failed.hint("shuffle_hash"), ["conv_id", "at"], "left").join(by_result.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(by_call.select("conv_id", "call_id", "n_calls").hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    calls = calls.withColumn("cyclic", F.lit(False)) if late is None else calls.join(late[1].withColumn("cyclic", F.lit(True)), ["conv_id", "at"], "left")
    problems = F.concat(
        "faults",
        F.coalesce(F.transform("failed", lambda r: F.concat(F.lit("reference:"), r)), no),
        one(F.col("cyclic"), "cycle"),
        one(F.col("n_results").isNull(), "no result"),
        one((F.col("n_calls") > 1) | (F.col("n_results") > 1), "duplicate id"),
    )
    body = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.coalesce("call_id", F.lit("")).alias("id"), F.coalesce("name", F.lit("")).alias("name"), F.col("refs"), F.coalesce("result.text", F.lit("")).alias("result"), "role"))
    done = calls.select("conv_id", "turn", "idx", "role", F.lit("call").alias("kind"), "call_id", "at", F.array_join(problems, ",").alias("problems"), body.alias("json"))
    results = results.join(by_result.select("conv_id", "call_id", "n_results").hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    faults = F.concat(one(F.col("first").isNull(), "orphan"), one(F.col("n_results") > 1, "duplicate id"))
    done = done.unionByName(results.select("conv_id", "turn", "idx", "role", F.lit("result").alias("kind"), "call_id", "at", F.array_join(faults, ",").alias("problems"), F.to_json(F.struct(F.col("text").alias("content"), F.col("call_id").alias("id"), "role")).alias("json")))
    place = at(F.col("turn"), "message", F.col("idx"), F.col("call_id"))
    done = done.unionByName(others.select("conv_id", "turn", "idx", "role", F.lit("message").alias("kind"), "call_id", place.alias("at"), F.lit("").alias("problems"), F.to_json(F.struct(F.col("text").alias("content"), F.coalesce("role", F.lit("")).alias("role"))).alias("json")))
    if late is None:
        done = done.withColumn("after", F.col("at")).withColumn("depth", F.lit(0))
    else:
        done = done.join(late[0], ["conv_id", "at"], "left").withColumn("after", F.coalesce("after", "at")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    done = stored(done.withColumn("block", F.floor(F.coalesce("after.turn", F.lit(-1)) / block)), "linked")
    counts = done.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    counts = counts.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), (F.sum("n").over(W.partitionBy("conv_id").orderBy("block")) - F.col("n")).alias("before"))
    placed = done.join(counts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
    place = F.row_number().over(W.partitionBy("conv_id", "block").orderBy("after", "depth", "at", "json"))
    return placed.select("conv_id", "turn", "idx", "role", "kind", "call_id", "problems", (F.col("before") + place).alias("seq"), "json")


def chats_as_tool_calls(conversations: DataFrame) -> DataFrame:
    """Plain conversations as tool traffic: a user's turn calls the tool 'answer' (or 'explain' from 60 words on), the turn after it, if
    the assistant's, is the result.  A call refers to the call two turns before it; system turns stay messages."""
    words = n_words(F.col("text"))
    call_id = lambda k: F.concat(F.lit("c"), F.col("turn") - k)
    after = F.when(F.col("turn") >= 2, F.concat(F.lit("$"), call_id(2)))
    arguments = F.to_json(F.struct(words.alias("words"), F.coalesce("text", F.lit("")).alias("text"), after.alias("after")))
    call = F.to_json(F.struct(F.array(F.struct(call_id(0).alias("id"), F.when(words < 60, "answer").otherwise("explain").alias("name"), arguments.alias("arguments"))).alias("tool_calls")))
    result = F.to_json(F.struct(call_id(1).alias("tool_call_id"), F.coalesce("text", F.lit("")).alias("content")))
    role = F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", result).otherwise(F.col("text")).alias("text"))
