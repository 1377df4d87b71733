"""Chat formatting: links tool calls to their results and serialises them as canonical JSON.

Calls and results are hash-joined by (conversation, identifier). Calls may refer to the results of others by
``{"$ref": "<call id>"}`` in their arguments; they get the length of their longest chain of references
as level, so that ordering by (level, turn, position) is topological. Arguments are validated against tool
schemas. Canonical JSON has sorted keys and no white space. DataFrame functions only.

Defined cases: an identifier used by several calls of a conversation belongs to the first (by turn, position, name and
arguments, nulls last; of equal rows to one of them), the others get the error ``duplicate id``, no level and no result. A
call's first result (by turn, then content, nulls last) is linked, later ones are not; results without a call are returned by
``orphans``, messages that are neither by ``plain_messages``. A call on a cycle of references, or that refers to one, has a null level and
the error ``cycle``; references to unknown calls are the error ``unknown reference`` and don't count for the level. Null or invalid
arguments give ``invalid arguments``, unknown tools ``unknown tool``. Calls with a null conversation or identifier can't be
linked: the error is ``no id``, the level null. Null turns and positions stay null. Further columns are not read.

Chains of calls that refer to one other each are followed by pointer jumping, in logarithmically many joins; only calls
that refer to several take a round a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import keep

CALL = "conv_id long, call_id string, name string, arguments string, turn long, position int"
RESULT = "conv_id long, call_id string, content string, turn long"
_REF = r'"\$ref"\s*:\s*"([^"]+)"'

#: JSON types by the first word of a variant's schema.
_KINDS = {
    "STRING": "string", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number",
    "BOOLEAN": "boolean", "VOID": "null", "ARRAY": "array", "OBJECT": "object",
}


def canonical(text: Column) -> Column:
    """Canonical JSON of a JSON text: sorted keys, no white space; null if it is not JSON."""
    return F.to_json(F.try_parse_json(text))


def embedded_calls(messages: DataFrame) -> DataFrame:
    """Calls in assistant messages of the form {"tool_calls": [{"id", "name", "arguments"}]}."""
    shape = "tool_calls array<struct<id:string,name:string,arguments:string>>"
    found = messages.where("role = 'assistant' and ltrim(text) like '{%'")
    found = found.select("conv_id", "turn", F.posexplode(F.from_json("text", shape)["tool_calls"]).alias("position", "c"))
    return found.select("conv_id", F.col("c.id").alias("call_id"), "c.name", "c.arguments", "turn", "position")


def embedded_results(messages: DataFrame) -> DataFrame:
    """Results in tool messages of the form {"tool_call_id", "content"}."""
    found = messages.where("role = 'tool'").select("conv_id", "turn", F.from_json("text", "tool_call_id string, content string").alias("r"))
    return found.select("conv_id", F.col("r.tool_call_id").alias("call_id"), "r.content", "turn")


def exchange_calls(messages: DataFrame, tool: str = "reply") -> DataFrame:
    """Every user message as a call of ``tool``, which refers to the exchange before it, if there is one. Without a turn it has no identifier."""
    before = messages.where("role = 'user'").select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("follows")).distinct()
    rows = messages.where("role = 'user'").join(before, ["conv_id", "turn"], "left")
    name = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    ref = F.when(F.col("follows"), F.struct(F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 2).cast("string")).alias("$ref")))
    arguments = F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("text"), ref.alias("after")))
    return rows.select("conv_id", name.alias("call_id"), F.lit(tool).alias("name"), arguments.alias("arguments"), "turn", F.lit(0).alias("position"))


def exchange_results(messages: DataFrame) -> DataFrame:
    """Every assistant message as the result of the message right before it."""
    name = F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - 1).cast("string"))
    return messages.where("role = 'assistant'").select("conv_id", name.alias("call_id"), F.col("text").alias("content"), "turn")


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(key, errors) of the calls (key, name, arguments) that break their tool's schema.

    ``schemas`` has a row (name, argument, kind, required) for each argument of each tool; a tool without
    arguments has one row with a null argument. Kinds are JSON types; integers are numbers too.
    """
    parsed = calls.select("key", "name", F.try_parse_json("arguments").alias("v"))
    parsed = parsed.withColumn("is_object", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    tools = schemas.select("name").distinct().withColumn("known", F.lit(True))
    tested = parsed.join(tools, "name", "left")
    whole = tested.select("key", F.explode(F.array_compact(F.array(
        F.when(F.col("known").isNull(), F.lit("unknown tool")), F.when(~F.col("is_object"), F.lit("invalid arguments"))
    ))).alias("error"))
    good = tested.where("known and is_object")
    given = good.select("key", "name", F.explode(F.col("v").cast("map<string,variant>")).alias("argument", "value"))
    first = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    kinds = F.create_map(*(F.lit(x) for pair in _KINDS.items() for x in pair))
    given = given.select("key", "name", "argument", F.coalesce(kinds[first], F.lit("string")).alias("is"))
    fields = schemas.where("argument is not null")
    compared = given.join(fields, ["name", "argument"], "left")
    wrong = F.when(F.col("kind").isNull(), F.concat(F.lit("unexpected "), "argument")).when(
        ~((F.col("is") == F.col("kind")) | ((F.col("is") == "integer") & (F.col("kind") == "number")) | ((F.col("is") == "null") & ~F.col("required"))),
        F.concat(F.lit("type of "), "argument"),
    )
    typed = compared.select("key", wrong.alias("error")).where("error is not null")
    asked = good.select("key", "name").join(fields.where("required"), "name")
    missing = asked.join(given.select("key", "argument"), ["key", "argument"], "left_anti")
    missing = missing.select("key", F.concat(F.lit("missing "), "argument").alias("error"))
    return whole.unionByName(typed).unionByName(missing).groupBy("key").agg(F.array_sort(F.collect_set("error")).alias("errors"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): the longest chain of edges (node, needs) below each node; null on or above a cycle.

    Nodes that need just one other are chains, which pointer jumping follows in rounds as many as the logarithm of their
    length, to the first node below that needs none or several. Only those are then levelled one round a level.
    """
    edges = keep(edges.distinct(), "edges")
    single = edges.groupBy("node").agg(F.count("*").alias("n"), F.min("needs").alias("to")).where("n = 1")
    jumps = keep(single.select("node", "to", F.lit(1).cast("long").alias("steps")), "jumps")
    for _ in range(jumps.count().bit_length() + 1):
        onward = jumps.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"))
        if jumps.join(onward, "to", "left_semi").isEmpty():
            break
        nxt = jumps.join(onward, "to", "left")
        jumps = keep(nxt.select("node", F.coalesce("further", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "jumps")
    ends = jumps.select(F.col("node").alias("needs"), "to", "steps")
    anchors = nodes.join(jumps, "node", "left_anti").select("node")
    several = edges.join(jumps.select("node"), "node", "left_anti").join(ends, "needs", "left")
    several = several.select("node", F.coalesce("to", "needs").alias("needs"), F.coalesce("steps", F.lit(0)).alias("steps"))
    several = several.groupBy("node", "needs").agg(F.max("steps").alias("steps"))
    done = _anchor_levels(anchors, several)
    on_chains = jumps.join(done.withColumnRenamed("node", "to"), "to").select("node", (F.col("level") + F.col("steps")).alias("level"))
    return nodes.join(done.unionByName(on_chains), "node", "left")


def _anchor_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level) of nodes that edges (node, needs, steps) lead down from, one round a level; nodes on cycles are missing."""
    done = keep(nodes.join(edges, "node", "left_anti").select("node", F.lit(0).cast("long").alias("level")), "level")
    last, waiting = done, keep(edges.withColumn("at", F.lit(0).cast("long")), "edges")
    while not waiting.isEmpty() and not last.isEmpty():
        met = last.select(F.col("node").alias("needs"), "level")
        seen = waiting.join(met, "needs", "left")
        reached = F.coalesce(F.col("level") + F.col("steps"), F.lit(0))
        per_node = seen.groupBy("node").agg(F.count_if(F.col("level").isNull()).alias("open"), F.max(F.greatest("at", reached)).alias("at"))
        last = keep(per_node.where("open = 0").select("node", (F.col("at") + 1).alias("level")), "level")
        still = per_node.where("open > 0").select("node", "at")
        waiting = keep(seen.where("level is null").select("node", "needs", "steps").join(still, "node"), "edges")
        done = done.unionByName(last)
    return done


def _placed_last(*columns: str) -> Column:
    """A struct that sorts by the columns with nulls last."""
    return F.struct(*(c for name in columns for c in (F.col(name).isNull().alias(f"no_{name}"), F.col(name))))


def linked_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: conv_id, call_id, turn, position, level, result_turn, errors, json."""
    names = ["conv_id", "call_id", "name", "arguments", "turn", "position"]
    # Equal rows are one until the end, so that a repeated call stays one row of any join.
    distinct = calls.groupBy(*names).agg(F.count("*").alias("copies"))
    distinct = distinct.withColumn("key", F.when(F.col("conv_id").isNotNull(), F.concat(F.col("conv_id").cast("string"), F.lit(":"), "call_id")))
    distinct = distinct.withColumn("place", _placed_last("turn", "position", "name", "arguments"))
    owner = distinct.where("key is not null").groupBy("key").agg(F.min("place").alias("o"))
    owned = distinct.join(owner, "key", "left").withColumn("first", F.coalesce(F.col("place").eqNullSafe(F.col("o")) & F.col("key").isNotNull(), F.lit(False)))
    owned = keep(owned.drop("o", "place"), "calls")
    answers = results.where("conv_id is not null and call_id is not null")
    answers = answers.groupBy("conv_id", "call_id").agg(F.min(_placed_last("turn", "content")).alias("r"))
    nodes = owned.where("first").select(F.col("key").alias("node"))
    refs = owned.where("first").select(
        F.col("key").alias("node"), F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(_REF), 1))).alias("ref"), "conv_id"
    )
    refs = refs.select("node", F.concat_ws(":", F.col("conv_id").cast("string"), "ref").alias("needs"))
    edges = keep(refs.join(nodes.select(F.col("node").alias("needs"), F.lit(True).alias("there")), "needs", "left").distinct(), "refs")
    ordered = levels(nodes, edges.where("there").select("node", "needs"))
    lost = edges.where("there is null").select("node").distinct().withColumn("lost", F.lit(True))
    # What is wrong with arguments depends on the tool and the arguments alone; they are named by 128 bits.
    named = owned.withColumn("asked", F.md5(F.to_json(F.struct("name", "arguments"))))
    wrong = argument_errors(named.select(F.col("asked").alias("key"), "name", "arguments").distinct(), schemas)
    out = named.join(ordered.withColumnRenamed("node", "key"), "key", "left").join(lost.withColumnRenamed("node", "key"), "key", "left")
    out = out.join(wrong.withColumnRenamed("key", "asked"), "asked", "left").join(answers, ["conv_id", "call_id"], "left")
    out = out.withColumn("first", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "copies"), lambda k: F.col("first") & (k == 1))))
    level, result = F.when(F.col("first"), F.col("level")), F.when(F.col("first"), F.col("r"))
    errors = F.concat(
        F.coalesce("errors", F.array().cast("array<string>")),
        F.array_compact(F.array(
            F.when(F.col("key").isNull(), F.lit("no id")), F.when(F.col("key").isNotNull() & ~F.col("first"), F.lit("duplicate id")),
            F.when(F.col("first") & F.col("level").isNull(), F.lit("cycle")), F.when(F.col("first") & F.col("lost"), F.lit("unknown reference")),
        )),
    )
    parsed = F.try_parse_json("arguments")
    body = F.struct(
        F.coalesce(parsed, F.parse_json(F.lit("null"))).alias("arguments"), F.col("call_id").alias("id"), "name",
        F.when(result.isNotNull(), F.struct(result["content"].alias("content"), result["turn"].alias("turn"))).alias("result"), "turn",
    )
    return out.select(
        "conv_id", "call_id", "turn", "position", level.alias("level"), result["turn"].alias("result_turn"),
        errors.alias("errors"), F.to_json(body).alias("json"),
    )


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose identifier no call of their conversation has, null ones among them."""
    return results.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")


def plain_messages(messages: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """Messages of other roles than those that call or answer."""
    return messages.where(F.col("role").isNull() | ~F.col("role").isin(*roles))


def conversation_rows(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """All of conversations as rows of one shape: kind ``call`` (see ``linked_calls``), ``orphan`` and ``message``, each with its canonical JSON."""
    linked = linked_calls(calls, results, schemas)
    none = lambda kind: F.lit(None).cast(kind)
    empty = F.array().cast("array<string>").alias("errors")
    alone = orphans(calls, results).select(
        "conv_id", "call_id", "turn", none("int").alias("position"), none("long").alias("level"), F.col("turn").alias("result_turn"), empty,
        F.to_json(F.struct("content", F.col("call_id").alias("id"), "turn")).alias("json"),
    )
    other = plain_messages(messages, roles).select(
        "conv_id", none("string").alias("call_id"), "turn", none("int").alias("position"), none("long").alias("level"), none("long").alias("result_turn"), empty,
        F.to_json(F.struct(F.col("text").alias("content"), "role", "turn")).alias("json"),
    )
    tagged = [df.withColumn("kind", F.lit(kind)) for df, kind in ((linked, "call"), (alone, "orphan"), (other, "message"))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
