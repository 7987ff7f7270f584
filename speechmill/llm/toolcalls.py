"""Chat formatting: tool calls linked to their results, by DataFrame functions only.

Calls and results meet in a hash join on (conv_id, call_id). A call may name the call it follows
from (``after``); the depth in that forest gives a topological order, found by pointer doubling:
every round joins each unresolved call with the one it points to, so a chain of n calls takes
log2(n) rounds, and calls on a cycle are recognised when a round resolves nothing. Arguments are
checked against a schema per tool name, and each pair becomes one canonical JSON string (keys in
order, no white space) through the variant type. All keys hold the call_id, so no conversation,
however long, is gathered into one task or one row.

Defined cases: of calls with the same id in a conversation the earliest (turn, then name and
arguments) stands and ``n_calls`` tells how many there were; of several results likewise
(``n_results``). A result without a call is a row of status ``orphan``, a call without a result
``open``. Rows with a null conv_id or call_id can't be linked: they are kept, each by itself, as
``open`` or ``orphan``. An ``after`` that names no call counts as none. Depth -1: on or behind a cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechmill.llm.common import staged, table

#: tool name -> field -> (type, required); types as JSON Schema names them
Schemas = dict[str, dict[str, tuple[str, bool]]]
_VARIANT_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$", "boolean": "^BOOLEAN$", "object": "^OBJECT<", "array": "^ARRAY<"}


def _quoted(c: Column) -> Column:
    """A string as a JSON value, null as null."""
    s = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.when(c.isNull(), "null").otherwise(s.substr(F.lit(2), F.length(s) - 2))


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) of calls(conv_id, call_id, after), whose ids are unique."""
    own = calls.select("conv_id", "call_id")
    known = own.withColumnRenamed("call_id", "after").withColumn("known", F.lit(True))
    state = staged(
        calls.join(known, ["conv_id", "after"], "left").select("conv_id", "call_id", F.when(F.col("known"), F.col("after")).alias("jump"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth")),
        "depth",
    )
    open_rows = state.where("jump is not null").count()
    while open_rows:
        to = state.select("conv_id", F.col("call_id").alias("jump"), F.col("jump").alias("next"), F.col("depth").alias("more"))
        waiting = state.where("jump is not null").join(to, ["conv_id", "jump"]).select("conv_id", "call_id", F.col("next").alias("jump"), (F.col("depth") + F.col("more")).alias("depth"))
        state = staged(state.where("jump is null").unionByName(waiting), "depth")
        left = state.where("jump is not null").count()
        if left == open_rows:  # only cycles are left
            break
        open_rows = left
    return state.select("conv_id", "call_id", F.when(F.col("jump").isNull(), F.col("depth")).otherwise(-1).alias("depth"))


def _problems(name: Column, args: Column, schemas: Schemas) -> Column:
    """The faults of ``args`` (a variant, null if it wasn't JSON) joined by ';', '' if none."""
    per_tool = F.when(args.isNull(), "arguments:not json").when(~F.schema_of_variant(args).startswith("OBJECT<"), "arguments:not an object")
    for tool, fields in schemas.items():
        faults = []
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_variant_get(args, f"$.{field}", "variant")
            missing = value.isNull() | F.is_variant_null(value)
            wrong = ~F.schema_of_variant(value).rlike(_VARIANT_TYPES[kind])
            faults.append(F.when(missing, F.lit(f"{field}:missing" if required else None)).when(wrong, f"{field}:not {kind}"))
        per_tool = per_tool.when(name == tool, F.concat_ws(";", *faults) if faults else F.lit(""))
    return per_tool.otherwise("name:unknown")


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """calls(conv_id, call_id, turn, name, arguments, after) with results(conv_id, call_id, turn, content).

    Returns conv_id, call_id, turn, status, depth, n_calls, n_results, problems, json.
    """
    keys = ["conv_id", "call_id"]
    calls = calls.select(*keys, "turn", "name", "arguments", "after")
    results = results.select(*keys, "turn", "content")
    has_id = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    one_call = (
        calls.where(has_id)
        .groupBy(*keys)
        .agg(F.min(F.struct(F.coalesce("turn", F.lit(2**62)).alias("o"), "name", "arguments", "after", "turn")).alias("c"), F.count("*").alias("n_calls"))
        .select(*keys, "c.turn", "c.name", "c.arguments", "c.after", "n_calls")
        .unionByName(calls.where(~has_id).withColumn("n_calls", F.lit(1).cast("long")))
    )
    one_result = (
        results.where(has_id)
        .groupBy(*keys)
        .agg(F.min(F.struct(F.coalesce("turn", F.lit(2**62)).alias("o"), "content", "turn")).alias("r"), F.count("*").alias("n_results"))
        .select(*keys, F.col("r.turn").alias("result_turn"), "r.content", "n_results")
        .unionByName(results.where(~has_id).select(*keys, F.col("turn").alias("result_turn"), "content", F.lit(1).cast("long").alias("n_results")))
    )
    depth = depths(one_call.where(has_id).select(*keys, "after"))
    linked = one_call.join(one_result, keys, "full").join(depth, keys, "left")
    args = F.try_parse_json("arguments")
    ok_args = F.when(args.isNotNull(), F.col("arguments")).otherwise(_quoted(F.col("arguments")))
    raw = F.concat(F.lit('{"arguments":'), ok_args, F.lit(',"id":'), _quoted(F.col("call_id")), F.lit(',"name":'), _quoted(F.col("name")), F.lit(',"result":'), _quoted(F.col("content")), F.lit("}"))
    status = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "open").otherwise("linked")
    return linked.select(
        *keys,
        F.coalesce("turn", "result_turn").alias("turn"),
        status.alias("status"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.when(status == "orphan", "").otherwise(_problems(F.col("name"), args, schemas)).alias("problems"),
        F.to_json(F.parse_json(raw)).alias("json"),
    )


#: The schema that turns of ``conversations`` are checked against, as calls of one tool.
REPLY: Schemas = {"reply": {"text": ("string", True), "turn": ("integer", True)}}


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conversations`` as calls and results: a turn that isn't the assistant's asks for a reply
    (its id is its turn, it follows from the turn two before), the assistant's next turn is the
    result. The ids are strings as tools send them."""
    call = (
        turns.where("role is distinct from 'assistant'")
        .select("conv_id", F.col("turn").cast("string").alias("call_id"), "turn", F.lit("reply").alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"), (F.col("turn") - 2).cast("string").alias("after"))
    )
    result = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), "turn", F.col("text").alias("content"))
    return call, result


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(*from_turns(table(spark, sf_dir, "conversations")), REPLY)


QUERIES = {"op1_tool_calls": op1_tool_calls}
ORACLE = {
    "op1_tool_calls": """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, min(text) AS text, count(*) AS n FROM conversations WHERE role <> 'assistant' GROUP BY ALL),
r AS (
  SELECT conv_id, turn - 1 AS turn, min(text) AS text, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL),
d AS (
  SELECT conv_id, turn, 0 AS depth FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL
  SELECT c.conv_id, c.turn, d.depth + 1 FROM d JOIN c ON c.conv_id = d.conv_id AND c.turn = d.turn + 2)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, CAST(coalesce(c.turn, r.turn) AS VARCHAR) AS call_id,
  coalesce(c.turn, r.turn + 1) AS turn,
  CASE WHEN c.n IS NULL THEN 'orphan' WHEN r.n IS NULL THEN 'open' ELSE 'linked' END AS status,
  CAST(coalesce(d.depth, 0) AS BIGINT) AS depth, coalesce(c.n, 0) AS n_calls, coalesce(r.n, 0) AS n_results,
  CASE WHEN c.n IS NOT NULL AND c.text IS NULL THEN 'text:missing' ELSE '' END AS problems,
  '{"arguments":' || CASE WHEN c.n IS NULL THEN 'null' ELSE '{' || coalesce('"text":' || CAST(to_json(c.text) AS VARCHAR) || ',', '') || '"turn":' || c.turn || '}' END
    || ',"id":"' || coalesce(c.turn, r.turn) || '","name":' || CASE WHEN c.n IS NULL THEN 'null' ELSE '"reply"' END
    || ',"result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || '}' AS json
FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn LEFT JOIN d ON d.conv_id = c.conv_id AND d.turn = c.turn
"""
}
