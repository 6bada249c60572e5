"""Chat formatting: tool calls are linked to their results, ordered, validated and written as canonical JSON.

A message of the assistant may be a JSON object with ``tool_calls``, a list of {id, name, arguments} or {id, function:
{name, arguments}}, and ``content``; a message of the role ``tool`` may be one with ``tool_call_id`` and ``content``. Every
other text is a plain message. Calls and results become rows of their own; what a message says beside its calls is a
message row before them.

* Linking: the calls and results of a (conversation, identifier) are counted and their first call is found by one
  aggregation, which is joined back by hash. A result belongs to the first call of its identifier; further calls of
  it are ``duplicate``, further results ``repeated``. A call without a result is ``unanswered``, a result without a
  call ``orphan``. Hot identifiers are pre-aggregated, and what has no identifier is not joined at all.
* Order: (conversation, place, depth, turn, part) is a topological order of messages, calls and results: a result's
  place is its own turn or, if that comes first, its call's, after the call. Results depend on one call and calls on
  nothing, so two sort columns place all and no window over a conversation is needed.
* Validation: arguments must be an object with all required parameters, each of its type, and no others.
* JSON: keys in order of their UTF-16 units at all levels (as RFC 8785 has it), no white space, null members of the message left out. Other members
  of a message, call, function or result are kept in its JSON, under ``extra`` if their name is taken by another value; of
  an object that cannot be read as a whole (a key twice, text after it) the text is kept as ``raw``.

All of it is DataFrame functions. Null text is an empty message; null roles stay null and are left out of the JSON; rows
without a conversation or turn are formatted but their calls and results link with nothing. Empty tables give
empty results; other columns are ignored, whatever their names; repeated rows are formatted each, and as they are the
same call or result, all have its status; a second call of an identifier at another place is a duplicate. Arguments with
a key twice are no object. Very long texts are parsed whole, one row at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tool schemas: for each tool its parameters, with their JSON type and whether they are required.
TOOLS: dict[str, dict[str, tuple[str, bool]]] = {
    "calculator": {"expression": ("string", True)},
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "weather": {"city": ("string", True), "days": ("integer", False), "metric": ("boolean", False)},
    "send_mail": {"to": ("array", True), "subject": ("string", False), "body": ("string", True), "options": ("object", False)},
    "convert": {"amount": ("number", True), "source": ("string", True), "target": ("string", True)},
}
_CALLS = "tool_calls ARRAY<STRUCT<id: STRING, name: STRING, arguments: STRING, function: STRING>>, content STRING"
_FUNCTION = "name STRING, arguments STRING"
_RESULT = "tool_call_id STRING, content STRING"
#: SQL types of JSON values as ``schema_of_variant`` names them.
_TYPES = {"string": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT"}


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and without white space; null if it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def errors(name: Column, arguments: Column, tools: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with a call, as a sorted array; empty if nothing is."""
    value = F.try_parse_json(arguments)
    known = F.lit(None).cast("array<string>")
    for tool, parameters in sorted(tools.items()):
        found = []
        for p, (kind, required) in sorted(parameters.items()):
            at = F.schema_of_variant(F.try_variant_get(value, f"$['{p}']", "variant"))
            missing = at.isNull() | (at == "VOID")
            found.append(F.when(missing, F.lit(f"missing {p}") if required else F.lit(None)).when(~at.rlike(_TYPES[kind]), F.lit(f"type {p}")))
        extra = F.transform(F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(p) for p in parameters]).cast("array<string>")), lambda k: F.concat(F.lit("unknown "), k))
        all_ = F.array_sort(F.array_compact(F.concat(F.array(*found).cast("array<string>"), extra)))
        known = F.when(name == tool, all_).otherwise(known)
    no_object = F.coalesce(~F.schema_of_variant(value).rlike("^OBJECT"), F.lit(True))
    return F.coalesce(F.when(no_object, F.array(F.lit("no object"))).otherwise(known), F.array(F.lit("unknown tool")))


def _entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("k"), value.alias("v"))


def _members(value: Column, known: Column) -> Column:
    """The members of a variant object that are neither known nor null, as (key, JSON); null if it is none."""
    all_ = F.transform(F.map_entries(value.try_cast("map<string,variant>")), lambda e: _entry(e["key"], F.to_json(e["value"])))
    return F.filter(all_, lambda e: ~F.array_contains(known, e["k"]) & e["v"].isNotNull() & (e["v"] != "null"))


def _object(entries: Column) -> Column:
    """An object of (key, JSON) entries, sorted by key."""
    keyed = F.transform(entries, lambda e: F.struct(F.encode(e["k"], "UTF-16BE").alias("at"), e["k"].alias("k"), e["v"].alias("v")))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(keyed), lambda e: F.concat(_quoted(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))


def _names(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _parts(df: DataFrame) -> DataFrame:
    """Messages, calls and results as rows: (conv_id, turn, part, kind, role, call_id, name, body, more)."""
    text = F.coalesce("text", F.lit(""))
    maybe = text.rlike(r"^\s*\{")
    said = F.when(maybe & (F.col("role") == "assistant") & text.contains("tool_calls"), F.from_json(text, _CALLS))
    result = F.when(maybe & (F.col("role") == "tool") & text.contains("tool_call_id"), F.from_json(text, _RESULT))
    none, nothing = F.lit(None).cast("string"), F.array().cast("array<struct<k:string,v:string>>")
    part = lambda kind, i, n, b, m: F.struct(F.lit(kind).alias("kind"), i.alias("call_id"), n.alias("name"), b.alias("body"), m.alias("more"))
    whole = F.try_parse_json(text)
    others = lambda *known: F.coalesce(_members(whole, _names(*known)), F.array(_entry(F.lit("raw"), _quoted(text))))
    given = F.try_variant_get(whole, "$.tool_calls", "array<variant>")

    def call(c: Column, i: Column) -> Column:
        function, own = F.from_json(c["function"], _FUNCTION), F.get(given, i)
        read = F.array_compact(F.array(F.when(c["name"].isNull(), F.lit("name")), F.when(c["arguments"].isNull(), F.lit("arguments"))))
        inside = F.try_variant_get(own, "$.function", "variant")
        left = _members(inside, read)
        unread = F.when(left.isNull(), F.to_json(inside)).when(F.size(left) > 0, _object(left))
        more = F.concat(F.coalesce(_members(own, _names("id", "name", "arguments", "function")), nothing), F.filter(F.array(_entry(F.lit("function"), unread)), lambda e: e["v"].isNotNull() & (e["v"] != "null")))
        return part("call", c["id"], F.coalesce(c["name"], function["name"]), F.coalesce(c["arguments"], function["arguments"], F.lit("{}")), more)

    beside = F.array(part("message", none, none, F.col("said")["content"], others("tool_calls", "content")))
    beside = F.filter(beside, lambda p: F.coalesce(F.length(p["body"]) > 0, F.lit(False)) | (F.size(F.filter(p["more"], lambda e: e != _entry(F.lit("role"), _quoted(F.col("role"))))) > 0))
    made = (
        F.when(F.size(F.col("said")["tool_calls"]) > 0, F.concat(beside, F.transform(F.col("said")["tool_calls"], call)))
        .when(F.col("result")["tool_call_id"].isNotNull(), F.array(part("result", F.col("result")["tool_call_id"], none, F.coalesce(F.col("result")["content"], F.lit("")), others("tool_call_id", "content"))))
        .otherwise(F.array(part("message", none, none, text, nothing)))
    )
    rows = df.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.select("conv_id", "turn", "role", "text", said.alias("said"), result.alias("result"))
    return rows.select("conv_id", "turn", "role", F.posexplode(made).alias("part", "p")).select("conv_id", "turn", "part", "role", "p.*")


def _json(fields: dict[str, Column], more: Column) -> Column:
    """An object of members that are JSON text already, and of more of them; null members are left out."""
    members = [F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(fields.items())]
    plain = F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    own = F.array(*[_entry(F.lit(k), v) for k, v in fields.items()])
    own = F.filter(own, lambda e: e["v"].isNotNull())
    free = F.filter(more, lambda e: ~e["k"].isin(*fields))
    taken = F.filter(more, lambda e: e["k"].isin(*fields) & ~F.exists(own, lambda o: o == e))
    extra = F.filter(F.array(_entry(F.lit("extra"), _object(taken))), lambda e: e["v"] != "{}")
    return F.when(F.size(more) == 0, plain).otherwise(_object(F.concat(own, free, extra)))


def _quoted(text: Column) -> Column:
    """A string as JSON; null stays null."""
    whole = F.to_json(F.struct(text.alias("s")))
    return F.when(text.isNotNull(), F.substr(whole, F.lit(6), F.length(whole) - 6))


def formatted(df: DataFrame, tools: dict[str, dict[str, tuple[str, bool]]] = TOOLS) -> DataFrame:
    """(conv_id, turn, part, kind, call_id, status, errors, place, depth, json) for each message, call and result."""
    parts = _parts(df)
    linked = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    here = F.struct("turn", "part")
    call = F.col("kind") == "call"
    keys = parts.where(linked).groupBy("conv_id", "call_id").agg(F.min(F.when(call, here)).alias("first"), F.min(F.when(~call, here)).alias("answer"))
    alone = parts.where(~linked).withColumns({"first": F.lit(None).cast(keys.schema["first"].dataType), "answer": F.lit(None).cast(keys.schema["answer"].dataType)})
    rows = parts.where(linked).join(keys.hint("shuffle_hash"), ["conv_id", "call_id"]).select(alone.columns).unionByName(alone)
    status = (
        F.when(call & F.coalesce(F.col("first") != here, F.lit(False)), "duplicate")
        .when(call, F.when(F.col("answer").isNotNull(), "answered").otherwise("unanswered"))
        .when(F.col("kind") == "result", F.when(F.col("first").isNull(), "orphan").when(F.col("answer") != here, "repeated").otherwise("linked"))
        .otherwise("message")
    )
    wrong = F.when(call, errors(F.col("name"), F.col("body"), tools))
    result = F.col("kind") == "result"
    place = F.when(result & F.col("first").isNotNull(), F.greatest(F.col("turn"), F.col("first")["turn"])).otherwise(F.col("turn"))
    depth = F.when(call, 1).when(result, 2).otherwise(0)
    plain = {"role": _quoted(F.col("role")), "id": _quoted(F.col("call_id"))}
    json = (
        F.when(call, _json(plain | {"arguments": F.coalesce(canonical(F.col("body")), _quoted(F.col("body"))), "name": _quoted(F.col("name"))}, F.col("more")))
        .when(result, _json(plain | {"content": _quoted(F.col("body"))}, F.col("more")))
        .otherwise(_json({"content": _quoted(F.col("body")), "role": plain["role"]}, F.col("more")))
    )
    return rows.select("conv_id", "turn", "part", "kind", "call_id", status.alias("status"), F.concat_ws("; ", wrong).alias("errors"), place.alias("place"), depth.alias("depth"), json.alias("json"))


#: The plain messages of a table, which holds no calls of tools.
SQL = """
SELECT conv_id, turn, 0 AS part, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, 'message' AS status, '' AS errors,
       turn AS place, 0 AS depth,
       '{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR)
           || coalesce(',"role":' || CAST(to_json(role) AS VARCHAR), '') || '}' AS json
FROM conversations
"""


def with_calls(conversations: DataFrame) -> DataFrame:
    """Conversations of tool calls (even turns) and results (odd turns) made from the turns of others: identifiers that come
    again, results before their call or without one, arguments right and wrong, unknown tools."""
    turn, text = F.col("turn"), lambda x: x.cast("string")
    name = F.when(turn % 3 == 2, "none").otherwise("search")
    arguments = F.when(turn % 3 == 0, '{"query":"q"}').otherwise('{"limit":"3"}')
    call = F.concat(F.lit('{"tool_calls":[{"id":"c'), text(turn % 6), F.lit('","name":"'), name, F.lit('","arguments":'), arguments, F.lit("}]}"))
    result = F.concat(F.lit('{"tool_call_id":"c'), text((turn + 1) % 8), F.lit('","content":"r"}'))
    even = turn % 2 == 0
    return conversations.select("conv_id", "turn", F.when(even, "assistant").otherwise("tool").alias("role"), F.when(even, call).otherwise(result).alias("text"))


LINKS_SQL = """
WITH p AS (SELECT conv_id, turn, turn % 2 = 0 AS is_call, CASE WHEN turn % 2 = 0 THEN 'c' || CAST(turn % 6 AS VARCHAR) ELSE 'c' || CAST((turn + 1) % 8 AS VARCHAR) END AS call_id FROM conversations),
k AS (SELECT conv_id, call_id, min(turn) FILTER (is_call) AS first_call, min(turn) FILTER (NOT is_call) AS answer FROM p GROUP BY ALL)
SELECT conv_id, turn, 0 AS part, CASE WHEN is_call THEN 'call' ELSE 'result' END AS kind, call_id,
       CASE WHEN is_call AND turn <> first_call THEN 'duplicate' WHEN is_call AND answer IS NOT NULL THEN 'answered' WHEN is_call THEN 'unanswered'
            WHEN first_call IS NULL THEN 'orphan' WHEN answer <> turn THEN 'repeated' ELSE 'linked' END AS status,
       CASE WHEN NOT is_call OR turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN 'missing query; type limit' ELSE 'unknown tool' END AS errors,
       CASE WHEN NOT is_call AND first_call IS NOT NULL THEN greatest(turn, first_call) ELSE turn END AS place,
       CASE WHEN is_call THEN 1 ELSE 2 END AS depth
FROM p JOIN k USING (conv_id, call_id)
"""
