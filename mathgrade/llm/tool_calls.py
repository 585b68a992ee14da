"""Tool-call linking and canonical JSON chat messages, in DataFrame operations only.

Input is a table of messages: conv_id, turn, role, text, and for tool use
``call`` (id, name, arguments as JSON text, depends_on ids) on a calling message
and ``answers`` (the id a result belongs to) on a result. ``link``

* hash-joins results to calls by (conversation, identifier). The first call of
  an identifier (by turn, then content) owns it, the first result after it
  answers it;
* orders calls topologically by their dependencies: the level of a call is the
  length of its longest chain of dependencies. Chains of calls with one
  dependency each are followed by doubling: a round joins every call to the one
  that its pointer points to and takes over that one's pointer, so a chain of n
  calls takes about log2(n) rounds. Calls with several dependencies are placed
  by rounds between them, over chains that are one step long by then;
* validates arguments against the tool's schema (types, bounds, lengths,
  allowed values, required and unexpected names);
* serialises each message as canonical JSON: sorted keys, no blanks, minimal
  escapes, numbers as the JSON parser normalises them.

One row per message comes out; (conv_id, level, call_turn, part, turn) orders a
conversation. No conversation is gathered into one row or task.

Definitions for odd input, by ``status``: ``no_result``, ``duplicate_call``
(an identifier used again), ``orphan_result`` (no such call, or it comes before
the call), ``extra_result`` (the call is answered already), ``cycle`` (a
dependency cycle, or a call behind one: level -1), ``plain``, ``ok``. A
dependency on an unknown identifier is an error and otherwise ignored. A null
conv_id is a conversation of its own, a null turn comes first, null texts
serialise as null. Arguments that aren't a JSON object are an error and
serialise as null. Repeated rows are repeated calls or results, as above. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, word_count

#: Tool -> parameter -> constraints, in the order of the reported errors. The registered query's tools.
SCHEMAS: dict[str, dict[str, dict]] = {
    "lookup": {"offset": {"type": "integer", "required": True, "minimum": 0}, "query": {"type": "string", "required": True}},
    "note": {"body": {"type": "string", "required": True, "maxLength": 1000}, "pinned": {"type": "boolean"}},
    "search": {"exact": {"type": "boolean"}, "limit": {"type": "integer", "required": True, "minimum": 1, "maximum": 100},
               "mode": {"type": "string", "enum": ["all", "any"]}, "query": {"type": "string", "required": True, "minLength": 1}},
}
MAX_ROUNDS = 10_000
_KEY = ["conv_id", "call_id"]


def json_string(c: Column) -> Column:
    """A string as a JSON value (null: null)."""
    text = F.to_json(F.array(c))
    return F.coalesce(text.substr(F.lit(2), F.length(text) - 2), F.lit("null"))


def _typed(value: Column, kind: str) -> Column:
    t = F.schema_of_variant(value)
    integral = t.isin("BIGINT") | t.rlike(r"^DECIMAL\(\d+,0\)$")
    tests = {"string": t == "STRING", "boolean": t == "BOOLEAN", "integer": integral,
             "number": integral | t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"),
             "array": t.startswith("ARRAY"), "object": t.startswith("OBJECT")}
    return tests[kind]


def _problems(args: Column, schema: dict[str, dict], names: Column) -> Column:
    """Error texts of one tool's arguments (an array, nulls where a check passes)."""
    out: list[Column] = []
    for name, rule in schema.items():
        value = F.try_variant_get(args, f"$['{name}']", "variant")
        there = F.array_contains(names, name)
        if rule.get("required"):
            out.append(F.when(~there, F.lit(f"{name}: missing")))
        good = _typed(value, rule["type"])
        out.append(F.when(there & ~good, F.lit(f"{name}: not {rule['type']}")))
        number = F.try_variant_get(args, f"$['{name}']", "double")
        text = F.try_variant_get(args, f"$['{name}']", "string")
        for bound, bad in (("minimum", number < F.lit(rule.get("minimum"))), ("maximum", number > F.lit(rule.get("maximum"))),
                           ("minLength", F.length(text) < F.lit(rule.get("minLength"))), ("maxLength", F.length(text) > F.lit(rule.get("maxLength")))):
            if bound in rule:
                out.append(F.when(there & good & bad, F.lit(f"{name}: {bound} {rule[bound]}")))
        if "enum" in rule:
            out.append(F.when(there & good & ~text.isin(*rule["enum"]), F.lit(f"{name}: not allowed")))
    known = F.array(*[F.lit(n) for n in schema])
    extra = F.transform(F.array_sort(F.array_distinct(F.array_except(names, known))), lambda n: F.concat(n, F.lit(": unexpected")))
    return F.concat(F.array(*out), extra)


def errors_of(name: Column, arguments: Column, schemas: dict[str, dict[str, dict]]) -> Column:
    """All schema errors of a call, as an array of texts."""
    args, names = F.try_parse_json(arguments), F.json_object_keys(arguments)
    found = F.array(F.concat(F.coalesce(name, F.lit("")), F.lit(": unknown tool")))
    for tool, schema in schemas.items():
        found = F.when(name == tool, _problems(args, schema, names)).otherwise(found)
    whole = F.when(args.isNull() | names.isNull(), F.array(F.lit("arguments: not a JSON object"))).otherwise(found)
    return F.filter(whole, lambda e: e.isNotNull())


def canonical(arguments: Column) -> Column:
    """JSON objects with sorted keys and no blanks; anything else as null."""
    return F.coalesce(F.when(F.json_object_keys(arguments).isNotNull(), F.to_json(F.try_parse_json(arguments))), F.lit("null"))


def chains(needs: DataFrame, longest: int) -> DataFrame:
    """(conv_id, call_id, to, steps): where the chain of each call with one dependency ends, and after how many steps.

    ``needs`` has one row (conv_id, call_id, to) per call. A chain that runs into a cycle of such calls has null in ``to``.
    ``longest`` bounds the number of calls of a conversation."""
    open_ = stored(needs.withColumn("steps", F.lit(1)), "pointers")
    done: list[DataFrame] = []
    for _ in range(max(1, longest).bit_length() + 1):
        beyond = open_.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("beyond"), F.col("steps").alias("more"))
        for part in done:  # calls that arrived in earlier rounds
            beyond = beyond.unionByName(part.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("beyond"), F.col("steps").alias("more")))
        met = stored(open_.join(beyond, ["conv_id", "to"], "left"), "pointers")
        done.append(met.filter("beyond is null").select("conv_id", "call_id", "to", "steps"))
        open_ = met.filter("beyond is not null").select("conv_id", "call_id", F.col("beyond").alias("to"), (F.col("steps") + F.col("more")).alias("steps"))
        if open_.isEmpty():
            break
    lost = open_.select("conv_id", "call_id", F.lit(None).cast("string").alias("to"), "steps")
    return reduce(DataFrame.unionByName, [*done, lost])


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of all calls; -1 in or behind a cycle.

    ``calls`` has conv_id, call_id; ``edges`` conv_id, call_id, needs: all among known identifiers."""
    counted = edges.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("to"))
    counted = stored(calls.select(*_KEY).join(counted, _KEY, "left"), "needs")
    longest = counted.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    one = stored(chains(counted.filter("n = 1").select(*_KEY, "to"), longest), "chains")
    roots = counted.filter("n is null").select(*_KEY, F.lit(0).alias("level"))
    # Calls with several dependencies: each dependency is the end of a chain, ``steps`` before it.
    several = counted.filter("n > 1").select(*_KEY)
    ends = one.select("conv_id", F.col("call_id").alias("needs"), F.col("to").alias("end"), (F.col("steps") + 1).alias("far"), F.lit(True).alias("chained"))
    wants = edges.join(several, _KEY, "left_semi").join(ends, ["conv_id", "needs"], "left") \
        .select(*_KEY, F.when(F.col("chained"), F.col("end")).otherwise(F.col("needs")).alias("end"), F.coalesce("far", F.lit(1)).alias("far"))
    wants, rest, placed = stored(wants, "wants"), stored(several, "several"), stored(roots, "placed")
    for _ in range(MAX_ROUNDS):
        if rest.isEmpty():
            break
        at = placed.select("conv_id", F.col("call_id").alias("end"), "level")
        known = wants.join(rest, _KEY, "left_semi").join(at, ["conv_id", "end"], "left")
        ready = known.groupBy(*_KEY).agg(F.max(F.col("level") + F.col("far")).alias("level"), F.min(F.col("level").isNotNull()).alias("all")) \
            .filter("all").select(*_KEY, "level")
        ready = stored(ready, "ready")
        if ready.isEmpty():
            break
        placed = placed.unionByName(ready)
        rest = stored(rest.join(ready, _KEY, "left_anti"), "several")
    else:
        raise RuntimeError(f"more than {MAX_ROUNDS} rounds of calls with several dependencies")
    at = placed.select("conv_id", F.col("call_id").alias("to"), "level")
    along = one.join(at, ["conv_id", "to"], "left").select(*_KEY, F.coalesce(F.col("level") + F.col("steps"), F.lit(-1)).alias("level"))
    return stored(placed.unionByName(rest.withColumn("level", F.lit(-1))).unionByName(along), "levels")


def link(messages: DataFrame, schemas: dict[str, dict[str, dict]] | None = None) -> DataFrame:
    """conv_id, turn, kind, call_id, name, status, level, call_turn, part, errors, json of every message."""
    schemas = SCHEMAS if schemas is None else schemas
    m = messages.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.col("conv_id").alias("conv"), "role", "text", "call", "answers")
    is_call, is_result = F.col("call").isNotNull(), F.col("call").isNull() & F.col("answers").isNotNull()

    # Calls: the first of an identifier owns it.
    calls = m.filter(is_call).select("conv_id", "conv", "turn", "role", "text", F.coalesce("call.id", F.lit("")).alias("call_id"), F.col("call.name").alias("name"),
                                     F.col("call.arguments").alias("arguments"), F.col("call.depends_on").alias("depends_on"))
    order = Window.partitionBy(*_KEY).orderBy(F.col("turn").asc_nulls_first(), "name", "arguments")
    calls = stored(calls.withColumn("use", F.row_number().over(order)), "tool-calls")
    owners = calls.filter("use = 1").select(*_KEY, "turn", "depends_on")

    # Results: the first after the owning call answers it.
    results = m.filter(is_result).select("conv_id", "conv", "turn", "role", "text", F.col("answers").alias("call_id"))
    known = owners.select(*_KEY, F.col("turn").alias("call_turn"))
    results = results.join(known.withColumn("known", F.lit(True)), _KEY, "left")
    late = F.col("known").isNotNull() & (F.coalesce("turn", F.lit(-1)) > F.coalesce("call_turn", F.lit(-1)))
    results = results.withColumn("late", F.coalesce(late, F.lit(False)))
    order = Window.partitionBy(*_KEY, "late").orderBy(F.col("turn").asc_nulls_first(), "text")
    results = stored(results.withColumn("use", F.row_number().over(order)), "tool-results")
    answered = results.filter("late and use = 1").select(*_KEY, F.lit(True).alias("answered"))

    # Dependencies, by a second hash join of identifiers.
    wants = owners.select(*_KEY, F.explode(F.array_distinct("depends_on")).alias("needs")).filter("needs is not null")
    there = owners.select("conv_id", F.col("call_id").alias("needs"), F.lit(True).alias("there"))
    wants = stored(wants.join(there, ["conv_id", "needs"], "left"), "dependencies")
    unknown = wants.filter("there is null").groupBy(*_KEY) \
        .agg(F.transform(F.array_sort(F.collect_set("needs")), lambda n: F.concat(F.lit("depends_on: unknown "), n)).alias("unknown"))
    level = levels(owners.select(*_KEY), wants.filter("there").select(*_KEY, "needs"))

    placed = calls.join(answered, _KEY, "left").join(unknown, _KEY, "left").join(level, _KEY, "left")
    status = F.when(F.col("use") > 1, "duplicate_call").when(F.col("level") < 0, "cycle") \
        .when(F.col("answered").isNull(), "no_result").otherwise("ok")
    errors = F.concat(errors_of(F.col("name"), F.col("arguments"), schemas), F.coalesce("unknown", F.array().cast("array<string>")))
    call_json = F.concat(F.lit('{"content":'), json_string(F.col("text")), F.lit(',"role":'), json_string(F.col("role")),
                         F.lit(',"tool_calls":[{"arguments":'), canonical(F.col("arguments")), F.lit(',"id":'), json_string(F.col("call_id")),
                         F.lit(',"name":'), json_string(F.col("name")), F.lit("}]}"))
    out_calls = placed.select("conv", "turn", F.lit("call").alias("kind"), "call_id", "name", status.alias("status"), F.coalesce("level", F.lit(0)).alias("level"),
                              F.col("turn").alias("call_turn"), F.lit(0).alias("part"), errors.alias("errors"), call_json.alias("json"))
    met = results.join(level, _KEY, "left")
    status = F.when(~F.col("late"), "orphan_result").when(F.col("use") > 1, "extra_result").otherwise("ok")
    result_json = F.concat(F.lit('{"content":'), json_string(F.col("text")), F.lit(',"role":"tool","tool_call_id":'), json_string(F.col("call_id")), F.lit("}"))
    none = F.array().cast("array<string>")
    out_results = met.select("conv", "turn", F.lit("result").alias("kind"), "call_id", F.lit(None).cast("string").alias("name"), status.alias("status"),
                             F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("call_turn", "turn").alias("call_turn"), F.lit(1).alias("part"),
                             none.alias("errors"), result_json.alias("json"))
    plain_json = F.concat(F.lit('{"content":'), json_string(F.col("text")), F.lit(',"role":'), json_string(F.col("role")), F.lit("}"))
    plain = m.filter(~is_call & ~is_result)
    out_plain = plain.select("conv", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("name"),
                             F.lit("plain").alias("status"), F.lit(0).alias("level"), F.col("turn").alias("call_turn"), F.lit(0).alias("part"),
                             none.alias("errors"), plain_json.alias("json"))
    return out_calls.unionByName(out_results).unionByName(out_plain).withColumnRenamed("conv", "conv_id")


def calls_of(conversations: DataFrame) -> DataFrame:
    """Messages with tool use derived from plain conversations (conv_id, turn, role, text).

    Every assistant turn is a call whose arguments hold its whole text; the turn after it is the result. Names and
    dependencies follow from conv_id and turn: most calls need the call before, some the call after, a few of which
    don't exist."""
    c = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    conv, turn = F.coalesce(F.col("conv_id").cast("long"), F.lit(0)), F.coalesce("turn", F.lit(0))
    ident = lambda shift: F.concat(F.lit("call_"), conv.cast("string"), F.lit("_"), (turn + shift).cast("string"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("search", "lookup", "note", "search", "lookup", "note", "translate")]),
                        (F.pmod(conv + turn, F.lit(7)) + 1).cast("int"))
    n = word_count(F.col("text")).cast("string")
    flag = F.when(F.pmod(conv, F.lit(2)) == 0, "true").otherwise("false")
    arguments = F.when(name == "search", F.concat(F.lit('{ "query" : '), json_string(F.col("text")), F.lit(', "limit": '), n, F.lit(', "exact": '), flag, F.lit("}"))) \
        .when(name == "lookup", F.concat(F.lit('{"query":'), json_string(F.col("text")), F.lit(',\n "offset": '), F.col("turn").cast("string"), F.lit(" }"))) \
        .when(name == "note", F.concat(F.lit('{"pinned": '), flag, F.lit(', "body": '), json_string(F.col("text")), F.lit("}"))) \
        .otherwise(F.concat(F.lit('{"text": '), json_string(F.col("text")), F.lit("}")))
    ahead = lambda shift: F.pmod(conv + turn + shift, F.lit(17)) == 0
    needs = F.when(ahead(0), F.array(ident(2))).when(ahead(-2) | (F.pmod(turn, F.lit(8)) < 2), F.array().cast("array<string>")).otherwise(F.array(ident(-2)))
    call = F.when(F.col("role") == "assistant", F.struct(ident(0).alias("id"), name.alias("name"), arguments.alias("arguments"), needs.alias("depends_on")))
    # a user turn answers the call of the turn before; if there is no such call it stays a plain message
    before = c.filter("role = 'assistant'").select(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("_c"), (F.coalesce("turn", F.lit(0)) + 1).alias("_t")).distinct()
    met = c.withColumn("call", call).withColumn("_conv", conv).withColumn("_turn", turn).withColumn("_before", ident(-1))
    met = met.join(before.withColumn("_b", F.lit(True)), (F.col("_c") == F.col("_conv")) & (F.col("_t") == F.col("_turn")), "left")
    answers = F.when(F.col("_b") & (F.coalesce("role", F.lit("")) == "user"), F.col("_before"))
    return met.withColumn("answers", answers).select("conv_id", "turn", "role", "text", "call", "answers")
