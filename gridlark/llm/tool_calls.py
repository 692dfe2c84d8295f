"""Chat formatting: link tool calls and results, order, validate and serialise them, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import positions, table

#: Kinds a schema may ask for, and what the parsed value's type is then.
KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}


#: Private characters: a number in disguise, a masked pair of backslashes, a masked quote.
NUMBER, SLASHES, QUOTE = "\ue000", "\ue001", "\ue002"
#: Fixed value: a number of JSON that stands alone.
NUMERAL = r"(?<![\w.+-])(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![\w.+-])"
#: Numbers up to so many digits before the point, and zeros after it, are written without an exponent.
PLAIN_DIGITS, PLAIN_ZEROS = 21, 5


def canonical_number(number: Column) -> Column:
    """One text for one value, exact however long: no exponent from 1e-6 up to 21 digits, else d.ddde+x; no idle zeros, no -0."""
    number = F.lower(number)
    mantissa, exponent = F.substring_index(number, "e", 1), F.when(F.contains(number, F.lit("e")), F.substring_index(number, "e", -1)).otherwise("0")
    unsigned = F.ltrim(mantissa, F.lit("-"))
    whole, fraction = F.substring_index(unsigned, ".", 1), F.when(F.contains(unsigned, F.lit(".")), F.substring_index(unsigned, ".", -1)).otherwise("")
    every = F.concat(whole, fraction)
    started = F.ltrim(every, F.lit("0"))
    digits = F.rtrim(started, F.lit("0"))
    n = F.length(digits)
    # the value is 0.digits times ten to the power of point
    point = F.length(whole) - (F.length(every) - F.length(started)) + exponent.try_cast("bigint")
    at = F.least(F.greatest(point, F.lit(-PLAIN_ZEROS)), F.lit(PLAIN_DIGITS)).cast("int")  # for repeats, whatever the branch
    plain = F.when(point >= n, F.concat(digits, F.repeat(F.lit("0"), F.greatest(at - n, F.lit(0))))).when(point > 0, F.concat(F.substr(digits, F.lit(1), at), F.lit("."), F.substr(digits, at + 1)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-at, F.lit(0))), digits)
    power = point - 1
    far = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), F.lit("e"), F.when(power > 0, "+").otherwise(""), power.cast("string"))
    value = F.when((point > 0) & (point <= PLAIN_DIGITS), plain).when((point <= 0) & (point >= -PLAIN_ZEROS), small).otherwise(far)
    out = F.when(n == 0, "0").otherwise(F.concat(F.when(F.startswith(mantissa, F.lit("-")), "-").otherwise(""), value))
    return F.coalesce(out, number)  # an exponent beyond all bounds stays as it is written


def _segments(json: Column) -> Column:
    """A text of JSON cut at its quotes, with escaped quotes and backslashes masked: odd places are outside of strings."""
    masked = F.regexp_replace(F.regexp_replace(F.regexp_replace(json, NUMBER, NUMBER * 2), SLASHES, r"\\ue001"), QUOTE, r"\\ue002")
    masked = F.regexp_replace(F.replace(masked, F.lit("\\\\"), F.lit(SLASHES)), r"(?i)\\ue000", NUMBER * 2)
    return F.split(F.replace(masked, F.lit('\\"'), F.lit(QUOTE)), '"', -1)


def _unmasked(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(QUOTE), F.lit('\\"')), F.lit(SLASHES), F.lit("\\\\"))


def _wrapped(json: Column, parse) -> Column:
    """Whether a text parses within brackets and within braces: the parsers ignore what follows a value."""
    return parse(F.concat(F.lit("["), json, F.lit("]"))).isNotNull() & parse(F.concat(F.lit('{"":'), json, F.lit("}"))).isNotNull()


def canonical(json: Column) -> Column:
    """JSON with sorted keys, no blanks and canonical numbers; null if it is null, not JSON, or repeats a key in an object.

    Numbers are exact: they go through the parser as marked strings, so that
    none is rounded, and come out by ``canonical_number``.
    """
    numbered = F.transform(_segments(json), lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, NUMERAL, f'"{NUMBER}$1"')).otherwise(x))
    out = F.to_json(F.try_parse_json(_unmasked(F.array_join(numbered, '"'))))
    marked = f'"{NUMBER}(-?[0-9][^"]*)"'
    between, numbers = F.split(out, marked, -1), F.regexp_extract_all(out, F.lit(marked), F.lit(1))
    whole = F.array_join(F.zip_with(between, numbers, lambda x, n: F.concat(x, F.coalesce(canonical_number(n), F.lit("")))), "")
    return F.when(_wrapped(json, F.try_parse_json), F.replace(whole, F.lit(NUMBER * 2), F.lit(NUMBER)))


def repeats_a_key(json: Column) -> Column:
    """Whether a text is JSON but for a key that an object has twice."""
    loose = F.exists(F.transform(_segments(json), lambda x, i: F.when(i % 2 == 0, x).otherwise("")), lambda x: F.contains(x, F.lit("'")))
    return json.isNotNull() & F.try_parse_json(json).isNull() & _wrapped(json, lambda x: F.get_json_object(x, "$")) & ~loose


def depths(calls: DataFrame) -> DataFrame:
    """(id, depth): how many calls a call depends on through its parents; null on a cycle.

    ``calls`` has id (unique, not null) and parent. A parent that is not a call
    counts as none. Each round doubles the steps that pointers have gone, so a
    chain of n calls takes log2(n) rounds; when a round settles no call, what
    is left leads into a cycle. A hub parent that many calls share is a skewed
    join key, which adaptive execution splits.
    """
    ids = calls.select(F.col("id").alias("parent"))
    known = calls.select("id", "parent").join(ids, "parent", "left_semi").select("id", "parent")
    roots = calls.select("id").join(known, "id", "left_anti").select("id", F.lit(0).cast("long").alias("depth"))
    done = table(roots, "call-depths")
    # at: an ancestor, steps: how far above
    open_ = table(known.select("id", F.col("parent").alias("at"), F.lit(1).cast("long").alias("steps")), "call-open")
    left = open_.count()
    while left:
        ended = done.select(F.col("id").alias("at"), F.col("depth").alias("above"))
        settled = open_.join(ended, "at").select("id", (F.col("steps") + F.col("above")).alias("depth"))
        ahead = open_.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"))
        onward = open_.join(ahead, "at").select("id", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"))
        done = table(done.unionByName(settled), "call-depths")
        open_ = table(onward, "call-open")
        now = open_.count()
        if now == left:
            break
        left = now
    return done.unionByName(open_.select("id", F.lit(None).cast("long").alias("depth")))


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with a call's arguments, an array of strings in the schema's order.

    ``schemas`` maps a tool to its fields: name -> (kind of ``KINDS``, required).
    Arguments must be a JSON object; a required field may not be missing or
    null, a given one must be of its kind, and no other field is allowed.
    """
    parsed = F.try_parse_json(arguments)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    out = F.array(F.lit("unknown tool"))
    for tool in sorted(schemas):
        fields = schemas[tool]
        checks = []
        for field, (kind, required) in fields.items():
            value = F.try_variant_get(parsed, "$['" + field.replace("'", "\\'") + "']", "variant")
            given = F.schema_of_variant(value)
            missing = value.isNull() | (given == "VOID")
            fits = F.lit(False)
            for k in KINDS[kind]:
                fits = fits | given.startswith(k)
            checks.append(F.when(missing, F.lit(f"missing {field}") if required else None).when(~fits, f"{field} is not {kind}"))
        names = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
        extra = F.transform(F.array_sort(F.array_except(names, F.lit(list(fields)) if fields else F.array().cast("array<string>"))), lambda k: F.concat(F.lit("unexpected "), k))
        found = F.array_compact(F.concat(F.array(*checks) if checks else F.array().cast("array<string>"), extra))
        bad = F.when(repeats_a_key(arguments), "a key is repeated").otherwise("arguments are no object")
        out = F.when(F.coalesce(name, F.lit("")) == tool, F.when(F.coalesce(is_object, F.lit(False)), found).otherwise(F.array(bad))).otherwise(out)
    return out


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """Link calls with results by identifier, give their topological level, validate and serialise.

    ``calls``: conv_id, id, parent, name, arguments (JSON); ``results``:
    conv_id, call_id, output. Other columns are not read. A row per linked
    pair, per call without a result and per result without a call:

    conv_id, call_id, level (calls that must come before; null on a cycle, or
    for a result without a call), position (gapless from 0 in the conversation),
    status (linked, unanswered, orphan), errors
    (empty if the arguments fit the schema; null for an orphan), json
    (canonical: sorted keys, no blanks, exact numbers of one form).

    Positions put every call after those it depends on: they go by level, calls
    without one last, then by id and output, both in code-point order. A call
    has at most one parent. Of several
    calls with one id in a conversation the first by (name, arguments, parent)
    stands. A null id, or conv_id, links with nothing: such a call is
    unanswered at level 0, such a result an orphan. Equal results of one call, or orphans of
    one id, are one. Arguments that are not JSON, or repeat a key, are
    serialised as a string of their text, and are an error. Empty tables give no rows; texts may be of any length.
    """
    key = F.when(F.col("conv_id").isNotNull() & F.col("id").isNotNull(), F.to_json(F.array(F.col("conv_id").cast("string"), F.col("id").cast("string"))))
    parent = F.when(F.col("conv_id").isNotNull() & F.col("parent").isNotNull(), F.to_json(F.array(F.col("conv_id").cast("string"), F.col("parent").cast("string"))))
    c = calls.select("conv_id", F.col("id").cast("string").alias("call_id"), key.alias("id"), parent.alias("parent"), "name", "arguments")
    named = c.where("id is not null").groupBy("id").agg(F.min(F.struct("name", "arguments", "parent", "conv_id", "call_id")).alias("c"))
    named = table(named.select("id", "c.*"), "calls")
    levels = depths(named.select("id", "parent"))
    named = named.join(levels, "id")
    nameless = c.where("id is null").withColumn("depth", F.lit(0).cast("long"))
    r_key = F.when(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull(), F.to_json(F.array(F.col("conv_id").cast("string"), F.col("call_id").cast("string"))))
    r = results.select(F.col("conv_id").alias("r_conv"), F.col("call_id").cast("string").alias("r_call"), r_key.alias("id"), "output").distinct()
    linked = named.select("id", "conv_id", "call_id", "parent", "name", "arguments", "depth").join(r, "id", "full")
    rows = linked.unionByName(nameless.select("id", "conv_id", "call_id", "parent", "name", "arguments", "depth"), allowMissingColumns=True)
    has_call = F.col("name").isNotNull() | F.col("arguments").isNotNull() | F.col("depth").isNotNull() | F.col("call_id").isNotNull()
    has_result = F.col("output").isNotNull() | F.col("r_call").isNotNull() | F.col("r_conv").isNotNull()
    status = F.when(has_call & has_result, "linked").when(has_call, "unanswered").otherwise("orphan")
    rows = rows.select(
        F.coalesce("conv_id", "r_conv").alias("conv_id"),
        F.coalesce("call_id", "r_call").alias("call_id"),
        F.col("depth").alias("level"),
        status.alias("status"),
        F.when(status != "orphan", argument_errors(F.col("name"), F.col("arguments"), schemas)).alias("errors"),
        "name",
        "arguments",
        "output",
        F.coalesce("depth", F.lit((1 << 63) - 1)).alias("_order"),
    )
    rows = positions(rows, "conv_id", ["_order", "call_id", "output"], "position", "call-places")
    text = F.to_json(F.struct(F.col("arguments").alias("a")))  # {"a":"..."}
    arguments = F.coalesce(canonical(F.col("arguments")), F.when(F.col("arguments").isNotNull(), F.substr(text, F.lit(6), F.length(text) - 6)), F.lit("null"))
    # fields in order of their names, those of the arguments too; nulls are kept: one text for one value
    rest = F.to_json(F.struct("call_id", "conv_id", "level", "name", "output", "position", "status"), {"ignoreNullFields": "false"})
    json = F.concat(F.lit('{"arguments":'), arguments, F.lit(","), F.substr(rest, F.lit(2)))
    return rows.select("conv_id", "call_id", "level", "position", "status", "errors", json.alias("json"))


#: The tool a conversation's turns are read as in the registered query.
SCHEMAS = {"reply": {"prompt": ("string", True), "turn": ("integer", True), "style": ("string", False)}}


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Read plain conversations as calls of the tool ``reply`` and their results.

    A user turn t is a call with id ``t``, which depends on the user turn t-2,
    and the assistant turn t+1 is the result of call t. Rows that are neither,
    or lack a turn, are left to ``other_turns``; a call whose t-2 is missing depends on nothing.
    """
    user = messages.where("role = 'user' and turn is not null")
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")), {"ignoreNullFields": "false"})
    calls = user.select("conv_id", F.col("turn").cast("string").alias("id"), (F.col("turn") - 2).cast("string").alias("parent"), F.lit("reply").alias("name"), arguments.alias("arguments"))
    results = messages.where("role = 'assistant' and turn is not null").select("conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), F.col("text").alias("output"))
    return calls, results


def other_turns(messages: DataFrame) -> DataFrame:
    """The rows of ``messages`` that no link of ``turns_as_calls`` carries, equal ones as one.

    conv_id, call_id (the turn), level 0, position (null), status, n_errors (null), json, n_rows
    (rows it stands for). Status ``other`` has another role, or no role or turn;
    ``repeated`` are user rows of a turn besides the one that stands, and
    further copies of equal rows.
    """
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")), {"ignoreNullFields": "false"})
    rows = table(messages.groupBy("conv_id", "role", "turn", "text").agg(F.count(F.lit(1)).alias("n")), "turns")
    linked = F.coalesce(F.col("role").isin("user", "assistant") & F.col("turn").isNotNull(), F.lit(False))
    others = rows.where(~linked).select("*", F.lit("other").alias("status"), F.col("n").alias("n_rows"))
    results = rows.where("role = 'assistant' and turn is not null").withColumn("n_rows", F.col("n") - 1)
    # user rows without a conv_id are all linked with nothing, each as a row
    users = rows.where("role = 'user' and turn is not null and conv_id is not null").withColumn("_arguments", arguments)
    several = users.groupBy("conv_id", "turn").agg(F.min("_arguments").alias("_stands"), F.max("_arguments").alias("_last")).where("_stands < _last").drop("_last")
    users = users.join(table(several, "turns-several"), ["conv_id", "turn"], "left")
    stands = F.col("_arguments") == F.coalesce("_stands", "_arguments")
    users = users.withColumn("n_rows", F.col("n") - stands.cast("long")).select(*results.columns)
    repeated = results.unionByName(users).where("n_rows > 0").withColumn("status", F.lit("repeated"))
    out = others.unionByName(repeated).withColumn("level", F.lit(0).cast("long"))
    json = F.to_json(F.struct("conv_id", "level", "role", "status", "text", "turn"), {"ignoreNullFields": "false"})
    return out.select("conv_id", F.col("turn").cast("string").alias("call_id"), "level", F.lit(None).cast("long").alias("position"), "status", F.lit(None).cast("int").alias("n_errors"), json.alias("json"), "n_rows")


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's user turns linked with the assistant's answers, and all other turns (n_rows says how many of each)."""
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    calls, results = turns_as_calls(messages)
    links = link_tool_calls(calls, results, SCHEMAS).withColumn("n_errors", F.size("errors")).withColumn("n_rows", F.lit(None).cast("long"))
    return links.drop("errors").unionByName(other_turns(messages))


def _oracle_links() -> str:
    """Chains of user turns are runs of turn / 2 within a conversation and parity."""
    quoted = lambda x: f"coalesce(to_json({x})::varchar, 'null')"
    return f"""
WITH c0 AS (
  SELECT conv_id, turn, min('{{"prompt":' || {quoted("text")} || ',"turn":' || turn || '}}') AS arguments FROM conversations
  WHERE role = 'user' AND turn IS NOT NULL AND conv_id IS NOT NULL GROUP BY conv_id, turn
), c1 AS (
  SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, abs(turn) % 2 ORDER BY turn) AS run FROM c0
), c AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, abs(turn) % 2, run ORDER BY turn) - 1 AS level FROM c1
), r AS (
  SELECT DISTINCT conv_id, turn - 1 AS turn, text AS output FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL
), b0 AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn)::varchar AS call_id, level, arguments, output,
    CASE WHEN c.turn IS NULL THEN 'orphan' WHEN r.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn
), b AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY level NULLS LAST, call_id NULLS FIRST, output NULLS FIRST) - 1 AS position FROM b0
)
SELECT conv_id, call_id, level, position, status,
  CASE WHEN status = 'orphan' THEN NULL WHEN starts_with(arguments, '{{"prompt":null') THEN 1 ELSE 0 END::int AS n_errors,
  '{{"arguments":' || coalesce(arguments, 'null') || ',"call_id":"' || call_id || '","conv_id":' || conv_id || ',"level":' || coalesce(level::varchar, 'null')
    || ',"name":' || CASE WHEN status = 'orphan' THEN 'null' ELSE '"reply"' END || ',"output":' || {quoted("output")} || ',"position":' || position || ',"status":"' || status || '"}}' AS json
FROM b"""


def _oracle_all() -> str:
    """The links, then rows of other roles, then those beyond the first of a turn or of equals."""
    quoted = lambda x: f"coalesce(to_json({x})::varchar, 'null')"
    return f"""
WITH links AS ({_oracle_links()}
), t AS (
  SELECT conv_id, role, turn, text, count(*) AS n, coalesce(role IN ('user', 'assistant') AND turn IS NOT NULL, false) AS carried FROM conversations GROUP BY ALL
), k AS (
  SELECT *, CASE WHEN role = 'user' THEN row_number() OVER (PARTITION BY role, conv_id, turn ORDER BY {quoted("text")}) ELSE 1 END AS place FROM t WHERE carried
), o AS (
  SELECT conv_id, role, turn, text, 'other' AS status, n AS n_rows FROM t WHERE NOT carried
  UNION ALL
  SELECT conv_id, role, turn, text, 'repeated', n - (place = 1)::int FROM k WHERE n - (place = 1)::int > 0 AND (role <> 'user' OR conv_id IS NOT NULL)
)
SELECT *, NULL::bigint AS n_rows FROM links
UNION ALL
SELECT conv_id, turn::varchar, 0, NULL, status, NULL::int,
  '{{"conv_id":' || {quoted("conv_id")} || ',"level":0,"role":' || {quoted("role")} || ',"status":"' || status || '","text":' || {quoted("text")} || ',"turn":' || {quoted("turn")} || '}}', n_rows
FROM o"""


ORACLE = {"op4_tool_calls": _oracle_all()}
