"""Chat formatting: linking tool calls to their results, in Spark expressions throughout.

Calls and results are joined by identifier. A call may use results of other calls of its conversation. Its order is
(wave, position): position is its place in the transcript, and wave is one more than that of any call that it uses
but that stands later. Calls of conversations in which uses only go back, as nearly all do, have wave 0 without any
iteration. In the others chains of calls with one use are followed by pointer doubling, so that rounds grow with the
logarithm of a chain's length; calls with several uses are then settled in order of their nesting. Whatever
never comes to an end is in, or behind, a cycle. Arguments are checked against the tools' schemas, and messages are
serialised as canonical JSON: keys sorted, no white space, numbers normalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import SPACE, forget, keep, table

#: What a schema's type accepts, as a pattern over schema_of_variant.
TYPES = {"integer": "BIGINT", "number": r"(BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))", "string": "STRING", "boolean": "BOOLEAN", "object": "OBJECT<.*>", "array": "ARRAY<.*>"}


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and without white space; null where it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def _waves(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, wave (null in or behind a cycle) of calls with uses, in conversations where one is of a later call."""
    uses = calls.select("conv_id", "call_id", "position", F.explode(F.array_distinct("uses")).alias("used"))
    place = calls.select("conv_id", F.col("call_id").alias("used"), F.col("position").alias("at"))
    edges = uses.join(place, ["conv_id", "used"]).select("conv_id", "call_id", "used", (F.col("at") >= F.col("position")).cast("long").alias("step"))
    edges = keep(edges.join(edges.where("step = 1").select("conv_id").distinct(), "conv_id", "left_semi"))
    several = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.max("used").alias("at"), F.max("step").alias("gain"))
    one, many = several.where("n = 1").select("conv_id", "call_id", "at", "gain"), keep(several.where("n > 1").select("conv_id", "call_id"))
    jump, reach = keep(one), 1
    most = jump.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while reach < most:  # each round doubles how far a pointer reaches along calls with one use
        onward = jump.select("conv_id", F.col("call_id").alias("at"), F.col("at").alias("next"), F.col("gain").alias("more"))
        jump, old = keep(jump.join(onward, ["conv_id", "at"], "left").select("conv_id", "call_id", F.coalesce("next", "at").alias("at"), (F.col("gain") + F.coalesce("more", F.lit(0))).alias("gain"))), jump
        forget(old)
        reach *= 2
    inside = one.select("conv_id", F.col("call_id").alias("at"), F.lit(True).alias("lost"))
    jump = keep(jump.join(inside, ["conv_id", "at"], "left").select("conv_id", "call_id", "at", "gain", F.coalesce("lost", F.lit(False)).alias("lost")))  # lost: still among them, so it goes round
    # calls with several uses, whose uses are followed to the next such call or to the end
    through = jump.select("conv_id", F.col("call_id").alias("used"), "at", "gain", "lost")
    arms = edges.join(many, ["conv_id", "call_id"], "left_semi").join(through, ["conv_id", "used"], "left")
    arms = keep(arms.select("conv_id", "call_id", F.coalesce("at", "used").alias("at"), (F.col("step") + F.coalesce("gain", F.lit(0))).alias("gain"), F.coalesce("lost", F.lit(False)).alias("lost")))
    settled = keep(many.limit(0).select("conv_id", F.col("call_id").alias("at"), F.lit(0).cast("long").alias("wave")))
    open_ = keep(many)
    while not open_.isEmpty():  # a round for each level of nesting
        waits = arms.join(open_, ["conv_id", "call_id"], "left_semi").join(open_.select("conv_id", F.col("call_id").alias("at"), F.lit(True).alias("open")), ["conv_id", "at"], "left").join(settled, ["conv_id", "at"], "left")
        ready = waits.groupBy("conv_id", "call_id").agg(F.max(F.col("gain") + F.coalesce("wave", F.lit(0))).alias("wave"), F.bool_or(F.col("lost") | F.col("open").isNotNull()).alias("stuck")).where("NOT stuck")
        new = keep(ready.select("conv_id", F.col("call_id").alias("at"), "wave"))
        if new.isEmpty():
            break
        settled = settled.unionByName(new)
        open_ = keep(open_.join(new.withColumnRenamed("at", "call_id"), ["conv_id", "call_id"], "left_anti"))
    branch = many.join(settled.withColumnRenamed("at", "call_id"), ["conv_id", "call_id"], "left").select("conv_id", "call_id", "wave")
    behind = many.select("conv_id", F.col("call_id").alias("at"), F.lit(True).alias("branch"))
    wave = F.when(F.col("lost"), F.lit(None)).when(F.col("branch"), F.col("gain") + F.col("wave")).otherwise(F.col("gain"))
    chain = jump.join(behind, ["conv_id", "at"], "left").join(settled, ["conv_id", "at"], "left").select("conv_id", "call_id", wave.alias("wave"))
    return branch.unionByName(chain).withColumn("late", F.lit(True))


def check_arguments(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, call_id, position, errors (sorted codes) of calls (tool, arguments) against schemas (tool, argument, type, required).

    Codes: `tool` (no schema), `json` (no JSON object), `missing:x`, `type:x`, `unknown:x`.
    """
    fields = schemas.groupBy("tool").agg(F.map_from_entries(F.collect_set(F.struct("argument", F.struct("type", "required")))).alias("fields"))  # a tool's arguments: bounded by its schema
    parsed = F.try_parse_json("arguments")
    seen = calls.join(fields, "tool", "left").withColumn("given", F.from_json(F.to_json(parsed), "map<string,variant>"))
    given, want = F.col("given"), F.col("fields")
    kinds = F.transform_values(given, lambda _, v: F.schema_of_variant(v))
    named = F.map_keys(want)
    missing = F.transform(F.filter(named, lambda k: want[k].required & ~F.coalesce(F.array_contains(F.map_keys(given), k), F.lit(False))), lambda k: F.concat(F.lit("missing:"), k))
    unknown = F.transform(F.filter(F.map_keys(given), lambda k: ~F.array_contains(named, k)), lambda k: F.concat(F.lit("unknown:"), k))
    pattern = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    wrong = F.transform(F.filter(F.map_keys(given), lambda k: F.array_contains(named, k) & ~F.coalesce(F.regexp_like(kinds[k], F.concat(F.lit("^"), pattern[want[k].type], F.lit("$"))), F.lit(False))), lambda k: F.concat(F.lit("type:"), k))
    none = F.array().cast("array<string>")
    errors = F.when(want.isNull(), F.array(F.lit("tool"))).when(given.isNull(), F.array(F.lit("json"))).otherwise(F.array_sort(F.concat(missing, wrong, unknown)))
    return seen.select(*[calls[f"`{c}`"] for c in calls.columns], F.coalesce(errors, none).alias("errors"))


def _text(c: Column) -> Column:
    """A string as JSON, null as null."""
    one = F.to_json(F.struct(c.alias("x")))
    return F.when(c.isNull(), F.lit("null")).otherwise(one.substr(F.lit(6), F.length(one) - 6))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, kind, call_id, position, wave, errors, linked, json: one row per call, and one per result without a call.

    calls: conv_id, call_id, position, tool, arguments (JSON text), uses (call_ids). results: conv_id, call_id, position,
    content. Of calls that share an identifier the first in the transcript stays, of results the first (ties: the smaller);
    rows without conv_id or call_id are left out. A call without a result has linked false and a null result. A use of
    an unknown call, or of itself, is an error (`use:x`); wave is null in or behind a cycle. Calls: json is
    {"arguments","id","name","result","valid"}, sorted; arguments that aren't JSON stand as text. A result that no call
    asked for is of the kind `result` with the error `call`, without a wave, and {"id","result"} for json. Texts of any
    length are kept whole, null content is an empty text; other columns aren't read. No conversation is gathered: order by
    (conv_id, wave, position).
    """
    none = F.array().cast("array<string>")
    known = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").select("conv_id", "call_id", F.struct("position", "tool", "arguments", F.coalesce("uses", none).alias("uses")).alias("c"))
    calls = known.groupBy("conv_id", "call_id").agg(F.min("c").alias("c")).select("conv_id", "call_id", "c.*")
    answers = results.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("position", F.coalesce("content", F.lit("")).alias("content"))).alias("r"))
    uses = calls.where(F.size("uses") > 0).select("conv_id", "call_id", F.explode(F.array_distinct("uses")).alias("used")).where("used IS NOT NULL")
    lost = (
        uses.join(calls.select("conv_id", F.col("call_id").alias("used")), ["conv_id", "used"], "left_anti")
        .unionByName(uses.where("used = call_id")).groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("use:"), "used"))).alias("lost"))
    )
    both = check_arguments(calls, schemas).withColumn("is_call", F.lit(True)).join(answers, ["conv_id", "call_id"], "full")
    whole = both.join(lost, ["conv_id", "call_id"], "left").join(_waves(calls), ["conv_id", "call_id"], "left")
    is_call, content = F.coalesce("is_call", F.lit(False)), F.col("r.content")
    errors = F.when(is_call, F.concat("errors", F.coalesce("lost", none))).otherwise(F.array(F.lit("call")))
    call = F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), _text(F.col("arguments"))), F.lit(',"id":'), _text(F.col("call_id")), F.lit(',"name":'), _text(F.col("tool")), F.lit(',"result":'), _text(content), F.lit(',"valid":'), (F.size(errors) == 0).cast("string"), F.lit("}"))
    result = F.concat(F.lit('{"id":'), _text(F.col("call_id")), F.lit(',"result":'), _text(content), F.lit("}"))
    return whole.select(
        "conv_id", F.when(is_call, "call").otherwise("result").alias("kind"), "call_id", F.coalesce("position", "r.position").alias("position"),
        F.when(is_call, F.when(F.col("late"), F.col("wave")).otherwise(0)).cast("long").alias("wave"), errors.alias("errors"), (is_call & F.col("r").isNotNull()).alias("linked"), F.when(is_call, call).otherwise(result).alias("json"),
    )


def notes(turns: DataFrame) -> DataFrame:
    """Turns that are neither calls nor results (conv_id, turn, role, text) as rows like those of link_calls, kind `note`: json is {"role","text"}."""
    json = F.concat(F.lit('{"role":'), _text(F.col("role")), F.lit(',"text":'), _text(F.coalesce("text", F.lit(""))), F.lit("}"))
    return turns.select("conv_id", F.lit("note").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.col("turn").alias("position"), F.lit(None).cast("long").alias("wave"), F.array().cast("array<string>").alias("errors"), F.lit(False).alias("linked"), json.alias("json"))


def transcript(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations (conv_id, turn, role, text) read as calls, results and notes.

    Every user turn is a call `t<turn>` of the tool `reply`. Its arguments are its text (left out if it is empty), its
    turn, its words (as text where their number is divisible by seven), and its lines where there are several. Where the
    number of words isn't divisible by three the call uses the one at the place 2 * (words mod 5) of its conversation's
    user turns, be it earlier, later, itself or none. An assistant turn is the result of the turn before it. Turns of other
    roles are notes. Turns with a null conv_id or turn are left out; null texts are empty.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.array_remove(F.split(text, SPACE), ""))
    named = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").withColumn("words", words)
    user = named.where("role = 'user'")
    lines = F.size(F.split(text, "\n"))
    fields = [F.when(lines > 1, lines).alias("lines"), F.when(text != "", text).alias("text"), F.col("turn").alias("turn")]  # to_json leaves nulls out
    arguments = F.when(F.col("words") % 7 == 0, F.to_json(F.struct(*fields, F.col("words").cast("string").alias("words")))).otherwise(F.to_json(F.struct(*fields, F.col("words").alias("words"))))
    used = F.concat(F.lit("t"), (F.col("turn") % 2 + 2 * (F.col("words") % 5)).cast("string"))
    calls = user.select(
        "conv_id", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("call_id"), F.col("turn").alias("position"), F.lit("reply").alias("tool"), arguments.alias("arguments"),
        F.when(F.col("words") % 3 > 0, F.array(used)).otherwise(F.array().cast("array<string>")).alias("uses"),
    )
    results = named.where("role = 'assistant'").select("conv_id", F.concat(F.lit("t"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("turn").alias("position"), text.alias("content"))
    return calls, results, notes(named.where("role IS NULL OR role NOT IN ('user', 'assistant')"))


REPLY = [("reply", "text", "string", True), ("reply", "turn", "integer", True), ("reply", "words", "integer", False)]


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, rest = transcript(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(REPLY, "tool string, argument string, type string, required boolean")
    linked = link_calls(calls, results, schemas).unionByName(rest)
    return linked.select("conv_id", "kind", "call_id", "position", "wave", F.size("errors").cast("long").alias("n_errors"), "linked", "json")


OP4_SQL = r"""
WITH RECURSIVE named AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
worded AS (SELECT *, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words, len(string_split(text, chr(10))) AS lines FROM named),
args AS (SELECT conv_id, turn, text, words, lines,
    '{' || CASE WHEN lines > 1 THEN '"lines":' || lines || ',' ELSE '' END || CASE WHEN text <> '' THEN '"text":' || CAST(to_json(text) AS VARCHAR) || ',' ELSE '' END
    || '"turn":' || turn || ',"words":' || CASE WHEN words % 7 = 0 THEN '"' || words || '"' ELSE CAST(words AS VARCHAR) END || '}' AS arguments,
    CASE WHEN words % 3 > 0 THEN turn % 2 + 2 * (words % 5) END AS used
  FROM worded WHERE role = 'user'),
calls AS (SELECT a.*, (SELECT count(*) FROM args b WHERE b.conv_id = a.conv_id) AS n, EXISTS (SELECT 1 FROM args b WHERE b.conv_id = a.conv_id AND b.turn = a.used) AS found FROM args a),
results AS (SELECT conv_id, turn - 1 AS turn, turn AS spot, text AS content FROM named WHERE role = 'assistant'),
walk AS (SELECT conv_id, turn AS start, turn AS spot, CAST(0 AS BIGINT) AS wave, 0 AS steps FROM calls
  UNION ALL SELECT w.conv_id, w.start, c.used, w.wave + CASE WHEN c.used >= c.turn THEN 1 ELSE 0 END, w.steps + 1 FROM walk w JOIN calls c ON c.conv_id = w.conv_id AND c.turn = w.spot WHERE c.found AND w.steps < c.n),
waves AS (SELECT conv_id, start AS turn, max(steps) AS steps, max(wave) AS wave FROM walk GROUP BY ALL),
linked AS (SELECT c.conv_id, c.turn, r.content, c.arguments, CASE WHEN w.steps < c.n THEN w.wave END AS wave,
    CAST((c.words % 7 = 0)::INT + (c.lines > 1)::INT + (c.text = '')::INT + coalesce((NOT c.found AND c.used IS NOT NULL)::INT, 0) + coalesce((c.used = c.turn)::INT, 0) AS BIGINT) AS n_errors
  FROM calls c JOIN waves w USING (conv_id, turn) LEFT JOIN results r USING (conv_id, turn))
SELECT conv_id, 'call' AS kind, 't' || turn AS call_id, turn AS position, wave, n_errors, content IS NOT NULL AS linked,
  '{"arguments":' || arguments || ',"id":"t' || turn || '","name":"reply","result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"valid":' || CASE WHEN n_errors = 0 THEN 'true' ELSE 'false' END || '}' AS json
FROM linked
UNION ALL SELECT conv_id, 'result', 't' || turn, spot, NULL, 1, false, '{"id":"t' || turn || '","result":' || CAST(to_json(content) AS VARCHAR) || '}' FROM results ANTI JOIN calls USING (conv_id, turn)
UNION ALL SELECT conv_id, 'note', NULL, turn, NULL, 0, false, '{"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || ',"text":' || CAST(to_json(text) AS VARCHAR) || '}' FROM named WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""
