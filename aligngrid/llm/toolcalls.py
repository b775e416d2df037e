"""Chat formatting: tool calls joined to their results, put in topological order, validated and written as canonical JSON.

Calls and results meet in a hash join on their identifier; repeated results are reduced to the first before the join. A call
names the calls that it needs; its level is one more than the highest of those. The needs of a conversation are ordered in one pass of
the task that gets them; a conversation of more than HELD needs is ordered in rounds over the calls that are still open instead. Positions inside a conversation are counted in ranges of the sorted rows, so a
conversation with a third of all calls is not sorted in one task. JSON is parsed row by row in Arrow batches.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aligngrid.llm.common import cut, python_map, store, table

#: The tools of the registered query, as the usual subset of JSON Schema.
SCHEMAS = {
    "search": {"type": "object", "required": ["query"], "additionalProperties": False, "properties": {
        "query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 50},
        "lang": {"enum": ["de", "en", "es", "fr"]}}},
    "store": {"type": "object", "required": ["key", "value"], "properties": {
        "key": {"type": "string"}, "value": {"type": ["string", "number", "null"]},
        "tags": {"type": "array", "items": {"type": "string"}}}},
}
_KINDS = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def _is(kind: str, x) -> bool:
    if kind in ("integer", "number"):
        return isinstance(x, int | float) and not isinstance(x, bool) and (kind == "number" or float(x).is_integer())
    return isinstance(x, _KINDS[kind])


def violations(schema: dict, x, at: str = "$") -> list[str]:
    """What in `x` breaks `schema`: type, enum, required, properties, additionalProperties, items, lengths, bounds."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(k, x) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and not any(type(x) is type(v) and x == v for v in schema["enum"]):
        out.append(f"{at}: not one of the values")
    if isinstance(x, str) and len(x) < schema.get("minLength", 0):
        out.append(f"{at}: too short")
    if isinstance(x, int | float) and not isinstance(x, bool) and not (
            schema.get("minimum", x) <= x <= schema.get("maximum", x)):
        out.append(f"{at}: out of bounds")
    if isinstance(x, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in x]
        for k in sorted(x):
            if k in known:
                out += violations(known[k], x[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(x, list) and "items" in schema:
        for i, v in enumerate(x):
            out += violations(schema["items"], v, f"{at}[{i}]")
    return out


def canonical(x) -> str:
    """JSON with sorted names, no spaces, and text as it is."""
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _refuse(text: str):
    raise ValueError(text)


def checked(name: str | None, arguments: str | None, schemas: dict) -> tuple[list[str], object]:
    """Errors of a call, and its arguments as a value (null where they are no JSON)."""
    try:
        value = json.loads(arguments or "", parse_constant=_refuse)
    except (ValueError, RecursionError):
        return ["$: no JSON"], None
    if name not in schemas:
        return ["unknown tool"], value
    return violations(schemas[name], value), value


def positions(df: DataFrame, group: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """`df` with the place (from 0) of each row in its group. Rows are sorted in ranges; a group may span many."""
    dealt = cut(df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order)) - 1
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", before)
    offsets = offsets.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_{i}") for i, g in enumerate(group)], "_before")
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_{i}"))
    counted = dealt.withColumn("_inside", inside)
    return counted.join(offsets, on).withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop(
        "_part", "_p", "_before", "_inside", *[f"_{i}" for i in range(len(group))])


#: Needs of a conversation that a task holds whole.
HELD = 200_000


def ordered(edges: list[tuple]) -> dict:
    """Level of every call that has needs, from (call, need) pairs; null on a cycle or behind one."""
    users, open_ = defaultdict(list), Counter()
    for call, need in edges:
        users[need].append(call)
        open_[call] += 1
    level: dict = dict.fromkeys(open_)
    ready = deque((need, 0) for need in users if need not in open_)
    while ready:  # calls leave in the order of their level
        done, n = ready.popleft()
        for call in users[done]:
            open_[call] -= 1
            if not open_[call]:
                level[call] = n + 1
                ready.append((call, n + 1))
    return level


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, call_id, need) sorted by conversation -> (conv_id, call_id, level)."""
    def made(conv, edges):
        level = ordered(edges)
        return pa.RecordBatch.from_arrays([pa.array([conv] * len(level), pa.int64()), pa.array(list(level), pa.string()),
                                           pa.array(list(level.values()), pa.int32())], names=["conv_id", "call_id", "level"])

    now, edges = None, []
    for batch in batches:
        for conv, call, need in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != now and edges:
                yield made(now, edges)
                edges = []
            now = conv
            edges.append((call, need))
    if edges:
        yield made(now, edges)


def levels(calls: DataFrame, held: int = HELD) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that need no known call, null on a cycle or behind one.

    calls: conv_id, call_id, needs array<string>; needs name calls of the same conversation, others are ignored.
    """
    known = calls.select("conv_id", "call_id").distinct()
    edges = calls.select("conv_id", "call_id", F.explode("needs").alias("need")).distinct()
    edges = cut(edges.join(known.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left_semi"))
    waits = edges.select("conv_id", "call_id").distinct()
    free = known.join(waits, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0))
    large = cut(edges.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > held).select("conv_id"))
    small = edges.join(large, "conv_id", "left_anti").select("conv_id", "call_id", "need")
    found = free.union(python_map(small.repartition("conv_id").sortWithinPartitions("conv_id"), _ordered,
                                  "conv_id bigint, call_id string, level int"))
    if large.isEmpty():
        return found
    return found.union(_levels_by_rounds(edges.join(large, "conv_id", "left_semi"), free))


def _levels_by_rounds(edges: DataFrame, free: DataFrame) -> DataFrame:
    """Levels of the calls of `edges`, a round for each level. free: the calls of level 0."""
    done, open_, found, n = free, edges, None, 0
    while True:
        # Needs of the last level are met; a call whose needs are all met has the next level.
        left = cut(open_.join(done.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_anti"))
        n += 1
        done = cut(open_.select("conv_id", "call_id").distinct().join(
            left.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(n)))
        found, open_ = done if found is None else found.union(done), left
        if done.isEmpty():
            break
    stuck = open_.select("conv_id", "call_id").distinct().withColumn("level", F.lit(None).cast("int"))
    return found.union(stuck)


def linked_calls(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row for each call, and one for each identifier of results without a call.

    calls: conv_id bigint, turn bigint, call_id string, name string, arguments string (JSON), needs array<string>.
    results: conv_id bigint, turn bigint, call_id string, content string.
    Result: conv_id, call_id, turn, level, position, status, errors array<string>, n_results, json.

    Identifiers hold inside a conversation. status: `linked`, `unanswered`, `orphan` (results without a call) or `repeated` (a call
    whose identifier an earlier call has; it gets no result). The first result by turn and content is linked. position: by
    level (null last), turn and identifier within the conversation; orphans come last. Null identifiers match nothing: such
    calls are unanswered and such results orphans. Null or broken arguments are an error; empty tables give an empty
    result; further columns are ignored.
    """
    mine = store(calls.select("conv_id", "turn", "call_id", "name", "arguments", F.coalesce(
        "needs", F.array().cast("array<string>")).alias("needs")), "calls")
    none = mine.where("conv_id is null or call_id is null").withColumn("first", F.lit(False))
    whole = F.struct("turn", "name", "arguments", "needs")
    firsts = mine.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min(whole).alias("c"), F.count(F.lit(1)).alias("n"))
    first = firsts.select("conv_id", "call_id", "c.*").withColumn("first", F.lit(True))
    # Later calls of an identifier: all its rows but one that equals the first.
    again = mine.where("conv_id is not null and call_id is not null").groupBy(
        "conv_id", "turn", "call_id", "name", "arguments", "needs").agg(F.count(F.lit(1)).alias("m"))
    same = F.struct("turn", "name", "arguments", "needs").eqNullSafe(F.col("c"))
    again = again.join(firsts.where("n > 1").select("conv_id", "call_id", "c"), ["conv_id", "call_id"]).withColumn(
        "m", F.col("m") - same.cast("int")).where("m > 0")
    again = again.select("conv_id", "turn", "call_id", "name", "arguments", "needs", F.explode(F.sequence(
        F.lit(1), F.col("m").cast("int"))).alias("_")).drop("_").withColumn("first", F.lit(False))
    level = levels(first)
    answers = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "content")).alias("answer"), F.count(F.lit(1)).alias("n_results"))
    known = first.join(level, ["conv_id", "call_id"]).hint("shuffle_hash").join(answers, ["conv_id", "call_id"], "full")
    blank = F.lit(None)
    rest = again.union(none.select(again.columns)).withColumn("level", blank.cast("int")).withColumn(
        "answer", blank.cast(answers.schema["answer"].dataType)).withColumn("n_results", blank.cast("long"))
    lost = results.where("conv_id is null or call_id is null").select(
        "conv_id", blank.cast("bigint").alias("turn"), "call_id", blank.cast("string").alias("name"),
        blank.cast("string").alias("arguments"), blank.cast("array<string>").alias("needs"),
        blank.cast("boolean").alias("first"), blank.cast("int").alias("level"),
        F.struct("turn", "content").alias("answer"), F.lit(1).cast("long").alias("n_results"))
    rows = known.select(lost.columns).union(rest.select(lost.columns)).union(lost)
    has_id = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    rows = rows.withColumn("status", F.when(F.col("first").isNull(), "orphan").when(~F.col("first") & has_id, "repeated").when(
        F.col("answer").isNull(), "unanswered").otherwise("linked"))
    rows = rows.withColumn("n_results", F.coalesce("n_results", F.lit(0))).withColumn(
        "at", F.coalesce("turn", "answer.turn")).withColumn("content", F.col("answer.content"))
    order = [F.col("first").isNull(), F.col("level").asc_nulls_last(), F.col("at").asc_nulls_last(),
             F.col("call_id").asc_nulls_last(), F.col("arguments").asc_nulls_last()]
    placed = positions(rows.drop("answer", "needs"), ["conv_id"], order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.to_pydict()
            errors, texts = [], []
            for name, args, status, call_id, content, level, at in zip(*(data[k] for k in (
                    "name", "arguments", "status", "call_id", "content", "level", "at"))):
                bad, value = ([], None) if status == "orphan" else checked(name, args, schemas)
                if status not in ("orphan", "repeated") and call_id is not None and level is None:
                    bad = [*bad, "needs form a cycle"]
                errors.append(bad)
                texts.append(canonical({"arguments": value, "errors": bad, "id": call_id, "name": name, "result": content,
                                        "status": status, "turn": at}))
            yield pa.RecordBatch.from_arrays([
                batch.column("conv_id"), batch.column("call_id"), batch.column("at"), batch.column("level"),
                batch.column("position"), batch.column("status"), pa.array(errors, pa.list_(pa.string())),
                batch.column("n_results"), pa.array(texts, pa.string())],
                names=["conv_id", "call_id", "turn", "level", "position", "status", "errors", "n_results", "json"])

    return python_map(placed, run, "conv_id bigint, call_id string, turn bigint, level int, position bigint, "
                      "status string, errors array<string>, n_results bigint, json string")


def derived(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results made from conversations, by rules on turn and length that also give every kind of mistake.

    An assistant turn is a call whose arguments hold its whole text; it needs the call that stands half as far from the start (some
    need themselves, some an unknown one). The user turn after it is its result; some bear another identifier.
    """
    n = F.coalesce(F.length("text"), F.lit(0))
    ident = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    said = conversations.select("conv_id", "turn", "role", "text", n.alias("n"))
    asked = said.where("role = 'assistant'")
    lang = F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "xx", "de", "es")]), (F.col("n") % 5 + 1).cast("int"))
    search = F.to_json(F.struct(F.when(F.col("n") % 11 != 0, F.col("text")).alias("query"),
                                (F.col("n") % 60).alias("limit"), lang.alias("lang")))
    keep = F.to_json(F.struct(F.col("text").alias("value"), F.array(F.col("role")).alias("tags"),
                              F.when(F.col("n") % 13 != 0, ident(F.col("turn"))).alias("key")))
    arguments = F.when(F.col("n") % 17 == 0, F.concat(F.lit("{"), F.col("text"))).when(F.col("n") % 2 == 0, search).otherwise(keep)
    name = F.when(F.col("n") % 23 == 0, "erase").when(F.col("n") % 2 == 0, "search").otherwise("store")
    half = F.when(F.col("turn") < 2, F.array().cast("array<string>")).when(F.col("n") % 29 == 0, F.array(ident(F.col("turn")))).when(
        F.col("n") % 31 == 0, F.array(F.lit("call-none"))).otherwise(F.array(ident(F.floor((F.col("turn") - 1) / 4) * 2 + 1)))
    calls = asked.select("conv_id", "turn", ident(F.col("turn")).alias("call_id"), name.alias("name"),
                         arguments.alias("arguments"), half.alias("needs"))
    answered = said.where("role = 'user' and turn > 0")
    results = answered.select("conv_id", "turn", ident(F.when(F.col("n") % 19 == 0, F.col("turn") + 1000).otherwise(
        F.col("turn") - 1)).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op4_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results of all conversations, linked, ordered, checked and written as JSON."""
    return linked_calls(*derived(table(spark, sf_dir, "conversations")))


QUERIES = {"op4_toolcalls": op4_toolcalls}
