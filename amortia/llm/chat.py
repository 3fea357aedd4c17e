"""Tool-call linking for chat data.

Calls and results are joined by identifier (conversation, call id), both sides aggregated to one row per identifier
first. Calls that name the calls they depend on are put in topological order, by the depth of a call: its longest way back
to a call without a parent. With one parent a call (``depends_on`` is text) it is found by pointer doubling, in a logarithmic
number of joins; with several (an array) layer by layer, one join a layer. Calls on a cycle, and those behind it, have no depth
and come last. Inside a conversation calls are numbered by (depth, turn, call id): rows are
range-partitioned on that order, numbered in their partition, and shifted by the counts of the partitions before, so a
conversation with a third of all rows is spread over tasks. Arguments are validated against the tool's schema, and each
linked call becomes one line of canonical JSON (sorted keys, no blanks, UTF-8). A schema gives per parameter
``(type, required)``, or a mapping with ``type``, ``required``, ``enum``, ``minimum``, ``maximum``, ``items`` (of an array)
and ``properties`` (of an object).

Cases: of several calls of one identifier the earliest stays and ``n_calls`` counts them; of several results the earliest
stays; a result without a call is a row of status ``orphan_result``; a call without a result has ``no_result``; a parent that
does not exist is ignored; null arguments, and text that is no JSON object, are invalid, as are NaN, numbers beyond
doubles and escaped halves of surrogate pairs, of which no canonical JSON is made (the message holds the text as it came); of a
key that comes twice the last value counts and an error tells; an unknown tool is an error;
null identifiers link with nothing; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amortia.llm.common import ship, shuffle_partitions, staged

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


class _NotFinite(ValueError):
    pass


def _finite(text: str) -> float:
    v = float(text)
    if v != v or v in (float("inf"), float("-inf")):
        raise _NotFinite(text)
    return v


def _rules(spec) -> dict:
    return spec if isinstance(spec, dict) else {"type": spec[0], "required": spec[1]}


def _check(value, spec: dict, path: str, errors: list[str]) -> None:
    """Errors of one value against its rules, nested ones with their path."""
    kind = spec["type"]
    if not isinstance(value, _TYPES[kind]) or (isinstance(value, bool) and kind in ("integer", "number")):
        errors.append(f"type:{path}")
        return
    if "enum" in spec and value not in spec["enum"]:
        errors.append(f"enum:{path}")
    if ("minimum" in spec and value < spec["minimum"]) or ("maximum" in spec and value > spec["maximum"]):
        errors.append(f"range:{path}")
    if kind == "array" and "items" in spec:
        for i, x in enumerate(value):
            _check(x, _rules(spec["items"]), f"{path}[{i}]", errors)
    if kind == "object" and "properties" in spec:
        _members(value, spec["properties"], f"{path}.", errors)


def _members(value: dict, schema: dict, path: str, errors: list[str]) -> None:
    rules = {p: _rules(s) for p, s in schema.items()}
    errors += [f"missing:{path}{p}" for p, s in rules.items() if s.get("required") and p not in value]
    for p, v in value.items():
        if p in rules:
            _check(v, rules[p], f"{path}{p}", errors)
        else:
            errors.append(f"unknown:{path}{p}")


def validate(arguments: str | None, schema: dict | None) -> tuple[object, list[str]]:
    """Parsed arguments (None if they are no JSON object, or none that has a canonical form) and the errors against the
    schema ``{parameter: rules}``."""
    twice: list[str] = []

    def members(pairs):
        out = dict(pairs)
        if len(out) < len(pairs):
            names = [k for k, _ in pairs]
            twice.extend(sorted({k for k in names if names.count(k) > 1}))
        return out

    try:
        value = json.loads(arguments, parse_constant=_finite, parse_float=_finite, object_pairs_hook=members) if arguments is not None else None
        if isinstance(value, dict):
            canonical(value).encode()
    except _NotFinite:
        return None, ["not_finite"]
    except UnicodeEncodeError:
        return None, ["not_unicode"]
    except (ValueError, RecursionError):
        value = None
    if not isinstance(value, dict):
        return None, ["not_an_object"]
    errors = [f"repeated:{k}" for k in twice]
    if schema is None:
        return value, sorted([*errors, "unknown_tool"])
    _members(value, schema, "", errors)
    # names come from the text: halves of surrogate pairs were refused above
    return value, sorted(errors)


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): depth null for calls on or behind a cycle. Pointer doubling."""
    ids = calls.select("conv_id", "call_id")
    parents = calls.select("conv_id", "call_id", F.col("depends_on").alias("up"))
    known = ids.select(F.col("conv_id").alias("p_conv"), F.col("call_id").alias("p_id"))
    state = (parents.join(known, (F.col("conv_id") == F.col("p_conv")) & (F.col("up") == F.col("p_id")), "left")
             .select("conv_id", "call_id", F.col("p_id").alias("up"), F.when(F.col("p_id").isNull(), 0).otherwise(1).cast("long").alias("way")))
    state = staged(state, "depths")
    total, rounds = state.count(), 0
    while rounds <= total.bit_length() and not state.where("up is not null").isEmpty():
        above = state.select(F.col("conv_id").alias("a_conv"), F.col("call_id").alias("a_id"), F.col("up").alias("a_up"), F.col("way").alias("a_way"))
        state = staged(state.join(above, (F.col("conv_id") == F.col("a_conv")) & (F.col("up") == F.col("a_id")), "left")
                       .select("conv_id", "call_id", F.col("a_up").alias("up"), (F.col("way") + F.coalesce("a_way", F.lit(0))).alias("way")), "depths")
        rounds += 1
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("way")).alias("depth"))


def layered_depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) of calls with several parents (``depends_on``: array): a call is placed one layer behind the
    last of its parents. A round joins the layer that was placed last with the calls that wait for it."""
    ids = calls.select("conv_id", "call_id")
    edges = calls.select("conv_id", "call_id", F.explode(F.array_distinct(F.filter("depends_on", lambda x: x.isNotNull()))).alias("up"))
    known = ids.select(F.col("conv_id").alias("p_conv"), F.col("call_id").alias("p_id"))
    edges = staged(edges.join(known, (F.col("conv_id") == F.col("p_conv")) & (F.col("up") == F.col("p_id")), "left_semi"), "edges")
    waits = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("waits"))
    open_ = staged(waits, "waits")
    layer = staged(ids.join(open_, ["conv_id", "call_id"], "left_anti").withColumn("depth", F.lit(0).cast("long")), "layer")
    placed, k = [layer], 0
    while not layer.isEmpty():
        k += 1
        done = layer.select(F.col("conv_id").alias("p_conv"), F.col("call_id").alias("p_id"))
        met = edges.join(done, (F.col("conv_id") == F.col("p_conv")) & (F.col("up") == F.col("p_id"))).groupBy("conv_id", "call_id").agg(F.count("*").alias("met"))
        rest = staged(open_.join(met, ["conv_id", "call_id"], "left").select("conv_id", "call_id", (F.col("waits") - F.coalesce("met", F.lit(0))).alias("waits")), "waits")
        layer = staged(rest.where("waits = 0").select("conv_id", "call_id", F.lit(k).cast("long").alias("depth")), "layer")
        open_ = rest.where("waits > 0")
        placed.append(layer)
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return ids.join(out, ["conv_id", "call_id"], "left")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """``calls(conv_id, call_id, turn, name, arguments, depends_on)`` and ``results(conv_id, call_id, turn, content)`` ->
    conv_id, call_id, turn, name, depth, ordinal, status, valid, errors, n_calls, message (canonical JSON)."""
    spark = calls.sparkSession
    ship(spark)
    c = staged(calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c"), F.count("*").alias("n_calls"))
        .select("conv_id", "call_id", "c.*", "n_calls"), "calls")
    r = (results.where("conv_id is not null and call_id is not null").groupBy(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id"))
         .agg(F.min(F.struct("turn", "content")).alias("r")))
    several = dict(calls.dtypes)["depends_on"].startswith("array")
    d = (layered_depths if several else depths)(c).withColumnsRenamed({"conv_id": "d_conv", "call_id": "d_id"})
    linked = (c.join(d, (F.col("conv_id") == F.col("d_conv")) & (F.col("call_id") == F.col("d_id")))
              .join(r, (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_id")), "full")
              .select(F.coalesce("conv_id", "r_conv").alias("conv_id"), F.coalesce("call_id", "r_id").alias("call_id"),
                      F.coalesce("turn", "r.turn").cast("long").alias("turn"), "name", "arguments", "depth", F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
                      F.when(F.col("d_id").isNull(), "orphan_result").when(F.col("r_id").isNull(), "no_result").otherwise("linked").alias("status"),
                      F.col("r.content").alias("content")))
    order = ["conv_id", F.when(F.col("status") == "orphan_result", 2).when(F.col("depth").isNull(), 1).otherwise(0), "depth", "turn", "call_id"]
    spread = linked.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    kinds = dict(linked.dtypes)

    def run(batches):
        conv, n = None, 0
        for b in batches:
            place, valid, errors, message = [], [], [], []
            cols = [b.column(x).to_pylist() for x in ("conv_id", "call_id", "name", "arguments", "content", "status")]
            for conv_id, call_id, name, arguments, content, status in zip(*cols):
                n = n + 1 if conv_id == conv else 0
                conv = conv_id
                place.append(n)
                if status == "orphan_result":
                    valid.append(None)
                    errors.append([])
                    message.append(canonical({"call_id": call_id, "content": content}))
                    continue
                value, wrong = validate(arguments, schemas.get(name))
                valid.append(not wrong)
                errors.append(wrong)
                out = {"arguments": arguments if value is None else value, "call_id": call_id, "name": name}
                if status == "linked":
                    out["result"] = content
                message.append(canonical(out))
            yield pa.RecordBatch.from_arrays(
                [b.column(x) for x in ("conv_id", "call_id", "turn", "name", "depth", "n_calls", "status")]
                + [pa.array(place, pa.int64()), pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(message, pa.string())],
                names=["conv_id", "call_id", "turn", "name", "depth", "n_calls", "status", "place", "valid", "errors", "message"])

    numbered = staged(spread.mapInArrow(run, f"conv_id {kinds['conv_id']}, call_id {kinds['call_id']}, turn long, name string, depth long, n_calls long, "
                                             "status string, place long, valid boolean, errors array<string>, message string")
                      .withColumn("part", F.spark_partition_id()), "numbered")
    # a conversation has one row here for each partition that it spans
    before = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn(
        "offset", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).where("offset > 0").select("conv_id", "part", "offset")
    return numbered.join(before, ["conv_id", "part"], "left").select(
        "conv_id", "call_id", "turn", "name", "depth", (F.col("place") + F.coalesce("offset", F.lit(0))).alias("ordinal"),
        "status", "valid", "errors", "n_calls", "message")


# ---- tool calls out of plain conversations -----------------------------------------------------

SCHEMAS = {"search": {"query": ("string", True), "limit": ("integer", False)},
           "measure": {"query": ("string", True), "limit": ("integer", True)},
           "lookup": {"query": ("string", True)}}


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in ``conversations(conv_id, turn, role, text)``: every user turn asks a tool (by its length), some
    with arguments of a wrong type or cut off; the assistant turn behind it is the result; each call depends on the one two turns before."""
    n = F.length("text")
    user = conversations.where("role = 'user' and text is not null")
    tool = F.element_at(F.array(F.lit("search"), F.lit("measure"), F.lit("lookup")), (n % 3 + 1).cast("int"))
    full = F.to_json(F.struct(F.col("text").alias("query"), F.when(n % 3 != 2, n).alias("limit")))
    typed = F.when(n % 7 == 0, F.to_json(F.struct(n.cast("string").alias("limit"), F.col("text").alias("query")))).otherwise(full)
    arguments = F.when(n % 11 == 0, F.expr("substring(to_json(struct(text as query)), 1, 9)")).otherwise(typed)
    calls = user.select("conv_id", F.concat(F.lit("t"), F.col("turn")).alias("call_id"), "turn", tool.alias("name"), arguments.alias("arguments"),
                        F.when(F.col("turn") >= 2, F.concat(F.lit("t"), F.col("turn") - 2)).alias("depends_on"))
    results = conversations.where("role = 'assistant'").select("conv_id", F.concat(F.lit("t"), F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


ORACLE = """
WITH RECURSIVE c AS (SELECT conv_id, 't' || turn AS call_id, turn, text, length(text) n, CASE length(text) % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'measure' ELSE 'lookup' END AS name,
  CASE WHEN turn >= 2 THEN 't' || (turn - 2) END AS up FROM conversations WHERE role = 'user' AND text IS NOT NULL),
r AS (SELECT conv_id, 't' || (turn - 1) AS call_id, turn, text AS content FROM conversations WHERE role = 'assistant'),
d(conv_id, call_id, depth) AS (SELECT conv_id, call_id, 0 FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.call_id = c.up)
  UNION ALL SELECT c.conv_id, c.call_id, d.depth + 1 FROM d JOIN c ON c.conv_id = d.conv_id AND c.up = d.call_id),
j AS (SELECT coalesce(c.conv_id, r.conv_id) conv_id, coalesce(c.call_id, r.call_id) call_id, coalesce(c.turn, r.turn) turn, c.text, n, name, depth, content,
  CASE WHEN c.call_id IS NULL THEN 'orphan_result' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'linked' END status
  FROM (SELECT c.*, d.depth FROM c JOIN d USING (conv_id, call_id)) c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id),
s AS (SELECT *, CASE WHEN n % 11 = 0 THEN to_json(left('{"query":' || to_json(text)::VARCHAR || '}', 9))::VARCHAR
  WHEN n % 7 = 0 THEN '{"limit":"' || n || '","query":' || to_json(text)::VARCHAR || '}'
  WHEN n % 3 <> 2 THEN '{"limit":' || n || ',"query":' || to_json(text)::VARCHAR || '}' ELSE '{"query":' || to_json(text)::VARCHAR || '}' END arg FROM j)
SELECT conv_id, call_id, turn, name, depth::BIGINT AS depth, row_number() OVER (PARTITION BY conv_id ORDER BY (status = 'orphan_result')::INT, depth, turn, call_id) - 1 AS ordinal, status,
  CASE WHEN status = 'orphan_result' THEN NULL ELSE n % 11 <> 0 AND n % 7 <> 0 END AS valid,
  sha256(CASE status WHEN 'orphan_result' THEN '{"call_id":"' || call_id || '","content":' || coalesce(to_json(content)::VARCHAR, 'null') || '}'
    ELSE '{"arguments":' || arg || ',"call_id":"' || call_id || '","name":"' || name || '"' || CASE WHEN status = 'linked' THEN ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') ELSE '' END || '}' END) AS message_sha256
FROM s"""
