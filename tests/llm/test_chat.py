import json

from amortia.llm import chat

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on string, status string, depth int"
RESULTS = "conv_id long, call_id string, turn long, content string, r string"


def linked(spark, calls, results):
    c = spark.createDataFrame([(*x, "s", 1) for x in calls], CALLS)
    r = spark.createDataFrame([(*x, "z") for x in results], RESULTS)
    return {(x.conv_id, x.call_id): x for x in chat.link_tool_calls(c, r, chat.SCHEMAS).collect()}


def test_links_order_and_validation(spark):
    good = '{"query": "q", "limit": 3}'
    calls = [(1, "b", 5, "search", good, "a"), (1, "a", 9, "search", '{"limit":1,"query":"é\\n"}', None), (1, "c", 1, "measure", '{"query":"x"}', "b"),
             (1, "d", 2, "lookup", '{"query":1,"more":2}', None), (1, "e", 3, "nope", "{}", "missing"), (1, "f", 4, "search", "{bad", "g"),
             (1, "g", 4, "search", None, "f"), (1, "h", 4, "search", "[1]", "g"), (2, "a", 0, "measure", '{"query":"x","limit":true}', None),
             (3, "a", 1, "search", good, None), (3, "a", 0, "search", '{"query":"first"}', None), (None, "a", 0, "search", good, None)]
    results = [(1, "a", 10, "ok"), (1, "a", 7, "earlier"), (1, "z", 1, None), (2, "a", 1, None), (9, "a", 1, "lost"), (1, None, 1, "x")]
    out = linked(spark, calls, results)
    assert {k: out[1, k].depth for k in "abcdefgh"} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 0, "f": None, "g": None, "h": None}
    assert sorted("abcdefghz", key=lambda k: out[1, k].ordinal) == list("deabcfghz")
    assert [out[1, k].ordinal for k in "deabcfghz"] == list(range(9))
    assert out[1, "z"].status == out[9, "a"].status == "orphan_result" and out[1, "b"].status == "no_result" and out[1, "a"].status == "linked"
    assert json.loads(out[1, "a"].message)["result"] == "earlier"
    assert out[1, "a"].message == '{"arguments":{"limit":1,"query":"é\\n"},"call_id":"a","name":"search","result":"earlier"}'
    assert out[1, "b"].valid and out[1, "c"].errors == ["missing:limit"] and out[1, "d"].errors == ["type:query", "unknown:more"]
    assert out[1, "e"].errors == ["unknown_tool"] and out[1, "f"].errors == out[1, "g"].errors == out[1, "h"].errors == ["not_an_object"]
    assert out[2, "a"].errors == ["type:limit"] and json.loads(out[2, "a"].message)["result"] is None
    assert out[3, "a"].n_calls == 2 and json.loads(out[3, "a"].message)["arguments"] == {"query": "first"}
    assert len(out) == 12


def test_a_large_conversation_is_numbered_through(spark):
    n = 700
    calls = [(1, f"t{i}", i, "lookup", '{"query":"x"}', f"t{i - 1}" if i and i % 50 else None) for i in range(n)] + [(2, "a", 0, "lookup", None, None)]
    out = linked(spark, calls, [])
    order = sorted((c for c in out.values() if c.conv_id == 1), key=lambda c: (c.depth, c.turn, c.call_id))
    assert [c.ordinal for c in order] == list(range(n)) and max(c.depth for c in order) == 49


def test_empty_tables(spark):
    assert linked(spark, [], []) == {}
    assert linked(spark, [], [(1, "a", 0, "x")])[1, "a"].status == "orphan_result"


def test_arguments_without_a_canonical_form_do_not_end_the_job(spark):
    bad = ['{"query":"\\ud800"}', '{"\\udc00":1}', '{"query":NaN}', '{"query":1e999}', '{"query":-Infinity}', '{"query":"a","query":"b"}', "[" * 100_000,
           '{"query":"' + "x" * 300_000 + '"}', '{"query":"\\ud83d\\ude00"}']
    out = linked(spark, [(1, f"c{i}", i, "lookup", a, None) for i, a in enumerate(bad)], [(1, "c0", 1, "done")])
    got = [(out[1, f"c{i}"].valid, out[1, f"c{i}"].errors) for i in range(len(bad))]
    assert got == [(False, ["not_unicode"])] * 2 + [(False, ["not_finite"])] * 3 + [(False, ["repeated:query"]), (False, ["not_an_object"]), (True, []), (True, [])]
    assert json.loads(out[1, "c0"].message) == {"arguments": bad[0], "call_id": "c0", "name": "lookup", "result": "done"}
    assert json.loads(out[1, "c2"].message)["arguments"] == bad[2] and json.loads(out[1, "c5"].message)["arguments"] == {"query": "b"}
    assert all("NaN" not in m.message or i == 2 for i, m in ((int(k[1][1:]), v) for k, v in out.items()))


def test_nested_schemas():
    schema = {"unit": {"type": "string", "required": True, "enum": ["c", "f"]}, "n": {"type": "integer", "minimum": 1, "maximum": 9},
              "points": {"type": "array", "items": {"type": "object", "properties": {"x": ("number", True), "tag": ("string", False)}}}}
    check = lambda v: chat.validate(json.dumps(v), schema)[1]
    assert check({"unit": "c", "n": 9, "points": [{"x": 1.5, "tag": "a"}, {"x": 2}]}) == []
    assert check({"unit": "k", "n": 10, "points": [{"x": "1"}, {"y": 2}, 3]}) == [
        "enum:unit", "missing:points[1].x", "range:n", "type:points[0].x", "type:points[2]", "unknown:points[1].y"]
    assert check({"n": True}) == ["missing:unit", "type:n"]


def test_calls_with_several_parents(spark):
    edges = {"a": [], "b": ["a", None, "a"], "c": ["a", "b"], "d": ["c", "a", "missing"], "e": ["d", "f"], "f": [], "g": ["h"], "h": ["g"], "i": ["a", "g"]}
    c = spark.createDataFrame([(1, k, 0, "lookup", "{}", up) for k, up in edges.items()] + [(2, "c", 0, "lookup", "{}", None)],
                              "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    r = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    out = {(x.conv_id, x.call_id): x for x in chat.link_tool_calls(c, r, chat.SCHEMAS).collect()}
    assert {k: out[1, k].depth for k in edges} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4, "f": 0, "g": None, "h": None, "i": None}
    assert out[2, "c"].depth == 0 and [k for k in sorted(edges, key=lambda k: out[1, k].ordinal)] == list("afbcdeghi")
