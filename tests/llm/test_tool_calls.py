"""Tool-call linking against a plain-Python version and planted cases."""

import json

import pyarrow as pa
import pytest

from prefloom.llm import tool_calls as tc


def brute(calls, results):
    """Rows (conv_id, seq, kind, call_id, level, linked, error, message) from lists of dicts."""
    out = []
    for conv in {c["conv_id"] for c in calls} | {r["conv_id"] for r in results}:
        mine = {}
        for c in sorted((c for c in calls if c["conv_id"] == conv and conv is not None and c["call_id"] is not None), key=lambda c: (c["turn"], c["name"], c["arguments"])):
            mine.setdefault(c["call_id"], c)
        first, orphans = {}, []
        for r in sorted((r for r in results if r["conv_id"] == conv), key=lambda r: (r["turn"], r["content"] or "")):
            if conv is not None and r["call_id"] in mine and r["call_id"] not in first:
                first[r["call_id"]] = r
            else:
                orphans.append(r)
        refs, info = {}, {}
        for k, c in mine.items():
            try:
                v = tc.parse_json(c["arguments"] or "")
                info[k] = (v, "unknown tool" if c["name"] not in tc.SCHEMAS else "; ".join(tc.violations(v, tc.SCHEMAS[c["name"]])))
                refs[k] = [x for x in tc.references(v) if x in mine]
            except ValueError:
                info[k], refs[k] = (None, "not JSON"), []
        level = {}
        while True:
            new = {k: max([level[x] + 1 for x in refs[k]], default=0) for k in mine if k not in level and all(x in level for x in refs[k])}
            if not new:
                break
            level |= new
        rows = sorted(mine, key=lambda k: (k not in level, level.get(k, 0), mine[k]["turn"], k))
        for k in rows:
            v, e = info[k]
            m = {"arguments": v, "id": k, "name": mine[k]["name"], "result": first[k]["content"] if k in first else None, "valid": e == ""}
            out.append((conv, "call", k, level.get(k), k in first, e, tc.canonical(m)))
        out += [(conv, "orphan", r["call_id"], None, False, "no call", tc.canonical({"id": r["call_id"], "result": r["content"]})) for r in sorted(orphans, key=lambda r: (r["turn"], r["call_id"] or ""))]
    return out


def got(df):
    return [(r.conv_id, r.kind, r.call_id, r.level, r.linked, r.error, r.message) for r in df.orderBy("conv_id", "seq").collect()]


def test_query_against_brute_force(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    calls, results = tc.derived_calls(turns)
    want = brute([r.asDict() for r in calls.collect()], [r.asDict() for r in results.collect()])
    rows = got(tc.link_calls(calls, results, tc.SCHEMAS))
    assert rows == sorted(want, key=lambda x: x[0])
    assert {x[5] for x in rows} >= {"", "not JSON", "no call"} and any(x[3] and x[3] > 0 for x in rows)
    for x in rows:
        assert tc.canonical(json.loads(x[6])) == x[6]


CALLS = "conv_id long, turn int, call_id string, name string, arguments string, content string"
RESULTS = "conv_id long, turn int, call_id string, content string, name string"


def test_edges(spark):
    ref = lambda x: json.dumps({"key": {"$ref": x}, "strict": True})
    calls = [
        (1, 5, "a", "lookup", ref("b"), "clash"),
        (1, 6, "b", "lookup", ref("c"), "clash"),
        (1, 7, "c", "lookup", '{"strict":true,"key":"k"}', None),
        (1, 7, "c", "lookup", '{"strict":true,"key":"z"}', None),  # a repeated id
        (2, 0, "x", "lookup", ref("y"), None),  # a cycle, and a call behind it
        (2, 1, "y", "lookup", ref("x"), None),
        (2, 2, "z", "lookup", ref("y"), None),
        (3, 0, "n", "search", None, None),
        (3, 1, "m", "search", '{"query":"","limit":0,"more":1}', None),
        (3, 2, "dup", "lookup", '{"key":"a","key":"b","strict":true}', None),
        (3, 3, "nan", "calculate", '{"op":"add","values":[NaN]}', None),
        (None, 0, "q", "lookup", "{}", None),
        (4, 0, None, "lookup", "{}", None),
    ]
    results = [
        (1, 8, "a", 'quote " \\ \n\x01 é', "clash"),
        (1, 8, "a", "second", None),
        (2, 3, "nobody", None, None),
        (2, 4, None, "t", None),
        (None, 0, "q", "t", None),
    ]
    c, r = spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)
    rows = {(x.conv_id, x.call_id, x.kind): x for x in tc.link_calls(c, r, tc.SCHEMAS).collect()}
    assert [rows[1, k, "call"].level for k in "abc"] == [2, 1, 0]
    assert [rows[1, k, "call"].seq for k in "cba"] == [0, 1, 2]
    assert json.loads(rows[1, "a", "call"].message)["result"] == 'quote " \\ \n\x01 é'
    assert json.loads(rows[1, "c", "call"].message)["arguments"]["key"] == "k"
    assert rows[1, "a", "orphan"].message == '{"id":"a","result":"second"}'
    assert [rows[2, k, "call"].level for k in "xyz"] == [None] * 3
    assert rows[3, "n", "call"].error == "not JSON" and rows[3, "dup", "call"].error == "not JSON" and rows[3, "nan", "call"].error == "not JSON"
    assert rows[3, "m", "call"].error == "$.more: unknown; $.limit: below minimum; $.query: too short"
    assert rows[2, None, "orphan"] and rows[None, "q", "orphan"] and (None, "q", "call") not in rows
    assert tc.link_calls(c.limit(0), r.limit(0), tc.SCHEMAS).count() == 0
    assert tc.link_calls(c.limit(0), r, tc.SCHEMAS).count() == 5


@pytest.mark.parametrize(("value", "text"), [({"b": 1.0, "a": [1e2, 0.5]}, '{"a":[100,0.5],"b":1}'), ("é\n", '"é\\n"'), (1e300, "1e+300")])
def test_canonical(value, text):
    assert tc.canonical(value) == text


def test_schema_size_is_checked(spark):
    c, r = spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)
    with pytest.raises(ValueError, match="larger"):
        tc.link_calls(c, r, {"t": {"enum": ["x" * (17 << 20)]}})


def test_deep_surrogate_and_long_arguments_do_not_fail(spark):
    deep = '{"query":' + "[" * 1500 + "]" * 1500 + ',"limit":1}'
    rows = [(1, 0, "a", "search", deep), (1, 1, "b", "search", '{"query":"\\ud800","limit":1,"\\udfff":2}'), (1, 2, "c", "search", '{"query":"x","limit":' + "7" * 5000 + "}")]
    schemas = {"search": {"type": "object", "properties": {"query": {"type": ["string", "array"]}, "limit": {"type": "integer"}}, "additionalProperties": False}}
    names, args = pa.array([r[3] for r in rows]), pa.array([r[4] for r in rows])
    out = [b.to_pydict() for b in tc._checker(schemas)(iter([pa.RecordBatch.from_arrays([names, args], ["name", "arguments"])]))]
    text = str(out)
    assert "[" * 1500 + "]" * 1500 in text and "7" * 5000 in text and "ud800" in text and "unknown" in text
    assert "not JSON" not in text
    assert tc.parse_json(tc.canonical(tc.parse_json(rows[1][4]))) == tc.parse_json(rows[1][4])


def test_canonical_equals_the_library_on_flat_values():
    for v in ({"b": [1, 2.0, {"a": None}], "a": "é\n"}, [], {}, [[], {}], "x", 1.5, True):
        want = json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False).replace("2.0", "2")
        assert tc.canonical(v) == want
