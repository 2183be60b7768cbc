import json

from tarnwork.operators.nested import REPEATED, one_table, pivot_rows, to_triples, triples

NAMES = frozenset(REPEATED)


def objects(payload):
    return sorted((p, q) for p, q, *_, f, _ in triples(payload, NAMES) if f is None)


def test_paths_and_positions():
    doc = {"outcome": {"goals": [{"text": "a", "steps": [{"artifacts": [{"path": "x"}, None, {"path": "y"}]}, {}]}, {"steps": []}]}}
    assert objects(json.dumps(doc)) == [("goals", "0"), ("goals", "1"), ("goals.steps", "0.0"), ("goals.steps", "0.1"), ("goals.steps.artifacts", "0.0.0"), ("goals.steps.artifacts", "0.0.2")]


def test_strings_lone_objects_and_lists_in_lists():
    assert objects('{"files":{"path":"a"}}') == [("files", "0")]
    assert objects(json.dumps({"results": json.dumps([{"a": 1}, {"b": 2}])})) == [("results", "0"), ("results", "1")]
    assert objects(json.dumps(json.dumps({"v": 2, "payload": json.dumps({"files": [[{"p": 1}], {"p": 2}]})}))) == [("files", "0.0"), ("files", "1")]
    assert objects('{"tags":[{"x":1},{"steps":[{"y":1}]}]}') == [("steps", "1.0")]
    assert objects('{"files":["a","b",3,null]}') == []


def test_blanks_of_any_number_before_json_in_a_string():
    for blanks in ("", " " * 7, " \t\n" * 70):
        assert objects(json.dumps({"files": blanks + '[{"path": 1}]'})) == [("files", "0")]


def test_invalid_payloads():
    for text in (None, "", "{", '{"files":[{}', '{"files":[{"a":NaN}]}', '{"files":[{}]} x', "[" * 5000, "null", "3"):
        assert triples(text, NAMES) == []


def test_deep_nesting_does_not_exhaust_the_stack():
    text = '{"a":' * 900 + '{"files":[{"x":1}]}' + "}" * 900
    assert objects(text) == [("files", "0")]


def test_pivot_into_tables_with_parent_links(spark):
    docs = [(1, '{"reviews":[{"author":"a","comments":[{"path":"p","line":3},{"path":"q"}]},{"author":"b"}]}', "x"), (1, '{"reviews":[{"author":"a","comments":[{"path":"p","line":3},{"path":"q"}]},{"author":"b"}]}', "y"), (None, '{"files":[{}]}', ""), (2, None, "")]
    rows = pivot_rows(to_triples(spark.createDataFrame(docs, "seq bigint, data string, path string"), "seq", "data"))
    reviews = sorted(tuple(r) for r in one_table(rows, "reviews", ["author"]).collect())
    assert reviews == [(1, "0", "", "", "a"), (1, "1", "", "", "b")]
    comments = sorted(tuple(r) for r in one_table(rows, "reviews.comments", ["path", "line"]).fillna("-").collect())
    assert comments == [(1, "0.0", "reviews", "0", "p", "3"), (1, "0.1", "reviews", "0", "q", "-")]
    empty = spark.createDataFrame([], "seq bigint, data string")
    assert pivot_rows(to_triples(empty, "seq", "data")).count() == 0


def test_long_payload(spark):
    data = json.dumps({"files": [{"path": f"f{i}"} for i in range(60_000)]})
    df = spark.createDataFrame([(7, data)], "seq bigint, data string")
    assert pivot_rows(to_triples(df, "seq", "data")).count() == 60_000
