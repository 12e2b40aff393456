"""Schema drift, nested documents and copy differences on small fixtures, against results written by hand or by brute force."""

import json
from datetime import datetime

import pytest

from sixline.operators import dewey, diff, drift

FILES = "file_id long, feed string, file_name string, released_at timestamp, received_at timestamp"
RECORDS = "file_id long, row_no int, record string"


def _files(spark, ids):
    return spark.createDataFrame([(i, "f", "x", datetime(2025, 1, 1 + k), datetime(2025, 2, 1)) for k, i in enumerate(ids)], FILES)


def _changes(spark, contents, ids=None):
    rows = [(i, k, r if isinstance(r, str) or r is None else json.dumps(r)) for i, rs in contents.items() for k, r in enumerate(rs)]
    got = drift.changes(_files(spark, ids or list(contents)), spark.createDataFrame(rows, RECORDS))
    return {(r.file_id, r.field, r.change) for r in got.collect()}


def test_drift_kinds(spark):
    got = _changes(spark, {
        3: [{"direction": "up", "is_stressed": True}],
        1: [{"dir": 1, "is_stressed": None}, {"dir": None}],
        2: [{"dir": 1.0, "isActivated": "yes", "is_stressed": 1}],
    })
    assert got == {(1, "direction", "renamed"), (1, "direction", "retyped"), (2, "direction", "retyped"), (2, "is_activated", "added")}


def test_drift_ignores_notes_and_counts(spark):
    got = _changes(spark, {1: [{"stress_note": "x"}], 2: [{"active_count": 4}], 3: [{"direction_note": "y", "stressed": 0}]})
    assert got == {(3, "is_stressed", "added")}


def test_drift_broken_records(spark):
    got = _changes(spark, {1: ['{"direction": 1', None, "", "[1]", "null", '{"direction": "up"}'], 2: ['{"direc'], 3: ['{"direction": null}']})
    assert got == {(2, "direction", "removed"), (3, "direction", "added")}


def test_drift_empty(spark):
    assert drift.changes(spark.createDataFrame([], FILES), spark.createDataFrame([], RECORDS)).count() == 0


def test_lines_and_failures(spark):
    rows = [(1, 0, '{"hexagram_id": 3, "line_number": "6", "lineDirection": "↑", "stressed": "Y"}'), (1, 1, '{"hexagram_id": 3, "line_number": "6", "lineDirection": "↑", "stressed": "Y"}'), (1, 2, '{"direction": "sideways"}'), (1, 3, "{")]
    records = spark.createDataFrame(rows, RECORDS)
    got = drift.lines(records).orderBy("row_no").collect()
    assert [(r.row_no, r.hexagram_id, r.line_number, r.direction, r.is_stressed) for r in got] == [(0, 3, 6, "rising", True), (2, None, None, None, None)]
    assert {(r.field, r.rows) for r in drift.cast_failures(records).collect()} == {("direction", 1), ("", 1)}


def test_drift_own_name_holds_whatever_the_values(spark):
    long = [{"direction": "strongly rising"}, {"direction": "up"}]
    assert _changes(spark, {1: [{"direction": "up"}], 2: long}) == set()
    records = spark.createDataFrame([(2, i, json.dumps(r)) for i, r in enumerate(long)], RECORDS)
    assert [(r.direction) for r in drift.lines(records).orderBy("row_no").collect()] == [None, "rising"]
    assert {(r.field, r.rows) for r in drift.cast_failures(records).collect()} == {("direction", 1)}


def test_drift_parts_of_names_need_values(spark):
    assert _changes(spark, {1: [{"is_stressed": True}], 2: [{"is_stressed": True, "stress_source": "wind"}]}) == set()


def test_drift_names_that_say_nothing(spark):
    got = _changes(spark, {1: [{"direction": "up"}], 2: [{"vector": "up"}, {"vector": "down"}, {"batch": 1}], 3: [{"orientation": 1}, {"orientation": -1}, {"flagged": 0}]})
    assert got == {(2, "direction", "renamed"), (3, "direction", "renamed"), (3, "direction", "retyped")}


def test_drift_trailing_content_and_nested_paths(spark):
    got = _changes(spark, {1: [{"direction": "up"}], 2: ['{"direction": "up"}{"is_stressed": 1}', {"line": {"state": {"direction": "up"}}}]})
    assert got == {(2, "direction", "renamed")}


def test_drift_reports_every_field(spark):
    rows = [(1, 0, '{"category": "a", "weight": 1}'), (2, 0, '{"category": 3, "extra": {"note": "x"}}')]
    got = drift.changes(_files(spark, [1, 2]), spark.createDataFrame(rows, RECORDS), every=True).collect()
    assert {(r.field, r.change) for r in got} == {("category", "retyped"), ("weight", "removed"), ("extra.note", "added")}


def test_report_and_lines_take_paths_in_one_order(spark):
    rows = [(1, 0, '{"dir": "up", "direction": null}'), (1, 1, '{"dir": "down", "direction": "flat"}')]
    records = spark.createDataFrame(rows, RECORDS)
    assert [(r.field, r.name) for r in drift.file_fields(records).collect()] == [("direction", "direction")]
    got = drift.lines(records).orderBy("row_no").collect()
    assert [r.direction for r in got] == ["rising", "stable"] and got[0].others == {}


def test_json_of_any_depth():
    from sixline.operators.jsontext import Reader

    r = Reader()
    for text in ['{"a": [1, {"b": null}, []], "c": {"d": "x\\u00e9", "e": -1.5e3}}', " [true, false, {}] ", "3", '"s"']:
        assert r._looped(text) == json.loads(text) and r.read(text) == (True, json.loads(text))
    for text in ["", "{", "[1,]", '{"a" 1}', "[1] 2", "{'a': 1}", "NaN", "01", '{"a": 1,}', "tru"]:
        assert r.read(text) == (False, None)
        with pytest.raises((ValueError, IndexError)):
            r._looped(text)
    deep = "[" * 200_000 + "]" * 200_000
    assert r.read(deep)[0] and not r.read(deep[:-1])[0]


CAPTURES, SNAPSHOTS = "capture_id long, payload string", "snapshot_id long, payload string"


def _elements(spark, captures=(), snapshots=()):
    c = spark.createDataFrame([(i, p) for i, p in captures], CAPTURES)
    s = spark.createDataFrame([(i, p) for i, p in snapshots], SNAPSHOTS)
    return {tuple(r)[1:] for r in dewey.elements(c, s).collect()}


@pytest.mark.parametrize("wrap", [lambda o: o, lambda o: {"capture_detailed": o, "engine": None}, lambda o: json.dumps(o), lambda o: {"run": 1, "captures": [{"label": "input=10", **o["10"]}]}])
def test_capture_layouts(spark, wrap):
    doc = {"10": {"label": "input=10", "top12": [[7, 0.1], None, {"hexagram": 9, "weight": 0.2}, "25:0.3"], "score_details_first3": [{"hex_score": 0.001}, None, [{"w": 1}, {"hex_score": "0.000000002"}, {"scores": {"hex_score": 3e-9}}, {"hex_score": None}]]}}
    got = _elements(spark, [(1, json.dumps(wrap(doc)))] * 2)
    assert got == {
        (1, "10", "top12", -1, 0, "7"), (1, "10", "top12", -1, 2, "9"), (1, "10", "top12", -1, 3, "25"),
        (1, "10", "hex_score", 0, 0, "1000000"), (1, "10", "hex_score", 2, 1, "2"), (1, "10", "hex_score", 2, 2, "3"),
    }


@pytest.mark.parametrize("wrap", [lambda d: {"domains": d}, lambda d: {"domain_registry": json.dumps({"domains": d})}, lambda d: {"domains": [{"name": k, **v} for k, v in d.items()]}])
def test_registry_layouts(spark, wrap):
    d = {"core": {"input_patterns": ["a", None, "b"]}, "x": {"input_patterns": "lone"}, "y": {"input_patterns": [{"pattern": "p", "optional": True}]}, "z": {"input_patterns": None}}
    got = _elements(spark, [], [(5, json.dumps(wrap(d)))])
    assert got == {(5, "core", "input_patterns", -1, 0, "a"), (5, "core", "input_patterns", -1, 2, "b"), (5, "x", "input_patterns", -1, 0, "lone"), (5, "y", "input_patterns", -1, 0, "p")}


def test_documents_that_do_not_parse(spark):
    deep = "[" * 100_000
    assert _elements(spark, [(1, None), (2, ""), (3, '{"10": {"top12": [[1'), (4, deep), (5, "null"), (6, '{"10": {}}')], [(1, "[]")]) == set()


def test_dewey_labels_link_to_parents():
    made = list(dewey.nodes('{"a": [{"b": 1}, {"b": 2}]}'))
    labels = {tuple(n[0]) for n in made}
    assert all(not label or label[:-1] in labels for label in labels) and len(labels) == len(made)
    assert [n[6] for n in made if n[3] == ".a[].b"] == ["1", "2"]
    assert all(n[1] == n[0][:-1] for n in made)


def test_parents_are_the_nearest_records():
    text = '{"a": {"10": {"x": {"deep": [[7]]}}, "20": {"x": {"deep": [[8, 9]]}}}}'
    made = list(dewey.nodes(text, keep=lambda p: p.endswith("[][]"), record=lambda p: p.startswith(".a.") and p.count(".") == 2))
    assert [(n[0], n[1], n[2], n[6]) for n in made] == [([0, 0, 0, 0, 0, 0], [0, 0], "10", "7"), ([0, 1, 0, 0, 0, 0], [0, 1], "20", "8"), ([0, 1, 0, 0, 0, 1], [0, 1], "20", "9")]


def test_documents_of_any_depth(spark):
    n = 50_000
    deep = '{"x":' * n + '{"10": {"captures": [{"label": "input=30", "top12": [5]}]}}' + "}" * n
    assert _elements(spark, [(1, deep)]) == {(1, "30", "top12", -1, 0, "5")}


def test_tables_of_every_path(spark):
    doc = {"domains": {"core": {"root": "r", "input_patterns": ["a", None]}, "other": {"root": "s", "rules": [{"n": 1}, {"n": 2.50}]}}}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "{"), (3, None), (4, " "), (5, "null")], SNAPSHOTS)
    rows = dewey.tables(df, ["snapshot_id"], "payload").collect()
    got = {(r.path, tuple(r.label), r.parent_path, r.key, r.pos): (None if r.parent_label is None else tuple(r.parent_label), r.fields) for r in rows}
    assert got[".domains{}", (0, 1), ".domains", "other", 1] == ((0,), {"root": "s"})
    assert got[".domains{}.rules[]", (0, 1, 1, 1), ".domains{}", None, 1] == ((0, 1), {"n": "2.5"})
    assert got[".domains{}.input_patterns[]", (0, 0, 1, 1), ".domains{}", None, 1] == ((0, 0), {"value": None})
    assert all(tuple(r.parent_label) == tuple(r.label)[: len(r.parent_label)] for r in rows if r.parent_label is not None)
    assert {(r.snapshot_id, r.reason) for r in dewey.rejects(df, ["snapshot_id"], "payload").collect()} == {(2, "broken"), (3, "null"), (4, "empty"), (5, "nothing")}


KEYS, SIDE = ["k"], "k int, v string, w string, t timestamp"


def _diff(spark, left, right):
    a, b = spark.createDataFrame(left, SIDE), spark.createDataFrame(right, SIDE)
    return {(r.k, r.field, r.kind) for r in diff.differences(a, b, KEYS, ["v", "w"], "t").collect()}


def test_differences(spark):
    t = lambda d: datetime(2025, 1, d)
    left = [(1, "a", "x", t(1)), (1, "old", "x", None), (2, None, "", t(1)), (2, None, "", t(1)), (3, "s", "s", t(1)), (None, "n", "n", t(1)), (5, "é", "", t(2))]
    right = [(1, "a", "x", t(3)), (1, "b", "x", t(2)), (2, "", None, t(1)), (4, "s", "s", t(1)), (None, "n", "m", t(1)), (5, "é", "", t(1))]
    assert _diff(spark, left, right) == {(2, "v", "differs"), (2, "w", "differs"), (3, "", "missing_right"), (4, "", "missing_left"), (None, "w", "differs"), (5, "v", "differs")}


def test_differences_empty(spark):
    assert _diff(spark, [], []) == set()
    assert _diff(spark, [(1, "a", "b", None)], []) == {(1, "", "missing_right")}


def test_digits(spark):
    rows = spark.createDataFrame([("h063",), ("#34",), (" 7",), ("x",), (None,), ("99999999999",)], "v string").select(diff.digits("v").alias("n")).collect()
    assert [r.n for r in rows] == [63, 34, 7, None, None, None]
