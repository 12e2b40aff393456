"""Readers and writers on files of each kind."""

import json
import zipfile

import pytest
from pyspark.sql import types as T

from sixline.sources import readers, writers


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_keyed_json(spark, tmp_path):
    value = T.StructType.fromDDL("name string, n int")
    p = _write(tmp_path / "a.json", json.dumps({"1": {"name": "x", "n": 1}, "2": {"name": "y"}}, indent=1))
    assert {(r.id, r.name, r.n) for r in readers.keyed_json(spark, p, value).collect()} == {("1", "x", 1), ("2", "y", None)}
    assert readers.keyed_json(spark, str(tmp_path / "none.json"), value).count() == 0


@pytest.mark.parametrize("text,n", [('[{"a": 1}, {"a": 2}]', 2), ('{"items": [{"a": 1}]}', 1), ('{"rows": [1, 2, 3]}', 3), ('{"a": 1}', 1), ('{"a": 1}\n\n{"a": 2}\n{"a"', 2), ("", 0)])
def test_records(spark, tmp_path, text, n):
    assert readers.records(spark, _write(tmp_path / "r.json", text)).count() == n


def test_items_and_csv_keep_zeros(spark, tmp_path):
    item = T.StructType.fromDDL("x int, y int")
    p = _write(tmp_path / "c.json", json.dumps({"coordinates": [{"x": 1, "y": 2}]}))
    assert [tuple(r) for r in readers.json_items(spark, p, "coordinates", item).collect()] == [(1, 2)]
    p = _write(tmp_path / "c.csv", "id,bits\n1,000010\n")
    assert readers.csv_table(spark, p, T.StructType.fromDDL("id int, bits string")).collect()[0].bits == "000010"


def test_text_kinds(spark, tmp_path):
    p = _write(tmp_path / "m.txt", "one\n§\n\n§\ntwo ")
    assert [r.entry for r in readers.delimited(spark, p).orderBy("place").collect()] == ["one", "two"]
    _write(tmp_path / "s" / "a" / "SKILL.md", "---\nname: x\nrelated_skills: [a, 'b c', ]\n---\nbody\n")
    r = readers.skills(spark, str(tmp_path / "s")).collect()[0]
    assert list(r.related) == ["a", "b c"] and r.body == "body\n"
    p = _write(tmp_path / "w.wikitext.txt", "== Head ==\n<math>x = 1</math>\n")
    r = readers.wikitext(spark, p).collect()[0]
    assert list(r.headings) == ["Head"] and list(r.formulas) == ["x = 1"]
    p = _write(tmp_path / "f.lua", 'local m = require("mod")\nfunction go()\nend\n')
    r = readers.lua(spark, p).collect()[0]
    assert list(r.functions) == ["go"] and list(r.requires) == ["mod"]
    assert readers.file_metadata(spark, str(tmp_path), "*.lua").collect()[0].length > 0
    with pytest.raises(ValueError):
        readers.source("nothing")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a" * 300), (2, None)], "id int, t string")
    writers.json_lines(df, str(tmp_path / "j"))
    writers.json_lines(df, str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    writers.csv(df, str(tmp_path / "c"), 200)
    assert max(len(r.t or "") for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()) == 200
    writers.once(df.limit(1), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    writers.document(df, str(tmp_path / "d.json"))
    assert len(json.loads((tmp_path / "d.json").read_text())) == 2
    writers.bundle(df, df, str(tmp_path / "b.zip"))
    assert len(zipfile.ZipFile(tmp_path / "b.zip").namelist()) == 3
    with pytest.raises(ValueError):
        writers.bounded(df, 1)


def test_records_at_line_starts(spark, tmp_path):
    p = _write(tmp_path / "a.json", '[\n{"a": 1,\n "b": 2},\n{"a": 3}\n]\n')
    assert readers.records(spark, p).selectExpr("variant_get(record, '$.a', 'int') AS a").collect() == [(1,), (3,)]
    p = _write(tmp_path / "l.jsonl", '{"a": 1}\n\n{"a": 2} x\n{"a": 3}\n')
    assert sorted(r.a for r in readers.records(spark, p).selectExpr("variant_get(record, '$.a', 'int') AS a").collect()) == [1, 3]


def test_broken_files_are_named(spark, tmp_path):
    _write(tmp_path / "d" / "bad.json", '[{"a": 1}')
    _write(tmp_path / "d" / "good.json", "[]")
    got = readers.broken(spark, str(tmp_path / "d")).collect()
    assert [(r.path.rsplit("/", 1)[1], r.reason) for r in got] == [("bad.json", "broken")]


def test_audit_and_code(spark, tmp_path):
    _write(tmp_path / "x" / "a.py", "one\ntwo\n")
    _write(tmp_path / "x" / "b.py", "")
    expected = spark.createDataFrame([("a.py",), ("b.py",), ("c.py",)], "path string")
    assert {(r.path, r.status) for r in readers.audit(spark, str(tmp_path / "x"), expected).collect()} == {("a.py", "ok"), ("b.py", "empty"), ("c.py", "missing")}
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.chars, r.line_breaks) for r in readers.code_metadata(spark, str(tmp_path / "x")).collect()}
    assert got["a.py"] == (8, 8, 2)


def test_runs_and_rewrites(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    for run, rows in (("one", 2), ("two", 1), ("two", 1)):
        writers.append_run(df.limit(rows), str(tmp_path / "runs"), run)
    assert {(r.run, r["count"]) for r in spark.read.parquet(str(tmp_path / "runs")).groupBy("run").count().collect()} == {("one", 2), ("two", 1)}
    new = writers.rewritten(df, spark.createDataFrame([(2, "c"), (3, "d")], "id int, t string"), ["id"])
    assert sorted(map(tuple, new.collect())) == [(1, "a"), (2, "c"), (3, "d")]
