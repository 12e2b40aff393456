"""Registered queries against their SQL on the smallest tables, invariants of the state space, streaming against batch."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sixline.plans import catalogue
from sixline.plans.dialect import even

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, bool) or v.__class__.__name__ == "Decimal":
        return float(v)
    return float(v) if isinstance(v, int) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    cursor = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(str([_plain(r[columns.index(c)]) for c in order]) for r in cursor.fetchall())
    got = sorted(str([_plain(r[c]) for c in order]) for r in df.collect())
    assert got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_state_space_invariants(spark):
    q = catalogue.queries()
    rows = q["decode_encode_roundtrip"](spark, DATA).collect()
    assert sorted(r.code for r in rows) == list(range(512)) and all(r.ok for r in rows)
    assert q["reachable_lines"](spark, DATA).count() == 125
    graph = q["transition_graph"](spark, DATA).collect()
    assert len(graph) == 384 and {(r.to_id, r.from_id) for r in graph} == {(r.from_id, r.to_id) for r in graph}
    pairs = q["inversion_pairs"](spark, DATA).collect()
    assert sum(r.a_id != r.b_id for r in pairs) == 28 and {r.a_id for r in pairs if r.a_id == r.b_id} == {1, 2, 27, 28, 29, 30, 61, 62}
    assert sum(r.adjacent for r in q["complement_pairs"](spark, DATA).collect()) == 8
    assert sum(r.canonical_id is not None for r in q["ternary_729"](spark, DATA).collect()) == 64
    porosity = {}
    for r in q["resolve_512"](spark, DATA).collect():
        porosity.setdefault(r.phase, set()).add(r.porosity)
    assert [porosity[p] for p in range(8)] == [{0}, {1}, {1}, {2}, {1}, {2}, {2}, {3}]


def test_even_rounding():
    assert even("round(a + f(b, c), 6)") == "(floor((a + f(b, c)) * 1e6 + 0.5001) / 1e6)"
    assert even("my_round(a, 2)") == "my_round(a, 2)"


def test_components(spark):
    from sixline.operators import mesh

    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51), (7, None), (60, 60)], "source long, found long")
    got = {r.id: r.component for r in mesh.components(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[50] == got[51] == 50 and got[60] == 60


def test_asof_over_buckets(spark):
    from datetime import datetime

    from sixline.operators.nearest import asof

    t = lambda d: datetime(2025, 1, d)
    left = spark.createDataFrame([(1, "a", t(5)), (2, "a", t(1)), (3, "b", t(9)), (4, None, t(3)), (5, "a", None), (6, "a", t(20))], "id int, key string, at timestamp")
    right = spark.createDataFrame([("a", t(3), 1), ("a", t(5), 2), ("a", t(7), 3), ("c", t(1), 4)], "key string, at timestamp, v int")
    assert {r.id: r.matched_v for r in asof(left, right, "key", "at", "at", ["v"]).collect()} == {1: 2, 2: None, 3: None, 4: None, 5: None, 6: 3}
    assert {r.id: r.matched_v for r in asof(left, right, "key", "at", "at", ["v"], forward=True).collect()} == {1: 2, 2: 1, 3: None, 4: None, 5: None, 6: None}


def test_stream_gives_batch_result(spark, tmp_path):
    from sixline.operators import sessions
    from sixline.session import table
    from sixline.streaming import sessions as streaming

    events = table(spark, DATA, "events").repartition(1).sortWithinPartitions("ts", "event_id")
    events.write.parquet(str(tmp_path / "in"))
    stream = streaming.states(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    want = {(r.event_id, r.tick, r.bits) for r in sessions.packed(sessions.with_momentum(sessions.with_axes(events))).collect()}
    assert {(r.event_id, r.tick, r.bits) for r in spark.table("out").collect()} == want
