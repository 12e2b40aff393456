"""Whole results where a query once did less than the whole job, against plain Python by the reference's formulas."""

import re
import shutil

import __spark_entry__ as entry
from sixline.tables import INTENTS, state_rows

CATEGORY = {"sovereign": ("create", "speak", "protect", "focus"), "transformer": ("transform", "heal", "grow", "release"), "dissipator": ("destroy", "conflict", "release", "explore"), "boundary": ("understand", "focus", "protect", "connect")}
ACTION = {"ASSERT": ("create", "speak", "protect", "focus"), "YIELD": ("release", "heal", "connect", "listen"), "ADAPT": ("transform", "explore", "grow", "understand"), "WAIT": ("understand", "focus", "listen", "release")}
WEIGHTS = "/root/testdata/sf0.001/emotional_weights.parquet"


def _match(text, category, action):
    words = set(re.findall(r"[a-z0-9]+", (text or "").lower()))
    matched = {k: sum(1.0 / r for r, w in enumerate(v.split(), 1) if w in words) for k, v in INTENTS.items()}
    if not any(matched.values()):
        return 0.5
    total = sum(matched[k] for k in CATEGORY[category]) + sum(matched[k] for k in ACTION[action])
    return min(1.0, total / 2) if total > 0 else 0.3


def _documents(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copy(WEIGHTS, tmp_path / "emotional_weights.parquet")
    return str(tmp_path)


TEXTS = ["table chair lamp rug", "create build speak guard", "destroy fight end kill", "Listen, hear: silence", "heal heal repair grow", "emotion love fear joy", None, ""]


def test_intent_match_of_each_kind_of_state(spark):
    from sixline.plans import scoring
    from sixline.plans.dialect import SPARK

    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").createOrReplaceTempView("documents")
    rows = spark.sql(f"SELECT * FROM {scoring.asked(SPARK)} AS a").collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        for i, (category, action) in enumerate(scoring._KINDS):
            assert abs(r[f"m_{i}"] - _match(TEXTS[r.doc_id], category, action)) < 1e-12
    assert {(c, a) for _, _, c, a, _ in state_rows()} == set(scoring._KINDS)


def test_consensus_depends_on_intents(spark, tmp_path):
    rows = {r.doc_id: r for r in entry.queries()["doc_consensus"](spark, _documents(spark, tmp_path, TEXTS)).collect()}
    assert len(rows) == len(TEXTS)
    answer = lambda i: tuple(rows[i])[1:]
    # Four words each: only their intents part them.
    assert len({answer(i) for i in (0, 1, 2, 4)}) == 4
    assert answer(6) == answer(7)


def test_missing_ids_of_every_edition_and_category(spark, tmp_path):
    rows = [(1, i, "herald") for i in range(1, 64)] + [(2, i, "other") for i in range(1, 65)] + [(4, i, "herald") for i in range(2, 65)] + [(4, 2, "herald"), (6, None, "other")]
    spark.createDataFrame(rows, "edition_id long, hexagram_id int, category string").write.parquet(str(tmp_path / "hexagram_registry.parquet"))
    got = sorted((r.edition_id, r.id) for r in entry.queries()["missing_ids"](spark, str(tmp_path)).collect())
    assert got == [(1, 64), (4, 1)] + [(6, i) for i in range(1, 65)]


def test_records_in_json_white_space_parse(spark):
    from sixline.operators import drift

    df = spark.createDataFrame([("f", 1, '{"a": 1}\r'), ("f", 2, '\n\t{"a": 2} \n'), ("f", 3, "x")], "file_id string, row_no long, record string")
    assert drift.paths(df).select('row_no').distinct().count() == 2
    assert [r._ok for r in drift._raw(df).orderBy("row_no").collect()] == [True, True, False]
