"""Queries p1, p2 and p5: schema drift, nested documents, differences of copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sixline.operators import dewey, diff, drift
from sixline.session import table

REGISTRY = ["name", "chinese", "pinyin", "binary", "unicode", "upper_trigram", "lower_trigram", "category", "action"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "yao_line_files"), table(spark, d, "yao_line_records")).select("file_id", "field", "change")


def p1_changes(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "yao_line_files"), table(spark, d, "yao_line_records"), every=True)


def p1_lines(spark: SparkSession, d: str) -> DataFrame:
    return drift.lines(table(spark, d, "yao_line_records")).withColumn("others", F.to_json("others"))


def p1_cast_failures(spark: SparkSession, d: str) -> DataFrame:
    return drift.cast_failures(table(spark, d, "yao_line_records"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return dewey.elements(table(spark, d, "capture_detailed"), table(spark, d, "domain_registry"))


def _text(label: str):
    return F.concat_ws(".", F.col(label).cast("array<string>")).alias(label)


def p2_levels(spark: SparkSession, d: str) -> DataFrame:
    return dewey.levels(table(spark, d, "capture_detailed")).withColumns({c: _text(c) for c in ("label", "parent_label")})


def p2_ranked(spark: SparkSession, d: str) -> DataFrame:
    return dewey.ranked(table(spark, d, "capture_detailed")).withColumns({c: _text(c) for c in ("label", "parent_label")}).distinct()


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    return dewey.scores(table(spark, d, "capture_detailed")).withColumns({c: _text(c) for c in ("label", "parent_label")}).distinct()


def p2_domains(spark: SparkSession, d: str) -> DataFrame:
    return dewey.domains(table(spark, d, "domain_registry")).withColumns({c: _text(c) for c in ("label", "parent_label")})


def p2_patterns(spark: SparkSession, d: str) -> DataFrame:
    return dewey.patterns(table(spark, d, "domain_registry")).withColumns({c: _text(c) for c in ("label", "parent_label")}).distinct()


def _documents(spark: SparkSession, d: str, of) -> DataFrame:
    """A result of both document kinds, with the table's name and the document's id before it."""
    kinds = [("capture_detailed", "capture_id"), ("domain_registry", "snapshot_id")]
    made = [of(table(spark, d, t), [k], "payload").select(F.lit(t).alias("tbl"), F.col(k).alias("doc_id"), "*").drop(k) for t, k in kinds]
    return made[0].unionAll(made[1])


def p2_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d, dewey.tables).withColumns({c: _text(c) for c in ("label", "parent_label")})
    return rows.withColumn("fields", F.to_json("fields"))


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """The tables that the documents hold: how many rows and documents each schema path has, and under which parent."""
    return _documents(spark, d, dewey.tables).groupBy("tbl", "path", "parent_path").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("documents"))


def p2_rejects(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, dewey.rejects)


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    keep = ["edition_id", "hexagram_id", *REGISTRY, "updated_at"]
    a, b = table(spark, d, "hexagram_registry").select(keep), table(spark, d, "hexagram_registry_copy").select(keep)
    # An id that is no number keeps its text as a key of its own: such rows stay apart.
    number = diff.digits("hexagram_id")
    return a.select(F.lit(None).cast("string").alias("_text"), "*").withColumn("hexagram_id", F.col("hexagram_id").cast("int")), b.select(F.when(number.isNull(), F.col("hexagram_id")).alias("_text"), "*").withColumn("hexagram_id", number)


def p5_differences(spark: SparkSession, d: str) -> DataFrame:
    return diff.differences(*_both(spark, d), ["edition_id", "hexagram_id", "_text"], REGISTRY, "updated_at").drop("_text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_differences(spark, d).select("edition_id", "hexagram_id", "field", "kind")


QUERIES = {f.__name__: f for f in (p1_found, p1_changes, p1_lines, p1_cast_failures, p2_found, p2_levels, p2_ranked, p2_scores, p2_domains, p2_patterns, p2_tables, p2_paths, p2_rejects, p5_found, p5_differences)}


def _p5_sql(values: bool) -> str:
    """The comparison as plain SQL: newest rows by window, full join, one branch per field."""
    fields = ", ".join(f'"{c}"' for c in REGISTRY)
    side = """SELECT * FROM (SELECT edition_id, {key} AS hexagram_id, {fields}, row_number() OVER (PARTITION BY edition_id, {key} ORDER BY updated_at DESC) AS rn FROM {t}) WHERE rn = 1"""
    a = side.format(key="hexagram_id", fields=fields, t="hexagram_registry")
    b = side.format(key="CAST(regexp_replace(hexagram_id, '[^0-9]', '', 'g') AS INTEGER)", fields=fields, t="hexagram_registry_copy")
    more = lambda l, r: f", {l} AS left_value, {r} AS right_value" if values else ""  # noqa: E731, E741
    none = more("CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)")
    parts = [
        f"SELECT b.edition_id, b.hexagram_id, '' AS field, 'missing_left' AS kind{none} FROM b ANTI JOIN a USING (edition_id, hexagram_id)",
        f"SELECT a.edition_id, a.hexagram_id, '' AS field, 'missing_right' AS kind{none} FROM a ANTI JOIN b USING (edition_id, hexagram_id)",
    ]
    for c in REGISTRY:
        parts.append(f"""SELECT a.edition_id, a.hexagram_id, '{c}' AS field, 'differs' AS kind{more(f'a."{c}"', f'b."{c}"')} FROM a JOIN b USING (edition_id, hexagram_id) WHERE a."{c}" IS DISTINCT FROM b."{c}" """)
    return f"WITH a AS ({a}), b AS ({b}) " + " UNION ALL ".join(parts)


def _p1_sql() -> str:
    """Keys of parsing records by DuckDB's own JSON functions; what the keys mean by patterns over the names that the data use."""
    name = "regexp_replace(lower(k), '[^a-z]', '', 'g')"
    field = f"""CASE WHEN {name} IN ('direction', 'linedirection', 'dir', 'heading', 'movement', 'trend', 'tendency') THEN 'direction'
      WHEN {name} LIKE '%stress%' AND {name} NOT LIKE '%note' THEN 'is_stressed' WHEN {name} LIKE '%activ%' AND {name} NOT LIKE '%count' AND {name} NOT LIKE '%note' THEN 'is_activated' END"""
    kind = "CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'decimal' WHEN 'NULL' THEN NULL ELSE 'integer' END"
    return f"""WITH r AS (SELECT file_id, record, unnest(json_keys(record)) AS k FROM yao_line_records WHERE json_valid(record) AND json_type(record) = 'OBJECT'),
      v AS (SELECT file_id, k, {field} AS field, json_extract(record, '$."' || k || '"') AS v FROM r),
      has AS (SELECT file_id, field, k AS name, max({kind}) AS type FROM v WHERE field IS NOT NULL GROUP BY file_id, field, k),
      every AS (SELECT f.file_id, f.feed, f.released_at, x.field FROM yao_line_files AS f CROSS JOIN (VALUES ('direction'), ('is_stressed'), ('is_activated')) AS x(field)),
      pair AS (SELECT e.file_id, e.field, h.name, h.type, lag(h.name) OVER w AS was, lag(h.type) OVER w AS was_type, row_number() OVER w AS n
        FROM every AS e LEFT JOIN has AS h ON h.file_id = e.file_id AND h.field = e.field WINDOW w AS (PARTITION BY e.feed, e.field ORDER BY e.released_at))
      SELECT file_id, field, 'added' AS change FROM pair WHERE n > 1 AND was IS NULL AND name IS NOT NULL
      UNION ALL SELECT file_id, field, 'removed' FROM pair WHERE n > 1 AND was IS NOT NULL AND name IS NULL
      UNION ALL SELECT file_id, field, 'renamed' FROM pair WHERE n > 1 AND was <> name
      UNION ALL SELECT file_id, field, 'retyped' FROM pair WHERE n > 1 AND was_type <> type"""


def _p2_sql() -> str:
    """The elements by DuckDB's own JSON functions: each layout of the documents by its place, without labels."""
    opened = lambda t, key, wrap: f"""(SELECT id, CASE json_type(j, '$.{wrap}') WHEN 'OBJECT' THEN j->'$.{wrap}' WHEN 'VARCHAR' THEN CASE WHEN json_valid(j->>'$.{wrap}') THEN CAST(j->>'$.{wrap}' AS JSON) ELSE j END ELSE j END AS j
      FROM (SELECT id, CAST(p AS JSON) AS j FROM (SELECT {key} AS id, CASE WHEN json_type(payload) = 'VARCHAR' THEN CAST(payload AS JSON)->>'$' ELSE payload END AS p FROM {t} WHERE json_valid(payload)) AS a WHERE json_valid(p)) AS b WHERE json_type(j) = 'OBJECT')"""  # noqa: E731
    each = lambda of: f"unnest(range(len(json_extract({of}, '$[*]'))))"
    at = lambda of, i: f"json_extract({of}, '$[*]')[{i} + 1]"
    score = "coalesce(d->>'$.hex_score', d->>'$.scores.hex_score')"
    return f"""WITH c AS {opened('capture_detailed', 'capture_id', 'capture_detailed')}, r AS {opened('domain_registry', 'snapshot_id', 'domain_registry')},
      level AS (SELECT id, k AS parent, json_extract(j, '$."' || k || '"') AS o FROM (SELECT id, j, unnest(json_keys(j)) AS k FROM c) AS x WHERE regexp_matches(k, '^-?[0-9]+$')
        UNION ALL SELECT id, regexp_replace(coalesce(o->>'$.name', o->>'$.label'), '^input\\s*=\\s*', '') AS parent, o FROM (SELECT id, unnest(json_extract(j, '$.captures[*]')) AS o FROM c) AS y),
      top AS (SELECT id, parent, i, {at('t', 'i')} AS v FROM (SELECT id, parent, o->'$.top12' AS t, {each("o->'$.top12'")} AS i FROM level) AS z),
      grp AS (SELECT id, parent, g, {at('s', 'g')} AS v FROM (SELECT id, parent, o->'$.score_details_first3' AS s, {each("o->'$.score_details_first3'")} AS g FROM level) AS z),
      detail AS (SELECT id, parent, g, p, {at('v', 'p')} AS d FROM (SELECT id, parent, g, v, {each('v')} AS p FROM grp WHERE json_type(v) = 'ARRAY') AS z UNION ALL SELECT id, parent, g, 0, v FROM grp WHERE json_type(v) = 'OBJECT'),
      domain AS (SELECT id, k AS parent, json_extract(j, '$.domains."' || k || '"') AS o FROM (SELECT id, j, unnest(json_keys(j, '$.domains')) AS k FROM r WHERE json_type(j, '$.domains') = 'OBJECT') AS x
        UNION ALL SELECT id, o->>'$.name', o FROM (SELECT id, unnest(json_extract(j, '$.domains[*]')) AS o FROM r WHERE json_type(j, '$.domains') = 'ARRAY') AS y),
      pat AS (SELECT id, parent, i, {at('t', 'i')} AS v FROM (SELECT id, parent, o->'$.input_patterns' AS t, {each("o->'$.input_patterns'")} AS i FROM domain WHERE json_type(o, '$.input_patterns') = 'ARRAY') AS z
        UNION ALL SELECT id, parent, 0, o->'$.input_patterns' FROM domain WHERE json_type(o, '$.input_patterns') = 'VARCHAR')
      SELECT DISTINCT tbl, doc_id, parent, field, CAST(grp AS INTEGER) AS grp, CAST(pos AS INTEGER) AS pos, item FROM (
        SELECT 'capture_detailed' AS tbl, id AS doc_id, parent, 'top12' AS field, -1 AS grp, i AS pos, CAST(try_cast(regexp_extract(CASE json_type(v) WHEN 'ARRAY' THEN v->>'$[0]' WHEN 'OBJECT' THEN coalesce(v->>'$.hexagram', v->>'$.hexagram_id', v->>'$.id') ELSE v->>'$' END, '^\\s*(\\d+)', 1) AS INTEGER) AS VARCHAR) AS item FROM top
        UNION ALL SELECT 'capture_detailed', id, parent, 'hex_score', g, p, CAST(CAST(round(try_cast({score} AS DOUBLE) * 1e9) AS BIGINT) AS VARCHAR) FROM detail
        UNION ALL SELECT 'domain_registry', id, parent, 'input_patterns', -1, i, CASE json_type(v) WHEN 'OBJECT' THEN v->>'$.pattern' WHEN 'NULL' THEN NULL ELSE v->>'$' END FROM pat) AS e WHERE item IS NOT NULL"""


ORACLE = {"p1_found": _p1_sql(), "p2_found": _p2_sql(), "p5_found": _p5_sql(False), "p5_differences": _p5_sql(True)}
