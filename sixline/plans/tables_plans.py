"""Queries over events, texts, meshes and quality rules (inventory SS-*, WN-*, TX-*, JN-15..20, AG-24..28, PF-*, SK-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sixline.operators import mesh, nearest, sessions, text
from sixline.plans.dialect import DUCK, Dialect, even, shared
from sixline.session import table
from sixline.tables import state_rows, states_sql


def event_intent_states(spark: SparkSession, d: str) -> DataFrame:
    return sessions.outcomes(table(spark, d, "events"))


def event_model_bias(spark: SparkSession, d: str) -> DataFrame:
    return sessions.bias(table(spark, d, "events"))


def event_save_strings(spark: SparkSession, d: str) -> DataFrame:
    return sessions.save_strings(table(spark, d, "events"))


def event_running_bias(spark: SparkSession, d: str) -> DataFrame:
    """WN-06: the bias of both models after every event."""
    return sessions.running_bias(table(spark, d, "events"))


def event_plain_states(spark: SparkSession, d: str) -> DataFrame:
    """SS-02: every event's state without momentum."""
    return sessions.plain_states(table(spark, d, "events"))


def event_full_strings(spark: SparkSession, d: str) -> DataFrame:
    """SK-11: every event as a whole save string."""
    return sessions.full_save_strings(table(spark, d, "events"))


def event_history_50(spark: SparkSession, d: str) -> DataFrame:
    """SK-09: the last fifty events of each user."""
    return sessions.last_events(table(spark, d, "events"), 50).select("event_id", "user_id", "tick")


def event_timeseries(spark: SparkSession, d: str) -> DataFrame:
    return sessions.timeseries(table(spark, d, "events"))


def profile_registry_asof(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "emotional_weights").select("profile_id", "hexagram_id", "observed_at", "ingested_at")
    right = table(spark, d, "hexagram_registry").filter("updated_at IS NOT NULL").select("hexagram_id", "updated_at")
    return nearest.asof(left, right, "hexagram_id", "observed_at", "updated_at", ["updated_at"]).select("profile_id", "hexagram_id", "ingested_at", "matched_time")


def doc_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", text.cleaned(F.col("text")).alias("cleaned"))


def page_features(spark: SparkSession, d: str) -> DataFrame:
    return text.markup(table(spark, d, "documents"))


def formula_classify(spark: SparkSession, d: str) -> DataFrame:
    return text.formulas(table(spark, d, "documents"))


def domain_keywords(spark: SparkSession, d: str) -> DataFrame:
    return text.domains(table(spark, d, "documents"))


def _mesh(spark: SparkSession, d: str, kind: str = "true") -> tuple[DataFrame, DataFrame]:
    """Customers as nodes; an edge from every order's customer to the one that its clerk's number names, in four ways of writing."""
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    number = F.regexp_extract("o_orderkey", "([0-9]+)$", 1).cast("long") % 1999
    way = F.col("o_orderkey") % 4
    padded = F.lpad(number.cast("string"), 9, "0")
    target = F.when(way == 0, F.concat(F.lit("Customer#"), padded)).when(way == 1, F.concat(F.lit(" customer "), padded)).when(way == 2, F.concat(F.lit("notes/customers/Customer#"), padded, F.lit(".md"))).otherwise(F.concat(F.lit("client "), padded))
    edges = table(spark, d, "orders").filter(kind).select(F.col("o_custkey").alias("source"), target.alias("target")).distinct()
    return nodes, edges


def edge_resolution(spark: SparkSession, d: str) -> DataFrame:
    return mesh.resolved(*_mesh(spark, d))


def mesh_orphans(spark: SparkSession, d: str) -> DataFrame:
    """JN-17: customers that no urgent order leads from or to."""
    nodes, edges = _mesh(spark, d, "o_orderpriority = '1-URGENT'")
    return mesh.orphans(nodes, mesh.resolved(nodes, edges)).select("id", "name")


def edge_missing(spark: SparkSession, d: str) -> DataFrame:
    """JN-16: targets that no node has, with the number of edges to them."""
    nodes, edges = _mesh(spark, d)
    return mesh.resolved(nodes, edges).filter("found IS NULL").groupBy("target").agg(F.count(F.lit(1)).alias("edges"))


def mesh_degrees(spark: SparkSession, d: str) -> DataFrame:
    """AG-28: number of different neighbours of each node, in either direction."""
    nodes, edges = _mesh(spark, d)
    return mesh.degrees(mesh.resolved(nodes, edges))


def doc_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return text.paragraphs(table(spark, d, "documents"))


def scene_sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    """TX-03: scenes as chunks of whole sentences."""
    scenes = table(spark, d, "jkd_ingestion_ternary").filter("scene_text IS NOT NULL")
    return scenes.select("scene_id", F.posexplode(text.sentence_chunks(F.col("scene_text"))).alias("place", "chunk"))


def mesh_clusters(spark: SparkSession, d: str) -> DataFrame:
    """SO-08: groups of linked customers and orders, the ten largest, of equal ones the first."""
    links = table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("source"), (F.col("o_orderkey") * 2 + 1).alias("found")).distinct()
    sizes = mesh.components(links).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.orderBy(F.desc("size"), "component").limit(10)


# --- SQL of both engines -----------------------------------------------------------------------


def _save_text(x: Dialect) -> str:
    """TX-17, TX-18: a profile as token text and as a save string."""
    string = "STRING" if x.spark else "VARCHAR"
    t = lambda v: f"CAST(CAST(floor({v} * 10000 + 0.5001) AS BIGINT) AS {string})"
    cols = ("chaos", "whimsy", "darktone", "coherence", "voiceweight")
    return f"""SELECT e.profile_id, e.ingested_at, '<|hexagram|>' || lpad(CAST(e.hexagram_id AS {string}), 2, '0') || ' <|phase|>' || e.phase_temporal || ' <|action|>' || h.action AS tokens,
      CAST(h.id AS {string}) || '|' || CASE h.category WHEN 'sovereign' THEN '1' WHEN 'transformer' THEN '2' WHEN 'boundary' THEN '3' ELSE '4' END || '|' || {" || '|' || ".join(t(v) for v in cols)} AS save_string
      FROM emotional_weights AS e JOIN {states_sql()} AS h ON h.id = e.hexagram_id"""


def _notes_parse(x: Dialect) -> str:
    """TX-13, TX-14, TX-19, TX-23: normalised, titled, shortened and escaped notes."""
    return f"""SELECT profile_id, ingested_at, {x.replace("lower(trim(trainingnotes))", "[^a-z0-9]+", "_")} AS plain, substr(trainingnotes, 1, 120) AS echo,
      replace(replace(replace(trainingnotes, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM emotional_weights WHERE trainingnotes IS NOT NULL"""


def _history(x: Dialect) -> str:
    return "SELECT event_id, user_id, place FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) AS e WHERE place <= 64"


def _every_nth(x: Dialect) -> str:
    return "SELECT scene_id, run_id, place FROM (SELECT scene_id, run_id, row_number() OVER (PARTITION BY run_id ORDER BY scene_index, scene_id) - 1 AS place FROM jkd_ingestion_ternary) AS s WHERE place % 25 = 0"


def _long_lines(x: Dialect) -> str:
    return "SELECT doc_id, length(text) AS chars, CASE WHEN length(text) > 800 THEN 'long' WHEN length(text) > 40 THEN 'kept' ELSE 'short' END AS band FROM documents WHERE length(text) > 0"


def _derive(x: Dialect) -> str:
    """MX-30, F-13: the emotional input that a record's price and coordinates raise."""
    return "SELECT l_orderkey, l_linenumber, round(greatest(0.5, CASE WHEN l_extendedprice > 1000000 THEN 0.8 ELSE 0.0 END, least(1.0, sqrt(power(l_partkey, 2) + power(l_suppkey, 2)) / CAST(10000 AS DOUBLE))), 4) AS emotional_input FROM lineitem"


def _temporal_phase(x: Dialect) -> str:
    """PF-18, MX-36: old, young or between, by a bounded reading, with the weights of the three."""
    v = "greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), coalesce(value, 50)))"
    return f"SELECT event_id, CASE WHEN {v} < 33 THEN 'old' WHEN {v} > 66 THEN 'young' ELSE 'transition' END AS substate, event_id % 3 AS tick3, CASE WHEN event_id % 3 = 0 THEN 0.6 ELSE 0.2 END AS w_past FROM events"


def _slider(x: Dialect) -> str:
    """PF-25: a reading clamped to 0..100, a bad one 50."""
    return "SELECT event_id, CASE WHEN value IS NULL THEN 50.0 ELSE greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), value)) END AS slider FROM events"


def _narrative(x: Dialect) -> str:
    """PF-24, PF-13: mode of a profile by its axes."""
    return "SELECT profile_id, ingested_at, CASE WHEN coherence > 0.6 AND chaos < 0.4 THEN 'code' WHEN chaos > 0.5 AND whimsy > 0.5 THEN 'blueprint' WHEN voiceweight > 0.6 AND darktone > 0.6 THEN 'agent' ELSE 'literary' END AS mode, CASE WHEN chaos > 0.7 THEN 1 ELSE 0 END + CASE WHEN whimsy > 0.7 THEN 1 ELSE 0 END + CASE WHEN darktone > 0.7 THEN 1 ELSE 0 END AS decorations FROM emotional_weights WHERE chaos IS NOT NULL AND whimsy IS NOT NULL AND darktone IS NOT NULL AND coherence IS NOT NULL AND voiceweight IS NOT NULL"


def _quality(x: Dialect) -> str:
    """PF-33, AG-31: required fields, uniqueness and least numbers of records by source."""
    return "SELECT source, count(*) AS records, count(text) AS with_text, count(DISTINCT doc_id) AS ids, CASE WHEN count(*) >= 5 THEN 1 ELSE 0 END AS enough, CASE WHEN count(text) = count(*) THEN 1 ELSE 0 END AS complete FROM documents GROUP BY source"


def _probe(x: Dialect) -> str:
    """AG-24, PF-16: pattern of each state in each session by spread, counted."""
    p = "CASE WHEN spread_c < 0.2 AND n < 3 THEN 'minimal' WHEN spread_c < 0.4 THEN 'passive' ELSE 'expansive' END"
    return f"SELECT pattern, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS profiles, min(session_id) AS first_session FROM (SELECT session_id, n, {p} AS pattern FROM (SELECT session_id, count(*) AS n, max(chaos) - min(chaos) AS spread_c FROM emotional_weights WHERE chaos BETWEEN 0 AND 1 GROUP BY session_id, hexagram_id) AS s) AS q GROUP BY pattern"


def _consistent(x: Dialect) -> str:
    """ST-04..06: states that every phase of the profiles knows, and documents too."""
    if x.spark:
        return "SELECT hexagram_id FROM emotional_weights GROUP BY hexagram_id HAVING count(DISTINCT phase_temporal) = (SELECT count(DISTINCT phase_temporal) FROM emotional_weights) INTERSECT SELECT hexagram_id FROM documents"
    return "SELECT DISTINCT d.hexagram_id FROM documents AS d WHERE d.hexagram_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT phase_temporal AS p FROM emotional_weights WHERE phase_temporal IS NOT NULL) AS a WHERE NOT EXISTS (SELECT 1 FROM emotional_weights AS e WHERE e.hexagram_id = d.hexagram_id AND e.phase_temporal = a.p))"


def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    """ST-05: of all states, those that an edition of the registry lacks."""
    has = table(spark, d, "hexagram_registry").select("edition_id", F.col("hexagram_id").alias("id")).distinct()
    every = has.select("edition_id").distinct().select("edition_id", F.explode(F.array(*[F.lit(i) for i, *_ in state_rows()])).alias("id"))
    return every.join(has, (every["edition_id"].eqNullSafe(has["edition_id"])) & (every["id"] == has["id"]), "left_anti")


def _missing(x: Dialect) -> str:
    return f"SELECT e.edition_id, h.id FROM (SELECT DISTINCT edition_id FROM hexagram_registry) AS e CROSS JOIN {states_sql()} AS h EXCEPT SELECT edition_id, hexagram_id FROM hexagram_registry"


def _score_tables(x: Dialect) -> str:
    """AG-25: how many fields of the registry's newest rows agree with the fixed states, and whole percents."""
    b = "binary" if x.spark else '"binary"'
    return f"""SELECT edition_id, count(*) AS records, CAST(sum(CASE WHEN r.{b} = h.bits THEN 1 ELSE 0 END) AS BIGINT) AS same_bits, CAST(sum(CASE WHEN length(r.{b}) = 6 THEN 1 ELSE 0 END) AS BIGINT) AS six,
      CAST(floor(100 * sum(CASE WHEN r.category IS NOT NULL THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS percent FROM hexagram_registry AS r JOIN {states_sql()} AS h ON h.id = r.hexagram_id GROUP BY edition_id"""


def _type_counts(x: Dialect) -> str:
    return "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 4) AS mean_value FROM events GROUP BY event_type"


def _axes_top2(x: Dialect) -> str:
    """SO-05: the two greatest axes of a profile, first by place."""
    rows = " UNION ALL ".join(f"SELECT profile_id, ingested_at, '{a}' AS axis, {i} AS place, {a} AS v FROM emotional_weights WHERE {a} IS NOT NULL" for i, a in enumerate(("chaos", "whimsy", "darktone", "coherence", "voiceweight")))
    return f"SELECT profile_id, ingested_at, axis, rn FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, ingested_at ORDER BY v DESC, place) AS rn FROM ({rows}) AS r) AS q WHERE rn <= 2"


def _session_windows(x: Dialect) -> str:
    """Beyond the reference: sessions of events by a gap of an hour."""
    gap = "CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL '1' HOUR THEN 1 ELSE 0 END"
    return f"SELECT user_id, session, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT user_id, event_id, ts, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session FROM (SELECT user_id, event_id, ts, {gap} AS new FROM events) AS g) AS s GROUP BY user_id, session"


_SQL = {
    "training_records": (_save_text, ("emotional_weights",)),
    "notes_normalised": (_notes_parse, ("emotional_weights",)),
    "session_history_64": (_history, ("events",)),
    "scene_every_25th": (_every_nth, ("jkd_ingestion_ternary",)),
    "doc_length_bands": (_long_lines, ("documents",)),
    "derive_emotional_input": (_derive, ("lineitem",)),
    "event_temporal_phase": (_temporal_phase, ("events",)),
    "event_slider_clamped": (_slider, ("events",)),
    "narrative_mode": (_narrative, ("emotional_weights",)),
    "quality_smoke": (_quality, ("documents",)),
    "query_probe_patterns": (_probe, ("emotional_weights",)),
    "consistent_ids": (_consistent, ("emotional_weights", "documents")),
    "missing_ids": (_missing, ("hexagram_registry",)),
    "dataset_score": (_score_tables, ("hexagram_registry",)),
    "event_type_counts": (_type_counts, ("events",)),
    "top_two_axes": (_axes_top2, ("emotional_weights",)),
    "session_window_events": (_session_windows, ("events",)),
}
_BUILT = {name: shared(sql, tables) for name, (sql, tables) in _SQL.items()}
QUERIES = {f.__name__: f for f in (
    event_intent_states, event_model_bias, event_running_bias, event_plain_states, event_full_strings, event_history_50, event_save_strings, event_timeseries, profile_registry_asof, doc_clean, page_features, formula_classify, domain_keywords, edge_resolution, edge_missing, mesh_degrees, mesh_orphans, mesh_clusters, doc_paragraphs, scene_sentence_chunks,
)} | {name: run for name, (run, _) in _BUILT.items()} | {"missing_ids": missing_ids}

_AXIS = lambda i: f"(CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), {i}, 2) AS BIGINT) % 100 / CAST(100 AS DOUBLE))"
_AXES_SQL = f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS tick, {_AXIS(1)} AS chaos, {_AXIS(3)} AS whimsy, {_AXIS(5)} AS dark FROM events"
_MOMENTUM = f"SELECT *, CASE WHEN count(*) OVER w = 3 THEN least(1.0, chaos + 0.1 * (avg(chaos) OVER w + avg(whimsy) OVER w) / 2) ELSE chaos END AS chaos_m FROM ({_AXES_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
_PACKED = f"SELECT *, (b & 63) + 1 AS state, (b >> 6) % 3 AS phase FROM (SELECT *, CAST(power(2, tick % 3) AS INTEGER) + CASE WHEN chaos_m > 0.5 THEN 8 ELSE 0 END + CASE WHEN whimsy > 0.5 THEN 16 ELSE 0 END + CASE WHEN dark > 0.5 THEN 32 ELSE 0 END + CASE WHEN event_type IN ('view', 'click') THEN 64 WHEN event_type = 'error' THEN 128 ELSE 256 END AS b FROM ({_MOMENTUM}))"
_PAD = "lpad(CAST(o_orderkey % 1999 AS VARCHAR), 9, '0')"
_EDGES = f"SELECT DISTINCT o_custkey AS source, CASE o_orderkey % 4 WHEN 0 THEN 'Customer#' || {_PAD} WHEN 1 THEN ' customer ' || {_PAD} WHEN 2 THEN 'notes/customers/Customer#' || {_PAD} || '.md' ELSE 'client ' || {_PAD} END AS target FROM orders"
_LOOSE = lambda c: f"regexp_replace(lower(trim({c})), '[^a-z0-9]+', '_', 'g')"
_STEM = lambda c: f"regexp_replace(regexp_replace({c}, '^.*/', ''), '\\.[A-Za-z0-9]+$', '')"
_RESOLVED = f"""SELECT e.source, e.target, coalesce(a.id, b.id, s.id) AS found, CASE WHEN a.id IS NOT NULL THEN 'exact' WHEN b.id IS NOT NULL THEN 'plain' WHEN s.id IS NOT NULL THEN 'stem' END AS rule FROM ({_EDGES}) e
  LEFT JOIN (SELECT c_name, min(c_custkey) AS id FROM customer GROUP BY c_name) a ON a.c_name = e.target LEFT JOIN (SELECT {_LOOSE('c_name')} AS p, min(c_custkey) AS id FROM customer GROUP BY 1) b ON b.p = {_LOOSE('e.target')}
  LEFT JOIN (SELECT {_LOOSE(_STEM('c_name'))} AS p, min(c_custkey) AS id FROM customer GROUP BY 1) s ON s.p = {_LOOSE(_STEM('e.target'))}"""
_URGENT = _RESOLVED.replace("FROM orders", "FROM orders WHERE o_orderpriority = '1-URGENT'")
_WHITE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_N = lambda p: f"CAST(len(regexp_extract_all(text, {DUCK.text(p)})) AS INTEGER)"
_HAS = lambda col, words: "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"

ORACLE = {name: sql for name, (_, sql) in _BUILT.items()} | {
    "event_intent_states": even(f"SELECT h.id, h.name, h.action, s.phase, s.n, round(s.chaos, 6) AS chaos FROM (SELECT state, phase, count(*) AS n, avg(chaos_m) AS chaos FROM ({_PACKED}) GROUP BY state, phase) s JOIN {states_sql()} AS h ON h.id = s.state"),
    "event_model_bias": f"SELECT user_id, 1 + sum(CASE WHEN chaos > 0.7 AND whimsy > 0.7 THEN 1 ELSE 0 END) / CAST(10 AS DOUBLE) AS creative, 1 + sum(CASE WHEN NOT (chaos > 0.7 AND whimsy > 0.7) AND chaos < 0.3 THEN 1 ELSE 0 END) / CAST(10 AS DOUBLE) AS precise, count(*) AS events FROM ({_AXES_SQL}) GROUP BY user_id",
    "event_save_strings": f"SELECT user_id, count(*) AS kept, string_agg('[' || state || '];id:' || event_id || ';tmp:' || phase, ';' ORDER BY tick) AS session FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tick DESC) AS rn FROM ({_PACKED})) WHERE rn <= 64 GROUP BY user_id",
    "event_running_bias": f"SELECT event_id, user_id, 1 + sum(CASE WHEN chaos > 0.7 AND whimsy > 0.7 THEN 1 ELSE 0 END) OVER w / CAST(10 AS DOUBLE) AS creative, 1 + sum(CASE WHEN NOT (chaos > 0.7 AND whimsy > 0.7) AND chaos < 0.3 THEN 1 ELSE 0 END) OVER w / CAST(10 AS DOUBLE) AS precise FROM ({_AXES_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "event_plain_states": f"SELECT event_id, user_id, state, phase FROM ({_PACKED.replace('chaos_m > 0.5', 'chaos > 0.5')})",
    "event_full_strings": f"""SELECT event_id, '[hex];id:' || b || ';yao:' || array_to_string(list_transform(range(6), lambda i: CASE WHEN (b >> CAST(i AS INTEGER)) & 1 = 1 THEN '1' ELSE '-1' END), ',') || ';tmp:' || phase
      || ';em:{{"chaos":' || chaos || ',"whimsy":' || whimsy || ',"dark":' || dark || '}};prv:{{"event_type":"' || event_type || '","tick":' || tick || '}}' AS save_string FROM ({_PACKED})""",
    "event_history_50": f"SELECT event_id, user_id, tick FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM ({_AXES_SQL})) WHERE tick > n - 50",
    "event_timeseries": even(f"SELECT user_id, tick, event_id, {', '.join(f'round({c} - lag({c}) OVER (PARTITION BY user_id ORDER BY tick), 6) AS d_{c}' for c in ('chaos', 'whimsy', 'dark'))} FROM ({_AXES_SQL})"),
    "profile_registry_asof": "SELECT e.profile_id, e.hexagram_id, e.ingested_at, r.updated_at AS matched_time FROM emotional_weights e ASOF LEFT JOIN (SELECT DISTINCT hexagram_id, updated_at FROM hexagram_registry WHERE updated_at IS NOT NULL) r ON r.hexagram_id = e.hexagram_id AND r.updated_at <= e.observed_at",
    "doc_clean": f"""SELECT d.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE l.line <> ''), '') AS cleaned FROM documents AS d LEFT JOIN (
      SELECT doc_id, i, CASE WHEN starts_with(bare, '--- PAGE') OR starts_with(bare, 'OF ') OR regexp_matches(bare, '^PAGE [0-9]+') THEN '' ELSE trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '[A-Z]{{2,}}', '', 'g'), '[0-9]+', '', 'g'), '[^\\p{{L}}\\p{{N}}_{_WHITE}.,;:''"!?\\-—]', ' ', 'g'), '[{_WHITE}]+', ' ', 'g')) END AS line
      FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, regexp_replace(unnest(ls), '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g') AS bare FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|[\\n\\r\\x{{0b}}\\x{{0c}}\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls FROM documents WHERE text IS NOT NULL))) AS l ON l.doc_id = d.doc_id WHERE d.text IS NOT NULL GROUP BY d.doc_id""",
    "doc_paragraphs": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS place, paragraph FROM (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, regexp_replace(unnest(ps), '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g') AS paragraph FROM (SELECT doc_id, string_split_regex(text, '\\n[\\s\\x{{0b}}]*\\n') AS ps FROM documents)) WHERE length(paragraph) > 40",
    "edge_missing": f"SELECT target, count(*) AS edges FROM ({_RESOLVED}) WHERE found IS NULL GROUP BY target",
    "mesh_degrees": f"SELECT id, count(DISTINCT other) AS degree FROM (SELECT source AS id, found AS other FROM ({_RESOLVED}) WHERE found IS NOT NULL UNION ALL SELECT found, source FROM ({_RESOLVED}) WHERE found IS NOT NULL) GROUP BY id",
    "mesh_clusters": "SELECT least(min(o_custkey) * 2, min(o_orderkey) * 2 + 1) AS component, count(*) + 1 AS size FROM orders GROUP BY o_custkey ORDER BY size DESC, component LIMIT 10",
    "page_features": f"SELECT doc_id, {_N(r'(?m)^=+[^=' + chr(92) + 'n]+=+ *' + chr(92) + 'r?$')} AS headings, {_N('<math[^>]*>[^<]*</math>')} AS formulas, {_N(chr(92) + '[' + chr(92) + '[[^' + chr(92) + ']]*' + chr(92) + ']' + chr(92) + ']')} AS links, {_N('<ref[^>]*>[^<]*</ref>')} AS refs, {_N('(?m)^[*•] ')} AS items, {_N('<!--')} AS comments, {_N('https?://[^ ]+')} AS addresses, {_N('<chem[^>]*>[^<]*</chem>')} AS reactions, {_N('<sub>[^<]*</sub>')} AS subs, {_N('<sup>[^<]*</sup>')} AS sups, length(text) AS chars FROM documents WHERE text IS NOT NULL",
    "formula_classify": r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS place, f[i] AS formula, CASE
      WHEN lower(f[i]) LIKE '%\langle%' AND lower(f[i]) LIKE '%\hat{a}%' AND lower(f[i]) LIKE '%\psi%' THEN 'hermitian_operator'
      WHEN contains(lower(f[i]), 'f(x)=') AND contains(lower(f[i]), '\sigma') AND contains(lower(f[i]), '\sqrt{2\pi}') AND contains(lower(f[i]), '\exp') THEN 'gaussian_normal'
      WHEN contains(lower(f[i]), '\frac{-b \pm \sqrt{b^2 - 4ac}}{2a}') THEN 'quadratic_formula'
      WHEN starts_with(lower(f[i]), '<math>') AND contains(lower(f[i]), '\delta =') AND contains(lower(f[i]), 'b^2 - 4ac') THEN 'discriminant'
      WHEN regexp_matches(lower(f[i]), '\\exp|e\^\{|\\sigma|\\sqrt|\\frac') THEN 'algebraic_expression'
      WHEN starts_with(lower(f[i]), '<chem>') OR contains(lower(f[i]), '\ce{') THEN 'reaction_representation'
      WHEN regexp_matches(lower(f[i]), '\\hbar|\\nabla|\\partial') THEN 'hamiltonian' ELSE 'unclassified' END AS class
      FROM (SELECT doc_id, f, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '<(?:math|chem)[^>]*>[^<]*</(?:math|chem)>') AS f FROM documents))""",
    "domain_keywords": "WITH hits AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS domain FROM documents WHERE {_HAS('lower(text)', w)}" for k, w in text.DOMAINS.items()) + ") SELECT * FROM hits UNION ALL SELECT doc_id, 'uncategorized' FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM hits)",
    "edge_resolution": _RESOLVED,
    "mesh_orphans": f"SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT source FROM ({_URGENT})) AND c_custkey NOT IN (SELECT found FROM ({_URGENT}) WHERE found IS NOT NULL)",
}
