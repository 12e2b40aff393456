"""Plans over the registry, documents, captures and events, as DataFrame plans with SQL written apart (inventory JN-*, ST-*, TX-*, PF-*, MX-*, N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sixline import tables as T
from sixline.functions.axes import rnd
from sixline.operators import clock, dewey, diff
from sixline.plans.dialect import even
from sixline.plans.ensemble import _VALID, PROFILE, _profiles
from sixline.plans.scoring import ORACLE as _SCORED
from sixline.plans.scoring import QUERIES as _SCORES
from sixline.session import table
from sixline.tables import AXES

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = even(sql)
        return f

    return add


_NEWEST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edition_id, hexagram_id ORDER BY updated_at DESC NULLS LAST, name DESC NULLS LAST, category DESC NULLS LAST, action DESC NULLS LAST, "binary" DESC NULLS LAST) AS rn FROM {t}) AS n WHERE rn = 1)"""
_A = _NEWEST.format(t="hexagram_registry")
_B = _NEWEST.format(t="(SELECT * REPLACE (CAST(regexp_extract(hexagram_id, '([0-9]+)', 1) AS INTEGER) AS hexagram_id) FROM hexagram_registry_copy)")
_KEEP = ["name", "category", "action", "binary"]


def _newest(df: DataFrame) -> DataFrame:
    """Each hexagram of each edition by its newest row."""
    order = F.max(F.struct("updated_at", *_KEEP)).alias("s")
    return df.groupBy("edition_id", "hexagram_id").agg(order).select("edition_id", "hexagram_id", "s.*")


def _copies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a, b = table(spark, d, "hexagram_registry"), table(spark, d, "hexagram_registry_copy")
    return _newest(a), _newest(b.withColumn("hexagram_id", diff.digits("hexagram_id")))


@query(f"SELECT coalesce(b.edition_id, a.edition_id) AS edition_id, coalesce(b.hexagram_id, a.hexagram_id) AS hexagram_id, CASE WHEN b.edition_id IS NULL THEN a.name ELSE b.name END AS name, CASE WHEN b.edition_id IS NULL THEN 'first' ELSE 'second' END AS origin FROM {_A} AS a FULL JOIN {_B} AS b ON a.edition_id = b.edition_id AND a.hexagram_id = b.hexagram_id")
def registry_union(spark: SparkSession, d: str) -> DataFrame:
    """ST-02: both copies as one; where both have a key the second wins."""
    a, b = _copies(spark, d)
    both = a.withColumn("origin", F.lit("first")).unionByName(b.withColumn("origin", F.lit("second")))
    return both.groupBy("edition_id", "hexagram_id").agg(F.max_by(F.struct("name", "origin"), "origin").alias("s")).select("edition_id", "hexagram_id", "s.*")


@query("""SELECT a.edition_id, CASE WHEN b.cats IS NULL THEN NULL ELSE len(list_filter(a.cats, lambda c: NOT list_contains(b.cats, c))) = 0 END AS is_subset, len(a.cats) AS categories FROM (SELECT edition_id, list(DISTINCT category) FILTER (WHERE category IS NOT NULL) AS cats FROM hexagram_registry GROUP BY edition_id) AS a
  LEFT JOIN (SELECT edition_id, list(DISTINCT category) FILTER (WHERE category IS NOT NULL) AS cats FROM hexagram_registry_copy GROUP BY edition_id) AS b ON b.edition_id = a.edition_id""")
def edition_subsets(spark: SparkSession, d: str) -> DataFrame:
    """ST-06: whether the categories of each edition are a subset of the other copy's."""
    sets = lambda t, name: table(spark, d, t).groupBy("edition_id").agg(F.collect_set("category").alias(name))
    j = sets("hexagram_registry", "a").join(sets("hexagram_registry_copy", "b"), "edition_id", "left")
    return j.select("edition_id", F.when(F.col("b").isNotNull(), F.size(F.array_except("a", "b")) == 0).alias("is_subset"), F.size("a").alias("categories"))


@query("""SELECT doc_id, array_to_string(list_filter(ts[1:80], lambda t: t IN ('and', 'or', 'not', 'if', 'then', 'while')), ' ') AS operators, least(len(ts), 80) AS kept, len(ts) AS tokens FROM (SELECT doc_id, list_filter(string_split(replace(lower(text), '/', ' '), ' '), lambda t: t <> '') AS ts FROM documents WHERE text IS NOT NULL) AS d""")
def doc_signatures(spark: SparkSession, d: str) -> DataFrame:
    """TX-07: the words of a text, slashes as spaces; of the first eighty those that join or negate, repeats included. The eighty are the feature: a signature."""
    tokens = F.filter(F.split(F.replace(F.lower("text"), F.lit("/"), F.lit(" ")), " "), lambda t: t != "")
    kept = F.filter(F.slice(F.col("ts"), 1, 80), lambda t: t.isin("and", "or", "not", "if", "then", "while"))
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", tokens.alias("ts")).select("doc_id", F.array_join(kept, " ").alias("operators"), F.least(F.size("ts"), F.lit(80)).alias("kept"), F.size("ts").alias("tokens"))


@query("SELECT edition_id, hexagram_id, array_to_string(list_transform(string_split(translate(lower(name), '-_', '  '), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS label FROM hexagram_registry WHERE name IS NOT NULL")
def registry_labels(spark: SparkSession, d: str) -> DataFrame:
    """TX-14: names as labels, signs between words as spaces, each word with a capital."""
    return table(spark, d, "hexagram_registry").filter("name IS NOT NULL").select("edition_id", "hexagram_id", F.initcap(F.translate(F.lower("name"), "-_", "  ")).alias("label"))


@query("SELECT edition_id, least((hexagram_id - 1) // 12, 5) + 1 AS section, count(*) AS records, count(DISTINCT hexagram_id) AS states FROM hexagram_registry GROUP BY 1, 2")
def registry_sections(spark: SparkSession, d: str) -> DataFrame:
    """PF-17: editions by sections of twelve states, the last one shorter."""
    section = F.least(F.floor((F.col("hexagram_id") - 1) / 12), F.lit(5)) + 1
    return table(spark, d, "hexagram_registry").groupBy("edition_id", section.alias("section")).agg(F.count(F.lit(1)).alias("records"), F.count_distinct("hexagram_id").alias("states"))


@query("SELECT action, category, normal_action, normal_category, count(*) AS rows FROM (SELECT action, category, CASE WHEN upper(action) IN ('ASSERT', 'YIELD', 'ADAPT', 'WAIT') THEN upper(action) ELSE 'WAIT' END AS normal_action, CASE WHEN lower(category) IN ('sovereign', 'transformer', 'dissipator', 'boundary') THEN lower(category) ELSE 'transformer' END AS normal_category FROM hexagram_registry_copy) AS n GROUP BY 1, 2, 3, 4")
def enums_normalised(spark: SparkSession, d: str) -> DataFrame:
    """PF-26: actions and categories as one of the known ones, else the default."""
    known = lambda c, f, values, default: F.when(f(c).isin(values), f(c)).otherwise(default)
    rows = table(spark, d, "hexagram_registry_copy").select("action", "category", known("action", F.upper, ["ASSERT", "YIELD", "ADAPT", "WAIT"], "WAIT").alias("normal_action"), known("category", F.lower, ["sovereign", "transformer", "dissipator", "boundary"], "transformer").alias("normal_category"))
    return rows.groupBy("action", "category", "normal_action", "normal_category").agg(F.count(F.lit(1)).alias("rows"))


_MEANS = ", ".join(f"round(avg({c}), 6) AS {a}" for c, a in zip(PROFILE, AXES))


@query(f"""SELECT h.id, h.name, h.category, h.action, coalesce(r.name, 'unnamed') AS latest_name, {', '.join(f'coalesce(w.{a}, 0.5) AS {a}' for a in AXES)} FROM {T.states_sql()} AS h LEFT JOIN (SELECT hexagram_id, {_MEANS} FROM {_VALID} AS v GROUP BY hexagram_id) AS w ON w.hexagram_id = h.id
  LEFT JOIN (SELECT hexagram_id, name FROM (SELECT hexagram_id, name, row_number() OVER (PARTITION BY hexagram_id ORDER BY updated_at DESC, name DESC) AS rn FROM hexagram_registry WHERE name IS NOT NULL AND updated_at IS NOT NULL) AS n WHERE rn = 1) AS r ON r.hexagram_id = h.id""")
def state_cards(spark: SparkSession, d: str) -> DataFrame:
    """JN-04: every state with its weights and its latest name in the registry, defaults where it has none."""
    w = _profiles(spark, d).groupBy(F.col("hexagram_id").alias("id")).agg(*[rnd(F.avg(c)).alias(a) for c, a in zip(PROFILE, AXES)])
    r = table(spark, d, "hexagram_registry").filter("name IS NOT NULL AND updated_at IS NOT NULL").groupBy(F.col("hexagram_id").alias("id")).agg(F.max(F.struct("updated_at", "name"))["name"].alias("latest_name"))
    cards = T.states(spark).join(w, "id", "left").join(r, "id", "left")
    return cards.select("id", "name", "category", "action", F.coalesce("latest_name", F.lit("unnamed")).alias("latest_name"), *[F.coalesce(a, F.lit(0.5)).alias(a) for a in AXES])


_HALF = lambda test: f"(SELECT hexagram_id, {', '.join(f'round(avg({c}), 6) AS {a}' for c, a in zip(PROFILE, AXES))} FROM {_VALID} AS v WHERE {test} GROUP BY hexagram_id)"


@query(" UNION ALL ".join(f"SELECT a.hexagram_id, '{x}' AS field, a.{x} AS left_value, b.{x} AS right_value FROM {_HALF('phase_temporal IS NULL')} AS a JOIN {_HALF('phase_temporal IS NOT NULL')} AS b ON a.hexagram_id = b.hexagram_id WHERE abs(a.{x} - b.{x}) > 0.05" for x in AXES))
def reconcile_weights(spark: SparkSession, d: str) -> DataFrame:
    """JN-13: states whose weights differ by more than a tolerance between profiles without and with a phase, field by field."""
    p = _profiles(spark, d)
    half = lambda test: p.filter(test).groupBy("hexagram_id").agg(*[rnd(F.avg(c)).alias(a) for c, a in zip(PROFILE, AXES)])
    return diff.reconciled(half("phase_temporal IS NULL"), half("phase_temporal IS NOT NULL"), ["hexagram_id"], list(AXES), 0.05)


@query("""SELECT event_id, round(chaos, 6) AS chaos, round(whimsy, 6) AS whimsy, round(1 - whimsy, 6) AS dark, round(coherence, 6) AS coherence, round(chaos - 0.5, 6) AS d_chaos, round(coherence - 0.5, 6) AS d_coherence FROM (
  SELECT event_id, least(1.0, 0.5 + f / 100 * 0.3) AS chaos, greatest(0.0, 0.5 - f / 100 * 0.2) AS coherence, (event_id % 101) / 100.0 AS whimsy FROM (SELECT event_id, CASE WHEN value IS NULL THEN 0 ELSE greatest(0.0, least(100.0, value)) END AS f FROM events) AS e) AS p""")
def emotional_parse(spark: SparkSession, d: str) -> DataFrame:
    """MX-33..35: axes from a base of one half, moved by fatigue and overridden by the slider, and what they differ from the base."""
    f = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("value"))), F.lit(0.0))
    chaos, coherence = F.least(F.lit(1.0), 0.5 + f / 100 * 0.3), F.greatest(F.lit(0.0), 0.5 - f / 100 * 0.2)
    whimsy = (F.col("event_id") % 101) / 100.0
    return table(spark, d, "events").select("event_id", rnd(chaos).alias("chaos"), rnd(whimsy).alias("whimsy"), rnd(1 - whimsy).alias("dark"), rnd(coherence).alias("coherence"), rnd(chaos - 0.5).alias("d_chaos"), rnd(coherence - 0.5).alias("d_coherence"))


@query(f"""SELECT session_id, category, magnitude, place FROM (SELECT session_id, category, magnitude, row_number() OVER (PARTITION BY session_id ORDER BY magnitude DESC, category) AS place FROM (SELECT v.session_id, h.category || '/' || h.action AS category, round(sum(v.voiceweight), 4) AS magnitude FROM {_VALID} AS v JOIN {T.states_sql()} AS h ON h.id = v.hexagram_id GROUP BY 1, 2) AS m) AS r WHERE place <= 8""")
def personality_roles(spark: SparkSession, d: str) -> DataFrame:
    """AG-19: the eight strongest roles of each session by the summed weight of their states."""
    h = F.broadcast(T.states(spark).select(F.col("id").alias("hexagram_id"), F.concat_ws("/", "category", "action").alias("category")))
    m = _profiles(spark, d).join(h, "hexagram_id").groupBy("session_id", "category").agg(rnd(F.sum("voiceweight"), 4).alias("magnitude"))
    return m.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("magnitude"), "category"))).filter("place <= 8")


@query("SELECT source AS domain, count(*) AS documents, string_agg(DISTINCT lang, ',' ORDER BY lang) AS labels, min(lang) AS entry_point FROM documents WHERE source IS NOT NULL GROUP BY source")
def domain_sidecars(spark: SparkSession, d: str) -> DataFrame:
    """Each domain's number of texts, its different labels in order, and the first."""
    return table(spark, d, "documents").filter("source IS NOT NULL").groupBy(F.col("source").alias("domain")).agg(F.count(F.lit(1)).alias("documents"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("labels"), F.min("lang").alias("entry_point"))


@query("""WITH ok AS (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY source HAVING count(text) >= 5 AND count(DISTINCT doc_id) = count(*)),
  f AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '<math[^>]*>([^<]*)</math>', 1)) AS formula FROM documents)
  SELECT d.source, 'text' AS kind, count(*) AS rows, CAST(sum(length(d.text)) AS BIGINT) AS chars FROM documents AS d JOIN ok ON ok.source = d.source WHERE length(d.text) > 40 GROUP BY d.source
  UNION ALL SELECT f.source, 'formula', count(*), CAST(sum(length(formula)) AS BIGINT) FROM f JOIN ok ON ok.source = f.source GROUP BY f.source""")
def corpus_parts(spark: SparkSession, d: str) -> DataFrame:
    """AG-31, corpus assembly: texts and formulas of the sources that pass their checks, as one corpus by source and kind."""
    doc = table(spark, d, "documents").filter("source IS NOT NULL")
    ok = doc.groupBy("source").agg(F.count("text").alias("t"), F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("u")).filter("t >= 5 AND u = n").select("source")
    texts = doc.filter(F.length("text") > 40).select("source", F.lit("text").alias("kind"), F.length("text").alias("n"))
    formulas = doc.select("source", F.explode(F.regexp_extract_all("text", F.lit(r"<math[^>]*>([^<]*)</math>"), F.lit(1))).alias("f")).select("source", F.lit("formula").alias("kind"), F.length("f").alias("n"))
    parts = texts.unionByName(formulas).groupBy("source", "kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("chars"))
    return parts.join(ok, "source", "left_semi")


@query(f"SELECT slider, line, coalesce(line <> lag(line) OVER (ORDER BY slider), FALSE) AS changed FROM (SELECT slider, string_agg(CAST(id AS VARCHAR), ' | ' ORDER BY place) AS line FROM ({_SCORED['debug_hex_scores_top12']}) AS s GROUP BY slider) AS r")
def slider_rollout(spark: SparkSession, d: str) -> DataFrame:
    """describe/rollout: the best twelve of every slider as one line, and whether it differs from the slider before; eleven rows."""
    top = _SCORES["debug_hex_scores_top12"](spark, d)
    lines = top.groupBy("slider").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"].cast("string")), " | ").alias("line"))
    return lines.withColumn("changed", F.coalesce(F.col("line") != F.lag("line").over(Window.orderBy("slider")), F.lit(False)))


@query("SELECT source, CAST(sum(len(f)) AS BIGINT) AS formulas, count(*) FILTER (WHERE len(f) > 0) AS pages, max(len(f)) AS most FROM (SELECT source, regexp_extract_all(text, '<math[^>]*>[^<]*</math>') AS f FROM documents WHERE source IS NOT NULL AND text IS NOT NULL) AS d GROUP BY source")
def formula_batches(spark: SparkSession, d: str) -> DataFrame:
    """math_batch_record: formulas and pages with any, by source."""
    n = F.size(F.regexp_extract_all("text", F.lit(r"<math[^>]*>[^<]*</math>"), F.lit(0)))
    return table(spark, d, "documents").filter("source IS NOT NULL AND text IS NOT NULL").select("source", n.alias("n")).groupBy("source").agg(F.sum("n").alias("formulas"), F.count_if(F.col("n") > 0).alias("pages"), F.max("n").alias("most"))


@query(None)
def domain_bridges(spark: SparkSession, d: str) -> DataFrame:
    """JN-18: the domains of every snapshot with the bridge that begins with their name, null where there is none."""
    rows = dewey.tables(table(spark, d, "domain_registry"), ["snapshot_id"], "payload")
    domain = rows.filter(F.col("path").endswith(".domains{}")).select("snapshot_id", F.col("key").alias("domain")).distinct()
    bridge = rows.filter(F.col("path").endswith(".bridges{}")).select("snapshot_id", F.regexp_extract("key", "^(.*)_to_[a-z]+$", 1).alias("domain"), F.col("key").alias("bridge")).distinct()
    return domain.join(bridge, ["snapshot_id", "domain"], "left")


@query(None)
def capture_states(spark: SparkSession, d: str) -> DataFrame:
    """JN-19: ranked hexagrams of the captures with the state that each must have; an unknown one is an error, not a lost row."""
    ranked = dewey.ranked(table(spark, d, "capture_detailed")).select("capture_id", "level", "pos", "hexagram_id").distinct()
    j = ranked.join(F.broadcast(T.states(spark)), F.col("hexagram_id") == F.col("id"), "left")
    name = F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("no state "), F.col("hexagram_id").cast("string")))).otherwise(F.col("name"))
    return j.select("capture_id", "level", "pos", "hexagram_id", name.alias("name"), "category", "action")


@query(f"""SELECT profile_id, ingested_at, coalesce(ax[1], 0) AS v1, coalesce(ax[2], 0) AS v2, coalesce(ax[3], 0) AS v3, coalesce(ax[4], 1) AS v4, coalesce(ax[5], 1) AS v5, len(ax) AS given FROM (SELECT profile_id, ingested_at, list_filter([{', '.join(PROFILE)}], lambda v: v IS NOT NULL) AS ax FROM emotional_weights) AS e""")
def vector_padding(spark: SparkSession, d: str) -> DataFrame:
    """MX-09: vectors of any length as five axes, with the defaults 0, 0, 0, 1, 1."""
    given = F.filter(F.array(*PROFILE), lambda v: v.isNotNull())
    return table(spark, d, "emotional_weights").select("profile_id", "ingested_at", given.alias("ax")).select("profile_id", "ingested_at", *[F.coalesce(F.get("ax", i), F.lit(v)).alias(f"v{i + 1}") for i, v in enumerate((0.0, 0.0, 0.0, 1.0, 1.0))], F.size("ax").alias("given"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'past' WHEN 1 THEN 'present' ELSE 'future' END AS dominant, CASE WHEN event_id % 3 = 0 THEN 0.6 ELSE 0.2 END AS past, CASE WHEN event_id % 3 = 1 THEN 0.6 ELSE 0.2 END AS present, CASE WHEN event_id % 3 = 2 THEN 0.6 ELSE 0.2 END AS future, 1 << (event_id % 3) AS bits FROM events""")
def temporal_weights(spark: SparkSession, d: str) -> DataFrame:
    """MX-36, MX-37: weights of the three temporals with the dominant one by the tick, and it alone as bits."""
    k = F.col("event_id") % 3
    names = ["past", "present", "future"]
    dominant = F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    return table(spark, d, "events").select("event_id", dominant.alias("dominant"), *[F.when(k == i, 0.6).otherwise(0.2).alias(n) for i, n in enumerate(names)], F.expr("shiftleft(1, CAST(event_id % 3 AS INT))").alias("bits"))


@query(f"""SELECT edition_id, hexagram_id, name, category, action, "binary" AS bits, upper_trigram || '/' || lower_trigram AS trigrams FROM hexagram_registry WHERE name IS NOT NULL AND upper_trigram IS NOT NULL AND lower_trigram IS NOT NULL""")
def registry_flat(spark: SparkSession, d: str) -> DataFrame:
    """PF-08, PF-09: nested records as flat columns, without the ones that aren't wanted."""
    r = table(spark, d, "hexagram_registry").filter("name IS NOT NULL AND upper_trigram IS NOT NULL AND lower_trigram IS NOT NULL")
    nested = r.select("edition_id", "hexagram_id", "updated_at", F.struct("name", F.struct("category", "action").alias("kind"), F.struct(F.col("binary").alias("bits"), F.concat_ws("/", "upper_trigram", "lower_trigram").alias("trigrams")).alias("lines")).alias("r"))
    return nested.drop("updated_at").select("edition_id", "hexagram_id", "r.name", "r.kind.*", "r.lines.*")


@query("""SELECT n AS minutes, 'every ' || CASE WHEN n % 60 = 0 THEN CAST(n // 60 AS VARCHAR) || 'h' ELSE CAST(n AS VARCHAR) || 'm' END AS text, least(3600, greatest(60, n * 60)) AS seconds FROM (SELECT DISTINCT CAST(l_quantity * 5 AS INTEGER) AS n FROM lineitem) AS q""")
def intervals(spark: SparkSession, d: str) -> DataFrame:
    """TX-20: intervals as schedule texts and back as seconds, within a minute and an hour."""
    n = table(spark, d, "lineitem").select((F.col("l_quantity") * 5).cast("int").alias("minutes")).distinct()
    return n.select("minutes", clock.interval_text(F.col("minutes")).alias("text")).withColumn("seconds", clock.interval_seconds(F.col("text")))
