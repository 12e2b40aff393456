"""Aggregates and windows over resolved states, profiles, events and texts, as DataFrame plans with SQL written apart (inventory AG-*, WN-*, SO-*, ST-*, MX-*, PF-*, TX-*, SK-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sixline import tables as T
from sixline.functions.axes import clamp, cosine, kernel, lerp, middle, or_default, rnd
from sixline.operators import sessions
from sixline.plans import scoring, symbols
from sixline.plans.dialect import DUCK, SPARK, even
from sixline.session import table
from sixline.tables import AXES

PROFILE = ["chaos", "whimsy", "darktone", "coherence", "voiceweight"]


def _resolved(spark: SparkSession) -> DataFrame:
    """The 512 resolved states at no intensity."""
    return spark.sql(even(f"SELECT * FROM {scoring.expanded(SPARK)} AS e"))


_E = scoring.expanded(DUCK)


def _valid(df: DataFrame) -> DataFrame:
    """Profiles once each, with all axes within 0 and 1."""
    keep = F.lit(True)
    for c in PROFILE:
        keep = keep & F.col(c).between(0, 1)
    return df.filter(keep).select("profile_id", "session_id", "hexagram_id", "phase_temporal", *PROFILE).distinct()


_VALID = f"(SELECT DISTINCT profile_id, session_id, hexagram_id, phase_temporal, {', '.join(PROFILE)} FROM emotional_weights WHERE {' AND '.join(f'{c} BETWEEN 0 AND 1' for c in PROFILE)})"


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    return _valid(table(spark, d, "emotional_weights"))


QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    """Registers a plan with its SQL for DuckDB."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = even(sql)
        return f

    return add


# --- Ensembles of the 512 states ---------------------------------------------------------------


@query(f"""SELECT temporal, count(*) AS states, {', '.join(f'round(avg({a}), 6) AS {a}' for a in AXES)}, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (WHERE rn <= 5) AS first_five
  FROM (SELECT *, row_number() OVER (PARTITION BY temporal ORDER BY id) AS rn FROM {_E} AS e) AS r GROUP BY temporal""")
def temporal_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """AG-06: mean of each temporal, its first five states by id, and how many it has."""
    first = F.slice(F.array_sort(F.collect_list("id")), 1, 5)  # 64 states each
    return _resolved(spark).groupBy("temporal").agg(F.count(F.lit(1)).alias("states"), *[rnd(F.avg(a)).alias(a) for a in AXES], F.array_join(first.cast("array<string>"), ",").alias("first_five"))


@query(f"""SELECT l.temporal, count(DISTINCT l.id) AS states, count(DISTINCT l.yao_key) AS yao_keys, count(DISTINCT e.porosity) AS porosities FROM {symbols.lines(symbols.space()).replace('{numbers}', DUCK.numbers(6))} AS l
  JOIN {_E} AS e ON e.id = l.id AND e.phase = l.phase GROUP BY l.temporal""")
def ensemble_distinct(spark: SparkSession, d: str) -> DataFrame:
    """AG-07: different states, line keys and porosities of each temporal."""
    lines = spark.sql(f"SELECT * FROM {symbols.lines(symbols.space()).replace('{numbers}', SPARK.numbers(6))} AS l").select("id", "phase", "temporal", "yao_key")
    each = lines.join(_resolved(spark).select("id", "phase", "porosity"), ["id", "phase"])
    return each.groupBy("temporal").agg(F.count_distinct("id").alias("states"), F.count_distinct("yao_key").alias("yao_keys"), F.count_distinct("porosity").alias("porosities"))


_SHIFTS = {p: s for p, _, _, s in T.PHASES}


@query(f"""SELECT id, round(avg(energy), 6) AS mean_energy, round(min(energy), 6) AS least_energy, round(max(energy), 6) AS most_energy FROM (
  SELECT e.id, greatest(0.0, least(1.0, {' + '.join(f'greatest(0.0, e.{a}) * abs(p.s_{a})' for a in AXES)} - (0.5 * abs(yin - yang) / 6.0 + 0.3 * yao / 6.0 + 0.2 * changing / 6.0))) AS energy
  FROM {_E} AS e JOIN {T.phases_sql()} AS p ON p.phase = e.phase) AS x GROUP BY id""")
def hamiltonian_energy(spark: SparkSession, d: str) -> DataFrame:
    """AG-08, MX-05: momentum of the resolved axes along the phase's shift, less the lines' imbalance, by state."""
    e = _resolved(spark).join(F.broadcast(T.phases(spark).drop("temporal", "polarity", *[f"_{a}" for a in AXES])), "phase")
    pull = sum((F.greatest(F.lit(0.0), F.col(a)) * F.abs(f"s_{a}") for a in AXES), F.lit(0.0))
    drag = 0.5 * F.abs(F.col("yin") - F.col("yang")) / 6 + 0.3 * F.col("yao") / 6 + 0.2 * F.col("changing") / 6
    return e.withColumn("energy", clamp(pull - drag)).groupBy("id").agg(rnd(F.avg("energy")).alias("mean_energy"), rnd(F.min("energy")).alias("least_energy"), rnd(F.max("energy")).alias("most_energy"))


@query(f"""WITH p AS (SELECT temporal, porosity / 4.0 AS pn, count(*) AS n FROM {_E} AS e GROUP BY temporal, porosity)
  SELECT temporal, round(sum(pn * n) / sum(n), 6) AS mean_porosity, arg_max(pn, n * 100 - pn) AS mode_porosity, round(sum(CASE WHEN pn = 0 THEN 0.35 ELSE pn END * n) / sum(n) / 2, 6) AS sigma FROM p GROUP BY temporal""")
def porosity_levels(spark: SparkSession, d: str) -> DataFrame:
    """AG-12: mean and mode of the porosity by temporal, of equal counts the least, and half the mean where 0 stands for 0.35."""
    p = _resolved(spark).groupBy("temporal", (F.col("porosity") / 4.0).alias("pn")).agg(F.count(F.lit(1)).alias("n"))
    weighed = lambda c: F.sum(c * F.col("n")) / F.sum("n")
    mode = F.max(F.struct("n", (-F.col("pn")).alias("low"), "pn"))["pn"]
    return p.groupBy("temporal").agg(rnd(weighed(F.col("pn"))).alias("mean_porosity"), mode.alias("mode_porosity"), rnd(weighed(or_default("pn", 0.35)) / 2).alias("sigma"))


@query(f"SELECT id, string_agg(CAST(phase AS VARCHAR) || ':' || CAST(porosity AS VARCHAR) || ':' || CAST(CAST(floor({' + '.join(AXES)} + 0.0001) AS INTEGER) AS VARCHAR), ' ' ORDER BY phase) AS details FROM {_E} AS e GROUP BY id")
def decision_details(spark: SparkSession, d: str) -> DataFrame:
    """AG-17: the details of each state's eight phases, collected in their order."""
    total = F.floor(sum((F.col(a) for a in AXES[1:]), F.col(AXES[0])) + 0.0001).cast("int").cast("string")
    one = F.concat_ws(":", F.col("phase").cast("string"), F.col("porosity").cast("string"), total)
    return _resolved(spark).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("phase", one.alias("s")))), lambda x: x["s"]), " ").alias("details"))


@query(f"SELECT s.slider, e.id, e.phase FROM {_E} AS e, (SELECT range * 10 AS slider FROM range(11)) AS s WHERE abs(e.porosity / 4.0 - s.slider / 100.0) < 0.35")
def porosity_window(spark: SparkSession, d: str) -> DataFrame:
    """PF-10: the states whose porosity lies within 0.35 of a slider, for every slider of the grid."""
    sliders = F.explode(F.array(*[F.lit(10 * i) for i in range(11)])).alias("slider")
    return _resolved(spark).select(sliders, "id", "phase", "porosity").filter(F.abs(F.col("porosity") / 4.0 - F.col("slider") / 100.0) < 0.35).select("slider", "id", "phase")


@query(f"""SELECT category, {', '.join(f"CAST(sum(CASE WHEN temporal = '{t}' THEN 1 ELSE 0 END) AS BIGINT) AS {t}" for _, t, _, _ in T.PHASES)}, round(avg(coherence), 6) AS coherence, CAST(sum(CASE WHEN action = 'ASSERT' THEN 1 ELSE 0 END) AS BIGINT) AS asserting FROM {_E} AS e GROUP BY category""")
def widget_matrix(spark: SparkSession, d: str) -> DataFrame:
    """SK-07: states by category and temporal, as a viewer's matrix."""
    e = _resolved(spark)
    wide = e.groupBy("category").pivot("temporal", [t for _, t, _, _ in T.PHASES]).count().na.fill(0)
    return wide.join(e.groupBy("category").agg(rnd(F.avg("coherence")).alias("coherence"), F.sum((F.col("action") == "ASSERT").cast("long")).alias("asserting")), "category")


@query(f"SELECT porosity, action, count(*) AS states, min(id) AS first_id, max(id) AS last_id, round(avg(voice), 6) AS voice FROM {_E} AS e GROUP BY porosity, action")
def widget_porosity(spark: SparkSession, d: str) -> DataFrame:
    """SK-07: histogram of the porosity by action."""
    return _resolved(spark).groupBy("porosity", "action").agg(F.count(F.lit(1)).alias("states"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), rnd(F.avg("voice")).alias("voice"))


@query(f"""SELECT e.id, e.phase, s.code, h.name, e.category, e.action, e.temporal, s.polarity, s.ternary, e.yin, e.yang, e.yao, e.changing, e.porosity, {', '.join(f'round(e.{a}, 4) AS {a}' for a in AXES)}, CASE WHEN e.yao > 0 THEN 1 ELSE 0 END AS moving
  FROM {_E} AS e JOIN {symbols.space()} AS s ON s.id = e.id AND s.phase = e.phase JOIN {T.states_sql()} AS h ON h.id = e.id""")
def weights_20(spark: SparkSession, d: str) -> DataFrame:
    """SK-04: the table of twenty columns for all 512 states."""
    space = spark.sql(f"SELECT id, phase, code, name, polarity, ternary FROM {symbols.space()} AS s")
    e = _resolved(spark).join(space, ["id", "phase"])
    return e.select("id", "phase", "code", "name", "category", "action", "temporal", "polarity", "ternary", "yin", "yang", "yao", "changing", "porosity", *[rnd(a, 4).alias(a) for a in AXES], (F.col("yao") > 0).cast("int").alias("moving"))


@query(f"""SELECT id, phase, string_agg(CAST(position AS VARCHAR) || '=' || yao_key, ' ' ORDER BY position) AS lines FROM {symbols.lines(symbols.space()).replace('{numbers}', DUCK.numbers(6))} AS l GROUP BY id, phase""")
def line_arrays(spark: SparkSession, d: str) -> DataFrame:
    """SO-10, SS-11: the lines of every state and phase in their order, with their keys."""
    lines = spark.sql(f"SELECT * FROM {symbols.lines(symbols.space()).replace('{numbers}', SPARK.numbers(6))} AS l")
    one = F.struct("position", F.concat_ws("=", F.col("position").cast("string"), "yao_key").alias("s"))
    return lines.groupBy("id", "phase").agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["s"]), " ").alias("lines"))


_VARIANT = """CASE state WHEN 0 THEN CASE WHEN is_changing = 1 THEN 'old_yin' WHEN temporal IN ('past', 'void') THEN 'stable_yin' ELSE 'young_yin' END
  WHEN 1 THEN CASE WHEN is_changing = 1 THEN 'old_yang' WHEN temporal IN ('future', 'crystallization') THEN 'new_yang' ELSE 'stable_yang' END
  ELSE CASE WHEN is_changing = 1 THEN 'old_yao' WHEN temporal IN ('transition', 'dissolution') THEN 'new_yao' ELSE 'stable_yao' END END"""


@query(f"SELECT temporal, yao_key, {_VARIANT} AS changing_first, count(*) AS lines FROM {symbols.lines(symbols.space()).replace('{numbers}', DUCK.numbers(6))} AS l GROUP BY 1, 2, 3")
def yao_variants(spark: SparkSession, d: str) -> DataFrame:
    """MX-10: the line keys by temporal first and by change first, side by side."""
    lines = spark.sql(f"SELECT * FROM {symbols.lines(symbols.space()).replace('{numbers}', SPARK.numbers(6))} AS l")
    moving = F.col("is_changing") == 1
    key = (
        F.when(F.col("state") == 0, F.when(moving, "old_yin").when(F.col("temporal").isin("past", "void"), "stable_yin").otherwise("young_yin"))
        .when(F.col("state") == 1, F.when(moving, "old_yang").when(F.col("temporal").isin("future", "crystallization"), "new_yang").otherwise("stable_yang"))
        .otherwise(F.when(moving, "old_yao").when(F.col("temporal").isin("transition", "dissolution"), "new_yao").otherwise("stable_yao"))
    )
    return lines.groupBy("temporal", "yao_key", key.alias("changing_first")).agg(F.count(F.lit(1)).alias("lines"))


@query(f"""SELECT id, phase, coalesce(arg_max(yao_key, position / 6.0 + 1) FILTER (WHERE yao_key LIKE 'old%'), 'stable_yao') AS best FROM {symbols.lines(symbols.space()).replace('{numbers}', DUCK.numbers(6))} AS l GROUP BY id, phase""")
def best_match_yao(spark: SparkSession, d: str) -> DataFrame:
    """The old line that stands highest, of every state and phase."""
    lines = spark.sql(f"SELECT * FROM {symbols.lines(symbols.space()).replace('{numbers}', SPARK.numbers(6))} AS l")
    return lines.groupBy("id", "phase").agg(F.coalesce(F.max(F.when(F.col("yao_key").startswith("old"), F.struct("position", "yao_key")))["yao_key"], F.lit("stable_yao")).alias("best"))


@query(f"""SELECT h.id, n.i + 1 AS position, substr(h.bits, n.i + 1, 1) AS bit, CASE WHEN n.i < 3 THEN substr(h.bits, 1, 3) ELSE substr(h.bits, 4, 3) END AS trigram_bits, n.i % 3 + 1 AS trigram_position, t.tname AS trigram_name, h.category, h.action
  FROM {T.states_sql()} AS h CROSS JOIN (SELECT CAST(range AS INTEGER) AS i FROM range(6)) AS n JOIN {T.trigrams_sql()} AS t ON t.tbits = CASE WHEN n.i < 3 THEN substr(h.bits, 1, 3) ELSE substr(h.bits, 4, 3) END""")
def slot_tags(spark: SparkSession, d: str) -> DataFrame:
    """MX-42, JN-11: tags of every line of every state: its bit, trigram and place in it."""
    h = T.states(spark)
    each = h.select("id", "category", "action", "bits", F.posexplode(F.split("bits", "")).alias("i", "bit")).filter("bit <> ''")
    bits = F.when(F.col("i") < 3, F.substring("bits", 1, 3)).otherwise(F.substring("bits", 4, 3))
    each = each.withColumn("trigram_bits", bits).join(F.broadcast(T.trigrams(spark).select(F.col("tbits").alias("trigram_bits"), F.col("tname").alias("trigram_name"))), "trigram_bits")
    return each.select("id", (F.col("i") + 1).alias("position"), "bit", "trigram_bits", (F.col("i") % 3 + 1).alias("trigram_position"), "trigram_name", "category", "action")


@query(f"""WITH b AS (SELECT h.id, p.phase, length(replace(h.bits, '0', '')) AS y, (p.phase + 1) % 4 AS shift FROM {T.states_sql()} AS h CROSS JOIN {T.phases_sql()} AS p),
  m AS (SELECT *, least(shift, y) AS my, least(shift, 6 - y) AS mi, CASE WHEN phase >= 4 THEN least(phase - 3, 2) ELSE 0 END AS yao FROM b)
  SELECT id, phase, y - my - CASE WHEN y - my >= yao THEN yao ELSE 0 END AS stable_yang, my // 2 AS old_yang, my - my // 2 AS new_yang, 6 - y - mi - CASE WHEN y - my >= yao THEN 0 ELSE yao END AS stable_yin, mi // 2 AS old_yin, mi - mi // 2 AS new_yin, yao AS stable_yao FROM m""")
def phase_yao_counts(spark: SparkSession, d: str) -> DataFrame:
    """MX-29: how a state's lines are distributed over the families as its phase moves on."""
    space = T.states(spark).select("id", "bits", F.explode(F.array(*[F.lit(p) for p, *_ in T.PHASES])).alias("phase"))
    y = F.length(F.translate("bits", "0", ""))
    shift = (F.col("phase") + 1) % 4
    moved = space.select("id", "phase", y.alias("y"), F.least(shift, y).alias("my"), F.least(shift, 6 - y).alias("mi"), F.when(F.col("phase") >= 4, F.least(F.col("phase") - 3, F.lit(2))).otherwise(0).alias("stable_yao"))
    left = F.col("y") - F.col("my")
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    return moved.select(
        "id", "phase", (left - F.when(left >= F.col("stable_yao"), F.col("stable_yao")).otherwise(0)).alias("stable_yang"), half("my").alias("old_yang"), (F.col("my") - half("my")).alias("new_yang"),
        (6 - F.col("y") - F.col("mi") - F.when(left >= F.col("stable_yao"), 0).otherwise(F.col("stable_yao"))).alias("stable_yin"), half("mi").alias("old_yin"), (F.col("mi") - half("mi")).alias("new_yin"), "stable_yao",
    )


# --- Pools ------------------------------------------------------------------------------------


#: Pools, at most, that are held against every vector.
POOLS = 10_000


def pools(profiles: DataFrame) -> DataFrame:
    """pool, p_*: the pool table that the operators take as parameter; here the profiles' means by phase, whose number is that of the phases' names."""
    return profiles.filter("phase_temporal IS NOT NULL").groupBy(F.col("phase_temporal").alias("pool")).agg(*[rnd(F.avg(c), 4).alias(f"p_{a}") for c, a in zip(PROFILE, AXES)])


def ranked_pools(vectors: DataFrame, keys: list[str], pool_table: DataFrame) -> DataFrame:
    """WN-08: all pools of every vector by cosine, ties by name; the pool table is a dimension that every vector is held against, so it is exploded per row."""
    held = pool_table.agg(F.collect_list(F.struct("pool", *[f"p_{a}" for a in AXES])).alias("_pools"))
    held = held.select(F.when(F.size("_pools") <= POOLS, F.col("_pools")).otherwise(F.raise_error(F.lit(f"more than {POOLS} pools"))).alias("_pools"))
    each = vectors.join(F.broadcast(held)).select(*keys, *AXES, F.explode("_pools").alias("_p")).select(*keys, *AXES, "_p.*")
    sim = each.withColumn("similarity", rnd(cosine(AXES, [f"p_{a}" for a in AXES])))
    return sim.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("similarity"), "pool")))


_POOLS = f"(SELECT phase_temporal AS pool, {', '.join(f'round(avg({c}), 4) AS p_{a}' for c, a in zip(PROFILE, AXES))} FROM {_VALID} AS v WHERE phase_temporal IS NOT NULL GROUP BY phase_temporal)"
_RANKED = f"""(SELECT *, row_number() OVER (PARTITION BY id, phase ORDER BY similarity DESC, pool) AS place FROM (SELECT e.id, e.phase, {', '.join(f'e.{a}' for a in AXES)}, p.*, round(coalesce(({' + '.join(f'e.{a} * p_{a}' for a in AXES)}) / nullif(sqrt({' + '.join(f'e.{a} * e.{a}' for a in AXES)}) * sqrt({' + '.join(f'p_{a} * p_{a}' for a in AXES)}), 0), 0), 6) AS similarity
  FROM {_E} AS e CROSS JOIN {_POOLS} AS p) AS s)"""


@query(f"SELECT id, phase, pool, similarity, place FROM {_RANKED} AS r")
def pool_rank_512(spark: SparkSession, d: str) -> DataFrame:
    """WN-08, MX-08: every pool ranked for every state and phase."""
    return ranked_pools(_resolved(spark), ["id", "phase"], pools(_profiles(spark, d))).select("id", "phase", "pool", "similarity", "place")


@query(f"""SELECT e.id, e.phase, r.pool, {', '.join(f'round(greatest(0.0, least(1.0, e.{a} * (1 - e.pn * 0.5) + r.p_{a} * e.pn * 0.5)), 6) AS {a}' for a in AXES)} FROM {_E} AS e JOIN {_RANKED} AS r ON r.id = e.id AND r.phase = e.phase AND r.place = 1""")
def porosity_blend(spark: SparkSession, d: str) -> DataFrame:
    """MX-27, JN-10: each state's vector blended with its nearest pool by its porosity."""
    e = _resolved(spark)
    best = ranked_pools(e, ["id", "phase"], pools(_profiles(spark, d))).filter("place = 1").select("id", "phase", "pool", *[f"p_{a}" for a in AXES])
    half = F.col("pn") * 0.5
    return e.join(best, ["id", "phase"]).select("id", "phase", "pool", *[rnd(clamp(F.col(a) * (1 - half) + F.col(f"p_{a}") * half)).alias(a) for a in AXES])


@query(f"""WITH r AS (SELECT * FROM {_RANKED} AS x WHERE phase = 0 AND place <= 3)
  SELECT a.id, n.i + 1 AS slot, t.i AS ternary, {', '.join(f'round(CASE t.i WHEN 0 THEN 0.6 * a.p_{x} + 0.25 * b.p_{x} + 0.15 * c.p_{x} WHEN 1 THEN 0.6 * b.p_{x} + 0.25 * a.p_{x} + 0.15 * c.p_{x} ELSE 0.4 * a.p_{x} + 0.4 * b.p_{x} + 0.2 * c.p_{x} END, 6) AS {x}' for x in AXES)}
  FROM r AS a JOIN r AS b ON b.id = a.id AND b.place = 2 JOIN r AS c ON c.id = a.id AND c.place = 3 CROSS JOIN (SELECT CAST(range AS INTEGER) AS i FROM range(6)) AS n CROSS JOIN (SELECT CAST(range AS INTEGER) AS i FROM range(3)) AS t WHERE a.place = 1""")
def slot_blend(spark: SparkSession, d: str) -> DataFrame:
    """MX-24, MX-26: for each line and line state a blend of three pools, by fixed weights."""
    r = ranked_pools(_resolved(spark).filter("phase = 0"), ["id", "phase"], pools(_profiles(spark, d))).filter("place <= 3")
    at = lambda k, a: F.max(F.when(F.col("place") == k, F.col(f"p_{a}"))).alias(f"{a}{k}")
    wide = r.groupBy("id").agg(*[at(k, a) for k in (1, 2, 3) for a in AXES])
    each = wide.select("*", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("slot")).select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ternary"))
    mix = lambda a, w: w[0] * F.col(f"{a}1") + w[1] * F.col(f"{a}2") + w[2] * F.col(f"{a}3")
    by = lambda a: F.when(F.col("ternary") == 0, mix(a, (0.6, 0.25, 0.15))).when(F.col("ternary") == 1, 0.6 * F.col(f"{a}2") + 0.25 * F.col(f"{a}1") + 0.15 * F.col(f"{a}3")).otherwise(mix(a, (0.4, 0.4, 0.2)))
    return each.select("id", "slot", "ternary", *[rnd(by(a)).alias(a) for a in AXES])


# --- Profiles ---------------------------------------------------------------------------------


@query(f"SELECT session_id, count(*) AS cards, round(avg(coherence), 6) AS coherence FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY profile_id) AS rn FROM {_VALID} AS v) AS r WHERE rn <= 64 GROUP BY session_id")
def session_coherence(spark: SparkSession, d: str) -> DataFrame:
    """AG-21: mean coherence of each session's first 64 profiles."""
    first = _profiles(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("session_id").orderBy("profile_id"))).filter("rn <= 64")
    return first.groupBy("session_id").agg(F.count(F.lit(1)).alias("cards"), rnd(F.avg("coherence")).alias("coherence"))


_SPREADS = {c: f"max({c}) - min({c})" for c in PROFILE}


@query(f"""SELECT session_id, coverage_rate, phases, round(spread, 6) AS spread, concat_ws(',', CASE WHEN coverage_rate < 0.99 THEN 'states' END, CASE WHEN phases < 8 THEN 'phases' END, CASE WHEN spread < 1.5 THEN 'spread' END) AS gaps,
  CASE WHEN coverage_rate < 0.95 THEN 'states' WHEN phases < 8 THEN 'phases' WHEN narrow < 1e-6 THEN 'spread' ELSE 'whole' END AS verdict
  FROM (SELECT session_id, count(DISTINCT hexagram_id) / 64.0 AS coverage_rate, count(DISTINCT phase_temporal) AS phases, {' + '.join(_SPREADS.values())} AS spread, least({', '.join(_SPREADS.values())}) AS narrow FROM {_VALID} AS v GROUP BY session_id) AS s""")
def session_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """PF-27, PF-28, coverage_stats: how far each session covers states and phases, what it lacks, and the verdict."""
    width = {c: F.max(c) - F.min(c) for c in PROFILE}
    s = _profiles(spark, d).groupBy("session_id").agg((F.count_distinct("hexagram_id") / 64.0).alias("coverage_rate"), F.count_distinct("phase_temporal").alias("phases"), sum(list(width.values())[1:], width["chaos"]).alias("spread"), F.least(*width.values()).alias("narrow"))
    rate, phases, spread = F.col("coverage_rate"), F.col("phases"), F.col("spread")
    gaps = F.concat_ws(",", F.when(rate < 0.99, "states"), F.when(phases < 8, "phases"), F.when(spread < 1.5, "spread"))
    verdict = F.when(rate < 0.95, "states").when(phases < 8, "phases").when(F.col("narrow") < 1e-6, "spread").otherwise("whole")
    return s.select("session_id", "coverage_rate", "phases", rnd("spread").alias("spread"), gaps.alias("gaps"), verdict.alias("verdict"))


@query("""WITH p AS (SELECT session_id, CAST(ingested_at AS DATE) AS day, round(avg(coherence), 6) AS coherence, count(*) AS profiles FROM emotional_weights WHERE coherence BETWEEN 0 AND 1 AND ingested_at IS NOT NULL GROUP BY 1, 2),
  o AS (SELECT *, row_number() OVER w AS pass, round(coherence - lag(coherence) OVER w, 6) AS delta FROM p WINDOW w AS (PARTITION BY session_id ORDER BY day)),
  r AS (SELECT *, CASE WHEN delta > 1e-6 AND lag(delta) OVER w > 1e-6 THEN 1 ELSE 0 END AS stops FROM o WINDOW w AS (PARTITION BY session_id ORDER BY day)),
  k AS (SELECT *, coalesce(sum(stops) OVER (PARTITION BY session_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM r)
  SELECT session_id, pass, day, profiles, coherence, delta, CASE WHEN delta > 1e-6 THEN 'increased' WHEN delta < -1e-6 THEN 'decreased' WHEN delta IS NOT NULL THEN 'unchanged' END AS direction FROM k WHERE stopped = 0 AND pass <= 6""")
def pass_trajectory(spark: SparkSession, d: str) -> DataFrame:
    """SS-09, WN-09, AG-30: a session's days as passes: change of coherence from pass to pass, up to five after the first, ending once two in a row improve."""
    w = table(spark, d, "emotional_weights").filter(F.col("coherence").between(0, 1) & F.col("ingested_at").isNotNull())
    p = w.groupBy("session_id", F.col("ingested_at").cast("date").alias("day")).agg(rnd(F.avg("coherence")).alias("coherence"), F.count(F.lit(1)).alias("profiles"))
    by = Window.partitionBy("session_id").orderBy("day")
    o = p.withColumn("pass", F.row_number().over(by)).withColumn("delta", rnd(F.col("coherence") - F.lag("coherence").over(by)))
    stops = F.coalesce((F.col("delta") > 1e-6) & (F.lag("delta").over(by) > 1e-6), F.lit(False)).cast("int")
    k = o.withColumn("stops", stops).withColumn("stopped", F.coalesce(F.sum("stops").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    direction = F.when(F.col("delta") > 1e-6, "increased").when(F.col("delta") < -1e-6, "decreased").when(F.col("delta").isNotNull(), "unchanged")
    return k.filter("stopped = 0 AND pass <= 6").select("session_id", "pass", "day", "profiles", "coherence", "delta", direction.alias("direction"))


@query(f"SELECT v.profile_id, {', '.join(f'round((v.{c} - m.l_{c}) / nullif(m.h_{c} - m.l_{c}, 0), 6) AS {c}' for c in PROFILE)} FROM {_VALID} AS v, (SELECT {', '.join(f'min({c}) AS l_{c}, max({c}) AS h_{c}' for c in PROFILE)} FROM {_VALID} AS x) AS m")
def profile_normalised(spark: SparkSession, d: str) -> DataFrame:
    """WN-07: every axis between the least and the greatest of all profiles; the extremes are one row, joined to all."""
    p = _profiles(spark, d)
    ends = p.agg(*[f(c).alias(f"{k}_{c}") for c in PROFILE for k, f in (("l", F.min), ("h", F.max))])
    return p.join(F.broadcast(ends)).select("profile_id", *[rnd((F.col(c) - F.col(f"l_{c}")) / F.nullif(F.col(f"h_{c}") - F.col(f"l_{c}"), F.lit(0.0))).alias(c) for c in PROFILE])


@query(f"SELECT id, 1 / 12.0 AS weight, row_number() OVER (ORDER BY round(m, 6) DESC, id) AS place FROM (SELECT hexagram_id AS id, avg(({' + '.join(PROFILE)}) / 5) AS m FROM {_VALID} AS v GROUP BY hexagram_id) AS s ORDER BY round(m, 6) DESC, id LIMIT 12")
def top12_uniform(spark: SparkSession, d: str) -> DataFrame:
    """SO-04: the twelve states of the greatest mean, with equal weights."""
    mean = sum((F.col(c) for c in PROFILE[1:]), F.col(PROFILE[0])) / 5
    top = _profiles(spark, d).groupBy(F.col("hexagram_id").alias("id")).agg(rnd(F.avg(mean)).alias("m")).orderBy(F.desc("m"), "id").limit(12)
    return top.select("id", F.lit(1 / 12.0).alias("weight"), F.row_number().over(Window.orderBy(F.desc("m"), "id")).alias("place"))  # twelve rows


@query("SELECT session_id, string_agg(phase_temporal, '>' ORDER BY first, phase_temporal) AS phases FROM (SELECT session_id, phase_temporal, min(profile_id) AS first FROM emotional_weights WHERE phase_temporal IS NOT NULL GROUP BY 1, 2) AS f GROUP BY session_id")
def session_phase_order(spark: SparkSession, d: str) -> DataFrame:
    """ST-03: the different phases of each session in the order of their first profile."""
    first = table(spark, d, "emotional_weights").filter("phase_temporal IS NOT NULL").groupBy("session_id", "phase_temporal").agg(F.min("profile_id").alias("first"))
    return first.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "phase_temporal"))), lambda x: x["phase_temporal"]), ">").alias("phases"))


@query("SELECT states, count(*) AS sessions, min(session_id) AS first_session FROM (SELECT session_id, string_agg(CAST(hexagram_id AS VARCHAR), ',' ORDER BY hexagram_id) AS states FROM (SELECT DISTINCT session_id, hexagram_id FROM documents WHERE session_id IS NOT NULL AND hexagram_id IS NOT NULL) AS s GROUP BY session_id) AS t GROUP BY states")
def state_set_groups(spark: SparkSession, d: str) -> DataFrame:
    """ST-07: sessions with the same set of states, one row per set; a set has 64 members at most."""
    sets = table(spark, d, "documents").filter("session_id IS NOT NULL AND hexagram_id IS NOT NULL").groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("hexagram_id")).cast("array<string>"), ",").alias("states"))
    return sets.groupBy("states").agg(F.count(F.lit(1)).alias("sessions"), F.min("session_id").alias("first_session"))


@query("SELECT profile_id, ingested_at, exp(-power(chaos - 0.5, 2) / (2 * power(0.2 / 2.35482, 2))) > 0.5 AS within, round(exp(-power(chaos - 0.5, 2) / (2 * power(0.2 / 2.35482, 2))), 6) AS kernel FROM emotional_weights WHERE chaos IS NOT NULL")
def gaussian_kernel(spark: SparkSession, d: str) -> DataFrame:
    """MX-03: a kernel of given width at half its height; without width it is equality."""
    k = kernel(F.col("chaos"), 0.5, 0.2)
    return table(spark, d, "emotional_weights").filter("chaos IS NOT NULL").select("profile_id", "ingested_at", (k > 0.5).alias("within"), rnd(k).alias("kernel"))


@query("""SELECT profile_id, ingested_at, 'state ' || CAST(hexagram_id AS VARCHAR) || ': chaos ' || printf('%.2f', floor(chaos * 100 + 0.5001) / 100) || ', coherence ' || printf('%.2f', floor(coherence * 100 + 0.5001) / 100) || CASE WHEN phase_temporal IS NULL THEN '' ELSE ' in ' || phase_temporal END AS summary FROM emotional_weights WHERE chaos IS NOT NULL AND coherence IS NOT NULL AND hexagram_id IS NOT NULL""")
def profile_summaries(spark: SparkSession, d: str) -> DataFrame:
    """TX-09: a profile as a sentence, with numbers of two digits."""
    two = lambda c: F.format_string("%.2f", rnd(c, 2))
    text = F.concat(F.lit("state "), F.col("hexagram_id").cast("string"), F.lit(": chaos "), two("chaos"), F.lit(", coherence "), two("coherence"), F.when(F.col("phase_temporal").isNull(), "").otherwise(F.concat(F.lit(" in "), F.col("phase_temporal"))))
    return table(spark, d, "emotional_weights").filter("chaos IS NOT NULL AND coherence IS NOT NULL AND hexagram_id IS NOT NULL").select("profile_id", "ingested_at", text.alias("summary"))


@query("""SELECT profile_id, ingested_at, round(sqrt(power(voiceweight - lag(voiceweight) OVER w, 2) + power(coherence - lag(coherence) OVER w, 2)), 6) AS velocity FROM (SELECT DISTINCT profile_id, ingested_at, session_id, voiceweight, coherence FROM emotional_weights) AS e WINDOW w AS (PARTITION BY session_id ORDER BY profile_id, ingested_at, voiceweight NULLS FIRST, coherence NULLS FIRST)""")
def profile_velocity(spark: SparkSession, d: str) -> DataFrame:
    """MX-38: how far voice and coherence move from one profile of a session to the next."""
    e = table(spark, d, "emotional_weights").select("profile_id", "ingested_at", "session_id", "voiceweight", "coherence").distinct()
    # Sessions may be large: their order is kept within ranges of profile ids, and the last row of the range before is carried.
    rows = sessions.in_order(e, "session_id", F.floor(F.col("profile_id") / 4096), ["profile_id", "ingested_at", "voiceweight", "coherence"], ["voiceweight", "coherence"])
    step = lambda c: F.pow(F.col(c) - F.get("before", 0)[c], 2)
    return rows.select("profile_id", "ingested_at", rnd(F.sqrt(step("voiceweight") + step("coherence"))).alias("velocity"))


_LISTED = {"logic": ["plan", "review", "route", "router", "check"], "tools": ["parser", "registry", "encoder", "index", "injector"], "people": ["teacher", "reader", "keeper", "voice"]}


@query("SELECT profile_id, ingested_at, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(trainingnotes), '{'|'.join(w)}') THEN '{k}' END" for k, w in _LISTED.items()) + ") AS branches FROM emotional_weights WHERE trainingnotes IS NOT NULL")
def note_branches(spark: SparkSession, d: str) -> DataFrame:
    """TX-15: the branches whose words a note has anywhere; the word lists are parameters."""
    t = F.lower("trainingnotes")
    return table(spark, d, "emotional_weights").filter("trainingnotes IS NOT NULL").select("profile_id", "ingested_at", F.concat_ws(",", *[F.when(F.greatest(*[t.contains(x) for x in w]), k) for k, w in _LISTED.items()]).alias("branches"))


_TAU = f"(SELECT *, 0.25 * ({' + '.join(AXES)}) + 0.25 * pn + 0.2 * 0.5 + 0.25 * ((abs(yin - yang) + abs(yang - yao) + abs(yao - yin)) / 6.0) + 0.1575 AS tau FROM {_E} AS e)"


@query(f"""WITH t AS (SELECT * FROM {_TAU} AS x), s AS (SELECT avg(tau) AS mu, greatest(1e-9, avg(CASE WHEN pn = 0 THEN 0.0875 ELSE pn END) / 2) AS sigma FROM t),
  w AS (SELECT t.id, t.phase, exp(-power(tau - mu, 2) / (2 * sigma * sigma)) AS w FROM t, s),
  v AS (SELECT l.id, l.position, CASE l.state WHEN 0 THEN 'yin' WHEN 1 THEN 'yang' ELSE 'yao' END AS family, sum(w.w) / (SELECT sum(w) FROM w) AS vote FROM {symbols.lines(symbols.space()).replace('{numbers}', DUCK.numbers(6))} AS l JOIN w ON w.id = l.id AND w.phase = l.phase GROUP BY 1, 2, 3)
  SELECT id, position, family, round(vote, 6) AS vote, 'old_' || family AS label, CASE WHEN row_number() OVER (PARTITION BY id, position ORDER BY round(vote, 6) DESC, family) = 1 THEN 1 ELSE 0 END AS wins FROM v""")
def line_vote_weighted(spark: SparkSession, d: str) -> DataFrame:
    """AG-14, AG-13, MX-04: votes of the line families for each line of each state, every phase by its Gaussian weight around the mean tau."""
    part = (F.abs(F.col("yin") - F.col("yang")) + F.abs(F.col("yang") - F.col("yao")) + F.abs(F.col("yao") - F.col("yin"))) / 6
    t = _resolved(spark).withColumn("tau", 0.25 * sum((F.col(a) for a in AXES[1:]), F.col(AXES[0])) + 0.25 * F.col("pn") + 0.2 * 0.5 + 0.25 * part + 0.1575)
    s = t.agg(F.avg("tau").alias("mu"), F.greatest(F.lit(1e-9), F.avg(or_default("pn", 0.0875)) / 2).alias("sigma"))
    w = t.join(F.broadcast(s)).select("id", "phase", F.exp(-F.pow(F.col("tau") - F.col("mu"), 2) / (2 * F.col("sigma") * F.col("sigma"))).alias("w"))
    lines = spark.sql(f"SELECT * FROM {symbols.lines(symbols.space()).replace('{numbers}', SPARK.numbers(6))} AS l").select("id", "phase", "position", F.element_at(F.array(F.lit("yin"), F.lit("yang"), F.lit("yao")), F.col("state") + 1).alias("family"))
    v = lines.join(w, ["id", "phase"]).groupBy("id", "position", "family").agg(F.sum("w").alias("w")).join(F.broadcast(w.agg(F.sum("w").alias("all"))))
    v = v.select("id", "position", "family", rnd(F.col("w") / F.col("all")).alias("vote"), F.concat(F.lit("old_"), F.col("family")).alias("label"))
    return v.withColumn("wins", (F.row_number().over(Window.partitionBy("id", "position").orderBy(F.desc("vote"), "family")) == 1).cast("int"))


@query(f"""SELECT s.slider, s.id AS winner, s.score, {', '.join(f'round(avg(e.{a}), 6) AS {a}' for a in AXES)}, round(avg(e.pn), 6) AS porosity FROM ({scoring.ORACLE['open_pool_consensus']}) AS s JOIN {_E} AS e ON e.id = s.id WHERE s.place = 1 GROUP BY s.slider, s.id, s.score""")
def open_pool_winner(spark: SparkSession, d: str) -> DataFrame:
    """AG-15, AG-16: the winner of every slider with its mean vector."""
    best = scoring.QUERIES["open_pool_consensus"](spark, d).filter("place = 1").select("slider", "id", "score")
    e = _resolved(spark).groupBy("id").agg(*[rnd(F.avg(a)).alias(a) for a in AXES], rnd(F.avg("pn")).alias("porosity"))
    return best.join(e, "id").select("slider", F.col("id").alias("winner"), "score", *AXES, "porosity")


#: The window of each porosity level.
WINDOWS = [(0.0, 0.05), (0.05, 0.2), (0.2, 0.5), (0.5, 0.8), (0.8, 1.0)]
_MID = "CASE e.porosity " + " ".join(f"WHEN {i} THEN {(a + b) / 2!r}" for i, (a, b) in enumerate(WINDOWS)) + " END"


@query(f"""SELECT e.id, e.phase, {', '.join(f'round(greatest(0.0, least(1.0, e.{a} + (r.p_{a} - e.{a}) * ({_MID}))), 6) AS {a}' for a in AXES)} FROM {_E} AS e JOIN {_RANKED} AS r ON r.id = e.id AND r.phase = e.phase AND r.place = 2""")
def porosity_bleed(spark: SparkSession, d: str) -> DataFrame:
    """MX-20: each state's vector moved toward its second pool by the middle of its porosity's window."""
    e = _resolved(spark)
    second = ranked_pools(e, ["id", "phase"], pools(_profiles(spark, d))).filter("place = 2").select("id", "phase", *[f"p_{a}" for a in AXES])
    t = F.lit(None).cast("double")
    for level, (low, high) in enumerate(WINDOWS):
        t = F.when(F.col("porosity") == level, middle(F.lit(low), F.lit(high))).otherwise(t)
    return e.join(second, ["id", "phase"]).select("id", "phase", *[rnd(lerp(a, f"p_{a}", t)).alias(a) for a in AXES])


@query(f"""WITH h AS (SELECT id, CASE WHEN length(replace(bits, '0', '')) >= 3 THEN 'yang' ELSE 'yin' END AS dominant, length(replace(bits, '0', '')) AS y FROM {T.states_sql()} AS s)
  SELECT a.id, a.dominant, CASE WHEN b.id IS NULL THEN NULL WHEN a.dominant = b.dominant THEN 'stays ' || a.dominant ELSE b.dominant || ' to ' || a.dominant END AS shift, a.y - b.y AS lines FROM h AS a LEFT JOIN h AS b ON b.id = a.id - 1""")
def sequence_shifts(spark: SparkSession, d: str) -> DataFrame:
    """WN-01: which family dominates each state, and how that shifts from the state before; 64 rows."""
    y = F.length(F.translate("bits", "0", ""))
    h = T.states(spark).select("id", F.when(y >= 3, "yang").otherwise("yin").alias("dominant"), y.alias("y"))
    w = Window.orderBy("id")
    was = F.lag("dominant").over(w)
    shift = F.when(was.isNull(), None).when(was == F.col("dominant"), F.concat(F.lit("stays "), "dominant")).otherwise(F.concat(was, F.lit(" to "), F.col("dominant")))
    return h.select("id", "dominant", shift.alias("shift"), (F.col("y") - F.lag("y").over(w)).alias("lines"))


@query("""SELECT profile_id, ingested_at, '[' || CASE WHEN coherence >= chaos THEN 'ORDER' ELSE 'DISORDER' END || '] ' || substr(trainingnotes, 1, 120) || CASE WHEN length(trainingnotes) > 120 THEN '…' ELSE '' END AS weave FROM emotional_weights WHERE trainingnotes IS NOT NULL AND chaos IS NOT NULL AND coherence IS NOT NULL""")
def profile_weaves(spark: SparkSession, d: str) -> DataFrame:
    """TX-19: a header by the stronger of two axes and the note's echo of up to 120 signs, which is the feature."""
    e = table(spark, d, "emotional_weights").filter("trainingnotes IS NOT NULL AND chaos IS NOT NULL AND coherence IS NOT NULL")
    head = F.when(F.col("coherence") >= F.col("chaos"), "[ORDER] ").otherwise("[DISORDER] ")
    return e.select("profile_id", "ingested_at", F.concat(head, F.left("trainingnotes", F.lit(120)), F.when(F.length("trainingnotes") > 120, "…").otherwise("")).alias("weave"))


@query(None)
def consensus_proof(spark: SparkSession, d: str) -> DataFrame:
    """consensus_proof: which states the documents agree on, and how many do."""
    return scoring.QUERIES["doc_consensus"](spark, d).groupBy("winner", "category", "action").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"))


ORACLE["consensus_proof"] = f"SELECT winner, category, action, count(*) AS documents, min(doc_id) AS first_doc FROM ({scoring.ORACLE['doc_consensus']}) AS c GROUP BY 1, 2, 3"
