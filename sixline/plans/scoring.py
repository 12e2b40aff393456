"""Expansion, consensus, decision matrix, temporal agreement and mechanics (inventory F-1..F-9, F-11..F-13, AG-*, SO-*).

The reference case is one question; here every distinct question of a table is one, and group keys
gain its key. A question's answer depends only on its intents (by their match with each kind of
state) and its length, so equal ones are answered once: the 512 states multiply the distinct
questions, never the rows of the table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sixline.plans.dialect import DUCK, SPARK, Dialect, even, shared
from sixline.plans.symbols import BASE, balance, space
from sixline.session import cut, table
from sixline.tables import AXES, INTENTS, PHASES, intents_sql, phases_sql, state_rows, states_sql, trigrams_sql

#: A word between ASCII white space, which the engines' own classes define differently.
WORD = r"[^ \t\n\r\f\x0B]+"
H, P, T = states_sql(), phases_sql(), trigrams_sql()
_COLUMNS = {"chaos": "chaos", "whimsy": "whimsy", "dark": "darktone", "coherence": "coherence", "voice": "voiceweight"}


def c(v: str, low: str = "0", high: str = "1") -> str:
    """Clamp."""
    return f"greatest(CAST({low} AS DOUBLE), least(CAST({high} AS DOUBLE), {v}))"


def lerp(a: str, b: str, t: str) -> str:
    """Interpolation, clamped."""
    return c(f"({a}) + (({b}) - ({a})) * ({t})")


def r4(v: str) -> str:
    """Four digits by one formula on both engines."""
    return f"round({v}, 4)"


def each(f) -> str:
    return ", ".join(f"{f(a)} AS {a}" for a in AXES)


def weights() -> str:
    """Axis weights of each state: means of the valid profiles, the parameter that stands for a fixed table."""
    valid = " AND ".join(f"{v} BETWEEN 0 AND 1" for v in _COLUMNS.values())
    return f"(SELECT hexagram_id AS id, {', '.join(f'{r4(f'avg({v})')} AS w_{a}' for a, v in _COLUMNS.items())} FROM (SELECT DISTINCT profile_id, hexagram_id, {', '.join(_COLUMNS.values())} FROM emotional_weights WHERE {valid}) AS v GROUP BY hexagram_id)"


#: The unit of the intent scores, in which all of them (1 / rank) are whole.
_UNIT = math.lcm(*range(1, 1 + max(len(words.split()) for words in INTENTS.values())))
_KNOWN = "array(" + ", ".join(f"'{w}'" for words in INTENTS.values() for w in words.split() if "_" not in w) + ")"


def intents(x: Dialect) -> str:
    """TX-04 over every document: intent scores by words, dominant intent, intensity, number of words.

    In Spark one projection: of a text's words only those of the intents are looked up in, and nothing
    is joined or moved. In DuckDB by joins with the table of words.
    """
    count = x.size(x.tokens("lower(text)", "[a-z0-9]+"))
    spaced = x.size(x.tokens("text", WORD))
    if x.spark:
        score = lambda words: "round((" + " + ".join(f"CASE WHEN array_contains(known, '{w}') THEN {_UNIT // r} ELSE 0 END" for r, w in enumerate(words.split(), 1) if "_" not in w) + f") / CAST({_UNIT} AS DOUBLE), 9)"
        known = f"(SELECT doc_id, {count} AS words, {spaced} AS spaced, array_intersect({x.tokens('lower(text)', '[a-z0-9]+')}, {_KNOWN}) AS known FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) AS d0)"
        return f"(SELECT doc_id, words, spaced, {', '.join(f'{score(w)} AS k_{k}' for k, w in INTENTS.items())} FROM {known} AS d1)"
    return f"""(SELECT d.doc_id, w.words, w.spaced, {', '.join(f"coalesce(s.k_{k}, CAST(0 AS DOUBLE)) AS k_{k}" for k in INTENTS)} FROM (SELECT doc_id FROM documents) AS d
      JOIN (SELECT doc_id, coalesce({count}, 0) AS words, coalesce({spaced}, 0) AS spaced FROM documents) AS w ON w.doc_id = d.doc_id
      LEFT JOIN (SELECT doc_id, {', '.join(f"coalesce(round(sum(CASE WHEN intent = '{k}' THEN score END), 9), CAST(0 AS DOUBLE)) AS k_{k}" for k in INTENTS)}
        FROM (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, {x.explode(x.tokens('lower(text)', '[a-z0-9]+'))} AS word FROM documents WHERE text IS NOT NULL) AS e) AS t
        JOIN {intents_sql()} AS i ON CAST(i.word AS VARCHAR) = t.word GROUP BY doc_id) AS s ON s.doc_id = d.doc_id)"""


_TOTAL = "(" + " + ".join(f"k_{k}" for k in INTENTS) + ")"


def _dominant() -> str:
    best = "greatest(" + ", ".join(f"k_{k}" for k in INTENTS) + ")"
    return f"CASE WHEN {best} = 0 THEN 'understand' " + " ".join(f"WHEN k_{k} = {best} THEN '{k}'" for k in INTENTS) + " END"


def _doc_intents(x: Dialect) -> str:
    return f"SELECT doc_id, words, least(1.0, spaced / CAST(50 AS DOUBLE)) AS intensity, {_dominant()} AS dominant, round({_TOTAL}, 6) AS total FROM {intents(x)} AS i"


def _seed(x: Dialect) -> str:
    """F-1: a seed vector of each document from its intents, scaled to sum 1."""
    n = lambda k: f"(CASE WHEN {_TOTAL} = 0 THEN 0 ELSE k_{k} / {_TOTAL} END)"
    part = lambda base, **k: c(f"{base} + " + " + ".join(f"{v} * {n(i)}" for i, v in k.items()))
    return f"""SELECT doc_id, round({part(0.1, conflict=0.4, destroy=0.3, transform=0.2)}, 6) AS chaos, round({part(0.1, explore=0.3, feel=0.3, heal=0.2)}, 6) AS whimsy,
      round({part(0.1, destroy=0.3, conflict=0.25)}, 6) AS dark, round({part(0.8, understand=0.15, focus=0.15, speak=0.1)}, 6) AS coherence,
      round({part(0.85, speak=0.15, protect=0.1, connect=0.1)}, 6) AS voice FROM {intents(x)} AS i"""


#: Pools of a state by its lines (mostly yao, yin, yang, balanced, other).
_POOLS = {"yao": (0.65, 0.35, 0.45, 0.35, 0.55), "yin": (0.15, 0.45, 0.08, 0.88, 0.82), "yang": (0.08, 0.08, 0.25, 0.97, 0.95), "even": (0.05, 0.2, 0.0, 0.95, 0.9), "other": (0.1, 0.25, 0.05, 0.9, 0.95)}


def _pool(x: Dialect) -> str:
    """PF-13: the pool of each state, by its lines in phase 0."""
    b = f"(SELECT * FROM {balance(x)} AS b0 WHERE phase = 0)"
    pick = lambda i: f"CAST(CASE WHEN yao > 1.8 THEN {_POOLS['yao'][i]} WHEN yin > 3.6 THEN {_POOLS['yin'][i]} WHEN yang > 3.6 THEN {_POOLS['yang'][i]} WHEN yin > 2.4 AND yang > 2.4 THEN {_POOLS['even'][i]} ELSE {_POOLS['other'][i]} END AS DOUBLE)"
    return f"(SELECT id, {', '.join(f'{pick(i)} AS p_{a}' for i, a in enumerate(AXES))} FROM {b} AS b1)"


#: The intents that a state's category and its action answer to (TX-06).
_CATEGORY_INTENTS = {"sovereign": "create speak protect focus", "transformer": "transform heal grow release", "dissipator": "destroy conflict release explore", "boundary": "understand focus protect connect"}
_ACTION_INTENTS = {"ASSERT": "create speak protect focus", "YIELD": "release heal connect listen", "ADAPT": "transform explore grow understand", "WAIT": "understand focus listen release"}
#: Category and action of each state.
_KINDS = sorted({(category, action) for _, _, category, action, _ in state_rows()})


def asked(x: Dialect) -> str:
    """TX-04, TX-06: doc_id and the question of every document: q_id, intensity and its match m_i with each kind of state.

    q_id is made of all that an answer depends on, so equal questions have equal ids. A match is counted
    in whole units; half of one where no intent matched, 0.3 where none of the kind's.
    """
    string = "STRING" if x.spark else "VARCHAR"
    scores = ", ".join("(" + " + ".join(f"CASE WHEN array_contains(tokens, '{w}') THEN {_UNIT // r} ELSE 0 END" for r, w in enumerate(words.split(), 1) if "_" not in w) + f") AS k_{k}" for k, words in INTENTS.items())
    either = [" + ".join(f"k_{k}" for k in (_CATEGORY_INTENTS[category] + " " + _ACTION_INTENTS[action]).split()) for category, action in _KINDS]
    match = ", ".join(f"CASE WHEN {_TOTAL} > 0 THEN CASE WHEN {s} > 0 THEN least({2 * _UNIT}, {s}) ELSE {2 * _UNIT * 3 // 10} END ELSE {_UNIT} END AS u_{i}" for i, s in enumerate(either))
    words = f"(SELECT doc_id, CAST(least(50, {x.size(x.tokens('text', WORD))}) AS INT) AS spaced, {x.tokens('lower(text)', '[a-z0-9]+')} AS tokens FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) AS d0)"
    # Only the intents' words are looked up in, a few of a text's.
    known = f"(SELECT doc_id, spaced, array_intersect(tokens, {_KNOWN}) AS tokens FROM {words} AS d1)"
    units = f"(SELECT doc_id, spaced, {match} FROM (SELECT doc_id, spaced, {scores} FROM {known} AS d2) AS d4)"
    ids = " || '.' || ".join(f"CAST({c_} AS {string})" for c_ in ("spaced", *(f"u_{i}" for i in range(len(_KINDS)))))
    return f"(SELECT doc_id, {ids} AS q_id, spaced / CAST(50 AS DOUBLE) AS intensity, {', '.join(f'u_{i} / CAST({2 * _UNIT} AS DOUBLE) AS m_{i}' for i in range(len(_KINDS)))} FROM {units} AS d3)"


#: Match of a question with a state, of the columns of :func:`asked`.
_MATCH = "CASE " + " ".join(f"WHEN category = '{category}' AND action = '{action}' THEN m_{i}" for i, (category, action) in enumerate(_KINDS)) + " END"


def stepped(x: Dialect, intensity: str = "q.intensity", questions: str = "(SELECT 0 AS q_id, CAST(0 AS DOUBLE) AS intensity)") -> str:
    """F-2..F-4 up to the intent match: 512 states for each question (q_id, intensity)."""
    old = "((old_yin + old_yang + old_yao) / CAST(6 AS DOUBLE))"
    yi, ya, yo = (f"(b.{k} / CAST(6 AS DOUBLE))" for k in ("yin", "yang", "yao"))
    line = {
        "chaos": c(f"0.5 * {yo} + 0.3 * {old} + 0.2 * abs({ya} - {yi})"),
        "whimsy": c(f"0.4 * {yi} + 0.3 * {yo} + 0.1 * {old}"),
        "dark": c(f"0.15 * old_yang + 0.2 * old_yao + 0.1 * {ya}"),
        "coherence": c(f"0.3 * {ya} + 0.3 * (1 - {yo}) - 0.1 * {old}"),
        "voice": c(f"0.3 * {ya} + 0.2 * (1 - {yo}) + 0.1 * old_yang"),
    }
    pool = _pool(x)
    # The pool of a state's neighbours in the ring, and the trigrams' vectors, are joined on ids of fixed ranges.
    base = f"""(SELECT q.q_id, s.id, s.phase, s.temporal, s.category, s.action, b.yin, b.yang, b.yao, b.changing, {', '.join(f's.s_{a}' for a in AXES)},
      {', '.join(f'{line[a]} AS l_{a}' for a in AXES)}, {', '.join(f"{lerp(f'u.t_{a}', f'lo.t_{a}', '0.5')} AS t_{a}" for a in AXES)},
      {', '.join(f"{lerp(f'pp.p_{a}', f'pn.p_{a}', '0.5')} AS n_{a}" for a in AXES)},
      least(4, CAST(floor({c(f'0.6 * {yo} + 0.3 * (b.changing / CAST(6 AS DOUBLE)) + 0.3 * {intensity}')} * 4 + 1e-9) AS INT)) AS porosity
      FROM {questions} AS q CROSS JOIN {space()} AS s JOIN {balance(x)} AS b ON b.id = s.id AND b.phase = s.phase
      JOIN {T} AS u ON u.idx = s.upper_idx JOIN {T} AS lo ON lo.idx = s.lower_idx
      JOIN {pool} AS pp ON pp.id = (s.id + 62) % 64 + 1 JOIN {pool} AS pn ON pn.id = s.id % 64 + 1)"""
    bleed = "(0.7 * porosity / CAST(4 AS DOUBLE))"
    e1 = {a: lerp(lerp(f"l_{a}", f"t_{a}", "0.3"), f"n_{a}", bleed) for a in AXES}
    return f"(SELECT *, {', '.join(f'{e1[a]} AS m_{a}' for a in AXES)} FROM {base} AS x0)"


def resolved(step: str, match: str = "0.5", more: str = "") -> str:
    """The end of F-4 over :func:`stepped`; an intent match of 0.5 stands for a question without intents."""
    im = dict(zip(AXES, (0.15, 0.15, 0.08, 0.08, 0.12)))
    e2 = {a: lerp(f"m_{a}", lerp(f"m_{a}", f"{match} * {im[a]}", "0.35"), "0.25") for a in AXES}
    return f"""(SELECT q_id, id, phase, temporal, category, action, yin, yang, yao, changing, porosity, porosity / CAST(4 AS DOUBLE) AS pn,
      {', '.join(f'{e2[a]} AS e_{a}' for a in AXES)}, {', '.join(f"{c(f'{e2[a]} + s_{a}')} AS {a}" for a in AXES)}{more} FROM {step} AS x1)"""


def expanded(x: Dialect, intensity: str = "q.intensity", questions: str = "(SELECT 0 AS q_id, CAST(0 AS DOUBLE) AS intensity)") -> str:
    """F-2..F-4: expanded and resolved vectors of 512 states for each question (q_id, intensity)."""
    return resolved(stepped(x, intensity, questions))


def _expand_64(x: Dialect) -> str:
    return f"SELECT id, porosity, yin, yang, yao, {', '.join(f'round(e_{a}, 6) AS {a}' for a in AXES)} FROM {expanded(x)} AS e WHERE phase = 0"


def _resolve_512(x: Dialect) -> str:
    return f"SELECT id, phase, porosity, {', '.join(f'round({a}, 6) AS {a}' for a in AXES)} FROM {expanded(x)} AS e"


def _tau(slider: str) -> str:
    return f"0.15 * ({' + '.join(AXES)}) + 0.1 * pn + 0.05 * ((abs(yin - yang) + abs(yang - yao) + abs(yao - yin)) / CAST(6 AS DOUBLE)) + (1 + {slider} * var_h) + 0.15 * w_voice + 0.55 * (0.5 + 2.5 * {slider})"


def _context(slider: str) -> tuple[str, str]:
    """A row's weight of its axes, and the preference for its temporal."""
    ctx = f"CASE WHEN yao > 2.4 THEN 0.3 * chaos + 0.3 * whimsy + 0.2 * dark + 0.1 * coherence + 0.1 * voice ELSE 0.1 * chaos + 0.1 * whimsy + 0.2 * dark + 0.3 * coherence + 0.3 * voice END"
    f = slider
    pref = f"CASE temporal WHEN 'past' THEN 1 - 0.8 * {f} WHEN 'present' THEN 1 - 0.5 * abs({f} - 0.5) WHEN 'future' THEN 0.8 * {f} WHEN 'transition' THEN 0.5 * {f} WHEN 'resolution' THEN 0.3 * (1 - {f}) WHEN 'dissolution' THEN 0.6 * {f} WHEN 'crystallization' THEN 0.7 * {f} ELSE 0.5 END"
    return ctx, pref


_SCORE = "(0.4 * ctx + 0.15 * (CASE WHEN pn = 0 THEN 0.35 ELSE pn END) + 0.1 * align + 0.05 * pref)"


def consensus(x: Dialect, questions: str, slider: str, states: str | None = None) -> str:
    """F-5 with each state scored once: tau, its mode as mu, gaussian weights, the winner by summed score.

    The vector is the weighted mean (``once``); its repeated blend toward a constant default, n times
    over n rows, has that constant as its limit and adds no information, so it is left to a parameter.
    """
    e = f"(SELECT e.*, w.w_voice FROM {states or expanded(x, questions=questions)} AS e JOIN {weights()} AS w ON w.id = e.id)"
    spread = f"""(SELECT q_id, id, ({' + '.join(f'power(avg({a}) - ({" + ".join(f"avg({b})" for b in AXES)}) / 5, 2)' for a in AXES)}) / 5 AS var_h FROM {e} AS e1 GROUP BY q_id, id)"""
    tau = _tau(slider)
    t = f"(SELECT e.*, {tau} AS tau, floor(({tau}) * 100 + 0.5 + 1e-7) AS tau2 FROM {e} AS e JOIN {spread} AS v ON v.q_id = e.q_id AND v.id = e.id)"
    mode = f"(SELECT q_id, tau2 / CAST(100 AS DOUBLE) AS mu FROM (SELECT q_id, tau2, row_number() OVER (PARTITION BY q_id ORDER BY count(*) DESC, min(id * 8 + phase)) AS rn FROM {t} AS t1 GROUP BY q_id, tau2) AS m WHERE rn = 1)"
    sigma = f"(SELECT q_id, greatest(1e-9, avg(CASE WHEN pn = 0 THEN 0.35 ELSE pn END) / 2) AS sigma FROM {t} AS t2 GROUP BY q_id)"
    ctx, pref = _context(slider)
    weighted = f"(SELECT t.*, mu, sigma, exp(-power(tau - mu, 2) / (2 * sigma * sigma)) AS w, ({ctx}) AS ctx, ({pref}) AS pref, CASE WHEN temporal = 'past' THEN 1.0 ELSE 0.5 END AS align FROM {t} AS t JOIN {mode} AS m ON m.q_id = t.q_id JOIN {sigma} AS s ON s.q_id = t.q_id)"
    weighted = weighted.replace("SELECT t.*, mu", "SELECT t.*, m.mu AS mu").replace(", sigma, exp", ", s.sigma AS sigma, exp").replace("power(tau - mu, 2) / (2 * sigma * sigma)", "power(tau - m.mu, 2) / (2 * s.sigma * s.sigma)")
    by_state = f"(SELECT q_id, id, sum({_SCORE} * w) AS score, sum(w) AS w, max(mu) AS mu, {', '.join(f'sum({a} * w) AS {a}' for a in AXES)} FROM {weighted} AS g GROUP BY q_id, id)"
    best = f"(SELECT q_id, id AS winner, score, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, id) AS rn FROM {by_state} AS bs)"
    whole = f"(SELECT q_id, max(mu) AS mu, sum(w) AS total, {', '.join(f'sum({a}) / sum(w) AS {a}' for a in AXES)} FROM {by_state} AS bw GROUP BY q_id)"
    return f"(SELECT b.q_id, b.winner, round(b.score / a.total, 6) AS score, round(a.mu, 6) AS mu, {', '.join(f'round(a.{x_}, 6) AS {x_}' for x_ in AXES)} FROM {best} AS b JOIN {whole} AS a ON a.q_id = b.q_id WHERE b.rn = 1)"


def answers(e: str, slider: str) -> str:
    """F-5 as :func:`consensus` has it, over resolved states with w_voice that are partitioned by q_id: no row is moved."""
    var = f"({' + '.join(f'power(avg({a}) OVER h - ({" + ".join(f"avg({b}) OVER h" for b in AXES)}) / 5, 2)' for a in AXES)}) / 5"
    t = f"(SELECT *, {_tau(slider)} AS tau FROM (SELECT *, {var} AS var_h FROM {e} AS e WINDOW h AS (PARTITION BY q_id, id)) AS v)"
    n = f"(SELECT *, count(*) OVER b AS n, min(id * 8 + phase) OVER b AS first FROM (SELECT *, floor(tau * 100 + 0.5 + 1e-7) AS tau2 FROM {t} AS t) AS t1 WINDOW b AS (PARTITION BY q_id, tau2))"
    m = f"(SELECT *, (max(struct(n, -first AS f, tau2)) OVER q).tau2 / CAST(100 AS DOUBLE) AS mu, greatest(1e-9, avg(CASE WHEN pn = 0 THEN 0.35 ELSE pn END) OVER q / 2) AS sigma FROM {n} AS n WINDOW q AS (PARTITION BY q_id))"
    ctx, pref = _context(slider)
    weighted = f"(SELECT *, exp(-power(tau - mu, 2) / (2 * sigma * sigma)) AS w, ({ctx}) AS ctx, ({pref}) AS pref, CASE WHEN temporal = 'past' THEN 1.0 ELSE 0.5 END AS align FROM {m} AS m)"
    by_state = f"(SELECT q_id, id, sum({_SCORE} * w) AS score, sum(w) AS w, max(mu) AS mu, {', '.join(f'sum({a} * w) AS {a}' for a in AXES)} FROM {weighted} AS g GROUP BY q_id, id)"
    whole = f"(SELECT q_id, max(struct(round(score, 9) AS r, -id AS i, score)) AS best, max(mu) AS mu, sum(w) AS total, {', '.join(f'sum({a}) / sum(w) AS {a}' for a in AXES)} FROM {by_state} AS s GROUP BY q_id)"
    return f"(SELECT q_id, -best.i AS winner, round(best.score / total, 6) AS score, round(mu, 6) AS mu, {', '.join(f'round({a}, 6) AS {a}' for a in AXES)} FROM {whole} AS w)"


def doc_consensus(spark: SparkSession, d: str) -> DataFrame:
    """F-1..F-5: the consensus of each document's question, by its length and its intents."""
    for t in ("documents", "emotional_weights"):
        table(spark, d, t).createOrReplaceTempView(t)
    asked_ = cut(spark.sql(f"SELECT * FROM {asked(SPARK)} AS a"))
    each = asked_.groupBy("q_id").agg(*[F.max(k).alias(k) for k in asked_.columns if k not in ("doc_id", "q_id")])
    # Fixed sizes: at most 51 lengths, each with 512 states, so the join with them is always a broadcast.
    asked_.select(F.round(F.col("intensity") * 50).cast("int").alias("q_id"), "intensity").distinct().createOrReplaceTempView("asked_lengths")
    fixed = cut(spark.sql(even(f"SELECT s.*, w.w_voice FROM {stepped(SPARK, questions='asked_lengths')} AS s JOIN {weights()} AS w ON w.id = s.id")).withColumnRenamed("q_id", "spaced"))
    rows = each.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "q_id").withColumn("spaced", F.round(F.col("intensity") * 50).cast("int"))
    rows.join(F.broadcast(fixed), "spaced").createOrReplaceTempView("asked_states")
    asked_.createOrReplaceTempView("asked_documents")
    found = answers(resolved("asked_states", _MATCH, ", w_voice"), "0.5")
    return spark.sql(even(f"SELECT d.doc_id, r.winner, h.category, h.action, r.score, r.mu, {', '.join(f'r.{a}' for a in AXES)} FROM asked_documents AS d JOIN {found} AS r ON r.q_id = d.q_id JOIN {H} AS h ON h.id = r.winner"))


def _asked_sql() -> str:
    """The questions of all documents in DuckDB, from the joined intent scores: q_id, intensity and m_i, apart from :func:`asked`."""
    total = "(" + " + ".join(f"k_{k}" for k in INTENTS) + ")"
    half = lambda category, action: "(" + " + ".join(f"k_{k}" for k in (_CATEGORY_INTENTS[category] + " " + _ACTION_INTENTS[action]).split()) + ") / 2"
    match = ", ".join(f"CASE WHEN {total} = 0 THEN 0.5 WHEN {half(*kind)} = 0 THEN 0.3 ELSE least(1.0, {half(*kind)}) END AS m_{i}" for i, kind in enumerate(_KINDS))
    units = " || '.' || ".join(f"CAST(CAST(round(m_{i} * {2 * _UNIT}) AS BIGINT) AS VARCHAR)" for i in range(len(_KINDS)))
    return f"SELECT doc_id, CAST(spaced AS VARCHAR) || '.' || {units} AS q_id, spaced / CAST(50 AS DOUBLE) AS intensity, {', '.join(f'm_{i}' for i in range(len(_KINDS)))} FROM (SELECT doc_id, least(50, spaced) AS spaced, {match} FROM {even(intents(DUCK))} AS i) AS m"


def _with_questions(sql: str) -> str:
    ms = ", ".join(f"max(m_{i}) AS m_{i}" for i in range(len(_KINDS)))
    return f"WITH asked AS MATERIALIZED ({_asked_sql()}), q AS MATERIALIZED (SELECT q_id, max(intensity) AS intensity, {ms} FROM asked GROUP BY q_id), st AS MATERIALIZED ({even(_answer_states())}) {even(sql)}"


def _answer_states() -> str:
    step = f"(SELECT s.*, {', '.join(f'q.m_{i} AS mm_{i}' for i in range(len(_KINDS)))} FROM {stepped(DUCK, questions='q')} AS s JOIN q ON q.q_id = s.q_id)"
    match = "CASE " + " ".join(f"WHEN category = '{category}' AND action = '{action}' THEN mm_{i}" for i, (category, action) in enumerate(_KINDS)) + " END"
    return f"SELECT * FROM {resolved(step, match)} AS r"


def _consensus_sql() -> str:
    return _with_questions(f"SELECT d.doc_id, r.winner, h.category, h.action, r.score, r.mu, {', '.join(f'r.{a}' for a in AXES)} FROM asked AS d JOIN {consensus(DUCK, 'q', '0.5', 'st')} AS r ON r.q_id = d.q_id JOIN {H} AS h ON h.id = r.winner")


def _question_states(spark: SparkSession, d: str) -> DataFrame:
    """The 512 resolved states of every distinct question of the documents."""
    table(spark, d, "documents").createOrReplaceTempView("documents")
    asked_ = spark.sql(f"SELECT * FROM {asked(SPARK)} AS a")
    each = asked_.groupBy("q_id").agg(*[F.max(k).alias(k) for k in asked_.columns if k not in ("doc_id", "q_id")]).withColumn("spaced", F.round(F.col("intensity") * 50).cast("int"))
    # Fixed sizes: 51 lengths, each with 512 states.
    lengths = spark.range(51).select(F.col("id").cast("int").alias("q_id"), (F.col("id") / 50).alias("intensity"))
    lengths.createOrReplaceTempView("all_lengths")
    fixed = spark.sql(even(f"SELECT * FROM {stepped(SPARK, questions='all_lengths')} AS s")).withColumnRenamed("q_id", "spaced")
    each.join(F.broadcast(fixed), "spaced").createOrReplaceTempView("question_states")
    return spark.sql(even(f"SELECT * FROM {resolved('question_states', _MATCH)} AS r"))


def doc_expand_64(spark: SparkSession, d: str) -> DataFrame:
    """F-2..F-4 in phase 0 for every distinct question of the documents."""
    return _question_states(spark, d).filter("phase = 0").select("q_id", "id", "porosity", *[_r6(f"e_{a}").alias(a) for a in AXES])


def doc_resolve_512(spark: SparkSession, d: str) -> DataFrame:
    """F-2..F-4 for every distinct question of the documents."""
    return _question_states(spark, d).select("q_id", "id", "phase", "porosity", *[_r6(a).alias(a) for a in AXES])


def _r6(c_: str):
    return F.expr(even(f"round({c_}, 6)"))


def _sliders(x: Dialect) -> str:
    return f"(SELECT i * 10 AS slider, i / CAST(10 AS DOUBLE) AS s FROM {x.numbers(11)} AS n)"


def _one(x: Dialect) -> str:
    """The 512 states at no intensity with their weights, for every slider of the grid."""
    return f"(SELECT e.*, sl.slider, sl.s, {', '.join(f'w.w_{a}' for a in AXES)} FROM {expanded(x)} AS e JOIN {weights()} AS w ON w.id = e.id CROSS JOIN {_sliders(x)} AS sl)"


def _open_pool(x: Dialect) -> str:
    """F-6: mean tau as centre, weights by distance from it."""
    b = "((abs(yin - yang) + abs(yang - yao) + abs(yao - yin)) / CAST(6 AS DOUBLE))"
    t = f"(SELECT *, 0.25 * ({' + '.join(AXES)}) + 0.25 * pn + 0.2 * s + 0.15 * w_voice + 0.25 * {b} + 0.1575 AS tau FROM {_one(x)} AS o)"
    st = f"(SELECT slider, avg(tau) AS mu, greatest(1e-9, avg(CASE WHEN pn = 0 THEN 0.0875 ELSE pn END) / 2) AS sigma FROM {t} AS t0 GROUP BY slider)"
    sc = f"(SELECT t.slider, t.id, sum((({' + '.join(AXES)}) + 0.5 * 0.3) * exp(-power(tau - mu, 2) / (2 * sigma * sigma))) AS score FROM {t} AS t JOIN {st} AS st ON st.slider = t.slider GROUP BY t.slider, t.id)"
    return f"SELECT slider, id, round(score, 6) AS score, row_number() OVER (PARTITION BY slider ORDER BY round(score, 6) DESC, id) AS place FROM {sc} AS sc"


def _decision(x: Dialect) -> str:
    """F-7: six axes, weighted, summed by state."""
    mean = lambda p: "(" + " + ".join(f"{p}{a}" for a in AXES) + ") / 5"
    L = "(0.5 * abs(yin - yang) / CAST(6 AS DOUBLE) + 0.3 * yao / CAST(6 AS DOUBLE) + 0.2 * changing / CAST(6 AS DOUBLE))"
    w = weights()
    near = f"(SELECT a.id, (({mean('p.w_')}) + ({mean('n.w_')})) / 2 AS around FROM {w} AS a JOIN {w} AS p ON p.id = (a.id + 62) % 64 + 1 JOIN {w} AS n ON n.id = a.id % 64 + 1)"
    line = c("(0.25 * yin + 0.25 * yang + 0.35 * yao + 0.15 * changing) / CAST(6 AS DOUBLE)")
    poro = c("(pn - (0.05 + 0.25 * s)) / greatest(1e-9, 0.5 + 0.2 * s)")
    cat = "CASE category WHEN 'sovereign' THEN 1.0 WHEN 'boundary' THEN 0.85 WHEN 'transformer' THEN 0.75 WHEN 'dissipator' THEN 0.6 ELSE 0.5 END"
    act = "CASE action WHEN 'ASSERT' THEN 1.0 WHEN 'YIELD' THEN 0.8 WHEN 'ADAPT' THEN 0.9 WHEN 'WAIT' THEN 0.7 ELSE 0.5 END"
    total = c(f"0.35 * {line} + 0.2 * {poro} + 0.15 * {c(f'1 - abs({mean("")} - around)')} + 0.15 * {c('(' + ' + '.join(AXES) + f') - {L}')} + 0.1 * {c(f'(({cat}) + ({act}) + 0.5) * CAST(1 AS DOUBLE) / 3')} + 0.05 * {c('w_voice * s')}")
    return f"SELECT slider, o.id AS id, round(sum({total}), 6) AS score, {', '.join(f'round(avg({a}), 6) AS {a}' for a in AXES)}, round(avg(pn), 6) AS porosity FROM {_one(x)} AS o JOIN {near} AS nb ON nb.id = o.id GROUP BY slider, o.id"


def _debug_scores(x: Dialect) -> str:
    """F-9, SO-02: composition match by state, best twelve for every slider."""
    y = lambda k: f"({k} / CAST(6 AS DOUBLE))"
    match = c(f"1 - (0.5 * abs({y('yin')} - (1 - s)) + 0.5 * abs({y('yang')} - s) + abs({y('yao')} - 0.25))")
    mean = "(" + " + ".join(f"w_{a}" for a in AXES) + ") / 5"
    return f"SELECT slider, id, place, score FROM (SELECT slider, id, round(score, 6) AS score, row_number() OVER (PARTITION BY slider ORDER BY round(score, 6) DESC, id) AS place FROM (SELECT slider, id, sum(({mean}) * (0.3 + 0.7 * {match}) * (0.5 + 0.5 * pn) * (0.3 + 0.7 * s) / 512) AS score FROM {_one(x)} AS o GROUP BY slider, id) AS a) AS b WHERE place <= 12"


def _slider_selection(x: Dialect) -> str:
    """F-12, SO-03: best eight for every slider and the ninth as borderline; slider 0 counts as 50."""
    s = "(CASE WHEN s = 0 THEN 0.5 ELSE s END)"
    stab = c("((yin + yang) / CAST(6 AS DOUBLE)) / 3")
    yo = "(yao / CAST(6 AS DOUBLE))"
    ca = c(f"{s} * {yo} + (1 - {s}) * {stab}")
    mean = "(" + " + ".join(f"w_{a}" for a in AXES) + ") / 5"
    score = f"({mean}) * (0.2 + 0.8 * pn) * (0.35 + 0.65 * {ca}) * (0.25 + 0.75 * {c(f'{yo} + 0.25 * pn')})"
    return f"SELECT slider, id, place, score, CASE WHEN place = 9 THEN 1 ELSE 0 END AS borderline FROM (SELECT slider, id, round(score, 6) AS score, row_number() OVER (PARTITION BY slider ORDER BY round(score, 6) DESC, id) AS place FROM (SELECT slider, id, max({score}) AS score FROM {_one(x)} AS o GROUP BY slider, id) AS a) AS b WHERE place <= 9"


def _anchors(x: Dialect) -> str:
    return f"SELECT id, temporal, round({' + '.join(AXES)}, 6) AS total FROM {expanded(x)} AS e ORDER BY total DESC, id DESC, temporal DESC LIMIT 5"


def _line_vote(x: Dialect) -> str:
    """AG-14: per line position and question, the family with the most votes."""
    from sixline.plans.symbols import lines

    q = lines(space()).replace("{numbers}", x.numbers(6))
    vote = f"(SELECT w.source, l.position, CASE l.state WHEN 0 THEN 'yin' WHEN 1 THEN 'yang' ELSE 'yao' END AS family, sum(w.n) AS votes FROM {q} AS l JOIN (SELECT source, hexagram_id AS id, count(*) AS n FROM documents WHERE hexagram_id IS NOT NULL GROUP BY source, hexagram_id) AS w ON w.id = l.id GROUP BY w.source, l.position, CASE l.state WHEN 0 THEN 'yin' WHEN 1 THEN 'yang' ELSE 'yao' END)"
    return f"SELECT source, position, family, CAST(votes AS BIGINT) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY source, position ORDER BY votes DESC, family) AS rn FROM {vote} AS v) AS r WHERE rn = 1"


def _temporal(x: Dialect) -> str:
    """F-11: three temporal vectors of each state, their agreement, winner and trajectory."""
    bal = f"(SELECT * FROM {balance(x)} AS b WHERE phase = 0)"
    bias = {"past": "0.5 * (w_dark + w_coherence) / 2", "present": "0.5 * (w_coherence + w_voice) / 2", "future": "0.5 * (w_chaos + w_whimsy) / 2"}
    raw = {"past": f"{bias['past']} + 0.3 * t_dark + 0.2 * (yin / CAST(6 AS DOUBLE))", "present": f"{bias['present']} + 0.3 * t_coherence + 0.2 * (yang / CAST(6 AS DOUBLE))", "future": f"{bias['future']} + 0.3 * t_whimsy + 0.2 * (yao / CAST(6 AS DOUBLE))"}
    base = f"(SELECT h.id, {', '.join(f'w.w_{a}' for a in AXES)}, {', '.join(f'({raw[t]}) AS r_{t}' for t in raw)} FROM {BASE} AS h JOIN {weights()} AS w ON w.id = h.id JOIN {T} AS u ON u.idx = h.upper_idx JOIN {bal} AS b ON b.id = h.id)"
    norm = f"(SELECT *, {', '.join(f'r_{t} / (r_past + r_present + r_future + 1e-9) AS b_{t}' for t in raw)}, CASE WHEN w_coherence + w_voice <= 1e-6 THEN 0.40 ELSE {c('0.15 + 0.25 * (w_chaos + w_whimsy) / (w_coherence + w_voice)', '0.15', '0.40')} END AS scale FROM {base} AS n0)"
    shift = {p: s for _, p, _, s in PHASES if p in raw}
    vec = lambda t, i, a: c(f"w_{a} + greatest(0, {shift[t][i]} + {f'(b_{t} - 1 / CAST(3 AS DOUBLE))' if i < 3 else '((b_past + b_present + b_future) / 3 - 1 / CAST(3 AS DOUBLE))'} * scale)")
    v = f"(SELECT id, {', '.join(f'b_{t}' for t in raw)}, {', '.join(f'{vec(t, i, a)} AS {t}_{a}' for t in raw for i, a in enumerate(AXES))} FROM {norm} AS n1)"
    dist = lambda p, q: "sqrt(" + " + ".join(f"power({p}_{a} - {q}_{a}, 2)" for a in AXES) + ")"
    d = f"(SELECT id, {', '.join(f'b_{t}' for t in raw)}, {dist('past', 'present')} AS d1, {dist('present', 'future')} AS d2, {dist('past', 'future')} AS d3, {', '.join(f'greatest({', '.join(f'{t}_{a}' for a in AXES)}) - least({', '.join(f'{t}_{a}' for a in AXES)}) AS spread_{t}' for t in raw)} FROM {v} AS v0)"
    score = {t: f"round(spread_{t} - b_{t}, 9)" for t in raw}
    best = "least(" + ", ".join(score.values()) + ")"
    return f"""(SELECT id, round({c('1 - ((d1 + d2 + d3) / 3) / (sqrt(5) * 3)')}, 6) AS agreement, CASE {' '.join(f"WHEN {score[t]} = {best} THEN '{t}'" for t in raw)} END AS winner,
      CASE WHEN d1 < 1e-6 AND d2 < 1e-6 THEN 'still' WHEN d2 < d1 - 1e-9 THEN 'converging' WHEN d2 > d1 + 1e-9 THEN 'diverging' ELSE 'cycling' END AS trajectory FROM {d} AS d0)"""


def _temporal_winners(x: Dialect) -> str:
    return f"SELECT * FROM {_temporal(x)} AS t"


def _temporal_global(x: Dialect) -> str:
    return f"SELECT winner, count(*) AS states, round(avg(agreement), 6) AS mean_agreement, min(agreement) AS least_agreement, max(agreement) AS most_agreement FROM {_temporal(x)} AS t GROUP BY winner"


def _mechanics(x: Dialect) -> str:
    """F-8: six mechanics of each state and slider, from line families, porosity, name sums and place."""
    spin = x.fold("name", "0", lambda h, k: f"{h} + {k}")
    b = f"(SELECT id, yin, yang, yao FROM {balance(x)} AS b0 WHERE phase = 1)"
    base = f"""(SELECT h.id, sl.slider, length(u.tname) AS ul, length(l.tname) AS ll, b.yin, b.yang, b.yao, sl.s, ({spin}) % 360 / CAST(360 AS DOUBLE) AS am, least(4, CAST(floor(4 * b.yao / CAST(6 AS DOUBLE)) AS INT)) / CAST(4 AS DOUBLE) AS por
      FROM {BASE} AS h JOIN {T} AS u ON u.idx = h.upper_idx JOIN {T} AS l ON l.idx = h.lower_idx JOIN {b} AS b ON b.id = h.id CROSS JOIN {_sliders(x)} AS sl)"""
    cf = c("(4 - ul + ll) / CAST(8 AS DOUBLE)")
    vs = c("am * (0.5 + 0.5 * por) * (0.5 + s / 2)")
    res = "exp(-power(abs(100 * por + 50 * s - 4) / 100, 2) / 0.18)"
    att, rep = "2 * least(yin, yang)", "CAST(1.5 AS DOUBLE) * yao"
    total = f"greatest(1, {att} + {rep})"
    mv = c(f"({att} + {rep}) / 6")
    bv = c("1.3 * least(1, power(por, 1.5))")
    egg = c("1 - 0.6 * abs(id - CAST(33.5 AS DOUBLE)) / CAST(33.5 AS DOUBLE)")
    return f"""SELECT id, slider, round({c(f'0.3 * {cf} + 0.3 * {vs} + 0.2 * ({rep}) / {total}')}, 6) AS chaos, round({c(f'0.4 * {cf} + 0.2 * {vs} + 0.3 * {mv}')}, 6) AS whimsy,
      round({c(f'0.4 * {bv} + 0.3 * ({rep}) / {total}')}, 6) AS dark, round({c(f'0.5 * {res} + 0.3 * {cf} + 0.2 * ({att}) / {total}')}, 6) AS coherence, round({c(f'0.4 * {egg} + 0.3 * {vs} + 0.3 * {res}')}, 6) AS voice FROM {base} AS m"""


def _personality(x: Dialect) -> str:
    """AG-19: shares of bits and trigrams over the session's profiles."""
    return f"""SELECT e.session_id, u.tname AS upper_name, count(*) AS profiles, round(sum(e.voiceweight), 4) AS magnitude, round(avg({'CAST(substr(b.bits, 1, 1) AS INT)'}), 6) AS first_line
      FROM (SELECT DISTINCT profile_id, session_id, hexagram_id, voiceweight FROM emotional_weights) AS e JOIN {BASE} AS b ON b.id = e.hexagram_id JOIN {T} AS u ON u.idx = b.upper_idx GROUP BY e.session_id, u.tname"""


def _voice_rank(x: Dialect) -> str:
    """WN-08, MX-08: the phases' mean vectors as pools, ranked for every state by cosine."""
    valid = " AND ".join(f"{v} BETWEEN 0 AND 1" for v in _COLUMNS.values())
    pool = f"(SELECT phase_temporal AS pool, {', '.join(f'{r4(f'avg({v})')} AS p_{a}' for a, v in _COLUMNS.items())} FROM emotional_weights WHERE phase_temporal IS NOT NULL AND {valid} GROUP BY phase_temporal)"
    dot = " + ".join(f"w_{a} * p_{a}" for a in AXES)
    n = lambda p: "sqrt(" + " + ".join(f"{p}_{a} * {p}_{a}" for a in AXES) + ")"
    return f"SELECT id, pool, similarity, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, pool) AS place FROM (SELECT id, pool, round(CASE WHEN {n('w')} * {n('p')} = 0 THEN 0 ELSE ({dot}) / ({n('w')} * {n('p')}) END, 6) AS similarity FROM {weights()} AS w CROSS JOIN {pool} AS p) AS s"


def _pool_mean_std(x: Dialect) -> str:
    """AG-02, AG-03: mean and population deviation by state and phase."""
    rows = "(SELECT DISTINCT profile_id, hexagram_id, phase_temporal, chaos, whimsy, darktone, coherence, voiceweight FROM emotional_weights)"
    return f"SELECT hexagram_id, phase_temporal, count(*) AS records, {', '.join(f'round(avg({v}), 5) AS mean_{a}, round(stddev_pop({v}), 5) AS std_{a}' for a, v in _COLUMNS.items())} FROM {rows} AS r GROUP BY hexagram_id, phase_temporal"


def _state_summary(x: Dialect) -> str:
    """AG-04, AG-05, JN-12: records and phases of each of the 64 states, those without any included."""
    return f"SELECT h.id, h.name, count(e.profile_id) AS records, count(DISTINCT e.phase_temporal) AS phases, count(DISTINCT e.session_id) AS sessions FROM {H} AS h LEFT JOIN emotional_weights AS e ON e.hexagram_id = h.id GROUP BY h.id, h.name"


def _coverage(x: Dialect) -> str:
    """AG-20: coverage and spread by session."""
    return f"SELECT session_id, count(DISTINCT hexagram_id) / CAST(64 AS DOUBLE) AS state_coverage, count(DISTINCT phase_temporal) AS phases, {', '.join(f'max({v}) - min({v}) AS range_{a}' for a, v in _COLUMNS.items())} FROM emotional_weights GROUP BY session_id"


def _dominant_axis(x: Dialect) -> str:
    """SO-06, TX-08, MX-40: the first axis of the greatest value, the intent text and the vector's norm."""
    g = "greatest(" + ", ".join(_COLUMNS.values()) + ")"
    cols = " AND ".join(f"{v} IS NOT NULL" for v in _COLUMNS.values())
    words = [("chaos", 0.7, "chaotic"), ("whimsy", 0.7, "playful"), ("darktone", 0.6, "grave"), ("coherence", 0.6, "focused"), ("voiceweight", 0.6, "authoritative")]
    text = " || ".join(f"CASE WHEN {v} > {t} THEN '{w}; ' ELSE '' END" for v, t, w in words)
    return f"SELECT profile_id, ingested_at, CASE {' '.join(f"WHEN {v} = {g} THEN '{a}'" for a, v in _COLUMNS.items())} END AS dominant, {text} AS intent, round(sqrt({' + '.join(f'{v} * {v}' for v in _COLUMNS.values())}), 6) AS norm FROM emotional_weights WHERE {cols}"


_E, _D = ("emotional_weights",), ("documents",)
_SQL = {
    "doc_intents": (_doc_intents, _D),
    "doc_seed_vectors": (_seed, _D),
    "expand_64": (_expand_64, ()),
    "resolve_512": (_resolve_512, ()),
    "open_pool_consensus": (_open_pool, _E),
    "decision_matrix": (_decision, _E),
    "debug_hex_scores_top12": (_debug_scores, _E),
    "slider_selection_top8": (_slider_selection, _E),
    "anchors_top5": (_anchors, ()),
    "weighted_line_vote": (_line_vote, _D),
    "temporal_winners": (_temporal_winners, _E),
    "temporal_global": (_temporal_global, _E),
    "mechanics_vector": (_mechanics, ()),
    "personality_distribution": (_personality, _E),
    "voice_pool_rank": (_voice_rank, _E),
    "pool_mean_std": (_pool_mean_std, _E),
    "state_summary": (_state_summary, _E),
    "superposition_coverage": (_coverage, _E),
    "dominant_axis": (_dominant_axis, _E),
}
_BUILT = {name: shared(text, tables) for name, (text, tables) in _SQL.items()}


def _weighted(text, tables: tuple[str, ...]):
    """The Spark side of a query that uses the state weights: their 64 rows are made once, not at each place that reads them."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        for t in tables:
            table(spark, d, t).createOrReplaceTempView(t)
        cut(spark.sql(even(f"SELECT * FROM {weights()} AS w"))).createOrReplaceTempView("state_weights")
        return spark.sql(even(text(SPARK)).replace(even(weights()), "(SELECT * FROM state_weights)"))

    return run


_BUILT |= {name: (_weighted(text, tables), _BUILT[name][1]) for name, (text, tables) in _SQL.items() if weights() in text(SPARK)}
QUERIES = {name: run for name, (run, _) in _BUILT.items()} | {f.__name__: f for f in (doc_consensus, doc_expand_64, doc_resolve_512)}
ORACLE = {name: sql for name, (_, sql) in _BUILT.items()} | {
    "doc_consensus": _consensus_sql(),
    "doc_expand_64": _with_questions(f"SELECT q_id, id, porosity, {', '.join(f'round(e_{a}, 6) AS {a}' for a in AXES)} FROM st WHERE phase = 0"),
    "doc_resolve_512": _with_questions(f"SELECT q_id, id, phase, porosity, {', '.join(f'round({a}, 6) AS {a}' for a in AXES)} FROM st"),
}
