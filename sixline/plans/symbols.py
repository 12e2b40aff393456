"""State spaces, encodings, graphs and hashes (inventory SC-01..21, PF-01..08, JN-01..09, HS-*, MX-10..41)."""

from __future__ import annotations

from sixline.plans.dialect import Dialect, shared
from sixline.tables import AXES, phases_sql, states_sql, trigrams_sql, values

H, P, T = states_sql(), phases_sql(), trigrams_sql()


def bit(n: str, i: int | str) -> str:
    return f"(CAST(floor(({n}) / power(2, {i})) AS BIGINT) % 2)"


def changing(phase: str, line: str) -> str:
    """1 if a phase changes a line (1..6): each phase bit changes a line and the one three above it."""
    return f"(CAST(floor({phase} / power(2, ({line} - 1) % 3)) AS BIGINT) % 2)"


#: Coordinates of a state from its bits, read from top to bottom: upper and lower trigram.
UPPER = "(4 * CAST(substr(reverse(bits), 1, 1) AS INT) + 2 * CAST(substr(reverse(bits), 2, 1) AS INT) + CAST(substr(reverse(bits), 3, 1) AS INT))"
LOWER = "(4 * CAST(substr(reverse(bits), 4, 1) AS INT) + 2 * CAST(substr(reverse(bits), 5, 1) AS INT) + CAST(substr(reverse(bits), 6, 1) AS INT))"
BASE = f"(SELECT *, {UPPER} AS upper_idx, {LOWER} AS lower_idx FROM {H} AS h)"


def space(where: str = "") -> str:
    """The 512 states: 64 states by 8 phases, with code and ternary lines."""
    lines = " || ".join(f"CASE WHEN {changing('phase', str(i))} = 1 THEN '2' ELSE substr(reverse(bits), {i}, 1) END" for i in range(1, 7))
    return f"""(SELECT id, name, bits, category, action, upper_idx, lower_idx, phase, temporal, polarity, {", ".join("s_" + a for a in AXES)},
      (upper_idx * 8 + lower_idx) * 8 + phase AS code, {lines} AS ternary FROM {BASE} AS b CROSS JOIN {P} AS p {where})"""


def _count(s: str, c: str) -> str:
    return f"(length({s}) - length(replace({s}, '{c}', '')))"


def lines(space_sql: str) -> str:
    """One row per state, phase and line 1..6 in the bottom-to-top order, with ternary state and yao key."""
    state = f"CASE WHEN {changing('phase', '(n.i + 1)')} = 1 THEN 2 ELSE CAST(substr(bits, n.i + 1, 1) AS INT) END"
    return f"""(SELECT *, CASE state WHEN 0 THEN CASE temporal WHEN 'past' THEN 'old_yin' WHEN 'present' THEN 'stable_yin' ELSE 'young_yin' END
      WHEN 1 THEN CASE temporal WHEN 'past' THEN 'old_yang' WHEN 'present' THEN 'stable_yang' ELSE 'new_yang' END
      ELSE CASE WHEN temporal IN ('present', 'crystallization') THEN 'stable_yao' WHEN temporal IN ('future', 'transition') THEN 'new_yao' ELSE 'old_yao' END END AS yao_key
      FROM (SELECT s.*, n.i + 1 AS position, {state} AS state, {changing('phase', '(n.i + 1)')} AS is_changing FROM {space_sql} AS s CROSS JOIN {{numbers}} AS n) AS l)"""


def balance(x: Dialect, space_sql: str | None = None) -> str:
    """AG-01: counts of lines by family, per state and phase."""
    return f"""(SELECT id, phase, temporal, CAST(sum(CASE WHEN state = 0 THEN 1 ELSE 0 END) AS BIGINT) AS yin, CAST(sum(CASE WHEN state = 1 THEN 1 ELSE 0 END) AS BIGINT) AS yang,
      CAST(sum(CASE WHEN state = 2 THEN 1 ELSE 0 END) AS BIGINT) AS yao, CAST(sum(is_changing) AS BIGINT) AS changing,
      {", ".join(f"CAST(sum(CASE WHEN yao_key = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS {k}" for k in ("young_yin", "old_yin", "stable_yin", "new_yao", "old_yao", "stable_yao", "old_yang", "new_yang", "stable_yang"))}
      FROM {lines(space_sql or space()).replace("{numbers}", x.numbers(6))} AS a GROUP BY id, phase, temporal)"""


def _state_space(x: Dialect) -> str:
    return f"SELECT id, name, category, action, phase, temporal, polarity, code, ternary, replace(ternary, '2', '0') AS transformed, {_count('ternary', '2')} AS yao FROM {space()} AS s"


def _reachable(x: Dialect) -> str:
    return f"SELECT ternary, count(*) AS states, min(code) AS first_code FROM {space()} AS s GROUP BY ternary"


def _roundtrip(x: Dialect) -> str:
    return f"""SELECT code, id, phase, CAST(floor(code / 8) AS INT) AS bit6, b.id2 AS decoded_id, CASE WHEN b.id2 = id AND code % 8 = phase THEN 1 ELSE 0 END AS ok
      FROM {space()} AS s JOIN (SELECT id AS id2, upper_idx * 8 + lower_idx AS key6 FROM {BASE} AS c) AS b ON b.key6 = CAST(floor(code / 8) AS INT)"""


def _by(column: str):
    return lambda x: f"SELECT {column}, code, id, phase FROM {space()} AS s WHERE {column} IS NOT NULL"


def _phases_of(x: Dialect) -> str:
    return f"SELECT h.hexagram_id, h.edition_id, s.phase, s.code, s.ternary FROM (SELECT DISTINCT edition_id, hexagram_id FROM hexagram_registry) AS h JOIN {space()} AS s ON s.id = h.hexagram_id"


def _encode(x: Dialect) -> str:
    return f"""SELECT e.profile_id, e.hexagram_id, s.phase, s.code, s.category, s.action FROM (SELECT DISTINCT profile_id, hexagram_id, phase_temporal FROM emotional_weights) AS e
      LEFT JOIN {space()} AS s ON s.id = e.hexagram_id AND s.temporal = e.phase_temporal"""


def _ternary(x: Dialect, digits: int) -> str:
    n = 3**digits
    symbol = lambda i: f"CAST(CAST(floor(i / power(3, {i})) AS BIGINT) % 3 AS INT)"
    text = " || ".join(f"CAST({symbol(i)} AS VARCHAR(1))" if not x.spark else f"CAST({symbol(i)} AS STRING)" for i in range(digits))
    return f"(SELECT i AS ternary_id, {text} AS digits FROM {x.numbers(n)} AS r)"


def _ternary_27(x: Dialect) -> str:
    return f"SELECT ternary_id, digits, {_count('digits', '0')} AS yin, {_count('digits', '1')} AS yang, {_count('digits', '2')} AS yao FROM {_ternary(x, 3)} AS t"


def _ternary_729(x: Dialect) -> str:
    return f"""SELECT u.ternary_id * 27 + l.ternary_id AS hid, u.digits AS upper_digits, l.digits AS lower_digits, h.id AS canonical_id
      FROM {_ternary(x, 3)} AS u CROSS JOIN {_ternary(x, 3)} AS l LEFT JOIN {H} AS h ON h.bits = l.digits || u.digits"""


def _ternary_5832(x: Dialect) -> str:
    return f"SELECT t.hid * 8 + p.phase AS rid, t.hid, p.phase, p.temporal, t.canonical_id FROM ({_ternary_729(x)}) AS t CROSS JOIN {P} AS p"


def _inversions(x: Dialect) -> str:
    return f"SELECT a.id AS a_id, b.id AS b_id, a.bits AS a_bits, b.bits AS b_bits FROM {H} AS a JOIN {H} AS b ON b.bits = reverse(a.bits) WHERE a.id <= b.id"


def _complements(x: Dialect) -> str:
    return f"SELECT a.id AS a_id, b.id AS b_id, CASE WHEN b.id = a.id + 1 THEN 1 ELSE 0 END AS adjacent FROM {H} AS a JOIN {H} AS b ON b.bits = translate(a.bits, '01', '10') WHERE a.id < b.id"


def _flip(bits: str) -> str:
    return f"substr({bits}, 1, i) || CASE WHEN substr({bits}, i + 1, 1) = '0' THEN '1' ELSE '0' END || substr({bits}, i + 2)"


def _transitions(x: Dialect) -> str:
    return f"SELECT f.id AS from_id, t.id AS to_id, 6 - f.i AS changed_line FROM (SELECT id, i, {_flip('bits')} AS flipped FROM {H} AS h CROSS JOIN {x.numbers(6)} AS n) AS f JOIN {H} AS t ON t.bits = f.flipped"


def _registry_transitions(x: Dialect) -> str:
    """JN-08 over every edition of the registry: the flips are exploded and matched by key, so there is no theta join."""
    one = f"(SELECT edition_id, hexagram_id, {x.last('binary' if x.spark else chr(34) + 'binary' + chr(34), 'updated_at')} AS bits FROM hexagram_registry GROUP BY edition_id, hexagram_id)"
    return f"""SELECT f.edition_id, f.hexagram_id AS from_id, t.hexagram_id AS to_id, 6 - f.i AS changed_line
      FROM (SELECT edition_id, hexagram_id, i, {_flip('bits')} AS flipped FROM {one} AS r CROSS JOIN {x.numbers(6)} AS n) AS f JOIN {one} AS t ON t.edition_id = f.edition_id AND t.bits = f.flipped"""


def _ring(x: Dialect) -> str:
    return f"""SELECT h.id, p.id AS previous_id, n.id AS next_id, p.name AS previous_name, n.name AS next_name FROM {H} AS h
      JOIN {H} AS p ON p.id = (h.id + 62) % 64 + 1 JOIN {H} AS n ON n.id = h.id % 64 + 1"""


def _balance(x: Dialect) -> str:
    return f"SELECT *, round(yin / CAST(6 AS DOUBLE), 6) AS yin_ratio, round(yang / CAST(6 AS DOUBLE), 6) AS yang_ratio, round(yao / CAST(6 AS DOUBLE), 6) AS yao_ratio, round(changing / CAST(6 AS DOUBLE), 6) AS changing_ratio FROM {balance(x)} AS b"


def _yao_lines(x: Dialect) -> str:
    return f"""SELECT id, phase, position, state, yao_key, CASE WHEN state = 2 THEN 1 ELSE 0 END AS is_stressed,
      CASE WHEN state = 1 THEN 'stable' WHEN state = 0 THEN 'stable' WHEN substr(bits, CAST(position AS INT), 1) = '1' THEN 'falling' ELSE 'rising' END AS direction FROM {lines(space()).replace("{numbers}", x.numbers(6))} AS l"""


def _arms(x: Dialect) -> str:
    """ST-01: union of the primary, line and mirror arms, with the trigrams joined by index."""
    return f"""SELECT 'primary' AS arm, b.id, 0 AS position, b.category AS label, u.tname AS upper_name, l.tname AS lower_name FROM {BASE} AS b JOIN {T} AS u ON u.idx = b.upper_idx JOIN {T} AS l ON l.idx = b.lower_idx
      UNION ALL SELECT 'line', id, CAST(i + 1 AS INT), substr(bits, i + 1, 1), '', '' FROM {H} AS h CROSS JOIN {x.numbers(6)} AS n
      UNION ALL SELECT 'mirror', a.id, 0, b.name, '', '' FROM {H} AS a JOIN {H} AS b ON b.bits = reverse(a.bits)"""


def _sequence(x: Dialect) -> str:
    """WN-01, MX-39: stability and change of each state and the difference from the one before."""
    yang = _count("bits", "1")
    return f"""SELECT id, stability, change, round(stability - lag(stability) OVER (ORDER BY id), 6) AS d_stability, round(change - lag(change) OVER (ORDER BY id), 6) AS d_change
      FROM (SELECT id, round(greatest({yang}, 6 - {yang}) / CAST(6 AS DOUBLE), 6) AS stability, round(least({yang}, 6 - {yang}) / CAST(6 AS DOUBLE), 6) AS change FROM {H} AS h) AS s"""


def _slots(x: Dialect) -> str:
    """MX-22..25, MX-41: every state's six lines in each of three states, and its card per bit."""
    return f"SELECT h.id, n.i + 1 AS slot, t.i AS ternary, CASE WHEN substr(h.bits, n.i + 1, 1) = '1' THEN 'yang' ELSE 'yin' END AS base, CASE WHEN t.i = 2 THEN 1 ELSE 0 END AS is_yao, translate(h.bits, '01', '10') AS inverted FROM {H} AS h CROSS JOIN {x.numbers(6)} AS n CROSS JOIN {x.numbers(3)} AS t"


def _phase_yao(x: Dialect) -> str:
    """MX-29 with the yang lines of each state: share of each family by phase."""
    return f"SELECT s.id, s.phase, b.yin, b.yang, b.yao, round(b.yang / CAST(6 AS DOUBLE), 6) AS yang_share, round((b.yin + b.yao) / CAST(6 AS DOUBLE), 6) AS open_share FROM {space()} AS s JOIN {balance(x)} AS b ON b.id = s.id AND b.phase = s.phase"


# --- Hashes over the driver's tables -----------------------------------------------------------

WRAP = "((({v}) + 2147483648) & 4294967295) - 2147483648"


def first4(x: Dialect, s: str) -> str:
    """HS-01: the first four bytes of a text's SHA-256 as a number."""
    return x.hexint(f"substr({x.sha256(s)}, 1, 8)")


def doc_state(x: Dialect, text: str = "text", tick: str = "'0'") -> tuple[str, str]:
    """HS-02: state 1..64 and phase 0..7 of a text."""
    state = f"({first4(x, f'{text} || {chr(39)}:{chr(39)} || {tick}')} % 64 + 1)"
    return state, f"({first4(x, f'{text} || {chr(39)}:{chr(39)} || CAST({state} AS ' + ('STRING' if x.spark else 'VARCHAR') + f') || {chr(39)}:{chr(39)} || {tick}')} % 8)"


def _doc_hexagram(x: Dialect) -> str:
    s, p = doc_state(x)
    return f"""SELECT d.doc_id, d.state, d.phase, h.name, h.category, h.action, ph.temporal FROM (SELECT doc_id, {s} AS state, {p} AS phase FROM documents WHERE text IS NOT NULL) AS d
      JOIN {H} AS h ON h.id = d.state JOIN {P} AS ph ON ph.phase = d.phase"""


def _doc_seed(x: Dialect) -> str:
    wrapped = x.fold("session_id", "0", lambda h, c: WRAP.format(v=f"{h} * 31 + {c}"))
    return f"""SELECT doc_id, seed, abs(seed) % 512 AS code, ((seed % 512) + 512) % 512 AS index512 FROM (SELECT doc_id, {wrapped} AS seed FROM documents WHERE session_id IS NOT NULL) AS d"""


def _part_coordinates(x: Dialect) -> str:
    return "SELECT l_orderkey, l_linenumber, ((l_orderkey * 17 + l_partkey * 13 + l_suppkey * 7 + l_linenumber) % 64 + 64) % 64 + 1 AS state FROM lineitem"


def _select_index(x: Dialect) -> str:
    string = "STRING" if x.spark else "VARCHAR"
    key = f"CAST(event_id AS {string}) || ':' || CAST(user_id AS {string}) || ':' || event_type"
    return f"SELECT event_id, {first4(x, key)} % 64 + 1 AS state FROM events"


def _fingerprints(x: Dialect) -> str:
    return f"SELECT doc_id, substr({x.sha256('text')}, 1, 16) AS source_hash, substr({x.sha256('text')}, 1, 12) AS fingerprint, substr(sha1(text), 1, 12) AS content, length(text) AS chars FROM documents WHERE text IS NOT NULL"


def _duplicates(x: Dialect) -> str:
    return f"SELECT {x.sha256('text')} AS content, count(*) AS documents, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY {x.sha256('text')} HAVING count(*) > 1"


def _xorshift(x: Dialect) -> str:
    """HS-09, F-10: a mixed hash of context, position and tick to nine bits."""
    m = lambda v: f"(({v}) & 4294967295)"
    h0 = x.xor("event_id", m("(user_id << 24) | ((event_id % 256) << 16) | ((event_id % 97) << 8)"))
    h1 = x.xor("h0", x.xor(m("event_id << 5"), "(event_id >> 7)"))
    h2 = x.xor("h1", x.xor(x.xor(m("h1 << 13"), "(h1 >> 17)"), m("h1 << 5")))
    return f"""SELECT event_id, {m(h2)} & 511 AS code FROM (SELECT event_id, {m(h1)} AS h1 FROM (SELECT event_id, user_id, {m(h0)} AS h0 FROM (SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS user_id FROM events) AS e) AS a) AS b"""


def _char_sums(x: Dialect) -> str:
    total = x.fold("name", "0", lambda h, c: f"{h} + {c}")
    return f"SELECT id, total, total % 97 / CAST(1000 AS DOUBLE) AS weight, total % 89 / CAST(1000 AS DOUBLE) AS other, total % 360 AS spin FROM (SELECT id, {total} AS total FROM {H} AS h) AS s"


def _md5_axes(x: Dialect) -> str:
    string = "STRING" if x.spark else "VARCHAR"
    byte = lambda i: f"({x.hexint(f'substr(md5(CAST(event_id AS {string})), {i}, 2)')} % 100 / 100.0)"
    return f"SELECT event_id, CAST({byte(1)} AS DOUBLE) AS chaos, CAST({byte(3)} AS DOUBLE) AS whimsy, CAST({byte(5)} AS DOUBLE) AS dark FROM events"


def decoded(df, code: str, strict: bool = True):
    """PF-01: ``df`` with the state and phase of a nine-bit code; one out of range is an error, or null where not ``strict``."""
    from pyspark.sql import functions as F

    space_ = df.sparkSession.sql(f"SELECT code AS _code, id AS state, phase, temporal, category, action FROM {space()} AS s")
    known = df.withColumn(code, F.when(F.col(code).isNull() | F.col(code).between(0, 511), F.col(code)).otherwise(F.raise_error(F.concat(F.lit("no such code: "), F.col(code).cast("string"))))) if strict else df
    return known.join(F.broadcast(space_), F.col(code) == F.col("_code"), "left").drop("_code")


_SQL = {
    "state_space_512": (_state_space, ()),
    "reachable_lines": (_reachable, ()),
    "decode_encode_roundtrip": (_roundtrip, ()),
    "encodings_by_category": (_by("category"), ()),
    "encodings_by_action": (_by("action"), ()),
    "encodings_by_temporal": (_by("temporal"), ()),
    "encodings_by_polarity": (_by("polarity"), ()),
    "registry_phases": (_phases_of, ("hexagram_registry",)),
    "profile_codes": (_encode, ("emotional_weights",)),
    "ternary_27": (_ternary_27, ()),
    "ternary_729": (_ternary_729, ()),
    "ternary_5832": (_ternary_5832, ()),
    "inversion_pairs": (_inversions, ()),
    "complement_pairs": (_complements, ()),
    "transition_graph": (_transitions, ()),
    "registry_transitions": (_registry_transitions, ("hexagram_registry",)),
    "ring_neighbours": (_ring, ()),
    "line_balance": (_balance, ()),
    "yao_lines": (_yao_lines, ()),
    "arms_union": (_arms, ()),
    "sequence_deltas": (_sequence, ()),
    "slot_options": (_slots, ()),
    "phase_yao_distribution": (_phase_yao, ()),
    "doc_hexagram_phase": (_doc_hexagram, ("documents",)),
    "doc_seed_state": (_doc_seed, ("documents",)),
    "part_coord_state": (_part_coordinates, ("lineitem",)),
    "event_select_index": (_select_index, ("events",)),
    "source_fingerprints": (_fingerprints, ("documents",)),
    "duplicate_sets": (_duplicates, ("documents",)),
    "xorshift_states": (_xorshift, ("events",)),
    "name_char_sums": (_char_sums, ()),
    "event_md5_axes": (_md5_axes, ("events",)),
}
_BUILT = {name: shared(text, tables) for name, (text, tables) in _SQL.items()}
QUERIES = {name: run for name, (run, _) in _BUILT.items()}
ORACLE = {name: sql for name, (_, sql) in _BUILT.items()}
