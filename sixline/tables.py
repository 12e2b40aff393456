"""Dimension tables: 64 six-bit states, 8 phases, 8 trigrams, as literals and as DataFrames.

The five axis weights of the states are no literals: they are a parameter, taken from a table of
profiles (see ``weights`` in :mod:`sixline.plans.symbols`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AXES = ("chaos", "whimsy", "dark", "coherence", "voice")

#: Id, lines from bottom to top, category, action, name.
STATES = """
1 111111 sovereign ASSERT The Creative
2 000000 transformer YIELD The Receptive
3 010001 dissipator ADAPT Difficulty at the Beginning
4 100010 transformer WAIT Youthful Folly
5 010111 dissipator WAIT Waiting
6 111010 transformer ASSERT Conflict
7 000010 sovereign ASSERT The Army
8 010000 transformer YIELD Holding Together
9 110111 dissipator ADAPT Taming Power of the Small
10 111011 sovereign ADAPT Treading
11 000111 transformer YIELD Peace
12 111000 boundary WAIT Standstill
13 101111 transformer ASSERT Fellowship with Men
14 111101 sovereign ASSERT Possession in Great Measure
15 001000 transformer YIELD Modesty
16 000100 dissipator ADAPT Enthusiasm
17 100110 transformer YIELD Following
18 011001 dissipator ADAPT Work on Decayed
19 110000 transformer YIELD Approach
20 000011 boundary WAIT Contemplation
21 100101 transformer ASSERT Biting Through
22 101001 boundary WAIT Grace
23 000001 dissipator WAIT Splitting Apart
24 100000 transformer YIELD Return
25 100111 sovereign ASSERT Innocence
26 111001 boundary ADAPT Taming Power of the Great
27 100001 transformer YIELD Corners of the Mouth
28 011110 dissipator ADAPT Preponderance of the Great
29 010010 dissipator WAIT The Abysmal
30 101101 boundary ADAPT The Clinging
31 001110 transformer YIELD Influence
32 011100 boundary WAIT Duration
33 001111 boundary YIELD Retreat
34 111100 sovereign ASSERT Power of the Great
35 000101 transformer ADAPT Progress
36 101000 dissipator WAIT Darkening of the Light
37 101011 transformer YIELD The Family
38 110101 dissipator ADAPT Opposition
39 010100 dissipator WAIT Obstruction
40 001010 transformer ADAPT Deliverance
41 100011 transformer YIELD Decrease
42 110001 transformer ASSERT Increase
43 111110 sovereign ASSERT Breakthrough
44 011111 boundary WAIT Coming to Meet
45 000110 transformer YIELD Gathering Together
46 011000 transformer ADAPT Pushing Upward
47 010110 dissipator WAIT Oppression
48 011010 boundary YIELD The Well
49 101110 transformer ASSERT Revolution
50 011101 sovereign ASSERT The Cauldron
51 100100 sovereign ASSERT The Arousing
52 001001 boundary WAIT Keeping Still
53 001011 transformer ADAPT Development
54 110100 dissipator YIELD The Marrying Maiden
55 001101 sovereign ASSERT Abundance
56 101100 dissipator ADAPT The Wanderer
57 011011 boundary YIELD The Gentle
58 110110 transformer YIELD The Joyous
59 010011 dissipator ADAPT Dispersion
60 110010 boundary WAIT Limitation
61 110011 transformer YIELD Inner Truth
62 001100 dissipator WAIT Preponderance of the Small
63 101010 boundary WAIT After Completion
64 010101 transformer ADAPT Before Completion
"""

#: Phase, temporal, polarity and the shift of each axis in that phase.
PHASES = [
    (0, "past", "yin", (0.0, 0.0, 0.05, 0.01, -0.01)),
    (1, "present", "yang", (0.04, 0.08, 0.0, -0.01, 0.01)),
    (2, "future", "yao", (0.02, 0.09, 0.0, 0.0, 0.02)),
    (3, "transition", "yin-yang", (0.05, 0.05, 0.02, -0.02, 0.0)),
    (4, "resolution", "yang-yin", (-0.03, -0.02, -0.02, 0.05, 0.03)),
    (5, "dissolution", "yin-yao", (0.06, 0.04, 0.05, -0.03, -0.02)),
    (6, "crystallization", "yang-yao", (-0.02, -0.01, -0.01, 0.04, 0.04)),
    (7, "void", "yao-yao", (0.0, 0.0, 0.0, 0.0, 0.0)),
]

#: Trigram bits, name, nature, attribute and context vector.
TRIGRAMS = [
    ("000", "Kun", "Earth", "receptive", (0.05, 0.1, 0.05, 0.95, 0.85)),
    ("001", "Gen", "Mountain", "still", (0.1, 0.1, 0.2, 0.92, 0.85)),
    ("010", "Kan", "Water", "abysmal", (0.5, 0.15, 0.55, 0.5, 0.7)),
    ("011", "Xun", "Wind", "gentle", (0.2, 0.5, 0.1, 0.75, 0.78)),
    ("100", "Zhen", "Thunder", "arousing", (0.4, 0.35, 0.1, 0.75, 0.85)),
    ("101", "Li", "Fire", "clinging", (0.2, 0.3, 0.1, 0.85, 0.88)),
    ("110", "Dui", "Lake", "joyous", (0.25, 0.6, 0.05, 0.8, 0.82)),
    ("111", "Qian", "Heaven", "creative", (0.1, 0.2, 0.05, 0.9, 0.95)),
]

#: Words by which a text shows an intent; a word's score is one over its place.
INTENTS = {
    "create": "create build make generate new start begin initiate",
    "destroy": "destroy end kill stop break collapse remove delete",
    "transform": "transform change evolve morph shift transition become",
    "explore": "explore discover find search wander journey seek",
    "understand": "understand learn see clarity know comprehend insight",
    "feel": "feel emotion love fear joy pain heart soul",
    "speak": "speak voice say tell express communicate utter",
    "listen": "listen hear silence quiet still pause receive",
    "connect": "connect join unite bond link bridge weave",
    "protect": "protect defend guard secure shelter preserve safe",
    "conflict": "conflict fight oppose clash battle resist challenge",
    "heal": "heal repair restore renew mend fix revive",
    "grow": "grow expand increase amplify scale rise flourish",
    "release": "release let_go free surrender yield open flow",
    "focus": "focus concentrate center aim direct target precision",
}


def state_rows() -> list[tuple[int, str, str, str, str]]:
    """(id, bits, category, action, name), bits from bottom to top."""
    rows = [line.split(" ", 4) for line in STATES.strip().splitlines()]
    return [(int(i), b, c, a, n) for i, b, c, a, n in rows]


def _literal(v) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)


def values(rows: list[tuple], columns: str) -> str:
    """A derived table of literals that Spark and DuckDB both read."""
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({columns}))"


def states_sql() -> str:
    return values(state_rows(), "id, bits, category, action, name")


def phases_sql() -> str:
    return values([(p, t, q, *s) for p, t, q, s in PHASES], "phase, temporal, polarity, " + ", ".join(f"s_{a}" for a in AXES))


def trigrams_sql() -> str:
    return values([(i, b, n, nature, attr, *v) for i, (b, n, nature, attr, v) in enumerate(TRIGRAMS)], "idx, tbits, tname, nature, attribute, " + ", ".join(f"t_{a}" for a in AXES))


def intents_sql() -> str:
    return values([(k, w, 1.0 / r) for k, words in INTENTS.items() for r, w in enumerate(words.split(), 1) if "_" not in w], "intent, word, score")


def states(spark: SparkSession) -> DataFrame:
    """The 64 states; a literal relation of fixed size, so joins with it may always broadcast it."""
    return spark.sql(f"SELECT * FROM {states_sql()}")


def phases(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {phases_sql()}")


def trigrams(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {trigrams_sql()}")
