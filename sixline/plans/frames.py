"""DataFrame plans of queries whose SQL stands in the other modules: the two are written apart, so each checks the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sixline import tables as T
from sixline.functions.axes import cosine, rnd
from sixline.session import table
from sixline.tables import AXES

PROFILE = ["chaos", "whimsy", "darktone", "coherence", "voiceweight"]
QUERIES = {}


def plan(f):
    QUERIES[f.__name__] = f
    return f


def _states(spark: SparkSession) -> DataFrame:
    return F.broadcast(T.states(spark))


def _once(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "emotional_weights").select(*columns).distinct()


def _inside(df: DataFrame) -> DataFrame:
    for c in PROFILE:
        df = df.filter(F.col(c).between(0, 1))
    return df


# --- State spaces -----------------------------------------------------------------------------


def _bits(states: DataFrame) -> DataFrame:
    """States with the indices of their trigrams: the bits read from the top."""
    upper, lower = F.reverse(F.substring("bits", 4, 3)), F.reverse(F.substring("bits", 1, 3))
    return states.withColumn("upper_idx", F.conv(upper, 2, 10).cast("int")).withColumn("lower_idx", F.conv(lower, 2, 10).cast("int"))


def _space(spark: SparkSession) -> DataFrame:
    """The 512 states with code and ternary lines from the top: phase bit k changes lines k and k + 3."""
    phases = T.phases(spark).select("phase", "temporal", "polarity")
    both = _bits(T.states(spark)).crossJoin(phases)  # 64 by 8
    lines = F.expr("transform(sequence(1, 6), i -> CASE WHEN shiftright(phase, (i - 1) % 3) % 2 = 1 THEN '2' ELSE substring(reverse(bits), i, 1) END)")
    return both.withColumn("code", (F.col("upper_idx") * 8 + F.col("lower_idx")) * 8 + F.col("phase")).withColumn("ternary", F.array_join(lines, ""))


@plan
def state_space_512(spark: SparkSession, d: str) -> DataFrame:
    moved = F.translate("ternary", "2", "0")
    return _space(spark).select("id", "name", "category", "action", "phase", "temporal", "polarity", "code", "ternary", moved.alias("transformed"), F.regexp_count("ternary", F.lit("2")).alias("yao"))


@plan
def reachable_lines(spark: SparkSession, d: str) -> DataFrame:
    return _space(spark).groupBy("ternary").agg(F.count(F.lit(1)).alias("states"), F.min("code").alias("first_code"))


@plan
def decode_encode_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    s = _space(spark).select("code", "id", "phase", F.shiftright("code", 3).alias("bit6"))
    back = _bits(T.states(spark)).select(F.col("id").alias("decoded_id"), (F.col("upper_idx") * 8 + F.col("lower_idx")).alias("bit6"))
    j = s.join(back, "bit6")
    return j.select("code", "id", "phase", "bit6", "decoded_id", ((F.col("decoded_id") == F.col("id")) & (F.col("code") % 8 == F.col("phase"))).cast("int").alias("ok"))


def _by(column: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _space(spark).select(column, "code", "id", "phase").filter(F.col(column).isNotNull())

    run.__name__ = f"encodings_by_{column}"
    return plan(run)


for _c in ("category", "action", "temporal", "polarity"):
    _by(_c)


@plan
def registry_phases(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "hexagram_registry").select("edition_id", "hexagram_id").distinct()
    return keys.join(F.broadcast(_space(spark).select(F.col("id").alias("hexagram_id"), "phase", "code", "ternary")), "hexagram_id")


@plan
def profile_codes(spark: SparkSession, d: str) -> DataFrame:
    e = _once(spark, d, "profile_id", "hexagram_id", "phase_temporal")
    s = _space(spark).select(F.col("id").alias("hexagram_id"), F.col("temporal").alias("phase_temporal"), "phase", "code", "category", "action")
    return e.join(F.broadcast(s), ["hexagram_id", "phase_temporal"], "left").drop("phase_temporal")


@plan
def inversion_pairs(spark: SparkSession, d: str) -> DataFrame:
    h = T.states(spark)
    a, b = h.select(F.col("id").alias("a_id"), F.col("bits").alias("a_bits"), F.reverse("bits").alias("b_bits")), h.select(F.col("id").alias("b_id"), F.col("bits").alias("b_bits"))
    return a.join(b, "b_bits").filter("a_id <= b_id")


@plan
def complement_pairs(spark: SparkSession, d: str) -> DataFrame:
    h = T.states(spark)
    a, b = h.select(F.col("id").alias("a_id"), F.translate("bits", "01", "10").alias("bits")), h.select(F.col("id").alias("b_id"), "bits")
    return a.join(b, "bits").filter("a_id < b_id").select("a_id", "b_id", (F.col("b_id") == F.col("a_id") + 1).cast("int").alias("adjacent"))


def _flipped(h: DataFrame, keys: list[str]) -> DataFrame:
    """Each line of a state flipped, as a number of six bits: exploded, so that the match is by key."""
    line = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")
    return h.select(*keys, F.conv("bits", 2, 10).cast("int").alias("n"), line).withColumn("to", F.expr("n ^ shiftleft(1, 5 - i)"))


@plan
def transition_graph(spark: SparkSession, d: str) -> DataFrame:
    h = T.states(spark)
    to = h.select(F.conv("bits", 2, 10).cast("int").alias("to"), F.col("id").alias("to_id"))
    return _flipped(h.withColumnRenamed("id", "from_id"), ["from_id"]).join(to, "to").select("from_id", "to_id", (6 - F.col("i")).alias("changed_line"))


@plan
def registry_transitions(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "hexagram_registry").groupBy("edition_id", "hexagram_id").agg(F.max_by("binary", "updated_at").alias("bits")).filter(F.col("bits").rlike("^[01]{6}$"))
    to = one.select("edition_id", F.conv("bits", 2, 10).cast("int").alias("to"), F.col("hexagram_id").alias("to_id"))
    return _flipped(one.withColumnRenamed("hexagram_id", "from_id"), ["edition_id", "from_id"]).join(to, ["edition_id", "to"]).select("edition_id", "from_id", "to_id", (6 - F.col("i")).alias("changed_line"))


@plan
def ring_neighbours(spark: SparkSession, d: str) -> DataFrame:
    h = T.states(spark).select("id", "name")
    p, n = h.toDF("previous_id", "previous_name"), h.toDF("next_id", "next_name")
    at = h.select("id", F.when(F.col("id") == 1, 64).otherwise(F.col("id") - 1).alias("previous_id"), F.when(F.col("id") == 64, 1).otherwise(F.col("id") + 1).alias("next_id"))
    return at.join(p, "previous_id").join(n, "next_id")


@plan
def ternary_27(spark: SparkSession, d: str) -> DataFrame:
    n = lambda v: F.regexp_count("digits", F.lit(v))
    return _digits(spark).select("ternary_id", "digits", n("0").alias("yin"), n("1").alias("yang"), n("2").alias("yao"))


def _digits(spark: SparkSession) -> DataFrame:
    """27 ids with their three digits, the lowest first."""
    return spark.range(27).select(F.col("id").cast("int").alias("ternary_id"), F.reverse(F.lpad(F.conv(F.col("id"), 10, 3), 3, "0")).alias("digits"))


@plan
def ternary_729(spark: SparkSession, d: str) -> DataFrame:
    u, l = _digits(spark).toDF("u", "upper_digits"), _digits(spark).toDF("l", "lower_digits")  # noqa: E741
    both = u.crossJoin(l)  # 27 by 27
    h = T.states(spark).select(F.col("id").alias("canonical_id"), F.substring("bits", 1, 3).alias("lower_digits"), F.substring("bits", 4, 3).alias("upper_digits"))
    return both.join(h, ["lower_digits", "upper_digits"], "left").select((F.col("u") * 27 + F.col("l")).alias("hid"), "upper_digits", "lower_digits", "canonical_id")


@plan
def ternary_5832(spark: SparkSession, d: str) -> DataFrame:
    each = ternary_729(spark, d).select("hid", "canonical_id").crossJoin(T.phases(spark).select("phase", "temporal"))  # 729 by 8
    return each.select((F.col("hid") * 8 + F.col("phase")).alias("rid"), "hid", "phase", "temporal", "canonical_id")


# --- Hashes -----------------------------------------------------------------------------------


def _first4(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


@plan
def doc_hexagram_phase(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text", (_first4(F.concat("text", F.lit(":0"))) % 64 + 1).alias("state"))
    docs = docs.select("doc_id", "state", (_first4(F.concat_ws(":", "text", F.col("state").cast("string"), F.lit("0"))) % 8).alias("phase"))
    names = T.states(spark).select(F.col("id").alias("state"), "name", "category", "action")
    return docs.join(F.broadcast(names), "state").join(F.broadcast(T.phases(spark).select("phase", "temporal")), "phase")


@plan
def doc_seed_state(spark: SparkSession, d: str) -> DataFrame:
    codes = F.transform(F.split("session_id", ""), lambda c: F.ascii(c).cast("long"))
    wrap = lambda v: (v + 2147483648).bitwiseAND(F.lit(4294967295)) - 2147483648
    seed = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c))
    return table(spark, d, "documents").filter("session_id IS NOT NULL").select("doc_id", seed.alias("seed")).select("doc_id", "seed", (F.abs("seed") % 512).alias("code"), F.pmod("seed", F.lit(512)).alias("index512"))


@plan
def part_coord_state(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("l_orderkey") * 17 + F.col("l_partkey") * 13 + F.col("l_suppkey") * 7 + F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.pmod(at, F.lit(64)) + 1).alias("state"))


@plan
def event_select_index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", (_first4(F.concat_ws(":", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type")) % 64 + 1).alias("state"))


@plan
def source_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    h = F.sha2("text", 256)
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", h.substr(1, 16).alias("source_hash"), h.substr(1, 12).alias("fingerprint"), F.sha1("text").substr(1, 12).alias("content"), F.char_length("text").alias("chars"))


@plan
def duplicate_sets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("content"))
    return docs.groupBy("content").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc")).filter("documents > 1")


@plan
def event_md5_axes(spark: SparkSession, d: str) -> DataFrame:
    from sixline.operators.sessions import md5_axis

    key = F.col("event_id").cast("string")
    return table(spark, d, "events").select("event_id", *[md5_axis(key, i).alias(a) for i, a in ((1, "chaos"), (3, "whimsy"), (5, "dark"))])


# --- Profiles ---------------------------------------------------------------------------------


@plan
def pool_mean_std(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "profile_id", "hexagram_id", "phase_temporal", *PROFILE)
    stats = [f(c).alias(f"{k}_{a}") for c, a in zip(PROFILE, AXES) for k, f in (("mean", lambda x: rnd(F.avg(x), 5)), ("std", lambda x: rnd(F.stddev_pop(x), 5)))]
    return rows.groupBy("hexagram_id", "phase_temporal").agg(F.count(F.lit(1)).alias("records"), *stats)


@plan
def state_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "emotional_weights").groupBy(F.col("hexagram_id").alias("id")).agg(F.count("profile_id").alias("records"), F.count_distinct("phase_temporal").alias("phases"), F.count_distinct("session_id").alias("sessions"))
    return T.states(spark).select("id", "name").join(e, "id", "left").na.fill(0, ["records", "phases", "sessions"])


@plan
def superposition_coverage(spark: SparkSession, d: str) -> DataFrame:
    wide = [(F.max(c) - F.min(c)).alias(f"range_{a}") for c, a in zip(PROFILE, AXES)]
    return table(spark, d, "emotional_weights").groupBy("session_id").agg((F.count_distinct("hexagram_id") / F.lit(64.0)).alias("state_coverage"), F.count_distinct("phase_temporal").alias("phases"), *wide)


@plan
def dominant_axis(spark: SparkSession, d: str) -> DataFrame:
    whole = table(spark, d, "emotional_weights").na.drop(subset=PROFILE)
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("v"), F.lit(-i).alias("i"), F.lit(a).alias("a")) for i, (c, a) in enumerate(zip(PROFILE, AXES))]))["a"]
    words = [("chaos", 0.7, "chaotic; "), ("whimsy", 0.7, "playful; "), ("darktone", 0.6, "grave; "), ("coherence", 0.6, "focused; "), ("voiceweight", 0.6, "authoritative; ")]
    norm = F.sqrt(F.aggregate(F.array(*PROFILE), F.lit(0.0), lambda s, v: s + v * v))
    return whole.select("profile_id", "ingested_at", best.alias("dominant"), F.concat(*[F.when(F.col(c) > t, w).otherwise("") for c, t, w in words]).alias("intent"), rnd(norm).alias("norm"))


@plan
def personality_distribution(spark: SparkSession, d: str) -> DataFrame:
    e = _once(spark, d, "profile_id", "session_id", "hexagram_id", "voiceweight")
    h = _bits(T.states(spark)).join(T.trigrams(spark).select(F.col("idx").alias("upper_idx"), F.col("tname").alias("upper_name")), "upper_idx").select(F.col("id").alias("hexagram_id"), "upper_name", F.substring("bits", 1, 1).cast("int").alias("first"))
    return e.join(F.broadcast(h), "hexagram_id").groupBy("session_id", "upper_name").agg(F.count(F.lit(1)).alias("profiles"), rnd(F.sum("voiceweight"), 4).alias("magnitude"), rnd(F.avg("first")).alias("first_line"))


@plan
def voice_pool_rank(spark: SparkSession, d: str) -> DataFrame:
    means = lambda df, p: [rnd(F.avg(c), 4).alias(f"{p}{a}") for c, a in zip(PROFILE, AXES)]
    w = _inside(_once(spark, d, "profile_id", "hexagram_id", *PROFILE)).groupBy(F.col("hexagram_id").alias("id")).agg(*means(None, "w_"))
    rows = _inside(table(spark, d, "emotional_weights")).filter("phase_temporal IS NOT NULL")
    held = rows.groupBy(F.col("phase_temporal").alias("pool")).agg(*means(None, "p_")).agg(F.collect_list(F.struct("pool", *[f"p_{a}" for a in AXES])).alias("_p"))  # one row per phase
    held = held.select(F.when(F.size("_p") <= 10_000, F.col("_p")).otherwise(F.raise_error(F.lit("too many pools"))).alias("_p"))
    each = w.join(F.broadcast(held)).select("*", F.explode("_p").alias("_x")).select("id", *[f"w_{a}" for a in AXES], "_x.*")
    sim = each.select("id", "pool", rnd(cosine([f"w_{a}" for a in AXES], [f"p_{a}" for a in AXES])).alias("similarity"))
    return sim.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "pool")))


@plan
def top_two_axes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "emotional_weights")
    named = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct((-F.col(c)).alias("v"), F.lit(i).alias("i"), F.lit(c).alias("axis"))) for i, c in enumerate(PROFILE)]))
    # Rows of one delivery may be there twice: their axes are ranked together.
    both = e.groupBy("profile_id", "ingested_at").agg(F.slice(F.array_sort(F.flatten(F.collect_list(named))), 1, 2).alias("top"))
    return both.select("profile_id", "ingested_at", F.posexplode("top").alias("at", "x")).select("profile_id", "ingested_at", "x.axis", (F.col("at") + 1).alias("rn"))


@plan
def narrative_mode(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "emotional_weights").na.drop(subset=PROFILE)
    c = F.col
    mode = F.when((c("coherence") > 0.6) & (c("chaos") < 0.4), "code").when((c("chaos") > 0.5) & (c("whimsy") > 0.5), "blueprint").when((c("voiceweight") > 0.6) & (c("darktone") > 0.6), "agent").otherwise("literary")
    return e.select("profile_id", "ingested_at", mode.alias("mode"), F.size(F.filter(F.array("chaos", "whimsy", "darktone"), lambda v: v > 0.7)).alias("decorations"))


@plan
def training_records(spark: SparkSession, d: str) -> DataFrame:
    h = T.states(spark).select(F.col("id").alias("hexagram_id"), "category", "action")
    e = table(spark, d, "emotional_weights").select("profile_id", "ingested_at", "hexagram_id", "phase_temporal", *PROFILE).join(F.broadcast(h), "hexagram_id")
    code = F.create_map(*[F.lit(x) for kv in (("sovereign", "1"), ("transformer", "2"), ("boundary", "3"), ("dissipator", "4")) for x in kv])[F.col("category")]
    whole = [F.floor(F.col(c) * 10000 + 0.5001).cast("long").cast("string") for c in PROFILE]
    bar = F.lit("|")
    save = F.concat(F.col("hexagram_id").cast("string"), bar, code, *[x for w in whole for x in (bar, w)])
    tokens = F.concat(F.lit("<|hexagram|>"), F.lpad(F.col("hexagram_id").cast("string"), 2, "0"), F.lit(" <|phase|>"), "phase_temporal", F.lit(" <|action|>"), "action")
    return e.select("profile_id", "ingested_at", tokens.alias("tokens"), save.alias("save_string"))


@plan
def notes_normalised(spark: SparkSession, d: str) -> DataFrame:
    from sixline.operators.mesh import plain

    e = table(spark, d, "emotional_weights").filter("trainingnotes IS NOT NULL")
    safe = F.col("trainingnotes")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(sign), F.lit(name))
    return e.select("profile_id", "ingested_at", plain(F.col("trainingnotes")).alias("plain"), F.left("trainingnotes", F.lit(120)).alias("echo"), safe.alias("escaped"))


# --- Events, texts, lines ---------------------------------------------------------------------


@plan
def event_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), rnd(F.avg("value"), 4).alias("mean_value"))


@plan
def event_slider_clamped(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.when(v.isNull(), 50.0).when(v < 0, 0.0).when(v > 100, 100.0).otherwise(v).alias("slider"))


@plan
def event_temporal_phase(spark: SparkSession, d: str) -> DataFrame:
    v, k = F.coalesce("value", F.lit(50.0)), F.col("event_id") % 3
    return table(spark, d, "events").select("event_id", F.when(v < 33, "old").when(v > 66, "young").otherwise("transition").alias("substate"), k.alias("tick3"), F.when(k == 0, 0.6).otherwise(0.2).alias("w_past"))


@plan
def session_history_64(spark: SparkSession, d: str) -> DataFrame:
    # The limit within the window is applied before the shuffle as well: a user with most events sends 64 per partition.
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").select("event_id", "user_id", F.row_number().over(w).alias("place")).filter("place <= 64")


@plan
def doc_length_bands(spark: SparkSession, d: str) -> DataFrame:
    n = F.char_length("text")
    return table(spark, d, "documents").select("doc_id", n.alias("chars")).filter("chars > 0").select("doc_id", "chars", F.when(F.col("chars") > 800, "long").when(F.col("chars") > 40, "kept").otherwise("short").alias("band"))


@plan
def quality_smoke(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.count("text").alias("with_text"), F.count_distinct("doc_id").alias("ids"))
    return q.select("*", (F.col("records") >= 5).cast("int").alias("enough"), (F.col("with_text") == F.col("records")).cast("int").alias("complete"))


@plan
def derive_emotional_input(spark: SparkSession, d: str) -> DataFrame:
    far = F.least(F.lit(1.0), F.hypot(F.col("l_partkey"), F.col("l_suppkey")) / 10000)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rnd(F.greatest(F.lit(0.5), F.when(F.col("l_extendedprice") > 1e6, 0.8).otherwise(0.0), far), 4).alias("emotional_input"))


@plan
def dataset_score(spark: SparkSession, d: str) -> DataFrame:
    h = T.states(spark).select(F.col("id").alias("hexagram_id"), F.col("bits").alias("_bits"))
    r = table(spark, d, "hexagram_registry").join(F.broadcast(h), "hexagram_id").groupBy("edition_id")
    return r.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("binary") == F.col("_bits")).alias("same_bits"), F.count_if(F.length("binary") == 6).alias("six"), F.floor(100 * F.count("category") / F.count(F.lit(1))).alias("percent"))


@plan
def session_window_events(spark: SparkSession, d: str) -> DataFrame:
    # Spark's own session windows: partial sessions are merged before and after the shuffle. Just an hour apart is still one session.
    events = table(spark, d, "events")
    s = events.groupBy("user_id", F.session_window("ts", "1 hour 1 microsecond")).agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return s.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("first_ts")).cast("long").alias("session"), "events", "first_ts", "last_ts")


@plan
def query_probe_patterns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "emotional_weights").filter(F.col("chaos").between(0, 1)).groupBy("session_id", "hexagram_id").agg(F.count(F.lit(1)).alias("n"), (F.max("chaos") - F.min("chaos")).alias("wide"))
    pattern = F.when((F.col("wide") < 0.2) & (F.col("n") < 3), "minimal").when(F.col("wide") < 0.4, "passive").otherwise("expansive")
    return rows.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("profiles"), F.min("session_id").alias("first_session"))


@plan
def xorshift_states(spark: SparkSession, d: str) -> DataFrame:
    low = lambda v: v.bitwiseAND(F.lit(4294967295))
    left, right = (lambda v, n: F.shiftleft(v, n)), (lambda v, n: F.shiftright(v, n))
    e = table(spark, d, "events").select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"))
    k = F.col("event_id")
    place = left(F.col("user_id"), 24).bitwiseOR(left(k % 256, 16)).bitwiseOR(left(k % 97, 8))
    h0 = low(k.bitwiseXOR(low(place)))
    e = e.select("event_id", h0.alias("h"))
    e = e.select("event_id", low(F.col("h").bitwiseXOR(low(left(k, 5)).bitwiseXOR(right(k, 7)))).alias("h"))
    h = F.col("h")
    return e.select("event_id", low(h.bitwiseXOR(low(left(h, 13)).bitwiseXOR(right(h, 17)).bitwiseXOR(low(left(h, 5))))).bitwiseAND(F.lit(511)).alias("code"))


@plan
def name_char_sums(spark: SparkSession, d: str) -> DataFrame:
    total = F.aggregate(F.transform(F.split("name", ""), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda s, c: s + c)
    h = T.states(spark).select("id", total.alias("total"))
    return h.select("id", "total", (F.col("total") % 97 / 1000).alias("weight"), (F.col("total") % 89 / 1000).alias("other"), (F.col("total") % 360).alias("spin"))


@plan
def arms_union(spark: SparkSession, d: str) -> DataFrame:
    h, t = T.states(spark), T.trigrams(spark)
    named = _bits(h).join(t.select(F.col("idx").alias("upper_idx"), F.col("tname").alias("upper_name")), "upper_idx").join(t.select(F.col("idx").alias("lower_idx"), F.col("tname").alias("lower_name")), "lower_idx")
    primary = named.select(F.lit("primary").alias("arm"), "id", F.lit(0).alias("position"), F.col("category").alias("label"), "upper_name", "lower_name")
    none = [F.lit("").alias("upper_name"), F.lit("").alias("lower_name")]
    lines = h.select(F.lit("line").alias("arm"), "id", F.posexplode(F.split("bits", "")).alias("i", "label")).filter("label <> ''").select("arm", "id", (F.col("i") + 1).alias("position"), "label", *none)
    other = h.select(F.reverse("bits").alias("_b"), F.col("name").alias("label"))
    mirror = h.join(other, F.col("bits") == F.col("_b")).select(F.lit("mirror").alias("arm"), "id", F.lit(0).alias("position"), "label", *none)
    return primary.unionByName(lines).unionByName(mirror)


@plan
def sequence_deltas(spark: SparkSession, d: str) -> DataFrame:
    y = F.length(F.translate("bits", "0", ""))
    h = T.states(spark).select("id", rnd(F.greatest(y, 6 - y) / 6).alias("stability"), rnd(F.least(y, 6 - y) / 6).alias("change"))
    w = Window.orderBy("id")  # 64 rows
    return h.select("*", *[rnd(F.col(c) - F.lag(c).over(w)).alias(f"d_{c}") for c in ("stability", "change")])


@plan
def slot_options(spark: SparkSession, d: str) -> DataFrame:
    h = T.states(spark).select("id", "bits", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("slot")).select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ternary"))
    return h.select("id", "slot", "ternary", F.when(F.expr("substring(bits, slot, 1)") == "1", "yang").otherwise("yin").alias("base"), (F.col("ternary") == 2).cast("int").alias("is_yao"), F.translate("bits", "01", "10").alias("inverted"))


@plan
def scene_every_25th(spark: SparkSession, d: str) -> DataFrame:
    # A run may hold most scenes: places are counted within ranges of the index, plus what the ranges before hold.
    s = table(spark, d, "jkd_ingestion_ternary").select("scene_id", "run_id", "scene_index", F.floor(F.col("scene_index") / 1024).alias("_r"))
    local = s.withColumn("_i", F.row_number().over(Window.partitionBy("run_id", "_r").orderBy("scene_index", "scene_id")) - 1)
    counts = s.groupBy(F.col("run_id").alias("_run"), F.col("_r").alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    held = counts.select("_run", "_range", F.coalesce(F.sum("_n").over(Window.partitionBy("_run").orderBy(F.asc_nulls_last("_range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_held"))
    j = local.join(held, F.col("run_id").eqNullSafe(F.col("_run")) & F.col("_r").eqNullSafe(F.col("_range")))
    return j.select("scene_id", "run_id", (F.col("_i") + F.col("_held")).alias("place")).filter("place % 25 = 0")
