"""Queries p3, p4, p6, p7 and p8 over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sixline.llm import bpe, cluster, cutoff, mix, split
from sixline.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split.oversized(table(spark, d, "jkd_ingestion_ternary"), ["scene_id"], "scene_text").select("scene_id", "forced")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.pieces(table(spark, d, "jkd_ingestion_ternary"), ["scene_id", "scene_index"], "scene_text")


AXES = {"chaos": 1.0, "whimsy": 1.0, "darktone": 1.0, "coherence": 1.0}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = cluster.tight(table(spark, d, "emotional_weights"), "profile_id", AXES, 0.025, 5, "ingested_at")
    return found.withColumnRenamed("id", "profile_id")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return cluster.groups(table(spark, d, "emotional_weights"), "profile_id", AXES, "ingested_at").withColumnRenamed("id", "profile_id")


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    weights = table(spark, d, "emotional_weights")
    found = cluster.tight(weights, "profile_id", AXES, 0.025, 5, "ingested_at")
    return cluster.described(found, weights, "profile_id", list(AXES), "ingested_at").withColumnRenamed("id", "profile_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), "doc_id", "text")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.shares(p7_mix(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.truncated(table(spark, d, "documents")).select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.rates(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_pieces, p4_found, p4_clusters, p4_groups, p6_ids, p7_mix, p7_shares, p8_found, p8_rates)}

ORACLE = {
    "p3_found": r"""SELECT scene_id, CAST(regexp_matches(scene_text, '[^\s.,;:!?。，；：！？、\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{801}') AS INTEGER) AS forced
FROM jkd_ingestion_ternary WHERE length(scene_text) > 800""",
}
