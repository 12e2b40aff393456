"""Audits of a mesh: nodes and named edges, resolved by an order of strategies, with orphans and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sixline.session import cut


def plain(name):
    """A name in lower case with runs of other signs as one underscore."""
    return F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_")


def stem(name):
    """The last part of a path without its suffix."""
    return F.regexp_replace(F.regexp_replace(name, "^.*/", ""), r"\.[A-Za-z0-9]+$", "")


def resolved(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (source, target) with node id ``found`` and the ``rule`` that found it: exact name, plain name, then stem; null where none does.

    Nodes are (id, name). Each rule is an equi-join with one row per name; a name of several nodes means the smallest id.
    """
    rules = {"exact": lambda c: c, "plain": plain, "stem": lambda c: plain(stem(c))}
    e = edges.select("source", "target", *[rule(F.col("target")).alias(f"_{k}_name") for k, rule in rules.items()])
    for k, rule in rules.items():
        known = nodes.groupBy(rule(F.col("name")).alias(f"_{k}_name")).agg(F.min("id").alias(f"_{k}"))
        e = e.join(known, f"_{k}_name", "left")
    first = None
    for k in rules:
        first = F.when(F.col(f"_{k}").isNotNull(), k) if first is None else first.when(F.col(f"_{k}").isNotNull(), k)
    return e.select("source", "target", F.coalesce(*[f"_{k}" for k in rules]).alias("found"), first.alias("rule"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree: different neighbours of each node that resolved edges touch, in either direction."""
    e = edges.filter("found IS NOT NULL").select(F.col("source").alias("id"), F.col("found").alias("other"))
    return e.unionAll(e.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge leads to or from."""
    touched = edges.select(F.col("source").alias("id")).unionAll(edges.select(F.col("found").alias("id"))).filter("id IS NOT NULL")
    return nodes.join(touched, "id", "left_anti")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """id, component (its smallest id) of undirected links (source, found): labels spread and shortcut until none changes.

    Each round moves labels over links and then replaces a label by its own label, so the number of
    rounds grows with the logarithm of the longest path; the state is cut to shared storage each round.
    Labels that still change when the rounds run out are an error.
    """
    links = edges.filter("source IS NOT NULL AND found IS NOT NULL").select("source", "found")
    both = cut(links.unionAll(links.select(F.col("found").alias("source"), F.col("source").alias("found"))).distinct())
    label = cut(both.groupBy(F.col("source").alias("id")).agg(F.least(F.min("found"), F.min("source")).alias("component")))
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("id", "found"), "found").groupBy(F.col("source").alias("id")).agg(F.min("component").alias("_near"))
        moved = label.join(near, "id").select("id", F.col("component").alias("_was"), F.least("component", "_near").alias("component"))
        up = moved.select(F.col("id").alias("component"), F.col("component").alias("_up"))
        after = cut(moved.join(up, "component", "left").select("id", "_was", F.least("component", F.coalesce("_up", "component")).alias("component")))
        label = after.select("id", "component")
        if after.filter("component <> _was").isEmpty():
            return label
    raise RuntimeError(f"labels still change after {rounds} rounds; allow more")
