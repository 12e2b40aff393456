"""Mixing sources to target weights.

Documents are counted by source and exact token length. The size of a mix is the greatest at which
no source needs more than its tokens times ``max_repeats``. A source's budget is met by whole passes
over it plus a rest, and the rest by subset-sum fitting on the length counts: every length gives the
same share of its documents, rounded down, and what remains is fitted by a bounded knapsack over the
documents left. Which documents of a length are taken follows a seeded hash of mix and document, by
ranks that are computed in buckets, so no source or length is gathered in one task.

Defined results
* weights are relative within a mix; null, zero and negative weights get nothing; a source that no
  document has, or has only empty texts of, keeps its target and reaches 0, the others keep their
  proportions to each other
* a null ``max_repeats`` is no cap, below 1 means the source isn't used; if no source of a mix has a
  cap, the mix has the size of its sources together
* several target rows of one mix and source count as one: weights added, the lowest cap
* null and empty texts have no tokens and are never taken; a null source is no source
* every copy of a document under another id is a document of its own; rows that repeat an id are one
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sixline.llm.tokens import FOLDER, sizes
from sixline.session import cut_columnar

SEED = 17
#: Buckets into which a length's documents are ranked; more of them for larger corpora only divides the work further.
BUCKETS = 64
#: Tokens, at least, that are left to the knapsack to fit.
SLACK = 2048


def fit(lengths: list[int], counts: list[int], budget: int, seed: int = SEED) -> list[int]:
    """How many documents of each length to take so that their tokens are as near to ``budget`` as the fitting finds.

    A systematic sample over the lengths, in order, takes all but the slack; the knapsack fits the
    rest from the documents left, whose lengths come in a seeded order, so neither prefers a length.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget <= 0 or total <= 0:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    slack = max(SLACK, 4 * total // sum(counts))
    goal, before, take = max(0, budget - slack), 0, []
    for c in counts:
        take.append((before + c) * goal // total - before * goal // total)
        before += c
    left = budget - sum(n * t for n, t in zip(lengths, take))
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i] * 2654435761 + seed) % 4294967291)
    for i in order:
        if left >= 0:
            break
        less = min(take[i], -(left // lengths[i]))
        take[i] -= less
        left += less * lengths[i]
    # Bounded knapsack: bit b of reach tells that b tokens can be made; counts go in by powers of two.
    limit = left + max(lengths)
    mask = (1 << (limit + 1)) - 1
    reach, steps = 1, []
    for i in order:
        free, k = min(counts[i] - take[i], limit // lengths[i]), 1
        while free > 0:
            k = min(k, free)
            more = reach | (reach << (k * lengths[i])) & mask
            if more != reach:
                steps.append((i, k, reach))
                reach = more
            free -= k
            k *= 2
        if reach >> left & 1:
            break
    below = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    over = reach >> (left + 1)
    above = left + 1 + (over & -over).bit_length() - 1 if over else None
    at = below if above is None or left - below <= above - left else above
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= k * lengths[i]
    return take


def _sized(documents: DataFrame, names: list[str], folder: str) -> DataFrame:
    """doc_id, source, tokenizer, tokens of the documents that have any, written once."""
    one = documents.filter("source IS NOT NULL").select("doc_id", "source", "text")
    wide = cut_columnar(sizes(one, ["doc_id", "source"], "text", names, folder), "sizes")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("tokenizer"), F.col(f"n_{i}").alias("tokens")) for i, n in enumerate(names)])).alias("s")
    return wide.select("doc_id", "source", each).select("doc_id", "source", "s.tokenizer", "s.tokens").filter("tokens > 0")


def _targets(targets: DataFrame) -> DataFrame:
    weight = F.greatest(F.coalesce(F.col("target_weight"), F.lit(0.0)), F.lit(0.0))
    cap = F.min(F.coalesce(F.col("max_repeats").cast("double"), F.lit(float("inf"))))
    one = targets.filter("source IS NOT NULL").groupBy("mix_id", "tokenizer", "source").agg(F.sum(weight).alias("weight"), F.greatest(cap, F.lit(0.0)).alias("cap"))
    mix = Window.partitionBy("mix_id", "tokenizer")
    return one.withColumn("target_share", F.col("weight") / F.nullif(F.sum("weight").over(mix), F.lit(0.0)))


def budgets(targets: DataFrame, totals: DataFrame) -> DataFrame:
    """mix_id, tokenizer, source, weight, cap, target_share, available, budget: tokens that each source shall give."""
    mix = Window.partitionBy("mix_id", "tokenizer")
    t = _targets(targets).join(totals, ["tokenizer", "source"], "left").withColumn("available", F.coalesce("available", F.lit(0)))
    usable = (F.col("weight") > 0) & (F.col("available") > 0) & (F.col("cap") >= 1)
    whole = F.sum(F.when(usable, F.col("available"))).over(mix) / F.sum(F.when(usable, F.col("weight"))).over(mix)
    scarce = F.min(F.when(usable & (F.col("cap") < float("inf")), F.col("available") * F.floor("cap") / F.col("weight"))).over(mix)
    scale = F.coalesce(scarce, whole)
    return t.withColumn("budget", F.when(usable, F.floor(F.col("weight") * scale + 0.5)).otherwise(0).cast("long"))


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_id, tokenizer, source, tokens, passes, extra: whole passes, and how many documents of this length get one more."""
    counts = sized.groupBy("source", "tokenizer", "tokens").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("source", "tokenizer").agg(F.sum(F.col("tokens") * F.col("n")).alias("available"))
    due = budgets(targets, totals).filter("budget > 0").select("mix_id", "tokenizer", "source", "cap", "available", "budget")

    def fitted(frame):
        import pandas as pd

        row = frame.iloc[0]
        frame = frame.sort_values("tokens")
        passes = int(min(row["budget"] // row["available"], row["cap"]))
        rest = 0 if passes >= row["cap"] else int(row["budget"]) - passes * int(row["available"])
        lengths, n = frame["tokens"].astype(int).tolist(), frame["n"].astype(int).tolist()
        return pd.DataFrame({
            "mix_id": frame["mix_id"], "tokenizer": frame["tokenizer"], "source": frame["source"], "tokens": frame["tokens"],
            "passes": passes, "extra": fit(lengths, n, rest),
        })

    out = "mix_id string, tokenizer string, source string, tokens long, passes long, extra long"
    return counts.join(due, ["tokenizer", "source"]).groupBy("mix_id", "tokenizer", "source").applyInPandas(fitted, out)


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``rank`` from 1 by ``_hash`` within the keys: ranked in buckets of the hash, plus what the buckets before hold."""
    rows = rows.withColumn("_bucket", F.floor(F.col("_hash") / F.lit(2.0**64 / BUCKETS)).cast("int"))
    held = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = held.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_n")).drop("_n")
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_hash", "doc_id"))
    return rows.withColumn("_local", local).join(before, [*keys, "_bucket"]).withColumn("rank", F.col("_local") + F.col("_before")).drop("_local", "_before", "_bucket")


def mix(documents: DataFrame, targets: DataFrame, folder: str = FOLDER, seed: int = SEED) -> DataFrame:
    """mix_id, source, doc_id, tokens, times: how often each document is used in each mix."""
    names = [r[0] for r in targets.select("tokenizer").filter("tokenizer IS NOT NULL").distinct().orderBy("tokenizer").collect()]
    if not names:
        names = ["byte_bpe_50k"]
    sized = _sized(documents, names, folder)
    due = plan(sized, targets)
    keys = ["mix_id", "tokenizer", "source", "tokens"]
    rows = sized.join(due, ["tokenizer", "source", "tokens"]).withColumn("_hash", F.xxhash64("mix_id", "doc_id", F.lit(seed)))
    ranked = _ranked(rows.filter("passes > 0 OR extra > 0"), keys)
    times = F.col("passes") + F.when(F.col("rank") <= F.col("extra"), 1).otherwise(0)
    return ranked.select("mix_id", "source", "doc_id", "tokens", times.alias("times")).filter("times > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_id, source, target_share, share, tokens, documents, max_times: what each source reached, beside its target."""
    got = mixed.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("times").alias("max_times"))
    t = _targets(targets).join(got, ["mix_id", "source"], "left")
    all_tokens = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return t.select(
        "mix_id", "source", F.round("target_share", 6).alias("target_share"), F.round(F.coalesce(F.col("tokens") / all_tokens, F.lit(0.0)), 6).alias("share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("max_times", F.lit(0)).alias("max_times"),
    )
