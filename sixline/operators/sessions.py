"""Sessions of events as states: ticks, momentum, packed intents, running bias, history, save strings.

Order within a user is kept by windows over user and day; what the days before hold, their numbers of
events and their last few, is carried by a second window over one row per user and day. So a user
with a large part of all events is spread over their days, and a task never holds a whole history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sixline import tables


def in_order(rows: DataFrame, key: str, bucket: Column, order: Sequence[str], carried: Sequence[str], back: int = 1) -> DataFrame:
    """``rows`` with ``tick``, their number within the key from 1, and ``before``: structs of the columns ``carried`` of up to ``back`` rows before, the latest last.

    The order must be that of the buckets first. Null keys and buckets are values like any other;
    null buckets come first.
    """
    rows = rows.withColumn("_bucket", bucket)
    at = Window.partitionBy(key, "_bucket")
    near = F.collect_list(F.struct(*carried)).over(at.orderBy(*order).rowsBetween(-back, -1))
    local = rows.withColumn("_i", F.row_number().over(at.orderBy(*order))).withColumn("_near", near)
    # The last rows of each bucket; the limit within the window is applied before the shuffle as well.
    last = rows.withColumn("_d", F.row_number().over(at.orderBy(*[F.desc(c) for c in order]))).filter(F.col("_d") <= back)
    ends = last.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_b")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_d")).alias("d"), F.struct(*carried).alias("x")))), lambda e: e["x"]).alias("_ends"))
    counts = rows.groupBy(F.col(key).alias("_key2"), F.col("_bucket").alias("_b2")).agg(F.count(F.lit(1)).alias("_n"))
    each = ends.join(counts, F.col("_key").eqNullSafe(F.col("_key2")) & F.col("_b").eqNullSafe(F.col("_b2")))
    by = Window.partitionBy("_key").orderBy("_b")
    held = each.select(
        "_key", "_b", F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_held"),
        F.flatten(F.collect_list("_ends").over(by.rowsBetween(-back, -1))).alias("_far"),
    )
    j = local.join(held, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    every = F.concat("_far", "_near")
    before = F.slice(every, F.greatest(F.size(every) - back + 1, F.lit(1)), F.lit(back))
    return j.select(*[F.col(c) for c in rows.columns if c != "_bucket"], (F.col("_i") + F.col("_held")).alias("tick"), before.alias("before"))


def md5_axis(text: Column, place: int) -> Column:
    """A number of 0 .. 0.99 from one byte of a text's MD5."""
    return F.conv(F.substring(F.md5(text), place, 2), 16, 10).cast("int") % 100 / F.lit(100.0)


def raw_axes(events: DataFrame) -> DataFrame:
    key = F.col("event_id").cast("string")
    return events.select("event_id", "user_id", "ts", "event_type", "value", md5_axis(key, 1).alias("chaos"), md5_axis(key, 3).alias("whimsy"), md5_axis(key, 5).alias("dark"))


def with_axes(events: DataFrame) -> DataFrame:
    """Events with chaos, whimsy, dark, the tick within their user, and the axes of up to three events ``before``."""
    return in_order(raw_axes(events), "user_id", F.to_date("ts"), ["ts", "event_id"], ["chaos", "whimsy", "dark"], 3)


def with_momentum(rows: DataFrame) -> DataFrame:
    """``chaos_m``: chaos raised by a tenth of the mean of the three events before, where there are three."""
    mean = lambda axis: (F.get("before", 0)[axis] + F.get("before", 1)[axis] + F.get("before", 2)[axis]) / 3
    lift = (mean("chaos") + mean("whimsy")) / 2
    return rows.withColumn("chaos_m", F.when(F.size("before") == 3, F.least(F.lit(1.0), F.col("chaos") + 0.1 * lift)).otherwise(F.col("chaos")))


def packed(rows: DataFrame) -> DataFrame:
    """``bits``: temporal, emotional and action parts in nine bits, and the state and phase they give."""
    temporal = F.pow(F.lit(2), F.col("tick") % 3).cast("int")
    emotional = sum((F.when(F.col(c) > 0.5, v).otherwise(0) for c, v in (("chaos_m", 8), ("whimsy", 16), ("dark", 32))), F.lit(0))
    action = F.when(F.col("event_type").isin("view", "click"), 64).when(F.col("event_type") == "error", 128).otherwise(256)
    bits = (temporal + emotional + action).alias("bits")
    out = rows.select("*", bits)
    return out.withColumn("state", F.col("bits").bitwiseAND(63) + 1).withColumn("phase", (F.shiftright("bits", 6) % 3).cast("int"))


def outcomes(events: DataFrame) -> DataFrame:
    """id, name, action, phase, n, chaos: how often the sessions reach each state."""
    counted = packed(with_momentum(with_axes(events))).groupBy("state", "phase").agg(F.count(F.lit(1)).alias("n"), F.avg("chaos_m").alias("chaos"))
    states = tables.states(events.sparkSession)
    mean = F.floor(F.col("chaos") * 1e6 + 0.5001) / F.lit(1e6)
    return counted.join(F.broadcast(states), counted.state == states.id).select("id", "name", "action", "phase", "n", mean.alias("chaos"))


def _bias(rows: DataFrame) -> tuple[Column, Column]:
    creative = (F.col("chaos") > 0.7) & (F.col("whimsy") > 0.7)
    return creative.cast("long"), (~creative & (F.col("chaos") < 0.3)).cast("long")


def bias(events: DataFrame) -> DataFrame:
    """Per user the final bias of two models: a tenth more for each creative event, else for each precise one."""
    rows = raw_axes(events)
    creative, precise = _bias(rows)
    return rows.groupBy("user_id").agg((1 + F.sum(creative) / F.lit(10.0)).alias("creative"), (1 + F.sum(precise) / F.lit(10.0)).alias("precise"), F.count(F.lit(1)).alias("events"))


def running_bias(events: DataFrame) -> DataFrame:
    """The bias of both models after every event: sums within a user's day, and those of the days before."""
    rows = raw_axes(events)
    creative, precise = _bias(rows)
    rows = rows.select("event_id", "user_id", "ts", creative.alias("c"), precise.alias("p"), F.to_date("ts").alias("_day"))
    own = Window.partitionBy("user_id", "_day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    days = rows.groupBy(F.col("user_id").alias("_u"), F.col("_day").alias("_d")).agg(F.sum("c").alias("c"), F.sum("p").alias("p"))
    before = Window.partitionBy("_u").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    held = days.select("_u", "_d", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_{k}") for k in "cp"])
    j = rows.select("event_id", "user_id", "_day", *[F.sum(k).over(own).alias(k) for k in "cp"]).join(held, F.col("user_id").eqNullSafe(F.col("_u")) & F.col("_day").eqNullSafe(F.col("_d")))
    return j.select("event_id", "user_id", (1 + (F.col("c") + F.col("_c")) / F.lit(10.0)).alias("creative"), (1 + (F.col("p") + F.col("_p")) / F.lit(10.0)).alias("precise"))


def plain_states(events: DataFrame) -> DataFrame:
    """States of events by their own axes, without momentum: no history is needed but the tick."""
    rows = with_axes(events)
    return packed(rows.withColumn("chaos_m", F.col("chaos"))).select("event_id", "user_id", "state", "phase")


def last_events(events: DataFrame, last: int) -> DataFrame:
    """Each user's last events with their ticks and axes."""
    total = events.groupBy(F.col("user_id").alias("_user")).agg(F.count(F.lit(1)).alias("_total"))
    return with_axes(events).join(total, F.col("user_id").eqNullSafe(F.col("_user"))).filter(F.col("tick") > F.col("_total") - last).drop("_user", "_total")


def save_strings(events: DataFrame, last: int = 64) -> DataFrame:
    """Each user's last events as save strings joined in the order of ticks; the array is bounded by ``last``."""
    kept = packed(with_momentum(last_events(events, last)))
    one = F.concat_ws(";", F.concat(F.lit("["), F.col("state").cast("string"), F.lit("]")), F.concat(F.lit("id:"), F.col("event_id").cast("string")), F.concat(F.lit("tmp:"), F.col("phase").cast("string")))
    items = F.transform(F.sort_array(F.collect_list(F.struct("tick", one.alias("s")))), lambda x: x["s"])
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"), F.array_join(items, ";").alias("session"))


def full_save_strings(events: DataFrame) -> DataFrame:
    """Every event's whole save string: state id, its six lines as 1 and -1, temporal phase, axes and origin as JSON."""
    rows = packed(with_momentum(with_axes(events)))
    lines = F.expr("transform(sequence(0, 5), i -> CASE WHEN shiftright(bits, i) % 2 = 1 THEN '1' ELSE '-1' END)")
    em = F.to_json(F.struct("chaos", "whimsy", "dark"))
    origin = F.to_json(F.struct("event_type", "tick"))
    return rows.select("event_id", F.concat(F.lit("[hex];id:"), F.col("bits").cast("string"), F.lit(";yao:"), F.array_join(lines, ","), F.lit(";tmp:"), F.col("phase").cast("string"), F.lit(";em:"), em, F.lit(";prv:"), origin).alias("save_string"))


def timeseries(events: DataFrame) -> DataFrame:
    """user_id, tick, and the change of each axis from the tick before."""
    rows = with_axes(events)
    delta = lambda c: F.floor((F.col(c) - F.get("before", F.size("before") - 1)[c]) * 1e6 + 0.5001) / F.lit(1e6)
    return rows.select("user_id", "tick", "event_id", *[delta(c).alias(f"d_{c}") for c in ("chaos", "whimsy", "dark")])
