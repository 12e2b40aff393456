"""As-of and nearest-in-time joins without a range join.

Both sides go into one stream per key and time bucket; a window carries the last row of the right
side forward. What the buckets before hold is carried by a second window over one row per key and
bucket. A hot key is thus spread over its buckets, and no row is compared with all others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: Sequence[str], bucket_days: int = 1, forward: bool = False) -> DataFrame:
    """``left`` with ``matched_time`` and the ``values`` of the latest right row of its key not after it (``forward``: the earliest not before).

    Left rows with a null key or time have no match; of right rows with equal times the greatest by
    value counts. Columns of both sides may have equal names: the right's get the prefix ``matched_``.
    """
    day = lambda c: F.floor(F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")) / bucket_days) * (-1 if forward else 1)
    order = (lambda c: F.col(c).desc()) if forward else (lambda c: F.col(c).asc())
    item = F.struct(F.col(right_time).alias("time"), *[F.col(v).alias(v) for v in values])
    kind = right.select(item.alias("x")).schema["x"].dataType
    l = left.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.col(left_time).alias("_t"), day(left_time).alias("_bucket"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_item"))
    r = right.filter(F.col(key).isNotNull() & F.col(right_time).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(right_time).alias("_t"), day(right_time).alias("_bucket")).agg(F.max(item).alias("_item"))
    r = r.select(F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), "_key", "_t", "_bucket", F.lit(0).alias("_side"), "_item")
    # Rows that can't have a match stay out of the windows, where they would all meet in one group.
    apart = F.col("_key").isNull() | F.col("_t").isNull()
    unmatched = l.filter(apart).select("_row.*", F.lit(None).cast(right.schema[right_time].dataType).alias("matched_time"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"matched_{v}") for v in values])
    both = l.filter(~apart).unionAll(r)
    within = Window.partitionBy("_key", "_bucket").orderBy(order("_t"), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("_found", F.last("_item", ignorenulls=True).over(within))
    ends = r.groupBy("_key", "_bucket").agg((F.min_by if forward else F.max_by)("_item", "_t").alias("_end"))
    buckets = both.select("_key", "_bucket").distinct().join(ends, ["_key", "_bucket"], "left")
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select("_key", "_bucket", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    out = near.filter("_side = 1").join(carried, ["_key", "_bucket"], "left").withColumn("_m", F.when(F.col("_t").isNotNull(), F.coalesce("_found", "_carried")))
    return out.select("_row.*", F.col("_m.time").alias("matched_time"), *[F.col(f"_m.{v}").alias(f"matched_{v}") for v in values]).unionAll(unmatched)
