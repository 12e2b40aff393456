"""Schedule texts as columns: intervals and five-field times of day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval_text(minutes: Column) -> Column:
    """``every Nh`` for whole hours, else ``every Nm``."""
    hours = (minutes / 60).cast("int").cast("string")
    return F.when(minutes % 60 == 0, F.concat(F.lit("every "), hours, F.lit("h"))).otherwise(F.concat(F.lit("every "), minutes.cast("string"), F.lit("m")))


def interval_seconds(text: Column, least: int = 60, most: int = 3600) -> Column:
    """Seconds of ``every Nm`` or ``every Nh`` within the bounds; null for other texts."""
    n = F.regexp_extract(text, r"^every\s+(\d+)\s*[mh]$", 1).try_cast("long")
    return F.greatest(F.lit(least), F.least(F.lit(most), n * F.when(text.endswith("h"), 3600).otherwise(60))) + n * 0


def daily(text: Column) -> Column:
    """minute and hour of a five-field schedule with both as numbers; 08:00 for all others."""
    parts = F.split(F.trim(text), r"\s+")
    field = lambda i, top: F.when(F.size(parts) == 5, F.get(parts, i)).try_cast("int").between(0, top)
    good = F.coalesce(field(0, 59) & field(1, 23), F.lit(False))
    return F.struct(F.when(good, F.get(parts, 0).try_cast("int")).otherwise(0).alias("minute"), F.when(good, F.get(parts, 1).try_cast("int")).otherwise(8).alias("hour"))
