"""Differences between two copies of a table.

Both copies are normalised to the latest row of each key, tagged and put into one union. One
aggregation over all columns then nets the copies against each other: rows with a surplus on the
left are the left copy EXCEPT ALL the right one, rows with a surplus on the right the reverse. Only
those residues, which are as small as the differences, are full-joined by key.

Defined results
* null key parts are keys like any other; two nulls are the same key
* rows sent twice, and older states of a row, don't count; of several rows with the same newest
  version the greatest by value is taken, so the result doesn't depend on the order of the rows
* a null version is older than any other
* an empty copy makes every row of the other one-sided; two empty copies give no rows
* values are compared by code points, without trimming or case folding; two nulls are equal, null
  and the empty text are not
* columns that aren't named as keys, fields or version are ignored, whatever they are called
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIELD, _KIND = "field", "kind"


def digits(column: Column | str) -> Column:
    """The number that a text's ASCII digits make, whatever stands around them, less a fraction of zeros; null without digits, with several numbers or beyond 32 bits."""
    c = F.trim((F.col(column) if isinstance(column, str) else column).cast("string"))
    one = F.regexp_extract(c, r"^[^0-9]*([0-9]+)(?:\.0*)?[^0-9]*$", 1)
    return one.try_cast("int")


def latest(df: DataFrame, keys: Sequence[str], fields: Sequence[str], version: str) -> DataFrame:
    """One row per key, that of the greatest version; an aggregation, so hot keys combine early."""
    newest = F.max(F.struct(F.col(version).alias("_version"), *[F.col(c) for c in fields])).alias("_newest")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_newest.{c}").alias(c) for c in fields])


def except_all_both(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left EXCEPT ALL right`` and the reverse in one pass.

    The columns of both, with ``_surplus``: how many more of the row the left copy has (positive)
    or the right one (negative).
    """
    columns = left.columns
    both = left.select(*columns, F.lit(1).alias("_surplus")).unionAll(right.select(*columns, F.lit(-1).alias("_surplus")))
    return both.groupBy(*columns).agg(F.sum("_surplus").alias("_surplus")).filter(F.col("_surplus") != 0)


def differences(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str], version: str) -> DataFrame:
    """Keys, ``field``, ``kind`` and both values as text.

    ``kind`` is ``missing_left`` (the left copy lacks the key), ``missing_right``, or ``differs``
    with one row per differing field. Both copies need the named columns with equal types.
    """
    residue = except_all_both(latest(left, keys, fields, version), latest(right, keys, fields, version))
    value = F.struct(*[F.col(c).cast("string").alias(c) for c in fields])
    a = residue.filter("_surplus > 0").select(*[F.col(k).alias(f"_l{i}") for i, k in enumerate(keys)], value.alias("_left"))
    b = residue.filter("_surplus < 0").select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], value.alias("_right"))
    on = [F.col(f"_l{i}").eqNullSafe(F.col(f"_r{i}")) for i in range(len(keys))]
    joined = a.join(b, on, "full")

    def entry(field: str, kind: str, lv: Column, rv: Column) -> Column:
        return F.struct(F.lit(field).alias(_FIELD), F.lit(kind).alias(_KIND), lv.alias("left_value"), rv.alias("right_value"))

    nothing = F.lit(None).cast(T.StringType())
    per_field = F.array(*[
        F.when(~F.col(f"_left.{c}").eqNullSafe(F.col(f"_right.{c}")), entry(c, "differs", F.col(f"_left.{c}"), F.col(f"_right.{c}")))
        for c in fields
    ])
    found = (
        F.when(F.col("_left").isNull(), F.array(entry("", "missing_left", nothing, nothing)))
        .when(F.col("_right").isNull(), F.array(entry("", "missing_right", nothing, nothing)))
        .otherwise(F.array_compact(per_field))
    )
    key = [F.when(F.col("_left").isNull(), F.col(f"_r{i}")).otherwise(F.col(f"_l{i}")).alias(k) for i, k in enumerate(keys)]
    return joined.select(*key, F.explode(found).alias("_d")).select(*keys, "_d.*")


def reconciled(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str], tolerance: float) -> DataFrame:
    """Keys, ``field`` and both values of numbers that differ by more than ``tolerance``, or of which one is null; keys of one side only aren't compared."""
    l = left.select(*keys, F.struct(*fields).alias("_l"))
    r = right.select(*keys, F.struct(*fields).alias("_r"))
    each = lambda f: F.struct(F.lit(f).alias("field"), F.col(f"_l.{f}").alias("left_value"), F.col(f"_r.{f}").alias("right_value"))
    rows = l.join(r, list(keys)).select(*keys, F.explode(F.array(*map(each, fields))).alias("_d")).select(*keys, "_d.*")
    one = F.col("left_value").isNull() != F.col("right_value").isNull()
    return rows.filter(one | (F.abs(F.col("left_value") - F.col("right_value")) > tolerance))
