"""Spreading a scan over the cluster before costly work per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    A scan of few files has few partitions, however many cores there are. Such a scan is small
    against the cluster, so moving its rows once costs less than leaving cores idle; a scan with
    enough partitions is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, F.xxhash64(key))
