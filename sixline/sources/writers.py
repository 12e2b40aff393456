"""Sinks: distributed writers, and small documents whose bound is checked before the driver writes them."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a document written by the driver may have.
DOCUMENT_ROWS = 10_000


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines, replacing or added to what is there."""
    df.write.mode("append" if append else "overwrite").json(path)


def csv(df: DataFrame, path: str, text_limit: int | None = None) -> None:
    """CSV with header; with ``text_limit`` texts are shortened to it."""
    kinds = dict(df.dtypes)
    out = df.select(*[F.substring(c, 1, text_limit).alias(c) if text_limit and kinds[c] == "string" else F.col(c) for c in df.columns])
    out.write.mode("overwrite").option("header", True).csv(path)


def once(df: DataFrame, path: str) -> None:
    """Written only if nothing is there yet."""
    df.write.mode("ignore").json(path)


def bounded(df: DataFrame, limit: int = DOCUMENT_ROWS) -> list[dict]:
    """The rows as dictionaries; more than ``limit`` are an error, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows for a document; write it with a distributed sink")
    return [r.asDict(recursive=True) for r in rows]


def document(df: DataFrame, path: str) -> None:
    """One indented JSON document."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(bounded(df), f, ensure_ascii=False, indent=2, default=str)


def bundle(manifest: DataFrame, samples: DataFrame, path: str, most: int = 8) -> None:
    """A ZIP of the manifest and the first samples by id."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("manifest.json", json.dumps(bounded(manifest), ensure_ascii=False, default=str))
        for i, row in enumerate(bounded(samples.limit(most))):
            buffer = io.StringIO()
            json.dump(row, buffer, ensure_ascii=False, default=str)
            z.writestr(f"samples/{i:02d}.json", buffer.getvalue())


def partitioned(df: DataFrame, path: str, *columns: str) -> None:
    """Parquet by partition columns, one writer task per partition value and hash bucket."""
    df.write.mode("overwrite").partitionBy(*columns).parquet(path)


def append_run(df: DataFrame, path: str, run: str) -> None:
    """Rows of one run added to a table of runs; a run that is there already is replaced, so a repeated job adds nothing twice."""
    df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def rewritten(df: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the rows of ``updates`` in place of those of their keys, and new ones added; write it as a new version."""
    return df.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(updates, allowMissingColumns=True)
