"""Sources: each returns a DataFrame with a fixed schema; a missing path gives an empty one where said so."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sixline.operators.text import front_matter


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a path, local or of any Hadoop file system, has files."""
    if "://" not in path and "*" not in path:
        return os.path.exists(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return bool(found)


def keyed_json(spark: SparkSession, path: str, value: T.StructType, key: str = "id") -> DataFrame:
    """A JSON object of objects as rows (key, fields of the object); missing or broken files have no rows."""
    if not _there(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField(key, T.StringType()), *value.fields]))
    whole = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", T.MapType(T.StringType(), value))
    return whole.select(F.explode(parsed).alias(key, "_v")).select(key, "_v.*")


def json_items(spark: SparkSession, path: str, field: str, item: T.StructType) -> DataFrame:
    """The elements of the array ``field`` of JSON documents (items, rows, coordinates, runs)."""
    if not _there(spark, path):
        return spark.createDataFrame([], item)
    schema = T.StructType([T.StructField(field, T.ArrayType(item)), T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode(field).alias("_v")).select("_v.*")


def broken(spark: SparkSession, path: str) -> DataFrame:
    """(path, reason): files that a JSON source would take as empty because they aren't one JSON value."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    from sixline.operators.dewey import rejects

    return rejects(whole, ["path"], "value")


def audit(spark: SparkSession, root: str, expected: DataFrame) -> DataFrame:
    """(path, length, status) of the files that ``expected`` (path relative to ``root``) names: ``ok``, ``empty`` or ``missing``; looked up by the executors."""
    import pyarrow as pa

    def look(batches):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            found = system.get_file_info([f"{at.rstrip('/')}/{p}" for p in batch.column(0).to_pylist()])
            sizes = [f.size if f.is_file else None for f in found]
            status = ["missing" if n is None else "ok" if n else "empty" for n in sizes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(status, pa.string())], ["path", "length", "status"])

    return expected.filter("path IS NOT NULL").select("path").distinct().mapInArrow(look, "path string, length long, status string")


def code_metadata(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes, chars, line_breaks) of source files."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return whole.select(F.input_file_name().alias("path"), F.octet_length("value").alias("bytes"), F.length("value").alias("chars"), (F.length("value") - F.length(F.replace("value", F.lit("\n"), F.lit("")))).alias("line_breaks"))


def _values(rows: DataFrame, whole: bool) -> DataFrame:
    """``record`` as JSON text: of whole documents their list, items, rows or themselves; of what is no document, and of lines, each line that is one value."""
    import json
    from collections.abc import Iterator

    import pyarrow as pa

    from sixline.operators.jsontext import Reader

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader().read

        def lines(text: str):
            for line in text.splitlines():
                ok, value = read(line)
                if ok:
                    yield value

        def of(text: str):
            ok, value = read(text) if whole else (False, None)
            if not ok:
                yield from lines(text)
                return
            if isinstance(value, dict):
                value = next((value[k] for k in ("items", "rows") if isinstance(value.get(k), list)), [value])
            yield from value if isinstance(value, list) else [value]

        for batch in batches:
            for text in batch.column(0):
                made = [json.dumps(v) for v in of(text.as_py() or "")]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["record"])

    return rows.select("value").mapInArrow(run, "record string").select(F.parse_json("record").alias("record"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Records of any of the shapes list, {items}, {rows}, single object or JSON lines, each as one VARIANT ``record``.

    A file that is one JSON value from end to end is taken as a document, else line by line; what
    doesn't parse is left out. Files named .jsonl or .ndjson are read as lines, and so may have any size.
    """
    if path.rstrip("*/").endswith((".jsonl", ".ndjson")):
        return _values(spark.read.text(path), False)
    return _values(spark.read.text(path, wholetext=True), True)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, broken ones give nulls."""
    return spark.read.schema(schema).json(path)


def csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with header by a given schema: nothing is inferred, so bit strings keep their zeros."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): non-blank lines."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), "value").filter(F.trim("value") != "")


def delimited(spark: SparkSession, path: str, mark: str = "\n§\n") -> DataFrame:
    """(path, place, entry): the entries of files that a mark divides."""
    whole = spark.read.text(path, wholetext=True)
    parts = whole.select(F.input_file_name().alias("path"), F.posexplode(F.split("value", mark)).alias("place", "entry"))
    return parts.select("path", "place", F.trim("entry").alias("entry")).filter("entry <> ''")


def skills(spark: SparkSession, root: str, name: str = "SKILL.md") -> DataFrame:
    """(path, related, body) of every file ``name`` below ``root``, with its front matter read."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name)
    related, body = front_matter(F.col("value"))
    return files.select(F.input_file_name().alias("path"), related.alias("related"), body.alias("body"))


def wikitext(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, headings, formulas) of wikitext files."""
    whole = spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
    return whole.select(F.input_file_name().alias("path"), "text", F.regexp_extract_all("text", F.lit(r"(?m)^=+ *([^=\n]+?) *=+ *$"), F.lit(1)).alias("headings"), F.regexp_extract_all("text", F.lit(r"(?s)<math[^>]*>(.*?)</math>"), F.lit(1)).alias("formulas"))


def lua(spark: SparkSession, path: str) -> DataFrame:
    """(path, functions, requires, lines) of Lua files."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.input_file_name().alias("path"), F.regexp_extract_all("value", F.lit(r"function\s+(\w+)"), F.lit(1)).alias("functions"), F.regexp_extract_all("value", F.lit("require\\(['\"]([^'\"]+)"), F.lit(1)).alias("requires"), F.size(F.split("value", "\n")).alias("lines"))


def file_metadata(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, modificationTime) of files; their content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length", "modificationTime")


#: Sources by name, for pipelines that name them in a parameter.
REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "keyed_json": keyed_json, "json_items": json_items, "records": records, "json_lines": json_lines, "csv": csv_table, "text": text_lines,
    "delimited": delimited, "skills": skills, "wikitext": wikitext, "lua": lua, "files": file_metadata, "code": code_metadata, "broken": broken,
}


def source(name: str) -> Callable[..., DataFrame]:
    """A registered source; an unknown name is an error."""
    if name not in REGISTRY:
        raise ValueError(f"unknown source {name!r}: one of {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]
