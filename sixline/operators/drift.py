"""Schemas that drift between files.

Each record is loaded as a map from path to value with its raw JSON type, nested objects by their
paths. One pass gathers statistics by file and path: how often it is there, with which types, and how
many of its values read as flags or directions. They are summed up within each Arrow batch first, so
what is shuffled has the size of the schemas. The statistics tell which path stands for which field;
files of a feed are then compared in their order, and the records are projected onto one set of typed
columns with those same paths, with a report of the values that don't cast.

Defined results
* a record counts if it is one JSON object; null, empty, cut or otherwise broken records, arrays,
  scalars, and objects with something behind them don't parse and are only counted; of a repeated key
  the last value counts
* a key with nothing but nulls is a field of unknown type: it is there, but is never retyped
* an integer is a number without decimal point or exponent; other numbers are decimals
* a field's own name is that field whatever its values; other names are it if at least half of their
  values cast; a name that says nothing is the direction if all of its values cast and it can't be a flag
* if several paths of a file mean one field, its own name comes first, then the least deep, the one with
  the most values, the first by name: the report has the first, a line the first that it has a value of
* a file without parsing records lacks every field
* files with equal release time are ordered by file id; a null release time comes first
* records delivered twice in a file give one line (that of the smallest row number)
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sixline.operators.jsontext import Reader, plain

#: Names, in lower case without signs, and parts of names by which a key may be a field.
FIELDS = {
    "direction": (["dir", "heading", "movement", "motion", "trend", "tendency", "course", "bearing", "drift", "flow"], ["direction"]),
    "is_stressed": ([], ["stress"]),
    "is_activated": ([], ["activ"]),
}
#: Other columns of a line and the keys they go by, written likewise.
OTHERS = {
    "hexagram_id": ["hexagramid", "id"],
    "hexagram_name": ["hexagramname", "name"],
    "line_number": ["linenumber", "line"],
    "position": ["position"],
    "trigram": ["trigram"],
    "base_state": ["basestate"],
    "ternary_state": ["ternarystate"],
    "category": ["category"],
    "hexagram_binary": ["hexagrambinary", "binary"],
}
#: How the flags and directions are written.
TRUE = ["true", "t", "yes", "y", "1", "1.0", "on"]
FALSE = ["false", "f", "no", "n", "0", "0.0", "off"]
RISING = ["rising", "rise", "up", "r", "+", "+1", "1", "1.0", "↑", "▲", "asc"]
FALLING = ["falling", "fall", "down", "f", "-", "-1", "-1.0", "2", "2.0", "↓", "▼", "desc"]
STABLE = ["stable", "still", "steady", "flat", "level", "s", "=", "0", "0.0", "·", "→", "-0.0", "none"]

TYPES = ["string", "boolean", "integer", "decimal", "array", "object"]
_FLAGS, _RISING, _FALLING, _STABLE = {*TRUE, *FALSE}, {*RISING}, {*FALLING}, {*STABLE}
_LONGEST = max(map(len, [*_FLAGS, *_RISING, *_FALLING, *_STABLE]))


class _Decimal(float):
    """A number with a point or an exponent, as it is written."""

    def __new__(cls, text: str):
        made = super().__new__(cls, text)
        made.text = text
        return made


def _reader() -> Reader:
    return Reader(int, _Decimal)


def _kind(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, str):
        return "string"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "decimal"
    return "array" if isinstance(value, list) else "object"


def _text(value) -> str | None:
    """A value as text: numbers as they are written, arrays and objects as JSON."""
    if value is None:
        return None
    if isinstance(value, str):
        return plain(value)
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, _Decimal):
        return value.text
    if isinstance(value, int):
        return str(value)
    import json

    return json.dumps(value, ensure_ascii=True)


def leaves(record: dict) -> Iterator[tuple[str, object]]:
    """(path, value) of what a record holds: members of nested objects by their paths, arrays and empty objects as values."""
    stack = [("", record)]
    while stack:
        prefix, held = stack.pop()
        for key, value in held.items():
            path = f"{prefix}.{key}" if prefix else key
            if isinstance(value, dict) and value:
                stack.append((path, value))
            else:
                yield path, value


def paths(records: DataFrame) -> DataFrame:
    """file_id, row_no, path, type, value: the maps of the records that parse, one row per record and path."""
    fields = [records.schema["file_id"], records.schema["row_no"]]
    schema = T.StructType(fields + T.StructType.fromDDL("path string, type string, value string").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader().read
        for batch in batches:
            at, out = [], ([], [], [])
            for i, text in enumerate(batch.column(2).to_pylist()):
                ok, record = read(text)
                for path, value in leaves(record) if ok and isinstance(record, dict) else ():
                    at.append(i)
                    for column, v in zip(out, (plain(path), _kind(value), _text(value))):
                        column.append(v)
            taken = [batch.column(k).take(pa.array(at, pa.int32())) for k in range(2)]
            yield pa.RecordBatch.from_arrays(taken + [pa.array(c, pa.string()) for c in out], schema.names)

    return records.select("file_id", "row_no", "record").mapInArrow(run, schema)


_COUNTS = ["rows", *TYPES, "flags", "directions", "classes"]


def file_statistics(records: DataFrame) -> DataFrame:
    """Per file and path: rows, values by type, values that read as a flag or a direction, and which directions are among them (bits)."""
    schema = T.StructType([records.schema["file_id"], *T.StructType.fromDDL("path string, " + ", ".join(f"{c} long" for c in _COUNTS)).fields])
    place = {t: 1 + i for i, t in enumerate(TYPES)}

    def reads(text: str) -> tuple[int, int, int]:
        t = text.strip().lower()
        bits = (t in _RISING) | (t in _FALLING) << 1 | (t in _STABLE) << 2
        return int(t in _FLAGS), int(bits > 0), bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, known = _reader().read, {}
        for batch in batches:
            stats: dict[tuple, list[int]] = {}
            where: dict[tuple, int] = {}
            for i, (file, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                ok, record = read(text)
                if not ok or not isinstance(record, dict):
                    continue
                for path, value in leaves(record):
                    row = stats.get((file, path))
                    if row is None:
                        row = stats[file, path] = [0] * len(_COUNTS)
                        where[file, path] = i
                    row[0] += 1
                    if value is None:
                        continue
                    row[place[_kind(value)]] += 1
                    if isinstance(value, (list, dict)):
                        continue
                    t = _text(value)
                    seen = known.get(t)
                    if seen is None:
                        seen = reads(t)
                        if len(t) <= 2 * _LONGEST and len(known) < 50_000:
                            known[t] = seen
                    row[7] += seen[0]
                    row[8] += seen[1]
                    row[9] |= seen[2]
            if stats:
                taken = batch.column(0).take(pa.array([where[k] for k in stats], pa.int32()))
                counts = [pa.array(c, pa.int64()) for c in zip(*stats.values())]
                yield pa.RecordBatch.from_arrays([taken, pa.array([plain(p) for _, p in stats], pa.string()), *counts], schema.names)

    parts = records.select("file_id", "record").mapInArrow(run, schema)
    sums = [(F.bit_or if c == "classes" else F.sum)(c).alias(c) for c in _COUNTS]
    return parts.groupBy("file_id", "path").agg(*sums)


def _plain_name(path: Column) -> Column:
    return F.translate(F.lower(F.substring_index(path, ".", -1)), "_- /", "")


def meanings(stats: DataFrame) -> DataFrame:
    """``stats`` with values, type, field and rank (0 the field's own name, 1 another name of it, 2 by its values); null field and rank for none."""
    name = _plain_name(F.col("path"))
    values = sum((F.col(t) for t in TYPES[1:]), F.col(TYPES[0]))
    s = stats.withColumn("values", values)
    s = s.withColumn("type", F.greatest(*[F.when(F.col(t) > 0, F.struct(F.col(t).alias("n"), F.lit(t).alias("t"))) for t in TYPES])["t"])
    found = F.lit(None).cast("struct<field:string,rank:int>")
    made = lambda field, rank: F.struct(F.lit(field).alias("field"), F.lit(rank).alias("rank"))
    # All of the values are directions, of two kinds at least, and they aren't all flags as well.
    two = F.bit_count("classes") >= 2
    found = F.when((F.col("values") > 0) & (F.col("directions") == F.col("values")) & (F.col("flags") < F.col("values")) & two, made("direction", 2)).otherwise(found)
    for field, (names, parts) in FIELDS.items():
        cast = F.col("directions" if field == "direction" else "flags")
        named = name.isin(names) if names else F.lit(False)
        for part in parts:
            named = named | name.contains(part)
        found = F.when(named & ((F.col("values") == 0) | (cast * 2 >= F.col("values"))), made(field, 1)).otherwise(found)
    for field, names in OTHERS.items():
        found = F.when(name.isin(names), made(field, 1)).otherwise(found)
    for field in [*FIELDS, *OTHERS]:
        found = F.when(name == field.replace("_", ""), made(field, 0)).otherwise(found)
    return s.withColumn("_f", found).select(*s.columns, "_f.field", "_f.rank")


def _order() -> Column:
    """Which of several paths for one field comes first."""
    return F.struct("rank", F.length(F.regexp_replace("path", "[^.]", "")).alias("depth"), (-F.col("values")).alias("values"), F.col("path").alias("name"), "type")


def file_fields(records: DataFrame, every: bool = False) -> DataFrame:
    """file_id, field, name, type: one row per file and field it has; with ``every``, paths of no known field are fields by their own names."""
    known = meanings(file_statistics(records))
    known = known.withColumns({"field": F.coalesce("field", "path"), "rank": F.coalesce("rank", F.lit(9))}) if every else known.filter("field IS NOT NULL")
    return known.groupBy("file_id", "field").agg(F.min(_order()).alias("c")).select("file_id", "field", "c.name", "c.type")


def changes(files: DataFrame, records: DataFrame, every: bool = False) -> DataFrame:
    """file_id, field, change and both names and types, comparing each file with the one before it in its feed.

    The three fields of :data:`FIELDS`; with ``every``, all that any file of the feed has.
    """
    has = file_fields(records, every)
    own = files.select("file_id", "feed", "released_at")
    if every:
        each = own.join(own.select("file_id", "feed").join(has, "file_id").select("feed", "field").distinct(), "feed")
    else:
        has = has.filter(F.col("field").isin(list(FIELDS)))
        each = own.withColumn("field", F.explode(F.array(*[F.lit(f) for f in FIELDS])))
    here = each.join(has, ["file_id", "field"], "left")
    w = Window.partitionBy("feed", "field").orderBy("released_at", "file_id")
    before = here.select(
        "file_id", "field", "name", "type",
        F.lag("name").over(w).alias("before_name"), F.lag("type").over(w).alias("before_type"), F.row_number().over(w).alias("_n"),
    ).filter("_n > 1")
    had, have = F.col("before_name").isNotNull(), F.col("name").isNotNull()
    kinds = F.array_compact(F.array(
        F.when(~had & have, F.lit("added")),
        F.when(had & ~have, F.lit("removed")),
        F.when(had & have & (F.col("name") != F.col("before_name")), F.lit("renamed")),
        F.when(had & have & (F.col("type") != F.col("before_type")), F.lit("retyped")),
    ))
    return before.select("file_id", "field", F.explode(kinds).alias("change"), "before_name", "name", "before_type", "type")


def _flag(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    return F.when(low.isin(TRUE), True).when(low.isin(FALSE), False)


def _direction(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    return F.when(low.isin(RISING), "rising").when(low.isin(FALLING), "falling").when(low.isin(STABLE), "stable")


def _typed(field: str, raw: Column) -> Column:
    if field == "direction":
        return _direction(raw)
    if field in FIELDS:
        return _flag(raw)
    return raw.try_cast("int") if field in ("hexagram_id", "line_number") else raw


def _raw(records: DataFrame) -> DataFrame:
    """file_id, row_no, one text column per field from the path that its file has for it, and the other paths as a map ``others``; ``_ok`` is false where a record doesn't parse."""
    fields = [*OTHERS, *FIELDS]
    # One row per file, of as many entries as it has paths for the fields, in their order.
    known = meanings(file_statistics(records)).filter("field IS NOT NULL")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(_order().alias("o"), "path", "field"))), lambda e: F.struct(e["path"].alias("path"), e["field"].alias("field")))
    # As text: what a file's rows have in common is read once for all of them.
    chosen = known.groupBy("file_id").agg(F.to_json(ordered).alias("_paths"))
    rows = records.select("file_id", "row_no", "record").join(chosen, "file_id", "left").select("file_id", "row_no", "record", "_paths")
    schema = T.StructType([*rows.schema.fields[:2], *T.StructType.fromDDL("_ok boolean, " + ", ".join(f"{f} string" for f in fields) + ", others map<string,string>").fields])
    slot = {f: i for i, f in enumerate(fields)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        read, plans = _reader().read, {None: []}
        for batch in batches:
            good, out, others = [], [[] for _ in fields], []
            for text, entries in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                ok, record = read(text)
                ok = ok and isinstance(record, dict)
                held = {plain(path): _text(value) for path, value in leaves(record)} if ok else {}
                row = [None] * len(fields)
                plan = plans.get(entries)
                if plan is None:
                    if len(plans) > 10_000:
                        plans = {None: []}
                    plan = plans[entries] = [(e["path"], slot[e["field"]]) for e in json.loads(entries)]
                for path, i in plan:
                    value = held.pop(path, None)
                    if row[i] is None:
                        row[i] = value
                good.append(ok)
                others.append(list(held.items()))
                for column, v in zip(out, row):
                    column.append(v)
            made = [pa.array(good, pa.bool_()), *[pa.array(c, pa.string()) for c in out], pa.array(others, pa.map_(pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], schema.names)

    return rows.mapInArrow(run, schema)


def lines(records: DataFrame) -> DataFrame:
    """One typed table of all yao lines, whatever the files call the fields and write the values; ``others`` has what is no field."""
    fields = [*OTHERS, *FIELDS]
    once = records.groupBy("file_id", "record").agg(F.min("row_no").alias("row_no"))
    return _raw(once).filter("_ok").select("file_id", "row_no", *[_typed(f, F.col(f)).alias(f) for f in fields], "others")


def cast_failures(records: DataFrame) -> DataFrame:
    """file_id, field, rows: values present that don't cast to the field's type; and records that don't parse as field ''."""
    fields = [*OTHERS, *FIELDS]
    lost = F.array_compact(F.array(F.when(~F.col("_ok"), F.lit("")), *[F.when(F.col(f).isNotNull() & _typed(f, F.col(f)).isNull(), F.lit(f)) for f in fields]))
    return _raw(records).select("file_id", F.explode(lost).alias("field")).groupBy("file_id", "field").agg(F.count(F.lit(1)).alias("rows"))
