"""Deeply nested JSON documents as related flat tables, by Dewey labels.

A walk over each document gives every node its Dewey label, the list of ordinals on the way from the
root ([0, 2, 5]). Parent links are derived by truncation: a node's label without its last ordinals, as
far as the nearest record of the document above it, is its parent's; so no join is needed. Nodes are grouped by schema path (member names, ``[]`` for every array, ``{}`` for members
that data name) into tables: :func:`tables` finds all of them, the functions below it take those of
the two document kinds. The walk is one pass over Arrow batches without a shuffle, holds its place on
a stack of its own, so no depth is too great, and makes labels only of the nodes it gives back.

Defined results
* documents that don't parse (null, empty, cut, more than one value) give no nodes; :func:`rejects` has them with the reason
* a document, or a member named in ``OPEN``, that is a text holding JSON is opened in place
* an absent or null part gives no rows below it; null elements keep their ordinal and are nodes of kind ``null``
* numbers keep the text by which they are written
* if an object repeats a key, its last value counts, at the first's ordinal
* the document's own keys and further columns stay apart from labels: key columns are passed by name
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sixline.operators.jsontext import Reader, plain

#: Members whose text value is a JSON document of its own.
OPEN = ("domain_registry", "capture_detailed", "payload")
#: Schema paths of objects whose members are named by data; objects whose members' names are all whole numbers are so anyway.
NAMED = r".*\.(domains|bridges)"
#: Steps of a schema path, from its end, that patterns look at in deeper nodes.
TAIL = 12

_NODE = "label array<int>, parent_label array<int>, parent string, path string, name string, kind string, value string"


class _Number(str):
    """A number as it is written."""


_READ = Reader(_Number, _Number).read


def decode(text: str | None):
    """The document of a text; None where it doesn't parse."""
    return _READ(text)[1]


def document(text: str | None) -> tuple[str, object]:
    """How a document was read, and it: ``ok``, or why it gives no nodes (``null``, ``empty``, ``broken``, ``nothing`` for a JSON null)."""
    if text is None:
        return "null", None
    ok, root = _READ(text)
    if ok and isinstance(root, str) and not isinstance(root, _Number):
        ok, root = _READ(root)
    if not ok:
        return ("broken" if text.strip() else "empty"), None
    return ("nothing" if root is None else "ok"), root


class _Path:
    """A schema path's last steps, with those below it; what is asked of paths is answered once for each."""

    __slots__ = ("steps", "tail", "plain", "depth", "below", "keep", "record")

    def __init__(self, steps: tuple[str, ...], depth: int, keep: Callable[[str], bool], record: Callable[[str], bool]) -> None:
        self.steps, self.depth, self.below = steps, depth, {}
        self.tail = ("" if depth <= TAIL else "…") + "".join(steps)
        self.plain = plain(self.tail)
        self.keep, self.record = keep(self.tail), record(self.tail)


def _scalar_kind(value) -> tuple[str, str | None]:
    if value is None:
        return "null", None
    if isinstance(value, bool):
        return "boolean", str(value).lower()
    return ("number", str(value)) if isinstance(value, _Number) else ("string", plain(value))


def nodes(text: str | None, named_by: Sequence[str] = ("name", "label"), keep: Callable[[str], bool] | None = None, record: Callable[[str], bool] | None = None, known: dict | None = None) -> Iterator[tuple]:
    """(label, parent_label, parent, path, name, kind, value) of each kept node, parents before children.

    ``keep`` and ``record`` tell of a schema path whether its nodes are given back, and whether they are
    records. A node's ``parent_label`` is the longest truncation of its label that is a record's, else
    the label without the last ordinal; ``parent`` is that node's name: the member's, or of an array's
    element its place or the first of its members ``named_by`` that is a text.
    """
    read, root = document(text)
    if read != "ok":
        return
    keep, record = keep or (lambda _: True), record or (lambda _: False)
    known = {} if known is None else known
    if len(known) > 100_000:
        known.clear()
    names: list[str] = []
    label: list[int] = []
    steps: list[str] = []
    depths: list[int] = []  # of each open container: how long the label of the nearest record is, itself included; -1 for none

    def path_of(above: _Path | None, step: str) -> _Path:
        if above is None:
            found = known.get(())
            if found is None:
                found = known[()] = _Path((), 0, keep, record)
            return found
        found = above.below.get(step)
        if found is None:
            key = (*above.steps[-TAIL + 1 :], step)
            depth = min(above.depth + 1, TAIL + 1)
            found = known.get((key, depth))
            if found is None:
                found = known[key, depth] = _Path(key, depth, keep, record)
            above.below[step] = found
        return found

    def made(at: _Path, kind: str, value: str | None) -> tuple:
        # The parent's label is this one cut off behind the nearest record above.
        cut = depths[-1] if depths else -1
        if cut < 0:
            cut = max(0, len(label) - 1)
        path = at.plain if at.depth <= TAIL else plain("".join(steps))
        return label[:], label[:cut], names[cut - 1] if cut else "", path, names[-1] if names else "", kind, value

    def below(at: _Path, held: dict | list) -> Iterator[tuple]:
        """(ordinal, step, name, value, path) of the children that are containers or given back; others only count."""
        if isinstance(held, list):
            path = path_of(at, "[]")
            for i, v in enumerate(held):
                if path.keep or isinstance(v, (dict, list)):
                    yield i, "[]", None, v, path
            return
        for i, (k, v) in enumerate(held.items()):
            step = f".{k}"
            path = at.below.get(step) or path_of(at, step)
            if path.keep or isinstance(v, (dict, list)) or (isinstance(v, str) and k in OPEN):
                yield i, step, k, v, path

    # A frame is a container's children still to come; ordinals, names and steps run along.
    stack: list[Iterator] = []
    at, value = path_of(None, ""), root
    while True:
        if isinstance(value, str) and names and names[-1] in OPEN and not isinstance(value, _Number):
            opened = decode(value)
            value = value if opened is None else opened
        if isinstance(value, (dict, list)):
            if at.keep:
                yield made(at, "object" if isinstance(value, dict) else "array", None)
            depths.append(len(label) if at.record else depths[-1] if depths else -1)
            stack.append(below(at, value))
            label.append(-1)
            names.append("")
            steps.append("")
        elif at.keep:
            yield made(at, *_scalar_kind(value))
        while stack:
            child = next(stack[-1], None)
            if child is not None:
                break
            stack.pop()
            depths.pop()
            label.pop()
            names.pop()
            steps.pop()
        else:
            return
        label[-1], step, name, value, at = child
        steps[-1] = step
        if name is None:
            own = next((value[n] for n in named_by if isinstance(value.get(n), str)), None) if isinstance(value, dict) else None
            name = str(label[-1]) if own is None else str(own)
        names[-1] = plain(name)


def _mapped(df: DataFrame, keys: Sequence[str], column: str, columns: str, rows: Callable[[], Callable[[str | None], Iterator[tuple]]]) -> DataFrame:
    """The key columns, and the columns of each row that ``rows()`` makes of a document."""
    fields = [df.schema[k] for k in keys]
    own = T.StructType.fromDDL(columns)
    schema = T.StructType([T.StructField(f"_k{i}", f.dataType) for i, f in enumerate(fields)] + own.fields)
    source = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(column).alias("_doc"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in own.fields]
        of = rows()

        def flush(batch, at, out):
            taken = [batch.column(i).take(pa.array(at, pa.int32())) for i in range(len(fields))]
            return pa.RecordBatch.from_arrays(taken + [pa.array(c, t) for c, t in zip(out, kinds)], schema.names)

        for batch in batches:
            at: list[int] = []
            out: list[list] = [[] for _ in kinds]
            for i, text in enumerate(batch.column(len(fields)).to_pylist()):
                for row in of(text):
                    at.append(i)
                    for column, v in zip(out, row):
                        column.append(v)
                    if len(at) >= 20_000:
                        yield flush(batch, at, out)
                        at, out = [], [[] for _ in kinds]
            if at:
                yield flush(batch, at, out)

    found = source.mapInArrow(walk, schema)
    return found.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *own.names)


def shred(df: DataFrame, keys: Sequence[str], document: str, wanted: str | None = None, records: str | None = None) -> DataFrame:
    """A row per node of each document: the key columns, then label, parent_label, parent, path, name, kind, value.

    ``wanted`` and ``records`` are regular expressions that a node's schema path must match in full to be
    given back, or to be a parent; nodes deeper than :data:`TAIL` are told by the end of their path.
    Other nodes are walked, so that ordinals hold, but not returned.
    """

    def rows():
        keep = re.compile(wanted).fullmatch if wanted else None
        record = re.compile(records).fullmatch if records else None
        known: dict = {}
        return lambda text: nodes(text, keep=keep and (lambda p: keep(p) is not None), record=record and (lambda p: record(p) is not None), known=known)

    return _mapped(df, keys, document, _NODE, rows)


def rejects(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The key columns and ``reason`` of each document that gives no nodes."""

    def rows():
        def of(text):
            read, _ = document(text)
            if read != "ok":
                yield (read,)

        return of

    return _mapped(df, keys, column, "reason string", rows)


def tables(df: DataFrame, keys: Sequence[str], column: str, named: str = NAMED) -> DataFrame:
    """The rows of all tables that the documents hold: the key columns, path, label, parent_path, parent_label, key, pos, fields.

    Every object is a row of the table of its schema path, with its scalar members as ``fields``; so is
    every scalar element of an array, as field ``value``. The parent is the nearest object above, its
    label a truncation of the row's own. ``key`` is the name that data gave the row, else null.
    """

    def rows():
        by_data = re.compile(named).fullmatch

        def of(text):
            read, root = document(text)
            if read != "ok":
                return
            # (value, path, label, parent's path, parent's label, key, pos), the row's parent being the nearest object.
            stack = [(root, "", (), None, None, None, 0)]
            while stack:
                value, path, label, up_path, up_label, key, pos = stack.pop()
                if isinstance(value, str) and not isinstance(value, _Number) and path.rpartition(".")[2] in OPEN:
                    opened = decode(value)
                    value = value if opened is None else opened
                if isinstance(value, dict):
                    own = {plain(k): _scalar_kind(v)[1] for k, v in value.items() if not isinstance(v, (dict, list)) and not (isinstance(v, str) and k in OPEN)}
                    yield plain(path), list(label), up_path, None if up_label is None else list(up_label), key, pos, list(own.items())
                    data = bool(value) and (by_data(path) is not None or all(k.lstrip("-").isdigit() for k in value))
                    below = [(v, path + ("{}" if data else f".{k}"), label + (i,), plain(path), label, plain(k) if data else None, i) for i, (k, v) in enumerate(value.items()) if isinstance(v, (dict, list)) or (isinstance(v, str) and k in OPEN)]
                    stack.extend(reversed(below))
                elif isinstance(value, list):
                    stack.extend(reversed([(v, path + "[]", label + (i,), up_path, up_label, None, i) for i, v in enumerate(value)]))
                elif path.endswith("[]") or path == "":
                    yield plain(path), list(label), up_path, None if up_label is None else list(up_label), key, pos, [("value", _scalar_kind(value)[1])]

        return of

    return _mapped(df, keys, column, "path string, label array<int>, parent_path string, parent_label array<int>, key string, pos int, fields map<string,string>", rows)


def parent(label="label"):
    """The parent's label: the label without its last ordinal."""
    c = F.col(label) if isinstance(label, str) else label
    return F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))


def ordinal(place: int, label="label"):
    """A label's ordinal, counted from the end: 1 is the node's own place among its siblings."""
    return F.try_element_at(F.col(label), F.lit(-place))


# --- The tables of the two document kinds -------------------------------------------------------

_TOP12 = r".*\.top12\[\](\[\]|\.hexagram(_id)?|\.id)?"
_SCORE = r".*\.score_details_first3\[\](\[\])?(\.scores)?\.hex_score"
_LEVELS = r".*\.captures\[\]|(\.capture_detailed)?\.-?\d+"
_LEVEL = rf"({_LEVELS})(\.(label|consensus|consensus_name|consensus_yao|mu|sigma))?"
_DOMAINS = r".*\.domains(\[\]|\.[^.\[]+)"
_DOMAIN = rf"{_DOMAINS}(\.(description|root|output_pattern|cross_domain_policy))?"
_PATTERN = r".*\.domains(\[\]|\.[^.\[]+)\.input_patterns(\[\](\.pattern)?)?"

def _scalar():
    return F.col("kind").isin("number", "string", "boolean")


def _level():
    """The input level that is a node's parent, without the words of a label ("input=20")."""
    return F.regexp_replace("parent", r"^input\s*=\s*", "")


def ranked(captures: DataFrame) -> DataFrame:
    """capture_id, label, parent_label, level, pos, hexagram_id: the elements of top12, children of their level."""
    n = shred(captures, ["capture_id"], "payload", _TOP12, _LEVELS)
    nested = F.col("path").rlike(r"\.top12\[\].+$")
    first = ~F.col("path").rlike(r"\.top12\[\]\[\]$") | (ordinal(1) == 0)
    item = F.regexp_extract(F.col("value"), r"^\s*(\d+)", 1).try_cast("int")
    return n.filter(_scalar() & first).select(
        "capture_id", F.when(nested, parent()).otherwise(F.col("label")).alias("label"), "parent_label", _level().alias("level"),
        F.when(nested, ordinal(2)).otherwise(ordinal(1)).alias("pos"), item.alias("hexagram_id"),
    ).filter("hexagram_id IS NOT NULL")


def _detail():
    """Of a score: how many steps its detail is above it, and 1 if its group is an array."""
    return 1 + F.col("path").endswith(".scores.hex_score").cast("int"), F.col("path").rlike(r"first3\[\]\[\]").cast("int")


def _back(steps):
    return F.try_element_at(F.col("label"), -steps)


def scores(captures: DataFrame) -> DataFrame:
    """capture_id, label, parent_label, level, grp, pos, hex_score: the score details, children of their level."""
    n = shred(captures, ["capture_id"], "payload", _SCORE, _LEVELS)
    up, array = _detail()
    return n.filter(_scalar()).select(
        "capture_id", F.slice(F.col("label"), F.lit(1), F.size("label") - up).alias("label"), "parent_label", _level().alias("level"),
        _back(up + array + 1).alias("grp"), F.when(array == 1, _back(up + 1)).otherwise(0).alias("pos"), F.col("value").try_cast("double").alias("hex_score"),
    ).filter("hex_score IS NOT NULL")


def _records(df: DataFrame, key: str, wanted: str, records: str):
    """The scalars that records of one table hold, with the record's label and name."""
    n = shred(df, [key], "payload", wanted, records)
    own = F.col("kind") == "object"
    return n.select("*", F.when(own, F.col("label")).otherwise(F.col("parent_label")).alias("_l"), F.when(own, F.col("name")).otherwise(F.col("parent")).alias("_name"), own.alias("_own"))


def levels(captures: DataFrame) -> DataFrame:
    """capture_id, label, parent_label, level and the level's own scalars, one row per input level."""
    pick = lambda name: F.max(F.when(~F.col("_own") & (F.col("name") == name), F.col("value")))
    rows = _records(captures, "capture_id", _LEVEL, _LEVELS).withColumn("level", F.regexp_replace("_name", r"^input\s*=\s*", ""))
    return rows.groupBy("capture_id", F.col("_l").alias("label"), "level").agg(
        pick("consensus").try_cast("int").alias("consensus"), pick("consensus_name").alias("consensus_name"), pick("consensus_yao").alias("consensus_yao"),
        pick("mu").try_cast("double").alias("mu"), pick("sigma").try_cast("double").alias("sigma"),
    ).withColumn("parent_label", parent())


def domains(snapshots: DataFrame) -> DataFrame:
    """snapshot_id, label, parent_label, domain and the domain's own scalars, one row per domain."""
    pick = lambda name: F.max(F.when(~F.col("_own") & (F.col("name") == name), F.col("value"))).alias(name)
    rows = _records(snapshots, "snapshot_id", _DOMAIN, _DOMAINS)
    return rows.groupBy("snapshot_id", F.col("_l").alias("label"), F.col("_name").alias("domain")).agg(*[pick(c) for c in ("description", "root", "output_pattern", "cross_domain_policy")]).withColumn("parent_label", parent())


def patterns(snapshots: DataFrame) -> DataFrame:
    """snapshot_id, label, parent_label, domain, pos, pattern: the input patterns, children of their domain; a lone text is at place 0."""
    n = shred(snapshots, ["snapshot_id"], "payload", _PATTERN, _DOMAINS)
    inner = F.col("path").endswith("[].pattern")
    element = F.col("path").endswith(".input_patterns[]")
    return n.filter(_scalar()).select(
        "snapshot_id", F.when(inner, parent()).otherwise(F.col("label")).alias("label"), "parent_label", F.col("parent").alias("domain"),
        F.when(inner, ordinal(2)).when(element, ordinal(1)).otherwise(0).alias("pos"), F.col("value").alias("pattern"),
    )


def elements(captures: DataFrame, snapshots: DataFrame) -> DataFrame:
    """tbl, doc_id, parent, field, grp, pos, item: distinct elements of both document kinds."""
    no = F.lit(-1)
    # One walk serves both tables of the captures.
    n = shred(captures, ["capture_id"], "payload", f"{_TOP12}|{_SCORE}", _LEVELS)
    score = F.col("path").endswith("hex_score")
    up, array = _detail()
    nested = F.col("path").rlike(r"\.top12\[\].+$")
    first = score | ~F.col("path").endswith(".top12[][]") | (ordinal(1) == 0)
    billionths = F.round(F.col("value").try_cast("double") * 1e9).try_cast("long").cast("string")
    hexagram = F.regexp_extract(F.col("value"), r"^\s*(\d+)", 1).try_cast("int").cast("string")
    from_captures = n.filter(_scalar() & first).select(
        F.lit("capture_detailed").alias("tbl"), F.col("capture_id").alias("doc_id"), _level().alias("parent"),
        F.when(score, "hex_score").otherwise("top12").alias("field"),
        F.when(score, _back(up + array + 1)).otherwise(no).alias("grp"),
        F.when(score, F.when(array == 1, _back(up + 1)).otherwise(0)).when(nested, ordinal(2)).otherwise(ordinal(1)).alias("pos"),
        F.when(score, billionths).otherwise(hexagram).alias("item"),
    )
    from_snapshots = patterns(snapshots).select(
        F.lit("domain_registry").alias("tbl"), F.col("snapshot_id").alias("doc_id"), F.col("domain").alias("parent"), F.lit("input_patterns").alias("field"),
        no.alias("grp"), "pos", F.col("pattern").alias("item"),
    )
    return from_captures.unionAll(from_snapshots).filter("item IS NOT NULL").distinct()
