"""Splitting oversized texts at natural boundaries, with overlap.

A text is a row of sections of fixed size. Near each multiple of that size the strongest boundary in
a bounded window is the seam between two sections; it depends on the window alone, so whoever reads a
section with halos on both sides knows both of its seams, and sections are cut apart from each other,
each with the overlap before its own seam. What goes over a seam is stitched from one small row per
section: numbers of pieces by prefix sums, unbroken runs by the lengths at both ends. The pieces are
the same whatever part of the sections a worker is given.

Texts of a column within one section are cut where they lie. Longer ones become rows of (text,
section) that are dealt out over the cluster. Files (:func:`file_pieces`) are read by byte ranges of
any file system that pyarrow opens, a section at a time, so no file is loaded whole.

Boundaries, strongest first: blank line, line end, sentence end, clause mark, white space. A piece
ends at the strongest boundary in the last half of what fits, at the last one there; if that half
has none, at the last boundary that fits, and only without any is it cut by force at the limit.
The next piece begins ``overlap`` code points earlier, moved on to the nearest later boundary if
one lies before the cut; the overlap is shortened where the next unbroken run fits only so.

Defined results
* null, empty and blank texts, and texts within the limit, have one piece (``pieces``, all texts) or
  aren't reported (``oversized``)
* lengths are code points; a forced cut doesn't part a letter from its combining marks, or CR from LF
* the pieces without their overlaps, in order, are the text; every piece is within the limit
* repeated rows are split each on its own; key columns may have any names
* bytes of files that aren't UTF-8 become U+FFFD; an empty file has no pieces
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sixline.llm.spread import spread

LIMIT, OVERLAP = 800, 100
#: Code points (bytes, of files) of a section, of the window in which its seam is looked for, and of the halo on both sides.
SECTION, WINDOW, HALO = 1 << 16, 1 << 14, 256

#: Marks after which a text may be cut; the last of each row need no white space after them.
STOPS, FULL_STOPS = ".!?…", "。！？"
CLAUSES, FULL_CLAUSES = ",;:", "，；：、"
_BOUNDARY = re.compile("(?:[" + STOPS + FULL_STOPS + CLAUSES + FULL_CLAUSES + r"]+[\"'”’»)\]」』）]*\s*|\s+)")
#: What breaks a run: white space and the marks of a cut.
_BREAK = re.compile(r"[\s.,;:!?。，；：！？、]+")


def _strength(found: str) -> int:
    """4 blank line, 3 line end, 2 sentence end, 1 clause, 0 white space, -1 a bare mark as in a number."""
    tail = found[len(found.rstrip()) :]
    lines = tail.replace("\r\n", "\n")
    ends = sum(lines.count(c) for c in "\n\r\u2028\x85") + 2 * lines.count("\u2029")
    if ends:
        return 4 if ends > 1 else 3
    marks = found[: len(found) - len(tail)]
    if any(c in marks for c in FULL_STOPS) or (tail and any(c in marks for c in STOPS)):
        return 2
    if any(c in marks for c in FULL_CLAUSES) or (tail and marks):
        return 1
    return 0 if tail else -1


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Offsets within a text at which it may be cut, and their strength."""
    at: list[int] = []
    strength: list[int] = []
    known: dict[str, int] = {}
    for m in _BOUNDARY.finditer(text):
        end = m.end()
        if end < len(text):
            found = m.group()
            value = known.get(found)
            if value is None:
                value = _strength(found)
                if len(found) < 9:
                    known[found] = value
            at.append(end)
            strength.append(value)
    return at, strength


def runs(text: str) -> tuple[int, int, int]:
    """Code points without white space or marks at a text's begin, at most inside, and at its end; all equal if nothing breaks it."""
    stretches = list(map(len, _BREAK.split(text)))
    return stretches[0], max(stretches), stretches[-1]


def stitched_run(parts: Sequence[tuple[int, int, int, int]]) -> int:
    """The longest run of a text of (length, first, most, last) of its parts in order."""
    best = carried = 0
    for length, first, most, last in parts:
        if length == first:
            carried += length
            continue
        best = max(best, carried + first, most)
        carried = last
    return max(best, carried)


def longest_run(text: str, size: int = SECTION) -> int:
    """Code points of the longest stretch without white space or marks; runs over the sections' edges are stitched."""
    parts = (text[i : i + size] for i in range(0, len(text), size))
    return stitched_run([(len(p), *runs(p)) for p in parts])


def _whole(text: str, at: int, least: int) -> int:
    """A forced cut moved back before a combining mark, joiner or line feed."""
    while at > least and at < len(text) and (
        unicodedata.combining(text[at]) or text[at] in "\u200d\ufe0f\ufe0e" or text[at - 1] == "\u200d" or (text[at] == "\n" and text[at - 1] == "\r") or "\U0001f3fb" <= text[at] <= "\U0001f3ff"
    ):
        at -= 1
    return at


def _forced(text: str, at: int, least: int) -> tuple[int, bool]:
    return _whole(text, at, least), not text[at].isspace()


def _cut(text: str, done: int, limit: int, overlap: int, last_forced: bool = False) -> list[tuple[int, int, bool]]:
    """(start, end, forced) of the pieces of what follows ``done`` in a text whose begin is there for context."""
    n = len(text)
    at, strength = boundaries(text)

    def back(end: int) -> int:
        """Where the piece after a cut begins: the overlap before it, shortened where the next boundary is in reach only from further on."""
        start = max(0, end - overlap)
        i = bisect.bisect_left(at, start)
        start = at[i] if i < len(at) and at[i] < end else start
        j = bisect.bisect_right(at, end)
        reach = (at[j] if j < len(at) else n) - limit
        return min(end, max(start, reach)) if reach <= end else start

    out, start = [], back(done) if done else 0
    while n - start > limit:
        stop = start + limit
        hi = bisect.bisect_right(at, stop)
        lo = bisect.bisect_right(at, max(done, start + limit // 2))
        forced = False
        if lo < hi:
            top = max(strength[lo:hi])
            end = next(at[i] for i in range(hi - 1, lo - 1, -1) if strength[i] == top)
        elif bisect.bisect_right(at, done) < hi:
            end = at[hi - 1]
        else:
            end, forced = _forced(text, stop, max(done, start) + 1)
        out.append((start, end, forced))
        done, start = end, max(start + 1, back(end))
    out.append((start, n, last_forced))
    return out


def _sizes(limit: int, section: int) -> tuple[int, int]:
    """Section and seam window, no less than what a limit needs."""
    section = max(section, 8 * limit)
    return section, max(limit, min(WINDOW, section // 4))


def _seam(around: str, begin: int, window: int) -> tuple[int, bool]:
    """Offset in ``around`` of the seam: the strongest boundary, the first of equals, in the window after ``begin``; and whether there is none."""
    at, strength = boundaries(around[: begin + window + HALO])
    inside = [i for i in range(bisect.bisect_right(at, begin), len(at)) if at[i] <= begin + window]
    if not inside:
        return _forced(around, begin, 1)
    return at[max(inside, key=lambda i: (strength[i], -i))], False


def section_cuts(around: str, before: int, part: int, more: bool, limit: int, overlap: int, section: int) -> list[tuple[int, int, bool]]:
    """The pieces of one section. ``around`` begins ``before`` code points ahead of it and goes on to the end of the next seam's window, or of the text if it has no ``more`` sections."""
    section, window = _sizes(limit, section)
    first = _seam(around, before, window)[0] if part else 0
    end, forced = _seam(around, before + section, window) if more else (len(around), False)
    left = max(0, first - overlap - HALO) if part else 0
    return [(left + a, left + b, f) for a, b, f in _cut(around[left:end], first - left, limit, overlap, forced)] if end > first else []


def _around(n: int, part: int, limit: int, overlap: int, section: int) -> tuple[int, int, int, bool]:
    """(from, to, before, more): what of a text of length n a section is cut from."""
    section, window = _sizes(limit, section)
    begin = part * section
    left = max(0, begin - overlap - 2 * HALO)
    more = begin + section < n
    return left, min(n, begin + section + window + HALO) if more else n, begin - left, more


def sections(n: int, limit: int, section: int = SECTION) -> int:
    return max(1, -(-n // _sizes(limit, section)[0]))


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP, section: int = SECTION) -> list[tuple[int, int, bool]]:
    """(start, end, forced) of each piece; ``forced`` if the piece's end is no boundary."""
    n = len(text)
    if n <= limit:
        return [(0, n, False)]
    out = []
    for part in range(sections(n, limit, section)):
        a, b, before, more = _around(n, part, limit, overlap, section)
        out += [(a + i, a + j, f) for i, j, f in section_cuts(text[a:b], before, part, more, limit, overlap, section)]
    return out


def _run(df: DataFrame, keys: Sequence[str], text: str, extra: str, rows) -> DataFrame:
    fields = [T.StructField(f"_k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
    more = T.StructType.fromDDL(extra)
    source = spread(df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(text).alias("_text")), "_text")
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in more.fields]
        for batch in batches:
            at, out = [], [[] for _ in more.fields]
            for i, s in enumerate(batch.column(len(names))):
                for row in rows(s.as_py()):
                    at.append(i)
                    for column, v in zip(out, row):
                        column.append(v)
                if len(at) >= 10_000:
                    taken = [batch.column(k).take(pa.array(at, pa.int32())) for k in range(len(names))]
                    yield pa.RecordBatch.from_arrays(taken + [pa.array(c, t) for c, t in zip(out, kinds)], names + more.names)
                    at, out = [], [[] for _ in more.fields]
            taken = [batch.column(k).take(pa.array(at, pa.int32())) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(taken + [pa.array(c, t) for c, t in zip(out, kinds)], names + more.names)

    found = source.mapInArrow(run, T.StructType(fields + more.fields))
    return found.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *more.names)


_PIECE = "piece_no int, start int, end int, forced int, piece string"
_RUNS = "length int, first int, most int, last int"


def _dealt(df: DataFrame, text: str, limit: int, overlap: int, section: int) -> DataFrame:
    """A row per section of each text over one section: _row, _part, _from, _before, _more, _around, and the other columns as ``_keys``."""
    long_ = df.filter(F.char_length(text) > _sizes(limit, section)[0])
    rows = long_.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(c) for c in df.columns if c != text]).alias("_keys"), F.col(text).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:2], *T.StructType.fromDDL("_part int, _from long, _before int, _more boolean, _around string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = batch.column(2)[i].as_py()
                for part in range(sections(len(s), limit, section)):
                    a, b, before, more = _around(len(s), part, limit, overlap, section)
                    values = [pa.array([v], k) for v, k in zip((part, a, before, more, s[a:b]), (pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *values], schema.names)

    out = rows.mapInArrow(run, schema)
    return out.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, "_row", "_part")


def _numbered(made: DataFrame, by: Sequence[str], part: str) -> DataFrame:
    """``piece_no`` over all parts: the number within the part and, by prefix sums, the pieces of the parts before."""
    counts = made.groupBy(*by, part).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*by, part, (F.sum("_n").over(Window.partitionBy(*by).orderBy(part)) - F.col("_n")).alias("_held"))
    return made.join(before, [*by, part]).withColumn("piece_no", (F.col("piece_no") + F.col("_held")).cast("int"))


def pieces(df: DataFrame, keys: Sequence[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP, only_oversized: bool = True, section: int = SECTION) -> DataFrame:
    """The key columns, piece_no from 1, start, end (code points), forced (1 if the end is no boundary) and the piece."""
    size = _sizes(limit, section)[0]

    def rows(s: str | None):
        if s is None or (only_oversized and len(s) <= limit):
            return
        for i, (a, b, forced) in enumerate(cuts(s, limit, overlap, section), 1):
            yield i, a, b, int(forced), s[a:b]

    plain = df.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], F.col(text).alias("_text"))
    names = plain.columns[:-1]
    short = _run(plain.filter((F.char_length("_text") <= size) | F.col("_text").isNull()), names, "_text", _PIECE, rows)

    def emit(frame):
        for part, left, before, more, around, row in zip(frame["_part"], frame["_from"], frame["_before"], frame["_more"], frame["_around"], frame["_row"]):
            for i, (a, b, forced) in enumerate(section_cuts(around, before, part, more, limit, overlap, section), 1):
                yield row, part, i, left + a, left + b, int(forced), around[a:b]

    def each(frames):
        import pandas as pd

        for frame in frames:
            out = list(emit(frame))
            made = pd.DataFrame(out, columns=["_row", "_part", "piece_no", "start", "end", "forced", "piece"])
            yield made

    dealt = _dealt(plain, "_text", limit, overlap, section)
    cut_ = dealt.drop("_keys").mapInPandas(each, "_row long, _part int, " + _PIECE)
    own = dealt.filter("_part = 0").select("_row", "_keys.*")
    long_ = _numbered(cut_, ["_row"], "_part").join(own, "_row")
    made = [f.split(" ")[0] for f in _PIECE.split(", ")]
    both = short.unionByName(long_.select(*names, *made))
    return both.select(*[F.col(c).alias(k) for c, k in zip(names, keys)], *made)


def oversized(df: DataFrame, keys: Sequence[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP, section: int = SECTION) -> DataFrame:
    """One row per text over the limit: the key columns, pieces, and forced, 1 if an unbroken run is over the limit."""
    size = _sizes(limit, section)[0]

    def rows(s: str | None):
        if s is not None and len(s) > limit:
            yield len(cuts(s, limit, overlap, section)), int(longest_run(s) > limit)

    plain = df.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], F.col(text).alias("_text")).filter(F.char_length("_text") > limit)
    names = plain.columns[:-1]
    short = _run(plain.filter(F.char_length("_text") <= size), names, "_text", "pieces int, forced int", rows)

    def measure(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for row, part, before, more, around in zip(frame["_row"], frame["_part"], frame["_before"], frame["_more"], frame["_around"]):
                own = around[before : before + size]
                out.append((row, part, len(section_cuts(around, before, part, more, limit, overlap, section)), len(own), *runs(own)))
            yield pd.DataFrame(out, columns=["_row", "_part", "pieces", "length", "first", "most", "last"])

    def stitch(frame):
        import pandas as pd

        frame = frame.sort_values("_part")
        best = stitched_run(list(frame[["length", "first", "most", "last"]].itertuples(index=False, name=None)))
        return pd.DataFrame({"_row": frame["_row"].iloc[:1], "pieces": [int(frame["pieces"].sum())], "forced": [int(best > limit)]})

    dealt = _dealt(plain, "_text", limit, overlap, section)
    table = dealt.drop("_keys").mapInPandas(measure, "_row long, _part int, pieces int, " + _RUNS)
    long_ = table.groupBy("_row").applyInPandas(stitch, "_row long, pieces int, forced int").join(dealt.filter("_part = 0").select("_row", "_keys.*"), "_row")
    both = short.unionByName(long_.select(*names, "pieces", "forced"))
    return both.select(*[F.col(c).alias(k) for c, k in zip(names, keys)], "pieces", "forced")


# --- Files -------------------------------------------------------------------------------------


def _opened(path: str):
    """A file system and the path in it, local or of any kind that pyarrow knows (hdfs, s3, gs ...)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _bytes(file, begin: int, stop: int) -> bytes:
    file.seek(begin)
    return file.read(stop - begin)


def _starts(data: bytes) -> int:
    """Bytes at the begin that belong to a letter begun before."""
    return next((i for i in range(min(4, len(data))) if data[i] & 0xC0 != 0x80), 0)


def file_ranges(spark: SparkSession, paths: Sequence[str], size: int = 64 << 20, limit: int = LIMIT) -> DataFrame:
    """(path, length, first, stop): sections of files, by ranges of about ``size`` bytes."""
    section = 4 * _sizes(limit, SECTION)[0]
    rows = []
    for p in paths:
        system, at = _opened(p)
        n = system.get_file_info(at).size
        k, step = -(-n // section), max(1, size // section)
        rows += [(p, n, i, min(k, i + step)) for i in range(0, k, step)]
    return spark.createDataFrame(rows, "path string, length long, first int, stop int").repartition(max(1, min(len(rows), 10_000)), "path", "first")


def file_pieces(spark: SparkSession, paths: Sequence[str], limit: int = LIMIT, overlap: int = OVERLAP, size: int = 64 << 20) -> DataFrame:
    """Pieces of UTF-8 files: path, piece_no, start, end (byte offsets), forced, piece; the same for every ``size`` of the ranges.

    A task reads its range section by section, each with its halos, and both of its seams by itself.
    """
    section = 4 * _sizes(limit, SECTION)[0]
    window = 4 * _sizes(limit, SECTION)[1]
    halo = 4 * (overlap + 2 * HALO)

    def seam(file, part: int, n: int) -> tuple[int, bool]:
        """Byte offset of the seam at the begin of a section."""
        if part == 0:
            return 0, False
        if part * section >= n:
            return n, False
        left = max(0, part * section - halo)
        data = _bytes(file, left, min(n, part * section + window + halo))
        skip = _starts(data)
        cut_at = part * section - left
        cut_at += _starts(data[cut_at:])
        before = data[skip:cut_at].decode("utf-8", "replace")
        after = data[cut_at:].decode("utf-8", "replace")
        text = before + after
        at, forced = _seam(text, len(before), window // 4)
        # Bytes up to the seam, counted in what was read: letters that aren't UTF-8 are counted by their own bytes.
        inside = _prefix(data[cut_at:], at - len(before)) if at >= len(before) else -len(before[at:].encode("utf-8"))
        return left + cut_at + inside, forced

    def emit(frames):
        import pandas as pd

        for frame in frames:
            for p, n, first, stop in zip(frame["path"], frame["length"], frame["first"], frame["stop"]):
                system, inner = _opened(p)
                with system.open_input_file(inner) as file:
                    begin, _ = seam(file, first, n)
                    for part in range(first, stop):
                        end, forced = seam(file, part + 1, n)
                        left = max(0, begin - halo) if part else 0
                        data = _bytes(file, left, end)
                        skip = _starts(data) if left else 0
                        head = data[skip : begin - left]
                        before = head.decode("utf-8", "replace")
                        text = before + data[begin - left :].decode("utf-8", "replace")
                        keep = max(0, len(before) - overlap - HALO)
                        offsets = _offsets(data[skip:], text)
                        out = []
                        if end > begin:
                            for i, (a, b, f) in enumerate(_cut(text[keep:], len(before) - keep, limit, overlap, forced), 1):
                                out.append((p, part, i, left + skip + offsets[keep + a], left + skip + offsets[keep + b], int(f), text[keep + a : keep + b]))
                        begin = end
                        yield pd.DataFrame(out, columns=["path", "_part", "piece_no", "start", "end", "forced", "piece"])

    made = file_ranges(spark, paths, size, limit).mapInPandas(emit, "path string, _part int, piece_no int, start long, end long, forced int, piece string")
    return _numbered(made, ["path"], "_part").select("path", "piece_no", "start", "end", "forced", "piece")


def _prefix(data: bytes, n: int) -> int:
    """Bytes that the first ``n`` code points take."""
    return _offsets(data, data.decode("utf-8", "replace"))[n]


def _offsets(data: bytes, text: str):
    """Byte offset of each code point of ``data`` decoded as ``text``, and of its end."""
    import codecs
    from itertools import accumulate

    if text.isascii():
        return range(len(text) + 1)
    spans: list[tuple[int, int]] = []

    def note(e):
        spans.append((e.start, e.end))
        return "\ufffd", e.end

    codecs.register_error("sixline_note", note)
    data.decode("utf-8", "sixline_note")
    sizes, at = [], 0
    for a, b in [*spans, (len(data), len(data))]:
        # A sign that stands for bytes which aren't UTF-8 has those bytes.
        sizes += [len(c.encode("utf-8")) for c in data[at:a].decode("utf-8")]
        if b > a:
            sizes.append(b - a)
        at = b
    return list(accumulate(sizes, initial=0))
