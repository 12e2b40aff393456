"""Texts cut off by field limits or broken transfers.

Per source, the histograms of lengths in code points and in bytes are searched for candidate limits,
lengths far more frequent than those around them. For each a right-censored log-normal distribution
is fitted by maximum likelihood (values at the limit count as censored); what it expects at the limit
without censoring, against what is there, gives the posterior that a value of that length was cut.
Texts at no limit have the share of broken transfers in their source as prior.

Ending evidence is a likelihood ratio of the class of ending, with nothing fixed by hand. The classes
rest on counts over the corpus' own lines, which are whole (how lines begin and how long they are,
their signs, their last two words). How often a class occurs is learnt from labels that the corpus
gives itself: texts ended at an inner line end are whole, texts ended anywhere else are cut. Per
source, EM over all texts brings priors and likelihoods together; each text's posterior follows.

Defined results
* null, empty and blank texts aren't cut; white space at the end is not looked at
* a text that ends with a sentence mark isn't cut, whatever its length, unless the mark parts a number
  or markup is still open: a cut at a sentence's end leaves a whole text
* dots at the end count as a mark of the cut by how rarely sentences that begin so end with dots
* a null source is a source of its own; sources with few texts have no limits and go by all sources' likelihoods
* repeated ids give one row each
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sixline.llm.spread import spread
from sixline.session import cut as _cut

#: Marks that end a sentence, signs that may close after them, bullets before a line.
_CLOSED = "\"'”’»)\\]」』）*_"
_CLOSING = "\"'”’»)]」』）*_"
_MARKS = ".!?。！？"
_INNER = re.compile(f"(?:[.!?…][{_CLOSED}]*\\s+|[。！？][{_CLOSED}]*)")
_BULLET = re.compile(r"^\s*(?:[*•·+–-]|\d{1,3}[.)])\s+")
_HALF_NUMBER = re.compile(r"(?:(?:^|[^\d.\w])0|[|=]\s*\d+|\d\.\d*[|,]\s*\d+)\.$")
_SIGNS = re.compile(r"[|\[\]<>{}=/\\_—]")
#: Code points from which a word or a signature is known by its hash: it is compared whole, but not as the begin of longer ones.
LONG = 96
#: A text of one line is a title up to so many words.
TITLE_WORDS = 12
#: Texts, at most, that are ended once more inside to learn from; chosen by the hash of their id.
LABELLED = 20_000
#: Share of cuts that leave dots, and of whole sentences whose begin is seen nowhere else.
MARKED, HABIT = 0.1, 0.004
#: What labels count in texts: those of cuts, those of all sources beside a source's own; and the length posterior of a limit.
LABELS_CUT, LABELS_ALL, LENGTHS = 50.0, 200.0, 2.0
#: A source's share of broken transfers before any of its texts is seen.
BROKEN = 0.03
CLASSES = ["blank", "end", "number", "open", "dots", "prose", "title_half", "title_known", "title", "line_half", "line_known", "line"]


def _short(s: str) -> str:
    """A text up to :data:`LONG`, or its hash."""
    return s if len(s) <= LONG else "#" + hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _shape(token: str) -> str:
    """A number by its digits after the point; other tokens as they are."""
    if token[:1].isdigit() or (token[:1] in "+-" and token[1:2].isdigit()):
        _, dot, tail = token.partition(".")
        return "9" + dot + re.sub(r"\d", "9", tail)
    return token


def _signature(line: str) -> str:
    """Words as a or A, whole numbers as 9, fractions by their digits, signs as they are."""
    s = re.sub(r"(?<![\d.])\d+", "9", line)
    s = re.sub(r"(?<=\.)\d+", lambda m: "9" * len(m.group()), s)
    s = re.sub(r"[^\W\d_]+", lambda m: "A" if m.group()[:1].isupper() else "a", s)
    return re.sub(r"(?:\b[aA]\b[ -]?){3,}", "a+ ", s).strip()


def _keys(line: str) -> tuple[str, int, str, str, str]:
    """First word, number of words, signature, last word but one, last word."""
    bare = _BULLET.sub("", line).strip()
    words = bare.split()
    if not words:
        return "", 0, "", "", ""
    signature = _short(_signature(bare)) if _SIGNS.search(bare) else ""
    return _short(words[0]), len(words), signature, _short(_shape(words[-2])) if len(words) > 1 else "", _short(_shape(words[-1]))


def _dotted(line: str) -> bool:
    return line.rstrip(_CLOSING).endswith(("...", "…"))


def _terminal(line: str) -> bool:
    return line.rstrip(_CLOSING)[-1:] in _MARKS if line else False


def _opened(line: str) -> bool:
    """Whether a bracket or markup that the line opens is still open at its end."""
    return line.count("(") > line.count(")") or line.count("（") > line.count("）") or line.count("[[") > line.count("]]") or line.count("<math") > line.count("</math") or line.rfind("<") > line.rfind(">") and line[line.rfind("<") + 1 : line.rfind("<") + 2].isalpha()


def _begin(sentence: str) -> str:
    return _short(" ".join(sentence.split(None, 2)[:2]))


def ending(text: str) -> tuple[str, str]:
    """How a text ends, and the last line or the last sentence's begin.

    ``blank``, ``end`` (sentence mark), ``number`` (a mark that parts a number), ``open`` (within
    brackets or markup), ``dots`` (in a sentence, with its first words), ``prose`` (an open sentence after others in
    its line), ``title`` (a text that is one short line), ``line``.
    """
    s = text.rstrip().rstrip("​﻿").rstrip()
    if not s:
        return "blank", ""
    line = s[max(s.rfind("\n"), s.rfind("\r")) + 1 :]
    if _dotted(line):
        body = _BULLET.sub("", re.sub("[.…]+$", "", line.rstrip(_CLOSING))).rstrip()
        return "dots", _begin(_INNER.split(body)[-1]) + "\t" + _short(_shape((body.split(None)[-1:] or [""])[0]))
    if _terminal(line):
        if _HALF_NUMBER.search(line):
            return "number", ""
        return ("open", "") if "<" in line and _opened(line.replace("(", "")) else ("end", "")
    inner = _INNER.split(_BULLET.sub("", line))
    if len(inner) > 1 and inner[-1].strip() and not _SIGNS.search(inner[0][:1]):
        return "prose", ""
    if len(line) == len(s) and len(inner) == 1 and len(s.split(None, TITLE_WORDS + 1)) <= TITLE_WORDS and s.count("(") <= s.count(")"):
        return "title", line[:1].lower() + line[1:]
    return ("open", "") if _opened(line) else ("line", line)


def _rows(df: DataFrame, text: str, source: str, key: str) -> DataFrame:
    return spread(df.select(F.col(key).alias("_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"), F.col(text).alias("_text")), "_id")


def line_statistics(rows: DataFrame) -> DataFrame:
    """kind, source, a, b, n: numbers of lines by first word and length (``first``, ``all``), of signatures, of line ends, of their words and of sentences with dots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: Counter = Counter()
            for src, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if not s:
                    continue
                lines = [x for x in s.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()]
                for i, line in enumerate(lines):
                    bare = _BULLET.sub("", line).strip()
                    if not bare:
                        continue
                    last = i == len(lines) - 1
                    sentences = [m.end() for m in _INNER.finditer(bare)]
                    if not last or not sentences:
                        count["all", src, _short(bare.split(None, 1)[0]), ""] += 1
                    if sentences:
                        for a, b in zip([0, *sentences], [*sentences, len(bare)]):
                            if a < b:
                                one = bare[a:b].strip()
                                count["dotted" if _dotted(one) else "marked", "", _begin(one), ""] += 1
                        continue
                    dotted = _dotted(bare)
                    count["dotted" if dotted else "marked", "", _begin(bare), ""] += 1
                    if dotted or _terminal(bare):
                        continue
                    first, n, signature, before, end = _keys(line)
                    count["first", src, first, str(n)] += 1
                    if not last:
                        count["inside", "", first, str(n)] += 1
                    if signature:
                        count["signature", "", signature, ""] += 1
                    count["end", "", before, end] += 1
                    for word in bare.split():
                        if word[0].isalpha():
                            count["word", "", "", _short(word)] += 1
            if count:
                cols = list(zip(*[(*k, v) for k, v in count.items()]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols[:4]] + [pa.array(cols[4], pa.int64())], ["kind", "source", "a", "b", "n"])

    # A text that is there several times shows its lines once.
    one = rows.filter("_text IS NOT NULL").groupBy(F.xxhash64("_source", "_text").alias("_h")).agg(F.min("_id").alias("_id"))
    distinct = rows.join(one.select("_id"), "_id", "left_semi").select("_id", "_source", "_text")
    return distinct.mapInArrow(run, "kind string, source string, a string, b string, n long").groupBy("kind", "source", "a", "b").agg(F.sum("n").alias("n"))


# --- Length limits -----------------------------------------------------------------------------


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def censored_fit(lengths: np.ndarray, counts: np.ndarray, limit: int) -> tuple[float, float]:
    """Mean and deviation of the logarithm, by maximum likelihood with the values at the limit censored (EM)."""
    x, n = np.log(lengths), counts.astype(float)
    at = lengths == limit
    exact, w, c = x[~at], n[~at], n[at].sum()
    m, s = np.average(x, weights=n), max(0.05, math.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n)))
    for _ in range(60):
        a = (math.log(limit) - m) / s
        hazard = math.exp(-a * a / 2) / math.sqrt(2 * math.pi) / max(1e-12, _normal_tail(a))
        mean = m + s * hazard
        square = s * s * (1 + a * hazard) + 2 * m * (mean - m) + m * m
        m_new = ((w * exact).sum() + c * mean) / (w.sum() + c)
        s_new = math.sqrt(max(1e-4, ((w * exact**2).sum() + c * square) / (w.sum() + c) - m_new**2))
        if abs(m_new - m) + abs(s_new - s) < 1e-7:
            break
        m, s = m_new, s_new
    return m, s


def limits(histogram: DataFrame) -> DataFrame:
    """source, unit, limit, observed, posterior, of (source, unit, length, n): the lengths at which a source's texts are cut.

    A task's rows are the distinct lengths of a source; neighbours are summed by prefix sums, so the
    work is that of sorting them, and only lengths that stand out are fitted.
    """

    def find(frame):
        import pandas as pd

        frame = frame[frame["length"] > 0].sort_values("length")
        lengths, n = frame["length"].to_numpy(), frame["n"].to_numpy()
        reach = np.maximum(20, lengths // 20)
        total = np.r_[0, np.cumsum(n)]
        near = total[np.searchsorted(lengths, lengths + reach, "right")] - total[np.searchsorted(lengths, lengths - reach, "left")] - n
        around = near / (2 * reach)
        out = []
        for i in np.nonzero(n >= 4 + 6 * around)[0]:
            if len(lengths) < 3:
                break
            m, s = censored_fit(lengths, n, int(lengths[i]))
            z = (math.log(lengths[i]) - m) / s
            expected = n.sum() * math.exp(-z * z / 2) / (s * math.sqrt(2 * math.pi) * lengths[i])
            posterior = 1 - max(expected, around[i]) / n[i]
            if posterior > 0.5:
                out.append((frame["source"].iloc[0], frame["unit"].iloc[0], int(lengths[i]), int(n[i]), float(posterior)))
        return pd.DataFrame(out, columns=["source", "unit", "limit", "observed", "posterior"])

    return histogram.groupBy("source", "unit").applyInPandas(find, "source string, unit string, limit long, observed long, posterior double")


# --- Endings -----------------------------------------------------------------------------------


def _labels(s: str, pick: int) -> Iterator[tuple[str, str]]:
    """A text ended once more: at a place inside (``cut``), and at an inner line end (``whole``)."""
    s = s.rstrip()
    if len(s) >= 40:
        yield "cut", s[: len(s) // 2 + pick % (len(s) - len(s) // 2)]
    ends = [m.start() for m in re.finditer(r"\r?\n\s*\S", s) if s[: m.start()].strip()]
    if ends:
        yield "whole", s[: ends[pick % len(ends)]]


def _endings(rows: DataFrame, texts: int) -> DataFrame:
    """A row per text, and per label of those picked: _row, _id, variant, source, lengths, how it ends and what it ends with."""
    names = ["_row", "_id", "source", "variant", "points", "bytes", "how", "first", "words", "signature", "before", "last"]
    picked = F.when(F.pmod(F.xxhash64("_id", "_source"), F.lit(max(1, texts))) < LABELLED, F.xxhash64("_source", "_id").bitwiseAND(0x7FFFFFFF)).otherwise(-1)
    source = rows.select(F.monotonically_increasing_id().alias("_row"), "_id", "_source", "_text", picked.alias("_pick"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            out: list[list] = [[] for _ in names[3:]]
            for i, (s, pick) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                s = s or ""
                for variant, t in [("real", s), *(_labels(s, pick) if pick >= 0 else ())]:
                    how, part = ending(t)
                    first, n, signature, before, last = _keys(part) if how in ("line", "title") else ("", 0, "", "", "")
                    if how == "dots":
                        first, _, last = part.partition("\t")
                    size = (len(t), len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass"))) if variant == "real" else (0, 0)
                    at.append(i)
                    for column, v in zip(out, (variant, *size, how, first, str(n), signature, before, last)):
                        column.append(v)
            kinds = [pa.string(), pa.int64(), pa.int64()] + [pa.string()] * 6
            taken = [batch.column(k).take(pa.array(at, pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays(taken + [pa.array(c, k) for c, k in zip(out, kinds)], names)

    kind = rows.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"_row long, _id {kind}, source string, variant string, points long, bytes long, " + ", ".join(f"{c} string" for c in names[6:]))


def _counts(stats: DataFrame) -> DataFrame:
    """key, n: every count that endings are looked up in, by one hash of its kind and parts."""
    own = stats.select("kind", "source", "a", "b", "n")
    everywhere = stats.filter("kind = 'all'").select(F.lit("everywhere").alias("kind"), F.lit("").alias("source"), "a", F.lit("").alias("b"), "n")

    def begins(kind: str, whole: str, to: str, a, b) -> DataFrame:
        # Every shorter begin of a word or signature; both are at most LONG, longer ones stand for themselves.
        cut = stats.filter((F.col("kind") == kind) & ~F.col(whole).startswith("#") & (F.length(whole) > 1))
        cut = cut.select("*", F.explode(F.sequence(F.lit(1), F.length(whole) - 1)).alias("_i"))
        part = F.substring(F.col(whole), F.lit(1), F.col("_i"))
        return cut.select(F.lit(to).alias("kind"), F.lit("").alias("source"), a(part).alias("a"), b(part).alias("b"), "n")

    longer = begins("end", "b", "longer", lambda p: F.col("a"), lambda p: p)
    words = begins("word", "b", "longer_word", lambda p: F.lit(""), lambda p: p)
    signs = begins("signature", "a", "longer_signature", lambda p: p, lambda p: F.lit(""))
    every = own.unionAll(everywhere).unionAll(longer).unionAll(words).unionAll(signs)
    return every.groupBy(F.xxhash64("kind", "source", "a", "b").alias("key")).agg(F.sum("n").alias("n"))


#: What an ending is looked up in: kind, and the columns that are its source, a and b.
_LOOKUPS = [
    ("first", "source", "first", "words"), ("all", "source", "first", None), ("inside", None, "first", "words"), ("everywhere", None, "first", None),
    ("signature", None, "signature", None), ("longer_signature", None, "signature", None), ("end", None, "before", "last"), ("longer", None, "before", "last"),
    ("word", None, None, "last"), ("longer_word", None, None, "last"),
]
_DOTS_LOOKUPS = [("dotted", None, "first", None), ("marked", None, "first", None), ("word", None, None, "last"), ("longer_word", None, None, "last")]


def _classed(ends: DataFrame, counts: DataFrame, found: DataFrame) -> DataFrame:
    """_row, _id, source, variant, at, prior, class, dots: the class of each ending that isn't blank or a sentence's end.

    Only these endings are looked up, so what most texts have in common is no join key; all counts
    are found by one join on the hash of kind and parts.
    """
    keys = lambda table: F.array(*[F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), *[F.col(c) if c else F.lit("") for c in parts]).alias("key")) for k, *parts in table])
    carried = ["_row", "_id", "source", "variant", "points", "bytes", "how", "signature", "last"]
    open_ = ends.filter(~F.col("how").isin("blank", "end"))
    looked = open_.select(*carried, F.explode_outer(F.when(F.col("how") == "dots", keys(_DOTS_LOOKUPS)).when(F.col("how").isin("line", "title"), keys(_LOOKUPS))).alias("_l"))
    j = looked.select(*carried, "_l.k", "_l.key").join(counts, "key", "left")
    n = {k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k, *_ in _LOOKUPS + _DOTS_LOOKUPS[:2]}
    # What is the same within a row needs no comparing, and its _row and variant are unique.
    same = [c for c in carried if c not in ("_row", "variant")]
    g = j.groupBy("_row", "variant").agg(*[F.first(c).alias(c) for c in same], *n.values())
    c = lambda k: F.col(f"n_{k}")
    # A made-up name may well begin like a longer one; other words are half if longer ones stand there by far more often.
    longer = ((F.col("how") != "dots") & (c("longer") > 3 * (c("end") - 1) + 1)) | ((c("longer_word") >= 3) & (c("longer_word") >= 20 * (c("word") - 1)))
    lower = ~F.col("last").rlike(r"^\p{Lu}")
    half = longer & lower
    often = (c("first") >= 4) & (c("first") * 12 >= c("all"))
    inside = (c("inside") >= 3) & (c("inside") * 50 >= c("everywhere"))
    signs = (c("signature") >= 4) & (c("signature") * 50 >= c("longer_signature"))
    known = F.when(F.col("signature") != "", signs).otherwise(often | inside)
    kind = (
        F.when(F.col("how") == "title", F.when(half & F.col("last").rlike(r"^\p{Ll}"), "title_half").when(known, "title_known").otherwise("title"))
        .when(F.col("how") == "line", F.when(half, "line_half").when(known, "line_known").otherwise("line")).otherwise(F.col("how"))
    )
    # Dots: how likely a cut leaves them, to how often whole sentences that begin so have them (without the text's own).
    others = F.greatest(c("dotted") - 1, F.lit(0))
    dots = MARKED * (others + c("marked") + 1) / (others + HABIT)
    out = g.select("_row", "_id", "source", "variant", "points", "bytes", kind.alias("class"), dots.alias("dots"), F.when(F.col("last").rlike(r"^\p{Ll}") & (c("word") + c("longer_word") > 0), half).alias("half"))
    return _at_limits(out, found)


def _at_limits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``at``, the limit that a text's length is ('' for none), and ``prior``, the limit's posterior by the lengths."""
    for unit in ("points", "bytes"):
        at = found.filter(F.col("unit") == unit).select("source", F.col("limit").alias(unit), F.col("posterior").alias(f"_p_{unit}"))
        rows = rows.join(at, ["source", unit], "left")
    points = F.coalesce("_p_points", F.lit(0.0)) >= F.coalesce("_p_bytes", F.lit(0.0))
    at = F.when(F.col("_p_points").isNull() & F.col("_p_bytes").isNull(), "").when(points, F.concat(F.lit("points "), F.col("points"))).otherwise(F.concat(F.lit("bytes "), F.col("bytes")))
    return rows.withColumn("at", at).withColumn("prior", F.greatest(F.coalesce("_p_points", F.lit(0.0)), F.coalesce("_p_bytes", F.lit(0.0)))).drop("points", "bytes", "_p_points", "_p_bytes")


# --- Both together -----------------------------------------------------------------------------


def posteriors(table: DataFrame, cut_share: dict[str, float], whole_share: dict[str, float], rounds: int = 40) -> DataFrame:
    """source, at, class, share, odds: by EM, of (source, variant, at, prior, class, n), per source.

    ``share`` is what part of the texts at a limit, or at none, is cut; ``odds`` the log odds of a
    text of that class there. All sources' labels are where a source's likelihoods begin.
    """

    def fit(frame):
        import pandas as pd

        index = {c: i for i, c in enumerate(CLASSES)}
        real = frame[frame["variant"] == "real"]
        strata = sorted(real["at"].unique())
        n = np.zeros((len(strata), len(CLASSES)))
        q0 = np.full(len(strata), BROKEN)
        for a, p, c, v in real[["at", "prior", "class", "n"]].itertuples(index=False):
            n[strata.index(a), index[c]] += v
            if a:
                q0[strata.index(a)] = p
        label = {v: np.zeros(len(CLASSES)) for v in ("cut", "whole")}
        for v, c, m in frame[frame["variant"] != "real"][["variant", "class", "n"]].itertuples(index=False):
            label[v][index[c]] += m
        begin = lambda share: np.array([share.get(c, 0.0) for c in CLASSES])
        # Where a cut falls depends on who cuts, so those labels count little; whole line ends count in full.
        cut0 = LABELS_CUT * (label["cut"] + 20 * begin(cut_share)) / (label["cut"].sum() + 20)
        whole0 = label["whole"] + LABELS_ALL * begin(whole_share)
        fixed = np.array([c in ("blank", "end", "dots", "line_known") or c.startswith("title") for c in CLASSES])
        # Inner lines can't tell how often texts are titles or end with a habitual line: these the texts themselves tell as well.
        learnt = np.array([c in ("end", "line_known") or c.startswith("title") for c in CLASSES])
        cut_, whole, q = cut0 / cut0.sum(), whole0 / whole0.sum(), q0.copy()
        for _ in range(rounds):
            r = q[:, None] * cut_ / np.maximum(1e-300, q[:, None] * cut_ + (1 - q[:, None]) * whole)
            r[:, index["blank"]] = 0
            # Dots have their likelihood by their own sentence's habit and tell nothing here.
            m = np.where(np.arange(len(CLASSES)) == index["dots"], 0, n)
            c_new, w_new = cut0 + (r * m).sum(0), (whole0 + ((1 - r) * m).sum(0)) * learnt
            cut_ = np.where(fixed, cut_, c_new / c_new.sum())
            whole = np.where(learnt, w_new / w_new.sum() * (1 - (whole * ~learnt).sum()), whole)
            weight = np.where([bool(a) for a in strata], LENGTHS, 20.0)
            q = np.clip(((r * m).sum(1) + weight * q0) / (m.sum(1) + weight), 1e-6, 1 - 1e-6)
        odds = np.log(q / (1 - q))[:, None] + np.log(np.maximum(cut_, 1e-12) / np.maximum(whole, 1e-12))
        rows = [(frame["source"].iloc[0], a, c, float(q[i]), float(odds[i, k])) for i, a in enumerate(strata) for c, k in index.items()]
        return pd.DataFrame(rows, columns=["source", "at", "class", "share", "odds"])

    return table.groupBy("source").applyInPandas(fit, "source string, at string, class string, share double, odds double")


def _scored(df: DataFrame, key: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """The texts that may be cut, with their odds; and all endings."""
    rows = _rows(df, text, source, key)
    ends = _cut(_endings(rows, df.count()))
    counts = _counts(_cut(line_statistics(rows)))
    real = ends.filter("variant = 'real'")
    sized = real.select("source", F.explode(F.array(F.struct(F.lit("points").alias("unit"), F.col("points").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("s"))
    found = _cut(limits(sized.groupBy("source", "s.unit", "s.length").agg(F.count(F.lit(1)).alias("n"))))
    classed = _cut(_classed(ends, counts, found))
    # Whole texts are counted by their length first, so limits are joined to lengths, not to texts.
    plain = ends.filter(F.col("how").isin("blank", "end")).groupBy("source", "variant", "points", "bytes", F.col("how").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    by = ["source", "variant", "at", "prior", "class"]
    table = _at_limits(plain, found).unionByName(classed.withColumn("n", F.lit(1)).select(*by, "n")).groupBy(*by).agg(F.sum("n").alias("n"))
    table = _cut(table)
    # Of fixed size: one row per variant and class.
    labels = {(r[0], r[1]): r[2] for r in table.filter("variant <> 'real'").groupBy("variant", "class").agg(F.sum("n")).collect()}
    share = lambda v: {c: (labels.get((v, c), 0) + 0.5) / (sum(n for (u, _), n in labels.items() if u == v) + 0.5 * len(CLASSES)) for c in CLASSES}
    fitted = posteriors(table, share("cut"), share("whole"))
    j = classed.filter("variant = 'real'").join(fitted, ["source", "at", "class"])
    # A half word before the dots tells as much as one at a line's end.
    lines = {v: share(v)["line_half"] / (share(v)["line_half"] + share(v)["line"]) for v in ("cut", "whole")}
    word = F.when(F.col("half").isNull(), 1.0).when(F.col("half"), lines["cut"] / lines["whole"]).otherwise((1 - lines["cut"]) / (1 - lines["whole"]))
    dots = F.log(F.col("share") / (1 - F.col("share"))) + F.log("dots") + F.log(word)
    return j.withColumn("odds", F.when(F.col("class") == "dots", dots).otherwise(F.col("odds"))), real


def score(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, class, at, limit_posterior, share, odds of each text that doesn't end with a sentence: its log odds of having been cut.

    ``limit_posterior`` is what the lengths alone say of its limit, ``share`` what part of the texts there is cut by both kinds of evidence.
    """
    j, _ = _scored(df, key, text, source)
    return j.select(F.col("_id").alias(key), "source", "class", "at", F.round("prior", 6).alias("limit_posterior"), F.round("share", 6).alias("share"), F.round("odds", 6).alias("odds"))


def truncated(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source of the texts that were cut."""
    return score(df, key, text, source).filter("odds > 0").select(key, "source")


def rates(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """source, texts, cut, rate, at_limit: how often each source's texts are cut, and how many of those at a field limit."""
    j, real = _scored(df, key, text, source)
    hits = j.filter("odds > 0").groupBy("source").agg(F.count(F.lit(1)).alias("cut"), F.sum((F.col("at") != "").cast("long")).alias("at_limit"))
    every = real.groupBy("source").agg(F.count(F.lit(1)).alias("texts")).join(hits, "source", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return every.select("source", "texts", n("cut").alias("cut"), F.round(n("cut") / F.col("texts"), 6).alias("rate"), n("at_limit").alias("at_limit"))
