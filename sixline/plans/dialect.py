"""The few functions that Spark's and DuckDB's SQL write differently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sixline.session import table


class Dialect:
    """SQL fragments of one engine."""

    def __init__(self, spark: bool) -> None:
        self.spark = spark

    def text(self, s: str) -> str:
        """A literal whose backslashes count as such."""
        return ("r" if self.spark else "") + "'" + s.replace("'", "''") + "'" if "'" not in s or not self.spark else '"' + s.replace("\\", "\\\\") + '"'

    def hexint(self, s: str) -> str:
        return f"CAST(conv({s}, 16, 10) AS BIGINT)" if self.spark else f"CAST('0x' || {s} AS BIGINT)"

    def sha256(self, s: str) -> str:
        return f"sha2({s}, 256)" if self.spark else f"sha256({s})"

    def xor(self, a: str, b: str) -> str:
        return f"(({a}) ^ ({b}))" if self.spark else f"xor({a}, {b})"

    def chars(self, s: str) -> str:
        return f"split({s}, '')" if self.spark else f"string_split({s}, '')"

    def fold(self, s: str, start: str, step: Callable[[str, str], str]) -> str:
        """A fold over a text's code points."""
        body = step("h", "c")
        if self.spark:
            return f"aggregate(transform(split({s}, ''), c -> CAST(ascii(c) AS BIGINT)), CAST({start} AS BIGINT), (h, c) -> {body})"
        return f"list_reduce(list_prepend(CAST({start} AS BIGINT), list_transform(list_filter(string_split({s}, ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: {body})"

    def tokens(self, s: str, pattern: str) -> str:
        return f"regexp_extract_all({s}, {self.text(pattern)}, 0)" if self.spark else f"regexp_extract_all({s}, {self.text(pattern)})"

    def replace(self, s: str, pattern: str, by: str) -> str:
        return f"regexp_replace({s}, {self.text(pattern)}, '{by}')" if self.spark else f"regexp_replace({s}, {self.text(pattern)}, '{by}', 'g')"

    def matches(self, s: str, pattern: str) -> str:
        return f"({s} RLIKE {self.text(pattern)})" if self.spark else f"regexp_matches({s}, {self.text(pattern)})"

    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS BIGINT)" if self.spark else f"CAST(len({a}) AS BIGINT)"

    def explode(self, a: str) -> str:
        return f"explode({a})" if self.spark else f"unnest({a})"

    def numbers(self, n: int) -> str:
        """A relation with column i of 0 .. n-1."""
        return f"(SELECT CAST(id AS INT) AS i FROM range({n}))" if self.spark else f"(SELECT CAST(range AS INT) AS i FROM range({n}))"

    def last(self, value: str, by: str) -> str:
        return f"max_by({value}, {by})" if self.spark else f"arg_max({value}, {by})"


SPARK, DUCK = Dialect(True), Dialect(False)


def even(sql: str) -> str:
    """``round(v, n)`` of all digits rewritten to one formula: the engines' own rounding differs on values that lie half way.

    Halves, as far as doubles tell, are always rounded up.
    """
    at = sql.find("round(")
    while at >= 0:
        if at and (sql[at - 1].isalnum() or sql[at - 1] == "_"):
            at = sql.find("round(", at + 1)
            continue
        depth, i, comma = 1, at + 6, -1
        while depth:
            ch = sql[i]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = i
            i += 1
        inner, digits = sql[at + 6 : comma], int(sql[comma + 1 : i - 1])
        sql = f"{sql[:at]}(floor(({inner}) * 1e{digits} + 0.5001) / 1e{digits}){sql[i:]}"
        at = sql.find("round(", at + 1)
    return sql


def shared(text: Callable[[Dialect], str], tables: tuple[str, ...] = ()) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """A query of SQL for Spark, with the named tables as views, and its form for DuckDB."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        for t in tables:
            table(spark, d, t).createOrReplaceTempView(t)
        return spark.sql(even(text(SPARK)))

    return run, even(text(DUCK))
