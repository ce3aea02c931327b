"""Cells and lines of a delimited or JSON output, as Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import session_conf
from ..sources.text import ENCODINGS, NOT_IN_JVM, QUOTES, encode_text

FORMULA = r"^[=\t\r]|(?s)^[+\-@].*[A-Za-z0-9_.]\(|^[+\-@].*\|.*!"


@dataclass(frozen=True)
class CsvSpec:
    delimiter: str = ","
    quote: str = "none"
    decimal_separator: str = "."
    encoding: str = "utf-8"
    header: bool = True

    def __post_init__(self):
        if self.quote not in QUOTES or self.encoding not in ENCODINGS or len(self.delimiter) != 1:
            raise ValueError("bad output format")


def csv_cell(c: Column, spec: CsvSpec) -> Column:
    """A value written safely: no formula can start, no line or delimiter can break out."""
    s = c
    if spec.decimal_separator != ".":
        plain = (F.octet_length(c) <= 64) & c.rlike(r"^-?[0-9]+(\.[0-9]*)?$")
        s = F.when(plain, F.replace(c, F.lit("."), F.lit(spec.decimal_separator))).otherwise(c)
    q = QUOTES[spec.quote]
    if not q:
        return _one_line(_guarded(s))
    wrap = s.contains("\n") | s.contains("\r") | s.contains(spec.delimiter) | s.contains(q)
    return F.when(wrap, F.concat(F.lit(q), _guarded(F.replace(s, F.lit(q), F.lit(q + q))), F.lit(q))).otherwise(_guarded(s))


def _guarded(s: Column) -> Column:
    # a formula can only start below '0' or between '=' and '@': most cells skip the pattern
    suspect = (s < "A") & ((s >= "=") | (s < "0"))
    return F.when(suspect & s.rlike(FORMULA), F.concat(F.lit("'"), s)).otherwise(s)


def _one_line(s: Column) -> Column:
    flat = F.replace(F.replace(s, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\\n"))
    return F.when(s.contains("\n") | s.contains("\r"), flat).otherwise(s)


def csv_line(columns: list[str], spec: CsvSpec) -> Column:
    """All cells of a row. Line breaks and quoting are looked at once per row, cells only where needed."""
    raw = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]
    q = QUOTES[spec.quote]
    if spec.decimal_separator != ".":
        return F.concat_ws(spec.delimiter, *[csv_cell(c, spec) for c in raw])
    line = F.concat_ws(spec.delimiter, *[_guarded(c) for c in raw])
    if not q:
        return _one_line(line)
    spare = F.length(line) - F.length(F.replace(line, F.lit(spec.delimiter), F.lit("")))
    plain = ~line.contains(q) & ~line.contains("\n") & ~line.contains("\r") & (spare == len(columns) - 1)
    careful = F.array_join(F.transform(F.array(*raw), lambda c: csv_cell(c, spec)), spec.delimiter)
    return F.when(plain, line).otherwise(careful)


def csv_header(columns: list[str], spec: CsvSpec) -> Column:
    return F.concat_ws(spec.delimiter, *[csv_cell(F.lit(c), spec) for c in columns])


def json_line(columns: list[str]) -> Column:
    """One object, every value a string, ill-formed bytes replaced."""
    return F.to_json(
        F.struct(*[F.make_valid_utf8(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) for c in columns])
    )


def encode_lines(spark: SparkSession, df: DataFrame, encoding: str) -> DataFrame:
    """Hold the bytes of ``line`` in another code page; unmappable characters become ``?``."""
    if encoding == "utf-8":
        return df
    if encoding in NOT_IN_JVM:

        @F.pandas_udf("binary")
        def encode(s: pd.Series) -> pd.Series:
            return s.map(lambda t: None if t is None else encode_text(t, encoding))

        return df.withColumn("line", encode("line").cast("string"))
    with session_conf(
        spark, {"spark.sql.legacy.javaCharsets": "true", "spark.sql.legacy.codingErrorAction": "true"}
    ):
        out = df.withColumn("line", F.encode("line", encoding).cast("string"))
        out.schema
        return out
