"""From field arrays to named columns, when every file brings its own header."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def last_positions(header: list[str]) -> dict[str, int]:
    """Zero-based position of each name; the last column of a name wins, blanks have none."""
    return {n: i for i, n in enumerate(header) if n != ""}


def field_at(i: int, decimal_separator: str = "."):
    return clean_field(F.get(F.col("_fields"), F.lit(i)), decimal_separator)


def clean_positions(rows: DataFrame, decimal_separator: str = ".") -> DataFrame:
    """Fields by position read like named ones; nothing is done where no one asks for them."""
    return rows.withColumn("_fields", F.transform("_fields", lambda c: clean_field(c, decimal_separator)))


def clean_field(c, decimal_separator: str = "."):
    c = F.coalesce(F.trim(c), F.lit(""))
    return c if decimal_separator == "." else normalise_decimal(c, decimal_separator)


def normalise_decimal(c, sep: str):
    """Spell a number written with another decimal separator with a dot, digit for digit."""
    s = "\\" + sep
    grouped = rf"^-?[0-9]{{1,3}}(\.[0-9]{{3}})+({s}[0-9]+)?$"
    plain = rf"^-?[0-9]+{s}[0-9]*$|^-?{s}[0-9]+$"
    bare = F.replace(c, F.lit("."), F.lit(""))
    return (
        F.when(~(c.contains(sep) | c.contains(".")), c)
        .when(c.rlike(grouped), F.replace(bare, F.lit(sep), F.lit(".")))
        .when(c.rlike(plain), F.replace(c, F.lit(sep), F.lit(".")))
        .otherwise(c)
    )


@dataclass(frozen=True)
class HeaderProfile:
    """What all headers of a source have in common."""

    width: int
    kinds: int
    sample: list


def profile(headers: DataFrame) -> HeaderProfile:
    r = headers.agg(
        F.max(F.size("_header")).alias("w"),
        F.count_distinct("_header").alias("k"),
        F.max("_header").alias("h"),
    ).collect()[0]
    return HeaderProfile(max(r.w or 1, 1), r.k, list(r.h or []))


def name_columns(rows: DataFrame, headers: DataFrame, seen: HeaderProfile, columns=None, decimal_separator=".") -> DataFrame:
    """Add named columns to rows that hold ``_path`` and ``_fields``.

    ``headers`` has one row per file (``_path``, ``_header``). With one header
    for all files, positions are constants; otherwise they come from a join.
    """
    if seen.kinds <= 1:
        at = last_positions(seen.sample)
        names = list(at) if columns is None else [c for c in columns if c in at]
        return rows.select(*rows.columns, *[field_at(at[n], decimal_separator).alias(n) for n in names])
    if columns is None:
        found = headers.select(F.explode("_header").alias("n")).filter("n <> ''").distinct().collect()
        columns = sorted(r.n for r in found)
    # array_position finds the first entry, so search the reversed header for the last one
    width = F.size("_header")
    back = F.reverse(F.col("_header"))
    places = F.array(
        *[
            F.when(F.array_contains("_header", c), width - F.array_position(back, c).cast("int"))
            for c in columns
        ]
    )
    table = headers.select(F.col("_path").alias("_hp"), places.alias("_at"))
    joined = rows.join(table, rows["_path"] == table["_hp"], "left")
    named = [
        clean_field(F.get(F.col("_fields"), F.get(F.col("_at"), F.lit(i))), decimal_separator).alias(c)
        for i, c in enumerate(columns)
    ]
    return joined.select(*rows.columns, *named)
