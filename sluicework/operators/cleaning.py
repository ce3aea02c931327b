"""Cleaning jobs: a table in, the cleaned table and its failure counts out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..functions.values import NUM, Val, num, text

f = fn.field


class Cleaned:
    """The cleaned rows and, lazily, how many cells of each column failed."""

    def __init__(self, rows: DataFrame, source: dict[str, str]):
        self.rows = rows
        self._source = source  # output column -> column that held the input text

    def failures(self) -> DataFrame:
        """Per column: filled cells, and filled cells that gave no result. One pass, no shuffle of rows."""
        aggs = []
        for out, src in self._source.items():
            filled = F.trim(F.col(f"`{src}`")) != ""
            aggs.append(F.count_if(filled).alias(f"{out}|filled"))
            failed = F.col(f"`{out}`").isNull() | ((F.col(f"`{out}`").cast("string") == "") & filled)
            aggs.append(F.count_if(filled & failed).alias(f"{out}|failed"))
        one = self.rows.agg(*aggs)
        return one.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(o).alias("column"),
                            F.col(f"`{o}|filled`").alias("filled"),
                            F.col(f"`{o}|failed`").alias("failed"),
                        )
                        for o in self._source
                    ]
                )
            )
        )


def _with(df: DataFrame, made: dict[str, Val], typed=None) -> DataFrame:
    return df.select("*", *[(num(v) if typed and typed[c] else text(v)).alias(c) for c, v in made.items()])


def number_value(name: str, style: str) -> Val:
    """A text column in a declared style as an exact number."""
    c = fn.trim(f(name))
    if style == "us":
        out = c * 1
    elif style == "eu":
        out = fn.replace(c, ".", "", ",", ".") * 1
    elif style == "space":
        out = fn.replace(c, " ", "", ",", ".") * 1
    elif style == "parentheses":
        out = fn.if_(fn.starts_with(c, "("), -(fn.replace(c, "(", "", ")", "") * 1), c * 1)
    elif style == "currency":
        out = fn.price_value(c) * 1
    elif style == "rate":
        out = fn.if_(
            fn.contains(c, "%"),
            fn.replace(c, "%", "") / 100,
            fn.if_(fn.contains(c, "bps"), fn.split_part(c, " ", 1) / 10000, c * 1),
        )
    elif style == "unit":
        out = fn.split_part(c, " ", 1) * 1
    else:
        raise ValueError(f"unknown number style {style!r}")
    return out


def clean_numbers(df: DataFrame, columns: dict[str, str], round_to: int | None = None, suffix="_num") -> Cleaned:
    """Exact decimals from text; a blank cell stays NULL and is no failure."""
    made = {}
    for name, style in columns.items():
        v = number_value(name, style)
        made[name] = v if round_to is None else fn.round_(v, round_to)
    filled = {n: F.trim(F.col(f"`{n}`"), F.lit(" \t\r\n")) != "" for n in columns}
    rows = df.select("*", *[F.when(filled[n], num(v)).cast(NUM).alias(n + suffix) for n, v in made.items()])
    return Cleaned(rows, {n + suffix: n for n in columns})


def clean_dates(df: DataFrame, columns: dict[str, str], workdays: int | None = None, suffix="_iso") -> Cleaned:
    """ISO dates from declared formats, optionally with a business-day shift and calendar columns."""
    made = {}
    for name, fmt in columns.items():
        made[name + suffix] = fn.date_convert(f(name), fmt, "YYYY-MM-DD")
    rows = _with(df, made)
    extra = {}
    for name in columns:
        d = f(name + suffix)
        extra[name + "_month"] = fn.date_trunc("month", d)
        extra[name + "_weekday"] = fn.weekday(d)
        if workdays is not None:
            extra[name + "_due"] = fn.workday(d, workdays)
    return Cleaned(_with(rows, extra), {n + suffix: n for n in columns})


def normalise_zones(df: DataFrame, time: str, zone: Val | str, target: str) -> Cleaned:
    """UTC and target-zone columns of a local time, its offset and its DST flag."""
    z = f(zone[1:]) if isinstance(zone, str) and zone.startswith("$") else zone
    t = f(time)
    made = {
        f"{time}_utc": fn.tz_convert(t, z, "UTC"),
        f"{time}_local": fn.tz_convert(t, z, target),
        f"{time}_offset": fn.tz_offset(t, z),
        f"{time}_dst": fn.is_dst(t, z),
    }
    return Cleaned(_with(df, made), {f"{time}_utc": time, f"{time}_local": time, f"{time}_offset": time})


# Spellings of missing, true and false.
NULL_WORDS = ("NULL", "NA", "N/A", "n/a", "None", "none", "-")
TRUE_WORDS = ("yes", "y", "1", "true", "t")
FALSE_WORDS = ("no", "n", "0", "false", "f")


def blank_nulls(name: str) -> Val:
    c = fn.trim(f(name))
    return fn.if_(fn.in_(c, *NULL_WORDS), "", c)


def boolean_word(name: str) -> Val:
    c = fn.lower(fn.trim(f(name)))
    return fn.if_(
        fn.isempty(f(name)), "", fn.if_(fn.in_(c, *TRUE_WORDS), "true", fn.if_(fn.in_(c, *FALSE_WORDS), "false", ""))
    )


def clean_text(df: DataFrame, columns: dict[str, list[str]], suffix="_clean") -> Cleaned:
    """Apply named steps per column: trim, upper, lower, proper, unaccent, nulls, boolean, digits."""
    steps = {
        "trim": fn.trim,
        "upper": fn.upper,
        "lower": fn.lower,
        "proper": fn.proper,
        "unaccent": fn.unaccent,
        "nulls": lambda v: fn.if_(fn.in_(fn.trim(v), *NULL_WORDS), "", fn.trim(v)),
        "boolean": lambda v: fn.case(fn.lower(fn.trim(v)), *[x for w in TRUE_WORDS for x in (w, "true")],
                                     *[x for w in FALSE_WORDS for x in (w, "false")], ""),
        "digits": lambda v: fn.regex_replace(v, "[^0-9]+", ""),
    }
    made = {}
    for name, todo in columns.items():
        v = f(name)
        for step in todo:
            v = steps[step](v)
        made[name + suffix] = v
    return Cleaned(_with(df, made), {n + suffix: n for n in columns})


def map_codes(df: DataFrame, columns: dict[str, dict[str, str]], suffix="_label") -> tuple[DataFrame, DataFrame]:
    """Whole-value maps with pass-through, and the values no map knew with their counts."""
    rows = _with(df, {n + suffix: fn.remap(f(n), m) for n, m in columns.items()})
    pairs = F.array(
        *[
            F.when(
                ~F.col(f"`{n}`").isin(list(m)), F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").alias("value"))
            )
            for n, m in columns.items()
        ]
    )
    unknown = df.select(F.inline(F.array_compact(pairs))).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return rows, unknown
