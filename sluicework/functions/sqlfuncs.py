"""The pure functions as Spark SQL functions, so a template can be written in SQL.

Each function's body is the analysed form of the Python builder, so both front
doors share one definition and Catalyst inlines it into the query.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import dates, logic, mapping, numbers, zones
from .text import (
    contains, ends_with, left, len_, lower, lpad, position, right, rpad, split_part, starts_with, substr, trim, unaccent_body, upper,
)
from .values import (
    add, and_, canonical_text, compare, concat, eq, neg, not_, or_, register_functions, spelled_out, sub, text, text_to_num, val,
)

_NUMERIC_TEXT = "a b c d e".split()


def _catalogue():
    """Name -> (builder over text columns, number of arguments)."""
    out = {
        "add": (add, 2), "sub": (sub, 2), "neg": (neg, 1), "eq": (eq, 2), "concat": (concat, 2), "in": (logic.in_, 3),
        "lt": (lambda a, b: compare(a, "<", b), 2), "le": (lambda a, b: compare(a, "<=", b), 2),
        "and": (and_, 2), "or": (or_, 2), "not": (not_, 1),
        "if": (logic.if_, 3), "case": (logic.case, 4), "iferror": (logic.iferror, 2), "coalesce": (logic.coalesce, 3),
        "nullif": (logic.nullif, 2), "isempty": (logic.isempty, 1), "is_numeric": (logic.is_numeric, 1),
        "trim": (trim, 1), "left": (left, 2), "right": (right, 2), "substr": (substr, 3), "len": (len_, 1),
        "upper": (upper, 1), "lower": (lower, 1),
        "contains": (contains, 2), "starts_with": (starts_with, 2), "ends_with": (ends_with, 2),
        "split_part": (split_part, 3), "position": (position, 2), "lpad": (lpad, 3), "rpad": (rpad, 3),
        "replace": (mapping.replace, 3), "remap": (lambda s, k, v: logic.case(s, k, v, s), 3),
        "abs": (numbers.abs_, 1), "floor": (numbers.floor, 1), "ceiling": (numbers.ceiling, 1), "trunc": (numbers.trunc, 1),
        "round": (lambda x: numbers.round_(x, 0), 1), "round_cents": (lambda x: numbers.round_(x, 2), 1),
        "sign": (numbers.sign, 1), "mod": (numbers.mod, 2), "mround": (numbers.mround, 2),
        "greatest": (numbers.greatest, 2), "least": (numbers.least, 2),
        "price_value": (numbers.price_value, 1), "price_currency": (numbers.price_currency, 1),
        "is_date": (dates.is_date, 1), "dateadd": (dates.dateadd, 2), "datediff": (dates.datediff, 2), "workday": (dates.workday, 2),
        "year": (dates.year, 1), "month": (dates.month, 1), "day": (dates.day, 1), "weekday": (dates.weekday, 1),
        "quarter": (dates.quarter, 1), "weeknum": (dates.weeknum, 1), "hour": (dates.hour, 1), "minute": (dates.minute, 1),
        "second": (dates.second, 1), "eomonth": (dates.eomonth, 1), "nth_dow": (dates.nth_dow, 4),
        "tz_offset": (dates.tz_offset, 2), "tz_convert": (dates.tz_convert, 3),
    }
    return out


#: Functions that are SQL functions already; a call to one has no SQL spelling in an analysed plan.
_EXACT = {"neg": "sw_exact_neg", "abs": "sw_exact_abs"}


def _body(spark, col) -> str:
    empty = spark.createDataFrame([], ", ".join(f"{a} string" for a in _NUMERIC_TEXT))
    plan = empty.select(col.alias("x"))._jdf.queryExecution().analyzed()
    return plan.expressions().head().child().sql()


def register_sql(spark: SparkSession, names=None, prefix: str = "sw_") -> list[str]:
    """Create the functions (all, or the named ones); arguments and results are text. Returns the names."""
    register_functions(spark)
    with spelled_out():
        return _register(spark, names, prefix)


def _register(spark: SparkSession, names, prefix: str) -> list[str]:
    made = []
    for name, (build, n) in _catalogue().items():
        if names is not None and name not in names:
            continue
        if name in _EXACT:
            a = _body(spark, text_to_num(F.col("a")))
            shown = f"rtrim('.', rtrim('0', CAST({_EXACT[name]}({a}) AS STRING)))"
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(a STRING) RETURNS STRING RETURN {shown}")
            made.append(prefix + name)
            continue
        args = _NUMERIC_TEXT[:n]
        body = _body(spark, text(build(*[val(F.col(a)) for a in args])))
        params = ", ".join(f"{a} STRING" for a in args)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({params}) RETURNS STRING RETURN {body}")
        made.append(prefix + name)
    for name, call in (("times", "sw_mul"), ("over", "sw_div")):
        a, b = (_body(spark, text_to_num(F.col(x))) for x in "ab")
        raw = f"{call}({a}, {b})"
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(a STRING, b STRING) RETURNS STRING RETURN "
            + (f"CASE WHEN {b} = 0 AND {a} IS NOT NULL THEN '' ELSE " if name == "over" else "(")
            + f"rtrim('.', rtrim('0', CAST({raw} AS STRING)))"
            + (" END" if name == "over" else ")")
        )
        made.append(prefix + name)
    # a lambda has no SQL spelling in an analysed plan, so this one is written out
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}proper(a STRING) RETURNS STRING RETURN array_join(transform("
        r"regexp_extract_all(lower(a), r'([A-Za-z\x{80}-\x{10FFFF}]+|[^A-Za-z\x{80}-\x{10FFFF}]+)', 1), "
        "w -> concat(upper(substring(w, 1, 1)), substring(w, 2))), '')"
    )
    made.append(prefix + "proper")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}unaccent(c STRING) RETURNS STRING RETURN {unaccent_body()}")
    made.append(prefix + "unaccent")
    if names is None or "is_dst" in names:
        seconds = _body(spark, zones.seconds_of(dates._moment(F.col("a"))))
        places, moments = zones.every_zone(sorted(dates.zone_names()))
        place = f"try_element_at(get(from_json('{places}', 'array<map<string,int>>'), CAST(crc32(CAST(b AS BINARY)) % {zones.BUCKETS} AS INT)), b)"
        passed = f"get(get(from_json('{moments}', 'array<array<bigint>>'), a.place), a.n + s - 1) <= a.seconds"
        inside = (
            f"aggregate(array({', '.join(str(s) for s in zones.STEPS)}), named_struct('n', 0, 'seconds', {seconds}, 'place', {place}), "
            f"(a, s) -> named_struct('n', CASE WHEN {passed} THEN a.n + s ELSE a.n END, 'seconds', a.seconds, 'place', a.place), a -> a.n % 2 = 1)"
        )
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}is_dst(a STRING, b STRING) RETURNS STRING RETURN "
            f"CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CAST({inside} AS STRING) END"
        )
        made.append(prefix + "is_dst")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}canonical(a STRING) RETURNS STRING RETURN {_body(spark, canonical_text(F.col('a')))}"
    )
    made.append(prefix + "canonical")
    return made


