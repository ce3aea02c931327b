"""The 71 column functions, the operators and the source-context values."""

from .dates import (
    date_convert, date_trunc, dateadd, datediff, day, eomonth, hour, is_date, is_dst, minute, month, now, nth_dow,
    quarter, second, to_utc, tz_convert, tz_offset, weekday, weeknum, workday, year,
)
from .logic import case, coalesce, if_, iferror, in_, is_numeric, isempty, nullif
from .mapping import fields, filename, lookup, record_num, remap, replace, sheet_name
from .numbers import (
    abs_, ceiling, floor, greatest, least, mod, mround, power, price_currency, price_value, rand, round_, sign, sqrt,
    trunc,
)
from .text import (
    contains, ends_with, left, len_, lower, lpad, position, proper, regex_extract, regex_match, regex_replace, right,
    rpad, split_part, starts_with, substr, trim, unaccent, upper,
)
from .values import (
    Val, add, and_, canonical, compare, concat, const, div, eq, field, mul, neg, not_, num, or_, sub, text, truthy, val,
)

__all__ = [
    "abs_", "add", "and_", "canonical", "case", "ceiling", "coalesce", "compare", "concat", "const", "contains",
    "date_convert", "date_trunc", "dateadd", "datediff", "day", "div", "ends_with", "eomonth", "eq", "field",
    "fields", "filename", "floor", "greatest", "hour", "if_", "iferror", "in_", "is_date", "is_dst", "is_numeric",
    "isempty", "least", "left", "len_", "lookup", "lower", "lpad", "minute", "mod", "month", "mround", "mul", "neg",
    "not_", "now", "nth_dow", "nullif", "num", "or_", "position", "power", "price_currency", "price_value", "proper",
    "quarter", "rand", "record_num", "regex_extract", "regex_match", "regex_replace", "remap", "replace", "right",
    "round_", "rpad", "second", "sheet_name", "sign", "split_part", "sqrt", "starts_with", "sub", "substr", "text",
    "to_utc", "trim", "trunc", "truthy", "tz_convert", "tz_offset", "unaccent", "upper", "val", "Val", "weekday",
    "weeknum", "workday", "year",
]
