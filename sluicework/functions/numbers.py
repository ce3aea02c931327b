"""Exact decimal functions. Rounding is half away from zero at every step."""

from __future__ import annotations

import decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from .values import INTEGER, NUM, NUMBER, TEXT, _call
from .values import add, derive, div, mul, num, optional_number, sub, text_arg, val, vals

MAX_EXPONENT = 1024
MAX_RANDOM_DIGITS = 65

# Currency signs and the codes they stand for.
CURRENCY_SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₽": "RUB"}


def abs_(x):
    x = val(x)
    return derive(_call("sw_exact_abs", num(x)), NUMBER, x)


def _digits(n, what: str) -> int | None:
    """A literal digit count, clamped; None when it comes from a column."""
    n = val(n)
    if n.const is None:
        return None
    from .values import parse_number

    d = parse_number(str(n.const))
    if d is None:
        raise TypeError(f"{what}: the digit count is not a number")
    return max(-30, min(30, int(d)))


def _at_digits(x, n, apply):
    """Apply a rounding at a literal or per-row digit count."""
    x = val(x)
    d = num(x)
    fixed = _digits(n, "rounding")
    if fixed is not None:
        return derive(apply(d, fixed).try_cast(NUM) if fixed < 12 else d, NUMBER, x)
    nv = val(n)
    k = F.greatest(F.lit(-30), F.least(F.lit(30), num(nv).cast("decimal(26,0)"))).cast("int")
    out = F.when(k >= 12, d)
    for i in range(-26, 12):
        out = out.when(k == i, apply(d, i).try_cast(NUM))
    out = out.when(k < -26, F.lit(0).cast(NUM))
    return derive(F.when(d.isNotNull(), out), NUMBER, x, nv)


def round_(x, n=0):
    return _at_digits(x, n, lambda d, k: F.when(d.isNotNull(), F.lit(0)) if k < -26 else F.round(d, k))


def trunc(x, n=0):
    def cut(d, k):
        if k < -25:
            return F.when(d.isNotNull(), F.lit(0))
        return F.when(d < 0, F.ceil(d, F.lit(k)).try_cast(NUM)).otherwise(F.floor(d, F.lit(k)).try_cast(NUM))

    return _at_digits(x, n, cut)


def floor(x):
    x = val(x)
    return derive(F.floor(num(x)).try_cast(NUM), NUMBER, x)


def ceiling(x):
    x = val(x)
    return derive(F.ceil(num(x)).try_cast(NUM), NUMBER, x)


def sign(x):
    x = val(x)
    d = num(x)
    return derive(F.when(d > 0, F.lit(1)).when(d < 0, F.lit(-1)).when(d == 0, F.lit(0)), INTEGER, x)


def mround(x, m):
    """Nearest multiple of |m|, ties away from zero; '' when m is 0."""
    x, m = vals([x, m])
    d, step = num(x), F.abs(num(m))
    rest = F.abs(d) % F.when(step != 0, step)
    size = F.abs(d).try_cast("decimal(37,12)") - rest.try_cast("decimal(37,12)")
    up = (rest >= step.try_cast("decimal(37,12)") - rest.try_cast("decimal(37,12)"))
    size = size.try_cast("decimal(37,12)") + F.when(up, step).otherwise(F.lit(0)).try_cast("decimal(37,12)")
    out = F.when(d < 0, -size).otherwise(size)
    return optional_number(F.when(d.isNotNull(), step == 0), out, x, m)


def mod(a, b):
    """Remainder with the sign of the dividend; '' when the divisor is 0."""
    a, b = vals([a, b])
    x, y = num(a), num(b)
    return optional_number(F.when(x.isNotNull(), y == 0), x % F.when(y != 0, y), a, b)


def _exact(x: decimal.Decimal):
    """Round to the 12-digit scale; None outside the range."""
    with decimal.localcontext() as ctx:
        ctx.prec = 80
        r = x.quantize(decimal.Decimal("1e-12"), rounding=decimal.ROUND_HALF_UP)
    return r if abs(r) < decimal.Decimal(10) ** 26 else None


@F.pandas_udf(DecimalType(38, 12))
def _power_udf(base: pd.Series, exponent: pd.Series) -> pd.Series:
    def one(b, n):
        if b is None or n is None or (b and b.adjusted() * n > 27):
            return None
        with decimal.localcontext() as ctx:
            ctx.prec = 80
            return _exact(b ** int(n))

    return pd.Series([one(b, n) for b, n in zip(base, exponent)], dtype=object)


@F.pandas_udf(DecimalType(38, 12))
def _sqrt_udf(x: pd.Series) -> pd.Series:
    def one(v):
        if v is None or v < 0:
            return None
        with decimal.localcontext() as ctx:
            ctx.prec = 40
            return _exact(v.sqrt())

    return pd.Series([one(v) for v in x], dtype=object)


def power(b, n):
    """Exact whole powers 0…1024, '' for any other exponent, overflow is a data error."""
    b, n = vals([b, n])
    x, e = num(b), num(n)
    bad = F.when(x.isNotNull(), (e != F.floor(e)) | (e < 0) | (e > MAX_EXPONENT))
    if str(n.const) == "2":  # squares stay inside the JVM
        return mul(derive(x, NUMBER, b), derive(x, NUMBER, b))
    return optional_number(bad, _power_udf(x, F.when(~bad, e)), b, n)


def sqrt(x):
    """Root at 12 digits; '' for a negative argument."""
    x = val(x)
    d = num(x)
    return optional_number(d < 0, _sqrt_udf(d), x)


def greatest(*xs):
    return _extreme(F.greatest, xs)


def least(*xs):
    return _extreme(F.least, xs)


def _extreme(pick, xs):
    xs = vals(xs)
    ds = [num(x) for x in xs]
    if len(ds) == 1:
        return derive(ds[0], NUMBER, *xs)
    known = ds[0].isNotNull()
    for d in ds[1:]:
        known = known & d.isNotNull()
    return derive(F.when(known, pick(*ds)), NUMBER, *xs)


def price_value(s):
    """The amount of a price text: one leading currency sign and the tail after a space go."""
    s = text_arg(s, "price_value")
    bare = F.regexp_replace(F.trim(s.col), "^[$€£¥₽]", "")
    return derive(F.substring_index(bare, " ", 1), TEXT, s)


def price_currency(s):
    s = text_arg(s, "price_currency")
    t = F.trim(s.col)
    out = F.when(s.col.isNull(), F.lit(None))
    for sign_, code in CURRENCY_SIGNS.items():
        out = out.when(t.startswith(sign_), F.lit(code))
    cut = F.locate(" ", t)
    out = out.when(cut > 0, F.substring(t, cut + 1, F.length(t))).otherwise(F.lit(""))
    return derive(out, TEXT, s)


def rand(n):
    """Random digits, the first never 0. New digits on every evaluation."""
    n = val(n)
    if not isinstance(n.const, (int, str)):
        raise TypeError("rand needs a literal digit count")
    size = max(1, min(MAX_RANDOM_DIGITS, int(n.const)))
    digits = [F.floor(F.rand() * 9 + 1).cast("int")] + [F.floor(F.rand() * 10).cast("int") for _ in range(size - 1)]
    return derive(F.concat(*[d.cast("string") for d in digits]), TEXT)


__all__ = [
    "abs_", "add", "ceiling", "div", "floor", "greatest", "least", "mod", "mround", "mul", "power",
    "price_currency", "price_value", "rand", "round_", "sign", "sqrt", "sub", "trunc",
]
