"""Typed column values and the coercion rules every other function builds on.

A ``Val`` is a Spark ``Column`` plus what is known about it while the plan is
built: its kind, the source fields it reads and the lookups it needs.

Missing data is ``''``; a data error is ``NULL`` and travels through every
function until ``iferror`` or the output edge turns it into text.
"""

from __future__ import annotations

import contextlib
import re
from contextvars import ContextVar
from dataclasses import dataclass, field as _field
from decimal import ROUND_HALF_UP, Context, Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import active_session, session_conf

NUM = "decimal(38,12)"
_ADDEND = "decimal(37,12)"  # two of these add up to decimal(38,12) without losing a digit

TEXT, NUMBER, INTEGER, BOOLEAN = "text", "number", "integer", "boolean"

NON_FINITE = r"^[ \t\r\n]*[+-]?(?i:nan|inf|infinity)[ \t\r\n]*$"
GROUPED = r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"
EXPONENT = r"^(?!0[0-9])[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)[eE][+-]?[0-9]{1,4}$"
ZERO = r"^(0|[+-]0*)?\.0*$"
TRIMMABLE = r"^(?!0[0-9])[+-]?([0-9]{1,26}\.[0-9]*|\.[0-9]+)$"
BLANKS = " \t\r\n"

_spelled: ContextVar[bool] = ContextVar("spelled", default=False)


@dataclass(frozen=True, eq=False)
class Val:
    col: Column
    kind: str = TEXT
    fields: frozenset = _field(default_factory=frozenset)
    lookups: tuple = ()
    const: object = None  # the Python value of a literal
    numeric: Column | None = None  # a numeric reading of a text value that is '' or a number
    mixed: bool = False  # text made from branches of different kinds

    def __add__(self, o):
        return add(self, o)

    def __radd__(self, o):
        return add(o, self)

    def __sub__(self, o):
        return sub(self, o)

    def __rsub__(self, o):
        return sub(o, self)

    def __mul__(self, o):
        return mul(self, o)

    def __rmul__(self, o):
        return mul(o, self)

    def __truediv__(self, o):
        return div(self, o)

    def __rtruediv__(self, o):
        return div(o, self)

    def __neg__(self):
        return neg(self)

    def __eq__(self, o):
        return eq(self, o)

    def __ne__(self, o):
        return not_(eq(self, o))

    def __lt__(self, o):
        return compare(self, "<", o)

    def __le__(self, o):
        return compare(self, "<=", o)

    def __gt__(self, o):
        return compare(self, ">", o)

    def __ge__(self, o):
        return compare(self, ">=", o)

    def __and__(self, o):
        return and_(self, o)

    def __or__(self, o):
        return or_(self, o)

    def __invert__(self):
        return not_(self)

    def __bool__(self):
        raise TypeError("combine conditions with & | ~, not with and/or/not")


# ---------------------------------------------------------------- construction


def field(name: str) -> Val:
    """A source column by name; a name the source lacks reads as ''."""
    return Val(F.col(f"`{name}`"), TEXT, frozenset([name]))


def const(x) -> Val:
    if isinstance(x, bool):
        return Val(F.lit(x), BOOLEAN, const=x)
    if isinstance(x, int):
        return Val(F.lit(x), INTEGER, const=x)
    if isinstance(x, float):
        x = Decimal(repr(x))
    if isinstance(x, Decimal):
        return Val(F.lit(x).cast(NUM), NUMBER, const=x)
    if isinstance(x, str):
        return Val(F.lit(x), TEXT, const=x)
    raise TypeError(f"no value can be made from {type(x).__name__}")


def val(x) -> Val:
    """Accept a Val, a text Column or a Python literal."""
    if isinstance(x, Val):
        return x
    if isinstance(x, Column):
        return Val(x)
    return const(x)


def vals(xs) -> list[Val]:
    return [val(x) for x in xs]


def derive(col: Column, kind: str, *parents: Val, numeric=None, mixed=False) -> Val:
    fields = frozenset().union(*(p.fields for p in parents)) if parents else frozenset()
    lookups = tuple({lk.key: lk for p in parents for lk in p.lookups}.values())
    return Val(col, kind, fields, lookups, None, numeric, mixed)


def text_arg(x, what: str) -> Val:
    """An argument that has to be text; a number or boolean there is a template mistake."""
    v = val(x)
    if v.kind != TEXT:
        raise TypeError(f"{what}: a text argument is expected, got {v.kind}")
    return v


# ---------------------------------------------------------------- conversions


def parse_number(s: str) -> Decimal | None:
    """The number a literal text stands for, by the rules of ``num``."""
    if s == "" or re.match(NON_FINITE, s):
        return Decimal(0)
    if re.match(GROUPED, s):
        s = s.replace(",", "")
    if not re.match(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$", s):
        return None
    d = Decimal(s.strip())
    if d.adjusted() >= 26:
        return None
    d = d.quantize(Decimal("1e-12"), rounding=ROUND_HALF_UP, context=Context(prec=60))
    return d if abs(d) < Decimal(10) ** 26 else None


def text_to_num(c: Column) -> Column:
    """The number a text stands for. The text is bound once, however long its expression is."""
    if not _spelled.get():
        return _call("sw_num", c)
    return F.coalesce(
        c.try_cast(NUM),
        F.when((c == "") | c.rlike(NON_FINITE), F.lit(0).cast(NUM)).when(c.rlike(GROUPED), F.replace(c, F.lit(","), F.lit("")).try_cast(NUM)),
    )


@contextlib.contextmanager
def spelled_out():
    """Inside, values are single expressions without bound arguments, as the body of an SQL function needs them."""
    token = _spelled.set(True)
    try:
        yield
    finally:
        _spelled.reset(token)


def num(x) -> Column:
    """The decimal reading of a value; NULL where it is not a number."""
    v = val(x)
    if v.numeric is not None:
        return v.numeric
    if v.const is not None and v.kind == TEXT:
        return F.lit(parse_number(v.const)).cast(NUM)
    if v.kind == TEXT:
        return text_to_num(v.col)
    if v.kind == BOOLEAN:
        return F.when(v.col, F.lit(1)).when(~v.col, F.lit(0)).cast(NUM)
    if v.kind == INTEGER:
        return v.col.cast(NUM)
    return v.col


def num_to_text(d: Column) -> Column:
    """Plain digits, trailing zeros dropped. The cast always prints 12 fraction digits."""
    return F.rtrim(F.rtrim(d.cast(NUM).cast("string"), F.lit("0")), F.lit("."))


def text(x) -> Column:
    v = val(x)
    if v.kind == TEXT:
        return v.col
    if v.kind == NUMBER:
        return num_to_text(v.col)
    return v.col.cast("string")


def truthy(x) -> Column:
    v = val(x)
    if v.kind == BOOLEAN:
        return v.col
    if v.mixed:
        raise TypeError("a value with branches of different kinds cannot serve as a bare condition")
    if v.kind in (NUMBER, INTEGER):
        return v.col != 0
    if v.numeric is not None:
        # '' is false, a number is true unless it is zero
        return F.when(v.col == "", F.lit(False)).otherwise(v.numeric != 0)
    return v.col != ""


def canonical_text(s: Column) -> Column:
    """Drop redundant zeros of a text that reads as a plain decimal, expand exponents.

    Leading-zero codes and long integers stay as they are, so no identifier is
    damaged. ``s`` should be a plain column: it is read several times.
    """
    # '+' to '9' as first byte: one comparison keeps most texts away from the patterns
    numeric = (s >= "+") & (s < ":")
    trimmed = (
        F.when(s.rlike(ZERO), F.lit("0")).when(s.rlike(TRIMMABLE), F.regexp_replace(s, r"\.?0*$", "")).otherwise(s)
    )
    return (
        F.when(numeric & (s.endswith("0") | s.endswith(".")) & s.contains("."), trimmed)
        .when(
            numeric & (s.contains("e") | s.contains("E")) & s.rlike(EXPONENT),
            F.coalesce(num_to_text(s.try_cast(NUM)), s),
        )
        .otherwise(s)
    )


def canonical(x) -> Column:
    v = val(x)
    return canonical_text(v.col) if v.kind == TEXT and v.numeric is None else text(v)


# ---------------------------------------------------------------- arithmetic

# Spark cuts the scale of wide decimal products. These functions are created with or without
# full precision and keep that choice. A function's arguments become columns of a projection
# below it, so what a body reads twice is computed once and a nested formula stays linear in size.
# The steps for wide operands get NULLs from all other rows, which pass through them untouched.
_WIDE = "DECIMAL(38,12)"
_SQL_FUNCTIONS = {
    # name: (arguments, result, whether precision may be lost, body)
    # Spark's own abs and minus round wide negative numbers to 34 digits.
    "sw_exact_neg": ("a W", "W", False, "0 - a"),
    "sw_exact_abs": ("a W", "W", False, "CASE WHEN a < 0 THEN 0 - a ELSE a END"),
    "sw_num": (
        "c STRING", "W", True,
        f"coalesce(try_cast(c AS W), CASE WHEN c = '' OR c RLIKE r'{NON_FINITE}' THEN 0 WHEN c RLIKE r'{GROUPED}' THEN try_cast(replace(c, ',', '') AS W) END)",
    ),
    "sw_optional_text": (
        "missing BOOLEAN, x W", "STRING", True, "CASE WHEN missing THEN '' WHEN NOT missing THEN rtrim('.', rtrim('0', CAST(x AS STRING))) END",
    ),
    "sw_optional_num": ("missing BOOLEAN, x W", "W", True, "CASE WHEN missing THEN 0 WHEN NOT missing THEN x END"),
    # Products: at once where both sides have 14 whole digits at most, else by whole parts and rests.
    "sw_mul_sum": (
        "w DECIMAL(26,0), v DECIMAL(26,0), r DECIMAL(12,12), s DECIMAL(12,12)", "W", False,
        "try_cast(try_add(try_add(try_cast(try_multiply(w, v) AS W), try_cast(try_multiply(w, s) AS W)), try_add(try_cast(try_multiply(r, v) AS W), try_cast(try_multiply(r, s) AS W))) AS W)",
    ),
    "sw_mul_parts": ("a W, b W, w DECIMAL(26,0), v DECIMAL(26,0)", "W", False, "sw_mul_sum(w, v, try_cast(a - w AS DECIMAL(12,12)), try_cast(b - v AS DECIMAL(12,12)))"),
    "sw_mul_wide": (
        "a W, b W", "W", False,
        "sw_mul_parts(a, b, CASE WHEN a < 0 THEN try_cast(ceil(a) AS DECIMAL(26,0)) ELSE try_cast(floor(a) AS DECIMAL(26,0)) END, CASE WHEN b < 0 THEN try_cast(ceil(b) AS DECIMAL(26,0)) ELSE try_cast(floor(b) AS DECIMAL(26,0)) END)",
    ),
    "sw_mul_or": ("a W, b W, p W", "W", False, "coalesce(p, sw_mul_wide(CASE WHEN p IS NULL THEN a END, CASE WHEN p IS NULL THEN b END))"),
    "sw_mul": ("a W, b W", "W", False, "sw_mul_or(a, b, try_cast(try_multiply(try_cast(a AS DECIMAL(26,12)), try_cast(b AS DECIMAL(26,12))) AS W))"),
    # Quotients: a dividend of 14 whole digits leaves exactly 12 digits for the fraction under Spark's own rule, so the
    # quotient is rounded once. Wider ones take long division: whole units (q), then twice six digits (d, e) of what is
    # left (r). Each step may be one unit short (-1 for 0), which the next one makes good. Divisors of 20 and more whole digits
    # leave no room for exact rests: there the twelve digits come from the first 25 digits of both sides.
    "sw_div_end": (
        "y W, minus BOOLEAN, q DECIMAL(26,0), d DECIMAL(26,0), t W, e DECIMAL(26,0), near DECIMAL(14,0)", "W", False,
        """try_cast((CASE WHEN minus THEN -1 ELSE 1 END) * try_cast(q + 0.000000000001BD * CAST(coalesce(near, d * 1000000 + e
          + CASE WHEN 2 * (t - e * y) >= 3 * y THEN 2 WHEN 2 * (t - e * y) >= y THEN 1 ELSE 0 END) AS DECIMAL(14,0)) AS W) AS W)""",
    ),
    "sw_div_second": (
        "y W, minus BOOLEAN, q DECIMAL(26,0), r W, d DECIMAL(26,0), t W", "W", True,
        """sw_div_end(y, minus, q, d, t, try_cast(floor(try_divide(t, y) - 0.000001) AS DECIMAL(26,0)),
          CASE WHEN y >= 10000000000000000000BD THEN try_cast(1000000000000 * try_divide(
            try_cast(floor(r * CAST(pow(10, greatest(0, 24 - floor(log10(CAST(y AS DOUBLE))))) AS DECIMAL(6,0))) AS DECIMAL(26,0)),
            try_cast(floor(y * CAST(pow(10, greatest(0, 24 - floor(log10(CAST(y AS DOUBLE))))) AS DECIMAL(6,0))) AS DECIMAL(26,0))) AS DECIMAL(14,0)) END)""",
    ),
    "sw_div_left": ("y W, minus BOOLEAN, q DECIMAL(26,0), r W, t W, d DECIMAL(26,0)", "W", False, "sw_div_second(y, minus, q, r, d, try_cast(try_multiply(t - d * y, 1000000BD) AS W))"),
    "sw_div_first": (
        "y W, minus BOOLEAN, q DECIMAL(26,0), r W, t W", "W", True,
        "sw_div_left(y, minus, q, r, t, try_cast(floor(try_divide(t, y) - 0.000001) AS DECIMAL(26,0)))",
    ),
    "sw_div_six": ("y W, minus BOOLEAN, q DECIMAL(26,0), r W", "W", False, "sw_div_first(y, minus, q, r, CASE WHEN y < 10000000000000000000BD THEN try_cast(try_multiply(r, 1000000BD) AS W) END)"),
    "sw_div_rest": ("x W, y W, minus BOOLEAN, q DECIMAL(26,0)", "W", False, "sw_div_six(y, minus, q, try_cast(try_subtract(x, try_multiply(q, y)) AS W))"),
    "sw_div_whole": (
        "x W, y W, minus BOOLEAN", "W", True,
        "sw_div_rest(x, y, minus, try_cast(floor(try_divide(x, y) - 0.000001) AS DECIMAL(26,0)))",
    ),
    "sw_div_wide": ("a W, b W", "W", False, "sw_div_whole(CASE WHEN a < 0 THEN 0 - a ELSE a END, CASE WHEN b < 0 THEN 0 - b ELSE b END, (a < 0) <> (b < 0))"),
    "sw_div_or": ("a W, b W, q W", "W", False, "coalesce(q, sw_div_wide(CASE WHEN q IS NULL AND b <> 0 THEN a END, CASE WHEN q IS NULL AND b <> 0 THEN b END))"),
    "sw_div": ("a W, b W", "W", True, "sw_div_or(a, b, try_divide(try_cast(a AS DECIMAL(26,12)), b))"),
}


def register_functions(spark) -> None:
    """Prepare a session once: exact multiply and divide, and a limit on generated methods.

    The JVM does not compile methods beyond 8000 bytes of bytecode, and wide
    conversions reach that. With the limit Spark splits them into small methods.
    """
    if getattr(spark, "_sluicework_ready", False):
        return
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    for name, (arguments, result, loss, body) in _SQL_FUNCTIONS.items():
        made = f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}"
        with session_conf(spark, {"spark.sql.decimalOperations.allowPrecisionLoss": str(loss).lower()}):
            spark.sql(re.sub(r"\bW\b", _WIDE, made))
    spark._sluicework_ready = True


def _call(name: str, *xs: Column) -> Column:
    register_functions(active_session())
    return F.call_function(name, *xs)


def _tight(x: Val) -> tuple[Decimal, int, int] | None:
    """Value, precision and scale of a numeric literal of at most 12 digits."""
    if x.const is None or isinstance(x.const, bool):
        return None
    d = x.const if isinstance(x.const, Decimal) else parse_number(str(x.const))
    if d is None:
        return None
    d = d.normalize()
    if d.as_tuple().exponent > 0:
        d = d.quantize(Decimal(1))
    scale = -d.as_tuple().exponent
    precision = max(len(d.as_tuple().digits), scale, 1)
    return (d, precision, scale) if precision <= 12 else None


def add(a, b) -> Val:
    a, b = val(a), val(b)
    return derive(num(a).try_cast(_ADDEND) + num(b).try_cast(_ADDEND), NUMBER, a, b)


def sub(a, b) -> Val:
    a, b = val(a), val(b)
    return derive(num(a).try_cast(_ADDEND) - num(b).try_cast(_ADDEND), NUMBER, a, b)


def mul(a, b) -> Val:
    """Exact product, rounded half away from zero at 12 digits; overflow is a data error."""
    a, b = val(a), val(b)
    t = _tight(b)
    if t is None and _tight(a) is not None:
        return mul(b, a)
    if t is not None:
        d, p, s = t
        if d == 1:
            return derive(num(a), NUMBER, a)
        product = num(a).try_cast(f"decimal({37 - p},12)") * F.lit(d).cast(f"decimal({p},{s})")
        return derive(_call("sw_mul_or", num(a), num(b), product.try_cast(NUM)), NUMBER, a)
    return derive(_call("sw_mul", num(a), num(b)), NUMBER, a, b)


def div(a, b) -> Val:
    """Quotient at 12 digits, half away from zero; a zero divisor answers ''."""
    a, b = val(a), val(b)
    t = _tight(b)
    if t is not None and t[0] != 0:
        d, p, s = t
        q = num(a).try_cast(f"decimal({38 - s},12)") / F.lit(d).cast(f"decimal({p},{s})")
        if s == 0:  # every dividend fits
            return derive(q.try_cast(NUM), NUMBER, a)
        return derive(_call("sw_div_or", num(a), num(b), q.try_cast(NUM)), NUMBER, a)
    nb = num(b)
    q = _call("sw_div", num(a), nb)
    return optional_number(F.when(num(a).isNotNull(), nb == 0), q, a, b)


def optional_number(missing: Column, value: Column, *parents: Val) -> Val:
    """A value that is '' where ``missing`` holds and a number elsewhere."""
    value = value.cast(NUM)
    if _spelled.get():
        numeric = F.when(missing, F.lit(0).cast(NUM)).when(~missing, value)
        return derive(F.when(missing, F.lit("")).when(~missing, num_to_text(value)), TEXT, *parents, numeric=numeric)
    return derive(_call("sw_optional_text", missing, value), TEXT, *parents, numeric=_call("sw_optional_num", missing, value))


def neg(a) -> Val:
    a = val(a)
    return derive(_call("sw_exact_neg", num(a)), NUMBER, a)


# ---------------------------------------------------------------- comparison and logic


def eq(a, b) -> Val:
    """Numeric when both sides read as numbers, else byte equality."""
    a, b = val(a), val(b)
    if a.const is not None and b.const is None:
        a, b = b, a
    kinds = {a.kind, b.kind}
    if kinds == {BOOLEAN}:
        return derive(a.col == b.col, BOOLEAN, a, b)
    if TEXT not in kinds:
        return derive(num(a) == num(b), BOOLEAN, a, b)
    if a.kind == b.kind == TEXT:
        if b.const is not None and b.const != "" and parse_number(b.const) is None:
            return derive(a.col == b.col, BOOLEAN, a)
        same = a.col == b.col
        out = F.when(same, F.lit(True)).when(~same, F.coalesce(num(a) == num(b), F.lit(False)))
        return derive(out, BOOLEAN, a, b)
    t, o = (a, b) if a.kind == TEXT else (b, a)
    if o.kind == BOOLEAN:
        out = F.when(t.col.isNotNull() & o.col.isNotNull(), F.coalesce(num(t) == num(o), t.col == text(o)))
    else:
        out = F.when(t.col.isNotNull() & o.col.isNotNull(), F.coalesce(num(t) == num(o), F.lit(False)))
    return derive(out, BOOLEAN, a, b)


def compare(a, op: str, b) -> Val:
    """Numbers only; anything else is a data error."""
    a, b = val(a), val(b)
    x, y = num(a), num(b)
    out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return derive(out, BOOLEAN, a, b)


def and_(*xs) -> Val:
    """Both sides are evaluated: an error on either side is an error."""
    return _logic(xs, lambda p, q: p & q)


def or_(*xs) -> Val:
    return _logic(xs, lambda p, q: p | q)


def _logic(xs, join) -> Val:
    xs = vals(xs)
    cols = [truthy(x) for x in xs]
    known = reduce(lambda p, q: p & q, [c.isNotNull() for c in cols])
    return derive(F.when(known, reduce(join, cols)), BOOLEAN, *xs)


def not_(x) -> Val:
    x = val(x)
    return derive(~truthy(x), BOOLEAN, x)


def concat(*xs) -> Val:
    xs = vals(xs)
    return derive(F.concat(*[text(x) for x in xs]), TEXT, *xs)
