"""Conditionals and emptiness tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from .values import BLANKS, BOOLEAN, INTEGER, NON_FINITE, GROUPED, NUMBER, NUM, TEXT
from .values import derive, eq, num, text, truthy, val, vals


def _unify(branches):
    """One kind for all branches, text where they differ."""
    kinds = {b.kind for b in branches}
    if kinds == {INTEGER}:
        return INTEGER, [b.col for b in branches], False
    if kinds <= {NUMBER, INTEGER}:
        return NUMBER, [num(b) for b in branches], False
    if len(kinds) == 1:
        return kinds.pop(), [b.col for b in branches], any(b.mixed for b in branches)
    return TEXT, [text(b) for b in branches], True


def if_(cond, yes, no):
    cond, yes, no = vals([cond, yes, no])
    kind, (y, n), mixed = _unify([yes, no])
    c = truthy(cond)
    return derive(F.when(c, y).when(~c, n), kind, cond, yes, no, mixed=mixed)


def case(x, *args):
    """First match by ``eq``; an odd last argument is the default, else ''."""
    if len(args) < 2:
        raise TypeError("case needs at least one match/result pair")
    x = val(x)
    args = vals(args)
    default = args[-1] if len(args) % 2 else val("")
    pairs = list(zip(args[0::2], args[1::2]))
    kind, cols, mixed = _unify([r for _, r in pairs] + [default])
    out = F.when(text(x).isNull(), F.lit(None))
    for (m, _), r in zip(pairs, cols):
        out = out.when(eq(x, m).col, r)
    return derive(out.otherwise(cols[-1]), kind, x, *args, mixed=mixed)


def iferror(x, fallback):
    x, fallback = vals([x, fallback])
    kind, (a, b), mixed = _unify([x, fallback])
    return derive(F.coalesce(a, b), kind, x, fallback, mixed=mixed)


def isempty(x):
    x = val(x)
    if x.kind != TEXT:
        return derive(F.when(x.col.isNotNull(), F.lit(False)), BOOLEAN, x)
    return derive(F.trim(x.col, F.lit(BLANKS)) == "", BOOLEAN, x)


def coalesce(*xs):
    """First argument that is not blank; the last one comes back as it is."""
    xs = vals(xs)
    kind, cols, mixed = _unify(xs)
    out = cols[-1]
    for x, c in reversed(list(zip(xs[:-1], cols[:-1]))):
        if x.kind == TEXT:
            empty = F.trim(x.col, F.lit(BLANKS)) == ""
            out = F.when(~empty, c).when(empty, out)
        else:
            out = c
    if len(xs) > 1:
        known = xs[0].col.isNotNull()
        for x in xs[1:]:
            known = known & x.col.isNotNull()
        out = F.when(known, out)
    return derive(out, kind, *xs, mixed=mixed)


def nullif(v, sentinel):
    v, sentinel = vals([v, sentinel])
    same = eq(v, sentinel).col
    mixed = v.kind != TEXT
    return derive(F.when(same, F.lit("")).when(~same, text(v)), TEXT, v, sentinel, mixed=mixed)


def in_(v, *options):
    """Numeric-first equality against each option."""
    if not options:
        raise TypeError("in_ needs at least one option")
    v = val(v)
    options = vals(options)
    plain = [o for o in options if o.kind == TEXT and o.const not in (None, "") and _not_number(o.const)]
    rest = [o for o in options if not any(o is p for p in plain)]
    tests = []
    if plain and v.kind == TEXT:
        tests.append(v.col.isin([o.const for o in plain]))
    elif plain:
        rest = options
    tests += [eq(v, o).col for o in rest]
    known = text(v).isNotNull()
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    for o in rest:
        if o.const is None:
            known = known & text(o).isNotNull()
    return derive(F.when(known, out), BOOLEAN, v, *options)


def _not_number(s: str) -> bool:
    from .values import parse_number

    return parse_number(s) is None


def is_numeric(x):
    """Stricter than arithmetic: '' and non-finite words are not numbers."""
    x = val(x)
    if x.kind in (NUMBER, INTEGER):
        return derive(F.when(x.col.isNotNull(), F.lit(True)), BOOLEAN, x)
    if x.kind == BOOLEAN:
        return derive(F.when(x.col.isNotNull(), F.lit(False)), BOOLEAN, x)
    c = x.col
    ok = c.try_cast(NUM).isNotNull() | (c.rlike(GROUPED) & ~c.rlike(NON_FINITE))
    return derive(F.when(c.isNotNull(), ok), BOOLEAN, x)
