"""Code mapping: whole values, substrings, keyed lookups, source context."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import functions as F

from .values import INTEGER, TEXT
from .values import Val, canonical, derive, text, text_arg, val


def _pairs(name: str, args) -> dict[str, str]:
    if len(args) == 1 and isinstance(args[0], dict):
        return dict(args[0])
    if not args or len(args) % 2:
        raise TypeError(f"{name} takes a map or pairs")
    out = {}
    for k, v in zip(args[0::2], args[1::2]):
        out.setdefault(str(k), v)
    return out


def remap(s, *pairs):
    """Whole-value replacement; a value the map lacks passes through.

    Values may be literals or other values. A map too large for a literal
    belongs in a table: see ``operators.mapjoin``.
    """
    s = text_arg(s, "remap")
    table = _pairs("remap", pairs)
    if all(isinstance(v, str) for v in table.values()) and len(table) > 8:
        m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        return derive(F.coalesce(F.try_element_at(m, s.col), s.col), TEXT, s)
    out, parents = None, [s]
    for k, v in table.items():
        r = val(v)
        parents.append(r)
        test = s.col == k
        out = F.when(test, text(r)) if out is None else out.when(test, text(r))
    return derive(out.otherwise(s.col), TEXT, *parents)


def replace(s, *pairs):
    """Substring replacement.

    One pair replaces every occurrence. Several pairs work in one pass from the
    left: at each place the first declared match wins and its output is not
    searched again. An empty search text matches nothing.
    """
    s = text_arg(s, "replace")
    if len(pairs) == 2 and not isinstance(pairs[0], dict):
        a, b = text_arg(pairs[0], "replace"), text_arg(pairs[1], "replace")
        if a.const is not None:
            return s if a.const == "" else derive(F.replace(s.col, a.col, b.col), TEXT, s, b)
        return derive(F.when(a.col == "", s.col).otherwise(F.replace(s.col, a.col, b.col)), TEXT, s, a, b)
    table = {k: v for k, v in _pairs("replace", pairs).items() if k != ""}
    if not table:
        return s
    if not all(isinstance(v, str) for v in table.values()):
        raise TypeError("replace with several pairs takes literal text")
    values = set(table.values())
    alternation = "|".join(_quote(k) for k in table)
    if values == {""}:
        return derive(F.regexp_replace(s.col, alternation, ""), TEXT, s)
    if all(len(k) == 1 for k in table) and all(len(v) == 1 for v in values):
        return derive(F.translate(s.col, "".join(table), "".join(table.values())), TEXT, s)
    pieces = F.regexp_extract_all(s.col, F.lit(f"((?s){alternation}|.)"), F.lit(1))
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    swapped = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(m, p), p)), "")
    return derive(F.when(s.col.rlike(alternation), swapped).otherwise(s.col), TEXT, s)


def _quote(k: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}\-&#~ ])", r"\\\1", k)


@dataclass(frozen=True, eq=False)
class Probe:
    """One left join a template needs: a named block probed by a key."""

    key: tuple
    block: str | None
    probe: Val
    prefix: str


def lookup(*args):
    """``lookup(key, field)`` or ``lookup(block, key, field)``; a miss answers ''."""
    if len(args) == 2:
        block, (key, name) = None, args
    elif len(args) == 3:
        block, key, name = args
    else:
        raise TypeError("lookup takes (key, field) or (block, key, field)")
    key = val(key)
    spelled = canonical(key)
    ident = hashlib.md5(f"{block}|{spelled}".encode()).hexdigest()[:10]
    probe = Probe((block, ident), block, key, f"_lk_{ident}")
    out = derive(F.coalesce(F.col(f"`{probe.prefix}_{name}`"), F.lit("")), TEXT, key)
    return Val(out.col, TEXT, out.fields, out.lookups + (probe,))


def fields(n):
    """A source field by its 1-based position; '' outside the row."""
    from .text import _int

    k, v, fixed = _int(n)
    if fixed is not None and fixed < 1:
        return derive(F.lit(""), TEXT)
    at = F.coalesce(F.get(F.col("_fields"), k - 1), F.lit(""))
    return derive(at if fixed is not None else F.when(k < 1, F.lit("")).otherwise(at), TEXT, v)


def filename():
    """The input's name without folder and matched suffix."""
    return derive(F.col("_stem"), TEXT)


def record_num():
    """1-based row number within the file."""
    return derive(F.col("_record_num"), INTEGER)


def sheet_name():
    """The configured sheet, '' for other inputs."""
    return derive(F.col("_sheet"), TEXT)
