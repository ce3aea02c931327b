"""Dates, times and zones.

Readers take a whole ISO date or datetime (an ISO tail is read and ignored),
answer '' for '' and treat anything else as a data error. The zone functions,
``is_date`` and ``date_convert`` never fail: they answer '' or false.
"""

from __future__ import annotations

import re
import zoneinfo
from functools import lru_cache

from pyspark.sql import functions as F

from .dateformat import parsed, render
from .text import _int
from .values import BOOLEAN, TEXT
from .values import derive, optional_number, text_arg, val
from .zones import daylight

ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})?)?$"
MAX_DAYS = 3_652_500


def _moment(c):
    """Wall-clock timestamp of an ISO text; NULL when it is none."""
    return F.when(c.rlike(ISO), F.substring(c, 1, 19).try_cast("timestamp_ntz"))


def _day(c):
    return _moment(c).cast("date")


def _part(x, what, pick):
    x = text_arg(x, what)
    return optional_number(x.col == "", pick(x.col), x)


def year(d):
    return _part(d, "year", lambda c: F.year(_day(c)))


def month(d):
    return _part(d, "month", lambda c: F.month(_day(c)))


def day(d):
    return _part(d, "day", lambda c: F.dayofmonth(_day(c)))


def weekday(d):
    return _part(d, "weekday", lambda c: F.weekday(_day(c)) + 1)


def quarter(d):
    return _part(d, "quarter", lambda c: F.quarter(_day(c)))


def weeknum(d):
    return _part(d, "weeknum", lambda c: F.weekofyear(_day(c)))


def hour(t):
    return _part(t, "hour", lambda c: F.hour(_moment(c)))


def minute(t):
    return _part(t, "minute", lambda c: F.minute(_moment(c)))


def second(t):
    return _part(t, "second", lambda c: F.second(_moment(c)))


def _date_text(x, out, *more):
    return derive(F.when(x.col == "", F.lit("")).when(x.col != "", out.cast("string")), TEXT, x, *more)


def dateadd(d, n):
    """Calendar days forward or back; '' beyond ten thousand years."""
    d = text_arg(d, "dateadd")
    k, v, fixed = _int(n)
    if fixed is not None and abs(fixed) > MAX_DAYS:
        return derive(F.when(d.col.isNotNull(), F.lit("")), TEXT, d)
    moved = F.date_add(_day(d.col), k)
    if fixed is None:
        far = F.abs(k) > MAX_DAYS
        moved = F.when(~far, F.date_add(_day(d.col), F.when(~far, k)).cast("string")).when(
            _day(d.col).isNotNull(), F.lit("")
        )
    return _date_text(d, moved, v)


def datediff(a, b):
    """Days from the second date to the first."""
    a, b = text_arg(a, "datediff"), text_arg(b, "datediff")
    return optional_number((a.col == "") | (b.col == ""), F.date_diff(_day(a.col), _day(b.col)), a, b)


def workday(d, n):
    """Business days forward or back over weekends; 0 leaves the day as it is."""
    d = text_arg(d, "workday")
    k, v, fixed = _int(n)
    start = _day(d.col)
    w = F.weekday(start)  # Monday = 0
    # From a weekend the count starts at the nearest working day behind the move.
    fwd = F.when(w >= 5, F.lit(4)).otherwise(w)
    fwd_base = F.when(w >= 5, w - 4).otherwise(F.lit(0))
    ahead = k + F.floor((fwd + k) / 5).cast("int") * 2 - fwd_base
    back_w = F.when(w >= 5, F.lit(0)).otherwise(w)
    back_base = F.when(w >= 5, 7 - w).otherwise(F.lit(0))
    m = -k
    behind = back_base - (m + F.floor((4 - back_w + m) / 5).cast("int") * 2)
    move = F.when(k > 0, ahead).when(k < 0, behind).otherwise(F.lit(0)).cast("int")
    far = F.abs(k) > MAX_DAYS
    out = F.when(~far, F.date_add(start, F.when(~far, move)).cast("string")).when(start.isNotNull(), F.lit(""))
    return _date_text(d, out, v)


def date_trunc(unit, d):
    u = str(val(unit).const).lower()
    if u not in ("year", "quarter", "month", "week", "day"):
        raise ValueError(f"unknown date unit {unit!r}")
    d = text_arg(d, "date_trunc")
    out = _day(d.col) if u == "day" else F.trunc(_day(d.col), u)
    return _date_text(d, out)


def eomonth(d):
    d = text_arg(d, "eomonth")
    return _date_text(d, F.last_day(_day(d.col)))


def nth_dow(y, m, wd, n):
    """The n-th weekday of a month, from the end when n is negative; '' when there is none."""
    (y, vy, _), (m, vm, _), (wd, vw, _), (n, vn, _) = _int(y), _int(m), _int(wd), _int(n)
    good = (m.between(1, 12)) & (wd.between(1, 7)) & (n != 0) & F.abs(n).between(1, 5) & y.between(1, 9999)
    first = F.when(good, F.format_string("%04d-%02d-01", y, m)).try_cast("date")
    last = F.last_day(first)
    ahead = F.date_add(first, F.pmod(wd - 1 - F.weekday(first), F.lit(7)) + (n - 1) * 7)
    behind = F.date_add(last, -F.pmod(F.weekday(last) - (wd - 1), F.lit(7)) + (n + 1) * 7)
    hit = F.when(n > 0, ahead).otherwise(behind)
    known = y.isNotNull() & m.isNotNull() & wd.isNotNull() & n.isNotNull()
    out = F.when(F.month(hit) == m, hit.cast("string"))
    return derive(F.when(known, F.coalesce(out, F.lit(""))), TEXT, vy, vm, vw, vn)


def now():
    """Current UTC instant; one value per query."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())
    return derive(F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), TEXT)


# ---------------------------------------------------------------- declared formats


def _format(f) -> str:
    v = val(f)
    if not isinstance(v.const, str):
        raise TypeError("a date format has to be literal text")
    return v.const


def date_convert(s, from_format, to_format):
    """Rewrite a date text from one token format to another; '' when it does not parse."""
    s = text_arg(s, "date_convert")
    out = parsed(s.col, _format(from_format), lambda p: F.when(p.valid(), render(p, _format(to_format))).otherwise(F.lit("")))
    return derive(F.when(s.col.isNotNull(), out), TEXT, s)


def is_date(s, fmt=None):
    s = val(s)
    if s.kind != TEXT:
        return derive(F.when(s.col.isNotNull(), F.lit(False)), BOOLEAN, s)
    ok = _moment(s.col).isNotNull() if fmt is None else parsed(s.col, _format(fmt), lambda p: p.valid()) & (s.col != "")
    return derive(F.when(s.col.isNotNull(), F.coalesce(ok, F.lit(False))), BOOLEAN, s)


def _clock_text(ts):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def to_utc(s, fmt):
    """UTC form of a timestamp that carries its offset; '' when it does not parse."""
    s = text_arg(s, "to_utc")

    def moment(p):
        local = F.concat(p.date_text(), F.lit(" "), p.hour(), F.lit(":"), p.minute(), F.lit(":"), p.second())
        return F.when(p.valid(), local.try_cast("timestamp_ntz")) - F.make_dt_interval(mins=p.offset_minutes())

    ts = parsed(s.col, _format(fmt), moment)
    return derive(F.when(s.col.isNotNull(), F.coalesce(_clock_text(ts), F.lit(""))), TEXT, s)


# ---------------------------------------------------------------- zones

FIXED_OFFSET = r"^(Z|UTC|[+-][0-9]{2}:?[0-9]{2})$"


@lru_cache(maxsize=1)
def zone_names() -> frozenset[str]:
    """IANA zone ids known on the driver."""
    return frozenset(z for z in zoneinfo.available_timezones() if "/" in z or z.isupper() or z.isalpha()) - {"localtime"}


def _zone(z, fixed_too: bool):
    """A zone column Spark will accept; NULL for an unknown zone."""
    v = text_arg(z, "zone")
    if v.const is not None:
        ok = v.const in zone_names() or (fixed_too and re.match(FIXED_OFFSET, v.const))
        name = v.const
        if ok and re.match(r"^[+-]\d{4}$", name):
            name = name[:3] + ":" + name[3:]
        return F.lit(name if ok else None).cast("string"), v
    known = F.when(v.col.isin(sorted(zone_names())), v.col)
    if fixed_too:
        known = known.when(v.col.rlike(FIXED_OFFSET), F.regexp_replace(v.col, r"^([+-]\d{2})(\d{2})$", "$1:$2"))
    return known, v


def _local(ts, zone):
    """Wall clock in ``zone`` of a UTC wall clock."""
    return F.convert_timezone(F.lit("UTC"), zone, ts)


def _offset(ts, zone):
    """Offset as an interval, reading the local time as if it were UTC."""
    return _local(ts, zone) - ts


def tz_offset(t, zone):
    t = text_arg(t, "tz_offset")
    z, v = _zone(zone, False)
    ts = _moment(t.col)
    there = _local(ts, z)
    size = F.date_format(F.lit("2000-01-01").cast("timestamp_ntz") + F.abs(there - ts), "HH:mm")
    out = F.concat(F.when(there < ts, F.lit("-")).otherwise(F.lit("+")), size)
    return derive(F.when(t.col.isNotNull() & v.col.isNotNull(), F.coalesce(out, F.lit(""))), TEXT, t, v)


def tz_convert(t, from_zone, to_zone):
    t = text_arg(t, "tz_convert")
    a, va = _zone(from_zone, True)
    b, vb = _zone(to_zone, True)
    ts = _moment(t.col)
    utc = ts if va.const in ("UTC", "Z") else ts - _offset(ts, a)
    out = _clock_text(utc if vb.const in ("UTC", "Z") else _local(utc, b))
    known = t.col.isNotNull() & va.col.isNotNull() & vb.col.isNotNull()
    return derive(F.when(known, F.coalesce(out, F.lit(""))), TEXT, t, va, vb)


def is_dst(t, zone):
    """Whether the zone database marks daylight saving; in some zones it is the winter that is marked."""
    t = text_arg(t, "is_dst")
    z, v = _zone(zone, False)
    ts = _moment(t.col)
    if v.const is not None and v.const not in zone_names():
        ahead = F.lit(None).cast("boolean")
    else:
        ahead = daylight(ts, z, v.const, sorted(zone_names()))
    return derive(F.when(t.col.isNotNull() & v.col.isNotNull(), F.coalesce(ahead, F.lit(False))), BOOLEAN, t, v)


__all__ = [
    "date_convert", "date_trunc", "dateadd", "datediff", "day", "eomonth", "hour", "is_date", "is_dst", "minute",
    "month", "now", "nth_dow", "quarter", "second", "to_utc", "tz_convert", "tz_offset", "weekday", "weeknum",
    "workday", "year",
]
