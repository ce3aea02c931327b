"""Column functions and operators over whole tables."""

from __future__ import annotations

from .. import functions as fn
from .base import digits, scalars

f = fn.field
D = digits

# ---------------------------------------------------------------- operators

scalars("x_01_add_sub", "items", lambda: {"total": f("signed") + f("us"), "net": f("plain") - f("qty"), "lenient": f("dirty") + 1}, {
    "total": D("sc + cents"), "net": D("cents - q * 100"),
    "lenient": f"CASE WHEN ln = 3 THEN NULL WHEN ln IN (4, 5) THEN '1' ELSE {D('cents + 100')} END",
}, "k,ln")
scalars("x_02_multiply", "items", lambda: {"gross": f("plain") * f("qty"), "scaled": f("signed") * "0.001", "sq": f("us") * f("us")}, {
    "gross": D("cents * q"), "scaled": D("sc", 5), "sq": D("CAST(cents AS HUGEINT) * cents", 4),
}, "k,ln")
_quot = "(2 * CAST(cents AS HUGEINT) * 10000000000 + q) // (2 * q)"
scalars("x_03_divide", "items", lambda: {"unit": f("plain") / f("qty"), "bps": f("signed") / 10000, "none": f("plain") / (f("qty") - f("qty"))}, {
    "unit": D(_quot, 12), "bps": D("sc", 6), "none": "''",
}, "k,ln")
# Operands near 1e25 on either side, where Spark's own decimal rules run out of digits.
scalars("x_02_multiply_wide", "goods", lambda: {
    "part": fn.concat(f("k"), "0" * 20) * "0.01", "literal": fn.concat(f("k"), "0" * 20) * "0.000000000001",
    "column": fn.concat(f("k"), "0" * 20) * fn.concat("0.0", f("size")), "less": -(fn.concat(f("k"), "0" * 20) * 1) + fn.concat(f("k"), "0" * 20),
}, {
    "part": "CASE WHEN k = 0 THEN '0' ELSE CAST(k AS VARCHAR) || repeat('0', 18) END", "literal": "CASE WHEN k = 0 THEN '0' ELSE CAST(k AS VARCHAR) || repeat('0', 8) END",
    "column": "CASE WHEN k = 0 THEN '0' ELSE CAST(CAST(k AS HUGEINT) * CAST(size AS HUGEINT) AS VARCHAR) || repeat('0', 19 - length(size)) END", "less": "'0'",
})
scalars("x_03_divide_wide", "goods", lambda: {
    "literal": fn.concat(f("k"), "0" * 20) / "3.2", "same": fn.concat(f("k"), "0" * 20, ".5") / fn.concat(f("k"), "0" * 20, ".5"),
}, {
    "literal": "CASE WHEN k = 0 THEN '0' ELSE CAST(k * 3125 AS VARCHAR) || repeat('0', 16) END", "same": "'1'",
})
scalars("x_04_negate", "items", lambda: {"v": -f("signed")}, {"v": D("-sc")}, "k,ln")
scalars("x_05_concat", "items", lambda: {"v": fn.concat(f("flag"), "/", f("plain") * 1, "/", f("qty"))}, {
    "v": f"flag || '/' || {D('cents')} || '/' || qty"}, "k,ln")
scalars("x_06_equal", "items", lambda: {
    "num": f("plain") == f("us"), "lit": f("qty") == "7.00", "txt": f("flag") == "R", "ne": f("dirty") != f("plain"), "zero": f("dirty") == 0,
}, {
    "num": "'true'", "lit": "CAST(q = 7 AS VARCHAR)", "txt": "CAST(flag = 'R' AS VARCHAR)",
    "ne": "CAST(ln IN (3, 4, 5) AS VARCHAR)", "zero": "CAST(ln IN (4, 5) AS VARCHAR)",
}, "k,ln")
scalars("x_07_order", "items", lambda: {"gt": f("us") > 50000, "le": f("dirty") <= f("qty")}, {
    "gt": "CAST(cents > 5000000 AS VARCHAR)",
    "le": "CASE WHEN ln = 3 THEN NULL WHEN ln IN (4, 5) THEN CAST(0 <= q AS VARCHAR) ELSE CAST(cents <= q * 100 AS VARCHAR) END",
}, "k,ln")
scalars("x_08_logic", "items", lambda: {
    "a": (f("us") > 50000) & (f("flag") == "R"), "o": (f("us") > 90000) | (f("status") == "O"), "n": ~(f("flag") == "R"),
    "e": (f("flag") == "R") | (f("dirty") > 1),
}, {
    "a": "CAST(cents > 5000000 AND flag = 'R' AS VARCHAR)", "o": "CAST(cents > 9000000 OR status = 'O' AS VARCHAR)",
    "n": "CAST(flag <> 'R' AS VARCHAR)",
    "e": "CASE WHEN ln = 3 THEN NULL ELSE CAST(flag = 'R' OR (ln NOT IN (4, 5) AND cents > 100) AS VARCHAR) END",
}, "k,ln")

# ---------------------------------------------------------------- logic

scalars("f_if", "items", lambda: {"v": fn.if_(f("flag") == "R", "returned", f("plain") * 1), "t": fn.if_(f("dirty"), "y", "n")}, {
    "v": f"CASE WHEN flag = 'R' THEN 'returned' ELSE {D('cents')} END", "t": "CASE WHEN dirty = '' THEN 'n' ELSE 'y' END",
}, "k,ln")
scalars("f_case", "sales", lambda: {"v": fn.case(f("status"), "F", "final", "P", "part", "open"), "d": fn.case(f("prio"), "1-URGENT", "1")}, {
    "v": "CASE status WHEN 'F' THEN 'final' WHEN 'P' THEN 'part' ELSE 'open' END",
    "d": "CASE prio WHEN '1-URGENT' THEN '1' ELSE '' END",
})
scalars("f_iferror", "items", lambda: {"v": fn.iferror(f("dirty") * 2, "bad")}, {
    "v": f"CASE WHEN ln = 3 THEN 'bad' WHEN ln IN (4, 5) THEN '0' ELSE {D('cents * 2')} END"}, "k,ln")
scalars("f_coalesce", "sales", lambda: {"v": fn.coalesce(f("maybe"), f("dmy"))}, {"v": "CASE WHEN trim(maybe) <> '' THEN maybe ELSE dmy END"})
scalars("f_nullif", "sales", lambda: {"v": fn.nullif(f("maybe"), "soon"), "z": fn.nullif(f("n"), "0.0")}, {
    "v": "CASE WHEN maybe = 'soon' THEN '' ELSE maybe END", "z": "CASE WHEN n = 0 THEN '' ELSE CAST(n AS VARCHAR) END"})
scalars("f_in", "items", lambda: {"v": fn.in_(f("qty"), "1.0", "2", "3.00"), "t": fn.in_(f("flag"), "A", "R", "Z")}, {
    "v": "CAST(q IN (1, 2, 3) AS VARCHAR)", "t": "CAST(flag IN ('A', 'R') AS VARCHAR)"}, "k,ln")
scalars("f_isempty", "sales", lambda: {"v": fn.isempty(f("maybe"))}, {"v": "CAST(trim(maybe) = '' AS VARCHAR)"})
scalars("f_is_numeric", "items", lambda: {"v": fn.is_numeric(f("dirty")), "g": fn.is_numeric(f("us")), "p": fn.is_numeric(f("price"))}, {
    "v": "CAST(ln NOT IN (3, 4, 5) AS VARCHAR)", "g": "'true'", "p": "'false'"}, "k,ln")

# ---------------------------------------------------------------- text

scalars("f_trim", "prose", lambda: {"v": fn.trim(fn.concat(" \t", f("text"), "\r\n "))}, {"v": "trim(text, ' \t\r\n')".replace("\t", "' || chr(9) || '").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '")})
scalars("f_left", "prose", lambda: {"v": fn.left(f("source"), 3), "z": fn.left(f("source"), -1)}, {"v": "left(source, 3)", "z": "''"})
scalars("f_right", "prose", lambda: {"v": fn.right(f("source"), 2)}, {"v": "right(source, 2)"})
scalars("f_substr", "links", lambda: {"v": fn.substr(f("url"), 5, 12), "z": fn.substr(f("url"), 0, 3)}, {"v": "substr(url, 5, 12)", "z": "''"})
scalars("f_len", "prose", lambda: {"v": fn.len_(f("text"))}, {"v": "CAST(strlen(text) AS VARCHAR)"})
scalars("f_upper", "prose", lambda: {"v": fn.upper(f("text"))}, {"v": "upper(replace(text, 'ß', 'SS'))"})
scalars("f_lower", "prose", lambda: {"v": fn.lower(f("text"))}, {"v": "lower(text)"})
_W = "[A-Za-z\\x{80}-\\x{10FFFF}]+|[^A-Za-z\\x{80}-\\x{10FFFF}]+"
scalars("f_proper", "goods", lambda: {"v": fn.proper(fn.concat(f("name"), "-", f("brand"), "'", f("type")))}, {
    "v": f"array_to_string(list_transform(regexp_extract_all(lower(name || '-' || brand || '''' || type), '{_W}'), lambda w: upper(w[1]) || w[2:]), '')"})
scalars("f_unaccent", "prose", lambda: {"v": fn.unaccent(f("text"))}, {"v": "strip_accents(replace(text, 'ß', 'ss'))"})
scalars("f_contains", "prose", lambda: {"v": fn.contains(f("text"), "the"), "d": fn.contains(f("text"), f("lang"))}, {
    "v": "CAST(contains(text, 'the') AS VARCHAR)", "d": "CAST(contains(text, lang) AS VARCHAR)"})
scalars("f_starts_with", "links", lambda: {"v": fn.starts_with(f("url"), "https"), "e": fn.starts_with(f("url"), "")}, {
    "v": "CAST(starts_with(url, 'https') AS VARCHAR)", "e": "'true'"})
scalars("f_ends_with", "links", lambda: {"v": fn.ends_with(f("url"), "top")}, {"v": "CAST(ends_with(url, 'top') AS VARCHAR)"})
scalars("f_split_part", "links", lambda: {"host": fn.split_part(f("url"), "/", 3), "past": fn.split_part(f("url"), "/", 99), "none": fn.split_part(f("url"), "", 1)}, {
    "host": "split_part(url, '/', 3)", "past": "''", "none": "''"})
scalars("f_position", "prose", lambda: {"v": fn.position("e", f("text")), "z": fn.position("", f("text"))}, {
    "v": "CAST(CASE WHEN instr(text, 'e') = 0 THEN 0 ELSE strlen(left(text, CAST(instr(text, 'e') - 1 AS BIGINT))) + 1 END AS VARCHAR)", "z": "'1'"})
scalars("f_lpad", "clients", lambda: {"v": fn.lpad(f("nation"), 5, "0"), "c": fn.lpad(f("name"), 4, "x")}, {"v": "lpad(nation, 5, '0')", "c": "left(name, 4)"})
scalars("f_rpad", "clients", lambda: {"v": fn.rpad(f("segment"), 14, ".-")}, {"v": "rpad(segment, 14, '.-')"})
scalars("f_regex_match", "links", lambda: {"v": fn.regex_match(f("url"), r"^https?://[a-z]\."), "d": fn.regex_match(f("html"), "(?i)<H1>")}, {
    "v": r"CAST(regexp_matches(url, '^https?://[a-z]\.') AS VARCHAR)", "d": "CAST(regexp_matches(html, '(?i)<H1>') AS VARCHAR)"})
scalars("f_regex_extract", "links", lambda: {"dom": fn.regex_extract(f("url"), r"://([^/]+)"), "num": fn.regex_extract(f("url"), r"[0-9]+"), "title": fn.regex_extract(f("html"), r"<title>([^<]*)</title>")}, {
    "dom": "regexp_extract(url, '://([^/]+)', 1)", "num": "regexp_extract(url, '[0-9]+')", "title": "regexp_extract(html, '<title>([^<]*)</title>', 1)"})
scalars("f_regex_replace", "prose", lambda: {"v": fn.regex_replace(f("text"), r"([A-Za-z]+)\.", "<$1>")}, {
    "v": r"regexp_replace(text, '([A-Za-z]+)\.', '<\1>', 'g')"})

# ---------------------------------------------------------------- mapping

SEGMENTS = {"AUTOMOBILE": "cars", "BUILDING": "bricks", "FURNITURE": "chairs"}
_segment_case = "CASE segment WHEN 'AUTOMOBILE' THEN 'cars' WHEN 'BUILDING' THEN 'bricks' WHEN 'FURNITURE' THEN 'chairs' ELSE segment END"
scalars("f_remap", "clients", lambda: {"v": fn.remap(f("segment"), SEGMENTS)}, {"v": _segment_case})
scalars("f_replace", "goods", lambda: {"one": fn.replace(f("name"), "e", "3"), "none": fn.replace(f("name"), "", "x"),
                                       "many": fn.replace(f("name"), "e", "<i>", "i", "<e>"), "gone": fn.replace(f("name"), "e", "", "i", "")}, {
    "one": "replace(name, 'e', '3')", "none": "name",
    "many": "replace(replace(replace(replace(name, 'e', chr(1)), 'i', chr(2)), chr(1), '<i>'), chr(2), '<e>')",
    "gone": "replace(replace(name, 'e', ''), 'i', '')"})

# ---------------------------------------------------------------- numbers

scalars("f_abs", "items", lambda: {"v": fn.abs_(f("signed"))}, {"v": D("abs(sc)")}, "k,ln")
_half = "(CASE WHEN sc < 0 THEN -1 ELSE 1 END) * ((abs(sc) + {h}) // {p})"
scalars("f_round", "items", lambda: {"one": fn.round_(f("signed"), 1), "zero": fn.round_(f("signed"), 0), "k3": fn.round_(f("signed"), -3), "all": fn.round_(f("signed"), 12)}, {
    "one": D(_half.format(h=5, p=10), 1), "zero": "CAST(" + _half.format(h=50, p=100) + " AS VARCHAR)",
    "k3": "CAST(1000 * " + _half.format(h=50000, p=100000) + " AS VARCHAR)", "all": D("sc")}, "k,ln")
scalars("f_floor", "items", lambda: {"v": fn.floor(f("signed"))}, {"v": "CAST(CASE WHEN sc >= 0 THEN sc // 100 ELSE -((-sc + 99) // 100) END AS VARCHAR)"}, "k,ln")
scalars("f_ceiling", "items", lambda: {"v": fn.ceiling(f("signed"))}, {"v": "CAST(CASE WHEN sc >= 0 THEN (sc + 99) // 100 ELSE -((-sc) // 100) END AS VARCHAR)"}, "k,ln")
scalars("f_trunc", "items", lambda: {"v": fn.trunc(f("signed")), "t": fn.trunc(f("signed"), 1), "k2": fn.trunc(f("signed"), -2)}, {
    "v": "CAST((CASE WHEN sc < 0 THEN -1 ELSE 1 END) * (abs(sc) // 100) AS VARCHAR)", "t": D("(CASE WHEN sc < 0 THEN -1 ELSE 1 END) * (abs(sc) // 10)", 1),
    "k2": "CAST((CASE WHEN sc < 0 THEN -100 ELSE 100 END) * (abs(sc) // 10000) AS VARCHAR)"}, "k,ln")
scalars("f_sign", "items", lambda: {"v": fn.sign(f("signed"))}, {"v": "CAST(sign(sc) AS VARCHAR)"}, "k,ln")
scalars("f_mround", "items", lambda: {"v": fn.mround(f("signed"), "0.25"), "z": fn.mround(f("signed"), "0")}, {
    "v": D("(CASE WHEN sc < 0 THEN -25 ELSE 25 END) * ((abs(sc) + 12) // 25 + CASE WHEN abs(sc) % 25 = 12 AND false THEN 1 ELSE 0 END)"), "z": "''"}, "k,ln")
scalars("f_power", "items", lambda: {"sq": fn.power(f("plain"), 2), "cube": fn.power(f("qty"), 3), "half": fn.power(f("qty"), "0.5")}, {
    "sq": D("CAST(cents AS HUGEINT) * cents", 4), "cube": "CAST(q * q * q AS VARCHAR)", "half": "''"}, "k,ln")
scalars("f_sqrt", "items", lambda: {"root": fn.sqrt(f("qty") * f("qty")), "neg": fn.sqrt(f("signed") - 10**9), "r6": fn.round_(fn.sqrt(f("qty")), 6)}, {
    "root": "qty", "neg": "''", "r6": D("CAST(round(sqrt(q) * 1000000) AS BIGINT)", 6)}, "k,ln")
scalars("f_mod", "items", lambda: {"v": fn.mod(f("signed"), "7"), "z": fn.mod(f("signed"), "0")}, {"v": D("sc % 700"), "z": "''"}, "k,ln")
scalars("f_greatest", "items", lambda: {"v": fn.greatest(f("signed"), f("qty"), "100"), "e": fn.greatest(f("dirty"), f("qty"))}, {
    "v": D("greatest(sc, q * 100, 10000)"), "e": f"CASE WHEN ln = 3 THEN NULL WHEN ln IN (4, 5) THEN qty ELSE {D('greatest(cents, q * 100)')} END"}, "k,ln")
scalars("f_least", "items", lambda: {"v": fn.least(f("signed"), f("qty"), "100"), "e": fn.least(f("dirty"), f("qty"))}, {
    "v": D("least(sc, q * 100, 10000)"), "e": f"CASE WHEN ln = 3 THEN NULL WHEN ln IN (4, 5) THEN '0' ELSE {D('least(cents, q * 100)')} END"}, "k,ln")
scalars("f_price_value", "items", lambda: {"v": fn.price_value(f("price"))}, {"v": "plain"}, "k,ln")
scalars("f_price_currency", "items", lambda: {"v": fn.price_currency(f("price")), "n": fn.price_currency(f("plain"))}, {
    "v": "CASE WHEN status = 'O' THEN 'USD' ELSE 'EUR' END", "n": "''"}, "k,ln")
scalars("f_rand", "goods", lambda: {"ok": fn.regex_match(fn.rand(9), "^[1-9][0-9]{8}$"), "one": fn.regex_match(fn.rand(0), "^[1-9]$")}, {"ok": "'true'", "one": "'true'"})

# ---------------------------------------------------------------- dates

scalars("f_now", "goods", lambda: {"ok": fn.regex_match(fn.now(), r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"), "y": fn.year(fn.now()) >= 2024}, {"ok": "'true'", "y": "'true'"})
scalars("f_date_convert", "sales", lambda: {
    "dmy": fn.date_convert(f("dmy"), "DD.MM.YYYY", "YYYY-MM-DD"), "mdy": fn.date_convert(f("mdy"), "M/D/YYYY", "YYYY-MM-DD"),
    "mon": fn.date_convert(f("mon"), "D MMM YYYY", "DD/MM/YY"), "long": fn.date_convert(f("ts"), "YYYY-MM-DD hh:mm:ss", "EEEE D MMMM YYYY h:mm A"),
    "iso": fn.date_convert(f("day"), "YYYY-MM-DD", "GGGG-[W]WW-e DDDD"), "junk": fn.date_convert(f("maybe"), "YYYY-MM-DD", "YYYYMMDD"),
    "wild": fn.date_convert(f("ts"), "YYYY-MM-DD[*]", "MM/YYYY"),
}, {
    "dmy": "day", "mdy": "day", "mon": "strftime(d, '%d/%m/%y')", "long": "strftime(t, '%A %-d %B %Y %-H:%M %p')",
    "iso": "strftime(d, '%G-W%V-%u %j')", "junk": "CASE WHEN maybe IN ('', 'soon') THEN '' ELSE strftime(d, '%Y%m%d') END",
    "wild": "strftime(d, '%m/%Y')",
})
scalars("f_is_date", "sales", lambda: {"v": fn.is_date(f("maybe")), "f": fn.is_date(f("dmy"), "DD.MM.YYYY"), "n": fn.is_date(f("dmy"), "MM.DD.YYYY")}, {
    "v": "CAST(maybe NOT IN ('', 'soon') AS VARCHAR)", "f": "'true'", "n": "CAST(day(d) <= 12 AS VARCHAR)"})
scalars("f_dateadd", "sales", lambda: {"v": fn.dateadd(f("day"), f("n")), "m": fn.dateadd(f("maybe"), 30), "far": fn.dateadd(f("day"), 4000000)}, {
    "v": "strftime(d + CAST(n AS INTEGER), '%Y-%m-%d')", "m": "CASE maybe WHEN '' THEN '' WHEN 'soon' THEN NULL ELSE strftime(d + 30, '%Y-%m-%d') END", "far": "''"})
scalars("f_datediff", "sales", lambda: {"v": fn.datediff(f("day"), "1998-01-01"), "b": fn.datediff(f("ts"), "")}, {
    "v": "CAST(d - DATE '1998-01-01' AS VARCHAR)", "b": "''"})
scalars("f_workday", "sales", lambda: {"fwd": fn.workday(f("day"), 10), "back": fn.workday(f("day"), -3), "zero": fn.workday(f("day"), 0)}, {
    "fwd": "strftime(d + 14 - CASE WHEN isodow(d) >= 6 THEN CAST(isodow(d) - 5 AS INTEGER) ELSE 0 END, '%Y-%m-%d')",
    "back": "strftime(d - CASE isodow(d) WHEN 1 THEN 5 WHEN 2 THEN 5 WHEN 3 THEN 5 WHEN 6 THEN 3 WHEN 7 THEN 4 ELSE 3 END, '%Y-%m-%d')",
    "zero": "day"})
for _name, _fn, _sql in (
    ("year", fn.year, "year(d)"), ("month", fn.month, "month(d)"), ("day", fn.day, "day(d)"), ("weekday", fn.weekday, "isodow(d)"),
    ("quarter", fn.quarter, "quarter(d)"), ("weeknum", fn.weeknum, "weekofyear(d)"),
):
    scalars(f"f_{_name}", "sales", lambda _fn=_fn: {"v": _fn(f("ts")), "m": _fn(f("maybe"))}, {
        "v": f"CAST({_sql} AS VARCHAR)", "m": f"CASE maybe WHEN '' THEN '' WHEN 'soon' THEN NULL ELSE CAST({_sql} AS VARCHAR) END"})
for _name, _fn in (("hour", fn.hour), ("minute", fn.minute), ("second", fn.second)):
    scalars(f"f_{_name}", "sales", lambda _fn=_fn: {"v": _fn(f("ts")), "d": _fn(f("day"))}, {"v": f"CAST({_name}(t) AS VARCHAR)", "d": "'0'"})
scalars("f_date_trunc", "sales", lambda: {u: fn.date_trunc(u, f("ts")) for u in ("year", "quarter", "month", "week", "day")}, {
    u: f"strftime(date_trunc('{u}', d), '%Y-%m-%d')" for u in ("year", "quarter", "month", "week", "day")}, "k")
scalars("f_eomonth", "sales", lambda: {"v": fn.eomonth(f("day"))}, {"v": "strftime(last_day(d), '%Y-%m-%d')"})
scalars("f_nth_dow", "sales", lambda: {
    "last": fn.nth_dow(fn.year(f("day")), 3, 7, -1), "second": fn.nth_dow(fn.year(f("day")), fn.month(f("day")), 2, 2), "fifth": fn.nth_dow(fn.year(f("day")), 2, 1, 5),
}, {
    "last": "strftime(make_date(year(d), 3, 31) - CAST(isodow(make_date(year(d), 3, 31)) % 7 AS INTEGER), '%Y-%m-%d')",
    "second": "strftime(make_date(year(d), month(d), 1) + CAST((2 - isodow(make_date(year(d), month(d), 1)) + 7) % 7 AS INTEGER) + 7, '%Y-%m-%d')",
    "fifth": "CASE WHEN year(d) % 4 = 0 AND isodow(make_date(year(d), 2, 1)) = 1 THEN strftime(make_date(year(d), 2, 1) + 28, '%Y-%m-%d') ELSE '' END",
})
scalars("f_to_utc", "sales", lambda: {
    "v": fn.to_utc(fn.concat(fn.replace(f("ts"), " ", "T"), "+02:00"), "YYYY-MM-DD[T]hh:mm:ssZZ"), "w": fn.to_utc(fn.concat(f("ts"), " -0530"), "YYYY-MM-DD hh:mm:ss ZZZ"),
    "z": fn.to_utc(fn.concat(f("ts"), "Z"), "YYYY-MM-DD hh:mm:ssZZ"), "bad": fn.to_utc(f("maybe"), "YYYY-MM-DD hh:mm:ssZZ"),
}, {
    "v": "strftime(t - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S')", "w": "strftime(t + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S')", "z": "ts", "bad": "''",
})
# Central European time changes at 01:00 UTC on the last Sunday of March and October; the last Sunday of
# October belonged to the rule from 1996 on, September before that.
_eu = """(t >= (make_date(year(d), 3, 31) - CAST(isodow(make_date(year(d), 3, 31)) % 7 AS INTEGER)) + INTERVAL 1 HOUR
  AND t < (CASE WHEN year(d) < 1996 THEN make_date(year(d), 9, 30) - CAST(isodow(make_date(year(d), 9, 30)) % 7 AS INTEGER)
    ELSE make_date(year(d), 10, 31) - CAST(isodow(make_date(year(d), 10, 31)) % 7 AS INTEGER) END) + INTERVAL 1 HOUR)"""
# Winter is the marked half of the year; until 1995 it began on the Sunday from 22 October on.
_ie = """NOT (t >= (make_date(year(d), 3, 31) - CAST(isodow(make_date(year(d), 3, 31)) % 7 AS INTEGER)) + INTERVAL 1 HOUR
  AND t < (CASE WHEN year(d) < 1996 THEN make_date(year(d), 10, 28) - CAST(isodow(make_date(year(d), 10, 28)) % 7 AS INTEGER)
    ELSE make_date(year(d), 10, 31) - CAST(isodow(make_date(year(d), 10, 31)) % 7 AS INTEGER) END) + INTERVAL 1 HOUR)"""
scalars("f_tz_offset", "sales", lambda: {"v": fn.tz_offset(f("ts"), "Europe/Prague"), "i": fn.tz_offset(f("ts"), "Asia/Kolkata"), "u": fn.tz_offset(f("ts"), "No/Where"), "b": fn.tz_offset(f("prio"), "Europe/Prague")}, {
    "v": f"CASE WHEN {_eu} THEN '+02:00' ELSE '+01:00' END", "i": "'+05:30'", "u": "''", "b": "''"})
scalars("f_tz_convert", "sales", lambda: {
    "ist": fn.tz_convert(f("ts"), "UTC", "Asia/Kolkata"), "fix": fn.tz_convert(f("ts"), "+02:00", "-05:00"), "prg": fn.tz_convert(f("ts"), "UTC", "Europe/Prague"), "u": fn.tz_convert(f("ts"), "No/Where", "UTC"),
}, {
    "ist": "strftime(t + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S')", "fix": "strftime(t - INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S')",
    "prg": f"strftime(t + CASE WHEN {_eu} THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END, '%Y-%m-%d %H:%M:%S')", "u": "''",
})
scalars("f_is_dst", "sales", lambda: {"v": fn.is_dst(f("ts"), "Europe/Prague"), "i": fn.is_dst(f("ts"), "Asia/Kolkata"), "u": fn.is_dst(f("ts"), "No/Where"),
    "ie": fn.is_dst(f("ts"), "Europe/Dublin"), "ma": fn.is_dst(f("ts"), "Africa/Casablanca"),
    "any": fn.is_dst(f("ts"), fn.if_(f("status") == "F", "Europe/Dublin", fn.if_(f("status") == "O", "Europe/Prague", "No/Where")))}, {
    "v": f"CAST({_eu} AS VARCHAR)", "i": "'false'", "u": "'false'", "ie": f"CAST({_ie} AS VARCHAR)", "ma": "'false'",
    "any": f"CAST(CASE status WHEN 'F' THEN {_ie} WHEN 'O' THEN {_eu} ELSE false END AS VARCHAR)"})
