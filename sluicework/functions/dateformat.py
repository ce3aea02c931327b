"""Compile a date token format into Spark columns, once, while the plan is built."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token alphabet, longest spelling first within a letter.
TOKENS = [
    "YYYY", "YY", "MMMM", "MMM", "MM", "M", "DDDD", "DD", "D", "hh", "h", "ii", "i", "mm", "m", "ss", "s",
    "A", "a", "ZZZ", "ZZ", "EEEE", "EEE", "EE", "E", "e", "SSSSSSSSS", "SSSSSS", "SSS",
    "FFFFFFFFF", "FFFFFF", "FFF", "GGGG", "WW", "W",
]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September",
          "October", "November", "December"]
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
_ABBR = "|".join(m[:3] for m in MONTHS)
_OFFSET = r"Z|[+-][0-9]{2}:?[0-9]{2}"

_PATTERN = {
    "YYYY": "[0-9]{4}", "YY": "[0-9]{2}", "MM": "[0-9]{2}", "M": "[0-9]{1,2}",
    "MMMM": "(?i:" + "|".join(MONTHS) + ")", "MMM": f"(?i:{_ABBR})",
    "DDDD": "[0-9]{3}", "DD": "[0-9]{2}", "D": "[0-9]{1,2}",
    "hh": "[0-9]{2}", "h": "[0-9]{1,2}", "ii": "[0-9]{2}", "i": "[0-9]{1,2}",
    "mm": "[0-9]{2}", "m": "[0-9]{1,2}", "ss": "[0-9]{2}", "s": "[0-9]{1,2}",
    "A": "[AaPp][Mm]", "a": "[AaPp][Mm]", "ZZ": _OFFSET, "ZZZ": _OFFSET,
    "EEEE": "(?i:" + "|".join(DAYS) + ")", "e": "[1-7]",
    "GGGG": "[0-9]{4}", "WW": "[0-9]{2}", "W": "[0-9]{1,2}",
}
for _t in ("EEE", "EE", "E"):
    _PATTERN[_t] = "(?i:" + "|".join(d[:3] for d in DAYS) + ")"
for _n in (3, 6, 9):
    _PATTERN["S" * _n] = f"[0-9]{{{_n}}}"
    _PATTERN["F" * _n] = f"[0-9]{{1,{_n}}}"

_WIDTH = {"YYYY": 4, "YY": 2, "MM": 2, "MMM": 3, "DDDD": 3, "DD": 2, "hh": 2, "ii": 2, "mm": 2, "ss": 2, "A": 2,
          "a": 2, "EEE": 3, "EE": 3, "E": 3, "e": 1, "SSS": 3, "SSSSSS": 6, "SSSSSSSSS": 9, "GGGG": 4, "WW": 2}


@dataclass(frozen=True)
class Piece:
    kind: str  # token, literal, wildcard
    text: str


def pieces(fmt: str) -> list[Piece]:
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "[":
            end = fmt.find("]", i)
            if end < 0:
                raise ValueError(f"unclosed [ in date format {fmt!r}")
            body = fmt[i + 1 : end]
            out.append(Piece("wildcard", "*") if body == "*" else Piece("literal", body))
            i = end + 1
            continue
        for t in TOKENS:
            if fmt.startswith(t, i):
                out.append(Piece("token", t))
                i += len(t)
                break
        else:
            out.append(Piece("literal", fmt[i]))
            i += 1
    return out


def _normalised(s: Column, ps: list[Piece]) -> Column:
    """Four-letter month spellings cut to three where the format expects three."""
    if not any(p.text == "MMM" and p.kind == "token" for p in ps):
        return s
    return F.regexp_replace(s, rf"(?<![A-Za-z])((?i:{_ABBR}))[A-Za-z](?![A-Za-z])", "$1")


_MARK, _NO_MARK = "\u0001", "\u0002"


class Format:
    """A format's pattern, and where each of its tokens stands."""

    def __init__(self, fmt: str):
        self.pieces = pieces(fmt)
        self.pattern, offset = "^", 1
        self.at: dict[str, tuple] = {}  # token -> group, offset, width
        self.groups = 0
        for i, p in enumerate(self.pieces):
            if p.kind == "wildcard":
                if i + 1 < len(self.pieces):
                    self.pattern += "(?s:.*?)"
                offset = None
            elif p.kind == "literal":
                self.pattern += re.sub(r"([^A-Za-z0-9 ])", r"\\\1", p.text)
                offset = None if offset is None or not p.text.isascii() else offset + len(p.text)
            else:
                self.pattern += "(" + _PATTERN[p.text] + ")"
                self.groups += 1
                width = _WIDTH.get(p.text)
                self.at[p.text] = (self.groups, offset, width)
                offset = None if offset is None or width is None else offset + width
        self.fixed = all(off is not None and width is not None for _, off, width in self.at.values())
        self.plain = not any(p.kind == "token" and p.text == "MMM" for p in self.pieces)

    def cut(self, s: Column) -> Column:
        """The texts of all groups from one search, and a last empty one; a single text where the format does not fit."""
        marked = "".join(f"${g}{_MARK}" for g in range(1, self.groups + 1))
        bare = F.translate(_normalised(s, self.pieces), _MARK, _NO_MARK)
        return F.split(F.regexp_replace(bare, self.pattern + "(?s:.*)", marked), _MARK, -1)


def parsed(s: Column, fmt: str, use: Callable[[Parsed], Column]) -> Column:
    """A value made of what a format reads out of a text.

    Tokens at fixed places are cut out of the text itself. Others take a search, which is done
    once for all of them, however often their texts are read.
    """
    f = Format(fmt)
    if f.fixed and f.plain:
        return use(Parsed(f.pieces, s.rlike(f.pattern), {t: F.substring(s, off, width) for t, (_, off, width) in f.at.items()}))

    def read(cut):
        return use(Parsed(f.pieces, F.size(cut) > 1, {t: F.get(cut, F.lit(g - 1)) for t, (g, _, _) in f.at.items()}))

    return F.get(F.transform(F.array(f.cut(s)), read), F.lit(0))


class Parsed:
    """The components a format reads out of a text column, and whether the text fits it."""

    def __init__(self, ps: list[Piece], ok: Column, parts: dict[str, Column]):
        self.pieces, self.ok, self.parts = ps, ok, parts

    def get(self, *tokens):
        for t in tokens:
            if t in self.parts:
                return t, self.parts[t]
        return None, None

    # two-digit text of each component -------------------------------------------------

    def year(self) -> Column:
        t, c = self.get("YYYY", "YY")
        if t == "YYYY":
            return c
        if t == "YY":
            return F.concat(F.when(c <= "69", F.lit("20")).otherwise(F.lit("19")), c)
        return F.lit("1970")

    def month(self) -> Column:
        t, c = self.get("MM", "M", "MMMM", "MMM")
        if t == "MM":
            return c
        if t == "M":
            return F.lpad(c, 2, "0")
        if t in ("MMMM", "MMM"):
            names = "".join(m[:3].upper() for m in MONTHS)
            k = F.call_function("locate", F.upper(F.left(c, F.lit(3))), F.lit(names))
            return F.lpad(F.floor((k + 2) / 3).cast("string"), 2, "0")
        return F.lit("01")

    def day(self) -> Column:
        t, c = self.get("DD", "D")
        if t is None:
            return F.lit("01")
        return c if t == "DD" else F.lpad(c, 2, "0")

    def hour(self) -> Column:
        t, c = self.get("hh", "h")
        if t is not None:
            h = c if t == "hh" else F.lpad(c, 2, "0")
            return h
        t, c = self.get("ii", "i")
        if t is None:
            return F.lit("00")
        _, half = self.get("A", "a")
        h = c.try_cast("int")
        if half is not None:
            h = F.when(F.upper(half) == "PM", h % 12 + 12).otherwise(h % 12)
        return F.lpad(h.cast("string"), 2, "0")

    def minute(self) -> Column:
        t, c = self.get("mm", "m")
        return F.lit("00") if t is None else c if t == "mm" else F.lpad(c, 2, "0")

    def second(self) -> Column:
        t, c = self.get("ss", "s")
        return F.lit("00") if t is None else c if t == "ss" else F.lpad(c, 2, "0")

    def nanos(self) -> Column:
        """Nine fraction digits."""
        t, c = self.get("SSSSSSSSS", "SSSSSS", "SSS", "FFFFFFFFF", "FFFFFF", "FFF")
        return F.lit("0" * 9) if t is None else F.rpad(c, 9, "0")

    def offset_minutes(self) -> Column:
        t, c = self.get("ZZ", "ZZZ")
        if t is None:
            return F.lit(0)
        digits = F.replace(F.substring(c, 2, 5), F.lit(":"), F.lit(""))
        m = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
        return F.when(c == "Z", F.lit(0)).when(c.startswith("-"), -m).otherwise(m)

    def date_text(self) -> Column:
        """``YYYY-MM-DD``; NULL when the text does not fit the format or is no calendar day."""
        t, doy = self.get("DDDD")
        if t is not None:
            first = F.concat(self.year(), F.lit("-01-01")).try_cast("date")
            day = F.date_add(first, doy.try_cast("int") - 1)
            good = self.ok & (doy != "000") & (F.year(day) == F.year(first))
            return F.when(good, day.cast("string"))
        t, week = self.get("WW", "W")
        g, wy = self.get("GGGG")
        if t is not None and g is not None:
            jan4 = F.concat(wy, F.lit("-01-04")).try_cast("date")
            _, dow = self.get("e")
            n = dow.try_cast("int") - 1 if dow is not None else F.lit(0)
            day = F.date_add(F.trunc(jan4, "week"), ((week.try_cast("int") - 1) * 7 + n).cast("int"))
            return F.when(self.ok & week.try_cast("int").between(1, 53), day.cast("string"))
        d = F.concat(self.year(), F.lit("-"), self.month(), F.lit("-"), self.day())
        return F.when(self.ok & d.try_cast("date").isNotNull(), d)

    def clock_ok(self) -> Column | None:
        tests = []
        for tokens, top in ((("hh", "h"), 23), (("mm", "m"), 59), (("ss", "s"), 59)):
            t, c = self.get(*tokens)
            if t in ("hh", "mm", "ss"):
                tests.append(c <= f"{top:02d}")
            elif t is not None:
                tests.append(c.try_cast("int") <= top)
        t, c = self.get("ii", "i")
        if t is not None:
            tests.append(c.try_cast("int").between(1, 12))
        out = None
        for x in tests:
            out = x if out is None else out & x
        return out

    def valid(self) -> Column:
        good = self.date_text().isNotNull()
        clock = self.clock_ok()
        return good if clock is None else good & clock


def render(p: Parsed, fmt: str) -> Column:
    """Write the parsed components in another format, without a valid-input test."""
    date = None

    def day() -> Column:
        return p.date_text().try_cast("date")

    simple_date = p.get("DDDD")[0] is None and p.get("GGGG")[0] is None
    out: list[Column] = []
    for i, q in enumerate(pieces(fmt)):
        if q.kind == "wildcard":
            continue
        if q.kind == "literal":
            out.append(F.lit(q.text))
            continue
        t = q.text
        year = p.year() if simple_date else F.substring(p.date_text(), 1, 4)
        month = p.month() if simple_date else F.substring(p.date_text(), 6, 2)
        dom = p.day() if simple_date else F.substring(p.date_text(), 9, 2)
        if t == "YYYY":
            c = year
        elif t == "YY":
            c = F.substring(year, 3, 2)
        elif t == "MM":
            c = month
        elif t == "M":
            c = F.ltrim(month, F.lit("0"))
        elif t in ("MMM", "MMMM"):
            c = F.element_at(F.array(*[F.lit(m if t == "MMMM" else m[:3]) for m in MONTHS]), month.cast("int"))
        elif t == "DD":
            c = dom
        elif t == "D":
            c = F.ltrim(dom, F.lit("0"))
        elif t == "DDDD":
            c = F.lpad(F.dayofyear(day()).cast("string"), 3, "0")
        elif t in ("hh", "h"):
            c = p.hour() if t == "hh" else p.hour().cast("int").cast("string")
        elif t in ("ii", "i"):
            h = (p.hour().cast("int") + 11) % 12 + 1
            c = F.lpad(h.cast("string"), 2, "0") if t == "ii" else h.cast("string")
        elif t in ("mm", "m"):
            c = p.minute() if t == "mm" else p.minute().cast("int").cast("string")
        elif t in ("ss", "s"):
            c = p.second() if t == "ss" else p.second().cast("int").cast("string")
        elif t in ("A", "a"):
            c = F.when(p.hour() >= "12", F.lit("PM" if t == "A" else "pm")).otherwise(F.lit("AM" if t == "A" else "am"))
        elif t in ("ZZ", "ZZZ"):
            m = p.offset_minutes()
            a = F.abs(m)
            c = F.concat(
                F.when(m < 0, F.lit("-")).otherwise(F.lit("+")),
                F.lpad(F.floor(a / 60).cast("string"), 2, "0"),
                F.lit(":" if t == "ZZ" else ""),
                F.lpad((a % 60).cast("string"), 2, "0"),
            )
        elif t in ("EEEE", "EEE", "EE", "E"):
            names = [d if t == "EEEE" else d[:3] for d in DAYS]
            c = F.element_at(F.array(*[F.lit(d) for d in names]), F.weekday(day()) + 1)
        elif t == "e":
            c = (F.weekday(day()) + 1).cast("string")
        elif t.startswith("S"):
            c = F.substring(p.nanos(), 1, len(t))
        elif t.startswith("F"):
            c = F.rtrim(F.substring(p.nanos(), 1, len(t)), F.lit("0"))
            if out and i and pieces(fmt)[i - 1].kind == "literal" and pieces(fmt)[i - 1].text[-1:] in ".,":
                lead = pieces(fmt)[i - 1].text
                out[-1] = F.when(c == "", F.lit(lead[:-1])).otherwise(F.lit(lead))
        elif t == "GGGG":
            c = F.lpad(F.year(F.date_add(F.trunc(day(), "week"), 3)).cast("string"), 4, "0")
        else:  # WW, W
            w = F.weekofyear(day()).cast("string")
            c = F.lpad(w, 2, "0") if t == "WW" else w
        out.append(c)
    return F.concat(*out) if out else F.lit("")
