"""Text functions. Lengths and offsets count UTF-8 bytes."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import functions as F

from ..session import active_session
from .values import BLANKS, BOOLEAN, INTEGER, TEXT
from .values import derive, num, parse_number, text_arg, val

MAX_PAD = 65535


def _bytes(c):
    return c.cast("binary")


def _int(n):
    """A whole number column from a literal or a value; fractions are cut."""
    v = val(n)
    if v.const is not None and not isinstance(v.const, bool):
        d = parse_number(str(v.const))
        if d is None:
            raise TypeError("a number is expected")
        return F.lit(max(-2147483647, min(2147483647, int(d)))), v, int(d)
    d = F.greatest(F.lit(-2147483647), F.least(F.lit(2147483647), num(v)))
    d = F.when(num(v).isNotNull(), F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)))
    return d.cast("int"), v, None


def trim(s):
    s = val(s)
    if s.kind != TEXT:
        return s
    return derive(F.trim(s.col, F.lit(BLANKS)), TEXT, s)


def left(s, n):
    s = text_arg(s, "left")
    k, v, _ = _int(n)
    return derive(F.substring(_bytes(s.col), F.lit(1), F.greatest(k, F.lit(0))).cast("string"), TEXT, s, v)


def right(s, n):
    s = text_arg(s, "right")
    k, v, _ = _int(n)
    size = F.octet_length(s.col)
    k = F.least(F.greatest(k, F.lit(0)), size)
    return derive(F.substring(_bytes(s.col), size - k + 1, k).cast("string"), TEXT, s, v)


def substr(s, start, length):
    """1-based; a start below 1 or a negative length answers ''."""
    s = text_arg(s, "substr")
    a, va, fixed_a = _int(start)
    n, vn, fixed_n = _int(length)
    cut = F.substring(_bytes(s.col), a, n).cast("string")
    if fixed_a is not None and fixed_n is not None:
        out = cut if fixed_a >= 1 and fixed_n >= 0 else F.when(s.col.isNotNull(), F.lit(""))
    else:
        bad = (a < 1) | (n < 0)
        out = F.when(bad & s.col.isNotNull(), F.lit("")).when(~bad, cut)
    return derive(out, TEXT, s, va, vn)


def len_(s):
    s = text_arg(s, "len")
    return derive(F.octet_length(s.col), INTEGER, s)


def upper(s):
    s = text_arg(s, "upper")
    return derive(F.upper(s.col), TEXT, s)


def lower(s):
    s = text_arg(s, "lower")
    return derive(F.lower(s.col), TEXT, s)


_WORD = r"[A-Za-z\x{80}-\x{10FFFF}]+"
_OTHER = r"[^A-Za-z\x{80}-\x{10FFFF}]+"


def proper(s):
    """Upper-case the letter that follows a non-letter; non-ASCII characters count as letters."""
    s = text_arg(s, "proper")
    runs = F.regexp_extract_all(F.lower(s.col), F.lit(f"({_WORD}|{_OTHER})"), F.lit(1))
    out = F.array_join(
        F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2147483647))), ""
    )
    return derive(out, TEXT, s)


# Letters that carry no separable mark or stand for two letters.
LIGATURES = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O",
    "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "TH",
    "ħ": "h", "Ħ": "H", "ı": "i", "ĸ": "q", "ŀ": "l", "Ŀ": "L", "ŉ": "'n", "ŋ": "n", "Ŋ": "N",
    "ŧ": "t", "Ŧ": "T", "ƀ": "b", "ƒ": "f", "ĳ": "ij", "Ĳ": "IJ", "ſ": "s",
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
    "ǆ": "dz", "ǅ": "Dz", "Ǆ": "DZ", "ǉ": "lj", "ǈ": "Lj", "Ǉ": "LJ", "ǌ": "nj", "ǋ": "Nj", "Ǌ": "NJ",
    "ǳ": "dz", "ǲ": "Dz", "Ǳ": "DZ",
}


@lru_cache(maxsize=1)
def _unaccent_tables() -> tuple[str, str, dict[str, str]]:
    """Character tables derived from the Unicode database: (from, to, longer spellings).

    ``to`` is shorter than ``from``: characters past its end are deleted.
    """
    src, dst, gone, longer = [], [], [], {}
    for cp in range(0xA0, sys.maxunicode + 1):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Co", "Cs") or 0xAC00 <= cp <= 0xD7A3:
            continue
        if ch in LIGATURES:
            out = LIGATURES[ch]
        elif cat == "Mn":
            gone.append(ch)
            continue
        else:
            nfd = unicodedata.normalize("NFD", ch)
            if not any(c in LIGATURES or unicodedata.category(c) == "Mn" for c in nfd):
                continue
            out = "".join(LIGATURES.get(c, c) for c in nfd if unicodedata.category(c) != "Mn")
            out = unicodedata.normalize("NFC", out)
        if out == ch:
            continue
        if len(out) == 1:
            src.append(ch)
            dst.append(out)
        else:
            longer[ch] = out
    return "".join(src + gone), "".join(dst), longer


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def unaccent_body() -> str:
    src, dst, longer = _unaccent_tables()
    swapped = "c"
    for ch, repl in longer.items():
        swapped = f"replace({swapped}, {_literal(ch)}, {_literal(repl)})"
    multi = _literal("[" + "".join(longer) + "]")
    return f"CASE WHEN octet_length(c) = char_length(c) THEN c ELSE translate(CASE WHEN c RLIKE {multi} THEN {swapped} ELSE c END, {_literal(src)}, {_literal(dst)}) END"


def unaccent(s):
    """Strip marks and spell out ligatures, all inside the JVM; pure ASCII text is left alone. The text is bound once."""
    s = text_arg(s, "unaccent")
    spark = active_session()
    if not getattr(spark, "_sluicework_unaccent", False):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION sw_plain_letters(c STRING) RETURNS STRING RETURN {unaccent_body()}")
        spark._sluicework_unaccent = True
    return derive(F.call_function("sw_plain_letters", s.col), TEXT, s)


def contains(h, n):
    h, n = text_arg(h, "contains"), text_arg(n, "contains")
    return derive(F.contains(h.col, n.col), BOOLEAN, h, n)


def starts_with(s, p):
    s, p = text_arg(s, "starts_with"), text_arg(p, "starts_with")
    return derive(F.startswith(s.col, p.col), BOOLEAN, s, p)


def ends_with(s, p):
    s, p = text_arg(s, "ends_with"), text_arg(p, "ends_with")
    return derive(F.endswith(s.col, p.col), BOOLEAN, s, p)


def split_part(s, delim, n):
    """1-based part; past the end, an empty delimiter and n < 1 all answer ''."""
    s, delim = text_arg(s, "split_part"), text_arg(delim, "split_part")
    k, v, fixed = _int(n)
    if fixed is not None and delim.const is not None:
        if fixed < 1 or delim.const == "":
            return derive(F.when(s.col.isNotNull(), F.lit("")), TEXT, s)
        return derive(F.split_part(s.col, delim.col, k), TEXT, s)
    bad = (k < 1) | (delim.col == "")
    part = F.split_part(
        s.col, F.when(delim.col == "", F.lit("?")).otherwise(delim.col), F.when(k < 1, F.lit(1)).otherwise(k)
    )
    return derive(F.when(bad & s.col.isNotNull(), F.lit("")).when(~bad, part), TEXT, s, delim, v)


def position(needle, hay):
    """1-based byte offset of the first match, 0 when absent, 1 for an empty needle."""
    needle, hay = text_arg(needle, "position"), text_arg(hay, "position")
    at = F.call_function("locate", needle.col, hay.col)
    before = F.octet_length(F.call_function("substring", hay.col, F.lit(1), at - 1))
    out = F.when(needle.col == "", F.when(hay.col.isNotNull(), F.lit(1))).when(at == 0, F.lit(0)).when(at > 0, before + 1)
    return derive(out, INTEGER, needle, hay)


def _pad(s, n, pad, name):
    s, pad = text_arg(s, name), text_arg(pad, name)
    k, v, _ = _int(n)
    k = F.greatest(F.lit(0), F.least(F.lit(MAX_PAD), k))
    padded = F.call_function(name, _bytes(s.col), k, _bytes(pad.col)).cast("string")
    if pad.const:
        return derive(padded, TEXT, s, v)
    return derive(F.when(pad.col == "", s.col).when(pad.col != "", padded), TEXT, s, v, pad)


def lpad(s, n, pad):
    return _pad(s, n, pad, "lpad")


def rpad(s, n, pad):
    return _pad(s, n, pad, "rpad")


# ---------------------------------------------------------------- regular expressions

#: Letters that may follow a backslash in the RE2 dialect.
_ESCAPES = frozenset("afrntvxQEAbBzdDsSwWpP")


def java_pattern(p: str) -> str:
    """Check an RE2-style pattern and spell it for the JVM.

    Lookaround, back-references, possessive quantifiers and the JVM's own
    escapes are refused. Named groups, case folding, the end anchor, swapped
    greediness and white space are written the JVM way, with ``\\n`` as the only
    line end. What is left is compiled once, so a bad pattern fails here.
    """
    out, i, in_class = ["(?d)"], 0, False
    modes = [frozenset()]  # flags of the open groups
    while i < len(p):
        ch = p[i]
        if ch == "\\" and i + 1 < len(p):
            nxt = p[i + 1]
            if nxt == "Q" and not in_class:
                end = p.find("\\E", i)
                end = len(p) if end < 0 else end
                out += ["\\" + c if not c.isalnum() and c.isascii() else c for c in p[i + 2 : end]]
                i = min(len(p), end + 2)
                continue
            if nxt in "123456789":
                raise ValueError(f"back-reference in pattern {p!r}")
            if nxt.isalpha() and nxt.isascii() and nxt not in _ESCAPES:
                raise ValueError(f"unknown escape in pattern {p!r}: \\{nxt}")
            inner = "\\t\\n\\f\\r "
            white = {"s": inner if in_class else f"[{inner}]", "v": "\\x0B"} | ({} if in_class else {"S": f"[^{inner}]"})
            out.append(white.get(nxt, "\\" + nxt))
            i += 2
            if nxt in "pPx" and p[i : i + 1] == "{":
                end = p.find("}", i) + 1
                out.append(p[i:end])
                i = end
            continue
        if in_class:
            if ch == "]":
                in_class = False
            elif ch == "[" and p[i : i + 2] != "[:":
                ch = "\\["
            elif ch == "&" and p[i : i + 2] == "&&":
                ch = "\\&"
            elif p[i : i + 2] == "[:":
                end = p.find(":]", i)
                if end < 0:
                    raise ValueError(f"unclosed character class in {p!r}")
                out.append("\\p{" + _POSIX[p[i + 2 : end]] + "}")
                i = end + 2
                continue
            out.append(ch)
            i += 1
            continue
        if ch == "[":
            in_class = True
            out.append(ch)
            i += 1
            if p[i : i + 1] == "^":
                out.append("^")
                i += 1
            if p[i : i + 1] == "]":
                out.append("\\]")
                i += 1
            continue
        if ch == "$":
            out.append("$" if "m" in modes[-1] else "\\z")
            i += 1
            continue
        if ch == ")" and len(modes) > 1:
            modes.pop()
        if ch == "(":
            name = re.match(r"\(\?P?<([A-Za-z]\w*)>", p[i:])
            flags = re.match(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])", p[i:])
            if name:
                out.append(f"(?<{name.group(1)}>")
                modes.append(modes[-1])
                i += name.end()
                continue
            if flags:
                now = (modes[-1] | set(flags.group(1))) - set(flags.group(2) or "")
                on, off = (re.sub("U", "", x or "").replace("i", "iu") for x in flags.group(1, 2))
                out.append("(?" + on + ("-" + off if off else "") + flags.group(3))
                if flags.group(3) == ":":
                    modes.append(now)
                else:
                    modes[-1] = now
                i += flags.end()
                continue
            if p.startswith("(?", i):
                raise ValueError(f"unsupported group in pattern {p!r}")
            modes.append(modes[-1])
        repeat = re.match(r"[*+?]|\{\d+(?:,\d*)?\}", p[i:])
        if repeat:
            i += repeat.end()
            if p[i : i + 1] == "+":
                raise ValueError(f"nested quantifier in pattern {p!r}")
            lazy = p[i : i + 1] == "?"
            i += lazy
            out.append(repeat.group(0) + ("?" if lazy != ("U" in modes[-1]) else ""))
            continue
        out.append(ch)
        i += 1
    spelled = "".join(out)
    try:
        active_session()._jvm.java.util.regex.Pattern.compile(spelled)
    except Exception as e:
        raise ValueError(f"bad pattern {p!r}: {str(e).splitlines()[-1]}") from None
    return spelled


_POSIX = {
    "alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower",
    "space": "Space", "punct": "Punct", "xdigit": "XDigit", "cntrl": "Cntrl", "graph": "Graph",
    "print": "Print", "blank": "Blank",
}


def _groups(p: str) -> int:
    """Capturing groups of a pattern."""
    n, i, in_class = 0, 0, False
    while i < len(p):
        if p[i] == "\\":
            i += 2
            continue
        if in_class:
            in_class = p[i] != "]"
        elif p[i] == "[":
            in_class = True
        elif p[i] == "(" and (p[i + 1 : i + 2] != "?" or re.match(r"\(\?P?<[A-Za-z]", p[i:])):
            n += 1
        i += 1
    return n


def _literal_pattern(p) -> str:
    v = val(p)
    if not isinstance(v.const, str):
        raise TypeError("a pattern has to be literal text")
    return v.const


def regex_match(s, pattern):
    s = text_arg(s, "regex_match")
    return derive(s.col.rlike(java_pattern(_literal_pattern(pattern))), BOOLEAN, s)


def regex_extract(s, pattern):
    """Group 1 when the pattern has one and it took part, else the whole match, else ''."""
    s = text_arg(s, "regex_extract")
    p = _literal_pattern(pattern)
    jp = java_pattern(p)
    groups = _groups(jp)
    if groups == 0:
        return derive(F.regexp_extract(s.col, jp, 0), TEXT, s)
    first = F.regexp_extract(s.col, jp, 1)
    if not re.search(r"\)[?*]|\)\{0|\|", p):  # nothing that could pass group 1 over
        return derive(first, TEXT, s)
    # An empty group inside group 1 matches again only if group 1 took part; a neighbouring character shows it.
    marked, inside = _with_empty_group(jp)
    shown = rf"(?:{marked})(?:\{2 + inside}(?:(?=([\s\S]))|(?<=([\s\S])))|)"
    took = (F.regexp_extract(s.col, shown, groups + 2) != "") | (F.regexp_extract(s.col, shown, groups + 3) != "")
    return derive(F.when((first == "") & ~took, F.regexp_extract(s.col, jp, 0)).otherwise(first), TEXT, s)


def _with_empty_group(jp: str) -> tuple[str, int]:
    """The pattern with ``()`` behind all its first group holds, and how many groups that one holds."""
    i, in_class, depth, inside, start, body = 0, False, 0, 0, None, 0
    while i < len(jp):
        ch = jp[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            depth += 1
            if jp[i + 1 : i + 2] != "?" or re.match(r"\(\?<[A-Za-z]", jp[i:]):
                if start is None:
                    start = depth
                    body = jp.index(">", i) + 1 if jp[i + 1] == "?" else i + 1
                else:
                    inside += 1
        elif ch == ")":
            if start is not None and depth == start:
                return f"{jp[:body]}(?:{jp[body:i]})(){jp[i:]}", inside
            depth -= 1
        i += 1
    raise ValueError(f"no group in {jp!r}")


def java_replacement(r: str, pattern: str) -> str:
    """``$1 ${1} ${name} $$`` in the JVM's spelling."""
    names = {}
    for i, m in enumerate(re.finditer(r"(?<!\\)\((?!\?)|\(\?P?<([A-Za-z]\w*)>", pattern), 1):
        if m.group(1):
            names[m.group(1)] = i

    def one(m):
        tok = m.group(0)
        if tok == "$$":
            return "\\$"
        if tok == "\\":
            return "\\\\"
        if tok == "$":
            return "\\$"
        ref = m.group(1) or m.group(2)
        if ref.isdigit():
            return "$" + ref if int(ref) <= _groups(pattern) else ""
        return "$" + str(names[ref]) if ref in names else ""

    return re.sub(r"\$\$|\$\{(\w+)\}|\$(\d+|[A-Za-z_]\w*)|\$|\\", one, r)


def regex_replace(s, pattern, repl):
    s = text_arg(s, "regex_replace")
    p, r = _literal_pattern(pattern), _literal_pattern(repl)
    return derive(F.regexp_replace(s.col, java_pattern(p), java_replacement(r, p)), TEXT, s)


__all__ = [
    "contains", "ends_with", "left", "len_", "lower", "lpad", "position", "proper", "regex_extract", "regex_match",
    "regex_replace", "right", "rpad", "split_part", "starts_with", "substr", "trim", "unaccent", "upper",
]
