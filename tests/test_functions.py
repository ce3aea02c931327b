"""Value tests: each case is an expression over one-row data and the text it must give."""

import pytest

from sluicework import functions as fn
from sluicework.functions.values import canonical_text, text

f = fn.field

# input columns of the one-row table
ROW = {
    "empty": "", "blank": " \t", "five": "5", "neg": "-7", "dec": "12.50", "us": "1,234.56", "junk": "abc",
    "nan": "NaN", "big": "99999999999999999999", "name": "o'brien foo-bar über 2nd", "acc": "Łódź Café ß ﬁ Ά",
    "day": "2024-02-29", "ts": "2024-07-15 12:34:56", "iso": "2024-07-15T12:34:56.789Z", "baddate": "2024-02-30",
    "price": "$1,234.56", "price2": "24.00 CZK", "zone": "Europe/Prague", "nozone": "Mars/Base", "path": "a|b||d",
    "two": "2", "zero": "0",
}

CASES = [
    # arithmetic and coercion
    (f("five") + f("us"), "1239.56"),
    (f("empty") + 1, "1"),
    (f("nan") + 1, "1"),
    (f("junk") + 1, None),
    (f("dec") - f("five"), "7.5"),
    (f("dec") * f("dec"), "156.25"),
    (fn.const("1.1") * f("dec"), "13.75"),
    (f("five") / 3, "1.666666666667"),
    (f("two") / f("zero"), ""),
    (f("two") / f("neg"), "-0.285714285714"),
    ((f("two") / f("zero")) + 4, "4"),
    (f("big") * f("dec"), "1249999999999999999987.5"),
    (-f("dec"), "-12.5"),
    (f("big") / f("two"), "49999999999999999999.5"),
    # comparison
    (f("empty") == "0", "true"),
    (f("five") == "5.0", "true"),
    (f("junk") == "abc", "true"),
    (f("junk") != "abd", "true"),
    (f("five") < 6, "true"),
    (f("junk") < 6, None),
    (f("junk") == f("junk"), "true"),
    (f("five") == f("dec"), "false"),
    ((f("five") < 6) & (f("junk") < 6), None),
    ((f("five") < 6) | (f("dec") > 20), "true"),
    (~(f("five") < 6), "false"),
    (fn.concat(f("five"), "-", fn.const(2) * 3), "5-6"),
    # logic
    (fn.if_(f("zero"), "y", "n"), "y"),
    (fn.if_(f("empty"), "y", "n"), "n"),
    (fn.if_(f("five") > 1, 1, f("junk")), "1"),
    (fn.case(f("five"), "4", "four", "5.00", "five", "other"), "five"),
    (fn.case(f("junk"), "4", "four"), ""),
    (fn.iferror(f("junk") * 2, "bad"), "bad"),
    (fn.coalesce(f("blank"), f("empty"), f("five")), "5"),
    (fn.coalesce(f("blank"), ""), ""),
    (fn.nullif(f("five"), "5.0"), ""),
    (fn.in_(f("five"), "4", "5.0"), "true"),
    (fn.in_(f("junk"), "x", "abc"), "true"),
    (fn.in_(f("junk"), "x", ""), "false"),
    (fn.isempty(f("blank")), "true"),
    (fn.is_numeric(f("us")), "true"),
    (fn.is_numeric(f("empty")), "false"),
    (fn.is_numeric(f("nan")), "false"),
    # text
    (fn.left(f("acc"), 2), "Ł"),
    (fn.right(f("ts"), 8), "12:34:56"),
    (fn.right(f("five"), 9), "5"),
    (fn.substr(f("ts"), 6, 2), "07"),
    (fn.substr(f("ts"), 0, 2), ""),
    (fn.len_(f("acc")), "23"),
    (fn.upper(fn.const("straße")), "STRASSE"),
    (fn.proper(f("name")), "O'Brien Foo-Bar Über 2Nd"),
    (fn.unaccent(f("acc")), "Lodz Cafe ss fi Α"),
    (fn.contains(f("ts"), ":34"), "true"),
    (fn.starts_with(f("ts"), ""), "true"),
    (fn.ends_with(f("ts"), "56"), "true"),
    (fn.split_part(f("path"), "|", 4), "d"),
    (fn.split_part(f("path"), "|", 9), ""),
    (fn.split_part(f("path"), "", 1), ""),
    (fn.split_part(f("path"), "|", 0), ""),
    (fn.position("é", f("acc")), "12"),
    (fn.position("zz", f("acc")), "0"),
    (fn.lpad(f("five"), 3, "0"), "005"),
    (fn.lpad(f("ts"), 4, "0"), "2024"),
    (fn.rpad(f("five"), 3, "ab"), "5ab"),
    (fn.lpad(f("five"), 3, ""), "5"),
    (fn.regex_match(f("ts"), r"^\d{4}"), "true"),
    (fn.regex_extract(f("ts"), r"(\d+):(\d+)"), "12"),
    (fn.regex_extract(f("ts"), r"\d+:\d+"), "12:34"),
    (fn.regex_extract(f("five"), r"5(x)?"), "5"),
    (fn.regex_replace(f("ts"), r"(?P<h>\d+):(\d+)", "${2}$$$h"), "2024-07-15 34$12:56"),
    (fn.remap(f("two"), "1", "one", "2", "two"), "two"),
    (fn.remap(f("junk"), {"1": "one"}), "abc"),
    (fn.replace(f("us"), ",", ""), "1234.56"),
    (fn.replace(fn.const("1 234,56"), " ", "", ",", "."), "1234.56"),
    (fn.replace(f("junk"), "ab", "b", "b", "x"), "bc"),
    # numbers
    (fn.abs_(f("neg")), "7"),
    (fn.round_("2.5", 0), "3"),
    (fn.round_("-2.5", 0), "-3"),
    (fn.round_("1250", -2), "1300"),
    (fn.round_(f("us"), f("zero")), "1235"),
    (fn.trunc("-3.999", 2), "-3.99"),
    (fn.trunc("1299.5", -2), "1200"),
    (fn.floor("-1.5"), "-2"),
    (fn.ceiling("-1.5"), "-1"),
    (fn.sign(f("neg")), "-1"),
    (fn.mround("0.075", "0.05"), "0.1"),
    (fn.mround("-7", "2"), "-8"),
    (fn.mround("7", "0"), ""),
    (fn.power("1.1", 2), "1.21"),
    (fn.power(f("two"), f("five")), "32"),
    (fn.power(f("two"), "2.5"), ""),
    (fn.power(f("big"), 3), None),
    (fn.sqrt("2"), "1.414213562373"),
    (fn.sqrt("6.25"), "2.5"),
    (fn.sqrt(f("neg")), ""),
    (fn.mod(f("neg"), "3"), "-1"),
    (fn.mod(f("neg"), "0"), ""),
    (fn.greatest(f("five"), f("dec"), f("neg")), "12.5"),
    (fn.least(f("five"), f("empty")), "0"),
    (fn.least(f("five"), f("junk")), None),
    (fn.price_value(f("price")), "1,234.56"),
    (fn.price_value(f("price2")), "24.00"),
    (fn.price_currency(f("price")), "USD"),
    (fn.price_currency(f("price2")), "CZK"),
    (fn.price_currency(f("five")), ""),
    # dates
    (fn.date_convert("31.12.2024", "DD.MM.YYYY", "YYYY-MM-DD"), "2024-12-31"),
    (fn.date_convert("26 Sept 2022, 16:02:36", "DD MMM YYYY, hh:mm:ss", "YYYY-MM-DD hh:mm:ss"), "2022-09-26 16:02:36"),
    (fn.date_convert("2024-02-23T06:20:20.182Z", "YYYY-MM-DDThh:mm:ss[*]", "DD/MM/YY h:mm A"), "23/02/24 6:20 AM"),
    (fn.date_convert("07/03/69", "D/M/YY", "D MMMM YYYY"), "7 March 2069"),
    (fn.date_convert("2024066", "YYYYDDDD", "YYYY-MM-DD EEE"), "2024-03-06 Wed"),
    (fn.date_convert("12:05:09.120 PM", "ii:mm:ss.SSS A", "hh:mm:ss.FFF"), "12:05:09.12"),
    (fn.date_convert("2024-01-01 00:00:00.000", "YYYY-MM-DD hh:mm:ss.SSS", "ss.FFF"), "00"),
    (fn.date_convert("2021-01-01", "YYYY-MM-DD", "GGGG-[W]WW-e"), "2020-W53-5"),
    (fn.date_convert("2020-W53-5", "GGGG-[W]WW-e", "YYYY-MM-DD"), "2021-01-01"),
    (fn.date_convert(f("junk"), "DD.MM.YYYY", "YYYY"), ""),
    (fn.date_convert("31.02.2024", "DD.MM.YYYY", "YYYY-MM-DD"), ""),
    (fn.is_date(f("day")), "true"),
    (fn.is_date(f("baddate")), "false"),
    (fn.is_date(f("empty")), "false"),
    (fn.is_date("31.12.2024", "DD.MM.YYYY"), "true"),
    (fn.dateadd(f("day"), 1), "2024-03-01"),
    (fn.dateadd(f("empty"), 1), ""),
    (fn.dateadd(f("junk"), 1), None),
    (fn.dateadd(f("day"), "4000000"), ""),
    (fn.datediff("2023-01-01", "2024-01-01"), "-365"),
    (fn.workday("2024-01-01", 10), "2024-01-15"),
    (fn.workday("2024-01-06", 1), "2024-01-08"),
    (fn.workday("2024-01-06", -1), "2024-01-05"),
    (fn.workday("2024-01-06", 0), "2024-01-06"),
    (fn.year(f("iso")), "2024"),
    (fn.month(f("empty")), ""),
    (fn.day(f("baddate")), None),
    (fn.weekday("2024-07-15"), "1"),
    (fn.quarter(f("ts")), "3"),
    (fn.weeknum("2021-01-01"), "53"),
    (fn.weeknum("2024-12-30"), "1"),
    (fn.date_trunc("week", "2025-01-01"), "2024-12-30"),
    (fn.date_trunc("quarter", f("ts")), "2024-07-01"),
    (fn.date_trunc("DAY", f("ts")), "2024-07-15"),
    (fn.hour(f("iso")), "12"),
    (fn.minute(f("day")), "0"),
    (fn.second(f("ts")), "56"),
    (fn.eomonth(f("day")), "2024-02-29"),
    (fn.nth_dow(2024, 3, 7, -1), "2024-03-31"),
    (fn.nth_dow(2024, 10, 1, 2), "2024-10-14"),
    (fn.nth_dow(2024, 2, 1, 5), ""),
    (fn.to_utc("2024-03-15T14:23:01+02:00", "YYYY-MM-DD[T]hh:mm:ssZZ"), "2024-03-15 12:23:01"),
    (fn.to_utc("2024-03-15T14:23:01Z", "YYYY-MM-DD[T]hh:mm:ssZZ"), "2024-03-15 14:23:01"),
    (fn.to_utc(f("junk"), "YYYY-MM-DD[T]hh:mm:ssZZ"), ""),
    (fn.tz_offset(f("ts"), f("zone")), "+02:00"),
    (fn.tz_offset("2024-01-15 12:00:00", "America/New_York"), "-05:00"),
    (fn.tz_offset(f("ts"), f("nozone")), ""),
    (fn.tz_offset(f("junk"), "Europe/Prague"), ""),
    (fn.tz_convert("2024-07-15 12:00:00", "America/New_York", "Europe/Prague"), "2024-07-15 18:00:00"),
    (fn.tz_convert("2024-07-15 12:00:00", "+02:00", "UTC"), "2024-07-15 10:00:00"),
    (fn.tz_convert(f("ts"), f("nozone"), "UTC"), ""),
    (fn.is_dst(f("ts"), f("zone")), "true"),
    (fn.is_dst("2024-01-15", "Europe/Prague"), "false"),
    (fn.is_dst(f("ts"), "Australia/Sydney"), "false"),
]


@pytest.fixture(scope="module")
def results(spark):
    df = spark.createDataFrame([ROW])
    from sluicework.functions.values import register_functions

    register_functions(spark)
    out = {}
    for start in range(0, len(CASES), 25):
        chunk = range(start, min(start + 25, len(CASES)))
        row = df.select(*[text(CASES[i][0]).alias(f"c{i}") for i in chunk]).collect()[0]
        out.update(row.asDict())
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_value(results, i):
    assert results[f"c{i}"] == CASES[i][1]


CANON = {
    "1000.00": "1000", "0.0313646200": "0.03136462", "40.7940823884086": "40.7940823884086", "007.50": "007.50",
    "1.23E+5": "123000", "-0.00": "0", ".0": "0", "BUY": "BUY", "1,234.50": "1,234.50", "12345678901234567890": "12345678901234567890",
    "5.": "5", "1e30": "1e30", "0012": "0012", "0.50": "0.5", "100": "100", "1.5.0": "1.5.0", "": "",
}


def test_canonical(spark):
    df = spark.createDataFrame([(k,) for k in CANON], "s string")
    got = {r.s: r.c for r in df.select("s", canonical_text(df.s).alias("c")).collect()}
    assert got == CANON


def test_template_mistakes_are_loud(spark):
    for bad in (
        lambda: fn.len_(5),
        lambda: fn.regex_match(f("five"), "(?=x)"),
        lambda: fn.regex_match(f("five"), r"(a)\1"),
        lambda: fn.date_trunc("weeks", f("day")),
        lambda: fn.truthy(fn.if_(f("five"), 1, "x")),
        lambda: fn.case(f("five"), "1"),
    ):
        with pytest.raises((TypeError, ValueError)):
            bad()


def test_rand(spark):
    rows = spark.range(200).select(text(fn.rand(12)).alias("r")).collect()
    assert all(len(r.r) == 12 and r.r.isdigit() and r.r[0] != "0" for r in rows)
    assert len({r.r for r in rows}) == 200
