"""Wide rows and wide numbers: nothing is cut by a header's width, a quote, a flag or the size of an operand."""

import random
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest
from sluicework import functions as fn
from sluicework.functions import values as v
from sluicework.sources import text
from sluicework.sources.columns import last_positions
from sluicework.sources.workbook import number_text

RAGGED = 'a,b\n1,2,3\n"x",2,3\n" p , q ", r ,"s ""t""",\n"open,2,3\nlast\r\n,"",,\n"one"\r\n'
FIELDS = [["1", "2", "3"], ["x", "2", "3"], ["p , q", "r", 's "t"', ""], None, ["last"], ["", "", "", ""], ["one"]]


@pytest.mark.parametrize("numbers", [True, False])
@pytest.mark.parametrize("header", [1, 0])
def test_ragged_rows_keep_every_field(spark, tmp_path, numbers, header):
    (tmp_path / "f.csv").write_text(RAGGED)
    src = text.TextSource(str(tmp_path), header_line=header, record_numbers=numbers)
    got = [r["_fields"] for r in text.scan(spark, src).select("_fields").collect()]
    got = got if header else got[1:]
    trimmed = [[x for x in row] for row in got]
    for row, want in zip(trimmed, FIELDS, strict=True):
        if want is not None:
            assert row[: len(want)] == want and not any(row[len(want) :])


def test_header_of_any_width():
    assert last_positions([f"c{i}" for i in range(17_000)])["c16999"] == 16_999


def test_arithmetic_over_the_whole_range(spark):
    rng = random.Random(1)

    def one():
        d = rng.choice([0, 2, 6, 7, 12])
        x = Decimal(rng.randint(0, 10 ** (rng.randint(0, 25) + d))).scaleb(-d)
        return x if rng.random() < 0.8 else -x

    with localcontext() as c:
        c.prec = 120
        rows = [(one(), one()) for _ in range(300)] + [(Decimal(10) ** 25, Decimal("3.1234567")), (Decimal("3e14"), Decimal("3.1234567")), (Decimal(10) ** 25, Decimal(10) ** 25)]
        df = spark.createDataFrame([(str(a), str(b)) for a, b in rows], "a string, b string").coalesce(1)
        a, b = fn.field("a"), fn.field("b")
        got = df.select(v.num(v.mul(a, b)), v.text(v.div(a, b)), v.num(v.mul(a, "0.123456789012")), v.num(v.div(a, "3.1234567")), v.num(v.neg(a))).collect()

        def exact(x):
            x = x.quantize(Decimal("1e-12"), rounding=ROUND_HALF_UP)
            return x if abs(x) < Decimal(10) ** 26 else None

        for (x, y), row in zip(rows, got, strict=True):
            assert row[0] == exact(x * y)
            if y:
                assert (None if row[1] is None else Decimal(row[1])) == exact(x / y)
            assert row[2] == exact(x * Decimal("0.123456789012"))
            assert row[3] == exact(x / Decimal("3.1234567"))
            assert row[4] == -x


def test_quotients_of_wide_operands(spark):
    """Divisors of up to 19 whole digits with twelve decimals, and dividends over the whole range."""
    rng = random.Random(8)

    def number(digits):
        n = rng.randint(0, digits)
        x = Decimal(rng.randint(0, 10**n - 1)) + Decimal(rng.randint(0, 10**12 - 1)).scaleb(-12) * rng.choice([0, 1])
        return x * rng.choice([1, -1])

    rows = [(number(26), number(19)) for _ in range(1500)]
    rows += [(Decimal("9" * 26 + "." + "9" * 12), Decimal(d)) for d in ("1", "-3", "0", "0.000000000001", "1000000000000000009")]
    df = spark.createDataFrame([(i, str(a), str(b)) for i, (a, b) in enumerate(rows)], "i int, a string, b string").coalesce(1)
    got = [r[1] for r in sorted(df.select("i", v.num(v.div(fn.field("a"), fn.field("b")))).collect())]
    with localcontext() as c:
        c.prec = 120
        for (x, y), q in zip(rows, got, strict=True):
            want = (x / y).quantize(Decimal("1e-12"), rounding=ROUND_HALF_UP) if y else Decimal(0)  # '' reads as 0
            assert q == (want if abs(want) < Decimal(10) ** 26 else None), (x, y)


def test_arguments_are_bound_once(spark):
    """The spelling of a text stands in the plan once for each time a formula asks for its number, not for each step of reading it."""
    a, b = fn.upper(fn.field("a")), fn.upper(fn.field("b"))
    plan = spark.createDataFrame([("1", "2")], "a string, b string").select(v.text(v.div(a, b)).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert 2 <= plan.count("upper(") <= 5


def test_literals_take_one_path():
    assert v.parse_number("0." + "3" * 60) == Decimal("0.333333333333")
    assert v.parse_number("1e30") is None and v.parse_number("99999999999999999999999999.9999999999999") is None


@pytest.mark.parametrize("raw,want", [("1.5E+20", "150000000000000000000"), ("1E+16", "10000000000000000"), ("1.5E+3", "1500"), ("2.50", "2.5"), ("1E-3", "0.001")])
def test_stored_numbers(raw, want):
    assert number_text(raw) == want
