"""One reading of quotes: the same cell whatever the header's width, the reader and the neighbours."""

import csv
import random

import pytest
from sluicework.sources import text


def lines_of(q, n=500):
    rng = random.Random(5)
    out = ["".join(rng.choice([q, q, ",", "a", " ", "b", "é", "\\"]) for _ in range(rng.randint(1, 14))) for _ in range(n)]
    out += [f"a,{q}b {q}x{q} c{q},{q}b {q}x{q} c{q}", f"{q}{'z' * 20_000}{q}{q * 2 * 5000}{q},k", f"{q}open,b", f"{q}{q},{q}{q}{q}{q}", "￿,x￿"]
    return [x for x in out if x.strip(" ")]


@pytest.mark.parametrize("quote,q", [("double", '"'), ("single", "'")])
@pytest.mark.parametrize("width", [1, 2, 5])
@pytest.mark.parametrize("numbers", [True, False])
def test_lines_read_as_by_a_lazy_state_machine(spark, tmp_path, quote, q, width, numbers):
    lines, names = lines_of(q), [f"h{i}" for i in range(width)]
    (tmp_path / "a.csv").write_text(",".join(names) + "\n" + "\n".join(lines) + "\n")
    want = sorted([c.strip(" ") for c in next(csv.reader([x], quotechar=q))] for x in lines)
    df = text.scan(spark, text.TextSource(str(tmp_path), quote=quote, record_numbers=numbers))
    assert sorted(r["_fields"] for r in df.select("_fields").collect()) == want
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(tuple((w + [""] * width)[:width]) for w in want)


def test_headers_are_read_alike(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"b "x" c","a,""b""",plain\n1,2,3\n')
    df = text.scan(spark, text.TextSource(str(tmp_path)))
    assert df.select('`b x" c"`', '`a,"b"`', "plain").first() == ("1", "2", "3")


def test_no_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"x,y"\n')
    for numbers in (True, False):
        df = text.scan(spark, text.TextSource(str(tmp_path), quote="none", record_numbers=numbers))
        assert tuple(df.select("a", "b").first()) == ('"x', 'y"')
