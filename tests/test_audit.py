"""One pass over the input for the output and every table of the audit."""

import random

import pytest
from pyspark.sql import functions as F
from sluicework import Lookup, Rule, Template
from sluicework import functions as fn
from sluicework.operators.provenance import with_provenance
from sluicework.sources import text

f = fn.field
TABLES = ["output", "outcomes", "filtered", "unmatched", "errors", "counters", "summary"]


def template(kind):
    variables = {"id": f("id"), "half": f("amount") / 2, "day": fn.dateadd(f("day"), 1), "unused": f("amount") * 3}
    rules = [
        Rule(f("kind") == "two", [{"half": fn.const("1.50")}, {"half": f("id") * 2}]),
        Rule(f("kind") == "skip", []),
        Rule(f("kind") == "one"),
    ]
    lookups, override = {}, {}
    if kind == "lookups":
        lookups = {"names": Lookup(f("id"), {"amount": f("amount")}, f("kind") == "one")}
        variables["seen"] = fn.lookup(f("id"), "amount")
    if kind == "late":
        override = {"day": f("day")}
        rules[0] = Rule(f("kind") == "two", [{"day": f("day")}, {"half": f("id") * 2}])
    output = {"ID": "id", "half": "half", "day": "day", "again": "half"}
    if kind == "none":
        rules = [Rule(f("kind") == "missing")]
    return Template("audit", variables, output, rules, lookups, date_range="day" if kind in ("date", "late") else None)


def source(spark, days=("2024-01-05", "2024-03-01", "soon", ""), n=400):
    rng = random.Random(7)
    rows = [
        (i, rng.choice(["a_2024-01-01_2024-01-20", "b"]), str(rng.choice([i % 9, "x", "01.50"])), rng.choice(["two", "one", "skip", "other", ""]),
         rng.choice(["1.50", "-3", "bad", "", "1e3"]), rng.choice(days))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "n long, stem string, id string, kind string, amount string, day string")
    return with_provenance(df, F.concat("stem", F.lit(".csv")), F.col("n") + 1, F.col("stem")).drop("n", "stem")


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("kind", ["plain", "lookups", "date", "late", "none"])
def test_same_tables_as_separate_runs(spark, kind):
    # under a file-name range every date has to be one
    days = ("2024-01-05", "2024-03-01") if kind in ("date", "late") else ("2024-01-05", "soon", "")
    run = template(kind).run(source(spark, days))
    audit = run.audited()
    for name in TABLES:
        want, got = getattr(run, name)(), getattr(audit, name)()
        assert got.columns == want.columns, name
        assert rows(got) == rows(want), name
    assert rows(audit.output(with_order=True)) == rows(run.output(with_order=True))
    total = run.counters().agg(*[F.sum(n).alias(n) for n in audit.totals]).first().asDict()
    assert audit.totals == total


def test_nothing_to_convert(spark):
    audit = template("plain").run(source(spark).limit(0)).audited()
    assert all(getattr(audit, name)().count() == 0 for name in TABLES)
    assert set(audit.totals.values()) == {0}


def test_input_is_read_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,kind,amount,day\n" + "".join(f"{i},one,{i},2024-01-05\n" for i in range(50)))
    run = template("plain").run(text.scan(spark, text.TextSource(str(tmp_path / "in"), record_numbers=False)))
    audit = run.audited(str(tmp_path / "records"))
    (tmp_path / "in" / "a.csv").unlink()  # every table comes from the records alone
    for name in TABLES:
        df = getattr(audit, name)()
        assert "FileScan csv" not in df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        df.collect()
    assert audit.output().count() == audit.totals["rows_out"] == 50
