"""Templates, lookups, routing, audit and sinks on small tables with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from sluicework import Lookup, Rule, Template
from sluicework import functions as fn
from sluicework.functions.sqlfuncs import register_sql
from sluicework.operators.daterange import range_status
from sluicework.operators.provenance import with_provenance
from sluicework.plans import recipes
from sluicework.sinks.cells import CsvSpec, csv_cell, csv_line
from sluicework.sinks.writers import guard_target, write_csv, write_json_lines, write_ordered, write_per_file
from sluicework.sources import text
from sluicework.streaming.incremental import convert_new

f = fn.field


def source(spark, rows, columns, **kw):
    df = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "n long, " + ", ".join(f"`{c}` string" for c in columns))
    return with_provenance(df, kw.get("file", "a.csv"), F.col("n"), kw.get("stem", "a")).drop("n")


def out(df):
    return sorted(tuple(r) for r in df.collect())


def test_lookup_last_definition_per_value(spark):
    rows = [("d", "k1", "1.50"), ("d", "k1", "bad"), ("d", "", "9"), ("d", "k2", ""), ("p", "k1", ""), ("p", "k2", ""), ("p", "", ""), ("p", "zz", "")]
    t = Template(
        "t", {"k": f("key"), "num": fn.lookup(f("key"), "num"), "raw": fn.lookup(f("key"), "raw")}, {"k": "k", "num": "num", "raw": "raw"},
        [Rule(f("kind") == "p")], {"b": Lookup(f("key"), {"num": f("v") * 2, "raw": f("v")}, f("kind") == "d")},
    )
    run = t.run(source(spark, rows, ["kind", "key", "v"]))
    # a failing expression keeps the older value; an empty text (0 as a number) overwrites
    assert out(run.output()) == [("", "", ""), ("k1", "3", "bad"), ("k2", "0", ""), ("zz", "", "")]
    assert run.lookup_dump().count() == 5


def test_lookup_stays_inside_its_file(spark):
    a = source(spark, [("d", "k", "A"), ("p", "k", "")], ["kind", "key", "v"], file="a.csv")
    b = source(spark, [("p", "k", "")], ["kind", "key", "v"], file="b.csv")
    t = Template("t", {"v": fn.lookup(f("key"), "v"), "file": f("kind")}, {"v": "v"}, [Rule(f("kind") == "p")], {"b": Lookup(f("key"), {"v": f("v")}, f("kind") == "d")})
    assert out(t.run(a.unionByName(b)).output()) == [("",), ("A",)]


def test_hot_key_against_brute_force(spark):
    """A third of all rows share one key."""
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 997).cast("string")).alias("key"),
        F.when(F.col("id") % 5 == 0, F.lit("d")).otherwise(F.lit("p")).alias("kind"), F.col("id").cast("string").alias("v"), (F.col("id") + 1).alias("n"),
    )
    t = Template("t", {"k": f("key"), "v": fn.lookup(f("key"), "v")}, {"k": "k", "v": "v"}, [Rule(f("kind") == "p")], {"b": Lookup(f("key"), {"v": f("v")}, f("kind") == "d")})
    got = {r.k: r.v for r in t.run(with_provenance(df, "f", F.col("n"))).output().distinct().collect()}
    want, last = set(), {}
    for i in range(n):
        key = "hot" if i % 3 == 0 else str(i % 997)
        if i % 5 == 0:
            last[key] = str(i)
        else:
            want.add(key)
    assert got == {k: last.get(k, "") for k in want}


def test_lookup_join_reads_from_shuffles(spark):
    """The join can be split on skew only when both inputs are shuffles."""
    t = Template("t", {"v": fn.lookup(f("key"), "v")}, {"v": "v"}, lookups={"b": Lookup(f("key"), {"v": f("v")})})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = with_provenance(spark.range(10).select(F.col("id").cast("string").alias("key"), F.lit("x").alias("v"), "id"), "f", F.col("id"))
        plan = t.run(df).output()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [ln.strip(" :+-|") for ln in plan.splitlines()]
    joins = [i for i, ln in enumerate(lines) if "SortMergeJoin" in ln]
    assert joins
    sorts = [i for i, ln in enumerate(lines) if i > joins[0] and ln.startswith("Sort [")][:1]
    assert lines[sorts[0] + 1].startswith("Exchange")


def test_rules_and_audit(spark):
    rows = [("buy", "10", "2024-01-02"), ("sell", "x", "2024-01-03"), ("skip", "1", "2024-01-04"), ("odd", "1", "2024-01-05"), ("late", "1", "2025-01-01")]
    t = Template(
        "t", {"kind": f("kind"), "v": f("v") * 2, "date": f("date")}, {"kind": "kind", "v": "v"},
        [Rule(f("v") > 100, [{}]), Rule(fn.in_(f("kind"), "buy", "late"), [{}, {"v": fn.const("fee")}]), Rule(f("kind") == "sell"), Rule(f("kind") == "skip", [])],
        date_range="date",
    )
    run = t.run(source(spark, rows, ["kind", "v", "date"], stem="x_2024-01-01_2024-12-31"))
    assert out(run.output()) == [("buy", "20"), ("buy", "fee"), ("sell", "")]
    assert sorted((r._record_num, r._reason) for r in run.filtered().collect()) == [(3, "rule_skip"), (4, "no_rule_match"), (5, "date_filter_from_filename")]
    assert [(r._record_num, r.variable, r.origin) for r in run.errors().collect()] == [(2, "v", "variable")]
    assert [r.kind for r in run.unmatched().collect()] == ["odd"]
    c = run.counters().collect()[0]
    assert (c.rows_in, c.rows_out, c.no_rule_match, c.rule_skip, c.date_filtered, c.errors) == (5, 3, 1, 1, 1, 1)
    assert json.loads(run.summary().collect()[0].document)["rows_out"] == 3


def test_short_date_under_a_range_stops_the_job(spark):
    t = Template("t", {"date": f("date")}, {"date": "date"}, date_range="date")
    run = t.run(source(spark, [("2024",)], ["date"], stem="2024-01-01_2024-12-31"))
    with pytest.raises(Exception, match="shorter than 10"):
        run.output().collect()


def test_range_status(spark):
    df = spark.createDataFrame([("a_2024-01-01_2024-02-01",), ("a",), ("2024-13-01_2024-02-01",), ("2024-03-01_2024-02-01",)], "s string")
    assert [r[0] for r in df.select(range_status(df.s)).collect()] == ["ok", "missing", "malformed", "malformed"]


def test_names_match_letter_for_letter(spark):
    t = Template("t", {"a": f("Name"), "b": f("name")}, {"a": "a", "b": "b"})
    assert out(t.run(source(spark, [("x",)], ["name"])).output()) == [("", "x")]


def test_bad_templates():
    with pytest.raises(ValueError):
        Template("t", {"a": f("a")}, {"x": "b"})
    with pytest.raises(ValueError):
        Template("t", {"a": f("a")}, {"a": "a", "b": "b"}, [Rule(True, [{"b": fn.const("1")}]), Rule()])
    with pytest.raises(ValueError):
        Template("t", {"a": fn.lookup(f("a"), "v")}, {"a": "a"})


CELLS = [
    ("plain", "plain", "plain"), ("a,b", "a,b", '"a,b"'), ('say "x"', 'say "x"', '"say ""x"""'), ("l1\r\nl2", "l1\\nl2", '"l1\r\nl2"'),
    ("=1+2", "'=1+2", "'=1+2"), ("=1,2", "'=1,2", "\"'=1,2\""), ("\tx", "'\tx", "'\tx"), ("-12.5", "-12.5", "-12.5"), ("-ISM, LLC", "-ISM, LLC", '"-ISM, LLC"'),
    ("-SUM(A1)", "'-SUM(A1)", "'-SUM(A1)"), ("+1 (two)", "+1 (two)", "+1 (two)"), ("-1+cmd|'/c'!A", "'-1+cmd|'/c'!A", "'-1+cmd|'/c'!A"), ("@handle", "@handle", "@handle"), ("", "", ""),
]


def test_cells_and_lines(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CELLS)], "i int, s string")
    got = df.select(csv_cell(df.s, CsvSpec()), csv_cell(df.s, CsvSpec(quote="double")), "i").collect()
    assert [(r[0], r[1]) for r in sorted(got, key=lambda r: r.i)] == [(c[1], c[2]) for c in CELLS]
    for spec in (CsvSpec(), CsvSpec(quote="double"), CsvSpec(delimiter=";", decimal_separator=",")):
        both = df.select(csv_line(["s", "i", "s"], spec).alias("line"), F.concat_ws(spec.delimiter, csv_cell(F.col("s"), spec), csv_cell(F.col("i").cast("string"), spec), csv_cell(F.col("s"), spec)).alias("want"))
        assert both.filter("line <> want").count() == 0


def test_writers(spark, tmp_path):
    rows = [("b", "2"), ("a", "1"), ("c", "3")]
    a = source(spark, rows, ["x", "y"], file="f1.csv", stem="f1")
    b = source(spark, rows[:1], ["x", "y"], file="f0.csv", stem="f0")
    res = recipes.plain("t", {"x": f("x"), "y": f("y")}).run(a.unionByName(b)).output(with_order=True)

    def body(path):
        return "".join(p.read_text() for p in sorted(path.glob("part-*")))

    write_ordered(res, str(tmp_path / "one"))
    assert body(tmp_path / "one") == "x,y\nb,2\nb,2\na,1\nc,3\n"
    write_ordered(res, str(tmp_path / "arr"), None)
    assert json.loads(body(tmp_path / "arr")) == [{"x": "b", "y": "2"}, {"x": "b", "y": "2"}, {"x": "a", "y": "1"}, {"x": "c", "y": "3"}]
    write_per_file(res, str(tmp_path / "per"))
    assert body(tmp_path / "per" / "_stem=f1") == "x,y\nb,2\na,1\nc,3\n"
    write_csv(res, str(tmp_path / "csv"), CsvSpec(encoding="windows-1250"))
    parts = [p.read_text() for p in (tmp_path / "csv").glob("part-*")]
    assert all(p.startswith("x,y\n") for p in parts if p)
    write_json_lines(res, str(tmp_path / "jl"))
    assert len(body(tmp_path / "jl").splitlines()) == 4
    with pytest.raises(ValueError):
        guard_target(str(tmp_path / "one" / "sub"), str(tmp_path / "one"))


def test_incremental(spark, tmp_path):
    src, dst, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    (src / "a.csv").write_text("k,t,v\n1,d,10\n1,p,\n")
    t = Template("t", {"k": f("k"), "v": fn.lookup(f("k"), "v"), "n": fn.record_num()}, {"k": "k", "v": "v", "n": "n"}, [Rule(f("t") == "p")], {"b": Lookup(f("k"), {"v": f("v")}, f("t") == "d")})
    source_ = text.TextSource(str(src))
    assert convert_new(spark, t, source_, dst, ck) == 1
    assert convert_new(spark, t, source_, dst, ck) == 0
    (src / "b.csv").write_text("k,t,v\n1,p,\n")
    assert convert_new(spark, t, source_, dst, ck) == 1
    lines = [r.value for r in spark.read.option("recursiveFileLookup", "true").text(dst).collect()]
    assert sorted(x for x in lines if x != "k,v,n") == ["1,,1", "1,10,2"]


def test_sql_functions(spark):
    names = register_sql(spark)
    assert len(names) > 55
    row = spark.sql(
        "SELECT sw_add('1,000', '2.5') a, sw_if('', 'y', 'n') b, sw_times('1.1', '2.5') c, sw_over('1', '0') d, sw_over('2', '3') e,"
        " sw_canonical('1.500') f, sw_proper('o''brien x') g, sw_workday('2024-01-01', '10') h, sw_iferror(sw_add('x', '1'), 'bad') i"
    ).collect()[0]
    assert tuple(row) == ("1002.5", "n", "2.75", "", "0.666666666667", "1.5", "O'Brien X", "2024-01-15", "bad")
