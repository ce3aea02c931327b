"""Pattern dialect, JSON arrays, staged writers, audit of unwritten variables."""

import json

import pytest
from sluicework import functions as fn
from sluicework.audit.checks import ingest_checks
from sluicework.functions import values as v
from sluicework.functions.text import java_pattern
from sluicework.plans.template import Rule, Template
from sluicework.sinks.writers import write_ordered, write_per_file
from sluicework.sources import json_array, text


def one(spark, value, x):
    return spark.createDataFrame([(value,)], "s string").select(v.text(x).alias("x")).first().x


@pytest.mark.parametrize(
    "s,pattern,want",
    [
        ("café", r"caf\x{E9}", "café"), ("aB", "a(?i)b", "aB"), ("xa.by", r"\Qa.b\E", "a.b"), ("aaa", "(?U)a+", "a"), ("aaa", "(?U)a+?", "aaa"),
        ("a\nb", "(?m)^a$", "a"), ("a\r\nb", "(?m)a.$", "a\r"), ("ab", "(x)?ab", "ab"), ("ab", "(x?)ab", ""), ("ab", "a(|x)b", ""),
        ("", "(x)?", ""), ("b", "(?:(a)|(b))", "b"), ("ba", "(?:b|(a))", "b"), ("k=v", r"(?P<key>\w)=", "k"), ("a\x0bb", r"a\sb", ""), ("a]b", "[]]", "]"),
    ],
)
def test_extract(spark, s, pattern, want):
    assert one(spark, s, fn.regex_extract(fn.field("s"), pattern)) == want


@pytest.mark.parametrize("pattern", [r"(?=a)", r"(?<!a)b", r"(a)\1", r"a++", r"a\Z", r"a\G", "(", "[a", r"\k<x>", "a**"])
def test_refused(spark, pattern):
    with pytest.raises(ValueError):
        java_pattern(pattern)


GOOD = '[{"a": 1.50, "b": "x"}, 5, null, ["y"], {"c": {"d": 1}, "a": 2e3, "b": true}]'


@pytest.mark.parametrize("columns", [None, ("a", "b", "c")])
@pytest.mark.parametrize("numbers", [True, False])
def test_array_files(spark, tmp_path, columns, numbers):
    (tmp_path / "one.json").write_text(GOOD)
    src = json_array.JsonSource(str(tmp_path), columns=columns, record_numbers=numbers)
    rows = json_array.scan(spark, src).select("a", "b", "c").collect()
    assert [tuple(r) for r in rows] == [("1.5", "x", ""), ("2000", "true", "")]
    (tmp_path / "two.json").write_text('[{"a": 1}, {"a"')
    with pytest.raises(Exception, match="two.json"):
        json_array.scan(spark, src).select("a").collect()


@pytest.mark.parametrize("numbers", [True, False])
def test_json_lines_are_loud(spark, tmp_path, numbers):
    (tmp_path / "one.json").write_text('{"a": 1}\n7\n\n{"a": 2}\n')
    src = json_array.JsonSource(str(tmp_path), lines=True, record_numbers=numbers)
    assert sorted(r.a for r in json_array.scan(spark, src).select("a").collect()) == ["1", "2"]
    (tmp_path / "two.json").write_text('{"a": 3\n')
    with pytest.raises(Exception, match="malformed JSON"):
        json_array.scan(spark, src).select("a").collect()


def test_ordered_outputs_convert_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = "_file string, _stem string, _record_num long, _emit_pos int, x string"
    df = spark.createDataFrame([("f.csv", "f", i, 0, str(i)) for i in range(500)], schema).repartition(4).mapInArrow(count, schema)
    write_ordered(df, str(tmp_path / "csv"))
    assert seen.value == 500
    write_ordered(df, str(tmp_path / "json"), None)
    assert seen.value == 1000
    write_per_file(df, str(tmp_path / "files"))
    assert seen.value == 1500
    parts = sorted((tmp_path / "json").glob("part-*"))
    assert [x["x"] for x in json.loads("".join(p.read_text() for p in parts))] == [str(i) for i in range(500)]


def test_unwritten_variables_count(spark):
    df = spark.createDataFrame([("f", "f", "", 1, "x"), ("f", "f", "", 2, "3")], "_file string, _stem string, _sheet string, _record_num long, a string")
    t = Template("t", {"bad": fn.field("a") * 2, "out": fn.field("a")}, {"out": "out"}, [Rule(fn.field("a") != "", [{}])])
    run = t.run(df)
    assert run.counters().first().errors == 1
    assert [(r.variable, r["_record_num"]) for r in run.errors().collect()] == [("bad", 1)]


def test_blank_lines_are_no_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h\n\n  \n\n")
    (tmp_path / "b.csv").write_text("pre\n\nh\n1\n\n2\n")
    got = {r["_file"]: (r.rows, r.zero_rows) for r in ingest_checks(spark, text.TextSource(str(tmp_path), header_line=1)).collect()}
    assert got["a.csv"] == (0, True)
    got = {r["_file"]: r.rows for r in ingest_checks(spark, text.TextSource(str(tmp_path), header_line=3)).collect()}
    assert got["b.csv"] == 2
