"""Dates whose tokens have no fixed place: one search per text, and range filters that do not spell it out again."""

import pytest
from sluicework import Rule, Template
from sluicework import functions as fn
from sluicework.operators.provenance import with_provenance

CASES = [
    ("D MMM YYYY, hh:mm:ss", "YYYY-MM-DD hh:mm:ss", {
        "3 Mar 2024, 01:02:03": "2024-03-03 01:02:03", "13 Sept 2024, 23:59:59 and more": "2024-09-13 23:59:59", "31 Feb 2024, 01:02:03": "",
        "3 Mar 2024, 24:00:00": "", "3 Mar 2024": "", "": "", "x3 Mar 2024, 01:02:03": "", "3 mAR 2024, 01:02:03\n4 Apr 2024, 01:02:03": "2024-03-03 01:02:03",
        "3\x01Mar 2024, 01:02:03": "", "\x01\x01\x01\x01\x01\x01": "", "3 Mar 2024, 01:02:03\x01": "2024-03-03 01:02:03",
    }),
    ("M/D/YY h:m A", "YYYYMMDD hhmm", {"1/2/03 4:5 PM": "20030102 0405", "12/31/99 23:59 am": "19991231 2359", "13/1/03 4:5 PM": "", "1-2-03 4:5 PM": ""}),
    ("M/D/YY i:m A", "YYYYMMDD hhmm", {"1/2/03 4:5 PM": "20030102 1605", "1/2/03 12:5 AM": "20030102 0005", "1/2/03 13:5 PM": ""}),
    ("[*]on D MMMM YYYY[*]", "DD.MM.YYYY", {"sent on 5 May 2024, on 6 May 2024": "05.05.2024", "5 May 2024": "", "a\x01\non 5 June 2024": "05.06.2024"}),
    ("D", "DD", {"7": "07", "31x": "31", "x": "", "\x01": "", "7\x01": "07"}),
    ("MMM YYYY", "MM/YYYY", {"Jan 2024": "01/2024", "Sept 2024": "09/2024", "Foo 2024": ""}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_one_search(spark, case):
    fmt, out, texts = CASES[case]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").coalesce(1)
    converted, known = fn.date_convert(fn.field("t"), fmt, out), fn.is_date(fn.field("t"), fmt)
    got = df.select(converted.col.alias("c"), known.col.alias("k")).collect()
    assert [(r.c, r.k) for r in got] == [(w, w != "") for w in texts.values()] + [(None, None)]
    plan = df.select(converted.col.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 0 and plan.count("regexp_replace") <= 2


def test_offset_behind_moving_tokens(spark):
    df = spark.createDataFrame([("3 Mar 2024 01:02 +02:30",), ("3 Mar 2024 01:02 Z",), ("3 Mar 2024 01:02",)], "t string").coalesce(1)
    got = [r[0] for r in df.select(fn.to_utc(fn.field("t"), "D MMM YYYY hh:mm ZZ").col).collect()]
    assert got == ["2024-03-02 22:32:00", "2024-03-03 01:02:00", ""]


@pytest.mark.parametrize("override", [False, True])
def test_range_filter_reads_the_test_once(spark, override):
    f = fn.field
    date = fn.date_convert(f("d"), "D MMM YYYY, hh:mm:ss", "YYYY-MM-DD hh:mm:ss")
    rules = [Rule(f("t") == "b", [{}, {"date": date}] if override else [{}]), Rule(f("t") == "s", []), Rule(f("t") == "o")]
    t = Template("x", {"id": f("id"), "date": date}, {"id": "id", "date": "date"}, rules, date_range="date")
    rows = [(1, "3 Mar 2024, 01:02:03", "b"), (2, "4 Mar 2025, 01:02:03", "b"), (3, "5 Apr 2024, 01:02:03", "s"), (4, "6 Apr 2024, 01:02:03", "o"), (5, "7 Apr 2024, 00:00:00", "?")]
    src = with_provenance(spark.createDataFrame(rows, "id int, d string, t string"), "x.csv", None, "x_2024-01-01_2024-12-31")
    out = t.run(src).output()
    assert sorted(tuple(r) for r in out.collect()) == [("1", "2024-03-03 01:02:03")] * (1 + override) + [("4", "2024-04-06 01:02:03")]
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 60_000 and out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") < 40
