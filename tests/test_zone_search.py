"""The search for a daylight-saving flag reads the time and the zone's place once, not at each step."""

import datetime
import zoneinfo

import pytest
from sluicework import functions as fn
from sluicework.functions.dates import zone_names
from sluicework.functions.sqlfuncs import register_sql

UTC = datetime.timezone.utc
TIMES = [datetime.datetime(2024, 1, 15, 12), datetime.datetime(2024, 7, 15, 12), datetime.datetime(1943, 7, 1)]


def steps(df):
    """What is evaluated at each step of the search."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1
    return plan.split("\n+- ")[0][plan.index("lambdafunction(") :].lower()


@pytest.mark.parametrize("zone", ["Europe/Prague", None])
def test_steps_read_no_text_and_no_zone(spark, zone):
    df = spark.createDataFrame([("2024-07-01", "Europe/Prague")], "t string, z string").coalesce(1)
    out = df.select(fn.is_dst(fn.field("t"), zone or fn.field("z")).col.alias("v"))
    assert out.first().v is True
    for reading in ("rlike", "try_cast", "z#", "t#", "crc32", "keys: ["):
        assert reading not in steps(out)


def test_every_zone_by_name(spark):
    rows = [(str(t), z) for z in sorted(zone_names()) for t in TIMES]
    df = spark.createDataFrame(rows, "t string, z string").coalesce(1)
    want = [bool(datetime.datetime.fromisoformat(t).replace(tzinfo=UTC).astimezone(zoneinfo.ZoneInfo(z)).dst()) for t, z in rows]
    assert [r.v for r in df.select(fn.is_dst(fn.field("t"), fn.field("z")).col.alias("v")).collect()] == want
    register_sql(spark, ["is_dst"])
    df.createOrReplaceTempView("zone_search")
    got = [r.v for r in spark.sql("SELECT sw_is_dst(t, z) AS v FROM zone_search UNION ALL SELECT sw_is_dst('2024-07-01', 'No/Where')").collect()]
    assert [str(v).lower() for v in got] == [str(v).lower() for v in want] + ["false"]
