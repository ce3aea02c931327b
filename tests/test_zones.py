"""Daylight-saving flags against the zone database itself."""

import datetime
import random
import zoneinfo

import pytest
from sluicework import functions as fn
from sluicework.functions.zones import changes

UTC = datetime.timezone.utc
ZONES = [
    "Europe/Dublin", "Europe/Prague", "Africa/Casablanca", "Australia/Lord_Howe", "Africa/Windhoek", "America/New_York", "Asia/Kolkata",
    "Europe/Moscow", "America/Sao_Paulo", "Pacific/Apia", "Africa/Cairo", "UTC",
]


def moments(zone, n=60):
    """Random times, and the seconds around every change of the flag."""
    rng = random.Random(zone)
    out = [datetime.datetime(rng.randint(1905, 2130), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59), rng.randint(0, 59)) for _ in range(n)]
    epoch = datetime.datetime(1970, 1, 1)
    for t in rng.sample(changes(zone), min(25, len(changes(zone)))):
        out += [epoch + datetime.timedelta(seconds=t + k) for k in (-1, 0, 1)]
    return [t for t in out if t.year > 1900]


def flag(t, zone):
    return bool(t.replace(tzinfo=UTC).astimezone(zoneinfo.ZoneInfo(zone)).dst())


@pytest.mark.parametrize("zone", ZONES)
def test_literal_zone(spark, zone):
    times = moments(zone)
    df = spark.createDataFrame([(str(t),) for t in times], "t string").coalesce(1)
    got = [r[0] for r in df.select(fn.is_dst(fn.field("t"), zone).col).collect()]
    assert got == [flag(t, zone) for t in times]


def test_zone_of_each_row(spark):
    rows = [(str(t), z) for z in ZONES for t in moments(z, 20)] + [("2024-07-01", "No/Where"), ("never", "Europe/Prague"), (None, "Europe/Prague"), ("2024-07-01", None)]
    df = spark.createDataFrame(rows, "t string, z string").coalesce(1)
    got = [r[0] for r in df.select(fn.is_dst(fn.field("t"), fn.field("z")).col).collect()]
    want = [flag(datetime.datetime.fromisoformat(t), z) for t, z in rows[:-4]] + [False, False, None, None]
    assert got == want


def test_sql_function(spark):
    from sluicework.functions.sqlfuncs import register_sql

    register_sql(spark, ["is_dst"])
    got = spark.sql("SELECT sw_is_dst('2024-01-05 12:00:00', 'Europe/Dublin'), sw_is_dst('2024-07-05', 'Europe/Dublin')").first()
    assert [str(x).lower() for x in got] == ["true", "false"]
