"""When daylight saving is in force, by the flags of the zone database, as sorted instants for the JVM to search."""

from __future__ import annotations

import datetime
import json
import os
import struct
import zlib
import zoneinfo
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The rule that ends a zone's table is followed up to this year; it changes the flag at most once a week.
LAST_YEAR, STEP = 2137, datetime.timedelta(days=7)
_UTC, _ONE = datetime.timezone.utc, datetime.timedelta(seconds=1)


def _file(zone: str) -> bytes:
    for folder in zoneinfo.TZPATH:
        path = os.path.join(folder, zone)
        if os.path.isfile(path):
            with open(path, "rb") as f:
                return f.read()
    from importlib import resources

    return resources.files("tzdata.zoneinfo").joinpath(*zone.split("/")).read_bytes()


def _table(raw: bytes) -> list[tuple[int, bool]]:
    """(instant, flag) of the explicit transitions of a zone file; its second part has 64-bit instants."""

    def counts(at):
        return struct.unpack(">6l", raw[at + 20 : at + 44])

    utc, std, leap, times, types, chars = counts(0)
    at, size = 44, 4
    if raw[4:5] >= b"2":
        at += times * 5 + types * 6 + chars + leap * 8 + std + utc + 44
        _, _, _, times, types, _ = counts(at - 44)
        size = 8
    instants = struct.unpack(f">{times}{'q' if size == 8 else 'l'}", raw[at : at + size * times])
    kinds = raw[at + size * times : at + (size + 1) * times]
    flags = [raw[at + (size + 1) * times + 6 * i + 4] != 0 for i in range(types)]
    return [(t, flags[k]) for t, k in zip(instants, kinds, strict=True)]


@lru_cache(maxsize=None)
def _changes(raw: bytes, zone: str) -> tuple[int, ...]:
    steps, zi = _table(raw), zoneinfo.ZoneInfo(zone)

    def flag(when):
        return bool(when.astimezone(zi).dst())

    last = steps[-1][0] if steps else -(2**40)
    here = max(datetime.datetime(1900, 1, 1, tzinfo=_UTC), datetime.datetime(1970, 1, 1, tzinfo=_UTC) + datetime.timedelta(seconds=max(last, -(2**32))))
    state = steps[-1][1] if steps else False
    while here.year < LAST_YEAR:
        ahead = here + STEP
        if flag(ahead) != state:
            low, high = here, ahead
            while high - low > _ONE:
                middle = (low + (high - low) / 2).replace(microsecond=0)
                low, high = (low, middle) if flag(middle) != state else (middle, high)
            state = not state
            steps.append((int(high.timestamp()), state))
        here = ahead
    out, state = [], False
    for t, now in steps:
        if now != state:
            out.append(t)
            state = now
    return tuple(out)


def changes(zone: str) -> tuple[int, ...]:
    """Seconds since 1970 at which daylight saving begins and ends, by turns, from the first begin on."""
    return _changes(_file(zone), zone)


#: Steps of a binary search over up to 1023 moments.
STEPS = [1 << k for k in range(9, -1, -1)]
#: Zone names are dealt over so many small tables.
BUCKETS = 4096


def in_force(seconds: Column, moments: Callable[[Column], Column], place: Column) -> Column:
    """Whether an odd number of the sorted moments at a place has come; an unknown time or place has none.

    The search reads time and place once: it carries them along, but never the moments, which would be copied at each step.
    """
    steps = F.array(*[F.lit(s) for s in STEPS])
    start = F.struct(F.lit(0).alias("n"), seconds.alias("seconds"), place.alias("place"))

    def step(a, s):
        passed = F.get(moments(a.place), a.n + s - 1) <= a.seconds
        return F.struct(F.when(passed, a.n + s).otherwise(a.n).alias("n"), a.seconds.alias("seconds"), a.place.alias("place"))

    return F.aggregate(steps, start, step, lambda a: a.n % 2 == 1)


def seconds_of(ts: Column) -> Column:
    """Seconds since 1970 of a local time read as if it were UTC."""
    return F.datediff(ts.cast("date"), F.lit("1970-01-01")).cast("bigint") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))


@lru_cache(maxsize=1)
def _every(names: tuple[str, ...]) -> tuple[str, str]:
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for i, z in enumerate(names):
        buckets[zlib.crc32(z.encode()) % BUCKETS][z] = i
    return json.dumps(buckets), json.dumps([changes(z) for z in names])


def every_zone(names: list[str]) -> tuple[str, str]:
    """The places of all zones, as a JSON array of small tables by name, and the changes at each place."""
    return _every(tuple(names))


def daylight(ts: Column, zone: Column, name: str | None, names: list[str]) -> Column:
    """The flag at a local time; name: the zone where it is one literal, names: all there may be."""
    if name is not None:
        every = F.from_json(F.lit(json.dumps([changes(name)])), "array<array<bigint>>")
        return in_force(seconds_of(ts), lambda place: F.get(every, place), F.lit(0))
    places, moments = every_zone(names)
    tables, every = F.from_json(F.lit(places), "array<map<string,int>>"), F.from_json(F.lit(moments), "array<array<bigint>>")
    place = F.try_element_at(F.get(tables, F.crc32(zone.cast("binary")) % BUCKETS), zone)
    return in_force(seconds_of(ts), lambda at: F.get(every, at), place)
