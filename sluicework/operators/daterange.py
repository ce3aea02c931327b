"""Keep the rows whose date lies in the range their file name announces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = r"([0-9]{4}-[0-9]{2}-[0-9]{2})_([0-9]{4}-[0-9]{2}-[0-9]{2})"


def bounds(stem: Column) -> tuple[Column, Column]:
    """First and last day of the range in a name; NULL when there is none or it is malformed."""
    lo, hi = F.regexp_extract(stem, RANGE, 1), F.regexp_extract(stem, RANGE, 2)
    live = lo.try_cast("date").isNotNull() & hi.try_cast("date").isNotNull() & (lo <= hi)
    return F.when(live, lo), F.when(live, hi)


def range_status(stem: Column) -> Column:
    lo, _ = bounds(stem)
    return F.when(lo.isNotNull(), F.lit("ok")).when(stem.rlike(RANGE), F.lit("malformed")).otherwise(F.lit("missing"))


def in_range(date: Column, stem: Column) -> Column:
    """Inclusive test on the first ten characters. A live range with a shorter date stops the job."""
    lo, hi = bounds(stem)
    day = F.substring(date, 1, 10)
    short = F.raise_error(F.concat(F.lit("date shorter than 10 characters under a file-name range: "), date)).cast("boolean")
    return F.when(lo.isNull(), F.lit(True)).when(F.octet_length(date) < 10, short).otherwise((day >= lo) & (day <= hi))
