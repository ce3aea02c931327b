"""File-level checks over the text scan and the headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.daterange import range_status
from ..sources.text import QUOTES, TextSource, headers, lines

#: Headers with more columns are reported; their columns are read all the same.
WIDE_HEADER = 16_384


def ingest_checks(spark: SparkSession, src: TextSource) -> DataFrame:
    """Per file: data rows, ill-formed bytes, unbalanced quotes, header faults, date-range state.

    One pass over the lines with counters only; every byte is looked at.
    """
    numbered = src.header_line > 1
    rows = lines(spark, src.path, src.suffix, record_numbers=numbered)
    data = F.trim("value") != ""  # blank lines are no records
    q = QUOTES[src.quote]
    count = F.length("value") - F.length(F.replace("value", F.lit(q), F.lit(""))) if q else F.lit(0)
    invalid = ~F.is_valid_utf8("value") if src.encoding == "utf-8" else F.lit(False)
    per_file = rows.groupBy("_path", "_file", "_stem").agg(
        (F.count_if(data & (F.col("_line") > src.header_line)) if numbered else F.count_if(data) - src.header_line).alias("rows"),
        F.count_if(invalid).alias("invalid_utf8"),
        F.count_if(count % 2 == 1).alias("unbalanced_quotes"),
    )
    out = per_file.withColumns(
        {"zero_rows": F.col("rows") <= 0, "date_range": range_status(F.col("_stem"))}
    )
    if src.header_line == 0:
        return out.drop("_path", "_stem")
    heads = headers(spark, src).select(
        F.col("_path").alias("_hp"),
        duplicates("_header").alias("duplicate_headers"),
        (F.size("_header") > WIDE_HEADER).alias("too_many_columns"),
    )
    return out.join(heads, out["_path"] == heads["_hp"], "left").drop("_path", "_hp", "_stem")


def duplicates(header: str):
    """Names a header holds more than once, blanks aside."""
    names = F.array_distinct(F.filter(F.col(header), lambda h: h != ""))
    return F.array_sort(
        F.filter(names, lambda n: F.size(F.filter(F.col(header), lambda h: h == n)) > 1)
    )


def header_drift(heads: DataFrame, expected: list[str]) -> DataFrame:
    """Expected names a file lacks although a near spelling of them is there.

    ``heads`` has ``_path`` and ``_header``. One edit is near for names shorter
    than six characters, two for longer ones; case does not count.
    """
    rows = heads.select("_path", "_header", F.explode(F.array(*[F.lit(e) for e in expected])).alias("expected"))
    limit = F.when(F.length("expected") < 6, F.lit(1)).otherwise(F.lit(2))
    near = F.filter(
        "_header", lambda h: (h != "") & (F.levenshtein(F.lower(h), F.lower(F.col("expected"))) <= limit)
    )
    missing = rows.filter(~F.array_contains("_header", F.col("expected"))).withColumn("near", near)
    return missing.filter(F.size("near") > 0).select("_path", "expected", F.explode("near").alias("found"))
