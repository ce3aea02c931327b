"""Provenance columns every source row carries, and the shape jobs expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROVENANCE = ["_file", "_stem", "_sheet", "_record_num"]


def with_provenance(df: DataFrame, file="", record_num: Column | None = None, stem=None, sheet="") -> DataFrame:
    """Add provenance to a table that did not come from a file scan.

    ``record_num`` has to order the rows of one file; it decides which row is
    the last one in keyed lookups.
    """
    file = file if isinstance(file, Column) else F.lit(file)
    stem = file if stem is None else stem if isinstance(stem, Column) else F.lit(stem)
    return df.withColumns(
        {
            "_file": file,
            "_stem": stem,
            "_sheet": F.lit(sheet),
            "_record_num": (record_num if record_num is not None else F.lit(None)).cast("bigint"),
        }
    )


def as_text(df: DataFrame, name: str) -> Column:
    """A source column as trimmed text, never NULL; '' when the source lacks it."""
    for f in df.schema.fields:
        if f.name == name:
            c = F.col(f"`{name}`")
            if f.dataType.typeName() in ("struct", "array", "map", "variant"):
                return F.lit("")
            if f.dataType.typeName() != "string":
                c = c.cast("string")
            return F.coalesce(F.trim(c), F.lit(""))
    return F.lit("")


def prepare(df: DataFrame, names) -> DataFrame:
    """Provenance plus exactly the fields a job reads, as text."""
    have = set(df.columns)
    keep = []
    for c in PROVENANCE:
        default = F.lit(None).cast("bigint") if c == "_record_num" else F.lit("")
        keep.append(F.col(c) if c in have else default.alias(c))
    keep += [F.col(c) for c in ("_fields", "_order") if c in have]
    return df.select(*keep, *[as_text(df, n).alias(n) for n in sorted(names)])
