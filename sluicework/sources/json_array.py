"""JSON arrays of objects (or JSON lines) as text columns."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.values import canonical_text
from .files import glob_for, list_files, open_random, split_bound, spread
from .text import _stem, file_name, number_lines

NESTED = ("struct", "array", "map")
BATCH = 10_000  # items sent at once


@dataclass(frozen=True)
class JsonSource:
    path: str
    suffix: str = ".json"
    columns: tuple | None = None  # known keys; None looks at the data first
    lines: bool = False  # one object per line: splittable, better for large inputs
    record_numbers: bool = True


def _read_as(f: StructField):
    return f.dataType if f.dataType.typeName() in NESTED else StringType()


def scan(spark: SparkSession, src: JsonSource) -> DataFrame:
    """Columns are the union of keys; absent and null read '', nested values read ''.

    Items that are no objects are skipped. A file (or line) that is no JSON
    stops the job with an error that names it, whatever columns or record
    numbers are asked for.
    """
    return scan_lines(spark, src) if src.lines else scan_files(spark, src)


def _shown(value) -> str:
    """Kind and text of a value: n for numbers, whose spelling is looked at later, t for all others."""
    if isinstance(value, _Number):
        return "n" + value
    if value is True or value is False:
        return "ttrue" if value else "tfalse"
    return "t" + value if isinstance(value, str) else "t"


class _Number(str):
    """A number as it stands in the file."""


def objects(path: str) -> list[dict]:
    """The objects of an array file (or the one object a file holds), with numbers as they are spelled."""
    with open_random(path) as f:
        body = bytes(f.read())
    try:
        found = json.loads(body.decode("utf-8-sig"), parse_int=_Number, parse_float=_Number, parse_constant=_Number)
    except ValueError as e:
        raise ValueError(f"malformed JSON in {path}: {e}") from None
    return [x for x in (found if isinstance(found, list) else [found]) if isinstance(x, dict)]


def scan_files(spark: SparkSession, src: JsonSource) -> DataFrame:
    """Array files: one task reads a file, as it has to be parsed from its start."""

    def read(batches):
        for pdf in batches:
            for path in pdf["path"]:
                items = objects(path)
                for i in range(0, len(items), BATCH):
                    part = [{k: _shown(v) for k, v in x.items()} for x in items[i : i + BATCH]]
                    yield pd.DataFrame({"_path": path, "_record_num": range(i + 1, i + 1 + len(part)), "_item": part})

    files = spread(list_files(spark, src.path, src.suffix).select("path"), spark)
    rows = files.mapInPandas(read, "_path string, _record_num long, _item map<string,string>")
    columns = src.columns
    if columns is None:
        keys = rows.select("_path", "_record_num", F.posexplode(F.map_keys("_item")).alias("at", "k"))
        seen = keys.groupBy("k").agg(F.min(F.struct("_path", "_record_num", "at")).alias("first")).orderBy("first").collect()
        columns = [r.k for r in seen]
    name = F.element_at(F.split("_path", "/"), -1)
    name = F.when(name.contains("%"), F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).otherwise(name)
    item = [F.try_element_at("_item", F.lit(c)) for c in columns]
    body = [F.substring(x, F.lit(2), F.char_length(x)) for x in item]
    out = [F.coalesce(F.when(x.startswith("n"), canonical_text(b)).otherwise(b), F.lit("")).alias(c) for c, x, b in zip(columns, item, body)]
    keep = ["_file"] + (["_record_num"] if src.record_numbers else [])
    return rows.withColumn("_file", name).select(*keep, _stem(F.col("_file"), src.suffix).alias("_stem"), F.lit("").alias("_sheet"), *out)


def scan_lines(spark: SparkSession, src: JsonSource) -> DataFrame:
    """One object per line: Spark's reader, split over tasks."""
    reader = (
        spark.read.format("json")
        .option("pathGlobFilter", glob_for(src.suffix))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
    )
    if src.columns is not None:
        seen = StructType([StructField(c, StringType()) for c in src.columns])
    else:
        seen = StructType([f for f in reader.load(src.path).schema.fields if f.name != "_corrupt_record"])
    # read every plain value as the very text it has in the file
    fields = [StructField(f.name, _read_as(f)) for f in seen.fields] + [StructField("_corrupt_record", StringType())]
    raw = reader.schema(StructType(fields)).load(src.path)
    bad = F.col("_corrupt_record")
    path = F.col("_metadata.file_path")
    # A line that is some other JSON value is no item; one that looks like an object is broken.
    # A data column has to be read beside the raw line, or Spark refuses the scan; so the message looks at one.
    held = F.when(F.col(f"`{seen.names[0]}`").isNull(), F.lit("")).otherwise(F.lit(" (in part)")) if seen.names else F.lit("")
    broken = F.raise_error(F.concat(F.lit("malformed JSON in "), path, held, F.lit(": "), F.left(bad, F.lit(80)))).cast("boolean")
    raw = raw.withColumn("_ok", F.when(bad.isNull(), F.lit(True)).when(bad.rlike(r"^\s*\{"), broken).otherwise(F.lit(False)))
    provenance = [
        path.alias("_path"),
        file_name().alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
    ]
    names = seen.names
    rows = raw.select("_ok", *[F.col(f"`{c}`") for c in names], *provenance).filter("_ok").drop("_ok")
    if src.record_numbers:
        bound = split_bound(spark, src.path, src.suffix)
        rows = number_lines(rows, bound).withColumnRenamed("_line", "_record_num")
    kinds = {f.name: f.dataType.typeName() for f in seen.fields}
    out = []
    for c in names:
        col = F.col(f"`{c}`")
        if kinds[c] in NESTED:
            out.append(F.lit("").alias(c))
        elif kinds[c] == "string":
            nested = col.rlike(r"^\s*[\[{]") if src.columns is not None else F.lit(False)
            out.append(F.when(nested, F.lit("")).otherwise(F.coalesce(col, F.lit(""))).alias(c))
        else:
            out.append(canonical_text(F.coalesce(col, F.lit(""))).alias(c))
    keep = ["_file"] + (["_record_num"] if src.record_numbers else [])
    return rows.select(
        *keep, _stem(F.col("_file"), src.suffix).alias("_stem"), F.lit("").alias("_sheet"), *out
    )
