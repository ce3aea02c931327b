"""Output folders: parallel parts, one ordered roll-up, or one folder per input file."""

from __future__ import annotations

import contextlib
import posixpath
from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_folder, scratch_dir
from .cells import CsvSpec, csv_header, csv_line, encode_lines, json_line

ORDER = ["_file", "_record_num", "_emit_pos"]
_ROW_IN_TASK = (1 << 33) - 1


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def guard_target(target: str, source: str | None) -> None:
    """Refuse an output folder that is, holds or lies inside the input folder."""
    if source is None:
        return
    a, b = (posixpath.normpath(urlparse(p).path) for p in (target, source))
    if a == b or a.startswith(b + "/") or b.startswith(a + "/"):
        raise ValueError(f"output {target} and input {source} overlap")


def _lines(df: DataFrame, spec: CsvSpec | None, keep=()) -> DataFrame:
    cols = data_columns(df)
    return df.select(*keep, (json_line(cols) if spec is None else csv_line(cols, spec)).alias("line"))


@contextlib.contextmanager
def staged(df: DataFrame, label: str):
    """The rows written once to the shared folder: sorting, headers and brackets read those, not the conversion again.

    The files go when the output is written.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        drop_folder(spark, path)


def write_csv(df: DataFrame, path: str, spec: CsvSpec = CsvSpec(), source: str | None = None, mode="error") -> None:
    """Parallel part files, each with the header on top. No shuffle, no sort."""
    guard_target(path, source)
    out = _lines(df, spec)
    if spec.header:
        # the low bits of the id count the rows of a task, so bit pattern 0 marks its first row
        first = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_IN_TASK)) == 0
        head = csv_header(data_columns(df), spec)
        both = F.when(first, F.array(head, F.col("line"))).otherwise(F.array(F.col("line")))
        out = out.select(F.explode(both).alias("line"))
    encode_lines(df.sparkSession, out, spec.encoding).write.mode(mode).text(path)


def write_json_lines(df: DataFrame, path: str, source: str | None = None, mode="error") -> None:
    guard_target(path, source)
    _lines(df, None).write.mode(mode).text(path)


def _key(df: DataFrame):
    missing = [c for c in ORDER if c not in df.columns]
    if missing:
        raise ValueError(f"an ordered output needs {missing}; run output(with_order=True)")


def ordered_lines(lines: DataFrame, spec: CsvSpec | None, columns: list[str]) -> DataFrame:
    """Staged lines with sort keys, the header (or the array brackets) included once."""
    lines = lines.withColumn("_part", F.lit(1))
    if spec is None:
        first = lines.agg(F.min(F.struct(*ORDER)).alias("m")).collect()[0].m
        edge = lines.sparkSession.range(1).select(
            F.explode(F.array(F.lit(0), F.lit(2))).alias("_part"), F.lit("").alias("_file"),
            F.lit(0).cast("bigint").alias("_record_num"), F.lit(0).alias("_emit_pos"),
        )
        edge = edge.withColumn("line", F.when(F.col("_part") == 0, F.lit("[")).otherwise(F.lit("]")))
        if first is not None:
            at = [F.col(c) == F.lit(first[c]) for c in ORDER]
            body = F.when(at[0] & at[1] & at[2], F.col("line")).otherwise(F.concat(F.lit(","), F.col("line")))
            lines = lines.withColumn("line", body)
        return lines.unionByName(edge)
    if not spec.header:
        return lines
    head = lines.sparkSession.range(1).select(
        F.lit("").alias("_file"), F.lit(0).cast("bigint").alias("_record_num"), F.lit(0).alias("_emit_pos"),
        csv_header(columns, spec).alias("line"), F.lit(0).alias("_part"),
    )
    return lines.unionByName(head)


def write_ordered(df: DataFrame, path: str, spec: CsvSpec | None = CsvSpec(), source=None, mode="error") -> None:
    """One roll-up of all files: the part files, read in name order, are the single ordered file.

    ``spec=None`` writes one JSON array. Rows are range-partitioned by file and
    record, so no task has to hold more than its share of even one huge file.
    """
    guard_target(path, source)
    _key(df)
    with staged(_lines(df, spec, ORDER), "ordered") as lines:
        out = ordered_lines(lines, spec, data_columns(df)).orderBy("_part", *ORDER).select("line")
        encode_lines(df.sparkSession, out, spec.encoding if spec else "utf-8").write.mode(mode).text(path)


def write_per_file(df: DataFrame, path: str, spec: CsvSpec = CsvSpec(), source=None, mode="error") -> None:
    """One folder per input file (``_stem=<name>``), rows in source order, header first.

    A large input is spread over several range partitions instead of one task.
    """
    guard_target(path, source)
    _key(df)
    with staged(_lines(df, spec, ["_stem", *ORDER]), "per_file") as lines:
        if spec.header:
            heads = lines.select("_stem").distinct().select(
                "_stem", F.lit("").alias("_file"), F.lit(0).cast("bigint").alias("_record_num"),
                F.lit(-1).alias("_emit_pos"), csv_header(data_columns(df), spec).alias("line"),
            )
            lines = lines.unionByName(heads)
        keys = ["_stem", "_record_num", "_emit_pos"]
        out = lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("_stem", "line")
        encode_lines(df.sparkSession, out, spec.encoding).write.mode(mode).partitionBy("_stem").text(path)
