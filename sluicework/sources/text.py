"""Delimited text: any header line, any quote, legacy code pages, exact record numbers."""

from __future__ import annotations

import csv
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import session_conf
from .columns import clean_field, clean_positions, last_positions, name_columns, profile
from .files import glob_for, list_files, open_random, split_bound, spread

MAX_BROADCAST_SPLITS = 400_000  # about 60 MB of paths and offsets
NO_DELIMITER = "\uffff"  # no character
QUOTES = {"double": '"', "single": "'", "none": ""}

# Encodings whose web name differs from the codec's, and those the JVM lacks.
PYTHON_CODEC = {
    "ibm866": "cp866", "ibm437": "cp437", "ibm850": "cp850", "ibm852": "cp852", "macintosh": "mac_roman",
    "x-mac-cyrillic": "mac_cyrillic", "windows-874": "cp874", "iso-8859-8-i": "iso-8859-8",
}
NOT_IN_JVM = {"iso-8859-10", "iso-8859-14", "x-user-defined", "x-mac-cyrillic"}  # the last: another table there
JVM_NAME = {"macintosh": "x-MacRoman", "windows-874": "x-windows-874", "iso-8859-8-i": "ISO-8859-8"}
ENCODINGS = {
    "utf-8", "windows-1250", "windows-1252", "iso-8859-1", "iso-8859-2", "iso-8859-15", "ibm866", "iso-8859-3",
    "iso-8859-4", "iso-8859-5", "iso-8859-6", "iso-8859-7", "iso-8859-8", "iso-8859-8-i", "iso-8859-10",
    "iso-8859-13", "iso-8859-14", "iso-8859-16", "koi8-r", "koi8-u", "macintosh", "windows-874", "windows-1251",
    "windows-1253", "windows-1254", "windows-1255", "windows-1256", "windows-1257", "windows-1258",
    "x-mac-cyrillic", "x-user-defined", "ibm437", "ibm850", "ibm852",
}


@dataclass(frozen=True)
class TextSource:
    path: str
    suffix: str = ".csv"
    delimiter: str = ","
    quote: str = "double"
    header_line: int = 1  # 0: no header, fields by position only
    encoding: str = "utf-8"
    decimal_separator: str = "."
    columns: tuple | None = None  # read only these; None reads all
    record_numbers: bool = True
    width: int | None = None  # fields per row of a headerless source

    def __post_init__(self):
        if self.encoding not in ENCODINGS:
            raise ValueError(f"unknown encoding {self.encoding!r}")
        if len(self.delimiter) != 1 or self.quote not in QUOTES:
            raise ValueError("the delimiter is one character, the quote none, single or double")
        if self.decimal_separator == self.delimiter:
            raise ValueError("decimal separator and delimiter must differ")


def decode_bytes(raw: bytes, encoding: str) -> str:
    """Bytes of a code page as text; an undefined byte becomes U+FFFD."""
    if encoding == "x-user-defined":
        return "".join(chr(b) if b < 0x80 else chr(0xF780 + b - 0x80) for b in raw)
    return raw.decode(PYTHON_CODEC.get(encoding, encoding), errors="replace")


def encode_text(text: str, encoding: str) -> bytes:
    """Text as bytes of a code page; an unmappable character becomes ``?``."""
    if encoding == "x-user-defined":
        return bytes(
            o if o < 0x80 else o - 0xF700 if 0xF780 <= o <= 0xF7FF else 0x3F for o in map(ord, text)
        )
    return text.encode(PYTHON_CODEC.get(encoding, encoding), errors="replace")


def decode_column(spark: SparkSession, df: DataFrame, column: str, encoding: str) -> DataFrame:
    """Replace a column of raw bytes (kept in a string) by its decoded text."""
    if encoding == "utf-8":
        return df
    raw = F.col(column).cast("binary")
    if encoding in NOT_IN_JVM:

        @F.pandas_udf("string")
        def decode(s: pd.Series) -> pd.Series:
            return s.map(lambda b: None if b is None else decode_bytes(bytes(b), encoding))

        return df.withColumn(column, decode(raw))
    with session_conf(
        spark, {"spark.sql.legacy.javaCharsets": "true", "spark.sql.legacy.codingErrorAction": "true"}
    ):
        out = df.withColumn(column, F.decode(raw, JVM_NAME.get(encoding, encoding)))
        out.schema  # the options are read while the plan is analysed
        return out


def split_line(line: str, delimiter: str, quote: str) -> list[str]:
    """One header line as names, with the same lenient quoting as the rows."""
    q = QUOTES[quote]
    if q and q in line:
        return next(csv.reader([line], delimiter=delimiter, quotechar=q), [])
    return line.split(delimiter)


def first_lines(path: str, n: int) -> list[bytes]:
    """The first ``n`` lines of a file, reading no further than needed."""
    with open_random(path) as f:
        buf = b""
        while buf.count(b"\n") < n:
            block = f.read(65536)
            if not block:
                break
            buf += bytes(block)
    return buf.split(b"\n")[:n]


def headers(spark: SparkSession, src: TextSource, files: DataFrame | None = None) -> DataFrame:
    """One row per file with the names in its header line. Only the top of each file is read.

    files: the paths to open (column path) instead of the whole folder.
    """
    at, delimiter, quote, encoding = src.header_line, src.delimiter, src.quote, src.encoding

    def read(batches):
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                lines = first_lines(path, at)
                line = lines[at - 1] if len(lines) >= at else b""
                if at == 1 and line.startswith(b"\xef\xbb\xbf"):
                    line = line[3:]
                text = decode_bytes(line.rstrip(b"\r"), encoding)
                out.append([n.strip(" ") for n in split_line(text, delimiter, quote)])
            yield pd.DataFrame({"_path": pdf["path"], "_header": out})

    files = spread(list_files(spark, src.path, src.suffix).select("path") if files is None else files, spark)
    return files.mapInPandas(read, "_path string, _header array<string>")


def lines(spark: SparkSession, path, suffix: str, record_numbers: bool = True) -> DataFrame:
    """Every line of every file with its place: path, stem and 1-based line number."""
    raw = (
        spark.read.format("text")
        .option("lineSep", "\n")
        .option("pathGlobFilter", glob_for(suffix))
        .load(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("_path"),
            file_name().alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_mid"),
        )
    )
    if record_numbers:
        raw = number_lines(raw, split_bound(spark, path, suffix))
    return strip_lines(raw, suffix, record_numbers)


def strip_lines(raw: DataFrame, suffix: str, numbered: bool) -> DataFrame:
    """Drop the byte-order mark and line-end remains; add the stem."""
    # cut bytes, not characters: the text may still be in a legacy code page
    bom = F.col("value").startswith("\ufeff")
    if numbered:
        bom = bom & (F.col("_line") == 1)
    raw = raw.withColumn("value", F.when(bom, _byte_cut("value", 4, 0)).otherwise(F.col("value")))
    return raw.withColumns(
        {
            "value": F.when(F.col("value").endswith("\r"), _byte_cut("value", 1, 1)).otherwise(F.col("value")),
            "_stem": _stem(F.col("_file"), suffix),
        }
    )


def _byte_cut(name: str, start: int, tail: int) -> Column:
    c = F.col(name)
    return F.substring(c.cast("binary"), F.lit(start), F.octet_length(c) - (start - 1) - tail).cast("string")


def file_name() -> Column:
    """The scanned file's name; Spark reports it percent-encoded."""
    raw = F.col("_metadata.file_name")
    return F.when(raw.contains("%"), F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))).otherwise(raw)


def _stem(name: Column, suffix: str) -> Column:
    return F.left(name, F.length(name) - len(suffix)) if suffix else name


def _bounded(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose row count is known to be small; otherwise leave the choice to Spark."""
    return F.broadcast(table) if rows <= MAX_BROADCAST_SPLITS else table


def number_lines(raw: DataFrame, splits_at_most: int) -> DataFrame:
    """Exact line numbers without moving or sorting the lines.

    One row per file split is enough: how many lines it holds and the id of its
    first line. A running total over the splits of a file turns the ids into line
    numbers. That table is broadcast while its known size allows, so the lines are
    not shuffled; beyond that the join is on the split, no group larger than one.
    """
    splits = raw.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select(
        F.col("_path").alias("_sp"),
        F.col("_block").alias("_sb"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1 - F.col("_first")).alias("_shift"),
    )
    base = _bounded(base, splits_at_most)
    joined = raw.join(base, (raw["_path"] == base["_sp"]) & (raw["_block"] == base["_sb"]))
    return joined.withColumn("_line", F.col("_mid") + F.col("_shift")).drop("_sp", "_sb", "_shift")


def raw_fields(line: Column, delimiter: str, quote: str) -> Column:
    """The fields of a line as they are spelled, quotes included.

    A quote at the start of a field opens it, a doubled one inside stands for itself, and a single
    one closes it; what follows up to the delimiter belongs to the field as it is, further quotes
    included. A quote anywhere else is text, and one that is never closed ends with its line.
    """
    d, q = _regex_literal(delimiter), QUOTES[quote]
    plain = F.split(line, d, -1)
    if not q:
        return plain
    k = _regex_literal(q)
    field = f"{d}((?:{k}[^{k}]*+(?:{k}{k}[^{k}]*+)*+{k}?)?[^{d}]*+)"
    return F.when(line.contains(q), F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(field), F.lit(1))).otherwise(plain)


def unquoted(field: Column, quote: str) -> Column:
    """The value of a field as `raw_fields` gives it."""
    q = QUOTES[quote]
    if not q:
        return field
    k = _regex_literal(q)
    inner = F.substring(field, F.lit(2), F.char_length(field) - 2)
    clean = field.endswith(q) & (F.char_length(field) > 1) & ~inner.contains(q)
    parts = f"(?s)^{k}([^{k}]*+(?:{k}{k}[^{k}]*+)*+){k}?(.*)$"
    other = F.concat(F.replace(F.regexp_extract(field, parts, 1), F.lit(q + q), F.lit(q)), F.regexp_extract(field, parts, 2))
    return F.when(field.startswith(q), F.when(clean, inner).otherwise(other)).otherwise(field)


def split_fields(df: DataFrame, delimiter: str, quote: str) -> DataFrame:
    """Turn ``value`` into the array ``_fields``: every field of every row, whatever the header's width."""
    raw = raw_fields(F.col("value"), delimiter, quote)
    q = QUOTES[quote]
    if q:
        raw = F.when(F.col("value").contains(q), F.transform(raw, lambda x: unquoted(x, quote))).otherwise(raw)
    return df.withColumn("_fields", raw).drop("value")


def _regex_literal(ch: str) -> str:
    return "\\" + ch if not ch.isalnum() and ch not in "\t " else ch


def parse_rows(spark, rows: DataFrame, heads: DataFrame | None, src: TextSource) -> DataFrame:
    """Lines with ``_line`` to named rows with ``_record_num``."""
    rows = decode_column(spark, rows, "value", src.encoding)
    rows = split_fields(rows, src.delimiter, src.quote)
    return rows if heads is None else name_columns(rows, heads, profile(heads), src.columns, src.decimal_separator)


def scan(spark: SparkSession, src: TextSource) -> DataFrame:
    """All matching files as one table of text columns with provenance. Blank lines are no records."""
    heads = headers(spark, src) if src.header_line > 0 else None
    if not src.record_numbers and src.encoding == "utf-8" and src.header_line <= 1:
        seen = profile(heads) if heads is not None else None
        if seen is not None and seen.kinds <= 1 or seen is None and src.width:
            return native_scan(spark, src, seen)
    need = src.record_numbers or src.header_line > 1
    rows = lines(spark, src.path, src.suffix, need)
    if need:
        rows = rows.filter(F.col("_line") > src.header_line).withColumn("_record_num", F.col("_line") - src.header_line)
    elif src.header_line == 1:
        rows = skip_first_line(rows, split_bound(spark, src.path, src.suffix))
    rows = rows.filter(F.trim("value") != "")
    out = clean_positions(parse_rows(spark, rows.withColumn("_sheet", F.lit("")), heads, src), src.decimal_separator)
    if not src.record_numbers:  # where a row stands in its file, without numbering any
        out = out.withColumn("_order", F.struct("_block", "_mid"))
    gone = [c for c in ("_line", "_mid", "_block", "_path") if c in out.columns]
    return out.drop(*gone)


def native_scan(spark: SparkSession, src: TextSource, seen) -> DataFrame:
    """One pass without line numbers: Spark's CSV reader drops the header lines of all files, and
    hands over whole lines, since the delimiter it is given is one that no text holds. The fields
    are cut as everywhere else."""
    raw = (
        spark.read.format("csv")
        .schema("value string, _odd string")
        .options(columnNameOfCorruptRecord="_odd", sep=NO_DELIMITER, quote="", escape="\\", header=str(src.header_line == 1).lower(), enforceSchema="true", mode="PERMISSIVE",
                 multiLine="false", lineSep="\n", maxCharsPerColumn="-1", emptyValue="", nullValue="", pathGlobFilter=glob_for(src.suffix))
        .load(src.path)
    )
    name, line = file_name(), F.coalesce("_odd", "value", F.lit(""))  # _odd: a line that holds the delimiter all the same
    raw = raw.select(
        name.alias("_file"), _stem(name, src.suffix).alias("_stem"), F.lit("").alias("_sheet"),
        F.struct(F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_mid")).alias("_order"),
        F.when(line.endswith("\r"), F.left(line, F.char_length(line) - 1)).otherwise(line).alias("value"),
    ).filter(F.trim("value") != "")
    raw = raw.withColumn("_raw", raw_fields(F.col("value"), src.delimiter, src.quote))
    at = last_positions(seen.sample) if seen else {}
    names = [c for c in (src.columns if src.columns is not None else at) if c in at]
    cell = lambda n: clean_field(unquoted(F.get("_raw", F.lit(at[n])), src.quote), src.decimal_separator).alias(n)
    out = raw.select(
        "_file", "_stem", "_sheet", F.transform("_raw", lambda x: unquoted(x, src.quote)).alias("_fields"), "_order", *[cell(n) for n in names]
    )
    return clean_positions(out, src.decimal_separator)


def skip_first_line(rows: DataFrame, splits_at_most: int) -> DataFrame:
    """Drop line 1 of every file when nobody asked for record numbers.

    The first line of a file is the one with the smallest id in its first split:
    one small aggregate over ids, no numbering of all lines.
    """
    top = rows.filter("_block = 0").groupBy("_path").agg(F.min("_mid").alias("_top"))
    top = top.select(F.col("_path").alias("_tp"), "_top")
    joined = rows.join(_bounded(top, splits_at_most), rows["_path"] == top["_tp"], "left")
    return joined.filter("_top IS NULL OR _mid <> _top").drop("_tp", "_top")
