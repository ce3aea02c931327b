"""Zipped delimited text, read in place: one task per archive member."""

from __future__ import annotations

import re
import zipfile
import zlib
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from .columns import clean_positions
from .files import list_files, open_random, spread
from .text import TextSource, _stem, decode_bytes, decode_column, parse_rows, split_line

BLOCK = 1 << 20  # bytes inflated at once


@dataclass(frozen=True)
class ArchiveSource:
    path: str
    entry_pattern: str
    text: TextSource
    dir_mode: str = "basename"  # or keep_path
    suffix: str = ".zip"


def unsafe(name: str) -> bool:
    parts = re.split(r"[/\\]", name)
    return name.startswith(("/", "\\")) or ".." in parts or bool(re.match(r"^[A-Za-z]:", name)) or "\0" in name


MEMBER = "_zip string, _member string, _file string, status string, size long, at long, packed long, method int, crc long"


def members(spark: SparkSession, src: ArchiveSource) -> DataFrame:
    """One row per matching member with its status (ok, unsafe, encrypted or unsupported) and its place in the archive.

    The directory of an archive is read here and nowhere else.
    """
    pattern, keep_path = src.entry_pattern, src.dir_mode == "keep_path"

    def read(batches):
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                with open_random(path) as f, zipfile.ZipFile(f) as z:
                    for m in z.infolist():
                        if m.is_dir() or not m.filename.endswith(pattern):
                            continue
                        status = (
                            "unsafe" if unsafe(m.filename)
                            else "encrypted" if m.flag_bits & 1
                            else "unsupported" if m.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)
                            else "ok"
                        )
                        name = m.filename if keep_path else re.split(r"[/\\]", m.filename)[-1]
                        rows.append((path, m.filename, name, status, m.file_size, m.header_offset, m.compress_size, m.compress_type, m.CRC))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in MEMBER.split(", ")])

    files = spread(list_files(spark, src.path, src.suffix).select("path"), spark)
    return files.mapInPandas(read, MEMBER)


def directory(spark: SparkSession, src: ArchiveSource) -> DataFrame:
    """``members``, written once for all that is done with it."""
    path = scratch_dir(spark, "archive")
    members(spark, src).write.parquet(path)
    return spark.read.schema(MEMBER).parquet(path)


def inflated(f, at: int, packed: int, method: int, crc: int, name: str):
    """The content of a member in pieces, read from its place on; a bad checksum is an error."""
    f.seek(at)
    head = bytes(f.read(30))
    if head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile(f"no member at {at}: {name}")
    f.seek(at + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
    inflate = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None
    seen = 0
    while packed > 0:
        raw = bytes(f.read(min(packed, BLOCK)))
        if not raw:
            raise zipfile.BadZipFile(f"{name} ends early")
        packed -= len(raw)
        while raw:
            piece = inflate.decompress(raw, BLOCK) if inflate else raw
            raw = inflate.unconsumed_tail if inflate else b""
            seen = zlib.crc32(piece, seen)
            if piece:
                yield piece
    if inflate and (piece := inflate.flush()):
        seen = zlib.crc32(piece, seen)
        yield piece
    if seen != crc:
        raise zipfile.BadZipFile(f"bad checksum of {name}")


def check_members(found: DataFrame) -> None:
    """Refuse unsafe names and two members that would share a name."""
    bad = found.groupBy("_file").agg(
        F.count(F.lit(1)).alias("n"), F.max((F.col("status") == "unsafe").cast("int")).alias("u")
    ).filter("n > 1 OR u = 1").limit(5).collect()
    if bad:
        raise ValueError("unsafe or colliding archive members: " + ", ".join(r._file for r in bad))


def member_lines(spark: SparkSession, src: ArchiveSource, found: DataFrame | None = None) -> DataFrame:
    """The lines of every readable member. Tasks inflate blocks that end at a line end; the JVM decodes and splits them."""
    keep = (members(spark, src) if found is None else found).filter("status = 'ok'")

    def read(batches):
        for pdf in batches:
            for path, own in pdf.groupby("_zip", sort=False):
                with open_random(path) as f:
                    for m in own.sort_values("at").itertuples(index=False):
                        line, rest = 1, b""
                        for piece in inflated(f, m.at, m.packed, m.method, m.crc, f"{path}!{m[1]}"):
                            rest += piece
                            cut = rest.rfind(b"\n") + 1
                            if cut >= BLOCK:
                                yield _frame(path, m[1], m[2], rest[:cut], line)
                                line += rest.count(b"\n", 0, cut)
                                rest = rest[cut:]
                        if rest:
                            yield _frame(path, m[1], m[2], rest, line)

    blocks = spread(keep, spark, "_zip", "_member").mapInPandas(read, "_path string, _file string, _first long, raw binary")
    text = decode_column(spark, blocks.withColumn("value", F.col("raw").cast("string")).drop("raw"), "value", src.text.encoding)
    lines = text.select("_path", "_file", "_first", F.posexplode(F.split("value", "\n")).alias("_at", "value"))
    value = F.when(F.col("value").endswith("\r"), F.left("value", F.char_length("value") - 1)).otherwise(F.col("value"))
    return lines.select("_path", "_file", (F.col("_first") + F.col("_at")).alias("_line"), value.alias("value"))


def _frame(path, member, file, body, first):
    if first == 1:
        body = body.removeprefix(b"\xef\xbb\xbf")
    return pd.DataFrame({"_path": [f"{path}!{member}"], "_file": [file], "_first": [first], "raw": [body.removesuffix(b"\n")]})


def member_headers(spark: SparkSession, src: ArchiveSource, found: DataFrame | None = None) -> DataFrame:
    """The header line of every readable member; inflation stops there."""
    t = src.text
    at, delimiter, quote, encoding = t.header_line, t.delimiter, t.quote, t.encoding

    def read(batches):
        for pdf in batches:
            rows = []
            for path, own in pdf.groupby("_zip", sort=False):
                with open_random(path) as f:
                    for m in own.sort_values("at").itertuples(index=False):
                        top = b""
                        for piece in inflated(f, m.at, m.packed, m.method, m.crc, f"{path}!{m[1]}"):
                            top += piece
                            if top.count(b"\n") >= at:
                                break
                        lines = top.split(b"\n")
                        line = lines[at - 1] if len(lines) >= at else b""
                        names = split_line(decode_bytes(line.rstrip(b"\r").removeprefix(b"\xef\xbb\xbf"), encoding), delimiter, quote)
                        rows.append((f"{path}!{m[1]}", [n.strip(" ") for n in names]))
            yield pd.DataFrame(rows, columns=["_path", "_header"])

    keep = (members(spark, src) if found is None else found).filter("status = 'ok'")
    return spread(keep, spark, "_zip", "_member").mapInPandas(read, "_path string, _header array<string>")


def scan(spark: SparkSession, src: ArchiveSource) -> DataFrame:
    """All members of all archives as one table with provenance."""
    found = directory(spark, src)
    check_members(found)
    t = src.text
    heads = member_headers(spark, src, found) if t.header_line > 0 else None
    rows = member_lines(spark, src, found)
    rows = rows.filter((F.col("_line") > t.header_line) & (F.trim("value") != "")).withColumns(
        {
            "_record_num": F.col("_line") - t.header_line,
            "_stem": _stem(F.col("_file"), src.entry_pattern),
            "_sheet": F.lit(""),
        }
    )
    out = parse_rows(spark, rows, heads, replace(t, encoding="utf-8"))
    return clean_positions(out, t.decimal_separator).drop("_line", "_path")
