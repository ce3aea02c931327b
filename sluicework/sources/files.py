"""Opening files inside tasks, and listing them without reading them."""

from __future__ import annotations

import re
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def glob_for(suffix: str) -> str:
    """A file-name glob that matches exactly this suffix."""
    return "*" + re.sub(r"([\[\]{}*?\\])", r"\\\1", suffix)


def open_random(path: str):
    """A seekable binary handle on a local, HDFS or object-store file."""
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(re.sub(r"^file:/*", "/", path)))
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def list_files(spark: SparkSession, path, suffix: str) -> DataFrame:
    """Path, name and size of every matching file of one flat folder; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob_for(suffix))
        .option("recursiveFileLookup", "false")
        .load(path)
    )
    return files.select(F.col("_metadata.file_path").alias("path"), "length")


def split_bound(spark: SparkSession, path, suffix: str) -> int:
    """An upper bound of the splits a scan makes, from file sizes alone."""
    size = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")))
    r = list_files(spark, path, suffix).agg(F.count(F.lit(1)).alias("n"), F.sum(F.ceil(F.col("length") / size)).alias("s"))
    row = r.collect()[0]
    cores = spark.sparkContext.defaultParallelism
    return int((row.s or 0) + row.n + 4 * cores)


def spread(files: DataFrame, spark: SparkSession, *keys: str) -> DataFrame:
    """Give independent files independent tasks; a local session needs no more than its cores can take."""
    n = 2 * spark.sparkContext.defaultParallelism
    if not spark.sparkContext.master.startswith("local"):
        n = max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(n, *keys)
