"""Convert only the inputs that were not converted before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.template import Template
from ..sinks.cells import CsvSpec
from ..sinks.writers import write_per_file
from ..sources.files import glob_for, list_files, split_bound
from ..sources.text import TextSource, _stem, file_name, headers, number_lines, parse_rows, strip_lines


def pending(spark: SparkSession, src: TextSource, done: DataFrame) -> DataFrame:
    """Input files whose stem is not among the finished ones (column ``_stem``)."""
    files = list_files(spark, src.path, src.suffix)
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    return files.withColumn("_stem", _stem(name, src.suffix)).join(done.select("_stem").distinct(), "_stem", "left_anti")


def convert_new(
    spark: SparkSession, template: Template, src: TextSource, out: str, checkpoint: str, spec: CsvSpec = CsvSpec(),
    max_files: int | None = None,
) -> int:
    """Run the template over files that arrived since the last call; returns the batches written.

    The file source never splits a file over two batches, so lookups and record
    numbers stay right. A batch that is retried overwrites its own folder.
    """
    reader = spark.readStream.format("text").option("lineSep", "\n").option("pathGlobFilter", glob_for(src.suffix))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    raw = reader.load(src.path).select(
        "value",
        F.col("_metadata.file_path").alias("_path"),
        file_name().alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    written = []

    def one(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        numbered = batch.withColumn("_mid", F.monotonically_increasing_id())
        rows = number_lines(numbered, split_bound(session, src.path, src.suffix))
        rows = strip_lines(rows, src.suffix, True)
        rows = rows.filter((F.col("_line") > src.header_line) & (F.trim("value") != "")).withColumns(
            {"_record_num": F.col("_line") - src.header_line, "_sheet": F.lit("")}
        )
        heads = None
        if src.header_line > 0:
            heads = headers(session, src, batch.select(F.col("_path").alias("path")).distinct())
        table = parse_rows(session, rows, heads, src)
        result = template.run(table).output(with_order=True)
        write_per_file(result, f"{out}/batch={batch_id}", spec, source=src.path, mode="overwrite")
        written.append(batch_id)

    q = (
        raw.writeStream.foreachBatch(one)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return len(written)
