"""Shared steps of the training-data operators: written tables, size-checked broadcasts, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir, session_conf

#: A join side is broadcast only while its counted rows stay below this many bytes.
BROADCAST_BYTES = 16 << 20
#: Rows with whole texts that are sent to Python at once.
TEXT_ROWS = 1000


def written(df: DataFrame, label: str, texts: bool = False) -> DataFrame:
    """The table, written to the shared folder and read again: lineage ends, and a lost executor costs no rework.

    texts: whole texts go through Python on the way, so fewer rows are sent at once.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    with session_conf(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(TEXT_ROWS)} if texts else {}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Marks a written table for broadcast if its counted size is below the bound; larger ones stay shuffled joins."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every end of the links (a, b): component is the smallest node reachable.

    Large-star and small-star steps alternate until nothing changes. Each step
    shuffles pairs only, with the minimum combined before the shuffle, so a node
    with very many links is no burden to one task. No links give no rows.
    """
    links = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.union(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(small_star.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())




def without(docs: DataFrame, gone: DataFrame, row_bytes: int = 16) -> DataFrame:
    """The rows of docs whose key is not in gone (a table of the key columns alone); all columns of docs stay."""
    keys = gone.columns
    return docs.join(small(written(gone.distinct(), "dropped", texts=True), row_bytes), keys, "left_anti").select(*docs.columns)
