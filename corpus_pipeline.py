"""The corpus pipeline over the documents table: language, copies, near copies, benchmark passages, packing.

Every stage takes all rows its predecessor kept and drops rows by doc_id (exact
copies: by doc_id and text), so rows that repeat a doc_id stay or go together.
Rows with a null doc_id cannot be named and stay. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.llm.decontamination import contaminated, contamination
from sluicework.llm.exact import exact_duplicates, lowered
from sluicework.llm.language import identify
from sluicework.llm.minhash import near_duplicates
from sluicework.llm.packing import pack
from sluicework.llm.queries import packed_pieces, tokenizer_path
from sluicework.llm.tables import without, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language: without letters, or unlike every language of the corpus."""
    judged = identify(docs, ["doc_id"], declared=F.col("lang"), host=F.col("source"))
    return without(docs, judged.where("NOT kept").select("doc_id"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, but for A-Z and a-z, the one with the largest doc_id stays."""
    gone = exact_duplicates(docs).where("NOT kept").select("doc_id", F.col("text_sha256").alias("_sha"))
    text = lowered(F.coalesce(F.col("text"), F.lit("")))
    named = docs.withColumn("_sha", F.sha2(text.cast("binary"), 256))
    return without(named, gone, 100).drop("_sha")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays."""
    return without(docs, near_duplicates(docs).where("NOT kept").select("doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more stands in the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(spark, docs, benchmark)
    return without(docs, found.where(contaminated()).select("doc_id"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document that is left, in sequences of at most 4096 tokens."""
    return packed_pieces(pack(docs, tokenizer_path()))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]
#: Similarity, token ids and packing have no SQL counterpart; tests/llm hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on all rows its predecessor kept; between stages the rows are written and read again."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        rows = written(stage(spark, rows, sf_dir), name)
    return STAGES[-1][1](spark, rows, sf_dir)
