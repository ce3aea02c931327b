"""The pipeline against brute force over a small documents table."""

import corpus_pipeline
import fixtures as fx
import numpy as np
from pyspark.sql import functions as F
from sluicework.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def survivors(docs, items):
    """Ids left by the first four stages: all documents here are in a known language."""
    last = {}
    for d, t in docs.items():
        last[fx.lowered(t)] = max(d, last.get(fx.lowered(t), d))
    left = {d: docs[d] for d in last.values()}
    roots = fx.near_groups(list(left.items()))
    left = {d: t for d, t in left.items() if roots[d] == d}
    hit = fx.contamination(list(left.items()), items)
    return {d: left[d] for d, n, h, _ in hit if not (h > 0 and 20 * h >= n)}


def test_run(spark):
    from tokenizers import Tokenizer

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = survivors(docs, items)
    assert 0 < len(want) < len(docs)
    whole = Tokenizer.from_file(tokenizer_path())
    counts = {d: len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in want.items()}
    rows = corpus_pipeline.run(spark, SF).collect()
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == counts
    sums = {}
    for r in rows:
        sums[r.sequence_id] = sums.get(r.sequence_id, 0) + r.length
    assert max(sums.values()) <= 4096 and np.mean(list(sums.values())) > 3000


def test_stages_keep_columns_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit(1)).withColumn("id", F.lit("x"))
    nothing = docs.where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, nothing, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.packing(spark, nothing, SF).count() == 0
