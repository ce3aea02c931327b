"""Quality by compression: how much better a text compresses with a dictionary of bad texts than with one of good."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import binary

#: Labelled texts of each class that are learnt from, the smallest hashes first; longer ones are left to the scoring.
SAMPLE_DOCS, SAMPLE_TEXT_BYTES = 1200, 1 << 16
DICTIONARY_BYTES, LEVEL = 96 << 10, 3
#: Texts are compressed in blocks, so that a dictionary counts as much at the end of a long text as at its start.
BLOCK_BYTES = 2048


@dataclass
class Model:
    """Two dictionaries (good, bad) and the calibration: log odds of a good text from `features`."""

    good: bytes
    bad: bytes
    weights: np.ndarray
    middle: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.column_stack([(x - self.middle) / self.scale, np.ones(len(x))]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


class Differ:
    def __init__(self, good: bytes, bad: bytes):
        self.sides = []
        for content in (bad, good):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self.sides.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False))

    def features(self, text: bytes) -> tuple[float, float, float]:
        """Compressed size with the bad dictionary less that with the good one as a share of their sum, and the
        compressed share of the text (log) with its square, which tell endless repetition from both; 0 for an empty text."""
        if not text:
            return 0.0, 0.0, 0.0
        view = memoryview(text)
        bad, good = (sum(len(c.compress(view[i : i + BLOCK_BYTES])) for i in range(0, len(text), BLOCK_BYTES)) for c in self.sides)
        share = math.log((bad + good) / (2 * len(text)))
        return (bad - good) / (bad + good), share, share * share


def dictionary(texts: list[bytes]) -> bytes:
    pieces = [t[i : i + BLOCK_BYTES] for t in texts for i in range(0, len(t), BLOCK_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples: the texts themselves are the dictionary
        return b"\n".join(pieces)[-DICTIONARY_BYTES:] or b"\n" * 8


def logistic(design: np.ndarray, y: np.ndarray, penalty: float = 1e-4) -> np.ndarray:
    """Weights by Newton's method with a small ridge; both classes weigh alike. The last column is the constant."""
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    ridge = np.full(design.shape[1], penalty)
    ridge[-1] = 1e-9
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - ridge * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        change = np.clip(np.linalg.solve(hessian, gradient), -5, 5)
        beta += change
        if np.abs(change).max() < 1e-9:
            break
    return beta


def fit(good: list[bytes], bad: list[bytes]) -> Model:
    """Dictionaries from every second text, the calibration from the others."""
    if not good or not bad:
        blank = b"\n" * 8
        return Model(blank, blank, np.zeros(4), np.zeros(3), np.ones(3))
    sides = dictionary(good[::2]), dictionary(bad[::2])
    differ = Differ(*sides)
    held = [(differ.features(t), label) for texts, label in ((good[1::2] or good, 1), (bad[1::2] or bad, 0)) for t in texts]
    x, y = np.array([h[0] for h in held]), np.array([h[1] for h in held], float)
    middle, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    return Model(*sides, logistic(np.column_stack([(x - middle) / scale, np.ones(len(x))]), y), middle, scale)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fits on at most sample_docs labelled texts of each class: the driver holds those and nothing else."""
    mine = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    order = [F.xxhash64("id"), F.col("id")]
    chosen = mine.where("label = 1").orderBy(*order).limit(sample_docs).union(mine.where("label = 0").orderBy(*order).limit(sample_docs)).select("id", "label")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("t")).where(F.octet_length("t").between(1, SAMPLE_TEXT_BYTES)).join(F.broadcast(chosen), "id")
    rows = sorted((r.id, r.t, r.label) for r in texts.dropDuplicates(["id"]).collect())
    return fit([t.encode() for _, t, y in rows if y == 1], [t.encode() for _, t, y in rows if y == 0])


def score(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, difference, score (0 to 1, higher is likelier good).

    Null texts count as empty; an empty text gets the score of no difference.
    Only the text is read. Rows that repeat an id are scored each for itself.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("difference", T.DoubleType()), T.StructField("score", T.DoubleType())])
    sent = spark.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        differ = Differ(sent.value.good, sent.value.bad)
        for batch in batches:
            x = np.array([differ.features(t.as_py()) for t in binary(batch.column(1))], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 0]), pa.array(sent.value.score(x))], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
