"""Repeated passages by prefix-partitioned sparse suffix trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .tables import small, written
from .words import WORD_BASE, Slice, ragged, rolled, slices

#: Words of a window, and of the prefix that deals suffixes into groups.
WINDOW, PREFIX = 50, 16
#: A prefix met more often than this is lengthened to the whole window, and each such node dealt into SALTS parts.
GROUP_SUFFIXES, SALTS = 512, 64
_PLACE_BITS = 28


def slide_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    span, out = 1, values
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (width - span)], out[width - span :]) if width > span else out


def anchors(part: Slice, hashes: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window, the prefix with the least fingerprint (the first of equals): document, fingerprint, first
    window and number of windows that choose it. Equal windows choose the same place, wherever they stand."""
    count = np.maximum(part.counts() - window + 1, 0)
    starts = ragged(part.bounds[:-1], count)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    grams = rolled(hashes, np.arange(len(hashes) - prefix + 1), np.arange(prefix, len(hashes) + 1), WORD_BASE)
    places = np.uint64((1 << _PLACE_BITS) - 1)
    least = slide_min((grams & ~places) | np.arange(len(grams), dtype=np.uint64), window - prefix + 1)
    chosen = (least[starts] & places).astype(np.int64)
    doc = np.repeat(np.arange(len(count)), count)
    new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1]))))
    return doc[new], grams[chosen[new]], starts[new] - part.bounds[:-1][doc[new]], np.diff(np.append(new, len(starts)))


def joined_words(part: Slice, i: int, keep: np.ndarray | None = None) -> bytes:
    a, b = part.bounds[i], part.bounds[i + 1]
    at = np.arange(a, b) if keep is None else np.flatnonzero(keep) + a
    data = part.data
    return b" ".join([data[s:e].tobytes() for s, e in zip(part.starts[at].tolist(), part.ends[at].tolist(), strict=True)])


def whole_words(part: Slice, i: int) -> bytes:
    return b" ".join(part.data[part.offsets[i] : part.offsets[i + 1]].tobytes().split())


def short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256, spans (first word, end) of what is removed.

    A window is `window` consecutive words. A word goes if it is covered by a
    window whose words also start in a document with a smaller id.

    1. Texts with equal words are one text: all but the smallest id go whole.
    2. Every window names one of its prefixes (the least fingerprint), so only
       about 2 of `window - prefix` suffixes need a look. Prefixes that stand in
       one text alone hold no repeat and end here.
    3. The suffixes of the windows behind the other prefixes are dealt out by
       prefix: a group fits in memory and is one subtree, kept as the sorted
       labels of its nodes at window depth. Nodes there with more than one
       document are the deep internal nodes; windows that follow each other in
       them are maximal repeats, and become spans.
    4. A prefix met more than group_suffixes times is lengthened to the whole
       window. Such a node's smallest id is found by a grouped minimum,
       combined before the shuffle, and leads each of the node's SALTS parts,
       so that no passage that many documents share meets in one task.

    Null texts have no words. Rows with a null id are left whole and count for
    no other. Rows that repeat an id don't count for each other. Texts of fewer
    words than a window lose nothing. Empty tables give empty results.
    """
    kind = docs.schema[id_col].dataType
    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
    seen = T.StructType(
        [T.StructField("id", kind), T.StructField("n_words", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("digest", T.LongType())]
        + [T.StructField(n, T.ArrayType(T.LongType())) for n in ("prefixes", "firsts", "counts")]
    )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), lower=False):
                n = len(part.bounds) - 1
                doc, grams, firsts, counts = anchors(part, part.hashes(), window, prefix)
                offsets = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
                shas = [hashlib.sha256(whole_words(part, i)) for i in range(n)]
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (grams.view(np.int64), firsts, counts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, n), pa.array(part.counts().astype(np.int64)), pa.array([x.hexdigest() for x in shas]), pa.array([short(x.digest()) for x in shas], pa.int64()), *lists],
                    seen.names,
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    first_look = written(rows.mapInArrow(look, seen), "anchors", texts=True)
    whole = written(first_look.where("id IS NOT NULL").groupBy("sha").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max("digest").alias("digest")), "texts")
    copied = written(whole.where("first_id < last_id").select("sha", "first_id"), "copied")
    later = small(copied.withColumnRenamed("first_id", "kept_id"), 100)
    facts = written(
        first_look.select("id", "n_words", "sha", "digest").join(later, "sha", "left").withColumn("copy", F.coalesce(F.col("id") > F.col("kept_id"), F.lit(False))).drop("kept_id"), "facts"
    )

    pins = first_look.where("id IS NOT NULL").select("id", "digest", F.explode(F.arrays_zip("prefixes", "firsts", "counts")).alias("a"))
    pins = pins.select("id", "digest", F.col("a.prefixes").alias("prefix"), F.col("a.firsts").alias("first"), F.col("a.counts").alias("count"))
    met = pins.groupBy("prefix").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.count("*").alias("n"))
    met = written(met.where("low < high").select("prefix", (F.col("n") > group_suffixes).alias("hot")), "prefixes")
    copies = small(written(facts.where("copy").select("id", "digest").distinct(), "copies"), 32)
    regions = pins.join(small(met, 24), "prefix").join(copies, ["id", "digest"], "left_anti")
    # Bounded by the windows of one document; rows that repeat an id and its words give the same list.
    regions = regions.groupBy("id", "digest").agg(F.collect_set(F.struct("first", "count", "hot", "prefix")).alias("regions"))
    regions = written(regions, "regions")

    def with_text(lists: DataFrame, column: str) -> DataFrame:
        ids = small(written(lists.select("id").distinct(), "ids"), 16)
        return rows.join(ids, "id", "left_semi").join(lists, "id").select("id", "t", "digest", column)

    suffix = T.StructType([T.StructField("id", kind)] + [T.StructField(n, T.LongType()) for n in ("digest", "first", "prefix", "label")] + [T.StructField("hot", T.BooleanType())])

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            for part in slices(batch.column(1), lower=False):
                hashes = part.hashes()
                # Rows that repeat an id: only the one whose words the list was made of.
                own = [short(hashlib.sha256(whole_words(part, i)).digest()) == batch.column(2)[part.first + i].as_py() for i in range(len(part.bounds) - 1)]
                here = lists.slice(part.first, len(own))
                flat, sizes = here.flatten(), np.diff(here.offsets.to_numpy())
                doc = np.repeat(np.arange(len(own)), sizes)
                take = np.array(own, bool)[doc] if len(doc) else np.zeros(0, bool)
                first, count, hot, pre = (x.to_numpy(zero_copy_only=False)[take] for x in flat.flatten())
                doc = doc[take]
                at = ragged(first + part.bounds[:-1][doc], count)
                label = rolled(hashes, at, at + window, WORD_BASE).view(np.int64)
                doc, pre, hot = np.repeat(doc, count), np.repeat(pre, count), np.repeat(hot, count)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, len(own)).take(pa.array(doc)), batch.column(2).slice(part.first, len(own)).take(pa.array(doc)), pa.array(at - part.bounds[:-1][doc]), pa.array(pre), pa.array(label), pa.array(hot.astype(bool))],
                    suffix.names,
                )

    tree = written(with_text(regions, "regions").mapInArrow(suffixes, suffix), "suffixes", texts=True)

    found = T.StructType([T.StructField("id", kind)] + [T.StructField(n, T.LongType()) for n in ("digest", "first")])

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of prefix, label, id: a node's first row has its smallest id."""
        node, least = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            label = batch.column(4).to_numpy()
            ids = batch.column(0)
            new = np.concatenate(([node is None or label[0] != node], label[1:] != label[:-1]))
            lead = np.flatnonzero(new)
            at = np.cumsum(new) - 1
            values = np.asarray(ids.to_numpy(zero_copy_only=False))
            leads = values[lead]
            if not new[0]:
                leads = np.concatenate((np.array([least], values.dtype), leads))
                at = at + 1
            node, least = label[-1], leads[-1]
            later_ones = pa.array(values > leads[at])
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), batch.column(2)], found.names).filter(later_ones)

    hot = tree.where("hot")
    lead = written(hot.groupBy("label").agg(F.min("id").alias("id"), F.max("id").alias("most")).where("id < most").select("id", "label"), "nodes")
    lead = lead.select("id", F.lit(0).cast("long").alias("digest"), F.lit(0).cast("long").alias("first"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "label")
    salted = lead.union(hot.select("id", "digest", "first", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"), "label"))
    dealt = tree.where("NOT hot").select("id", "digest", "first", "prefix", "label").union(salted.select("id", "digest", "first", F.xxhash64("label", "salt"), "label"))
    covered = dealt.repartition("prefix").sortWithinPartitions("prefix", "label", "id").mapInArrow(subtrees, found)
    covered = covered.groupBy("id", "digest").agg(F.collect_set("first").alias("firsts"))
    covered = written(covered, "covered")

    result = T.StructType([T.StructField("id", kind), T.StructField("digest", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("spans", span)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part in slices(batch.column(1), lower=False):
                for i in range(len(part.bounds) - 1):
                    row = part.first + i
                    digest, n = batch.column(2)[row].as_py(), int(part.bounds[i + 1] - part.bounds[i])
                    if short(hashlib.sha256(whole_words(part, i)).digest()) != digest:
                        continue
                    first = batch.column(3)[row].values.to_numpy()
                    steps = np.zeros(n + 1, np.int64)
                    np.add.at(steps, first, 1)
                    np.add.at(steps, first + window, -1)
                    gone = np.cumsum(steps[:-1]) > 0
                    edges = np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))
                    pairs = zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True)
                    out.append((batch.column(0)[row].as_py(), digest, int(gone.sum()), hashlib.sha256(joined_words(part, i, ~gone)).hexdigest(), [{"first": a, "end": b} for a, b in pairs]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, arrow_types, strict=True)], result.names)

    arrow_types = [to_arrow_type(f.dataType) for f in result.fields]
    changed = written(with_text(covered, "firsts").mapInArrow(cut, result).dropDuplicates(["id", "digest"]), "cut", texts=True)
    all_gone = F.col("copy") & (F.col("n_words") >= window)
    every = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("end")))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return facts.join(changed, ["id", "digest"], "left").select(
        F.col("id").alias(id_col), "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, empty).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(all_gone, every).otherwise(F.coalesce("spans", F.array().cast(span))).alias("spans"),
    )
