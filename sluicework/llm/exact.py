"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import small, written

#: A chunk ends behind the first sentence or line end at least MIN_CHUNK characters on, at MAX_CHUNK at the latest.
MIN_CHUNK, MAX_CHUNK = 1024, 8192
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """Lower-case A-Z only. A text of ASCII alone takes the byte-wise path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def chunks(text: Column) -> Column:
    """The chunks of a text, in order; joined they are the text. Empty texts have none."""
    pattern = f"(?s).{{{MIN_CHUNK}}}(?:.{{0,{MAX_CHUNK - MIN_CHUNK}}}?[.!?\\n]|.{{0,{MAX_CHUNK - MIN_CHUNK}}})|.+"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when they are identical after lower-casing A-Z. Each text
    becomes a recipe: the list of its chunks' keys (a 64-bit hash cut to
    key_bits) and lengths. Texts whose recipes agree are candidates; only their
    chunks are moved, once, and compared as whole strings: a key met with two
    different contents gets each content's SHA-256 added, which makes the
    identifiers verified. Equal lists of verified identifiers are equal texts.
    Groups are counted before the shuffle and joined back on short rows.

    Null texts count as empty, and empty texts are equal. Of equal texts the
    row with the largest id stays; rows that repeat that id all stay, as the id
    is their identity. Null ids rank below all others; in a group of null ids
    alone, every row stays. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), lowered(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    key = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - key_bits)
    item = lambda c: F.struct(key(c).alias("key"), F.char_length(c).alias("n"))
    recipes = written(
        rows.select("id", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"), F.transform(chunks(F.col("t")), item).alias("recipe")), "recipes"
    )
    recipes = recipes.withColumn("digest", F.xxhash64("recipe"))
    # Written, so that each side of the join is an exchange of its own and a hot key can be split.
    again = written(recipes.groupBy("digest").count().where("count > 1").select("digest"), "digests")
    twice = written(recipes.join(again, "digest", "left_semi").select("id").distinct(), "candidates")
    moved = rows.join(small(twice, 16), "id", "left_semi").union(rows.where("id IS NULL"))
    moved = moved.select(F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"), "t")
    pieces = moved.select("text_sha256", F.posexplode(chunks(F.col("t"))).alias("pos", "chunk")).withColumn("key", key(F.col("chunk"))).withColumn("n", F.char_length("chunk"))
    clash = written(pieces.select("key", "n", "chunk").distinct().groupBy("key", "n").count().where("count > 1").select("key", "n"), "clashes")
    marks = pieces.join(small(clash, 24), ["key", "n"], "left_semi").select("text_sha256", "pos", F.sha2(F.col("chunk").cast("binary"), 256).alias("sha"))
    # Copies are one entry here, and a text has no more marks than chunks.
    marks = marks.distinct().groupBy("text_sha256").agg(F.map_from_entries(F.collect_list(F.struct("pos", "sha"))).alias("marks"))
    full = recipes.join(marks, "text_sha256", "left")
    plain = F.transform("recipe", lambda c: F.struct(c.key.alias("key"), c.n.alias("n"), F.lit("").alias("sha")))
    checked = F.transform("recipe", lambda c, i: F.struct(c.key.alias("key"), c.n.alias("n"), F.coalesce(F.try_element_at("marks", i), F.lit("")).alias("sha")))
    full = full.select("id", "text_sha256", F.when(F.col("marks").isNull(), plain).otherwise(checked).alias("list"))
    full = full.withColumn("digest", F.xxhash64("list"))
    groups = written(full.groupBy("digest", "list").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return full.join(groups, ["digest", "list"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.size("list").cast("long").alias("n_chunks")
    )
