"""Language identification: text likelihood, declared language, address and host prior, fused by Bayes' rule."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import small, written
from .words import releasing, slices

#: Different texts of each language that the letter model is fitted on, about.
LANGUAGE_ROWS = 600
BUCKETS = 1 << 15
#: Count that each bucket has beforehand; trigrams a language needs to be in the model (fewer are a stray label), and
#: to say that a text is known: with fewer, any text is nearly as likely as in a uniform model.
BEFORE, FEW, ENOUGH = 0.05, 100, BUCKETS // 20
#: Letter trigrams overlap, so a text counts as at most so many independent ones.
EVIDENCE = 60
#: Weight, in documents, of the level above: all documents for a domain, the domain for a host.
DOMAIN_WEIGHT, HOST_WEIGHT = 50.0, 20.0
UNKNOWN = "und"

#: Letters (a-z after lower-casing, and all of non-ASCII) stand for themselves, everything else is one space.
_LETTERS = np.zeros(256, np.int64)
_LETTERS[0x61:0x7B] = np.arange(1, 27)
_LETTERS[0x80:] = np.arange(0x80, 0x100)
_ALL = np.ones(256, bool)


def trigrams(part) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each letter trigram of a slice, and the text it is in. At least two of the three are letters."""
    codes = _LETTERS[part.data]
    n = len(codes)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    text = np.repeat(np.arange(len(part.offsets) - 1), np.diff(part.offsets))
    use = (((a > 0).astype(np.int8) + (b > 0) + (c > 0)) >= 2) & (text[:-2] == text[2:])
    bucket = ((a * 66_049 + b * 257 + c) * 0x9E3779B1 >> 12) & (BUCKETS - 1)
    return bucket[use], text[:-2][use]


@dataclass
class Letters:
    """Log probability of each trigram bucket in each language, and which languages can say that a text is known."""

    languages: list[str]
    table: np.ndarray
    enough: np.ndarray


def learn_letters(docs: DataFrame, text_col: str, label: Column, language_rows: int = LANGUAGE_ROWS) -> Letters:
    """Trigram counts of about language_rows different texts of each label, those with the smallest hashes, and of all
    if it has fewer. Each task counts what it reads; the driver gets one number for each language and bucket."""
    labelled = docs.select(label.alias("label"), F.col(text_col).alias("t")).where("label IS NOT NULL AND t IS NOT NULL").withColumn("h", F.xxhash64("t"))
    shares = labelled.groupBy("label").agg((F.lit(float(language_rows)) / F.approx_count_distinct("h")).alias("share"))
    shares = written(shares, "label_shares")
    chosen = labelled.join(small(shares, 24), "label").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * float(1 << 30))
    chosen = chosen.groupBy("label", "h").agg(F.first("t").alias("t")).select("label", "t")
    schema = T.StructType([T.StructField("label", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist(), object)
            for part in slices(batch.column(1), _ALL):
                bucket, text = trigrams(part)
                for name in set(labels[part.first : part.last]):
                    mine = bucket[(labels[part.first : part.last] == name)[text]]
                    total[name] = total.get(name, 0) + np.bincount(mine, minlength=BUCKETS)
        for name, numbers in total.items():
            full = np.flatnonzero(numbers)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(numbers[full])], schema.names)

    counted = chosen.mapInArrow(releasing(count), schema).groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(counted.column("label").to_pylist(), object)
    languages, at = np.unique(names, return_inverse=True) if len(names) else (names, np.zeros(0, np.int64))
    bucket, n = counted.column("bucket").to_numpy(), counted.column("n").to_numpy()
    total = np.bincount(at, weights=n, minlength=len(languages))
    # Of few texts all languages are taken as they are.
    kept = np.flatnonzero(total >= (FEW if (total >= ENOUGH).any() else 1))
    place = np.full(len(languages), -1)
    place[kept] = np.arange(len(kept))
    mine = place[at] >= 0
    table = np.full((BUCKETS, len(kept)), BEFORE)
    table[bucket[mine], place[at[mine]]] += n[mine]
    enough = total[kept] >= ENOUGH
    return Letters(languages[kept].tolist(), np.log(table / table.sum(0)).astype(np.float32), enough if enough.any() else ~enough)


def language_code(text: Column) -> Column:
    """Primary subtag of a declared language; anything else is null."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(text)), "^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def address_code(url: Column) -> Column:
    """What an address says: the language segment of its path if there is one, else the last part of its host."""
    path = F.regexp_extract(F.lower(url), "^[a-z]+://[^/]+/([a-z]{2})(?:[/?#]|$)", 1)
    top = F.regexp_extract(F.lower(url), "^[a-z]+://[^/:?#]*\\.([a-z]{2,})(?:[:/?#]|$)", 1)
    return F.when(path != "", F.concat(F.lit("/"), path)).when(top != "", F.concat(F.lit("."), top))


def host_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(url), "^[a-z]+://(?:www\\.)?([^/:?#]+)", 1), F.lit(""))


def identify(docs: DataFrame, keys: list[str], text_col: str = "text", declared: Column | None = None, address: Column | None = None, host: Column | None = None, letters: Letters | None = None, label: Column | None = None) -> DataFrame:
    """One row per input row: the keys, language, probability, kept.

    Log odds of each language are the sum of
    - the text's letter trigrams under the language's model, at the weight of at
      most EVIDENCE independent ones;
    - the declared language and the address code, each by how often it goes with
      the language in this corpus (grouped counts of what the texts alone say);
    - the prior of the host: its own counts, smoothed towards its domain's, and
      those towards all documents'.
    Counts are grouped before the shuffle, so a host of any size is one short
    row, and only those rows are joined.

    A text without letter trigrams, or one whose letters are less likely in
    every language of ENOUGH trigrams than in a uniform model, is UNKNOWN. kept is false for those
    and where no language reaches a half. Null texts count as empty. Null
    declarations, addresses and hosts are no evidence. Labels are those of
    `label`, by default the declared ones. Rows that repeat are judged alike.
    """
    none = F.lit(None).cast("string")
    declared = none if declared is None else language_code(declared)
    letters = learn_letters(docs, text_col, declared if label is None else label) if letters is None else letters
    names, enough, model = letters.languages, letters.enough, docs.sparkSession.sparkContext.broadcast(letters.table)  # BUCKETS x languages
    k = len(names)
    if not k:
        return docs.select(*keys, F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("probability"), F.lit(False).alias("kept"))
    host = none if host is None else host
    seen = docs.select(
        F.struct(*[F.col(c) for c in keys]).alias("_keys"), declared.alias("declared"), (none if address is None else address).alias("address"), host.alias("host"),
        F.coalesce(F.nullif(F.regexp_extract(host, "([^.]+\\.[^.]+)$", 1), F.lit("")), host).alias("domain"), F.col(text_col).alias("_text"),
    )
    schema = T.StructType([f for f in seen.schema if f.name != "_text"] + [T.StructField("lean", T.ArrayType(T.DoubleType())), T.StructField("best", T.DoubleType())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(5), _ALL):
                n = part.last - part.first
                bucket, text = trigrams(part)
                count = np.bincount(text, minlength=n)
                sums = np.stack([np.bincount(text, weights=model.value[bucket, j], minlength=n) for j in range(k)], 1)
                mean = sums / np.maximum(count, 1)[:, None]
                lean = mean * np.minimum(count, EVIDENCE)[:, None]
                best = np.where(count > 0, mean[:, enough].max(1), -np.inf)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, k * n + 1, k, dtype=np.int32)), pa.array((lean - lean.max(1, keepdims=True)).ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(part.first, n) for i in range(5)], flat, pa.array(best)], schema.names)

    seen = written(seen.mapInArrow(releasing(weigh), schema), "evidence", texts=True)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    normal = lambda a: F.transform(a, lambda x: x / total(a))
    spread = seen.withColumn("p", F.transform("lean", lambda x: F.exp(x))).withColumn("p", normal(F.col("p")))
    spread = spread.where(F.col("best") > float(-np.log(BUCKETS)))
    sums = [F.sum(F.col("p")[j]).alias(f"c{j}") for j in range(k)]
    vector = F.array(*[F.col(f"c{j}") for j in range(k)])
    whole = spread.agg(*[F.coalesce(s, F.lit(0.0)).alias(f"c{j}") for j, s in enumerate(sums)]).first()
    overall = np.array([whole[j] for j in range(k)]) + 1.0
    prior = F.array(*[F.lit(float(x)) for x in overall / overall.sum()])

    def likelihood(column: str) -> DataFrame:
        """log P(value | language) for each value met, one pseudo-document spread over all."""
        counts = spread.where(F.col(column).isNotNull()).groupBy(column).agg(*sums)
        odds = F.array(*[F.log((F.col(f"c{j}") + 0.5) / F.lit(float(overall[j] + 10.0))) for j in range(k)])
        return written(counts.select(column, odds.alias(f"{column}_odds")), column)

    def smoothed(counts: Column, above: Column, weight: float) -> Column:
        return F.zip_with(counts, above, lambda c, a: (c + weight * a) / (total(counts) + weight))

    domains = spread.where("domain IS NOT NULL").groupBy("domain").agg(*sums).select("domain", smoothed(vector, prior, DOMAIN_WEIGHT).alias("domain_prior"))
    hosts = spread.where("host IS NOT NULL").groupBy("host", "domain").agg(*sums).select("host", "domain", vector.alias("counts"))
    hosts = hosts.join(domains, "domain").select("host", F.transform(smoothed(F.col("counts"), F.col("domain_prior"), HOST_WEIGHT), lambda x: F.log(x)).alias("host_odds"))
    hosts = written(hosts, "hosts")
    row = 40 + 8 * k
    zero = F.array_repeat(F.lit(0.0), k)
    fused = seen.join(small(likelihood("declared"), row), "declared", "left").join(small(likelihood("address"), row), "address", "left").join(small(hosts, row), "host", "left")
    odds = F.col("lean")
    for more in (F.coalesce("declared_odds", zero), F.coalesce("address_odds", zero), F.coalesce("host_odds", F.transform(prior, lambda x: F.log(x)))):
        odds = F.zip_with(odds, more, lambda a, b: a + b)
    fused = fused.select("_keys", "best", odds.alias("odds"))
    fused = fused.select("_keys", "best", F.transform("odds", lambda x: F.exp(x - F.array_max("odds"))).alias("p"))
    fused = fused.select("_keys", "best", normal(F.col("p")).alias("p"))
    known = F.col("best") > float(-np.log(BUCKETS))
    top = F.array_max("p")
    language = F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position("p", top).cast("int"))
    return fused.select(
        "_keys.*", F.when(known, language).otherwise(UNKNOWN).alias("language"), F.when(known, top).otherwise(0.0).alias("probability"), (known & (top >= 0.5)).alias("kept")
    )
