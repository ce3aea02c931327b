"""Exact, near and substring duplicates against brute force."""

import hashlib

import fixtures as fx
import pytest
from sluicework.llm.exact import chunks, exact_duplicates, lowered
from sluicework.llm.minhash import near_duplicates
from sluicework.llm.substrings import repeated_passages
from sluicework.llm.tables import components, written
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    return written(spark.createDataFrame(fx.documents(), fx.SCHEMA).repartition(5), "test")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def wanted_exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(fx.lowered(t), []).append(d)
    out = []
    for d, t in rows:
        mine = groups[fx.lowered(t)]
        keep = max((x for x in mine if x is not None), default=None)
        out.append((d, keep, len(mine), d == keep, hashlib.sha256(fx.lowered(t).encode()).hexdigest()))
    return sorted(out, key=fx.key)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact(docs, bits):
    """With few key bits most chunks clash, and contents decide."""
    got = exact_duplicates(docs, key_bits=bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted((tuple(r) for r in got), key=fx.key) == wanted_exact(pairs(docs))


def test_exact_empty(docs):
    assert exact_duplicates(docs.limit(0)).count() == 0


def test_chunks_join_to_the_text(docs):
    t = docs.select(lowered(F.coalesce("text", F.lit(""))).alias("t"))
    assert t.where(F.array_join(chunks(F.col("t")), "") != F.col("t")).count() == 0
    assert t.agg(F.max(F.size(chunks(F.col("t"))))).first()[0] > 5


def test_near(docs):
    rows = pairs(docs)
    roots = fx.near_groups(rows)
    want = sorted(((d, len(fx.shingles(t)), roots.get(d), d is None or roots[d] == d) for d, t in rows), key=fx.key)
    assert sorted((tuple(r) for r in near_duplicates(docs).collect()), key=fx.key) == want
    assert len({r[2] for r in want}) < len(want) - 20


@pytest.mark.parametrize("leaf", [48, 4])
def test_near_large_group(spark, leaf):
    """A hot group of near copies: nodes beyond the leaf size, tight ones among them."""
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(150)]
    rows = []
    for i in range(240):
        w = list(base) if i % 2 else [rng.choice(words) for _ in range(60)] + base[:60]
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    roots = fx.near_groups(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaf=leaf).collect()
    assert {r.doc_id: r.component_id for r in got} == roots


@pytest.mark.parametrize("shape", ["star", "template"])
def test_near_group_of_many_blocks(spark, shape):
    """Groups of many blocks below the limit: all links through one source, or twins that share a template."""
    import random

    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(200)]
    rows = [(500, " ".join(base))]
    for i in range(240):
        w = list(base)
        if shape == "star":
            for at in (20, 70, 120, 170):
                w[at + rng.randint(-15, 15)] = rng.choice(words)
        else:
            own = random.Random(i // 2)
            w[150:] = [own.choice(words) for _ in range(50)]
            w[10 + i % 2] = rng.choice(words)
        rows.append((i, " ".join(w)))
    roots = fx.near_groups(rows)
    assert len(set(roots.values())) == (1 if shape == "star" else 121)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaf=8, block=16).collect()
    assert {r.doc_id: r.component_id for r in got} == roots


def test_near_empty(docs):
    assert near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("group", [512, 3])
def test_substrings(docs, group):
    """With a small group size every shared prefix is lengthened to the window."""
    rows = pairs(docs)
    got = repeated_passages(docs, group_suffixes=group)
    assert sorted((tuple(r) for r in got.drop("spans").collect()), key=fx.key) == sorted(fx.repeated(rows), key=fx.key)
    sizes = got.select("n_removed", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"]).alias("n")).where("n_removed <> n")
    assert sizes.count() == 0
    assert got.agg(F.sum("n_removed")).first()[0] > 1000


def test_substrings_empty(docs):
    assert repeated_passages(docs.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 300), (200, 300), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
