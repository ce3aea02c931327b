"""Prefix trie, spelling variants and token counts against brute force and the library."""

import collections
import hashlib
import math
import random
import re
import zlib

import fixtures as fx
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sluicework.llm.queries import tokenizer_path
from sluicework.llm.spelling import Trie, Words, near_pairs, one_edit, variant_words, variants
from sluicework.llm.tokens import Counter, Merger, count_tokens
from sluicework.llm.trie import conversation_trie, paths, trie_nodes

MODEL = tokenizer_path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


# --- prefix trie


def conversations():
    """Rows (conv_id, turn, role, text, key, path): shared starts, copies, ties, nulls, repeated rows, absent heads, long ones."""
    rng = random.Random(1)
    rows = []
    for c in [*range(-45, 300), 1000]:
        for t in range(0 if c == 60 else rng.choice([1, 1, 2, 3, 5, 8])):
            turn = rng.choice([t, t, None]) if rng.random() < 0.2 else t
            rows.append((c, turn, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "a b", "", None, "hello  there x"])))
    rows += [(c, t, "user", "same text") for c in range(2000, 2300) for t in range(4)]
    rows += rows[5:9] + [(None, 1, "user", "x")]
    rows += [(c, t, "u", str(t % 50)) for c, n in ((5000, 300), (5020, 400)) for t in range(n)]
    return rows


def rebuilt(rows):
    said = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            said[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    said = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in said.items()}
    out = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(said.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    return out


def trie_of(whole):
    members, kids = collections.defaultdict(list), collections.defaultdict(list)
    for c, p in whole.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        words = len(fx.SPACE_WORD.findall(p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * words
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if whole[c] == p)
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=fx.key)


@pytest.mark.parametrize("shard_turns", [100_000, 7, 1])
def test_trie(spark, shard_turns):
    rows = conversations()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    turns = turns.withColumn("path", F.lit("clash")).withColumn("key", F.lit(None).cast("int")).withColumn("head", F.lit(1))
    got = trie_nodes(paths(turns), shard_turns)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=fx.key) == trie_of(rebuilt(rows))


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie(empty).count() == 0
    nameless = spark.createDataFrame([(None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert conversation_trie(nameless).count() == 0


def test_turnless_conversation(spark):
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    got = conversation_trie(spark.createDataFrame([(c, 0, "user", "x")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_long_texts_and_turns(spark):
    rows = [(100, t, "user", "w " * (200_000 if t == 1 else 1)) for t in range(2000)] + [(101, 0, "user", "w ")]
    got = conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, got.collect()), key=fx.key) == trie_of(rebuilt(rows))


# --- spelling variants


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def spelled(rows):
    """(word, form, root, n, n_near, form_n) by comparing all words."""
    n = collections.Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", fx.lowered(text)):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    friends = {w: [x for x in n if abs(len(x) - len(w)) < 2 and near(w, x)] for w in n}
    best = {w: min(f, key=lambda x: (-n[x], x)) for w, f in friends.items() if f}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n[w], len(friends[w]), n[form[w]] if w in form else None) for w in n), key=fx.key)


def misspelt():
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdeéÈ") for _ in range(rng.randint(4, 8))) for _ in range(60)] + ["x" * 300, "x" * 299]

    def changed(w):
        i = rng.randrange(len(w))
        return rng.choice([w, w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1 :]])

    rows = []
    for d in range(300):
        words = [changed(changed(rng.choice(base))) if rng.random() < 0.6 else rng.choice(base) for _ in range(rng.randint(0, 60))]
        rows.append((d, " ".join(w.upper() if rng.random() < 0.1 else w for w in words) + rng.choice(["", " 12ab-cd", "×÷ab'c"])))
    return rows + [(None, "abcde abcde abcde"), (5, None), (6, ""), (None, None)] + rows[3:6]


@pytest.mark.parametrize("limits", [{}, {"shard_letters": 300, "search_letters": 500}, {"shard_letters": 5, "search_letters": 50}])
def test_variants(spark, limits):
    rows = misspelt()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("word", F.lit("clash")).withColumn("n", F.lit(None)).withColumn("id", F.lit(1))
    assert sorted(map(tuple, variants(variant_words(docs), **limits).collect()), key=fx.key) == spelled(rows)


def test_variants_of_nothing(spark):
    assert variants(variant_words(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    assert variants(variant_words(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))).count() == 0


def test_crowded_leaf():
    """Hundreds of words of the same letters: a leaf that is looked up by what is left without a letter."""
    rng = random.Random(4)
    words = sorted({"".join(rng.sample("aaabbbmmmnnn", 12)) for _ in range(300)} | {"".join(rng.choice("ayAY") for _ in range(6)) for _ in range(200)})
    trie, pairs = Trie(Words(words), 0), set()
    assert len(trie.crowded)
    for spent in (0, 1):
        asked = Words(words if not spent else [w[:3] + "b" + w[3:] for w in words])
        i, j = trie.search(asked, np.full(len(words), spent), 0)
        pairs |= {(asked.names[a], words[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    same = {(a, b) for a in words for b in words if a < b and len(a) == len(b) and near(a, b)}
    longer = {(w[:3] + "b" + w[3:], x) for w in words for x in words if len(x) == len(w) and near(w[:3] + "b" + w[3:], x)}
    assert {tuple(sorted(p)) for p in pairs if len(p[0]) == len(p[1])} == same
    assert {p for p in pairs if len(p[0]) > len(p[1])} == longer


def test_one_edit_by_letters():
    rng = random.Random(6)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(150), np.arange(150)))
    fits = np.array([len(words[a]) - len(words[b]) in (0, 1) for a, b in zip(i, j, strict=True)])
    w = Words(words)
    assert one_edit(w, i[fits], w, j[fits]).tolist() == [near(words[a], words[b]) for a, b in zip(i[fits], j[fits], strict=True)]


def test_pairs_once(spark):
    words = spark.createDataFrame([(w, 3) for w in {"abcde", "abcdf", "abcd", "abcdee", "bacde", "vwxyz"}], "word string, n long")
    got = [tuple(sorted((r.a, r.b))) for r in near_pairs(words).collect()]
    assert sorted(got) == [("abcd", "abcde"), ("abcd", "abcdf"), ("abcde", "abcdee"), ("abcde", "abcdf")]


# --- token counts


@pytest.fixture(scope="module")
def model():
    return Merger(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts_of_all_kinds(library, n=2500):
    rng = random.Random(3)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    out = ["", " ", "  ", "▁", "\x00", "<s> </s> <unk> <0x41>", "a" * 3000, "=-" * 1500, "é" * 900]
    while len(out) < n:
        k, size = rng.randrange(6), rng.choice([0, 1, 3, 10, 60, 300])
        kinds = [
            lambda: chr(rng.choice([rng.randrange(1, 128), rng.randrange(1, 0x3000), rng.randrange(0x10000, 0x20000)])),
            lambda: rng.choice("ab "),
            lambda: rng.choice(pieces),
            lambda: rng.choice("etaoin shr▁\n"),
            lambda: rng.choice(["x", "ab", "  ", "aab", "the"]),
            lambda: rng.choice(pieces).strip(),
        ]
        out.append("".join(kinds[k]() for _ in range(size)))
    return out


@pytest.mark.parametrize("kept", [0, 500, 1_000_000])
def test_counts_are_the_librarys(model, library, kept):
    texts = texts_of_all_kinds(library)
    got = Counter(model, kept).counts(pa.array([t.encode() for t in texts], pa.binary()))
    assert got.tolist() == [len(x) for x in library.encode(texts)]


def test_blocks_inside_a_text(model, library, monkeypatch):
    monkeypatch.setattr("sluicework.llm.tokens.BLOCK_BYTES", 1000)
    texts = ["word and  more " * 700, "x" * 5000, "", ("y" * 3000 + "  ") * 3, "z"]
    got = Counter(model).counts(pa.array([t.encode() for t in texts], pa.binary()))
    assert got.tolist() == [len(x) for x in library.encode(texts)]


def test_count_tokens(spark, library):
    rows = [*fx.documents(60), (900, "many words " * 3000, *[None] * 10)]
    docs = spark.createDataFrame(rows, fx.SCHEMA).repartition(4).withColumn("n_tokens", F.lit("clash")).withColumn("text_", F.lit(1))
    got = sorted(map(tuple, count_tokens(docs, MODEL).collect()), key=fx.key)
    sizes = [len(library.encode(r[1] or "")) for r in rows]
    assert got == sorted(((r[0], len((r[1] or "").encode()), n, n > 4096) for r, n in zip(rows, sizes, strict=True)), key=fx.key)
    assert count_tokens(docs.limit(0), MODEL).count() == 0


def test_every_document(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = [(r.doc_id, len(library.encode(r.text or ""))) for r in docs.select("doc_id", "text").collect()]
    assert sorted((r.doc_id, r.n_tokens) for r in count_tokens(docs, MODEL).collect()) == sorted(want)


def test_other_vocabularies_are_refused():
    with pytest.raises(Exception):  # noqa: B017
        Merger(tokenizer_path("word_bpe_49k.json"))
