"""Spelling variants: words one edit apart, from a trie over letter-group counts.

A word's vector is its length and how often each of GROUPS letter groups occurs
in it. One edit leaves the vector, or takes one from one group (a deficit), or
gives one to another (a surplus), or both. The words stand in a trie by
successive counts; a search walks down from the root and may spend one surplus
and one deficit, and compares the words of the leaves it comes to letter by
letter. Each pair is found once: at equal lengths only words with the larger
vector are looked for, so a surplus is spent before a deficit, and a longer word
looks for shorter ones with the deficit alone.

The upper levels of the trie are dealt out: a subtree with at most SHARD_LETTERS
letters is a shard, which one task holds and walks with the words that reach it;
larger subtrees are cut at deeper levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small, written
from .words import mix, ragged

#: Letter groups: a letter belongs to the group of its code point modulo this.
GROUPS = 12
#: Levels below the length at which the trie is cut into shards; the next ones only where a subtree is too large.
CUTS = (2, 6, GROUPS)
SHARD_LETTERS = 2_000_000
#: Letters of searching words that walk one copy of a shard.
SEARCH_LETTERS = 400_000
#: Words that search at once, and branches of their searches that are followed at once.
BATCH, BRANCHES = 20_000, 400_000
#: Leaves with more words are looked up by what is left of a word without one letter.
LEAF = 64
#: A search starts unspent at equal lengths, and with its surplus spent among shorter words.
UNSPENT, SURPLUS, BOTH = 0, 1, 2


def variant_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 5, least_rows: int = 3, damage: int | None = 97) -> DataFrame:
    """(word, n): runs of Latin letters in lower case A-Z, with at least so many letters and occurrences.

    damage: where this number divides h, the CRC-32 of id, colon and run, the run loses its letter
    h % length; None leaves all runs whole. Null texts hold no words; a null id is empty.
    """
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lower, F.lit(f"[A-Za-zÀ-ÿ]{{{least_letters},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    word = F.col("run")
    if damage:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        runs = runs.withColumn("h", h).withColumn("at", (F.col("h") % F.char_length("run")).cast("int"))
        cut = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.char_length("run")))
        word = F.when(F.col("h") % damage == 0, cut).otherwise(word)
    words = runs.select(word.alias("word")).where(F.char_length("word") >= least_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_rows)


class Words:
    """Some words as one array of letters: of[starts[i]:ends[i]] is word i; vectors[i] its length and group counts."""

    def __init__(self, words: list[str]):
        self.names = words
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.of = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        cell = np.repeat(np.arange(len(words)) * GROUPS, self.sizes) + self.of % GROUPS
        counts = np.bincount(cell, minlength=len(words) * GROUPS).reshape(-1, GROUPS)
        self.vectors = np.concatenate((self.sizes[:, None], counts), axis=1)
        self.halves: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def half(self, shorter: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the first m // 2 letters and of the last m - m // 2, where m is the length less `shorter`."""
        if shorter not in self.halves:
            place = ragged(np.zeros(len(self.sizes), np.int64), self.sizes)
            letter = self.of.astype(np.uint64) << np.uint64(32)
            ahead = np.concatenate(([np.uint64(0)], np.cumsum(mix(letter + place.astype(np.uint64)))))
            back = np.concatenate(([np.uint64(0)], np.cumsum(mix(letter + (np.repeat(self.sizes, self.sizes) - place).astype(np.uint64)))))
            m = np.maximum(self.sizes - shorter, 0)
            self.halves[shorter] = ahead[self.starts + m // 2] - ahead[self.starts], back[self.ends] - back[self.ends - (m - m // 2)]
        return self.halves[shorter]

    def without_one(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, fingerprint of the word without the letter at that place) for all places of the rows."""
        sizes = self.sizes[rows]
        at = ragged(self.starts[rows], sizes)
        place = ragged(np.zeros(len(rows), np.int64), sizes)
        owner = np.repeat(np.arange(len(rows)), sizes)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        here = mix((self.of[at].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64))
        moved = mix((self.of[at].astype(np.uint64) << np.uint64(32)) + (place - 1).astype(np.uint64))
        left, right = np.concatenate(([np.uint64(0)], np.cumsum(here))), np.concatenate(([np.uint64(0)], np.cumsum(moved)))
        spot = np.arange(len(at))
        total = left[spot] - left[first] + right[first + sizes[owner]] - right[spot + 1]
        return rows[owner], place, mix(total)

    def whole(self, rows: np.ndarray) -> np.ndarray:
        """The fingerprint that `without_one` gives words that are equal to these."""
        sizes = self.sizes[rows]
        at = ragged(self.starts[rows], sizes)
        place = ragged(np.zeros(len(rows), np.int64), sizes)
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix((self.of[at].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64)))))
        ends = np.cumsum(sizes)
        return mix(total[ends] - total[ends - sizes])


def may_fit(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether words i of a and j of b, as long or one letter shorter, share a half: one edit leaves one of two alone."""
    head, tail = b.half(0)
    out = np.zeros(len(i), bool)
    for shorter in (0, 1):
        rows = np.flatnonzero(a.sizes[i] - shorter == b.sizes[j])
        first, last = a.half(shorter)
        out[rows] = (first[i[rows]] == head[j[rows]]) | (last[i[rows]] == tail[j[rows]])
    return out


def one_edit(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether words i of a and j of b, as long or one letter shorter, are exactly one edit apart."""
    out = np.zeros(len(i), bool)
    if not len(i):
        return out
    sizes = b.sizes[j]
    x, y = ragged(a.starts[i], sizes), ragged(b.starts[j], sizes)
    place = ragged(np.zeros(len(i), np.int64), sizes)
    heads = np.cumsum(sizes) - sizes
    differ = a.of[x] != b.of[y]
    same = a.sizes[i] == sizes
    out[same] = (np.add.reduceat(differ, heads, dtype=np.int64) == 1)[same]
    shorter = a.sizes[i] == sizes + 1
    if shorter.any():
        first = np.minimum.reduceat(np.where(differ, place, np.repeat(sizes, sizes)), heads)
        moved = a.of[np.minimum(x + 1, len(a.of) - 1)] != b.of[y]
        last = np.maximum.reduceat(np.where(moved, place, -1), heads)
        out[shorter] = (last < first)[shorter]
    return out


def branches(counts: np.ndarray, spent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, count to look for, spent then) of each way to go on at one level."""
    yield np.arange(len(counts)), counts, spent
    rows = np.flatnonzero(spent == UNSPENT)
    yield rows, counts[rows] + 1, np.full(len(rows), SURPLUS)
    rows = np.flatnonzero((spent == SURPLUS) & (counts > 0))
    yield rows, counts[rows] - 1, np.full(len(rows), BOTH)


class Trie:
    """The subtree of some words with equal first counts; `depth` of the levels of groups lie above it."""

    def __init__(self, words: Words, depth: int):
        vectors = words.vectors[:, 1 + depth :]
        order = np.lexsort([*reversed(vectors.T), np.zeros(len(vectors))])
        self.words, self.order, vectors = words, order, vectors[order]
        self.step = int(vectors.max(initial=0)) + 3
        self.levels = []
        node = np.zeros(len(order), np.int64)
        for counts in vectors.T:
            keys, node = np.unique(node * self.step + counts, return_inverse=True)
            self.levels.append(keys)
        self.ends = np.cumsum(np.bincount(node, minlength=1))
        self.starts = np.concatenate(([0], self.ends[:-1]))
        self.crowded = np.flatnonzero(self.ends - self.starts > LEAF)
        self.lost: dict[int, tuple] = {}

    def search(self, words: Words, spent: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(searching word, word of the trie) of all pairs that are one edit apart."""
        pairs = []
        todo = [(0, np.arange(len(spent)), np.zeros(len(spent), np.int64), spent)]
        while todo:
            level, who, node, spent = todo.pop()
            if level == len(self.levels):
                pairs.append(self.leaves(words, who, node))
                continue
            keys, found = self.levels[level], []
            for rows, count, then in branches(words.vectors[who, 1 + depth + level], spent):
                key = node[rows] * self.step + np.minimum(count, self.step - 1)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                found.append((who[rows[hit]], at[hit], then[hit]))
            who, node, spent = (np.concatenate(x) for x in zip(*found, strict=True))
            for k in range(0, len(who), BRANCHES):
                todo.append((level + 1, who[k : k + BRANCHES], node[k : k + BRANCHES], spent[k : k + BRANCHES]))
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        return i, j

    def leaves(self, words: Words, who: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        big = np.isin(leaf, self.crowded)
        low, high = self.starts[leaf], self.ends[leaf]
        pairs = []
        plain = np.flatnonzero(~big)
        for k in range(0, len(plain) + 1, BRANCHES // 4):
            at = plain[k : k + BRANCHES // 4]
            pairs.append(self.checked(words, *self.expanded(who[at], low[at], high[at], self.order)))
        for x in np.unique(leaf[big]).tolist():
            pairs.append(self.checked(words, *self.by_loss(words, who[leaf == x], x)))
        i, j = zip(*pairs, strict=True)
        return np.concatenate(i), np.concatenate(j)

    @staticmethod
    def expanded(who, starts, ends, names):
        sizes = ends - starts
        return np.repeat(who, sizes), names[ragged(starts, sizes)]

    def by_loss(self, words: Words, who: np.ndarray, leaf: int):
        """Candidates of a leaf with many words: those that lose the same letter's place to equal rests, or that are the rest."""
        if leaf not in self.lost:
            rows = self.order[self.starts[leaf] : self.ends[leaf]]
            row, place, rest = self.words.without_one(rows)
            key = mix(rest + place.astype(np.uint64))
            a, whole = np.argsort(key, kind="stable"), self.words.whole(rows)
            b = np.argsort(whole, kind="stable")
            self.lost[leaf] = (key[a], row[a], whole[b], rows[b])
        keys, rows, wholes, names = self.lost[leaf]
        longer = words.sizes[who] > self.words.sizes[names[0]]
        out = []
        row, place, rest = words.without_one(who[~longer])
        key = mix(rest + place.astype(np.uint64))
        out.append(self.expanded(row, np.searchsorted(keys, key), np.searchsorted(keys, key, "right"), rows))
        row, place, rest = words.without_one(who[longer])
        fresh = np.unique(np.stack((row.astype(np.uint64), rest)), axis=1) if len(row) else np.zeros((2, 0), np.uint64)
        out.append(self.expanded(fresh[0].astype(np.int64), np.searchsorted(wholes, fresh[1]), np.searchsorted(wholes, fresh[1], "right"), names))
        i, j = zip(*out, strict=True)
        return np.concatenate(i), np.concatenate(j)

    def checked(self, words: Words, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that are one edit apart; of two words with equal vectors the smaller one finds the larger."""
        fit = may_fit(words, i, self.words, j)
        i, j = i[fit], j[fit]
        keep = one_edit(words, i, self.words, j)
        i, j = i[keep], j[keep]
        twin = (words.vectors[i] == self.words.vectors[j]).all(axis=1)
        late = np.fromiter((t and words.names[a] > self.words.names[b] for t, a, b in zip(twin.tolist(), i.tolist(), j.tolist(), strict=True)), bool, len(i))
        return i[~late], j[~late]


def key_of(vectors: np.ndarray) -> pa.Array:
    """The counts of each row as bytes that sort like them."""
    width = 4 * vectors.shape[1]
    return pa.Array.from_buffers(pa.binary(width), len(vectors), [None, pa.py_buffer(np.ascontiguousarray(vectors, ">u4").tobytes())]).cast(pa.binary())


def homes(depth: int):
    """Adds the place of each word in the trie, cut at so many levels of groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), key_of(words.vectors[:, : 1 + depth])], ["word", "n", "key"])

    return run


def visits(above: int, depth: int):
    """All places at `depth` that a search may come to, from the one at `above` that it is in; above -1: from the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, BATCH):
                rows = batch.slice(part, BATCH)
                words = Words(rows.column(0).to_pylist())
                who = np.arange(rows.num_rows)
                if above < 0:
                    there = np.concatenate((words.vectors[:, :1], words.vectors[:, :1] - 1))
                    who, spent = np.concatenate((who, who)), np.repeat([UNSPENT, SURPLUS], rows.num_rows)
                else:
                    there = np.frombuffer(b"".join(rows.column(2).to_pylist()), ">u4").reshape(rows.num_rows, -1).astype(np.int64)
                    spent = rows.column(3).to_numpy().astype(np.int64)
                for level in range(max(above, 0), depth):
                    found = [(who[x], np.concatenate((there[x], count[:, None]), axis=1), then) for x, count, then in branches(words.vectors[who, 1 + level], spent)]
                    who, there, spent = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(who)), rows.column(1).take(pa.array(who)), key_of(there), pa.array(spent, pa.int32())], ["word", "n", "key", "spent"])

    return run


def rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a leaf too large for one task, once for each rest without a letter: such leaves are dealt out by rests."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            words, spent = Words(row.column(0).to_pylist()), row.column(3)[0].as_py()
            _, place, rest = words.without_one(np.array([0]))
            placed, bare = mix(rest + place.astype(np.uint64)), np.unique(rest)
            # Standing words: by every rest and its place, and as the rest of a longer word. Searching ones: by one of the two.
            tags = [(b"p", placed), (b"w", words.whole(np.array([0])))] if spent is None else [(b"w", bare)] if len(row.column(2)[0].as_py()) and spent_longer(row) else [(b"p", placed)]
            keys = [row.column(2)[0].as_py() + tag + x.to_bytes(8, "big") for tag, names in tags for x in names.tolist()]
            at = pa.array(np.zeros(len(keys), np.int64))
            yield pa.RecordBatch.from_arrays([row.column(0).take(at), row.column(1).take(at), pa.array(keys, pa.binary()), row.column(3).take(at)], ["word", "n", "key", "spent"])


def spent_longer(row: pa.RecordBatch) -> bool:
    """Whether a searching word is longer than the words of the leaf it came to."""
    return len(row.column(0)[0].as_py()) > int.from_bytes(row.column(2)[0].as_py()[:4], "big")


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs one edit apart from rows sorted by shard, standing words (spent null) first. One shard and one batch of
    searching words are held at a time."""
    key, standing, trie, waiting = None, [], None, []

    def searched():
        nonlocal trie
        if trie is None:
            trie = Trie(Words([w for w, _ in standing]), depth)
        words = Words([w for w, *_ in waiting])
        i, j = trie.search(words, np.array([s for *_, s in waiting], np.int64), depth)
        if not len(i):
            return
        a, b = [waiting[x] for x in i.tolist()], [standing[x] for x in j.tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in a]), pa.array([x[1] for x in a], pa.int64()), pa.array([x[0] for x in b]), pa.array([x[1] for x in b], pa.int64())], ["a", "a_n", "b", "b_n"]
        )

    depth = 0
    for batch in batches:
        for place, salt, word, n, spent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (place, salt) != key:
                if waiting and standing:
                    yield from searched()
                key, standing, trie, waiting = (place, salt), [], None, []
                depth = min(len(place) // 4 - 1, GROUPS)
            if spent is None:
                standing.append((word, n))
            elif standing:
                waiting.append((word, n, spent))
                if len(waiting) == BATCH:
                    yield from searched()
                    waiting = []
    if waiting and standing:
        yield from searched()


def near_pairs(words: DataFrame, shard_letters: int = SHARD_LETTERS, search_letters: int = SEARCH_LETTERS, cuts: tuple = CUTS) -> DataFrame:
    """(a, a_n, b, b_n): every pair of the distinct words (word, n) that is one edit apart, once."""
    spark = words.sparkSession
    standing = "word string, n long, key binary"
    moving = f"{standing}, spent int"
    left, placed, reach, above = words.select("word", "n"), [], [], -1
    searching = left
    for depth in cuts:
        home = written(left.select("word", "n").mapInArrow(homes(depth), standing), "homes")
        sizes = written(home.groupBy("key").agg(F.sum(F.char_length("word")).alias("letters")), "subtrees")
        coming = written(searching.mapInArrow(visits(above, depth), moving).join(small(sizes, 64), "key"), "visits")
        large = sizes.where(F.col("letters") > shard_letters)
        placed.append(home.join(small(large, 64), "key", "left_anti").select("word", "n", "key", F.lit(None).cast("int").alias("spent")))
        reach.append(coming.where(F.col("letters") <= shard_letters).select("word", "n", "key", "spent"))
        left = home.join(small(large, 64), "key", "left_semi").select("word", "n", "key", F.lit(None).cast("int").alias("spent"))
        searching = coming.where(F.col("letters") > shard_letters).select("word", "n", "key", "spent")
        above = depth
        if large.isEmpty():
            break
    else:
        placed.append(left.select("word", "n", "key", "spent").mapInArrow(rests, moving))
        reach.append(searching.mapInArrow(rests, moving))
    rows = None
    for part in [*placed, *reach]:
        rows = part if rows is None else rows.union(part)
    rows = written(rows, "walks")
    # A shard that very many words come to is copied, and each copy takes a share of them.
    letters = F.char_length("word")
    loads = rows.groupBy("key").agg(F.sum(F.when(F.col("spent").isNotNull(), letters)).alias("load"), F.max(F.when(F.col("spent").isNull(), 1)).alias("there"))
    loads = written(loads.where("there = 1 AND load > 0").select("key", F.ceil(F.col("load") / search_letters).cast("int").alias("copies")), "loads")
    dealt = rows.join(small(loads, 64), "key")
    every = F.sequence(F.lit(0), F.col("copies") - 1)
    salt = F.when(F.col("spent").isNull(), every).otherwise(F.array(F.pmod(F.xxhash64("word"), F.col("copies")).cast("int")))
    dealt = dealt.select("key", F.explode(salt).alias("salt"), "word", "n", "spent")
    total = rows.agg(F.coalesce(F.sum(letters), F.lit(0))).first()[0]
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-total // search_letters))
    dealt = dealt.repartition(tasks, "key", "salt").sortWithinPartitions("key", "salt", F.col("spent").asc_nulls_first())
    return dealt.mapInArrow(walk, "a string, a_n long, b string, b_n long")


def variants(words: DataFrame, ratio: int = 2, **limits) -> DataFrame:
    """One row per word of (word, n): form, root, n, n_near, form_n.

    n_near: words one edit away. form: the most frequent of them (of equals the first in code-point
    order) if it is at least `ratio` times as frequent, else null. root: where forms lead from the word,
    itself without one; a form is more frequent than its word, so they end. No words give no rows.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    words = written(words.select("word", "n"), "words")
    pairs = written(near_pairs(words, **limits), "pairs")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form")))
    near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    known = words.join(near, "word", "left").withColumn("most", -F.col("best.less"))
    is_form = F.col("most") >= ratio * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, F.col("most")).alias("form_n"))
    known = written(known, "forms")
    # Each round doubles the way followed.
    roots = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = written(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not stepped.where("moved").isEmpty()
        roots = stepped.drop("moved")
        if not moved:
            break
    out = known.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
