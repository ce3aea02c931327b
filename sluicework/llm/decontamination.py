"""Benchmark decontamination with an FM-index per shard of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import ALNUM, ragged, releasing, slices

WINDOW = 13
#: Bytes of text of one shard, and of the test items that are searched at once.
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 4 << 20
#: Every text position whose number divides by this keeps its place in the index, and every first one behind a break.
SAMPLE = 16


class Phrases:
    """The windows of a block of test items, as numbers of the block's own words."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        column = pa.array([t for _, t in items], pa.string())
        found: dict[bytes, list[int]] = {}
        self.names = sorted({str(i) for i, _ in items if i is not None})
        place = {n: k for k, n in enumerate(self.names)}
        vocabulary, each = [], []
        for part in slices(column, ALNUM):
            hashes = part.hashes()
            vocabulary.append(hashes)
            each += [hashes[a:b] for a, b in zip(part.bounds, part.bounds[1:], strict=False)]
        self.vocabulary = np.unique(np.concatenate([*vocabulary, np.zeros(0, np.uint64)]))
        for (item, _), words in zip(items, each, strict=True):
            ids = np.searchsorted(self.vocabulary, words).astype(np.int64)
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                owners = found.setdefault(ids[i : i + size].tobytes(), [])
                if item is not None and (not owners or owners[-1] != place[str(item)]):
                    owners.append(place[str(item)])
        #: By length: the phrases, one a row, and the number of the first.
        self.by_length: list[tuple[int, np.ndarray, int]] = []
        self.owners: list[list[int]] = []
        for size in sorted({len(k) // 8 for k in found}):
            same = [k for k in found if len(k) == 8 * size]
            self.by_length.append((size, np.array([np.frombuffer(k, np.int64) for k in same]), len(self.owners)))
            self.owners += [found[k] for k in same]
        self.shortest = self.by_length[0][0] if self.by_length else 0


class Index:
    """FM-index of runs of known words: Burrows-Wheeler transform in a wavelet matrix, sampled suffix positions.

    text: word numbers with -1 between runs. Breaks are distinct symbols to the
    suffix order and one symbol (0) to the transform; word w is symbol w + 1.
    """

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        breaks = text < 0
        rank = np.where(breaks, np.cumsum(breaks) - 1, text + int(breaks.sum()))
        width = 1
        while True:  # prefix doubling: suffixes in the order of their first `width` words
            ahead = np.zeros(n, np.int64)
            ahead[: n - width] = rank[width:] + 1
            key = rank * (int(rank.max()) + 2) + ahead
            order = np.argsort(key, kind="stable")
            new = np.zeros(n, np.int64)
            new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
            rank = new
            width *= 2
            if n == 0 or rank[order[-1]] == n - 1 or width >= n:
                break
        before = text[order - 1] + 1  # the text ends with a break, so position 0 follows one
        self.n = n
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text + 1, minlength=symbols + 1))))
        start_of_run = np.concatenate(([True], breaks[:-1]))
        keep = start_of_run | (np.arange(n) % SAMPLE == 0)
        self.sampled = keep[order]
        self.suffix = np.where(self.sampled, order, -1)
        self.levels: list[tuple[int, np.ndarray, int]] = []
        symbols_here = before
        for bit in reversed(range(max(1, int(symbols).bit_length()))):
            ones = (symbols_here >> bit) & 1
            counted = np.concatenate(([0], np.cumsum(ones)))
            zeros = n - int(counted[-1])
            self.levels.append((bit, counted, zeros))
            symbols_here = np.concatenate((symbols_here[ones == 0], symbols_here[ones == 1]))

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        low = np.zeros_like(place)
        for bit, counted, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            place = np.where(one, zeros + counted[place], place - counted[place])
            low = np.where(one, zeros + counted[low], low - counted[low])
        return place - low

    def step(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix one word longer."""
        symbol, place = np.zeros_like(row), row
        for bit, counted, zeros in self.levels:
            one = counted[place + 1] - counted[place] == 1
            symbol |= one.astype(np.int64) << bit
            place = np.where(one, zeros + counted[place], place - counted[place])
        return self.first[symbol] + self.rank(symbol, row)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the range of rows that begin with each phrase."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in reversed(range(phrases.shape[1])):
            symbol = phrases[live, j] + 1
            low[live] = self.first[symbol] + self.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to the next sampled suffix."""
        out = np.zeros(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            here = self.sampled[rows[todo]]
            out[todo[here]] = self.suffix[rows[todo[here]]] + steps
            todo = todo[~here]
            rows[todo] = self.step(rows[todo])
            steps += 1
        return out


def hits(hashes: np.ndarray, bounds: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered words of a shard, and the (document, phrase) pairs that occur.

    Words that no test item holds end a run, and runs shorter than the shortest
    phrase go: no phrase fits there, so nothing is lost.
    """
    covered = np.zeros(len(hashes) + 1, np.int64)
    none = np.zeros(0, np.int64)
    if not phrases.shortest or not len(hashes):
        return covered[:-1] > 0, none, none
    ids = np.searchsorted(phrases.vocabulary, hashes)
    ids[ids == len(phrases.vocabulary)] = 0
    known = phrases.vocabulary[ids] == hashes
    edge = np.zeros(len(hashes) + 1, bool)
    edge[bounds] = True
    begins = np.flatnonzero(known & (edge[:-1] | ~np.concatenate(([False], known[:-1]))))
    ends = np.flatnonzero(known & (edge[1:] | ~np.concatenate((known[1:], [False])))) + 1
    long = ends - begins >= phrases.shortest
    begins, ends = begins[long], ends[long]
    if not len(begins):
        return covered[:-1] > 0, none, none
    at = ragged(begins, ends - begins + 1)  # one place more a run, for its break
    lasts = np.cumsum(ends - begins + 1) - 1
    text = ids[np.minimum(at, len(ids) - 1)].astype(np.int64)
    text[lasts] = -1
    index = Index(text, len(phrases.vocabulary))
    docs, found = [], []
    for size, rows, first in phrases.by_length:
        low, high = index.search(rows)
        which = np.repeat(np.arange(len(rows)), high - low)
        starts = at[index.locate(ragged(low, high - low))]
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + size, -1)
        docs.append(np.searchsorted(bounds, starts, "right") - 1)
        found.append(first + which)
    return np.cumsum(covered[:-1]) > 0, np.concatenate(docs), np.concatenate(found)


def contamination(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """One row per input row: id, n_words, n_hit, items (sorted strings), spans (first word, end) of what is hit.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A
    test item gives its windows of `window` words, or itself if it is shorter;
    a document word inside any occurrence is hit. Documents are read once and
    never shuffled: each task indexes its texts shard by shard. Test items are
    dealt into blocks of a bounded size, each sent to the tasks by itself; the
    driver holds one block at a time.

    Null texts have no words, items without words no windows. Windows of items
    whose id is null are removed like all others, but have no name to list.
    Items that repeat an id are one item. Rows that repeat an id are judged
    each by itself. An empty benchmark hits nothing.
    """
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text_col)), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.coalesce(F.col(item_text_col), F.lit("")).alias("t")).distinct()
    sent = [
        spark.sparkContext.broadcast([(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).orderBy("i", "t").collect()])
        for b in range(blocks)
    ]
    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", span)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = {}
        for batch in batches:
            for part in slices(batch.column(1), ALNUM, size=shard_bytes):
                hashes, n = part.hashes(), len(part.bounds) - 1
                covered = np.zeros(len(hashes), bool)
                names: list[set[str]] = [set() for _ in range(n)]
                for b, block in enumerate(sent):
                    if len(sent) > 1:  # one block at a time in memory
                        phrases = {b: phrases[b]} if b in phrases else {}
                    if b not in phrases:
                        phrases[b] = Phrases(block.value, window)
                    p = phrases[b]
                    mask, where, which = hits(hashes, part.bounds, p)
                    covered |= mask
                    for d, k in np.unique(np.stack([where, which], 1), axis=0).tolist() if len(where) else []:
                        names[d].update(p.names[o] for o in p.owners[k])
                total = np.concatenate(([0], np.cumsum(covered)))
                edges = np.diff(np.concatenate(([False], covered, [False])).astype(np.int8))
                inner = np.zeros(len(edges), bool)
                inner[part.bounds] = True
                joined = inner[1:-1] & covered[:-1] & covered[1:] if len(covered) else np.zeros(0, bool)
                extra = np.flatnonzero(joined) + 1
                firsts = np.sort(np.concatenate((np.flatnonzero(edges == 1), extra)))
                lasts = np.sort(np.concatenate((np.flatnonzero(edges == -1), extra)))
                owner = np.searchsorted(part.bounds, firsts, "right") - 1
                offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
                base = part.bounds[owner]
                pairs = pa.StructArray.from_arrays([pa.array(firsts - base), pa.array(lasts - base)], ["first", "end"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, n), pa.array(np.diff(part.bounds).astype(np.int64)), pa.array(total[part.bounds[1:]] - total[part.bounds[:-1]]),
                        pa.array([sorted(x) for x in names], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(offsets), pairs),
                    ],
                    schema.names,
                )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(releasing(run), schema)


def contaminated(n_hit="n_hit", n_words="n_words"):
    """At least a twentieth of the words, and one, are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
