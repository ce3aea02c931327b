"""Token counts by rank-synchronous merging of ragged numpy arrays.

A text becomes pre-tokens: runs of blanks with what follows them, since no piece
of the vocabulary holds a blank behind another character. The different
pre-tokens of a block lie one after another in one array of symbols. In each
step every sequence finds its lowest rank and merges the pairs of that rank, all
sequences at once; what survives is counted. The result is that of merging one
pair at a time, lowest rank first and leftmost among equals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import BASE, binary, ragged, rolled

LIMIT = 4096
#: Texts are worked on in blocks of about so many bytes, cut between pre-tokens, also inside a text.
BLOCK_BYTES = 2 << 20
#: A worker keeps the counts of the first so many different pre-tokens (12 bytes each), which the frequent ones are among.
KEPT = 1_000_000
#: How a vocabulary of this kind spells a blank.
BLANK = "▁"
_NONE = np.int32(2**31 - 1)

_MERGERS: dict[str, Merger] = {}


def utf8_length(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)


class Merger:
    """Pairs of a sentencepiece BPE vocabulary with byte fallback, as sorted arrays.

    Symbols: the characters of the pieces, then the longer pieces, then four
    that stand for characters of 1 to 4 bytes outside the vocabulary, which
    never merge and count as their bytes. A pair is any two symbols that
    together spell a piece; its rank is the place of the piece's score.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        ordinary = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        if any(model.is_unused(i) for i in every) or sum(map(model.is_byte, every)) != 256:
            raise ValueError(f"{path}: only vocabularies with byte fallback and without unused pieces are counted")
        score = {model.id_to_piece(i): model.get_score(i) for i in ordinary}
        chars = sorted({c for p in score for c in p} | {BLANK})
        longer = [p for p in score if len(p) > 1]
        symbol = {s: i for i, s in enumerate(chars + longer)}
        self.size = len(symbol) + 4
        self.weight = np.ones(self.size, np.int64)
        for c in chars:
            if c not in score:
                self.weight[symbol[c]] = len(c.encode())
        self.weight[-4:] = 1, 2, 3, 4
        places = {s: i for i, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = []
        for p in longer:
            for i in range(1, len(p)):
                if p[:i] in symbol and p[i:] in symbol:
                    pairs.append((symbol[p[:i]] * self.size + symbol[p[i:]], places[score[p]], symbol[p]))
        table = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.made = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        points = np.arange(0x110000)
        self.symbols = (len(symbol) - 1 + utf8_length(points)).astype(np.int32)
        self.symbols[[ord(c) for c in chars]] = np.arange(len(chars))
        self.symbols[0x20] = symbol[BLANK]
        #: Whether pieces keep to pre-tokens; if not, a text is one pre-token.
        self.cuts = not any(BLANK in p.lstrip(BLANK) for p in longer)
        for probe in ("  It's  a\n\ttest ", "x" * 40, " ▁ é́ \x00①😀", "<s> </s> <unk> <0x41>", "ﬁ Å １"):
            if self.counts([probe.encode()]) != [len(model.encode(probe))]:
                raise ValueError(f"{path}: the vocabulary changes texts in a way that is not counted here")

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and the symbol it becomes."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], _NONE), self.made[at]

    def survivors(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each sequence; lengths are at least 1."""
        out = np.zeros(len(lengths), np.int64)
        names = np.arange(len(lengths))
        ends = np.cumsum(lengths)
        rank, made = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int32)
        if len(symbols) > 1:
            rank[:-1], made[:-1] = self.pair(symbols[:-1], symbols[1:])
            rank[ends - 1] = _NONE
        while len(names):
            starts = ends - lengths
            low = np.minimum.reduceat(rank, starts)
            done = low == _NONE
            if done.any():
                out[names[done]] = np.add.reduceat(self.weight[symbols], starts)[done]
                left = np.repeat(~done, lengths)
                symbols, rank, made = symbols[left], rank[left], made[left]
                names, lengths, low = names[~done], lengths[~done], low[~done]
                ends = np.cumsum(lengths)
                if not len(names):
                    break
            of = np.repeat(np.arange(len(names)), lengths)
            at = np.flatnonzero(rank == low[of])
            # Of overlapping pairs in a row, every second one from the left.
            head = np.concatenate(([True], np.diff(at) != 1))
            at = at[(at - at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]) % 2 == 0]
            new, seq = made[at], of[at]
            # Neighbours as they are when a pair's turn comes: merged on the left, not yet on the right.
            close = np.concatenate(([False], (np.diff(at) == 2) & (seq[1:] == seq[:-1])))
            before = np.where(close, at - 2, at - 1)
            has_left = at > (ends - lengths)[seq]
            has_right = at + 2 < ends[seq]
            left = np.where(close, np.concatenate((new[:1], new[:-1])), symbols[np.maximum(at - 1, 0)])
            rank_left, made_left = self.pair(left, new)
            rank_left = np.where(has_left, rank_left, _NONE)
            rank_right, made_right = self.pair(new, symbols[np.minimum(at + 2, len(symbols) - 1)])
            rank_right = np.where(has_right, rank_right, _NONE)
            # A pair that calls for another merge first ends its sequence's step.
            first = np.minimum(rank_left, rank_right) <= low[seq]
            if first.any():
                stop = np.full(len(names), len(symbols))
                np.minimum.at(stop, seq[first], at[first])
                stay = at <= stop[seq]
                at, new, seq, before, has_left = at[stay], new[stay], seq[stay], before[stay], has_left[stay]
                rank_left, made_left, rank_right, made_right = rank_left[stay], made_left[stay], rank_right[stay], made_right[stay]
            symbols[at], rank[at], made[at] = new, rank_right, made_right
            rank[before[has_left]], made[before[has_left]] = rank_left[has_left], made_left[has_left]
            left = np.ones(len(symbols), bool)
            left[at + 1] = False
            symbols, rank, made = symbols[left], rank[left], made[left]
            lengths = lengths - np.bincount(seq, minlength=len(names))
            ends = np.cumsum(lengths)
        return out

    def spelled(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the pre-tokens one after another, and how many each has."""
        flat = data[ragged(starts, ends - starts)]
        points = np.frombuffer(flat.tobytes().decode().encode("utf-32-le"), np.uint32)
        heads = np.concatenate(([0], np.cumsum((flat & 0xC0) != 0x80)))
        cuts = heads[np.concatenate(([0], np.cumsum(ends - starts)))]
        return self.symbols[points], np.diff(cuts)

    def counts(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text, without help of earlier counts."""
        return Counter(self, 0).counts(pa.array(texts, pa.binary())).tolist()


class Counter:
    """Counts texts, and keeps the counts of pre-tokens that it met."""

    def __init__(self, merger: Merger, kept: int = KEPT):
        self.merger, self.kept = merger, kept
        self.names, self.tokens = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of a binary column. A text with content starts with one more blank."""
        out = np.zeros(len(texts), np.int64)
        held, owners, size = [], [], 0
        for i, text in enumerate(texts):
            data = np.frombuffer(text.as_buffer().to_pybytes().replace(BLANK.encode(), b" "), np.uint8)
            n, a, first = len(data), 0, True
            while a < n:
                b = min(n, a + BLOCK_BYTES)
                if b < n:
                    b = self.cut(data, a, b)
                if first:
                    held.append(np.array([0x20], np.uint8))
                    owners.append((i, 1 + b - a))
                else:
                    owners.append((i, b - a))
                held.append(data[a:b])
                size += b - a + first
                a, first = b, False
                if size >= BLOCK_BYTES:
                    self.block(held, owners, out)
                    held, owners, size = [], [], 0
        if held:
            self.block(held, owners, out)
        return out

    def cut(self, data: np.ndarray, a: int, b: int) -> int:
        """The last place up to b, or else the first behind it, where a pre-token starts."""
        if not self.merger.cuts:
            return len(data)
        step = 1 << 16
        for y in range(b, a, -step):
            part = data[max(a, y - step) : y + 1]
            at = np.flatnonzero((part[1:] == 0x20) & (part[:-1] != 0x20))
            if len(at):
                return max(a, y - step) + int(at[-1]) + 1
        for x in range(b, len(data), step):
            part = data[x : x + step + 1]
            at = np.flatnonzero((part[1:] == 0x20) & (part[:-1] != 0x20))
            if len(at):
                return x + int(at[0]) + 1
        return len(data)

    def block(self, held: list[np.ndarray], owners: list[tuple[int, int]], out: np.ndarray) -> None:
        """Adds the tokens of some stretches of texts, each a row of whole pre-tokens."""
        data = np.concatenate(held)
        rows, sizes = (np.array(x) for x in zip(*owners, strict=True))
        edges = np.cumsum(sizes) - sizes
        start = np.zeros(len(data), bool)
        if self.merger.cuts:
            blank = data == 0x20
            start[1:] = blank[1:] & ~blank[:-1]
        start[edges] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(data))
        names, first, which = np.unique(rolled(data, starts, ends, BASE), return_index=True, return_inverse=True)
        at = np.searchsorted(self.names, names)
        known = np.zeros(len(names), bool)
        if len(self.names):
            known = self.names[np.minimum(at, len(self.names) - 1)] == names
        tokens = np.zeros(len(names), np.int64)
        tokens[known] = self.tokens[at[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            tokens[fresh] = self.merger.survivors(*self.merger.spelled(data, starts[first[fresh]], ends[first[fresh]]))
            keep = fresh[: max(0, self.kept - len(self.names))]
            self.names = np.insert(self.names, at[keep], names[keep])
            self.tokens = np.insert(self.tokens, at[keep], tokens[keep].astype(np.int32))
        stretch = np.searchsorted(edges, starts, "right") - 1
        out += np.bincount(rows[stretch], weights=tokens[which], minlength=len(out)).astype(np.int64)


def merger(path: str) -> Merger:
    """One for each worker process."""
    if path not in _MERGERS:
        _MERGERS[path] = Merger(path)
    return _MERGERS[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than the limit).

    No shuffle: each task counts its own rows. Null and empty texts have no
    bytes and no tokens. Rows that repeat an id, or have none, are counted each
    for itself. Other columns are not read. An empty table gives no rows.
    """
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(merger(tokenizer_path))
        for batch in batches:
            texts = binary(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(counter.counts(texts))], schema.names)

    read = docs.select(F.col(id_col).alias("id"), F.make_valid_utf8(F.col(text_col)).alias("text"))
    counted = read.mapInArrow(run, schema)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
