"""Packing by Karmarkar-Karp multiway differencing over the real token counts."""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Slice, binary, ragged, releasing, slices

CAPACITY = 4096
#: Documents that are packed together; a task packs its rows group by group.
GROUP_DOCS = 512
#: Longest piece that differencing moves; a longer rest of a document is cut into equal parts.
MAX_PIECE = 1024
#: A worker keeps the ids of the first so many words and parts of words, which the frequent ones are among.
#: Longer words are encoded each time; texts are worked on in slices of about SLICE_BYTES.
CACHED_BYTES, CACHED_WORDS, CACHED_PARTS = 48, 800_000, 400_000
SLICE_BYTES = 2 << 20
END_ID = 2

_ENCODERS: dict[str, Encoder] = {}
#: Words of these characters alone are split here, as the vocabulary's own splitter does after lower-casing.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\\[-`{-~]+")
#: Texts on which the two short cuts are tried before they are used with a vocabulary.
_PROBES = ("It's  a\n\tTEST,### of\x0bthings...l'Été 12ab ÀÖØß", "we'll they'd {x}[y]=\"z\"; #1 ¿", "a|b <|endoftext|> c\u00a0d")


class Encoder:
    """Token ids of whole texts, the end id included, as little-endian unsigned 32-bit integers.

    Where a vocabulary drops white space and never joins what stands on both
    sides of it, a text's ids are its words' ids one after another, and frequent
    words are encoded once; plain words are taken apart here and only their
    parts go to the vocabulary's model. Each short cut is used only if it agrees
    with the vocabulary on the probes; else whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: How the model spells the bytes of letters beyond ASCII.
        self.shown = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(0xC0, 0x100)}
        self.spelled = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.end = np.array([END_ID], "<u4").tobytes()
        self.words: dict[int, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.plain = all(self.plain_word(w) == self.whole(w) for x in _PROBES for w in x.split() if _PLAIN.fullmatch(w) and "<|" not in w)
        self.by_words = all(b"".join(self.whole(w.decode()) for w in x.encode().split()) == self.whole(x) for x in _PROBES)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, text: str) -> bytes:
        found = self.parts.get(text)
        if found is None:
            shown = text if text.isascii() else text.translate(self.shown)
            spelled = self.spelled
            found = b"".join([spelled[t.id] for t in self.tokenizer.model.tokenize(shown)])
            if len(self.parts) < CACHED_PARTS:
                self.parts[text] = found
        return found

    def plain_word(self, word: str) -> bytes:
        return b"".join(map(self.part, _PARTS.findall(word.lower())))

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        if len(word) <= CACHED_BYTES and self.plain and _PLAIN.fullmatch(text) and "<|" not in text:
            return self.plain_word(text)
        return self.whole(text)

    def known(self, part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a slice's different words one after another, where each begins, how many it has, and which of them
        each word of the slice is. Words are told apart by 64-bit fingerprints."""
        marks, first, which = np.unique(part.hashes(), return_index=True, return_inverse=True)
        names = marks.tolist()
        found = list(map(self.words.get, names))
        starts, ends, data = part.starts, part.ends, part.data
        for i, x in enumerate(found):
            if x is None:
                at = first[i]
                found[i] = x = self.word(data[starts[at] : ends[at]].tobytes())
                if len(self.words) < CACHED_WORDS and len(x) <= CACHED_BYTES:
                    self.words[names[i]] = x
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes, sizes, which

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text."""
        if not self.by_words:
            return [self.whole((t.as_py() or b"").decode()) + self.end for t in binary(texts)]
        out = []
        for part in slices(texts, lower=False, size=SLICE_BYTES):
            flat, begin, sizes, which = self.known(part)
            lengths = sizes[which]
            tokens = flat[ragged(begin[which], lengths)]
            cuts = np.concatenate(([0], np.cumsum(lengths)))[part.bounds].tolist()
            out += [tokens[x:y].tobytes() + self.end for x, y in zip(cuts, cuts[1:], strict=False)]
        return out


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def differencing(lengths: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k - 1) of each item, near-equal in sums.

    Every item starts as a partial partition into k windows, one of them
    filled. The two partial partitions with the largest spread are merged, the
    fullest windows of one with the emptiest of the other, and what all windows
    have in common is taken off, until one partition is left.
    """
    n = len(lengths)
    heap = []
    for i in range(n):
        sums = np.zeros(k, np.int64)
        sums[0] = lengths[i]
        nodes = np.full(k, -1, np.int64)
        nodes[0] = i
        heap.append((-int(lengths[i]) if k > 1 else 0, i, sums, nodes))
    heapq.heapify(heap)
    merges, fresh = [], n
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        right = right[::-1]
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums, left, right = sums[order], left[order], right[order]
        both = (left >= 0) & (right >= 0)
        count = int(both.sum())
        nodes = np.where(left >= 0, left, right)
        nodes[both] = np.arange(fresh, fresh + count)
        merges.append((fresh, left[both], right[both]))
        fresh += count
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), n + len(merges), sums - sums[-1], nodes))
    label = np.zeros(fresh + 1, np.int64)
    last = heap[0][3]
    label[last[last >= 0]] = np.flatnonzero(last >= 0)
    for first, left, right in reversed(merges):
        label[left] = label[right] = label[first : first + len(left)]
    return label[:n]


def windows(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The window of each item and the number of windows; one more is tried whenever one would hold too much."""
    k = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        at = differencing(lengths, k)
        if np.bincount(at, weights=lengths, minlength=k).max() <= capacity:
            return at, k
        k += 1


def plan(counts: list[int], capacity: int, max_piece: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, window, offset) of every piece of some documents. Whole windows are cut off long
    documents first, the rest goes through differencing."""
    out, rest, window = [], [], 0
    for d, n in enumerate(counts):
        full = n // capacity
        for i in range(full):
            out.append((d, i * capacity, capacity, window, 0))
            window += 1
        if left := n - full * capacity:
            parts = -(-left // max_piece)
            cuts = [full * capacity + left * i // parts for i in range(parts + 1)]
            rest += [(d, a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    if rest:
        lengths = np.array([x[2] for x in rest], np.int64)
        at, k = windows(lengths, capacity)
        filled = [0] * k
        for (d, start, n), w in zip(rest, at.tolist(), strict=True):
            out.append((d, start, n, window + w, filled[w]))
            filled[w] += n
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, max_piece: int = MAX_PIECE) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each task encodes its rows and packs them in groups of group_docs, without
    a shuffle: groups hold enough pieces for near-equal windows, and no group
    grows with the data. Sequence ids carry the partition's number, so a rerun
    of a lost task gives the same rows. Null texts count as empty; an empty
    text is its end id alone. Rows that repeat an id are packed each for
    itself. An empty table gives no pieces.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField(id_col, kind)]
        + [T.StructField(n, T.LongType()) for n in ("start", "length")]
        + [T.StructField("ids", T.BinaryType())]
        + [T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).ids
        first = TaskContext.get().partitionId() << 32
        names, held = [], []

        def flush():
            nonlocal first
            pieces = plan([len(x) // 4 for x in held], capacity, max_piece)
            d, start, n, window, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            ids = [held[i][4 * a : 4 * (a + b)] for i, a, b, *_ in pieces]
            total = np.array([len(x) // 4 for x in held], np.int64)[d]
            out = [pa.concat_arrays(names).take(pa.array(d)), start, n, pa.array(ids, pa.binary()), total, first + window, offset]
            first += int(window.max()) + 1
            names.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], schema.names)

        for batch in batches:
            for i in range(0, batch.num_rows, group_docs):
                part = batch.slice(i, group_docs)
                for k, ids in enumerate(encode(part.column(1))):
                    names.append(part.column(0).slice(k, 1))
                    held.append(ids)
                    if len(held) == group_docs:
                        yield flush()
        if held:
            yield flush()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(releasing(run), schema)
