"""Words and rolling fingerprints of many texts at once, as numpy arrays over an Arrow text column.

A text is its UTF-8 bytes. Words are runs of bytes that a 256-entry table calls
word bytes; every separator of the word rules used here is ASCII, so bytes and
code points give the same words. A fingerprint is a polynomial in an odd base
modulo 2**64, then mixed; equal sequences have equal fingerprints, and two
different ones agree with a chance near 2**-64. Nulls read as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xD6E8FEB86659FD93 | 1
#: Texts are worked on in slices of about so many bytes; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20

#: `[^\x20\x09-\x0D]+`
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2**64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.empty(size, np.uint64)
        out[0] = 1
        filled = 1
        while filled < size:
            out[filled : 2 * filled] = out[:filled] * np.uint64(pow(base, filled, 1 << 64))
            filled *= 2
        _POWERS[base] = have = out
    return have[:n]


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of batches; when a task ends, its worker, which waits for the next task, gives memory back."""

    def through(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _POWERS.clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return through


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Fingerprint of values[start:end] for each start and end."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(base, n), out=total[1:])
    sums = (total[ends] - total[starts]) * powers(inverse(base), n + 1)[starts]
    return mix(sums ^ ((ends - starts).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)))


class Slice:
    """The words of some consecutive texts.

    first, last: rows of the batch; starts, ends: byte places of the words in
    data; bounds: words of text i are bounds[i]:bounds[i + 1].
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, last: int, table: np.ndarray, lower: bool):
        self.first, self.last = first, last
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        word = np.zeros(len(data) + 2, bool)
        word[1:-1] = table[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        self.starts = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        return rolled(self.data, self.starts, self.ends, BASE)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the k-word sequences, text by text, and each one's first word."""
        n = np.maximum(self.counts() - k + 1, 0)
        at = ragged(self.bounds[:-1], n)
        return rolled(hashes, at, at + k, WORD_BASE), at


def ragged(firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each pair, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    steps = np.ones(total, np.int64)
    full = np.flatnonzero(lengths)
    heads = np.concatenate(([0], np.cumsum(lengths[full])[:-1]))
    steps[heads] = firsts[full]
    steps[heads[1:]] -= firsts[full[:-1]] + lengths[full[:-1]] - 1
    return np.cumsum(steps)


def binary(column) -> pa.Array:
    out = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(out.cast(pa.binary()), b"")


def slices(column, table: np.ndarray = NOT_SPACE, lower: bool = True, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a column, in slices."""
    texts = binary(column)
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield Slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i, j, table, lower)
        i = j
