"""Vectorised words of whole texts: one numpy pass over the bytes of an Arrow batch.

``word_stream`` splits every text of a batch into words and gives each word a
64-bit hash. The hash of a word is a polynomial over its (case-folded) bytes,
read off running sums, so no Python object is made per word. All constants are
fixed by a seeded rule: the same word has the same hash on every executor.

Hashes stand in for words. Two different words share a hash with a chance of
about 2**-64 per pair of words.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_ONE = np.uint64(1)


def _mixed(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants from a seeded generator."""
    return np.random.default_rng(seed).integers(0, 2 ** 64, n, dtype=np.uint64) | _ONE


_TABLE = _mixed(256, 20250101)
_BASE = int(_mixed(1, 7)[0])
_BASE_INV = pow(_BASE, -1, 2 ** 64)
_SEEDS = _mixed(64, 99)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_FOLDED = _TABLE[_FOLD]

#: separators of words [^\x20\x09-\x0D]+
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: separators of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[128:] = False
for _lo, _hi in ((ord("0"), ord("9")), (ord("A"), ord("Z")), (ord("a"), ord("z"))):
    NOT_ALNUM[_lo:_hi + 1] = False

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for ``n`` positions."""
    if "up" not in _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            step = np.full(n, base, dtype=np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bit mixer (splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def seeded(h: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of the same items, one of 64 independent ones."""
    return mix(h + _SEEDS[seed])


@dataclass
class Words:
    """Words of a batch: hash, byte span in ``data``, and per text the range of its words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # first[i]:first[i+1] are the words of text i
    data: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = texts.cast(pa.large_string()).fill_null("")
    _, off, data = texts.buffers()
    n = len(texts)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> Words:
    """Words of texts that lie one after another in ``data``."""
    n = len(data)
    if n == 0:
        return spans_of(data, offsets, np.zeros(0, bool), np.zeros(0, bool))
    sep = separators[data]
    begin = np.empty(n, bool)
    begin[0] = True
    begin[1:] = sep[:-1]
    cut = offsets[1:-1]
    begin[cut[cut < n]] = True
    begin &= ~sep
    # a word ends before a separator, before the next text, or with the data
    stop = np.empty(n, bool)
    stop[-1] = True
    stop[:-1] = sep[1:]
    stop[(cut - 1)[(cut > 0)]] = True
    stop &= ~sep
    return spans_of(data, offsets, begin, stop)


def spans_of(data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> Words:
    """Words whose first and last bytes are flagged."""
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            lo = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, lo + CHUNK_BYTES, side="right")))
            hi = ends[j - 1]
            up, down = _power(max(CHUNK_BYTES, int(hi - lo)) + 1)
            run = np.empty(hi - lo + 1, np.uint64)
            run[0] = 0
            np.cumsum(_FOLDED[data[lo:hi]] * up[:hi - lo], out=run[1:])
            a, b = starts[i:j] - lo, ends[i:j] - lo
            hashes[i:j] = (run[b] - run[a]) * down[a]
            i = j
        hashes = mix(hashes)
    first = np.searchsorted(starts, offsets)
    return Words(hashes, starts, ends, first, data, offsets)


def word_stream(texts: pa.Array, separators: np.ndarray = SPACE) -> Words:
    """Words of every text of an Arrow string array (A-Z folded for the hash)."""
    return words_of(*text_buffers(texts), separators)


def windows(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words (len - k + 1 of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out *= np.uint64(_BASE)
            out += hashes[j:j + n]
        return mix(out + _SEEDS[seed] * np.uint64(2 * k + 1))


def slices(offsets: np.ndarray, limit: int):
    """Ranges (i, j) of consecutive texts of at most ``limit`` bytes together, one text at least."""
    n = len(offsets) - 1
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = j


def release_memory() -> None:
    """Give freed memory back at the end of a task: Spark keeps idle Python workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass
