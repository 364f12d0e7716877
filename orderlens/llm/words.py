"""Words, word hashes and shingle hashes of a batch of texts, vectorised over the whole batch.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r, taken over the UTF-8 bytes of the
text, which is the pattern ``[^\\x20\\x09-\\x0D]+``. Null texts have no words. Hashes are 64 bit and
depend on the bytes alone, so they agree between tasks, retries and runs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20260101))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
BASE = int(_rng.integers(2**40, 2**63)) | 1
BASE_INVERSE = pow(BASE, -1, 2**64)
PLACE = _rng.integers(2**40, 2**63, 64, dtype=np.uint64) | U64(1)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Bytes hashed at a time: bounds the 8-byte-per-byte working arrays.
STEP = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def unique(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting, which for integers is much faster than numpy's hashing)."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, U64(base), dtype=np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = powers(BASE, STEP + 1), powers(BASE_INVERSE, STEP + 1)


class Words:
    """Words of a list of texts: ``starts``/``ends`` are byte ranges in ``buf``; text ``i`` owns the
    words ``off[i]:off[i + 1]`` and the bytes ``byte_off[i]:byte_off[i + 1]``."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        texts = pc.fill_null(texts, "")
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        self.buf = LOWER[raw] if lower else raw
        self.byte_off = off - off[0]
        word = ~IS_SPACE[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[self.byte_off] = True  # a text ends here, so does a word
        before = np.concatenate(([False], word[:-1])) if len(raw) else word
        after = np.concatenate((word[1:], [False])) if len(raw) else word
        self.starts = np.flatnonzero(word & (~before | cut[:-1]))
        self.ends = np.flatnonzero(word & (~after | cut[1:])) + 1
        self.off = np.searchsorted(self.starts, self.byte_off)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends)

    def text(self, word: int) -> bytes:
        return self.buf[self.starts[word]:self.ends[word]].tobytes()


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; spans ascend and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            at = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, at + STEP, "right")))
            size = int(ends[j - 1] - at)
            up, down = (_UP, _DOWN) if size <= STEP else (powers(BASE, size + 1), powers(BASE_INVERSE, size + 1))
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(BYTE_CODE[buf[at:at + size]] * up[:size], dtype=np.uint64, out=sums[1:])
            s, e = starts[i:j] - at, ends[i:j] - at
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            i = j
    return out


def shingle_hashes(words: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles and where each text's begin (length texts + 1).

    A text with fewer than n words, but one at least, has its whole sequence as one shingle.
    """
    counts = np.diff(off)
    out_off = np.concatenate(([0], np.cumsum(np.where(counts >= n, counts - n + 1, counts > 0))))
    first = np.repeat(off[:-1] - out_off[:-1], np.diff(out_off)) + np.arange(out_off[-1])
    have = np.repeat(np.minimum(counts, n), np.diff(out_off))
    padded = np.concatenate((words, np.zeros(n, np.uint64)))
    with np.errstate(over="ignore"):
        total = have.astype(np.uint64) * PLACE[63]
        short = bool((have < n).any())
        for k in range(n):
            part = padded[first + k] * PLACE[k]
            total += np.where(have > k, part, U64(0)) if short else part
        return mix(total), out_off


def give_back() -> None:
    """Returns freed memory to the system: workers stay between tasks and stages, and what one has freed
    counts against the next one's limit."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def text_chunks(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; a longer text is a slice by itself."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(sizes)))
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
    give_back()
