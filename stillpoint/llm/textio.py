"""Arrow helpers shared by the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not the GNU library
    _TRIM = None


def tidy() -> None:
    """Give memory that is free back to the system: workers live on between tasks, and share their executor's limit."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batches, column: str = "text", max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about ``max_bytes`` of ``column`` (at least one row); tidies up at both ends."""
    tidy()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        marks = np.cumsum(sizes) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
        del batch
    tidy()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a slice; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


#: Bytes of the keys and values of a worker's cache, beside its bound on their number.
CACHE_BYTES = 16 << 20


class Bounded(dict):
    """A cache of bytes computed on a miss, emptied when it holds ``limit`` entries or ``most_bytes`` of keys."""

    def __init__(self, compute, limit: int = 200_000, most_bytes: int = CACHE_BYTES):
        super().__init__()
        self._compute, self._limit, self._most, self._bytes = compute, limit, most_bytes, 0

    def __missing__(self, key):
        value = self._compute(key)
        self._bytes += len(key)
        if len(self) >= self._limit or self._bytes > self._most:
            self.clear()
            self._bytes = len(key)
        if self._bytes <= self._most:
            self[key] = value
        return value


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, vectorised."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Odd multipliers, one for each place of a shingle.
PLACES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


class WordHasher:
    """64-bit hashes of the words of texts: A-Z lower-cased, split at ASCII white space (space, 9 to 13)."""

    def __init__(self):
        self.cache = Bounded(xxhash.xxh64_intdigest)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of all texts in order, and the number of words of each text."""
        words: list[bytes] = []
        counts = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            # bytes.lower and bytes.split know ASCII only, which is what is meant here
            own = t.encode("utf-8", "surrogatepass").lower().split()
            counts[i] = len(own)
            words += own
        return np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words)), counts

    def shingles(self, texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-word shingles with the index of their text, in order of place.

        A text of 1 to n-1 words has one shingle, its whole sequence; a text without words has none.
        """
        hashes, counts = self.words(texts)
        ends = np.cumsum(counts)
        owner = np.repeat(np.arange(len(texts)), counts)
        total = len(hashes)
        full = np.zeros(0, np.uint64)
        own = np.zeros(0, np.int64)
        if total >= n:
            full = hashes[: total - n + 1] * PLACES[0]
            for k in range(1, n):
                full = full + hashes[k : total - n + 1 + k] * PLACES[k]
            keep = owner[: total - n + 1] == owner[n - 1 :]
            full, own = mix(full[keep]), owner[: total - n + 1][keep]
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            more = np.array([self._whole(hashes[ends[i] - counts[i] : ends[i]], n) for i in short], np.uint64)
            full, own = np.concatenate([full, more]), np.concatenate([own, short])
            order = np.argsort(own, kind="stable")
            full, own = full[order], own[order]
        return full, own

    @staticmethod
    def _whole(words: np.ndarray, n: int) -> np.uint64:
        h = np.uint64((len(words) * 0x9E3779B97F4A7C15 + n) & 0xFFFFFFFFFFFFFFFF)
        with np.errstate(over="ignore"):
            for k, w in enumerate(words):
                h = h + w * PLACES[k]
        return mix(np.array([h], np.uint64))[0]
