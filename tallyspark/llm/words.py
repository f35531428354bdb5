"""Hashes of words and word windows over whole batches of texts, with numpy.

Words are maximal runs of bytes that are not separators. A word's hash is a polynomial of its
bytes modulo 2**64; a window's is the same polynomial (Rabin-Karp) of its word hashes. Both come
from prefix sums, so a window of any length costs the same.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: [^\x20\x09-\x0D]+
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case
NON_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_BASE, _WINDOW_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes hashed at once.
BLOCK = 1 << 18
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            done = 1
            while done < size:
                p[done : 2 * done] = p[:done] * np.uint64(pow(b, done, 1 << 64))
                done *= 2
            out.append(p)
        have = _powers[base] = (out[0], out[1])
    return have


class Spans:
    """Hashes of values[start:end] for any start and end."""

    def __init__(self, values: np.ndarray, base: int):
        up, self.down = powers(base, len(values))
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.total[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.total[end] - self.total[start]) * self.down[start]
        return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)))


class Words:
    """The words of some texts: hash has a value per word, bounds the words of text i as bounds[i]:bounds[i + 1].

    Bytes are hashed in blocks of BLOCK that end behind a word, so that what is needed besides start, end and hash
    doesn't grow with the texts (but with the longest word).
    """

    def __init__(self, texts: list[bytes], separators: bytes):
        joined = separators[:1].join([*texts, b""]) if texts else b""
        raw = self.raw = np.frombuffer(joined, np.uint8)
        table = np.zeros(256, bool)
        table[list(separators)] = True
        starts, ends, hashes, at = [], [], [], 0
        while at < len(raw):
            stop = min(at + BLOCK, len(raw))
            while stop < len(raw) and not table[raw[stop - 1]]:
                gap = table[raw[stop : stop + BLOCK]]
                stop += int(gap.argmax()) + 1 if gap.any() else len(gap)
            part = raw[at:stop]
            inside = np.concatenate([[False], ~table[part], [False]])
            edge = np.flatnonzero(inside[1:] != inside[:-1])
            start, end = edge[0::2], edge[1::2]
            hashes.append(Spans(_VALUES[part], _BASE).hash(start, end))
            starts.append(start + at)
            ends.append(end + at)
            at = stop
        self.start, self.end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        cut = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.bounds = np.concatenate([[0], np.searchsorted(self.start, cut)]).astype(np.int64)

    def spelled(self, which: np.ndarray) -> tuple[Spans, np.ndarray, np.ndarray]:
        """The bytes of some words one after another, and where each begins and ends in them."""
        size = self.end[which] - self.start[which]
        end = np.cumsum(size)
        start = end - size
        return Spans(_VALUES[self.raw[np.arange(end[-1] if len(end) else 0) + np.repeat(self.start[which] - start, size)]], _BASE), start, end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def windows(self, size: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of `size` words and the bounds of each text's.

        short: a text of fewer words, but not none, has its whole sequence as its only window.
        """
        n = self.counts
        many = np.maximum(n - size + 1, 0)
        if short:
            many = np.where((n > 0) & (n < size), 1, many)
        bounds = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
        start = np.arange(bounds[-1]) + np.repeat(self.bounds[:-1] - bounds[:-1], many)
        end = start + np.repeat(np.minimum(n, size), many)
        return Spans(self.hash, _WINDOW_BASE).hash(start, end), bounds

    def whole(self) -> np.ndarray:
        """A hash of each text's sequence of words; 0 for no words."""
        h = Spans(self.hash, _WINDOW_BASE).hash(self.bounds[:-1], self.bounds[1:])
        return np.where(self.counts > 0, h, np.uint64(0))


def chunks(rows: Iterable[tuple], size: int = 1_800_000, at: int = -1) -> Iterator[list[tuple]]:
    """Rows in lists of about `size` bytes of text, so that memory doesn't grow with Arrow's batches."""
    out, total = [], 0
    for row in rows:
        out.append(row)
        total += len(row[at]) + 64
        if total >= size:
            yield out
            out, total = [], 0
    if out:
        yield out


def release() -> None:
    """Give memory that this worker's earlier tasks left unused back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def batch_rows(batches, *names: str) -> Iterator[tuple]:
    """Tuples of the named columns of Arrow batches; the last one is a text, null read as empty."""
    release()
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for i in range(0, batch.num_rows, 256):
            values = [c.slice(i, 256).to_pylist() for c in columns]
            values[-1] = [t if t is not None else b"" for t in values[-1]]
            yield from zip(*values, strict=True)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers; quicker by sorting than np.unique is."""
    v = np.sort(values)
    return v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v


def pack(values: np.ndarray) -> bytes:
    """Bytes by place value, all lowest bytes first: sorted or small numbers then compress well."""
    v = np.ascontiguousarray(values)
    return v.view(np.uint8).reshape(-1, v.itemsize).T.tobytes() if len(v) else b""


def unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def key_of(doc_id: int | None) -> int:
    """An id as a number that sorts a null last."""
    return doc_id if doc_id is not None else (1 << 63) - 1
