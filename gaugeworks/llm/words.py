"""Words and hashes over Arrow batches in numpy, without a Python object per word.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. All separators are ASCII, so working on UTF-8 bytes gives
the same words as working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes of text that are worked on at once; a longer document is worked on alone.
WORKING_BYTES = 1 << 20

P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of every slice buf[start:end]; buf has at least 8 bytes of padding after the last slice."""
    size = end - start
    order = np.argsort(np.minimum(size, 32).astype(np.uint8), kind="stable")
    start, size = start[order], size[order]
    out = np.empty(len(order), np.uint64)
    n = int(np.searchsorted(size, 32)) if len(size) and size[-1] >= 32 else len(size)
    if n < len(size):
        raw = buf.data
        out[order[n:]] = [xxhash.xxh64_intdigest(raw[a : a + b], seed) for a, b in zip(start[n:].tolist(), size[n:].tolist(), strict=True)]
        start, size, order = start[:n], size[:n], order[:n]
    words8 = np.ndarray((max(len(buf) - 7, 0),), "<u8", buf, strides=(1,))
    words4 = np.ndarray((max(len(buf) - 3, 0),), "<u4", buf, strides=(1,))
    h = np.uint64(seed) + P5 + size.astype(np.uint64)
    at = start.copy()
    for lane in range(3):
        k = int(np.searchsorted(size, 8 * (lane + 1)))
        if k == n:
            break
        x = words8[at[k:]] * P2
        part = h[k:] ^ (_rotl(x, 31) * P1)
        h[k:] = _rotl(part, 27) * P1 + P4
        at[k:] += 8
    rest = size & 7
    four = np.flatnonzero(rest & 4)
    if len(four):
        part = h[four] ^ (words4[at[four]].astype(np.uint64) * P1)
        h[four] = _rotl(part, 23) * P2 + P3
        at[four] += 4
    for i in range(3):
        one = np.flatnonzero((rest & 3) > i)
        if len(one):
            part = h[one] ^ (buf[at[one] + i].astype(np.uint64) * P5)
            h[one] = _rotl(part, 11) * P1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    out[order] = h
    return out


class Words:
    """The words of several texts: text i has words first[i] to first[i + 1], word j is buf[start[j]:end[j]], and one
    space stands between neighbours."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, lower: bool):
        """raw: all texts with one white-space byte after each; bounds: where each text begins, and the end."""
        space = SPACE[raw]
        after = np.empty(len(raw), bool)  # follows a word's byte
        if len(raw):
            after[0] = False
            np.logical_not(space[:-1], out=after[1:])
        keep = after | ~space
        ends_at = space & after
        kept = raw[keep]
        last = ends_at[keep]
        kept[last] = 0x20
        self.buf = np.concatenate([LOWER[kept] if lower else kept, np.zeros(8, np.uint8)])
        self.end = np.flatnonzero(last)
        self.start = np.concatenate([np.zeros(1, np.int64), self.end[:-1] + 1]) if len(self.end) else np.zeros(0, np.int64)
        where = np.flatnonzero(ends_at)
        self.first = np.searchsorted(where, bounds)
        self.count = np.diff(self.first)

    def of(self) -> np.ndarray:
        """The text of every word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, seed: int = 42) -> np.ndarray:
        return xxh64(self.buf, self.start, self.end, seed)

    def spans(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, last word and number per text of all k-word shingles; a shorter text with words is one shingle."""
        n = np.where(self.count >= k, self.count - k + 1, np.minimum(self.count, 1))
        head = np.repeat(self.first[:-1], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return head, np.minimum(head + k, np.repeat(self.first[1:], n)) - 1, n

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end and number per text of these."""
        head, tail, n = self.spans(k)
        return self.start[head], self.end[tail], n


def texts_of(column: pa.Array | pa.ChunkedArray, budget: int = WORKING_BYTES, between: bytes = b"") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, raw, bounds) for runs of texts of up to budget bytes, `between` (one byte or none) after each; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n, more = len(column), len(between)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    sizes = np.diff(offsets)
    if column.null_count:
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    at = 0
    while at < n:
        total = np.cumsum(sizes[at : at + 4096] + more)
        to = at + max(1, int(np.searchsorted(total, budget, side="right")))
        to = min(to, n)
        bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes[at:to] + more)])
        raw = np.full(int(bounds[-1]), between[0] if more else 0, np.uint8)
        for i in range(at, to):
            raw[bounds[i - at] : bounds[i - at + 1] - more] = data[offsets[i] : offsets[i] + sizes[i]]
        yield at, to, raw, bounds
        at = to


def pieces(column: pa.Array | pa.ChunkedArray, budget: int = WORKING_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The same, each text followed by one line feed."""
    yield from texts_of(column, budget, b"\n")


def word_pieces(column: pa.Array | pa.ChunkedArray, lower: bool = False, budget: int = WORKING_BYTES) -> Iterator[tuple[int, int, Words]]:
    for at, to, raw, bounds in pieces(column, budget):
        yield at, to, Words(raw, bounds, lower)
