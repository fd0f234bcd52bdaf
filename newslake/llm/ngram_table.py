"""Interning of byte strings of one buffer in an open-addressed numpy table, and its hashes, all by whole columns."""

from __future__ import annotations

import zlib

import numpy as np
import xxhash

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Bytes that a buffer needs after its last string, so that whole words can be read anywhere.
PADDING = 8
#: Strings from here on are hashed one by one.
_LONG = 32


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _view(buffer: np.ndarray, kind: type) -> np.ndarray:
    """The little-endian integer that starts at each byte of the buffer (unaligned)."""
    return np.ndarray(len(buffer) - np.dtype(kind).itemsize + 1, np.dtype(kind).newbyteorder("<"), buffer, strides=(1,))


def xxhash64(buffer: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of buffer[start : start + size] for each pair; the public definition, step by step over columns."""
    words, halves, n = _view(buffer, np.uint64), _view(buffer, np.uint32), size.astype(np.int64)
    h, at, end = _P5 + size.astype(np.uint64), start.astype(np.int64), start + n
    short = n < _LONG
    for step in range(_LONG // 8 - 1):
        k = np.flatnonzero(short & (n >= 8 * step + 8))
        if not len(k):
            break
        lane = _rotated(words[at[k]] * _P2, 31) * _P1
        h[k] = _rotated(h[k] ^ lane, 27) * _P1 + _P4
        at[k] += 8
    k = np.flatnonzero(short & (end - at >= 4))
    h[k] = _rotated(h[k] ^ halves[at[k]].astype(np.uint64) * _P1, 23) * _P2 + _P3
    at[k] += 4
    for _ in range(3):
        k = np.flatnonzero(short & (end > at))
        if not len(k):
            break
        h[k] = _rotated(h[k] ^ buffer[at[k]].astype(np.uint64) * _P5, 11) * _P1
        at[k] += 1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    whole = memoryview(buffer)
    for i in np.flatnonzero(~short).tolist():
        h[i] = xxhash.xxh64_intdigest(whole[start[i] : start[i] + n[i]])
    return h


def _same(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes from a equal those from b, eight at a time."""
    words, same = _view(buffer, np.uint64), np.ones(len(a), bool)
    live, done = np.arange(len(a)), 0
    while len(live):
        left = np.minimum(size[live] - done, 8)
        drop = ((8 - left) * 8).astype(np.uint64)  # the bytes after the string's end
        same[live] &= (words[a[live] + done] ^ words[b[live] + done]) << drop == 0
        done += 8
        live = live[same[live] & (size[live] > done)]
    return same


def crc32(buffer: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    whole = memoryview(buffer)
    pairs = zip(start.tolist(), (start + size).tolist(), strict=True)
    return np.fromiter((zlib.crc32(whole[a:b]) for a, b in pairs), np.int64, len(start))


class Table:
    """The different strings of a batch: slots with key, first occurrence, bucket and count; `slot` of each occurrence.

    A string probes from its xxhash64 on, slot by slot. A free slot goes to one of the strings that reach it at once; at a
    taken slot a string stays if key, length and bytes are those of the slot's, and else goes on to the next.
    """

    def __init__(self, buffer: np.ndarray, start: np.ndarray, size: np.ndarray, buckets: int):
        n = len(start)
        capacity = 1 << max(4, (2 * n).bit_length())  # at most half full
        mask = np.uint64(capacity - 1)
        keys = xxhash64(buffer, start, size)
        self.first = np.full(capacity, -1, np.int64)
        self.slot = np.empty(n, np.int64)
        live = np.arange(n)
        at = (keys & mask).astype(np.int64)
        while len(live):
            free = self.first[at] < 0
            self.first[at[free]] = live[free]  # of several, the last written has it
            other = self.first[at]
            stays = (keys[other] == keys[live]) & (size[other] == size[live])
            stays[stays] = _same(buffer, start[live[stays]], start[other[stays]], size[live[stays]])
            self.slot[live[stays]] = at[stays]
            live, at = live[~stays], (at[~stays] + 1) & (capacity - 1)
        self.used = np.flatnonzero(self.first >= 0)
        owner = self.first[self.used]
        self.bucket = np.zeros(capacity, np.int64)
        self.bucket[self.used] = crc32(buffer, start[owner], size[owner]) % buckets
        self.count = np.bincount(self.slot, minlength=capacity)

    def by_bucket(self, buckets: int) -> np.ndarray:
        """Occurrences by bucket."""
        out = np.zeros(buckets, np.int64)
        np.add.at(out, self.bucket[self.used], self.count[self.used])
        return out

    def gathered(self, by_bucket: np.ndarray) -> np.ndarray:
        """The value of each occurrence's bucket, through its slot."""
        return by_bucket[self.bucket][self.slot]
