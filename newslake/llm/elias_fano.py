"""Elias-Fano sequences and a two-level trie shard over them, kept in one memory-mapped file and searched in place."""

from __future__ import annotations

import json
import mmap
import tempfile

import numpy as np


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) set bit of each 64-bit word."""
    w, k, at = words.copy(), k.astype(np.int64), np.zeros(len(words), np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        low = w & np.uint64((1 << half) - 1)
        n = np.bitwise_count(low).astype(np.int64)
        up = k >= n
        k -= np.where(up, n, 0)
        at += np.where(up, half, 0)
        w = np.where(up, w >> np.uint64(half), low)
    return at


class EliasFano:
    """A non-decreasing sequence of n numbers: l low bits each, packed; high parts in unary, with ranks by 64-bit word."""

    def __init__(self, n: int, l: int, low: np.ndarray, high: np.ndarray):  # noqa: E741
        self.n, self.l, self.low, self.high = n, l, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(ones) else np.zeros(1, np.int64)
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones
        self.at_byte = np.ndarray((max(0, len(low) - 7),), "<u8", buffer=low, strides=(1,)) if len(low) >= 8 else np.zeros(0, "<u8")

    @staticmethod
    def encode(values: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """(head, low bytes, high words) of an ascending uint64 array."""
        n = len(values)
        top = int(values[-1]) if n else 0
        l = max(0, (top // max(1, n)).bit_length() - 1)  # noqa: E741
        low = [np.zeros(0, np.uint8)]
        for i in range(0, n if l else 0, 1 << 18):  # a multiple of 8 values, so that blocks meet at bytes
            some = values[i : i + (1 << 18), None]
            low.append(np.packbits(((some >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
        parts = (values >> np.uint64(l)).astype(np.int64)
        bits = np.zeros(((n + (top >> l) + 2) + 63) // 64 * 64, np.uint8)
        bits[parts + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        return {"n": n, "l": l}, np.concatenate([*low, np.zeros(8, np.uint8)]), high

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        rank = self.ones if ones else self.zeros
        word = np.searchsorted(rank, k, "right") - 1
        w = self.high[word]
        return word * 64 + _select(w if ones else ~w, k - rank[word])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        bit = i * self.l
        return (self.at_byte[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.l) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.l)) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first number not below x, whether it equals x)."""
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        part = (x >> np.uint64(self.l)).astype(np.int64)
        beyond = part > len(self.high) * 64 - self.n - 1
        part = np.where(beyond, 0, part)
        start = np.where(part > 0, self._select(np.maximum(part - 1, 0), False) - (part - 1), 0)
        stop = self._select(part, False) - part
        low, a, b = x & np.uint64((1 << self.l) - 1), start.copy(), stop.copy()
        while (open_ := a < b).any():
            mid = np.where(open_, (a + b) >> 1, 0)
            less = self._low(mid) < low
            a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
        inside = (a < stop) & ~beyond
        equal = np.zeros(len(x), bool)
        equal[inside] = self._low(a[inside]) == low[inside]
        return np.where(beyond, self.n, a), equal


class TrieShard:
    """Contexts (Elias-Fano ids), pointers to their successors, and successors made monotone by a base per context; and
    a quantised probability for each successor. All arrays are views of one buffer."""

    LEVELS = ("contexts", "pointers", "bases", "successors")

    def __init__(self, buffer):
        size = int(np.frombuffer(buffer, "<i8", 1)[0])
        head = json.loads(bytes(buffer[8 : 8 + size]))
        view = lambda k: np.frombuffer(buffer, head[k]["type"], head[k]["count"], head[k]["at"])
        for k in self.LEVELS:
            setattr(self, k, EliasFano(head[k]["n"], head[k]["l"], view(f"{k}.low"), view(f"{k}.high")))
        self.codes = view("codes")

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, codes: np.ndarray) -> bytes:
        """From pairs ascending by (context, word)."""
        edge = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.empty(0, np.int64)
        stop = np.r_[edge[1:], len(context)].astype(np.int64) if len(edge) else edge
        top = word[stop - 1] + np.uint64(1) if len(edge) else word
        bases = np.concatenate([np.zeros(1, np.uint64), np.cumsum(top, dtype=np.uint64)])[: len(edge)]
        run = np.repeat(np.arange(len(edge)), stop - edge)
        levels = {"contexts": context[edge], "pointers": np.r_[edge, len(context)].astype(np.uint64), "bases": bases, "successors": bases[run] + word}
        head, parts = {}, {}
        for k, v in levels.items():
            head[k], parts[f"{k}.low"], parts[f"{k}.high"] = EliasFano.encode(v.astype(np.uint64))
        parts["codes"] = codes.astype("<u2")
        at = 4096
        for k, v in parts.items():
            head[k] = {"type": v.dtype.str, "count": len(v), "at": at}
            at += (v.nbytes + 15) // 8 * 8
        text = json.dumps(head).encode()
        out = bytearray(at)
        out[:8], out[8 : 8 + len(text)] = np.array([len(text)], "<i8").tobytes(), text
        for k, v in parts.items():
            out[head[k]["at"] : head[k]["at"] + v.nbytes] = v.tobytes()
        return bytes(out)

    @classmethod
    def mapped(cls, data: bytes) -> TrieShard:
        """Over an unnamed temporary file, mapped; it goes with the process, so nothing is left on the machine."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of each pair, 0 where the trie has none."""
        out = np.zeros(len(word), np.uint16)
        if not self.contexts.n:
            return out
        at, known = self.contexts.successor(context)
        pick = np.flatnonzero(known)
        if len(pick):
            base = self.bases.access(at[pick])
            place, found = self.successors.successor(base + word[pick])
            # a base's range ends where the next begins, so a larger word may fall into a later context's range
            found &= place < self.pointers.access(at[pick] + 1).astype(np.int64)
            out[pick[found]] = self.codes[place[found]]
        return out
