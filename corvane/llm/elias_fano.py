"""Elias-Fano sequences in numpy, and files of named arrays that can be memory-mapped."""

from __future__ import annotations

import json
import struct

import numpy as np

BLOCK_WORDS = 4  # 256 bits
#: Of each byte, the place of its k-th one, for k from 0 to 7.
IN_BYTE = np.array([([n for n in range(8) if byte >> n & 1] + [0] * 8)[:8] for byte in range(256)], np.int64).reshape(-1)


def pack(arrays: dict[str, np.ndarray], **told: int | float) -> bytes:
    """One file of arrays and numbers."""
    at, head, parts = 0, {}, []
    for name, a in arrays.items():
        data = np.ascontiguousarray(a).tobytes()
        head[name] = [a.dtype.str, len(a), at]
        parts.append(data + b"\0" * (-len(data) % 8))
        at += len(parts[-1])
    text = json.dumps({"arrays": head, "told": told}).encode()
    text += b" " * (-len(text) % 8)
    return b"".join([struct.pack("<Q", len(text)), text, *parts])


def unpack(data) -> tuple[dict[str, np.ndarray], dict]:
    """Views of what pack() wrote, without copies."""
    size = struct.unpack("<Q", data[:8])[0]
    head = json.loads(bytes(data[8 : 8 + size]))
    return {n: np.frombuffer(data, kind, count, 8 + size + at) for n, (kind, count, at) in head["arrays"].items()}, head["told"]


def _words(bits: np.ndarray) -> np.ndarray:
    """0/1 bytes as 64-bit words, the first bit lowest, with two words of room at the end."""
    raw = np.packbits(bits, bitorder="little")
    return np.concatenate((raw, np.zeros(-len(raw) % 8 + 16, np.uint8))).view(np.uint64)


class EliasFano:
    """An ascending sequence of unsigned integers: high parts in unary, low parts packed.

    access(i) gives elements and find(x) the index of the first element equal to x, or -1; both take arrays."""

    def __init__(self, arrays: dict[str, np.ndarray], told: dict, name: str):
        self.n, self.bits, self.buckets = (int(told[f"{name}_{k}"]) for k in ("n", "bits", "buckets"))
        self.low, self.high, self.zeros, self.ones = (arrays[f"{name}_{k}"] for k in ("low", "high", "zeros", "ones"))

    @staticmethod
    def build(values: np.ndarray, universe: int, name: str) -> tuple[dict[str, np.ndarray], dict]:
        """Arrays and numbers for pack(). universe: above every value."""
        n = len(values)
        bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        v = values.astype(np.uint64)
        high = (v >> np.uint64(bits)).astype(np.int64)
        buckets = (max(1, universe) - 1 >> bits) + 1
        unary = np.zeros(n + buckets, np.uint8)
        unary[high + np.arange(n)] = 1
        words = _words(unary)
        words = np.concatenate((words, np.zeros(-len(words) % BLOCK_WORDS, np.uint64)))
        inside = np.bitwise_count(words).reshape(-1, BLOCK_WORDS).sum(1, dtype=np.int64)
        ones = np.concatenate(([0], np.cumsum(inside)[:-1]))  # before each block
        zeros = np.arange(len(ones)) * (64 * BLOCK_WORDS) - ones
        packed = []
        for k in range(0, n, 1 << 16):  # a multiple of 64 values fills whole words
            part = v[k : k + (1 << 16), None] >> np.arange(bits, dtype=np.uint64)[None, :] & np.uint64(1)
            packed.append(np.packbits(part.astype(np.uint8).reshape(-1), bitorder="little"))
        raw = np.concatenate([*packed, np.zeros(0, np.uint8)])
        low = np.concatenate((raw, np.zeros(-len(raw) % 8 + 16, np.uint8))).view(np.uint64)
        return {f"{name}_low": low, f"{name}_high": words, f"{name}_zeros": zeros, f"{name}_ones": ones}, {f"{name}_n": n, f"{name}_bits": bits, f"{name}_buckets": buckets}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        value = self.low[word] >> shift | self.low[word + 1] << np.uint64(1) << (np.uint64(63) - shift)
        return value & np.uint64((1 << self.bits) - 1)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Positions of the k-th ones or zeros, from 0."""
        before = self.ones if one else self.zeros
        block = np.searchsorted(before, k, "right") - 1
        left, word = k - before[block], block * BLOCK_WORDS
        bits = self.high[word] if one else ~self.high[word]
        for _ in range(BLOCK_WORDS - 1):
            count = np.bitwise_count(bits).astype(np.int64)
            on = left >= count
            if not on.any():
                break
            left, word = left - np.where(on, count, 0), word + on
            bits = self.high[word] if one else ~self.high[word]
        # Sums over the bytes so far, side by side in a word; those not above what is left come before the byte sought.
        sums = bits - (bits >> np.uint64(1) & np.uint64(0x5555555555555555))
        sums = (sums & np.uint64(0x3333333333333333)) + (sums >> np.uint64(2) & np.uint64(0x3333333333333333))
        sums = (sums + (sums >> np.uint64(4)) & np.uint64(0x0F0F0F0F0F0F0F0F)) * np.uint64(0x0101010101010101)
        high = np.uint64(0x8080808080808080)
        passed = (left.astype(np.uint64) * np.uint64(0x0101010101010101) | high) - sums & high
        shift = np.bitwise_count(passed).astype(np.uint64) << np.uint64(3)
        left = left - (sums << np.uint64(8) >> shift & np.uint64(255)).astype(np.int64)
        byte = (bits >> shift & np.uint64(255)).astype(np.int64)
        return word * 64 + shift.astype(np.int64) + IN_BYTE[byte * 8 + left]

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First element of each bucket, and the one after its last."""
        at = np.where(high > 0, self._select(np.maximum(high - 1, 0), False), -1) + 1  # where its ones begin
        start, word, shift = at - high, at >> 6, (at & 63).astype(np.uint64)
        bits = self.high[word] >> shift
        run = np.bitwise_count(bits & ~(bits + np.uint64(1))).astype(np.int64)  # ones from there, in this word
        stop = start + run
        on = np.flatnonzero(run + shift.astype(np.int64) == 64)
        if len(on):
            stop[on] = self._select(high[on], False) - high[on]
        return start, stop

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.bits) | self._low(i)).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x).astype(np.uint64)
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        high, mask = (x >> np.uint64(self.bits)).astype(np.int64), np.uint64((1 << self.bits) - 1)
        inside = high < self.buckets
        high, low = np.where(inside, high, 0), x & mask
        a, stop = self._bucket(high)
        end, open_ = stop.copy(), np.flatnonzero(a < stop)
        while len(open_):  # the first element of the bucket that isn't below x
            mid = a[open_] + end[open_] >> 1
            less = self._low(mid) < low[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            end[open_] = np.where(less, end[open_], mid)
            open_ = open_[a[open_] < end[open_]]
        hit = inside & (a < stop)
        hit &= self._low(np.minimum(a, self.n - 1)) == low
        return np.where(hit, a, -1)
