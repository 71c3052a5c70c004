"""A wavelet matrix over token ids, as one compressed file with its documents' bounds.

The ids' bits go to planes, the highest first; each plane is the bit of every id in the order that the planes before
gave (zeros first, stably). Planes are kept in blocks of 2**18 bits, each compressed on its own, with counts of ones
before every block and, within a block once it is open, before every byte. The file answers access(i), rank(id, i) and
select(id, k) by opening the blocks it needs, and decode() gives all ids.

Layout, little-endian: magic, then u64 n, bits, documents; the documents' ids (i64), null flags (u8), ends (u64); for each
plane u64 zeros; for each plane and block u64 end of its bytes, u64 ones before; the blocks.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"CVWM0001"
BLOCK_BITS = 1 << 18


def build(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray, block_bits: int = BLOCK_BITS) -> bytes:
    """ids: unsigned integers of all documents on end; ends: where each document ends among them."""
    n, bits = len(ids), max(1, int(ids.max()).bit_length() if len(ids) else 1)
    seq = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    packer = zstandard.ZstdCompressor(level=1)
    zeros, table, blobs, at = [], [], [], 0
    for b in range(bits - 1, -1, -1):
        bit = (seq >> b) & 1 == 1
        zeros.append(n - int(np.count_nonzero(bit)))
        before = 0
        for k in range(0, n, block_bits):
            part = bit[k : k + block_bits]
            blobs.append(packer.compress(np.packbits(part).tobytes()))
            at += len(blobs[-1])
            table += (at, before)
            before += int(np.count_nonzero(part))
        seq = np.concatenate((seq[~bit], seq[bit]))
    head = MAGIC + struct.pack("<4Q", n, bits, len(doc_ids), block_bits)
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids) + np.asarray(ends, "<u8").tobytes()
    return b"".join([head, docs, np.array(zeros, "<u8").tobytes(), np.array(table, "<u8").tobytes(), *blobs])


class WaveletMatrix:
    """Reads what build() made, from bytes or a memory map."""

    def __init__(self, data, cached_blocks: int = 64):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.n, self.bits, docs, self.block_bits = struct.unpack("<4Q", data[8:40])
        view, at = memoryview(data), 40

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(view, kind, count, at)
            at += out.nbytes
            return out

        values, null, self.ends = take("<i8", docs), take("u1", docs), take("<u8", docs)
        self.doc_ids = [None if x else int(d) for d, x in zip(values, null, strict=True)]
        self.zeros = take("<u8", self.bits).astype(np.int64)
        self.blocks = -(-self.n // self.block_bits)
        self.table = take("<u8", 2 * self.bits * self.blocks).astype(np.int64).reshape(-1, 2)
        self.data, self.base, self.unpacker = view, at, zstandard.ZstdDecompressor()
        self.cache, self.cached_blocks = {}, cached_blocks

    def _bytes(self, k: int) -> bytes:
        start = self.table[k - 1, 0] if k else 0
        return self.unpacker.decompress(bytes(self.data[self.base + start : self.base + self.table[k, 0]]))

    def _open(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        k = plane * self.blocks + block
        if k not in self.cache:
            if len(self.cache) >= self.cached_blocks:
                self.cache.pop(next(iter(self.cache)))
            raw = np.frombuffer(self._bytes(k), np.uint8)
            self.cache[k] = raw, np.concatenate(([0], np.cumsum(np.bitwise_count(raw), dtype=np.int64)))
        return self.cache[k]

    def _ones(self, plane: int, i: int) -> int:
        """Ones before position i."""
        if i >= self.n:
            return self.n - int(self.zeros[plane])
        block, rest = divmod(i, self.block_bits)
        raw, counts = self._open(plane, block)
        byte, bit = divmod(rest, 8)
        inner = int(raw[byte] >> (8 - bit)).bit_count() if bit else 0
        return int(self.table[plane * self.blocks + block, 1]) + int(counts[byte]) + inner

    def _bit(self, plane: int, i: int) -> int:
        block, rest = divmod(i, self.block_bits)
        return int(self._open(plane, block)[0][rest >> 3] >> (7 - rest % 8)) & 1

    def access(self, i: int) -> int:
        value = 0
        for p in range(self.bits):
            bit, ones = self._bit(p, i), self._ones(p, i)
            i = int(self.zeros[p]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token before position i."""
        if token >> self.bits:
            return 0
        low = 0
        for p in range(self.bits):
            a, b = self._ones(p, low), self._ones(p, i)
            low, i = (int(self.zeros[p]) + a, int(self.zeros[p]) + b) if token >> (self.bits - 1 - p) & 1 else (low - a, i - b)
        return i - low

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence of token, from 0; -1 if there is none."""
        low, high = 0, self.n
        while low < high:  # the first i with k + 1 occurrences up to it
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.rank(token, mid + 1) <= k else (low, mid)
        return low if low < self.n and k >= 0 else -1

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up: each plane tells how the order above it was dealt to zeros and ones."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for p in range(self.bits - 1, -1, -1):
            raw = b"".join(self._bytes(p * self.blocks + k) for k in range(self.blocks))
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).view(bool)
            above, z = np.empty_like(out), int(self.zeros[p])
            above[~bit] = out[:z]
            above[bit] = out[z:] | out.dtype.type(1 << (self.bits - 1 - p))
            out = above
        return out
