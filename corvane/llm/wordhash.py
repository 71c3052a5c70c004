"""Words of many texts at once as 64-bit hashes, in numpy.

A text's UTF-8 bytes, A-Z lowered, are split at separators; a word's hash is its polynomial in an odd base modulo
2**64, had from prefix sums, and then mixed. Equal words have equal hashes on any machine. Different words of under a
thousand bytes share one with a chance of about 2**-56 at worst.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
CHUNK_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: For words without punctuation: all but a-z, 0-9 and what isn't ASCII.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_powers = _inverses = np.ones(1, np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n - 1 of BASE and of its inverse modulo 2**64."""
    global _powers, _inverses
    if len(_powers) < n:
        factors = np.full((2, max(n, CHUNK_BYTES + 1)), BASE, np.uint64)
        factors[1] = pow(BASE, -1, 1 << 64)
        factors[:, 0] = 1
        _powers, _inverses = np.cumprod(factors, axis=1, dtype=np.uint64)
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ x >> np.uint64(30)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _split(data: bytes, separators: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start and end of every word, prefix sums of the bytes' polynomial, and the inverse powers."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], ~separators[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    power, inverse = _power(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], out=prefix[1:])
    return edges[0::2], edges[1::2], prefix, inverse


def _hash(a: np.ndarray, b: np.ndarray, prefix: np.ndarray, inverse: np.ndarray, salt: int = 0) -> np.ndarray:
    poly = (prefix[b] - prefix[a]) * inverse[a]
    return mix(poly + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(salt))


def _words(data: bytes, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word."""
    starts, ends, prefix, inverse = _split(data, separators)
    return _hash(starts, ends, prefix, inverse), starts


def _stems(data: bytes, separators: np.ndarray, stems: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and start of every word and of its first k bytes for each k of stems below its length, and the hash of the next shorter of these, or 0."""
    starts, ends, prefix, inverse = _split(data, separators)
    hashes, at, shorter, last = [], [], [], np.zeros(len(starts), np.uint64)
    for k in stems:
        own = ends - starts > k
        h = _hash(starts, np.minimum(starts + k, ends), prefix, inverse, 1)
        hashes.append(h[own])
        shorter.append(last[own])
        at.append(starts[own])
        last = np.where(own, h, last)
    hashes.append(_hash(starts, ends, prefix, inverse))
    return np.concatenate(hashes), np.concatenate([*at, starts]), np.concatenate([*shorter, last])


def _pieces(data: bytes, separators: np.ndarray) -> Iterator[bytes]:
    """A text that is too long for a chunk, cut at separators."""
    at = 0
    while at < len(data):
        end = min(len(data), at + CHUNK_BYTES)
        while end < len(data):  # on to the next separator
            stop = np.flatnonzero(separators[np.frombuffer(data[end : end + CHUNK_BYTES], np.uint8)])
            if len(stop):
                end += int(stop[0])
                break
            end = min(len(data), end + CHUNK_BYTES)
        yield data[at:end]
        at = end


def words(texts: list[str | None], separators: np.ndarray = WHITE, chunks: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts, in order: the hashes of all their words, and bounds, where text k of the run has words bounds[k] to bounds[k + 1].

    chunks: how many of CHUNK_BYTES a run may have."""
    run, size = [], 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if run and size + len(data) + 1 > chunks * CHUNK_BYTES:
            yield _run(run, separators)
            run, size = [], 0
        if len(data) > CHUNK_BYTES:
            hashes = np.concatenate([_words(p, separators)[0] for p in _pieces(data, separators)])
            yield hashes, np.array([0, len(hashes)])
            continue
        run.append(data)
        size += len(data) + 1
    if run:
        yield _run(run, separators)


def _run(run: list[bytes], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, starts = _words(b"\n".join(run), separators)
    begins = np.cumsum([0, *(len(d) + 1 for d in run)])
    return hashes, np.searchsorted(starts, begins)


def features(texts: list[str | None], separators: np.ndarray, stems: tuple[int, ...]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: number of the first text, how many they are, and of each word and stem the hash, its text's number in the run, and the next shorter stem."""
    first, run, size = 0, [], 0

    def done(run: list[bytes]) -> tuple:
        hashes, starts, shorter = _stems(b"\n".join(run), separators, stems)
        begins = np.cumsum([0, *(len(d) + 1 for d in run)])
        return first, len(run), hashes, np.searchsorted(begins, starts, "right") - 1, shorter

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if run and size + len(data) + 1 > CHUNK_BYTES:
            yield done(run)
            first, run, size = first + len(run), [], 0
        if len(data) > CHUNK_BYTES:
            parts = [_stems(p, separators, stems) for p in _pieces(data, separators)]
            hashes, shorter = (np.concatenate([p[k] for p in parts]) for k in (0, 2))
            yield first, 1, hashes, np.zeros(len(hashes), np.int64), shorter
            first += 1
            continue
        run.append(data)
        size += len(data) + 1
    if run:
        yield done(run)
