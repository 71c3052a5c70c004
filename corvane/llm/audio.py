"""Telephony audio: G.711 expansion by table, IMA ADPCM blocks and their decoding across blocks, WAV files and integer resampling."""

from __future__ import annotations

import math
import struct

import numpy as np

MULAW, ALAW, ADPCM = "mulaw", "alaw", "adpcm"
#: WAVE format tags; fixed values.
TAGS = {ALAW: 6, MULAW: 7, ADPCM: 0x11}
#: IMA ADPCM step sizes and index changes; fixed values.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190,
     209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499,
     2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385,
     24623, 27086, 29794, 32767], np.int32,
)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, size = code >> 4 & 7, ((code & 15) << 4) + 8
    size = np.where(exponent > 0, size + 256 << np.maximum(exponent - 1, 0), size)
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """blocks: one mono IMA block in each row (uint8, a 4-byte head, then two samples a byte). Returns int16, a row of samples for each.

    Every step handles one sample of all blocks at once; a step index out of range, which no encoder writes, counts as the nearest."""
    n, width = blocks.shape
    value = blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8
    value = np.where(value > 32767, value - 65536, value)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    codes = _codes(blocks[:, 4:])
    out = np.empty((1 + len(codes), n), np.int16)
    out[0] = value
    for k, code in enumerate(codes, 1):
        value = np.clip(value + _change(code, index), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code], 0, len(STEPS) - 1)
        out[k] = value
    return out.T


def _codes(body: np.ndarray) -> np.ndarray:
    """The 4-bit codes of each row of body, a row for each place."""
    codes = np.empty((2 * body.shape[1], len(body)), np.int32)
    codes[0::2], codes[1::2] = body.T & 15, body.T >> 4
    return codes


def _change(code: np.ndarray, index: np.ndarray) -> np.ndarray:
    step = STEPS[index]
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.where(code & 8, -change, change)


def _starts(shift: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """What a state is before each block and after the last, if a block makes clip(state + shift, low, high) of it and the first of a recording begins with 0."""
    out = []
    for a, lo, hi, begins in zip(shift.tolist(), low.tolist(), high.tolist(), first.tolist(), strict=True):
        state = 0 if begins else state
        out.append(state)
        state = min(max(state + a, lo), hi)
    return np.array(out, np.int32), state


def adpcm_heads(bodies: np.ndarray, first: np.ndarray, chunk: int = 8192) -> np.ndarray:
    """The heads (uint8, four a row) of blocks with these codes, as an encoder writes them that carries its state from block to block: the sample
    and step index that the block before ends with, and a zero. first: which blocks begin a recording.

    A sum of clipped shifts is a clipped shift again. So the codes of many blocks are gone through at once, for indexes and then for samples."""
    top, end_index, end_value = len(STEPS) - 1, 0, 0
    heads = np.zeros((len(bodies), 4), np.uint8)
    for at in range(0, len(bodies), chunk):
        codes, begins = _codes(bodies[at : at + chunk]), first[at : at + chunk]
        shift, low, high = (np.full(len(begins), v, np.int32) for v in (0, 0, top))
        for code in codes:
            move = INDEX_CHANGE[code]
            shift, low, high = shift + move, np.clip(low + move, 0, top), np.clip(high + move, 0, top)
        index, end_index = _starts(shift, low, high, begins, end_index)
        now, shift, low, high = index, *(np.full(len(begins), v, np.int32) for v in (0, -32768, 32767))
        for code in codes:
            move = _change(code, now)
            shift, low, high = shift + move, np.clip(low + move, -32768, 32767), np.clip(high + move, -32768, 32767)
            now = np.clip(now + INDEX_CHANGE[code], 0, top)
        value, end_value = _starts(shift, low, high, begins, end_value)
        heads[at : at + chunk, :3] = np.stack((value & 255, value >> 8 & 255, index), 1)
    return heads


def adpcm_data(payloads: list[bytes], width: int) -> list[bytes]:
    """Sound data of recordings whose codes are payloads, positive multiples of width: blocks of a head and width bytes of codes."""
    bodies = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, width)
    starts = np.cumsum([0] + [len(p) // width for p in payloads])[:-1]
    first = np.zeros(len(bodies), bool)
    first[starts] = True
    blocks = np.concatenate((adpcm_heads(bodies, first), bodies), 1)
    return [b.tobytes() for b in np.split(blocks, starts[1:])] if payloads else []


def sound_codes(codec: str, block: int, data: bytes) -> bytes:
    """The codes of sound data: all of it, for ADPCM without the heads of blocks."""
    return b"".join(data[k + 4 : k + block] for k in range(0, len(data), block)) if codec == ADPCM else data


def sample_count(codec: str, block: int, size: int) -> int:
    """The samples in so many bytes of sound data."""
    whole, rest = divmod(size, block)
    return whole * (2 * (block - 4) + 1) + max(0, 2 * (rest - 4) + 1) * (rest >= 4) if codec == ADPCM else size


def wav(codec: str, data: bytes, rate: int, block: int = 1) -> bytes:
    """A mono WAV file; block: bytes of an ADPCM block."""
    extra = struct.pack("<HH", 2, 2 * (block - 4) + 1) if codec == ADPCM else struct.pack("<H", 0)
    per_second = rate * block // (2 * (block - 4) + 1) if codec == ADPCM else rate
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, rate, per_second, block if codec == ADPCM else 1, 4 if codec == ADPCM else 8) + extra
    fact = b"fact" + struct.pack("<II", 4, sample_count(codec, block, len(data)))
    body = b"fmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def parse_wav(media: bytes) -> tuple[str, int, int, bytes]:
    """codec, rate, block and data bytes."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt = 12, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        elif kind == b"data" and fmt:
            codec = next((k for k, v in TAGS.items() if v == fmt[0]), None)
            if codec is None or fmt[1] != 1:
                raise ValueError(f"format {fmt[0]} with {fmt[1]} channels isn't telephony audio")
            return codec, fmt[2], fmt[4], media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no audio data")


def to_pcm(codec: str, block: int, data: list[bytes], chunk: int = 8192) -> list[np.ndarray]:
    """The samples (int16) of recordings of one codec. ADPCM: the blocks of all recordings are decoded together; a last one may be shorter."""
    if codec != ADPCM:
        tab = MULAW_TABLE if codec == MULAW else ALAW_TABLE
        return [tab[np.frombuffer(d, np.uint8)] for d in data]
    counts = [-(-len(d) // block) for d in data]
    rows = np.frombuffer(b"".join(d.ljust(n * block, b"\0") for d, n in zip(data, counts, strict=True)), np.uint8).reshape(-1, block)
    done = [decode_adpcm(rows[k : k + chunk]).reshape(-1) for k in range(0, len(rows), chunk)]
    flat = np.concatenate(done) if done else np.zeros(0, np.int16)
    parts = np.split(flat, np.cumsum(counts)[:-1] * (2 * (block - 4) + 1)) if data else []
    return [p[: sample_count(codec, block, len(d))] for p, d in zip(parts, data, strict=True)]


def taps(up: int, down: int, half: int = 8) -> np.ndarray:
    """Row p: the windowed-sinc filter of output phase p, in 1/32768 parts."""
    wide = max(1.0, down / up)
    reach = int(half * wide)
    at = np.arange(-reach + 1, reach + 1)[None, :] - np.arange(up)[:, None] / up
    row = np.sinc(at / wide) * np.cos(np.pi * np.clip(at / (reach + 1), -0.5, 0.5)) ** 2
    return np.rint(row / row.sum(1, keepdims=True) * 32768).astype(np.int64)


def ratio(rate: int, target: int) -> tuple[int, int]:
    """up and down that make target of rate."""
    common = math.gcd(rate, target)
    return target // common, rate // common


def resample(pcm: np.ndarray, up: int, down: int, filters: np.ndarray) -> np.ndarray:
    """Whole-number arithmetic, so that equal samples give equal samples anywhere. Silence is assumed around the recording."""
    n, width = len(pcm), filters.shape[1]
    padded = np.concatenate((np.zeros(width // 2 - 1, np.int64), pcm.astype(np.int64), np.zeros(width // 2, np.int64)))
    out = np.empty(-(-n * up // down), np.int16)
    for first in range(min(up, len(out))):
        at, phase = divmod(first * down, up)
        size = len(out[first::up])
        row = sum(int(t) * padded[at + k : at + k + (size - 1) * down + 1 : down] for k, t in enumerate(filters[phase]) if t)
        out[first::up] = np.clip(row + 16384 >> 15, -32768, 32767)
    return out
