"""Media columns of telephony audio.

to_media() keeps payloads as mono WAV files at 8 kHz, in mu-law, A-law or IMA ADPCM, which of them the payload's crc32
tells. The payload is the file's codes, byte for byte; blocks of ADPCM have the heads that an encoder writes before them.
pcm() reads the files, expands or decodes them and resamples them to 16 kHz PCM; describe() tells what PCM is like.
features() does both: it writes the PCM of all files and reads it back.

Defined cases: a null text is an empty payload, padded like any other; equal texts have equal files and features; of
repeated rows each gives its own; a null doc_id stays null; an empty table gives no rows; other columns don't matter. A
recording's PCM is one value of at most 2 GB, which is that of a text of 250 MB. A file that isn't telephony audio raises
an error in pcm() and features().
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from corvane.llm.common import drop_table, file_bytes, put, table

UNIT, HEAD = 192, 4
RATE, TARGET = 8000, 16000
#: features() holds the PCM of one part of the files at a time, which is that of PART_BYTES of documents or of one in PARTS.
PARTS, PART_BYTES = 8, 8_000_000
#: Bytes of text or sound that a task handles at once.
GROUP = 2_000_000

DIGESTS = [("payload_bytes", LongType(), pa.int64()), ("payload_sha256", StringType(), pa.string()), ("tail_crc32", LongType(), pa.int64()),
           ("media_bytes", LongType(), pa.int64()), ("media_sha256", StringType(), pa.string())]
SOUND = [("codec", StringType(), pa.string()), ("rate", IntegerType(), pa.int32()), ("pcm", BinaryType(), pa.binary())]


def _with_columns(df: DataFrame, gone: str, made: list, f) -> DataFrame:
    """df with the columns made instead of gone. f gives, for values of gone, a row of the new ones for each."""
    kept = [c for c in df.schema.fields if c.name not in gone.split()]
    names = [c.name for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _groups(batch, gone.split()[-1]):
                rows = f(part)
                new = [pa.array([r[k] for r in rows], kind) for k, (_, _, kind) in enumerate(made)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + new, names=names + [name for name, _, _ in made])

    return df.mapInArrow(run, StructType(kept + [StructField(name, kind) for name, kind, _ in made]))


def _groups(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """batch in slices of about GROUP bytes of a column."""
    start, size = 0, 0
    for k, value in enumerate(batch.column(name)):
        size += len(value.as_buffer() or b"") if value.is_valid else 0
        if size > GROUP or k == len(batch) - 1:
            yield batch.slice(start, k + 1 - start)
            start, size = k + 1, 0


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media for docs (doc_id, text)."""

    def store(part: pa.RecordBatch) -> list[tuple]:
        from corvane.llm.audio import ADPCM, ALAW, MULAW, adpcm_data, wav

        raw = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
        full = [r.ljust(max(1, -(-len(r) // UNIT)) * UNIT) for r in raw]
        codecs = [(MULAW, ALAW, ADPCM)[zlib.crc32(p) % 3] for p in full]
        blocks = iter(adpcm_data([p for p, c in zip(full, codecs, strict=True) if c == ADPCM], UNIT))
        return [(len(r), wav(c, next(blocks) if c == ADPCM else p, RATE, UNIT + HEAD)) for r, p, c in zip(raw, full, codecs, strict=True)]

    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return _with_columns(ids, "text", [("n_bytes", LongType(), pa.int64()), ("media", BinaryType(), pa.binary())], store)


def sound(media: DataFrame) -> DataFrame:
    """media (media and other columns) with digests of each file and its payload, codec, rate and PCM (16-bit little-endian) instead of the file."""

    def expand(part: pa.RecordBatch) -> list[tuple]:
        from corvane.llm.audio import parse_wav, ratio, resample, sound_codes, taps, to_pcm

        files = part.column("media").to_pylist()
        parsed = [parse_wav(f) for f in files]
        rows: list = [None] * len(files)
        for codec, rate, block in {p[:3] for p in parsed}:
            same = [k for k, p in enumerate(parsed) if p[:3] == (codec, rate, block)]
            up, down = ratio(rate, TARGET)
            filters = taps(up, down)
            for k, samples in zip(same, to_pcm(codec, block, [parsed[k][3] for k in same]), strict=True):
                payload = sound_codes(codec, block, parsed[k][3])
                told = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(files[k]), hashlib.sha256(files[k]).hexdigest()
                rows[k] = (*told, codec, TARGET, resample(samples, up, down, filters).astype("<i2").tobytes())
        return rows

    return _with_columns(media, "media", DIGESTS + SOUND, expand)


def pcm(media: DataFrame) -> DataFrame:
    """doc_id, rate, pcm (16-bit little-endian) for media (doc_id, media)."""
    return sound(media.select("doc_id", "media")).select("doc_id", "rate", "pcm")


def describe(heard: DataFrame) -> DataFrame:
    """heard (codec, rate, pcm and other columns) with a feature instead of these three."""

    def tell(part: pa.RecordBatch) -> list[tuple]:
        import numpy as np

        rows = []
        for codec, rate, held in zip(part.column("codec").to_pylist(), part.column("rate").to_pylist(), part.column("pcm"), strict=True):
            samples = np.frombuffer(held.as_buffer(), "<i2")
            wide = samples.astype(np.int64)
            crossings = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
            told = f"{codec};rate={rate};samples={len(wide)};peak={int(np.abs(wide).max(initial=0))};power={int((wide * wide).sum()) // max(1, len(wide))}"
            rows.append((f"{told};crossings={crossings};pcm_crc32={zlib.crc32(samples)}",))
        return rows

    return _with_columns(heard, "codec rate pcm", [("feature", StringType(), pa.string())], tell)


def features(media: DataFrame, parts: int = 1) -> DataFrame:
    """doc_id, n_bytes, and digests and features of each file, for media (doc_id, n_bytes, media).

    The PCM of all files is written and read back, in so many parts one after the other; that of a part goes when its features are written."""
    place = (F.monotonically_increasing_id() % parts).cast("int").alias("part")
    stored = put(media.select("doc_id", "n_bytes", "media", place), "media", by=("part",))
    done = []
    for part in range(parts):
        heard = put(sound(stored.filter(F.col("part") == part).drop("part")), "pcm")
        done.append(put(describe(heard), "features"))
        drop_table(heard)
    return reduce(DataFrame.union, done)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return features(to_media(docs), min(PARTS, 1 + file_bytes(docs) // PART_BYTES))


ORACLE: dict[str, str] = {}
QUERIES = {"op7_media": op7_media}
