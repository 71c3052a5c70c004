"""Token ids of documents in wavelet-matrix files, in ascending order of doc_id.

Documents are dealt by ranges of (doc_id, hash of the text), sorted within a range, encoded, and written as files of
about SHARD_TOKENS ids (more only where one document has more). A file's row in the manifest is written by Spark with
its task, so that files of failed or doubled tasks are never read.

Defined cases: a null text counts as empty and has the end id only; null doc_ids come first; rows that repeat a doc_id
follow one another; an empty table gives no files and no rows; other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import put, scratch, table

SHARD_TOKENS = 16_000_000


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, folder: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes docs (doc_id, text) to folder. The manifest: part, shard, path, n_docs, n_tokens, and start, the ids before the file."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        from corvane.llm.encode import encoder
        from corvane.llm.files import write_file
        from corvane.llm.wavelet import build

        context, end = TaskContext.get(), np.array([end_id], "<u4").tobytes()
        narrow = end_id < 1 << 16
        parts, doc_ids, ends, n, shard = [], [], [], 0, 0

        def flush() -> pd.DataFrame:
            nonlocal parts, doc_ids, ends, n, shard
            path = f"{folder}/tokens-{context.partitionId():06d}-{shard:06d}-{context.taskAttemptId()}.wm"
            write_file(path, build(np.concatenate(parts), doc_ids, np.array(ends)))
            row = pd.DataFrame({"part": [context.partitionId()], "shard": [shard], "path": [path], "n_docs": [len(doc_ids)], "n_tokens": [n]})
            parts, doc_ids, ends, n, shard = [], [], [], 0, shard + 1
            return row

        for batch in batches:
            for doc, ids in zip(batch["doc_id"], encoder(vocabulary).ids(batch["text"].tolist()), strict=True):
                own = np.frombuffer(ids + end, "<u4")
                parts.append(own.astype(np.uint16) if narrow and own.max() < 1 << 16 else own)
                n += len(own)
                doc_ids.append(None if pd.isna(doc) else int(doc))
                ends.append(n)
                if n >= shard_tokens:
                    yield flush()
        if doc_ids:
            yield flush()

    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(*key).sortWithinPartitions(*key)
    # An id may be null in some batch: as objects, long ids keep their digits.
    rows = ordered.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(write, "part int, shard int, path string, n_docs bigint, n_tokens bigint")
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # one short row for each file
    return put(rows, "token-manifest").withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        from corvane.llm.files import map_file
        from corvane.llm.wavelet import WaveletMatrix

        for batch in batches:
            for path, base in zip(batch["path"], batch["start"], strict=True):
                matrix = WaveletMatrix(map_file(path))
                ids, ends = matrix.decode(), matrix.ends.astype(np.int64)
                starts = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(matrix.doc_ids, "Int64"), "start": starts + base, "n_tokens": ends - starts, "ids_crc32": crc})

    files = manifest.select("path", "start").repartition(max(1, manifest.count()))
    return files.mapInPandas(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return read_tokens(write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, scratch(spark, "tokens")))


ORACLE: dict[str, str] = {}
QUERIES = {"op6_token_files": op6_token_files}
