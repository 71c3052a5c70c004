"""Packing documents into sequences by minimum bin slack.

Which pieces share a sequence depends on their lengths alone, so the plan is made from the histogram of lengths, which
has no more entries than a sequence has tokens. For each bin the plan fixes the longest length left and fills the rest
as far as any combination of the lengths left can: a subset-sum over a bitset of sums. That combination is taken out as
often as the histogram allows, so that the plan's size follows the number of lengths and not of pieces. Each piece then
finds its place from its rank among pieces of its length; ranks are counted in salted parts of a length, so that a
length that a third of all pieces have is no larger a task.

Defined cases: a null text counts as empty; an empty document is its end id alone; rows that repeat a doc_id are packed
each; a null doc_id stays null; a very long text is encoded in one row and cut; an empty table gives no rows; other
columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import put, small, table

#: Distinct words whose ids a Python worker keeps; a stage of a pipeline shares its executor's memory with what ran before.
CACHE_PIECES = 250_000
CAPACITY = 2048
#: Pieces of one length that a task ranks, about.
PART_PIECES = 1 << 16

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def fullest(left: Mapping[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) with times <= left[length] whose sum is the greatest that isn't above room."""
    mask, sums, layers, goal = (1 << room + 1) - 1, 1, [], 1 << room
    for length in sorted((x for x in left if x <= room), reverse=True):
        most, k = min(left[length], room // length), 1
        while most > 0 and not sums & goal:
            k = min(k, most)
            layers.append((length, k, sums))
            sums |= sums << length * k & mask
            most, k = most - k, 2 * k
    at, used = sums.bit_length() - 1, {}
    for length, k, before in reversed(layers):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return sorted(used.items(), reverse=True)


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces of it in each bin, first bin, offset in the bin): ranks from first rank on, up to the
    next run of that length, go to first bin and the bins after it."""
    left, taken, runs, bins = {x: n for x, n in counts.items() if n}, dict.fromkeys(counts, 0), [], 0
    while left:
        longest = max(left)
        rest = {**left, longest: left[longest] - 1}
        pattern = dict(fullest(rest, capacity - longest))
        pattern[longest] = pattern.get(longest, 0) + 1
        times, offset = min(left[x] // q for x, q in pattern.items()), 0
        for length, q in sorted(pattern.items(), reverse=True):
            runs.append((length, taken[length], q, bins, offset))
            offset += q * length
            taken[length] += q * times
            left[length] -= q * times
            if not left[length]:
                del left[length]
        bins += times
    return runs


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Encodes docs (doc_id, text); documents longer than capacity are cut."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from corvane.llm.encode import encoder

        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["doc_id"], encoder(vocabulary, CACHE_PIECES).ids(batch["text"].tolist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "object"})

    # Ids as text: beside nulls, pandas would make floats of them.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(cut, PIECES.replace("doc_id bigint", "doc_id string"))
    return rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def pack(found: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    """found, a written table of PIECES, with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    runs = sorted(plan(histogram, capacity))
    parts = found.sparkSession.createDataFrame([(x, 1 + n // part_pieces) for x, n in histogram.items()], "length bigint, _parts bigint")
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_parts"))
    salted = found.join(F.broadcast(parts), "length").withColumn("_part", part).drop("_parts")
    # At most a row for each length and each part_pieces pieces.
    counts = put(salted.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n")), "pack-counts")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = put(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "pack-starts")
    within = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_row", F.row_number().over(within)).join(small(starts), ["length", "_part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_row") - 1).alias("_rank"))
    columns = [[r[k] for r in runs] for k in range(5)]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        length, first, q, bin0, offset = (np.array(c, np.int64) for c in columns)
        lengths = np.unique(length)
        low, high = np.searchsorted(length, lengths), np.searchsorted(length, lengths, "right")
        for batch in batches:
            own, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            run = np.zeros(len(own), np.int64)
            for x in np.unique(own):
                k, mine = np.searchsorted(lengths, x), own == x
                run[mine] = low[k] + np.searchsorted(first[low[k] : high[k]], rank[mine], "right") - 1
            inner = rank - first[run]
            yield batch.drop(columns="_rank").assign(sequence_id=bin0[run] + inner // q[run], offset=offset[run] + inner % q[run] * own)

    fixed = ranked.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(place, PIECES.replace("doc_id bigint", "doc_id string") + ", sequence_id bigint, offset bigint")
    return fixed.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    return pack(put(pieces(docs, vocabulary, end_id, capacity), "pack-pieces"), capacity)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


ORACLE: dict[str, str] = {}
QUERIES = {"op3_pack": op3_pack}
