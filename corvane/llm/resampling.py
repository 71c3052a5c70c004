"""Importance resampling of documents towards a target table.

Texts become features, runs of consecutive words, hashed into buckets. A bucket's gain compares how often the target and
the documents fill it, a document's weight is the sum of its features' gains, and the documents with the highest
weights plus Gumbel noise are drawn, which samples without replacement in proportion to exp(weight).

A text longer than CHUNK_BYTES is cut at word boundaries into chunks that are dealt to all tasks. A chunk owns the words
that begin in it, and with them the features that start there; it carries the next runs - 1 words along, so that features
across a boundary are counted once. Counts and weights of chunks are summed by document. Ranks come from ranges of
scores: sums by range tell what ranks a range has, and only ranges with drawn rows are numbered.

Defined cases: a null or empty text has no words and no features, weight 0, and isn't drawn; a null doc_id draws noise as
an empty id; rows that repeat a doc_id are documents each, and equal rows take ranks one after another; a very long text
is cut as told; an empty table gives no rows; an empty target counts 0 in every bucket; other columns don't matter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import put, small, table

BUCKETS = 10_000
CHUNK_BYTES = 1 << 18
#: Distinct features whose buckets a Python worker keeps.
CACHE_FEATURES = 400_000
#: Equal rows that one row of a first explosion stands for.
COPIES = 1 << 16
_WORD_BYTES = set(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | set(range(128, 256))
#: Bytes that end words become spaces, A-Z become lower case; bytes of longer characters stay.
_PLAIN = bytes(b if b in _WORD_BYTES else 32 for b in range(256)).lower()
_CHUNK = "doc_id bigint, digest string, chunk bigint"


def chunks(text: bytes, size: int, carry: int) -> Iterator[tuple[bytes, int]]:
    """(words with what is carried, number of owned words) of a text in which all between words is spaces.

    A chunk owns the words that begin in it; it ends at the first word boundary after size bytes."""
    word, at = re.compile(rb"[^ ]+"), 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        upto, following = end, word.finditer(text, end)
        for _ in range(carry):
            if (nxt := next(following, None)) is None:
                break
            upto = nxt.end()
        yield text[at:upto], len(text[at:end].split())
        at = end


def split_long(docs: DataFrame, chunk_bytes: int, carry: int) -> DataFrame:
    """Chunks (doc_id, digest, chunk, text binary, own) of docs (doc_id, digest, text binary) that are longer than one."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for k, (part, own) in enumerate(chunks(row["text"].translate(_PLAIN), chunk_bytes, carry)):
                    columns = [pa.array([x], t) for x, t in ((row["doc_id"], pa.int64()), (row["digest"], pa.string()), (k, pa.int64()), (part, pa.binary()), (own, pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "chunk", "text", "own"])

    return docs.mapInArrow(split, f"{_CHUNK}, text binary, own bigint")


def hashed(docs: DataFrame, runs: int, buckets: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk of docs (doc_id, text): doc_id, digest, chunk, n_words, and the buckets of its features as unsigned
    32-bit integers."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        cache: dict[bytes, int] = {}
        for batch in batches:
            own, found = [], []
            for text, limit in zip(batch["text"].to_pylist(), batch["own"].to_pylist(), strict=True):
                words = text.translate(_PLAIN).split()
                n = len(words) if limit is None else limit
                own.append(n)
                grams = words[:n]
                for k in range(2, runs + 1):
                    grams += [b" ".join(words[i : i + k]) for i in range(min(n, len(words) - k + 1))]
                new = set(grams).difference(cache)
                if len(cache) + len(new) > CACHE_FEATURES:
                    cache, new = {}, set(grams)
                cache.update((g, zlib.crc32(g) % buckets) for g in new)
                found.append(np.fromiter(map(cache.__getitem__, grams), "<u4", len(grams)).tobytes())
            columns = [batch["doc_id"], batch["digest"], batch["chunk"], pa.array(own, pa.int64()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "chunk", "n_words", "features"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(text.cast("binary")).alias("digest"), text.cast("binary").alias("text"))
    is_long = F.octet_length("text") > chunk_bytes
    short = rows.filter(~is_long).select("doc_id", "digest", F.lit(0).cast("bigint").alias("chunk"), "text", F.lit(None).cast("bigint").alias("own"))
    dealt = split_long(rows.filter(is_long), chunk_bytes, runs - 1).repartition("doc_id", "digest", "chunk")
    return short.unionByName(dealt).mapInArrow(features, f"{_CHUNK}, n_words bigint, features binary")


def filled(found: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: how many features each bucket has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["features"].to_pylist()), "<u4"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return found.select("features").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """Each bucket's gain, from two tables of filled(); no more rows than buckets come to the driver."""
    s, t = ([0] * buckets for _ in range(2))
    for counts, frame in ((s, docs), (t, target)):
        for row in frame.collect():
            counts[row["bucket"]] = row["n"]
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return [math.floor(1000 * math.log(float((b + 1) * all_s) / float((a + 1) * all_t))) for a, b in zip(s, t, strict=True)]


def weighted(found: DataFrame, gain: list[int]) -> DataFrame:
    """doc_id, digest, n_words, n_features, weight, and times, the number of equal rows that a row stands for."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        each = np.array(gain, np.int64)
        for batch in batches:
            own = [np.frombuffer(f, "<u4") for f in batch["features"].to_pylist()]
            columns = [batch["doc_id"], batch["digest"], batch["chunk"], batch["n_words"], pa.array([len(f) for f in own], pa.int64()), pa.array([int(each[f].sum()) for f in own], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "chunk", "n_words", "n_features", "weight"])

    rows = found.mapInArrow(weigh, f"{_CHUNK}, n_words bigint, n_features bigint, weight bigint")
    sums = rows.groupBy("doc_id", "digest").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")], F.count_if(F.col("chunk") == 0).alias("times"))
    return sums.withColumns({c: F.expr(f"{c} div times") for c in ("n_words", "n_features", "weight")})


def ranked(rows: DataFrame, percent: int, least_words: int) -> DataFrame:
    """rows (of weighted(), with score) as often as they stand for, with rank."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("digest")]
    fit = F.col("n_words") >= least_words
    # Ranges of scores; the few below least_words are one range after all others.
    dealt = put(rows.filter(fit).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "resample-ranges")
    counts = put(dealt.groupBy("_part").agg(F.sum("times").alias("_n")), "resample-counts")
    every = Window.orderBy("_part")  # one short row for each range
    before = F.coalesce(F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    starts = put(counts.select("_part", before.alias("_before"), F.floor(total * percent / 100).cast("bigint").alias("_draw")), "resample-starts")
    placed = dealt.join(small(starts), "_part")
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    drawn = placed.filter("_before < _draw").withColumn("_first", F.col("_before") + F.coalesce(F.sum("times").over(within), F.lit(0)))
    rest = placed.filter("_before >= _draw").withColumn("_first", F.col("_before"))
    low = rows.filter(~fit).withColumns({"_part": F.lit(-1), "_before": F.lit(0).cast("bigint"), "_draw": F.lit(0).cast("bigint"), "_first": F.lit(0).cast("bigint")})
    # A row stands for equal rows; they come out in two steps, so that no array is longer than COPIES.
    many = drawn.unionByName(rest).unionByName(low).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(times - 1) div {COPIES}"))))
    upto = F.least(F.lit(COPIES).cast("bigint"), F.col("times") - F.col("_block") * COPIES)
    copies = many.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), upto)))
    rank = F.col("_first") + F.col("_block") * COPIES + F.col("_copy")
    return copies.withColumn("rank", F.when(rank <= F.col("_draw"), rank))


def resample(
    docs: DataFrame, target: DataFrame, runs: int = 1, buckets: int = BUCKETS, seed: int = 2024, percent: int = 10, least_words: int = 20, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank for each row of docs (doc_id, text); target has a column text.

    percent of the documents with least_words words or more are drawn and have ranks 1, 2, 3 ...; the others' rank is null."""
    found = put(hashed(docs, runs, buckets, chunk_bytes), "resample-features")
    aims = hashed(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), runs, buckets, chunk_bytes)
    gain = gains(filled(found, buckets), filled(aims, buckets), buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint").cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = put(weighted(found, gain).withColumn("score", F.col("weight") + noise), "resample-scored")
    return ranked(scored, percent, least_words).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    # crc32 by its definition: a table of 256 remainders, then a fold over the word's bytes.
    "op11_resample": f"""
        WITH RECURSIVE steps AS (SELECT range AS i, range AS c, 0 AS k FROM range(256)
            UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
        d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
        dw AS (SELECT r, unnest(w) AS w FROM d),
        bw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
        words AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
        hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
                                             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS b FROM words, crc),
        s AS (SELECT b, count(*) AS s FROM dw JOIN hashed USING (w) GROUP BY b),
        t AS (SELECT b, count(*) AS t FROM bw JOIN hashed USING (w) GROUP BY b),
        g AS (SELECT range AS b, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT count(*) FROM dw) + {BUCKETS}))::DOUBLE
                                                 / ((coalesce(s, 0) + 1) * ((SELECT count(*) FROM bw) + {BUCKETS}))::DOUBLE))::BIGINT AS gain
              FROM range({BUCKETS}) LEFT JOIN s ON range = s.b LEFT JOIN t ON range = t.b),
        w AS (SELECT r, sum(gain)::BIGINT AS weight FROM dw JOIN hashed USING (w) JOIN g USING (b) GROUP BY r),
        x AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((
                ('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
              FROM d LEFT JOIN w ON d.r = w.r),
        k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS p FROM x)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND p <= (SELECT count(*) * 10 // 100 FROM x WHERE n_features >= 20) THEN p END AS rank FROM k"""
}
QUERIES = {"op11_resample": op11_resample}
