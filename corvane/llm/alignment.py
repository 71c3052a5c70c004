"""Alignment of two tokenizers: which tokens of one cover the same bytes as which of the other.

Byte offsets where tokens of both end cut a text into groups; all pairs of a group are links. How good a link is, is told
by its count, the number of documents that hold the pair linked, against the highest count of its A id.

Both vocabularies begin anew at a single space after a printable character, so texts are cut there into units, and each
distinct unit is aligned once in a bounded cache. A task turns blocks of documents into postings: for each pair of ids
the block's documents with their multiplicities. Postings are dealt by A id and come sorted by B id, in streams that
Spark spills; sums over an A id's stream give counts and their maximum where the postings are. Each posting list then
gives its documents' contributions, which are summed by document. An A id with more than PART_POSTINGS postings is dealt
in slices, whose counts come from a table of sums by pair instead.

Defined cases: texts that are null or empty, or that either tokenizer doesn't give back byte for byte, have zeros and ''
for groups_sha256; rows that repeat a doc_id are documents each; a null doc_id stays null; a very long text is one row of
a block by itself; strings of special tokens are plain text; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import put, small, table

#: Units of a generation that a Python worker keeps, the characters of the longest such, and units that are encoded together.
CACHE_UNITS, CACHE_CHARS, TOGETHER = 150_000, 64, 2000
#: Units of a block of documents, about, and documents of it at most.
BLOCK_UNITS, BLOCK_DOCS = 300_000, 4096
#: Postings of one A id that are dealt together.
PART_POSTINGS = 1 << 22
#: Contributions that a task gathers before it sums them.
GATHERED = 1 << 21
#: A unit begins at a space after one of these characters, which no tokenizer takes for white space.
_PRINTABLE = re.compile(r"[!-~¡-¬®-ɏ]")
_UNIT = re.compile(rf"(?<={_PRINTABLE.pattern}) ")

_DOC = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
_POSTING = "a int, b int, n int, docs binary, times binary"
_FIELDS = [*((c, pa.int64()) for c in ("key", "doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), *((c, pa.int32()) for c in "abn"), ("docs", pa.binary()), ("times", pa.binary())]


class Aligner:
    """Units and their alignments: the groups as text, the numbers of A ids, B ids, groups and links, and each link's A id * width + B id."""

    def __init__(self, byte_vocabulary: str, piece_model: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import numpy as np
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_vocabulary)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_model)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        with open(byte_vocabulary, encoding="utf-8") as f:
            entries = json.load(f)
        self.a_size = np.zeros(self.a.get_vocab_size(), np.int64)
        for token, i in entries["model"]["vocab"].items():
            self.a_size[i] = len(bytes(byte[c] for c in token))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_size, self.width = np.array([len(p) for p in self.b_bytes], np.int64), len(pieces)
        self.a_said = np.array([[f"{sign}{i}" for i in range(len(self.a_size))] for sign in (",", ";", "\n")], object)
        self.b_said = np.array([[f"{sign}{i}" for i in range(len(pieces))] for sign in (",", "|")], object)
        # Where a piece may go on over a space, texts are one unit.
        self.units = not any(re.search("[^▁]▁", p) for p in pieces)

    def split(self, text: str) -> list[str]:
        return _UNIT.split(text) if self.units else [text]

    def align(self, units: list[str]) -> list[tuple | None]:
        """Each unit's alignment, with a space before it, or None if a tokenizer doesn't give it back."""
        out: list[tuple | None] = [None] * len(units)
        # Units that end in a printable character can be encoded one after another as one text.
        alone = [k for k, u in enumerate(units) if not (self.units and u and _PRINTABLE.match(u[-1]))]
        apart = set(alone)
        rest = [k for k in range(len(units)) if k not in apart]
        for part in [*([k] for k in alone), *(rest[k : k + TOGETHER] for k in range(0, len(rest), TOGETHER))]:
            for k, found in zip(part, self._together([units[k] for k in part]), strict=True):
                out[k] = found
        return out

    def _together(self, units: list[str]) -> list[tuple | None]:
        import numpy as np

        text = " ".join(units)
        a, b = np.array(self.a.encode(" " + text, add_special_tokens=False).ids, np.int64), np.array(self.b.encode(text), np.int64)
        if not len(b) or self.a_size[a].sum() != len(text.encode()) + 1 or b"".join([self.b_bytes[i] for i in b]) != b" " + text.encode():
            half = len(units) // 2
            return [None] if not half else self._together(units[:half]) + self._together(units[half:])
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        n_a, n_b = np.bincount(group_a), np.bincount(group_b)
        unit = np.searchsorted(np.cumsum([len(u.encode()) + 1 for u in units]), ends)
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        # Every A token with every B token of its group.
        times = n_b[group_a]
        pairs = np.repeat(a * self.width, times) + b[_runs(first_b[group_a], times)]
        new_unit = np.concatenate(([True], unit[1:] != unit[:-1]))
        # Text of the groups: ids in order, each with the sign before it.
        lead = np.zeros(len(a), np.int64)
        lead[first_a] = np.where(new_unit, 2, 1)
        said = np.empty(len(a) + len(b), object)
        said[np.arange(len(a)) + first_b[group_a]] = self.a_said[lead, a]
        lead = np.zeros(len(b), np.int64)
        lead[first_b] = 1
        said[np.arange(len(b)) + (first_a + n_a)[group_b]] = self.b_said[lead, b]
        starts = np.flatnonzero(new_unit)
        sizes = [np.add.reduceat(x, starts).tolist() for x in (n_a, n_b, np.ones_like(n_a), n_a * n_b)]
        upto, pairs = np.cumsum(sizes[3]).tolist(), pairs.tolist()
        own = [tuple(pairs[i:j]) for i, j in zip([0, *upto], upto, strict=False)]
        return list(zip("".join(said.tolist()).split("\n")[1:], *sizes, own, strict=True))


class _Units:
    """Aligned units, those of the last blocks kept in two generations."""

    def __init__(self, aligner: Aligner):
        self.aligner, self.young, self.old = aligner, {}, {}

    def found(self, wanted: list[str]) -> list[tuple | None]:
        out = {u: self.young.get(u) or self.old.get(u) for u in wanted}
        new = [u for u, r in out.items() if r is None]
        out.update(zip(new, self.aligner.align(new), strict=True))
        if len(self.young) > CACHE_UNITS:
            self.young, self.old = {}, self.young
        self.young.update((u, r) for u, r in out.items() if r is not None and len(u) <= CACHE_CHARS)
        return list(out.values())


def _runs(starts, lengths):
    """Indices of runs one after another."""
    import numpy as np

    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def aligned(docs: DataFrame, byte_vocabulary: str, piece_model: str, block_units: int = BLOCK_UNITS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Rows of two kinds for docs (doc_id, text): with a null, a document and its sizes, whose key is unlike any other; else a
    posting list: key, the block's first; ids a and b; n, the documents that hold them linked; for each its key less the block's, two
    bytes, and its multiplicity, one byte if all fit in one, else four."""
    names = [c for c, _ in _FIELDS]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        units = _Units(Aligner(byte_vocabulary, piece_model))
        key, waiting, n_waiting = TaskContext.get().partitionId() << 26, [], 0

        def rows(size: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, t) for c, t in _FIELDS], names)

        def binary(raw, ends) -> pa.Array:
            """An array of byte strings: raw cut at ends."""
            offsets = np.concatenate(([0], ends)).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal key, waiting, n_waiting
            own = [us or [""] for _, us in waiting]
            wanted = list({u for us in own for u in us})
            records = units.found(wanted)
            at = dict(zip(wanted, range(len(wanted)), strict=True))
            found = [list(map(at.__getitem__, us)) for us in own]
            wrong = {k for k, r in enumerate(records) if r is None}
            records.append(("", 0, 0, 0, 0, ()))
            if wrong:  # such a text is tried as a whole, in case changes cancel out
                for k, (_, us) in enumerate(waiting):
                    if us is None or not wrong.isdisjoint(found[k]):
                        whole = units.aligner.align([" ".join(us)])[0] if us else None
                        found[k] = [len(records) if whole else len(wanted)]
                        records += [whole] if whole else []
                records = [r or ("", 0, 0, 0, 0, ()) for r in records]
            said, *sizes, pairs = zip(*records, strict=True)
            lengths = np.array([len(f) for f in found])
            flat = np.fromiter(chain.from_iterable(found), np.int64, lengths.sum())
            of = np.repeat(np.arange(len(found)), lengths)
            sums = np.add.reduceat(np.array(sizes, np.int64).T[flat], np.cumsum(lengths) - lengths)
            sha = [hashlib.sha256(";".join([said[u] for u in f]).encode()).hexdigest() if n else "" for f, n in zip(found, sums[:, 0], strict=True)]
            told = {c: pa.array(sums[:, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
            ids = pa.array([d for d, _ in waiting], pa.int64())
            yield rows(len(found), key=pa.array(key + np.arange(len(found))), doc_id=ids, groups_sha256=pa.array(sha, pa.string()), **told)
            # Documents and their distinct units, then the pairs of these.
            both, times = np.unique(of * len(records) + flat, return_counts=True)
            of, flat = both // len(records), both % len(records)
            n_pairs = np.array(sizes[3], np.int64)
            codes = np.fromiter(chain.from_iterable(pairs), np.int64, n_pairs.sum())[_runs((np.cumsum(n_pairs) - n_pairs)[flat], n_pairs[flat])]
            codes = codes * len(found) + np.repeat(of, n_pairs[flat])
            many = np.repeat(times, n_pairs[flat])
            if len(codes):
                order = np.argsort(codes)
                codes = codes[order]
                starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
                many = np.add.reduceat(many[order], starts)
                code, of = np.divmod(codes[starts], len(found))
                first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
                n = np.diff(np.append(first, len(code)))
                wide = np.maximum.reduceat(many, first) > 255
                of = of.astype("<u2")
                for is_wide in (False, True):
                    lists = wide == is_wide
                    if lists.any():
                        here, ends = _runs(first[lists], n[lists]), np.cumsum(n[lists])
                        a, b = np.divmod(code[first[lists]], units.aligner.width)
                        yield rows(
                            len(ends), key=pa.array(np.full(len(ends), key)), a=pa.array(a.astype(np.int32)), b=pa.array(b.astype(np.int32)), n=pa.array(n[lists].astype(np.int32)),
                            docs=binary(of[here].tobytes(), 2 * ends), times=binary(many[here].astype("<u4" if is_wide else "u1").tobytes(), (4 if is_wide else 1) * ends),
                        )
            key, waiting, n_waiting = key + len(found), [], 0

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = units.aligner.split(text) if text else None
                if waiting and (n_waiting + len(own or ()) > block_units or len(waiting) >= block_docs):
                    yield from block()
                waiting.append((doc_id, own))
                n_waiting += len(own or ())
        if waiting:
            yield from block()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(align, f"key bigint, {_DOC}, {_POSTING}")


def contributions(lists: DataFrame) -> DataFrame:
    """block, docs, best and total: of each block of documents the sums over links by document, from lists (key, docs, times, count,
    is_best). A block comes as often as a task's GATHERED contributions are summed; docs are two-byte, sums eight-byte integers."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        parts, gathered = [], 0

        def summed() -> tuple:
            key, best, total = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            return key[starts], np.add.reduceat(best[order], starts), np.add.reduceat(total[order], starts)

        def packed() -> pa.RecordBatch:
            key, best, total = summed()
            block = key >> 16
            cuts = np.append(np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))), len(key)).tolist()
            each = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())
            columns = [pa.array(block[cuts[:-1]]), each((key & 0xFFFF).astype("<u2")), each(best.astype("<i8")), each(total.astype("<i8"))]
            return pa.RecordBatch.from_arrays(columns, ["block", "docs", "best", "total"])

        for batch in batches:
            base, count, is_best = (batch[c].to_numpy(zero_copy_only=False) for c in ("key", "count", "is_best"))
            docs, times = batch["docs"].to_pylist(), batch["times"].to_pylist()
            wide = np.array([len(t) > len(d) for d, t in zip(docs, times, strict=True)], bool)
            for is_wide in (False, True):
                at = np.flatnonzero(wide == is_wide)
                if not len(at):
                    continue
                own = np.frombuffer(b"".join([docs[i] for i in at]), "<u2").astype(np.int64)
                many = np.frombuffer(b"".join([times[i] for i in at]), "<u4" if is_wide else "u1").astype(np.int64)
                n = np.array([len(docs[i]) // 2 for i in at])
                parts.append((np.repeat(base[at] << 16, n) + own, many * np.repeat(is_best[at], n), many * np.repeat(count[at], n)))
                gathered += len(own)
            if gathered > GATHERED:
                parts = [summed()]
                gathered = len(parts[0][0])
                if gathered > GATHERED // 2:
                    yield packed()
                    parts, gathered = [], 0
        if parts:
            yield packed()

    return lists.select("key", "docs", "times", "count", "is_best").mapInArrow(expand, "block bigint, docs binary, best binary, total binary")


def summed_by_document(parts: DataFrame) -> DataFrame:
    """key, n_best and count_sum of every document in parts (of contributions()). A block's rows come one after another, and its sums are held alone."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        now, sums = None, np.zeros((3, 1 << 16), np.int64)

        def out() -> pa.RecordBatch:
            at = np.flatnonzero(sums[0])
            batch = pa.RecordBatch.from_arrays([pa.array(at + now), pa.array(sums[1, at]), pa.array(sums[2, at])], ["key", "n_best", "count_sum"])
            sums[:, at] = 0
            return batch

        for batch in batches:
            for block, docs, best, total in zip(*(batch[c].to_pylist() for c in ("block", "docs", "best", "total")), strict=True):
                if block != now:
                    if now is not None:
                        yield out()
                    now = block
                at = np.frombuffer(docs, "<u2")
                sums[0, at] = 1
                sums[1, at] += np.frombuffer(best, "<i8")
                sums[2, at] += np.frombuffer(total, "<i8")
        if now is not None:
            yield out()

    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(add, "key bigint, n_best bigint, count_sum bigint")


def counted(postings: DataFrame, part_postings: int = PART_POSTINGS) -> DataFrame:
    """postings, a written table, with count and is_best, whether no other B id of its A id has a higher count."""
    sizes = put(postings.groupBy("a").agg(F.sum("n").alias("_all")), "align-sizes")  # a row for each id of the vocabulary, at most
    parted = postings.join(F.broadcast(sizes), "a")
    local = parted.filter(F.col("_all") <= part_postings).drop("_all").repartition("a").sortWithinPartitions("a", "b")
    count = F.sum("n").over(Window.partitionBy("a", "b")).cast("bigint")
    local = local.withColumn("count", count).withColumn("is_best", F.col("count") == F.max("count").over(Window.partitionBy("a")))
    hot = parted.filter(F.col("_all") > part_postings).withColumn("_slice", F.pmod(F.xxhash64("key"), F.expr(f"1 + _all div {part_postings}")))
    sums = hot.groupBy("a", "b").agg(F.sum("n").cast("bigint").alias("count"))
    sums = sums.withColumn("is_best", F.col("count") == F.max("count").over(Window.partitionBy("a")))
    slices = hot.select("a", "_all").distinct().withColumn("_slice", F.explode(F.expr(f"sequence(0, _all div {part_postings})"))).drop("_all")
    sliced = hot.drop("_all").join(sums.join(small(put(slices, "align-slices")), "a"), ["a", "_slice", "b"])
    columns = [*postings.columns, "count", "is_best"]
    return local.select(columns).unionByName(sliced.select(columns))


def align_tokens(docs: DataFrame, byte_vocabulary: str, piece_model: str, part_postings: int = PART_POSTINGS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs (doc_id, text)."""
    rows = put(aligned(docs, byte_vocabulary, piece_model), "align")
    postings = rows.filter("a IS NOT NULL").select("key", "a", "b", "n", "docs", "times")
    sums = summed_by_document(contributions(counted(postings, part_postings)))
    none = F.lit(0).cast("bigint")
    told = rows.filter("a IS NULL").select("key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "key", "left")
    return told.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


ORACLE: dict[str, str] = {}
QUERIES = {"op12_align": op12_align}
