"""Packing documents into sequences in their order, with as little padding and truncation as a dynamic program finds.

The tokens of consecutive documents are one stream, which is cut into windows of at most capacity tokens. A window may
end where a document ends, which is free, where a sentence ends (sentence_penalty), or after each GAP tokens of a longer
sentence (deep_penalty). A window is padded to capacity unless its length is a power of two. The sum of paddings and
penalties is least, and of the cuts with that sum those with the fewest windows are taken. The best cost of the stream up
to a cut is the least over the earlier cuts within reach: cost + position has its sliding minimum in a monotone queue,
and the lengths that take no padding are looked up by position.

Streams are strips of about STRIP_TOKENS tokens of a task's documents, in the order in which the table has them, so that
nothing is shuffled and a task holds one strip. A strip's last window is the only one that knows nothing of what follows.

Defined cases: a null text counts as empty; an empty document is its end id alone; rows that repeat a doc_id are packed
each; a null doc_id stays null; a very long text is encoded in one row and spread over strips; an empty table gives no
rows; other columns don't matter.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import table

CACHE_PIECES = 500_000
CAPACITY = 1024
STRIP_TOKENS = 1 << 19
#: Tokens whose candidates are found together.
GROUP_TOKENS = 1 << 17
#: A sentence of more tokens may also be cut after each so many.
GAP = 16
SENTENCE_PENALTY, DEEP_PENALTY = 4, 8
_SENTENCE_END = re.compile(r"""(?:[.!?…。！？]["'”’»)\]]*\s*|\n\s*)$""")


def sentence_ends(vocabulary: str) -> list[int]:
    """Ids of a byte-level vocabulary after which a sentence ends."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    with open(vocabulary, encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    text = lambda token: bytes(byte.get(c, 0) for c in token).decode(errors="replace")
    return sorted(i for token, i in entries.items() if _SENTENCE_END.search(text(token)))


def best_cuts(ends, penalties, capacity: int = CAPACITY) -> list[int]:
    """Of the ascending positions ends, those where windows end; the last position always is one.

    penalties: of a window that ends there. No two neighbouring positions may be further apart than capacity."""
    import numpy as np

    at = np.concatenate(([0], np.asarray(ends, np.int64)))
    index = np.full(at[-1] + 1, -1, np.int64)
    index[at] = np.arange(len(at))
    free = []  # (later, earlier) positions whose distance is a power of two, but for capacity, which takes no padding anyway
    for length in (1 << k for k in range((capacity - 1).bit_length())):
        later = np.flatnonzero(at >= length)
        earlier = index[at[later] - length]
        free.append(np.stack((later[earlier >= 0], earlier[earlier >= 0])))
    free = np.concatenate(free or [np.zeros((2, 0), np.int64)], axis=1)
    free = free[:, np.argsort(free[0], kind="stable")]
    edges, earlier = np.searchsorted(free[0], np.arange(1, len(at) + 1)).tolist(), free[1].tolist()
    unit = float(1 << 24)  # costs in units, the number of windows below; doubles hold both as whole numbers
    low = np.searchsorted(at, at - capacity).tolist()
    place, room, price = (at * unit).tolist(), ((capacity - at) * unit).tolist(), [0.0, *(np.asarray(penalties) * unit + 1).tolist()]
    n = len(place)
    cost, lead, origin = [0.0] * n, [0.0] * n, [0] * n  # lead: cost + position
    queue, head, tail, edge = [0] * n, 0, 0, edges[0]  # indices whose leads and positions ascend, from head to tail
    for j in range(1, n):
        first = low[j]
        while queue[head] < first:
            head += 1
        source = queue[head]
        best = lead[source] + room[j]
        upto = edges[j]
        while edge < upto:
            i = earlier[edge]
            if cost[i] < best:
                best, source = cost[i], i
            edge += 1
        cost[j] = own = best + price[j]
        origin[j] = source
        lead[j] = own = own + place[j]
        while tail >= head and lead[queue[tail]] >= own:
            tail -= 1
        tail += 1
        queue[tail] = j
    cuts = []
    j = n - 1
    while j:
        cuts.append(int(at[j]))
        j = origin[j]
    return cuts[::-1]


def candidates(ids, ends_sentence, gap: int, sentence_penalty: int, deep_penalty: int, ends=None):
    """(positions, penalties) where documents of these ids may be cut. ends: where each of them ends, which is free; one document without it."""
    import numpy as np

    ends = np.array([len(ids)]) if ends is None else ends
    stop = ends_sentence[ids]
    stop[ends - 1] = True
    stops = np.flatnonzero(stop) + 1
    starts = np.concatenate(([0], stops[:-1]))
    more = (stops - starts - 1) // gap
    deep = np.repeat(starts, more) + gap * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    at = np.concatenate((stops, deep))
    penalty = np.concatenate((np.full(len(stops), sentence_penalty), np.full(len(deep), deep_penalty)))
    penalty[np.searchsorted(stops, ends)] = 0
    order = np.argsort(at)
    return at[order], penalty[order]


def grouped(docs: Iterator[tuple[int | None, bytes]], tokens: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """Documents (doc_id, ids) in their order, in lists of about so many tokens."""
    group, n = [], 0
    for doc in docs:
        group.append(doc)
        n += len(doc[1]) // 4
        if n >= tokens:
            yield group
            group, n = [], 0
    if group:
        yield group


class _Strip:
    """Documents, or parts of them, that are cut together."""

    def __init__(self):
        self.docs, self.ends, self.penalties, self.n = [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes, start: int, stop: int, at, penalties) -> None:
        self.docs.append((doc_id, ids, start, stop))
        self.ends.append(at - start + self.n)
        self.penalties.append(penalties)
        self.n += stop - start

    def rows(self, capacity: int, first: int) -> tuple[list[tuple], int]:
        """Pieces, with sequences numbered from first on, and the number that comes next."""
        import numpy as np

        cuts = best_cuts(np.concatenate(self.ends), np.concatenate(self.penalties), capacity)
        rows, base, window, opened = [], 0, 0, 0
        for doc_id, ids, start, stop in self.docs:
            at, upto = base, base + stop - start
            while at < upto:
                end = min(upto, cuts[window])
                own = memoryview(ids)[4 * (start + at - base) : 4 * (start + end - base)]
                rows.append((doc_id, start + at - base, end - at, zlib.crc32(own), len(ids) // 4, first + window, at - opened))
                at = end
                if end == cuts[window]:
                    window, opened = window + 1, end
            base = upto
        return rows, first + window


def pack_in_order(
    docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, strip_tokens: int = STRIP_TOKENS,
    gap: int = GAP, sentence_penalty: int = SENTENCE_PENALTY, deep_penalty: int = DEEP_PENALTY,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece of docs (doc_id, text)."""
    if not 0 < gap <= min(capacity, strip_tokens):
        raise ValueError("gap must be positive, and no more than capacity or strip_tokens")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from corvane.llm.encode import encoder

        own = encoder(vocabulary, CACHE_PIECES)
        ends_sentence = np.zeros(own.tokenizer.get_vocab_size(), bool)
        ends_sentence[sentence_ends(vocabulary)] = True
        number, strip, end = TaskContext.get().partitionId() << 32, _Strip(), end_id.to_bytes(4, "little")

        def flush() -> pa.RecordBatch:
            nonlocal number, strip
            rows, number = strip.rows(capacity, number)
            strip = _Strip()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for batch in batches:
            told = zip(batch["doc_id"].to_pylist(), own.ids(batch["text"].to_pylist()), strict=True)
            for docs in grouped(((doc_id, ids + end) for doc_id, ids in told), GROUP_TOKENS):
                ends = np.cumsum([len(ids) // 4 for _, ids in docs])
                every, penalty = candidates(np.frombuffer(b"".join(ids for _, ids in docs), "<u4"), ends_sentence, gap, sentence_penalty, deep_penalty, ends)
                bounds = [0, *np.searchsorted(every, ends, "right").tolist()]
                for (doc_id, ids), base, a, b in zip(docs, [0, *ends.tolist()][:-1], bounds[:-1], bounds[1:], strict=True):
                    at, penalties = every[a:b] - base, penalty[a:b]
                    start, k = 0, 0
                    while k < len(at):
                        # As much of the document as the strip has room for, up to a candidate.
                        upto = int(np.searchsorted(at, start + strip_tokens - strip.n, "right"))
                        if upto <= k:
                            yield flush()
                            continue
                        strip.add(doc_id, ids, start, int(at[upto - 1]), at[k:upto], penalties[k:upto])
                        start, k = int(at[upto - 1]), upto
        if strip.n:
            yield flush()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(pack, ", ".join(f"{c} bigint" for c in names))


def op13_pack_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_in_order(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


ORACLE: dict[str, str] = {}
QUERIES = {"op13_pack_in_order": op13_pack_in_order}
