"""Similarity join of documents by the Jaccard similarity of their word n-grams.

1. A document's set is its distinct n-grams (64-bit hashes). Documents with equal sets are one vertex from here on.
2. A list of one document adds to no overlap: a set can only link if other sets hold the required share of its n-grams.
   Chunks of documents send each range of the hashes one packed run; what comes back is how many n-grams of each set
   another one holds. The sets that fall short of t times their size are done, whatever passages they share.
3. Two sets of a and b <= a / t elements that reach similarity t differ in at most a * (1 - t) / t of them. With more
   parts of the hash range than that, they agree in some part, and in some part that isn't empty unless a set leaves
   so many empty that its documents get a key of their own. Each set gives a signature for each of its parts. The sets
   that share a signature are a bucket; of buckets with the same sets one is searched.
4. Links are found by T-occurrence search over inverted lists with DivideSkip: of a query's lists the short ones are
   heap-merged, and the documents that occur often enough there are probed for in the long ones by bisection, until they
   reach the overlap that their sizes ask for or no longer can. First each bucket's most central set is the query, once
   for all buckets that it is central to; what it reaches is one component. In buckets that are then of one component no
   pair is left to tell. The others are closed over chains to groups, and in a group every set outside of the largest
   component is a query against all others; or in each bucket by itself, if fewer n-grams are moved that way.

Queries and lists of a pivot, group or bucket are cut into blocks (BLOCK_MEMBERS, BLOCK_ITEMS) and each block of queries
meets each block of lists, so no task holds a whole group. A pivot is one query, so near copies of one text cost their
number, not its square. What can cost more is a bucket of many sets with no link between them that also share most
n-grams with yet others. No set or link is dropped anywhere.

Defined cases: words are runs of anything but ASCII white space, with A-Z lowered; a text of fewer words than an n-gram
has them all as its one element; null and empty texts have empty sets and link with nothing; a null doc_id never names a
component unless all in it are null; rows may repeat; a very long text is a chunk of its own; an empty table gives no
rows; other columns don't matter.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from heapq import merge
from itertools import groupby

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import drop_table, is_small, put, small, table
from corvane.llm.components import components

#: N-grams of a chunk, and of a hash range, that a task counts at once.
CHUNK_ITEMS, RANGE_ITEMS = 1_000_000, 2_000_000
#: Sets and n-grams of a block of lists, and n-grams of a block of queries.
BLOCK_MEMBERS, BLOCK_ITEMS = 512, 1_000_000
#: Of a chunk's n-gram: several of its sets hold it.
MANY = 0xFFFFFFFF
#: DivideSkip's constant: what a step of the heap costs against a probe.
MU = 0.01
CLASS_RATIO = 1.25


def shingle_sets(texts: list[str | None], n: int) -> Iterator:
    """The sorted distinct n-gram hashes (uint64) of each text."""
    import numpy as np

    from corvane.llm.wordhash import mix, words

    for hashes, bounds in words(texts):
        grams = hashes
        for k in range(1, n):
            grams = mix(mix(grams[: len(hashes) - k]) + hashes[k:]) if len(hashes) > k else grams[:0]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                whole = hashes[a : a + 1]
                for k in range(1, b - a):
                    whole = mix(mix(whole) + hashes[a + k : a + k + 1])
                yield mix(whole + np.uint64(b - a))
            else:
                yield hashes[:0]


def most_apart(a: int, percent: int) -> int:
    """How many elements a set of a and one no smaller can differ in at most and be similar."""
    return a * (100 - percent) // percent


@lru_cache(maxsize=None)
def size_class(number: int, percent: int) -> tuple[int, int, int, int]:
    """Least and greatest size of the class, greatest difference in it, and its number of parts."""
    first = -(-2 * percent // (100 - percent))  # below it sets differ in one element at most
    if number == 0:
        low = first
    else:
        low = size_class(number - 1, percent)[1] + 1
    high = max(low, int(low * CLASS_RATIO) - 1)
    apart = most_apart(high, percent)
    parts = apart + 1
    while True:  # until a set of the least size all but surely fills more than apart parts
        empty, two = (1 - 1 / parts) ** low, (1 - 2 / parts) ** low if parts > 2 else 0.0
        spread = math.sqrt(max(0.0, parts * (empty + (parts - 1) * two - parts * empty * empty)))
        if parts * (1 - empty) - 4 * spread > apart or parts > 4 * low:
            return low, high, apart, parts
        parts += 1 + parts // 50


def class_of(size: int, percent: int) -> int:
    number = 0
    while size_class(number, percent)[1] < size:
        number += 1
    return number


def signatures(grams, percent: int):
    """Keys of which two sets that are similar, but not equal, share one. grams: sorted distinct hashes."""
    import numpy as np

    from corvane.llm.wordhash import mix

    size = len(grams)
    first = size_class(0, percent)[0]
    out = []
    if most_apart(size, percent) and -(-percent * size // 100) < first:  # may be one element more or less than a small set
        each = mix(grams ^ np.uint64(0x5851F42D4C957F2D))
        whole = each.sum(dtype=np.uint64)
        out.append(mix(np.concatenate(([whole], whole - each)).astype(np.uint64)))
    if size >= first:
        for number in range(class_of(max(first, -(-percent * size // 100)), percent), class_of(size, percent) + 1):
            low, high, apart, parts = size_class(number, percent)
            part = (grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)  # ascending, as grams are
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            sums = np.add.reduceat(mix(grams ^ np.uint64(0x14057B7EF767814F)), starts)
            out.append(mix(sums + mix(part[starts] * np.uint64(1 << 20) + np.uint64(number))))
            if len(starts) <= apart:
                out.append(mix(np.array([number], np.uint64) + np.uint64(0x2545F4914F6CDD1D)))
    return np.unique(np.concatenate(out)) if out else grams[:0]


class Lists:
    """Inverted lists over sets (sorted distinct hashes), in order of size."""

    def __init__(self, sets: list, percent: int):
        import numpy as np

        self.order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
        self.sizes = [len(sets[k]) for k in self.order]
        items = np.concatenate([sets[k] for k in self.order]) if sets else np.zeros(0, np.uint64)
        by_item = np.argsort(items, kind="stable")
        items = items[by_item]
        first = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1]))) if len(items) else np.zeros(0, np.int64)
        self.distinct, self.bounds = items[first], np.append(first, len(items))
        self.docs = np.repeat(np.arange(len(sets)), self.sizes)[by_item]
        self.percent = percent

    def search(self, query, alive=None) -> list[int]:
        """The sets, as they were numbered, that are similar to the query. alive: by place in order, which to look at."""
        import numpy as np

        size, percent = len(query), self.percent
        low, high = bisect_left(self.sizes, -(-percent * size // 100)), bisect_right(self.sizes, 100 * size // percent)
        if low == high or not len(self.distinct):
            return []
        least = needed(size, max(1, self.sizes[low]), percent)
        at = np.minimum(np.searchsorted(self.distinct, query), len(self.distinct) - 1)
        own = at[self.distinct[at] == query]
        if len(own) < least:
            return []
        lists = []
        for s, e in zip(self.bounds[own].tolist(), self.bounds[own + 1].tolist(), strict=True):
            docs = self.docs[s:e].tolist()
            if docs[0] < low or docs[-1] >= high:
                docs = docs[bisect_left(docs, low) : bisect_left(docs, high)]
            if alive is not None:
                docs = [d for d in docs if alive[d]]
            if docs:
                lists.append(docs)
        if len(lists) < least:
            return []
        lists.sort(key=len)
        n_long = min(least - 1, int(least / (MU * math.log2(len(lists[-1]) + 1) + 1)))
        split = len(lists) - n_long
        found = []
        for doc, times in groupby(merge(*lists[:split])):
            count = sum(1 for _ in times)
            if count < least - n_long:
                continue
            need, left = needed(size, self.sizes[doc], percent), n_long
            for docs in lists[split:]:
                if count >= need or count + left < need:
                    break
                k = bisect_left(docs, doc)
                count += k < len(docs) and docs[k] == doc
                left -= 1
            if count >= need:
                found.append(self.order[doc])
        return found


def needed(a: int, b: int, percent: int) -> int:
    """Least overlap of similar sets of a and b elements."""
    return -(-percent * (a + b) // (100 + percent))


def links(queries: list, sets: list, asked: list, told: list, percent: int) -> list[tuple[int, int]]:
    """(query, set) similar to each other, such that with the components asked (of queries) and told (of sets) every similar pair is connected."""
    lists, found, names = Lists(sets, percent), [], {}

    def name(x):
        while x in names:
            x = names[x]
        return x

    for q, query in enumerate(queries):
        own = name(asked[q])
        alive = [name(told[k]) != own for k in lists.order]
        for k in lists.search(query, None if all(alive) else alive) if any(alive) else ():
            a, b = name(asked[q]), name(told[k])
            if a != b:
                names[b] = a
                found.append((q, k))
    return found


def _identity(grams) -> bytes:
    """128 bits of a set."""
    import numpy as np

    from corvane.llm.wordhash import mix

    salts = np.array([0x9E6C63D0876A9A35, 0xD1342543DE82EF95], np.uint64)
    return b"".join(int(mix(grams ^ s).sum(dtype=np.uint64) + np.uint64(len(grams))).to_bytes(8, "big") for s in salts)


def _described(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, _row (hash of id and text), _n and _id (of the set)."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(len(grams), _identity(grams)) for grams in shingle_sets(batch["text"].tolist(), n)]
            out = pd.DataFrame(rows, columns=["_n", "_id"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            out.insert(1, "_row", batch["_row"].to_numpy())
            yield out

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "_row", "text")
    out = rows.mapInPandas(describe, "doc_id string, _row bigint, _n bigint, _id binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _blob(*arrays) -> bytes:
    """Arrays of unsigned integers, by byte planes, compressed."""
    import numpy as np
    import zstandard

    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unblob(blob: bytes, *kinds: str) -> list:
    import numpy as np
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for kind, width in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).reshape(-1))
        at += n * width
    return out


def shared_enough(texts: DataFrame, n: int, percent: int, all_items: int, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """_id of each set of texts (text) of whose n-grams other texts hold percent or more. all_items: about how many n-grams
    there are; so many of the hashes' bits are compared that a thousandth of them clash, and a clash lets a set through at most."""
    ranges, bits = 1 + all_items // RANGE_ITEMS, min(64, max(24, all_items.bit_length() + 10))

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        held, items, number = [], 0, TaskContext.get().partitionId() << 32

        def flush() -> pd.DataFrame:
            keys = np.concatenate(held) >> np.uint64(64 - bits)
            owner = np.repeat(np.arange(len(held), dtype=np.uint32), [len(g) for g in held])
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            times = np.diff(np.append(first, len(keys)))
            inside = np.bincount(owner[np.repeat(times > 1, times)], minlength=len(held))
            keys, owner = keys[first], np.where(times > 1, np.uint32(MANY), owner[first])
            range_ = ((keys >> np.uint64(bits - 24)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate(([True], range_[1:] != range_[:-1], [True])))
            rows = [(int(range_[a]), number, 1, _blob(np.diff(keys[a:b], prepend=np.uint64(0)), owner[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            ids = np.frombuffer(b"".join(_identity(g) for g in held), np.uint64).reshape(-1, 2)
            rows.append((number % ranges, number, 0, _blob(ids[:, 0], ids[:, 1], np.array([len(g) for g in held], np.uint64), inside.astype(np.uint64))))
            return pd.DataFrame(rows, columns=["range", "chunk", "kind", "blob"])

        for batch in batches:
            for grams in shingle_sets(batch["text"].tolist(), n):
                if len(grams):
                    held.append(grams)
                    items += len(grams)
                if items >= chunk_items:
                    yield flush()
                    held, items, number = [], 0, number + 1
        if held:
            yield flush()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        now, held = None, []

        def done() -> pd.DataFrame:
            keys, owner = np.concatenate([k for _, k, _ in held]), np.concatenate([o for _, _, o in held])
            of = np.repeat(np.arange(len(held)), [len(k) for _, k, _ in held])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            shared = np.maximum.reduceat(owner[order], first) == MANY
            times = np.diff(np.append(first, len(keys)))
            hit = order[np.repeat(shared | (times > 1), times)]
            hit = np.sort(hit[owner[hit] != MANY])
            rows = []
            for a, b in zip(*(np.searchsorted(of[hit], np.arange(len(held)), side) for side in ("left", "right")), strict=True):
                if a < b:
                    sets, n_shared = np.unique(owner[hit[a:b]], return_counts=True)
                    rows.append((held[of[hit[a]]][0], 1, _blob(sets, n_shared.astype(np.uint32))))
            return pd.DataFrame(rows, columns=["chunk", "kind", "blob"])

        for batch in batches:
            yield batch.loc[batch["kind"] == 0, ["chunk", "kind", "blob"]]
            for range_, chunk, kind, blob in zip(batch["range"], batch["chunk"], batch["kind"], batch["blob"], strict=True):
                if not kind:
                    continue
                if range_ != now and held:
                    yield done()
                    held = []
                now = range_
                steps, owner = _unblob(blob, "<u8", "<u4")
                held.append((chunk, np.cumsum(steps, dtype=np.uint64), owner))
        if held:
            yield done()

    def enough(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        now, told, total = None, None, None

        def done() -> pd.DataFrame:
            ids = np.stack(told[:2], axis=1)[total * 100 >= percent * told[2].astype(np.int64)]
            return pd.DataFrame({"_id": [i.tobytes() for i in ids]})

        for batch in batches:
            for chunk, kind, blob in zip(batch["chunk"], batch["kind"], batch["blob"], strict=True):
                if chunk != now:
                    if told is not None:
                        yield done()
                    now, told = chunk, _unblob(blob, "<u8", "<u8", "<u8", "<u8")  # a chunk's own row is its first
                    total = told[3].astype(np.int64)
                if kind:
                    sets, n_shared = _unblob(blob, "<u4", "<u4")
                    total[sets] += n_shared
        if told is not None:
            yield done()

    packed = texts.select("text").mapInPandas(runs, "range bigint, chunk bigint, kind int, blob binary")
    counted = packed.repartition(ranges, "range").sortWithinPartitions("range").mapInPandas(count, "chunk bigint, kind int, blob binary")
    counted = put(counted, "join-counted", "uncompressed")
    able = put(counted.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInPandas(enough, "_id binary").distinct(), "join-able")
    drop_table(counted)
    return able


def _search(rows: DataFrame, percent: int, of: str) -> DataFrame:
    """u, v: links between queries and lists (_asks) of the same key (of) and block (_i, _j). rows: also _id, _comp, _grams."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        now, held = None, ([], [])

        def done() -> pd.DataFrame:
            (sets, queries) = held
            found = links([g for _, _, g in queries], [g for _, _, g in sets], [c for _, c, _ in queries], [c for _, c, _ in sets], percent) if sets and queries else []
            return pd.DataFrame([(queries[q][0], sets[k][0]) for q, k in found], columns=["u", "v"])

        for batch in batches:
            for key, i, j, asks, name, comp, grams in zip(*[batch[c] for c in (of, "_i", "_j", "_asks", "_id", "_comp", "_grams")], strict=True):
                if (key, i, j) != now:
                    yield done()
                    now, held = (key, i, j), ([], [])
                held[asks].append((name, comp, np.frombuffer(grams, np.uint64)))
        yield done()

    keys = (of, "_i", "_j")
    ordered = rows.select(*keys, "_asks", "_id", "_comp", "_grams").repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInPandas(find, "u binary, v binary")


def _blocks(rows: DataFrame, of: str, sets: DataFrame, block_members: int, block_items: int) -> DataFrame:
    """What _search takes of rows (of, _id, _comp, _asks): queries go to each block of lists, lists to each block of queries."""
    sized = rows if "_n" in rows.columns else rows.join(sets.select("_id", "_n"), "_id")
    listed, asked = ~F.col("_asks"), F.col("_asks")
    cut = lambda which, members: F.greatest(F.lit(1), F.ceil(F.sum(F.when(which, F.col("_n"))) / block_items), F.ceil(F.count_if(which) / members)).cast("int")
    counts = put(sized.groupBy(of).agg(cut(asked, block_members).alias("_qs"), cut(listed, block_members).alias("_ls")), "join-blocks")
    spread = lambda n, salt: F.pmod(F.xxhash64("_id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    placed = rows.join(small(counts), of).withColumn("_i", F.explode(F.when(F.col("_asks"), F.array(spread("_qs", 1))).otherwise(every("_qs"))))
    placed = placed.withColumn("_j", F.explode(F.when(F.col("_asks"), every("_ls")).otherwise(F.array(spread("_ls", 2)))))
    placed = placed.select(of, "_i", "_j", "_id", "_comp", F.col("_asks").cast("int").alias("_asks"))
    return placed.join(sets.select("_id", "_grams"), "_id")


def set_links(sets: DataFrame, percent: int, block_members: int = BLOCK_MEMBERS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """node and label, the least set that links lead to, of each linked set. sets, a written table: _id, _n, _grams, _sigs."""
    members = sets.select("_id", F.explode("_sigs").alias("_sig"))
    # Buckets of the same sets are told by their number and two sums of hashes; the one of the least signature stands for all.
    told = (F.count(F.lit(1)).alias("_size"), F.bit_xor(F.xxhash64("_id")).alias("_x"), F.sum(F.xxhash64("_id", F.lit(1)).bitwiseAND((1 << 40) - 1)).alias("_y"))
    buckets = members.groupBy("_sig").agg(*told).filter("_size > 1").groupBy("_size", "_x", "_y").agg(F.min("_sig").alias("_sig"))
    buckets = put(buckets.select("_sig", "_size"), "join-buckets")
    members = put(members.join(small(buckets), "_sig"), "join-members")
    # A bucket's pivot is its set with the most company over all buckets.
    central = put(members.groupBy("_id").agg(F.sum("_size").alias("_score")), "join-central")
    pivots = members.join(small(central), "_id").groupBy("_sig").agg(F.max(F.struct("_score", "_id"))["_id"].alias("_pivot"))
    edges = members.join(small(put(pivots, "join-pivots")), "_sig").filter("_id != _pivot").select("_id", "_pivot").distinct()
    edges = put(edges, "join-edges")
    asks = edges.select("_pivot", F.col("_pivot").alias("_id")).distinct().select("_pivot", "_id", F.col("_id").alias("_comp"), F.lit(True).alias("_asks"))
    lists = edges.select("_pivot", "_id", F.col("_id").alias("_comp"), F.lit(False).alias("_asks"))
    first = put(_search(_blocks(lists.unionByName(asks), "_pivot", sets, block_members, block_items), percent, "_pivot"), "join-links")
    reached = components(first)
    # A bucket of two sets is done, and so is one whose sets are all of one component.
    named = members.filter("_size > 2").join(small(put(reached, "join-reached")), F.col("_id") == F.col("node"), "left")
    named = put(named.select("_sig", "_id", F.coalesce("label", "_id").alias("_comp")), "join-named")
    parts = named.groupBy("_sig", "_comp").agg(F.min("_id").alias("_first")).groupBy("_sig").agg(F.min("_first").alias("_first"), F.count(F.lit(1)).alias("_c"))
    left = put(named.join(small(put(parts.filter("_c > 1").drop("_c"), "join-open")), "_sig"), "join-left")
    groups = put(components(left.select(F.col("_id").alias("u"), F.col("_first").alias("v"))), "join-groups")
    left = put(left.join(small(groups), F.col("_id") == F.col("node")).join(sets.select("_id", "_n"), "_id").select("_sig", "_id", "_comp", "_n", F.col("label").alias("_group")), "join-left")
    whole = put(left.select("_group", "_id", "_comp", "_n").distinct(), "join-whole")
    in_groups, in_buckets = (put(_asked(rows, of), "join-asked") for rows, of in ((whole, "_group"), (left, "_sig")))
    blocks = lambda which: F.greatest(F.lit(1), F.ceil(F.sum(F.when(which, F.col("_n"))) / block_items), F.ceil(F.count_if(which) / block_members))
    moved = F.sum(F.when(F.col("_asks"), F.col("_n")).otherwise(0)) * blocks(~F.col("_asks")) + F.sum(F.when(F.col("_asks"), 0).otherwise(F.col("_n"))) * blocks(F.col("_asks"))
    costs = in_groups.groupBy("_group").agg(moved.alias("_whole")).join(in_buckets.groupBy("_group").agg(F.sum("_n").alias("_parts")), "_group")
    parted = small(put(costs.filter("_whole > _parts").select("_group"), "join-parted"))
    second = _search(_blocks(in_groups.join(parted, "_group", "left_anti"), "_group", sets, block_members, block_items), percent, "_group")
    third = _search(_blocks(in_buckets.join(parted, "_group", "left_semi"), "_sig", sets, block_members, block_items), percent, "_sig")
    return components(first.unionByName(put(second.unionByName(third), "join-links")))


def _asked(rows: DataFrame, of: str) -> DataFrame:
    """rows (of, _group, _id, _comp, _n) with _asks false, and again with _asks true where a set isn't of the component with most sets of its key."""
    main = rows.groupBy(of, "_comp").agg(F.count(F.lit(1)).alias("_k")).groupBy(of).agg(F.max(F.struct("_k", "_comp"))["_comp"].alias("_main"))
    asks = rows.join(small(put(main, "join-main")), of).filter("_comp != _main").drop("_main")
    return rows.withColumn("_asks", F.lit(False)).unionByName(asks.withColumn("_asks", F.lit(True)))


def join_components(docs: DataFrame, n: int = 5, percent: int = 80, block_members: int = BLOCK_MEMBERS, block_items: int = BLOCK_ITEMS, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """doc_id, n_shingles, component_id and _row for each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_row"))
    described = put(_described(docs, n), "join-described")
    vertices = described.filter("_n > 0").groupBy("_id").agg(F.first("_n").alias("_n"), F.min("doc_id").alias("_least"), F.min(F.struct("doc_id", "_row")).alias("_rep"))
    vertices = put(vertices, "join-vertices")
    copies = described.filter("_n > 0").join(vertices.select("_id", "_rep"), "_id").filter("NOT (doc_id <=> _rep.doc_id AND _row = _rep._row)")
    copies = put(copies.select(F.col("doc_id").alias("_doc"), F.col("_row").alias("_of")).distinct(), "join-copies")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_row") == F.col("_of"))
    alone = docs.join(small(copies), same, "left_anti")
    if not is_small(copies):  # chunks ask for rows in the same order should a task run twice
        alone = put(alone, "join-alone")
    items = vertices.agg(F.sum("_n")).first()[0] or 0
    able = shared_enough(alone, n, percent, items, chunk_items)
    if not is_small(copies):
        drop_table(alone)
    wanted = vertices.join(small(able), "_id", "left_semi").select("_id", F.col("_rep.doc_id").alias("_doc"), F.col("_rep._row").alias("_of"))
    texts = docs.join(small(put(wanted, "join-wanted")), same).groupBy("_id").agg(F.first("text").alias("text"))

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            rows = [(len(g), g.tobytes(), signatures(g, percent).view(np.int64)) for g in shingle_sets(batch["text"].tolist(), n)]
            out = pd.DataFrame(rows, columns=["_n", "_grams", "_sigs"])
            out.insert(0, "_id", batch["_id"].to_numpy())
            yield out

    sets = put(texts.mapInPandas(to_sets, "_id binary, _n bigint, _grams binary, _sigs array<bigint>"), "join-sets")
    found = put(set_links(sets, percent, block_members, block_items), "join-found")
    drop_table(sets)
    named = vertices.select("_id", "_least").join(small(found), F.col("_id") == F.col("node"), "left").withColumn("_label", F.coalesce("label", "_id"))
    least = named.groupBy("_label").agg(F.min("_least").alias("component_id"))
    names = put(named.join(least, "_label").select("_id", "component_id"), "join-names")
    out = described.join(names, "_id", "left")
    return out.select("doc_id", F.col("_n").alias("n_shingles"), F.when(F.col("_n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "_row")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Of each component the rows whose doc_id names it (all rows with empty sets and all without an id), with docs' own columns."""
    own = docs.columns
    names = [f"c{i}" for i in range(len(own))]
    inner = docs.toDF(*names).withColumns({n: F.col(names[own.index(n)]) for n in ("doc_id", "text")})
    joined = join_components(inner, n, percent)
    gone = put(joined.filter("doc_id != component_id").select(F.col("doc_id").alias("_gone"), F.col("_row").alias("_of")).distinct(), "join-gone")
    kept = inner.join(small(gone), (F.col("doc_id") == F.col("_gone")) & (F.xxhash64("doc_id", "text") == F.col("_of")), "left_anti")
    return kept.select(*[F.col(c).alias(n) for c, n in zip(names, own, strict=True)])


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"), 3, 90).drop("_row")


ORACLE: dict[str, str] = {}
QUERIES = {"op2_ngram_join": op2_ngram_join}
