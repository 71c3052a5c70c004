"""Language-model scoring by an n-gram trie of three levels in Elias-Fano form.

Training counts every word, pair and triple of the training texts. A task sorts and sums what it has read and sends each
shard one packed, compressed run of keys and counts; a shard merges its runs and writes its part of a level as one file
in the shared folder, which every scoring task maps into memory:

- level 1: the words' hashes, ascending (a word's id is its place), and their counts;
- level 2: for each word the start of its successors (monotone pointers), the successors' ids in sequence with their word,
  quantised log10 probabilities, and each word's quantised back-off;
- level 3: for each pair the start of its successors; a successor is told by its place among the successors of the pair's
  second word, a small number, in sequence with its pair; quantised probabilities and back-offs.

Probabilities are smoothed by absolute discounting: what is discounted goes to the next shorter context. What is
discounted from words is the unknown word's. A text is scored as its words followed by one end, after a start.

Counts are exact over all training texts, and every pair and triple seen LEAST times, which is once, is in the model. Words are 64-bit hashes of what is between ASCII
white space, with A-Z lowered.

Defined cases: null and empty texts are the end alone; with nothing to learn from, every token is unknown and the
model's score is 0; a null doc_id stays null; rows may repeat; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import crc_mod, put, scratch, table

#: Times that a pair or triple must occur to be kept.
LEAST = 1
DISCOUNT = 0.75
#: Tokens that a task sums at a time, and that a shard of level 2 or 3 is for.
RUN_TOKENS, SHARD_TOKENS = 3_000_000, 2_000_000
WORD_SHARDS = 64
#: Megabytes of text whose tokens are looked up at once.
CHUNKS = 3
#: Steps of a tenfold, of 255 at most, in quantised probabilities and back-offs.
PROB_STEPS, BACK_STEPS = 24, 64
END = 0x27D4EB2F165667C5  # stands for the end among the words' hashes


def _streams(texts: list[str | None]):
    """For runs of texts: all tokens' hashes with ends, and where each text ends."""
    import numpy as np

    from corvane.llm.wordhash import words

    for hashes, bounds in words(texts, chunks=CHUNKS):
        n = len(bounds) - 1
        ends = bounds[1:] + np.arange(n)
        tokens = np.full(len(hashes) + n, END, np.uint64)
        inside = np.ones(len(tokens), bool)
        inside[ends] = False
        tokens[inside] = hashes
        yield tokens, ends + 1


def _packed(keys, counts) -> bytes:
    """Ascending keys and counts: differences by byte planes, compressed."""
    import numpy as np
    import zstandard

    steps = np.diff(keys, prepend=keys.dtype.type(0)).astype(np.uint64)
    planes = np.concatenate((steps.view(np.uint8).reshape(-1, 8).T.reshape(-1), counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.reshape(-1)))
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(blob: bytes):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(2, 8, -1)
    steps, counts = (np.ascontiguousarray(p.T).view(np.uint64).reshape(-1) for p in planes)
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


def _summed(keys, counts):
    import numpy as np

    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _count(texts: DataFrame, keys_of: Callable, shard_of: Callable, shards: int, build: Callable, schema: str) -> DataFrame:
    """The table of what build(shard, keys, counts) returns for each shard of the keys that keys_of(streams) gives."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        held, size = [], 0

        def flush() -> pd.DataFrame:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            shard = shard_of(keys)
            cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(keys) else [0]
            rows = [(int(shard[a]), _packed(keys[a:b], counts[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pd.DataFrame(rows, columns=["shard", "run"])

        for batch in batches:
            for tokens, ends in _streams(batch["text"].tolist()):
                held.append(keys_of(tokens, ends))
                size += len(held[-1])
                if size >= RUN_TOKENS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        now, held = None, []

        def done() -> pd.DataFrame:
            keys, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            return pd.DataFrame([build(now, keys, counts)])

        for batch in batches:
            for shard, run in zip(batch["shard"], batch["run"], strict=True):
                if shard != now and held:
                    yield done()
                    held = []
                now = int(shard)
                held.append(_unpacked(run))
                if sum(len(k) for k, _ in held) > 2 * SHARD_TOKENS and len(held) > 8:
                    held = [_summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
        if held:
            yield done()

    packed = texts.mapInPandas(runs, "shard int, run binary")
    return put(packed.repartition(shards, "shard").sortWithinPartitions("shard").mapInPandas(merged, schema), "lm-level")


def _save(folder: str, name: str, shard: int, data: bytes) -> str:
    from corvane.llm.files import write_file

    path = f"{folder}/{name}-{shard:06d}-{TaskContext.get().taskAttemptId()}.ef"
    write_file(path, data)
    return path


def _spans(keys, bounds: list[int]):
    """Each k with keys, which ascend, from bounds[k] to below bounds[k + 1], and the slice of these."""
    import numpy as np

    cuts = np.searchsorted(keys, np.array(bounds, np.int64)).tolist()
    for k, (a, b) in enumerate(itertools.pairwise(cuts)):
        if a < b:
            yield k, slice(a, b)


class Trie:
    """What the driver knows of the levels, and the maps of a worker."""

    def __init__(self, words: list[tuple], pairs: list[tuple] = (), triples: list[tuple] = ()):
        """words: (shard, path, types, tokens). pairs: (shard, path, pairs, widest). triples: (shard, path, triples)."""
        self.words = sorted(words)
        self.types, self.tokens = sum(w[2] for w in words), sum(w[3] for w in words)
        self.word_start = [0]
        for w in self.words:
            self.word_start.append(self.word_start[-1] + w[2])
        self.shards = max(1, math.ceil(self.tokens / SHARD_TOKENS))
        self.pairs = {p[0]: p for p in pairs}
        self.pair_start = [0]
        for k in range(self.shards):
            self.pair_start.append(self.pair_start[-1] + (self.pairs[k][2] if k in self.pairs else 0))
        self.width = max([1, *(p[3] for p in pairs)])
        self.triples = {t[0]: t for t in triples}
        self.start_id = self.types  # of the start, beyond all words

    # A context's shard: words by id, pairs by the shard of level 2 that they are in.
    def shard_of_word(self, ids):
        return ids * self.shards // (self.types + 1)

    def first_word(self, shard: int) -> int:
        return -(-shard * (self.types + 1) // self.shards)

    def open(self, path: str, *sequences: str):
        from corvane.llm.elias_fano import EliasFano, unpack
        from corvane.llm.files import map_file

        if path not in _maps:
            if len(_maps) > 1 << 15:
                _maps.clear()
            arrays, told = unpack(map_file(path))
            _maps[path] = arrays, told, {s: EliasFano(arrays, told, s) for s in sequences}
        return _maps[path]

    def ids(self, hashes):
        """Ids of words, -1 for unknown ones, and their counts."""
        import numpy as np

        distinct, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        shard = (distinct >> np.uint64(58)).astype(np.int64)
        for k, w in enumerate(self.words):
            a, b = np.searchsorted(shard, w[0]), np.searchsorted(shard, w[0], "right")
            if a < b:
                arrays, _, seq = self.open(w[1], "hash")
                at = seq["hash"].find(distinct[a:b] & np.uint64((1 << 58) - 1))
                ids[a:b] = np.where(at >= 0, at + self.word_start[k], -1)
                counts[a:b] = np.where(at >= 0, arrays["counts"][np.maximum(at, 0)], 0)
        return ids[back], counts[back]

    def counts(self, ids):
        """Counts of known ids, ascending or not."""
        import numpy as np

        out, order = np.zeros(len(ids), np.int64), np.argsort(ids)
        ascending = ids[order]
        for k, own in _spans(ascending, self.word_start):
            out[order[own]] = self.open(self.words[k][1], "hash")[0]["counts"][ascending[own] - self.word_start[k]]
        return out

    def log_word(self, counts):
        """log10 of the words' own probabilities, from their counts."""
        import numpy as np

        if not self.tokens:
            return np.zeros(len(counts))
        unknown = math.log10(DISCOUNT * self.types / self.tokens)
        return np.where(counts > 0, np.log10(np.maximum(counts - DISCOUNT, 0.01) / self.tokens), unknown)

    def pair_spans(self, keys):
        """For ascending keys of pairs (first * (types + 1) + second): each shard of level 2 and the slice of its keys; -1 is in none."""
        return _spans(keys, [self.first_word(k) * (self.types + 1) for k in range(self.shards + 1)])

    def triple_spans(self, keys):
        """The same for keys of triples (pair * width + place) and level 3, whose shards are those of their pairs."""
        return _spans(keys, [n * self.width for n in self.pair_start])

    def _pairs(self, first, second):
        """Of each pair of ids, where the first is known: its number or -1, its place among the successors of its first word, the log10 probability
        of the second word or, where the pair isn't in the model, of the back-off to that word alone, and that to the pair as a context.

        Pairs are looked up in order, so that a shard has a slice of them and work doesn't grow with the number of shards."""
        import numpy as np

        key = np.where(first >= 0, first * (self.types + 1) + np.where(second >= 0, second, self.types), -1)
        distinct, back = np.unique(key, return_inverse=True)
        number, place, told, onward = np.full(len(distinct), -1, np.int64), np.full(len(distinct), -1, np.int64), np.zeros(len(distinct)), np.zeros(len(distinct))
        for k, own in self.pair_spans(distinct):
            if k not in self.pairs:
                continue
            arrays, _, seq = self.open(self.pairs[k][1], "next", "starts")
            keys = distinct[own] - self.first_word(k) * (self.types + 1)
            word, at = keys // (self.types + 1), seq["next"].find(keys)
            hit = np.flatnonzero(at >= 0)
            found = at[hit]
            backed = arrays["back"][word] / -BACK_STEPS
            backed[hit] = arrays["probs"][found] / -PROB_STEPS
            told[own] = backed
            hit += own.start
            number[hit] = found + self.pair_start[k]
            own_word = word[hit - own.start]
            new = np.flatnonzero(np.concatenate(([True], own_word[1:] != own_word[:-1]))) if len(hit) else hit
            place[hit] = found - np.repeat(seq["starts"].access(own_word[new]), np.diff(new, append=len(hit)))
            if k in self.triples:
                onward[hit] = self.open(self.triples[k][1], "next", "starts")[0]["back"][found] / -BACK_STEPS
        return number[back], place[back], told[back], onward[back]

    def log_probs(self, ids, counts, first):
        """log10 probability of each token in its text, which the flags in first start."""
        import numpy as np

        _, pairs, before_pairs, places, both, told, onward = self.context(ids, first)
        out = np.where(pairs >= 0, told, told + self.log_word(counts))
        hit = np.flatnonzero(both)
        key = before_pairs[hit] * self.width + places[hit]
        order = np.argsort(key)
        key, hit = key[order], hit[order]
        out = np.where(before_pairs >= 0, np.concatenate(([0.0], onward[:-1])) + out, out) if len(ids) else out
        for k, own in self.triple_spans(key):
            if k in self.triples:
                arrays, _, seq = self.open(self.triples[k][1], "next", "starts")
                at = seq["next"].find(key[own] - self.pair_start[k] * self.width)
                kept = at >= 0
                out[hit[own][kept]] = arrays["probs"][at[kept]] / -PROB_STEPS
        return out

    def context(self, ids, first):
        """Of each token: the id before it, the number of their pair, that of the pair before, the place of their pair, whether both pairs are in the model,
        and what _pairs() tells of probabilities."""
        import numpy as np

        before = np.concatenate(([self.start_id], ids[:-1])) if len(ids) else ids
        before = np.where(first, self.start_id if self.types else -1, before)
        pairs, places, told, onward = self._pairs(before, ids)
        before_pairs = np.concatenate(([-1], pairs[:-1])) if len(ids) else pairs
        before_pairs = np.where(first, -1, before_pairs)
        both = (pairs >= 0) & (before_pairs >= 0)
        return before, pairs, before_pairs, places, both, told, onward


_maps: dict = {}


def _flags(ends, n: int):
    import numpy as np

    first = np.zeros(n, bool)
    first[np.concatenate(([0], ends[:-1]))] = True
    return first


def _quantised(log10, steps: int):
    import numpy as np

    return np.clip(np.rint(-log10 * steps), 0, 255).astype(np.uint8)


def train(texts: DataFrame) -> Trie:
    """The trie of texts (text), its files in the shared folder."""
    folder = scratch(texts.sparkSession, "lm")
    texts = texts.select("text")

    def word_file(shard: int, keys, counts):
        import numpy as np

        from corvane.llm.elias_fano import EliasFano, pack

        arrays, told = EliasFano.build(keys & np.uint64((1 << 58) - 1), 1 << 58, "hash")
        path = _save(folder, "words", shard, pack(arrays | {"counts": counts.astype(np.uint32 if counts.max() < 1 << 32 else np.uint64)}, **told))
        return {"shard": shard, "path": path, "types": len(keys), "tokens": int(counts.sum())}

    words = _count(texts, lambda tokens, ends: tokens, lambda keys: keys >> 58, WORD_SHARDS, word_file, "shard int, path string, types bigint, tokens bigint")
    trie = Trie([tuple(r) for r in words.collect()])  # a row for each file
    if not trie.types:
        return trie

    def pair_keys(tokens, ends):
        import numpy as np

        ids, first = trie.ids(tokens)[0], _flags(ends, len(tokens))
        before = np.where(first, trie.start_id, np.concatenate(([0], ids[:-1])))
        return (before * (trie.types + 1) + ids).astype(np.uint64)

    def pair_file(shard: int, keys, counts):
        import numpy as np

        from corvane.llm.elias_fano import EliasFano, pack

        low, high = trie.first_word(shard), trie.first_word(shard + 1)
        base = low * (trie.types + 1)
        keys = keys.astype(np.int64) - base
        word = keys // (trie.types + 1)
        total = np.bincount(word, counts, high - low)
        kept = counts >= LEAST
        keys, counts, word = keys[kept], counts[kept], word[kept]
        mass = np.bincount(word, counts - DISCOUNT, high - low)
        left = np.clip(1 - mass / np.maximum(total, 1), 1e-4, 1)
        p = (counts - DISCOUNT) / total[word] + left[word] * 10 ** trie.log_word(trie.counts(keys % (trie.types + 1)))
        starts = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=high - low))))
        parts = [EliasFano.build(keys, (high - low) * (trie.types + 1), "next"), EliasFano.build(starts, len(keys) + 1, "starts")]
        arrays = {"probs": _quantised(np.log10(p), PROB_STEPS), "back": _quantised(np.log10(left), BACK_STEPS), "counts": np.minimum(counts, (1 << 32) - 1).astype(np.uint32)}
        path = _save(folder, "pairs", shard, pack(parts[0][0] | parts[1][0] | arrays, **parts[0][1], **parts[1][1]))
        return {"shard": shard, "path": path, "pairs": len(keys), "widest": int(np.diff(starts).max(initial=0))}

    pairs = _count(texts, pair_keys, lambda keys: trie.shard_of_word(keys.astype("int64") // (trie.types + 1)), trie.shards, pair_file, "shard int, path string, pairs bigint, widest bigint")
    trie = Trie(trie.words, [tuple(r) for r in pairs.collect()])

    def triple_keys(tokens, ends):
        import numpy as np

        # Every triple's pairs are kept, so only the tokens that no pair goes before are left out.
        _, _, before_pairs, places, both, _, _ = trie.context(trie.ids(tokens)[0], _flags(ends, len(tokens)))
        return (before_pairs[both] * trie.width + places[both]).astype(np.uint64)

    def triple_shard(keys):
        import numpy as np

        return np.searchsorted(trie.pair_start, keys.astype(np.int64) // trie.width, "right") - 1

    def triple_file(shard: int, keys, counts):
        import numpy as np

        from corvane.llm.elias_fano import EliasFano, pack

        arrays2, _, seq2 = trie.open(trie.pairs[shard][1], "next", "starts")
        n, base = trie.pairs[shard][2], trie.pair_start[shard]
        kept = counts >= LEAST
        keys, counts = keys[kept].astype(np.int64) - base * trie.width, counts[kept]
        pair, place = keys // trie.width, keys % trie.width
        total = arrays2["counts"].astype(np.int64)
        mass = np.bincount(pair, counts - DISCOUNT, n)
        left = np.clip(1 - mass / np.maximum(total, 1), 1e-4, 1)
        # The second word's successor at that place, and its probability after that word.
        second = seq2["next"].access(pair) % (trie.types + 1)
        p2, order = np.zeros(len(keys)), np.argsort(second)
        second, place = second[order], place[order]
        for k, own in _spans(second, [trie.first_word(k) for k in range(trie.shards + 1)]):
            arrays, _, seq = trie.open(trie.pairs[k][1], "next", "starts")
            p2[order[own]] = 10 ** (arrays["probs"][seq["starts"].access(second[own] - trie.first_word(k)) + place[own]] / -PROB_STEPS)
        p = np.minimum(1, (counts - DISCOUNT) / total[pair] + left[pair] * p2)
        starts = np.concatenate(([0], np.cumsum(np.bincount(pair, minlength=n))))
        parts = [EliasFano.build(keys, n * trie.width, "next"), EliasFano.build(starts, len(keys) + 1, "starts")]
        arrays = {"probs": _quantised(np.log10(p), PROB_STEPS), "back": _quantised(np.log10(left), BACK_STEPS)}
        path = _save(folder, "triples", shard, pack(parts[0][0] | parts[1][0] | arrays, **parts[0][1], **parts[1][1]))
        return {"shard": shard, "path": path, "triples": len(keys)}

    triples = _count(texts, triple_keys, triple_shard, trie.shards, triple_file, "shard int, path string, triples bigint")
    return Trie(trie.words, list(trie.pairs.values()), [tuple(r) for r in triples.collect()])


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score for docs (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        n, v = trie.tokens, trie.types
        for batch in batches:
            out = []
            for tokens, ends in _streams(batch["text"].tolist()):
                starts = np.concatenate(([0], ends[:-1]))
                ids, counts = trie.ids(tokens)
                base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
                own = trie.log_probs(ids, counts, _flags(ends, len(tokens)))
                out.append([ends - starts, np.add.reduceat((counts > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(own, starts)])
            columns = [np.concatenate([o[k] for o in out]) for k in range(4)] if out else [[]] * 4
            yield pd.DataFrame(dict(zip(("doc_id", "n_tokens", "n_known", "base_score", "score"), (batch["doc_id"].to_numpy(), *columns), strict=True)))

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    scored = rows.mapInPandas(run, "doc_id string, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 10) == 0
    trie = train(docs.filter(~held_out))
    return score(docs, trie).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(trie.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


ORACLE: dict[str, str] = {}
QUERIES = {"op9_lm_scores": op9_lm_scores}
