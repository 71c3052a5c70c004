"""Token counts by a linear longest-match automaton.

The vocabulary's trie gets failure links: where the text leaves the trie at a node, the link leads to the node of what
is left of its string once the longest tokens are popped off, and each link carries how many those are. A word's count
is thus had in one pass over its bytes, and its pieces are never built. Counts of words are kept in a bounded cache.

A word is a run of anything but ASCII white space. Its first piece is looked for with a space before it, as the
vocabulary writes word starts; all bytes are tokens, so every word has an answer.

Defined cases: a null or empty text has 0 words and 0 pieces; a null doc_id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import table

CACHE_WORDS = 600_000


def _with_text_ids(rows: DataFrame, f, schema: str) -> DataFrame:
    """mapInPandas with doc_id as text on the way: beside nulls, pandas would make floats of ids."""
    out = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(f, f"doc_id string, {schema}")
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a file of ranks."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class LongestMatch:
    """count(word) -> the number of tokens in its greedy longest-match segmentation, or None if it has none."""

    def __init__(self, tokens: Iterable[bytes]):
        step, ends, tree = {}, [False], [[]]  # step: node << 8 | byte -> node
        for token in tokens:
            node = 0
            for byte in token:
                if (nxt := step.get(node << 8 | byte)) is None:
                    nxt = step[node << 8 | byte] = len(ends)
                    ends.append(False)
                    tree.append([])
                    tree[node].append((byte, nxt))
                node = nxt
            ends[node] = bool(node)
        fail, popped, queue = [-1] * len(ends), [0] * len(ends), [0]
        for node in queue:  # shorter strings first
            for byte, child in tree[node]:
                queue.append(child)
                if ends[child]:
                    fail[child], popped[child] = 0, 1
                    continue
                at, n = fail[node], popped[node]
                while at >= 0 and (nxt := step.get(at << 8 | byte)) is None:
                    n += popped[at]
                    at = fail[at]
                if at >= 0:
                    fail[child], popped[child] = nxt, n
        self.step, self.fail, self.popped = step, fail, popped

    def count(self, word: bytes) -> int | None:
        step, fail, popped, node, n = self.step.get, self.fail, self.popped, 0, 0
        for byte in word:
            while (nxt := step(node << 8 | byte)) is None:
                if fail[node] < 0:
                    return None
                n += popped[node]
                node = fail[node]
            node = nxt
        while node > 0:
            if fail[node] < 0:
                return None
            n += popped[node]
            node = fail[node]
        return n


_matchers: dict[str, tuple[LongestMatch, dict[bytes, int]]] = {}


def token_counts(docs: DataFrame, vocabulary: str, cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, n_words, n_pieces for docs (doc_id, text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if vocabulary not in _matchers:
            _matchers[vocabulary] = LongestMatch(read_ranks(vocabulary)), {}
        matcher, cache = _matchers[vocabulary]
        for batch in batches:
            words, pieces = [], []
            for text in batch["text"]:
                own = (text or "").encode().split()
                for w in own if len(own) < 64 else set(own):
                    if w not in cache:
                        if len(cache) >= cache_words:
                            cache.clear()
                        cache[w] = matcher.count(b" " + w)
                try:
                    pieces.append(sum(map(cache.__getitem__, own)))
                except KeyError:  # the cache was emptied on the way
                    pieces.append(sum(matcher.count(b" " + w) for w in own))
                words.append(len(own))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": words, "n_pieces": pieces})

    return _with_text_ids(docs.select("doc_id", "text"), count, "n_words bigint, n_pieces bigint")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


ORACLE: dict[str, str] = {}
QUERIES = {"op10_token_counts": op10_token_counts}
