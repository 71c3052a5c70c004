"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import resampling

DOCS = [(1, "Ab cd, Ab"), (None, "nul é1 x"), (2, None), (3, ""), (3, " \n--"), (4, "ab cd " * 30), (4, "ab cd " * 30), (5, "x y z " * 9), (5, "other WORDS " * 12), (2**60 + 1, "İ ſ ab_cd 日本 " * 7), (6, "lone" * 40)]


def brute(docs, target, runs, buckets, percent, least):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    grams = lambda w: [" ".join(w[i : i + k]) for k in range(1, runs + 1) for i in range(len(w) - k + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in docs for g in grams(words(t)))
    t = Counter(bucket(g) for x in target for g in grams(words(x)))
    all_s, all_t = s.total() + buckets, t.total() + buckets
    rows = []
    for doc, text in docs:
        own = grams(words(text))
        weight = sum(math.floor(1000 * math.log((t[bucket(g)] + 1) * all_s / ((s[bucket(g)] + 1) * all_t))) for g in own)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(words(text)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("runs,chunk", [(1, 1 << 18), (1, 20), (3, 1 << 18), (3, 17)])
def test_resample(spark, runs, chunk):
    docs = spark.createDataFrame([(*d, "x", 7) for d in DOCS], "doc_id bigint, text string, digest string, times int").repartition(3)
    target = ["ab x other", None, "", "cd cd 日本"]
    aims = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = resampling.resample(docs, aims, runs, 50, 2024, 60, 3, chunk).collect()
    assert sorted(map(tuple, got), key=str) == brute(DOCS, target, runs, 50, 60, 3)
    assert resampling.resample(docs.limit(0), aims).count() == 0
    assert {r.weight for r in resampling.resample(docs, aims.limit(0), runs, 50).collect()} != {0}


def test_equal_rows_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(resampling, "COPIES", 2)
    docs = [(7, "a b c")] * 11 + [(8, "a")]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([("b",)], "text string"), 1, 50, 2024, 70, 1).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, ["b"], 1, 50, 70, 1)


@settings(max_examples=200, deadline=None)
@given(words=st.lists(st.binary(min_size=1, max_size=4).map(lambda b: b.replace(b" ", b"x")), max_size=20), size=st.integers(1, 12), carry=st.integers(0, 3), gap=st.integers(1, 3))
def test_chunks_own_every_word_once(words, size, carry, gap):
    words = [w for w in words if w.split() == [w]]
    at = 0
    for part, own in resampling.chunks((b" " * gap).join(words), size, carry):
        assert part.split() == words[at : at + own + carry]
        at += own
    assert at == len(words)
