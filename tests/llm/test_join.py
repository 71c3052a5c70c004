"""The n-gram join against all pairs."""

import random
import re

import numpy as np
import pytest

from corvane.llm import ngram_join
from corvane.llm.components import components
from corvane.llm.wordhash import features, words, NOT_ALNUM
from corvane.llm import wordhash


def sets_of(rows, n):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        out.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    return out


def brute(rows, n, percent):
    sets = sets_of(rows, n)
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    base = [[f"w{draw.randint(0, 300)}" for _ in range(draw.choice([1, 2, 4, 9, 12, 20, 30, 90]))] for _ in range(24)]
    common = [f"c{k}" for k in range(50)]
    out = []
    for i in range(260):
        w = list(draw.choice(base)) + (common if draw.random() < 0.3 else [])
        for _ in range(draw.choice([0, 0, 1, 1, 2])):
            k = draw.randrange(len(w) + 1)
            w[k : k + draw.choice([0, 1])] = draw.choice([["Z"], []])
        out.append((i, " ".join(w)))
    return [*out, (900, None), (901, ""), (902, " \n"), (None, out[0][1]), (None, None), out[5], (903, "long " * 3000), (904, "Long " * 3001)]


@pytest.mark.parametrize(("n", "percent", "sizes"), [(3, 90, ()), (5, 80, ()), (1, 80, (4, 150, 300)), (3, 90, (3, 100, 1)), (5, 80, (2, 60, 2000))])
def test_components(spark, rows, n, percent, sizes):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, _h int, _n int").repartition(3)
    got = ngram_join.join_components(docs, n, percent, *sizes)
    assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == brute(rows, n, percent)


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_signature(percent):
    draw = np.random.default_rng(percent)
    for size in [*range(1, 60), 200, 1000, 6000]:
        a = np.unique(draw.integers(0, 2**64 - 1, size, dtype=np.uint64))
        for gone in {0, ngram_join.most_apart(size, percent) // 2}:
            for new in range(0, ngram_join.most_apart(size, percent) + 1 - gone, max(1, size // 20)):
                b = np.unique(np.concatenate((a[gone:], draw.integers(0, 2**64 - 1, new, dtype=np.uint64))))
                both = len(np.intersect1d(a, b))
                if gone + new and 100 * both >= percent * (len(a) + len(b) - both):
                    assert np.intersect1d(ngram_join.signatures(a, percent), ngram_join.signatures(b, percent)).size


def test_keep_one(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, _ROW string")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = [i for i, _, c in brute(rows, 5, 80) if i is None or i == c]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


def test_component_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (102, 101)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


def test_word_hashes(monkeypatch):
    texts = ["The cat", None, "", "the\x0bCAT  É é", "x" * 50 + " " + "y " * 40, "cat"]
    want = [(t or "").encode().lower().split() for t in texts]
    names = {}
    for size in (1 << 20, 16):
        monkeypatch.setattr(wordhash, "CHUNK_BYTES", size)
        got = [h[a:b].tolist() for h, bounds in words(texts) for a, b in zip(bounds[:-1], bounds[1:])]
        assert [len(g) for g in got] == [len(w) for w in want]
        for g, w in zip(got, want):
            assert all(names.setdefault(y, x) == x for x, y in zip(g, w))
    assert len(set(names.values())) == len(names)
    seen = [(first, n) for first, n, *_ in features(texts, NOT_ALNUM, (2, 3))]
    assert sum(n for _, n in seen) == len(texts) and seen[0][0] == 0
