"""Packing in order against a quadratic dynamic program and the library's ids."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvane.llm import ordered_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
ODD = [(3, "b c. D e! " * 3), (None, "nul"), (1, None), (2, ""), (2, ""), (2**60 + 1, "It's  a\n\n test — “quoted.” 日本語。 x"), (9, "word " * 900 + "End. Next one."), (4, "\t \n")]


def padding(length, capacity):
    return 0 if length & (length - 1) == 0 else capacity - length


@settings(max_examples=400, deadline=None)
@given(steps=st.lists(st.tuples(st.integers(1, 8), st.sampled_from([0, 1, 3])), min_size=1, max_size=40), capacity=st.sampled_from([8, 11, 16]))
def test_least_cost_with_fewest_windows(steps, capacity):
    ends, penalties = np.cumsum([s for s, _ in steps]).tolist(), [p for _, p in steps]
    at, price = [0, *ends], [0, *penalties]
    best = [(0, 0)]
    for j in range(1, len(at)):
        best.append(min((best[i][0] + padding(at[j] - at[i], capacity) + price[j], best[i][1] + 1) for i in range(j) if at[j] - at[i] <= capacity))
    cuts = ordered_packing.best_cuts(ends, penalties, capacity)
    assert cuts[-1] == ends[-1] and set(cuts) <= set(ends)
    cost = sum(padding(b - a, capacity) + price[at.index(b)] for a, b in zip([0, *cuts], cuts, strict=False))
    assert (cost, len(cuts)) == best[-1]


@settings(max_examples=200, deadline=None)
@given(stops=st.lists(st.booleans(), min_size=1, max_size=60), gap=st.integers(1, 7))
def test_candidates(stops, gap):
    at, penalties = ordered_packing.candidates(np.arange(len(stops)), np.array(stops), gap, 2, 9)
    want, last = {}, 0
    for i in range(1, len(stops) + 1):
        if i == len(stops) or stops[i - 1]:
            want[i], last = (0 if i == len(stops) else 2), i
        elif (i - last) % gap == 0:
            want[i] = 9
    assert dict(zip(at.tolist(), penalties.tolist(), strict=True)) == want and at.tolist() == sorted(at.tolist())


@settings(max_examples=200, deadline=None)
@given(docs=st.lists(st.lists(st.booleans(), min_size=1, max_size=30), min_size=1, max_size=6), gap=st.integers(1, 7))
def test_candidates_of_many_documents(docs, gap):
    ends = np.cumsum([len(d) for d in docs])
    stops = np.array([x for d in docs for x in d])
    at, penalties = ordered_packing.candidates(np.arange(len(stops)), stops, gap, 2, 9, ends)
    own = [ordered_packing.candidates(np.arange(len(d)), np.array(d), gap, 2, 9) for d in docs]
    assert at.tolist() == [x + e - len(d) for d, e, (a, _) in zip(docs, ends.tolist(), own, strict=True) for x in a.tolist()]
    assert penalties.tolist() == [x for _, p in own for x in p.tolist()]


def test_sentence_ends():
    ends = set(ordered_packing.sentence_ends(PATH))
    for text, last in (("It ends.", True), ("It ends", False), ("so!\n", True), ('he said."', True), ("a\n", True), ("a, b", False)):
        assert (PLAIN.encode(text).ids[-1] in ends) == last, text


@pytest.mark.parametrize("capacity,strip,gap", [(64, 1 << 19, 16), (64, 100, 16), (1024, 1 << 19, 128), (8, 8, 8)])
def test_pack_in_order(spark, capacity, strip, gap):
    rows = [(*r, 5) for r in ODD * 4]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start int").coalesce(1)
    got = ordered_packing.pack_in_order(docs, PATH, 0, capacity, strip, gap).collect()
    at, padded, total = iter(got), 0, 0
    fill = {}
    for doc_id, text, _ in rows:  # pieces come in the order of the documents
        ids, start = PLAIN.encode(text or "", add_special_tokens=False).ids + [0], 0
        while start < len(ids):
            p = next(at)
            own = np.array(ids[start : start + p.length], "<u4").tobytes()
            assert (p.doc_id, p.start, p.doc_tokens, p.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(own))
            assert p.offset == fill.get(p.sequence_id, 0)
            fill[p.sequence_id] = p.offset + p.length
            start += p.length
        total += len(ids)
    assert next(at, None) is None and list(fill) == sorted(fill)
    for n in fill.values():
        assert n <= capacity
        padded += padding(n, capacity)
    assert sum(fill.values()) == total
    if strip > 1000:
        assert padded < 0.05 * total
    assert ordered_packing.pack_in_order(docs.limit(0), PATH).count() == 0
