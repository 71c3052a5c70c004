"""Encoding, wavelet files, packing and longest-match counts against the libraries and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvane.llm import packing, token_counts, token_files
from corvane.llm.common import scratch
from corvane.llm.encode import Encoder
from corvane.llm.wavelet import WaveletMatrix, build

FILES = {n: public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}
ENCODERS = {n: Encoder(p, 500) for n, p in FILES.items()}
PLAIN = {n: Tokenizer.from_file(p) for n, p in FILES.items()}
ODD = [(3, "b c"), (None, "nul"), (1, None), (2, ""), (2, ""), (2**60 + 1, "It's  a\n\n test — “quoted” ½²³ naïve İstanbul 日本語 \x1c\x85"), (9, "word " * 9000), (4, "\t \n")]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=300, deadline=None)
@given(text=st.text(st.one_of(st.characters(max_codepoint=0x2FF), st.sampled_from(" \n\t'sdtrevm'¼²ßſ—“…€  "), st.characters(codec="utf-8")), max_size=40))
def test_encoder_agrees_with_the_library(name, text):
    want = PLAIN[name].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(next(ENCODERS[name].ids([text])), "<u4").tolist() == want


@pytest.mark.parametrize("name", FILES)
def test_capitals_inside_words(name):
    texts = [t for c in map(chr, range(0xC0, 0x250)) for t in (f"{c}LAQ{c}L{c}R", f"a {c}arna x{c}")]
    for text, ids in zip(texts, ENCODERS[name].ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == PLAIN[name].encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("name", FILES)
def test_strings_of_added_tokens(name):
    texts = ["<|endoftext|>", "a <|endoftext|> b", "x<|startoftext|>Y <|ENDOFTEXT|>", "<|endoftext| >", "<|endoftext|><|endoftext|>'s \n", "<|endof  text|>"]
    for text, ids in zip(texts, ENCODERS[name].ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == PLAIN[name].encode(text, add_special_tokens=False).ids, text


@settings(max_examples=60, deadline=None)
@given(ids=st.lists(st.integers(0, 70), max_size=300), block=st.sampled_from([8, 64, 1024]))
def test_wavelet_matrix(ids, block):
    m = WaveletMatrix(build(np.array(ids, np.uint32), [None, 5], np.array([0, len(ids)]), block))
    assert m.decode().tolist() == ids and m.doc_ids == [None, 5]
    for i in range(0, len(ids), 7):
        assert m.access(i) == ids[i]
    for t in (0, 3, 70, 4096):
        at = [i for i, x in enumerate(ids) if x == t]
        assert m.rank(t, len(ids)) == len(at)
        assert [m.select(t, k) for k in range(len(at))] == at and m.select(t, len(at)) == -1


def test_token_files_round_trip(spark):
    docs = spark.createDataFrame([(*r, "extra") for r in ODD], "doc_id bigint, text string, path string").repartition(3)
    rows = token_files.read_tokens(token_files.write_tokens(docs, FILES["byte_bpe_50k.json"], 2, scratch(spark, "t"), 20)).collect()
    got, at = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in rows)), 0
    assert [g[1] for g in got] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i or 0))
    texts = {i: t for i, t in ODD}
    for start, doc, n, crc in got:
        ids = PLAIN["byte_bpe_50k.json"].encode(texts[doc] or "", add_special_tokens=False).ids + [2]
        assert (start, n, crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += n
    assert token_files.read_tokens(token_files.write_tokens(docs.limit(0), FILES["byte_bpe_50k.json"], 2, scratch(spark, "t"))).count() == 0


def check_bins(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark):
    docs = spark.createDataFrame([(*r, 1) for r in ODD * 5], "doc_id bigint, text string, length int").repartition(4)
    rows = packing.pack_documents(docs, FILES["word_bpe_49k.json"], 0, 50).collect()
    want = []
    for i, t in ODD * 5:
        ids = PLAIN["word_bpe_49k.json"].encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, k, a, len(ids[a : a + 50]), zlib.crc32(np.array(ids[a : a + 50], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 50))]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(want, key=key)
    assert check_bins(rows, 50) <= -(-sum(r.length for r in rows) // 50) + 1
    found = packing.put(packing.pieces(docs, FILES["word_bpe_49k.json"], 0, 50), "t")
    parted = packing.pack(found, 50, 2).collect()
    assert check_bins(parted, 50) == check_bins(rows, 50) and sorted([tuple(r)[:5] for r in parted], key=key) == sorted(want, key=key)
    assert packing.pack_documents(docs.limit(0), FILES["word_bpe_49k.json"]).count() == 0


@settings(max_examples=150, deadline=None)
@given(lengths=st.lists(st.integers(1, 12), min_size=1, max_size=40))
def test_each_bin_is_the_fullest(lengths):
    counts = {x: lengths.count(x) for x in set(lengths)}
    runs, left, bins = packing.plan(counts, 12), sorted(lengths), {}
    total = {}
    for k, (length, first, q, bin0, offset) in enumerate(runs):
        after = min((r[1] for r in runs if r[0] == length and r[1] > first), default=counts[length])
        for n in range(after - first):
            bins.setdefault(bin0 + n // q, []).append(length)
        total[length] = total.get(length, 0) + after - first
    assert total == counts
    for b in sorted(bins):
        sums = {max(left)}
        rest = list(left)
        rest.remove(max(left))
        for x in rest:
            sums |= {s + x for s in sums if s + x <= 12}
        assert sum(bins[b]) == max(sums)
        for x in bins[b]:
            left.remove(x)


@settings(max_examples=300, deadline=None)
@given(tokens=st.sets(st.text("ab", min_size=1, max_size=5), max_size=6), word=st.text("ab", max_size=14), whole=st.booleans())
def test_longest_match(tokens, word, whole):
    tokens = tokens | ({"a", "b"} if whole else set())
    n, rest = 0, word
    while rest and n is not None:
        size = next((k for k in range(len(rest), 0, -1) if rest[:k] in tokens), 0)
        n, rest = (n + 1, rest[size:]) if size else (None, rest)
    assert token_counts.LongestMatch(t.encode() for t in tokens).count(word.encode()) == n


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = set(token_counts.read_ranks(path))

    def pieces(word):
        n = 0
        while word:
            size = next(k for k in range(len(word), 0, -1) if word[:k] in tokens)
            n, word = n + 1, word[size:]
        return n

    docs = spark.createDataFrame([(*r, 0) for r in ODD], "doc_id bigint, text string, n_words int")
    for cache in (1, 1000):
        got = sorted(map(tuple, token_counts.token_counts(docs, path, cache).collect()), key=str)
        assert got == sorted(((i, len((t or "").encode().split()), sum(pieces(b" " + w) for w in (t or "").encode().split())) for i, t in ODD), key=str)


@pytest.mark.parametrize("name", FILES)
def test_new_words_go_to_the_library_together(name):
    """Many new words are few texts to the library; their ids are those of each by itself, also after a bounded cache has let them go."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeéñ'.!9 \t\n", k=rng.randint(1, 9))) for _ in range(2000)]
    own = Encoder(FILES[name], 600)
    library, sent = own.tokenizer, []

    class Counting:
        def encode_batch_fast(self, texts, **kwargs):
            sent.append(len(texts))
            return library.encode_batch_fast(texts, **kwargs)

    own.tokenizer = Counting()
    for _ in range(2):
        for at in range(0, 2000, 500):
            text = " ".join(words[at : at + 500])
            assert list(own.ids([text])) == [np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
            assert len(own.cache) <= 600 + 1500 and len(own.older) <= 600
    assert sum(sent) < 600


@pytest.mark.parametrize("name", FILES)
def test_many_texts_at_once(name):
    rng = random.Random(7)
    texts = ["".join(rng.choices([*"abreTvSlmd'  \n\t\r.,!0123é½’“ßŁ", "'s", "'re", " '", "'ll ", "\n ", "日", "<|endoftext|>"], k=rng.randint(0, 25))) for _ in range(4000)]
    for text, ids in zip(texts, Encoder(FILES[name]).ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == PLAIN[name].encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("name", FILES)
def test_the_cache_is_asked_once_for_a_piece_of_a_chunk(name):
    class Asked(dict):
        n = 0

        def get(self, *a):
            Asked.n += 1
            return super().get(*a)

        def __contains__(self, p):
            Asked.n += 1
            return super().__contains__(p)

        def __getitem__(self, p):
            Asked.n += 1
            return super().__getitem__(p)

    own = Encoder(FILES[name])
    own.cache = Asked()
    text = "one two, three. It's “é” 4 \n" * 500
    assert list(own.ids([text, text])) == [np.array(PLAIN[name].encode(text, add_special_tokens=False).ids, "<u4").tobytes()] * 2
    assert Asked.n <= 3 * 20
