"""Token alignment against plain Python on whole texts."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from corvane.llm import alignment
from corvane.llm.common import put

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["The quick brown fox; the lazy dog's café.", None, "", "a  b\n\n c \t d ", "The quick brown fox; the lazy dog's café.", " lead", "trail ", "<|endoftext|> <s> <0x41>", "日本語 ñandú 🎉🎉 x", "▁ under", "é" * 50, "ab " * 400, "\x00\x1c \x85", "aaaa" * 100]
BYTE = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
BYTE |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in BYTE.values())}


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B), alignment.Aligner(A, B)


def whole(libraries, text):
    """(A ids, B ids, groups of ids) of a text, or None."""
    if not text:
        return None
    a_ids, b_ids = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
    a_bytes = [bytes(BYTE[c] for c in libraries[0].id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(p[3:5], 16)]) if libraries[1].is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, libraries[1].id_to_piece(i)) for i in b_ids)]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return None
    ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
    ends_a, ends_b = ends(a_bytes), ends(b_bytes)
    both = sorted(set(ends_a) & set(ends_b))
    own = lambda ids, at: [[i for i, e in zip(ids, at, strict=True) if low < e <= high] for low, high in zip([0, *both], both, strict=False)]
    return a_ids, b_ids, list(zip(own(a_ids, ends_a), own(b_ids, ends_b), strict=True))


def brute(libraries, docs):
    found = [(d, whole(libraries, t)) for d, t in docs]
    links = [Counter((x, y) for a, b in (w[2] if w else ()) for x in a for y in b) for _, w in found]
    count = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    rows = []
    for (doc, w), own in zip(found, links, strict=True):
        a, b, groups = w or ([], [], [])
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        good = sum(n for p, n in own.items() if count[p] == best[p[0]])
        rows.append((doc, len(a), len(b), len(groups), own.total(), good, sum(n * count[p] for p, n in own.items()), hashlib.sha256(said.encode()).hexdigest() if w else ""))
    return sorted(rows, key=str)


@pytest.mark.parametrize("part", [1 << 22, 3])
def test_align(spark, libraries, part):
    docs = [*enumerate(TEXTS), (None, "The quick"), (3, "dog's"), (3, "dog's"), (2**60 + 1, "the lazy"), (7, "b " * 700)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, n_a int, key string").repartition(3)
    got = alignment.align_tokens(frame, A, B, part).collect()
    assert sorted(map(tuple, got), key=str) == brute(libraries, docs)
    assert alignment.align_tokens(frame.limit(0), A, B).count() == 0


def test_small_blocks(spark, libraries):
    docs = [*enumerate(TEXTS)] * 2
    rows = put(alignment.aligned(spark.createDataFrame(docs, "doc_id bigint, text string"), A, B, 7, 2), "t")
    keys = [r.key for r in rows.filter("a IS NULL").collect()]
    assert len(set(keys)) == len(docs)
    lists = alignment.counted(rows.filter("a IS NOT NULL").select("key", "a", "b", "n", "docs", "times"), 2)
    sums = {r.key: (r.n_best, r.count_sum) for r in alignment.summed_by_document(alignment.contributions(lists)).collect()}
    got = sorted((r.doc_id, *sums.get(r.key, (0, 0))) for r in rows.filter("a IS NULL").collect())
    assert got == sorted((r[0], r[5], r[6]) for r in brute(libraries, docs))


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sdtrevmabcé½ß—“…▁<0x41>  ́­")), min_size=1, max_size=30))
def test_units_agree_with_whole_texts(libraries, text):
    aligner = libraries[2]
    found, want = aligner.align(aligner.split(text)), whole(libraries, text)
    if None not in found:
        assert want is not None
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in want[2])
        assert ";".join(f[0] for f in found) == said
        assert [sum(f[k] for f in found) for k in range(1, 5)] == [len(want[0]), len(want[1]), len(want[2]), sum(len(a) * len(b) for a, b in want[2])]
        assert Counter(p for f in found for p in f[5]) == Counter(x * 32000 + y for a, b in want[2] for x in a for y in b)


def test_units_encoded_together(libraries):
    units = [u for t in TEXTS if t for u in libraries[2].split(t)] + ["▁", "x▁y", "a\n", "é", ""]
    assert libraries[2].align(units) == [libraries[2].align([u])[0] for u in units]
