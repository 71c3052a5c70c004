"""Toxicity, language model and media against brute force, and the pipeline as a whole."""

import hashlib
import math
import os
import random
import re
import resource
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import audio, media, ngram_lm, toxicity
from corvane.llm.elias_fano import EliasFano, pack, unpack


@pytest.mark.parametrize(("n", "universe"), [(0, 5), (1, 1), (7, 1 << 40), (3000, 3001), (3000, 9000), (2000, 1 << 62)])
def test_elias_fano(n, universe):
    draw = np.random.default_rng(n)
    v = np.sort(draw.integers(0, universe, n, dtype=np.uint64))
    if n == 3000:
        v[1000:2000] = v[1000]
    arrays, told = EliasFano.build(v, universe, "x")
    e = EliasFano(*unpack(pack(arrays, **told)), "x")
    assert (e.access(np.arange(n)) == v.astype(np.int64)).all()
    asked = np.concatenate((v, draw.integers(0, universe, 300, dtype=np.uint64)))
    at = np.searchsorted(v, asked)
    there = (at < n) & (v[np.minimum(at, n - 1)] == asked) if n else np.zeros(len(asked), bool)
    assert (e.find(asked) == np.where(there, at, -1)).all()


def lm_brute(train, texts, least=ngram_lm.LEAST, d=ngram_lm.DISCOUNT):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for t in map(split, train):
        s = ["<s> "] + t
        c1.update(t)
        c2.update(zip(s, s[1:]))
        c3.update(zip(s, s[1:], s[2:]))
    n, v = sum(c1.values()), len(c1)
    of1, kept1, kept2 = Counter(), Counter(), Counter()
    for (a, b), c in c2.items():
        of1[a] += c
        kept1[a] += c - d if c >= least else 0
    for (a, b, _), c in c3.items():
        kept2[a, b] += c - d if c >= least else 0

    def p2(a, w):
        own = (c1[w] - d) / n if c1[w] else d * v / n
        if not of1[a]:
            return own
        return max(0, c2[a, w] - d) * (c2[a, w] >= least) / of1[a] + (1 - kept1[a] / of1[a]) * own

    def p3(a, b, w):
        if c2[a, b] < least:
            return p2(b, w)
        return max(0, c3[a, b, w] - d) * (c3[a, b, w] >= least) / c2[a, b] + (1 - kept2[a, b] / c2[a, b]) * p2(b, w)

    out = []
    for t in map(split, texts):
        s = ["", "<s> "] + t
        base = sum(math.log10((c1[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        out.append((len(t), sum(c1[w] > 0 for w in t), base, sum(math.log10(p3(*g)) for g in zip(s, s[1:], s[2:]))))
    return n, out


def test_language_model(spark):
    draw = random.Random(3)
    say = lambda: " ".join(draw.choice("the The cat sat on a mat dog ran é".split()) for _ in range(draw.randint(0, 30)))
    train = [say() for _ in range(120)] + [None, "", "once"]
    asked = [*[say() for _ in range(30)], None, "", "never seen words", "the cat", "the cat"]
    trie = ngram_lm.train(spark.createDataFrame([(t, 1) for t in train], "text string, shard int").repartition(3))
    n, want = lm_brute(train, asked)
    assert trie.tokens == n and trie.triples
    docs = spark.createDataFrame([(k if k else None, t, "x") for k, t in enumerate(asked)], "doc_id bigint, text string, score string")
    got = {r.doc_id or 0: r for r in ngram_lm.score(docs, trie).collect()}
    for k, (tokens, known, base, score) in enumerate(want):
        assert (got[k].n_tokens, got[k].n_known) == (tokens, known)
        assert got[k].base_score == pytest.approx(base) and abs(got[k].score - score) <= 0.05 * tokens
    none = ngram_lm.train(spark.createDataFrame([], "text string"))
    assert [r.score for r in ngram_lm.score(docs.limit(2), none).collect()] == [0.0, 0.0]


def test_language_model_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 300)
    draw = random.Random(8)
    say = lambda: " ".join(f"w{int(draw.paretovariate(0.7)) % 200}" for _ in range(draw.randint(0, 40)))
    train, asked = [say() for _ in range(150)], [say() for _ in range(40)]
    trie = ngram_lm.train(spark.createDataFrame([(t,) for t in train], "text string").repartition(3))
    assert trie.shards >= 4
    got = {r.doc_id: r for r in ngram_lm.score(spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string"), trie).collect()}
    for k, (tokens, known, base, score) in enumerate(lm_brute(train, asked)[1]):
        assert (got[k].n_tokens, got[k].n_known) == (tokens, known) and got[k].base_score == pytest.approx(base) and abs(got[k].score - score) <= 0.05 * tokens


def test_language_model_keeps_what_is_seen_once(spark):
    train, asked = ["one two three four", "one two five", "five six"], ["one two three", "one two five", "two three four", "five six seven", "six one"]
    trie = ngram_lm.train(spark.createDataFrame([(t,) for t in train], "text string"))
    assert sum(p[2] for p in trie.pairs.values()) == 10 and sum(t[2] for t in trie.triples.values()) == 8
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in ngram_lm.score(docs, trie).collect()}
    for k, (tokens, _, _, score) in enumerate(lm_brute(train, asked, least=1)[1]):
        assert abs(got[k] - score) <= 0.05 * tokens


def test_spans_of_ascending_keys():
    keys = np.array([-1, -1, 0, 0, 3, 9, 9, 20])
    bounds = [0, 3, 3, 9, 30]
    got = {k: keys[own].tolist() for k, own in ngram_lm._spans(keys, bounds)}
    assert got == {0: [0, 0], 2: [3], 3: [9, 9, 20]}
    assert not list(ngram_lm._spans(keys[:0], bounds)) and not list(ngram_lm._spans(keys[:2], bounds))


def test_more_maps_than_open_files(tmp_path):
    """A model of many shards has more files than a process may hold open."""
    from corvane.llm.files import map_file, write_file

    for k in range(60):
        write_file(f"file://{tmp_path}/{k}", bytes([k]) * 8)
    before = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (max(map(int, os.listdir("/proc/self/fd"))) + 20, before[1]))
    try:
        maps = [map_file(f"file://{tmp_path}/{k}") for k in range(60)]
        assert [m[7] for m in maps] == list(range(60))
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, before)


def test_block_max_index_is_exact():
    draw = random.Random(5)
    for _ in range(150):
        vectors = [{t: draw.random() for t in draw.sample(range(8), draw.randint(0, 4))} for _ in range(draw.randint(1, 200))]
        query, without = {t: draw.random() for t in sorted(draw.sample(range(8), 3))}, draw.choice([-1, 0])
        want = sorted(((sum(query[t] * v[t] for t in query if t in v), -d) for d, v in enumerate(vectors) if d != without), reverse=True)[:5]
        flat = [(d, t, w) for d, v in enumerate(vectors) for t, w in v.items()]
        owner, term, weight = (np.array([f[k] for f in flat], kind) for k, kind in enumerate((np.int64, np.int64, np.float64)))
        block = draw.choice([2, 4, 16])
        index = toxicity.BlockMaxIndex(toxicity.BlockMaxIndex.build(owner, term, weight, len(vectors), 8, block, draw.choice([1, 2, 4])), block)
        got = next(index.search([(np.array(list(query)), np.array(list(query.values())))], 5, [without]))[0]
        assert [round(s, 9) for s in got] == [round(s, 9) for s, _ in want if s > 0]


def test_isotonic():
    assert toxicity.isotonic([0.1, 0.2, 0.3, 0.3], [0, 1, 0, 1], [1, 1, 1, 1]) == ([0.1, pytest.approx(0.8 / 3)], [0, pytest.approx(2 / 3)])
    assert toxicity.isotonic([], [], []) == ([], [])


def toxic_brute(docs, labels, train, texts, k=toxicity.NEIGHBOURS):
    """Scores by plain Python: the whole of the weights, the votes and the calibration."""
    split = lambda t: Counter(re.findall(r"[a-z0-9\x80-\xff]+", (t or "").encode().lower().decode("latin-1")))
    known = {}
    for i, y in labels:
        if i is not None and y is not None and train(i):
            known[i] = max(known.get(i, 0), y)
    by_id = {}
    for i, t in docs:
        if i in known:
            by_id.setdefault(i, []).append(t)
    examples = [(i, known[i], split(min((t for t in ts if t is not None), default=None))) for i, ts in sorted(by_id.items())]
    n = [sum(e[1] == y for e in examples) for y in (0, 1)]
    df, all_docs = Counter(), [split(t) for _, t in docs]
    for d in all_docs:
        df.update(d.keys())
    seen = [Counter(), Counter()]
    for _, y, c in examples:
        seen[y].update(c.keys())

    def factor(t):
        cells = [(seen[y][t], n[y], seen[0][t] + seen[1][t]) for y in (0, 1)] + [(n[y] - seen[y][t], n[y], sum(n) - seen[0][t] - seen[1][t]) for y in (0, 1)]
        g = 2 * sum(o * math.log(o * sum(n) / (row * column)) for o, row, column in cells if o)
        return max(0.0, g) * (math.log((len(docs) + 1) / (df[t] + 0.5)) + 1)

    factors = {t: factor(t) for t in {*seen[0], *seen[1]}}

    def vector(c):
        v = {t: (1 + math.log(x)) * factors[t] for t, x in c.items() if factors.get(t, 0) > 0}
        size = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / size for t, w in v.items()}

    vectors = [vector(c) for _, _, c in examples]

    def votes(v, without=-1):
        near = sorted(((sum(w * u[t] for t, w in v.items() if t in u), -j) for j, u in enumerate(vectors) if j != without), reverse=True)[:k]
        near = [(s, -j) for s, j in near if s > 1e-12]
        weights = [1 / (1.05 - min(1, s)) for s, _ in near]
        return (sum(w for w, (_, j) in zip(weights, near) if examples[j][1]) + n[1] / sum(n)) / (sum(weights) + 1) if near else None

    size = [sum(y == z for z in known.values()) for y in (0, 1)]
    told = [(votes(v, j), examples[j][1]) for j, v in enumerate(vectors)]
    line = toxicity.isotonic([v for v, _ in told if v is not None], [y for v, y in told if v is not None], [size[y] / n[y] for v, y in told if v is not None])
    out = [votes(vector(split(t))) for t in texts]
    return [None if v is None else float(np.interp(v, *line)) for v in out]


def toxic_rows(n):
    draw = random.Random(7)
    word = lambda: "".join(draw.choice(["ta", "ri", "mo", "ne", "su", "ka"]) for _ in range(draw.randint(1, 4)))
    rows = []
    for k in range(n):
        w = [word() for _ in range(draw.randint(5, 60))]
        if k % 5 == 0:
            for _ in range(3):
                w.insert(draw.randrange(len(w)), draw.choice(["Grobian!", "nastyx", "vilest", "zork"]))
        rows.append((k, " ".join(w), int(k % 5 == 0)))
    return rows


def test_toxicity_scores(spark):
    rows = toxic_rows(200)
    docs = [(i, t) for i, t, _ in rows] + [(7, rows[8][1]), (None, "grobian ta"), (3, None)]
    labels = [(i, y) for i, _, y in rows] + [(3, 1)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id bigint, toxic int"), F.col("doc_id") % 3 != 0)
    asked = [t for i, t, _ in rows if i % 3 == 0] + ["zork", "ta ri mo " * 50, "nastyx grobian"]
    got = [s for s, _ in model.scores(list(toxicity.term_counts(asked)))]
    assert got == pytest.approx(toxic_brute(docs, labels, lambda i: i % 3 != 0, asked), abs=1e-6)


def test_toxicity_held_out(spark):
    rows = toxic_rows(900)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, "x"), (5000, "", "x"), (5001, "ta " * 20000, "x"), (7, rows[7][1], "x")], "doc_id bigint, text string, toxic string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (3, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, labels.doc_id % 3 != 0)
    scored = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.scorer(model, spark)(docs.text).alias("s")).collect()}
    held = [(scored[i].score >= 0.5, bool(y)) for i, _, y in rows if i % 3 == 0]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= s.score <= 1 for s in scored.values()) and scored[None].score < 0.5 and scored[5000] == scored[None]
    assert scored[0].evidence[0].toxic == 1 and len(scored[0].evidence) == toxicity.EVIDENCE and scored[5000].evidence == []
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.filter("text = ''").count() == 1
    nothing = toxicity.fit(docs, labels.limit(0))
    assert next(nothing.scores(list(toxicity.term_counts(["ta"])))) == (0.25, [])
    assert toxicity.reject_toxic(docs.limit(0), labels).count() == 0 and toxicity.reject_toxic(docs.limit(0), labels.limit(0)).count() == 0


def test_companding_tables():
    assert (audio.MULAW_TABLE[0], audio.MULAW_TABLE[0x80], audio.MULAW_TABLE[0xFF], audio.MULAW_TABLE[0x7F]) == (-32124, 32124, 0, 0)
    assert (audio.ALAW_TABLE[0x2A], audio.ALAW_TABLE[0xAA], audio.ALAW_TABLE[0xD5], audio.ALAW_TABLE[0x55]) == (-32256, 32256, 8, -8)


def adpcm_one(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(audio.INDEX_CHANGE[code])))
            out.append(value)
    return out


def test_adpcm_blocks():
    raw = np.random.default_rng(1).integers(0, 256, (5, 24), dtype=np.uint8)
    assert audio.decode_adpcm(raw).tolist() == [adpcm_one(bytes(b)) for b in raw]


def test_resampling_keeps_level_and_length():
    pcm = np.full(500, 1000, np.int16)
    up = audio.resample(pcm, 3, 2, audio.taps(3, 2))
    assert len(up) == 750 and (abs(up[50:-50].astype(int) - 1000) <= 2).all()
    assert audio.resample(pcm[:0], 2, 1, audio.taps(2, 1)).size == 0


@pytest.mark.parametrize("codec", [audio.MULAW, audio.ALAW, audio.ADPCM])
def test_wav_round_trip(codec):
    data = bytes(range(192)) * 2
    assert audio.parse_wav(audio.wav(codec, data, 8000, 192)) == (codec, 8000, 192 if codec == audio.ADPCM else 1, data)
    with pytest.raises(ValueError):
        audio.parse_wav(b"no audio")


def test_media(spark):
    texts = ["", None, "abc", "é" * 96, "x" * 192, "x" * 193, "long " * 30000, "abc"]
    docs = spark.createDataFrame([(k if k != 4 else None, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, media string")
    stored = media.to_media(docs)
    got = {r.doc_id: r for r in media.features(stored).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[k if k != 4 else None]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
    assert tuple(got[2])[1:] == tuple(got[7])[1:] and tuple(got[0])[1:] == tuple(got[1])[1:]
    sound = {r.doc_id: r for r in media.pcm(stored).collect()}
    assert all(f"pcm_crc32={zlib.crc32(bytes(sound[i].pcm))}" in got[i].feature for i in got)
    assert media.features(media.to_media(docs.limit(0))).count() == 0


def plain_adpcm(codes, value=0, index=0):
    """The samples of 4-bit codes in one run."""
    out = []
    for byte in codes:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + (-1 if code & 7 < 4 else 2 * (code & 7) - 6)))
            out.append(value)
    return out


def plain_g711(codec, byte):
    if codec == audio.MULAW:
        byte ^= 255
        size = ((2 * (byte & 15) + 33) << (byte >> 4 & 7)) * 4 - 132
        return -size if byte & 128 else size
    byte ^= 0x55
    size = (2 * (byte & 15) + (33 if byte & 112 else 1)) * 8 << max(0, (byte >> 4 & 7) - 1)
    return size if byte & 128 else -size


def plain_resample(pcm, up, down, half=8):
    """Each sample as a sum over its window, in the same 1/32768 parts."""
    wide, n = max(1.0, down / up), len(pcm)
    reach, out = int(half * wide), []
    for j in range(-(-n * up // down)):
        at, phase = divmod(j * down, up)
        xs = [k - phase / up for k in range(-reach + 1, reach + 1)]
        w = [(math.sin(math.pi * x / wide) / (math.pi * x / wide) if x else 1.0) * math.cos(math.pi * max(-0.5, min(0.5, x / (reach + 1)))) ** 2 for x in xs]
        taps = [round(v / sum(w) * 32768) for v in w]
        total = sum(t * pcm[at + k] for t, k in zip(taps, range(-reach + 1, reach + 1)) if 0 <= at + k < n)
        out.append(max(-32768, min(32767, total + 16384 >> 15)))
    return out


@pytest.mark.parametrize("chunk", [1, 3, 8192])
def test_adpcm_heads(chunk):
    draw = np.random.default_rng(2)
    payloads = [draw.integers(0, 256, 24 * k, dtype=np.uint8).tobytes() for k in (1, 5, 2)] + [b"x" * 72, bytes([0x77]) * 72, bytes([0xFF]) * 48]
    bodies = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 24)
    first = np.array([k == 0 for p in payloads for k in range(len(p) // 24)])
    heads = audio.adpcm_heads(bodies, first, chunk)
    assert heads.tobytes() == b"".join(d[k : k + 4] for d in audio.adpcm_data(payloads, 24) for k in range(0, len(d), 28))
    for p, d, pcm in zip(payloads, audio.adpcm_data(payloads, 24), audio.to_pcm(audio.ADPCM, 28, audio.adpcm_data(payloads, 24))):
        assert audio.sound_codes(audio.ADPCM, 28, d) == p
        want = plain_adpcm(p)
        told = [v for k in range(0, len(want), 48) for v in [want[k - 1] if k else 0] + want[k : k + 48]]
        assert pcm.tolist() == told


def test_stored_adpcm_is_what_an_encoder_writes(spark):
    """Heads of blocks are states, no payload bytes: an index within the table, a zero, and the sample that the block before ends with."""
    docs = spark.createDataFrame([(k, f"zebra {k} " * (30 * k)) for k in range(1, 15)], "doc_id bigint, text string")
    seen = 0
    for r in media.to_media(docs).collect():
        codec, _, block, data = audio.parse_wav(bytes(r.media))
        if codec == audio.ADPCM:
            last = 0
            for k in range(0, len(data), block):
                assert data[k + 2] <= 88 and data[k + 3] == 0 and int.from_bytes(data[k : k + 2], "little", signed=True) == last
                last = adpcm_one(data[k : k + block])[-1]
                seen += 1
    assert seen > 10


def test_short_last_block():
    data = bytes(range(56))
    whole = audio.to_pcm(audio.ADPCM, 28, [data])[0].tolist()
    assert [s.tolist() for s in audio.to_pcm(audio.ADPCM, 28, [data[:40], data[:30], data[:28]])] == [whole[: 49 + 17], whole[:49], whole[:49]]


@pytest.mark.parametrize(("up", "down"), [(2, 1), (3, 2), (1, 3), (160, 441)])
def test_resampling_is_the_sum_over_the_window(up, down):
    pcm = np.random.default_rng(up).integers(-32768, 32768, 95)
    got = audio.resample(pcm.astype(np.int16), up, down, audio.taps(up, down)).tolist()
    want = plain_resample(pcm.tolist(), up, down)
    assert got == want


def test_every_rate_becomes_16_khz(spark):
    stored = spark.createDataFrame([(r, audio.wav(audio.MULAW, b"some sound" * 50, r)) for r in (8000, 11025, 16000, 32000)], "doc_id bigint, media binary")
    got = {r.doc_id: r for r in media.pcm(stored).collect()}
    assert {k: (r.rate, len(r.pcm) // 2) for k, r in got.items()} == {k: (16000, -(-500 * 16000 // k)) for k in (8000, 11025, 16000, 32000)}
    assert bytes(got[16000].pcm) == audio.MULAW_TABLE[np.frombuffer(b"some sound" * 50, np.uint8)].tobytes()


@pytest.mark.parametrize("parts", [(), (3,)])
def test_media_features_of_stored_pcm(spark, monkeypatch, parts):
    """The PCM of every file is written and read back, and features are those of a plain decoder."""
    texts = [None, "abc", *(f"some words of text {k} é" * (3 * k) for k in range(12)), "abc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    written, real = {}, media.put

    def spy(df, name, *rest, **named):
        kept = real(df, name, *rest, **named)
        if "pcm" in kept.columns:
            assert not written.keys() & (rows := {r.doc_id: bytes(r.pcm) for r in kept.collect()}).keys()
            written.update(rows)
        return kept

    monkeypatch.setattr(media, "put", spy)
    got = {r.doc_id: r for r in media.features(media.to_media(docs), *parts).collect()}
    assert len(got) == len(texts) == len(written)
    codecs = set()
    for k, t in enumerate(texts):
        full = (t or "").encode()
        full += b" " * (max(192, -(-len(full) // 192) * 192) - len(full))
        codec = ("mulaw", "alaw", "adpcm")[zlib.crc32(full) % 3]
        codecs.add(codec)
        pcm = [plain_g711(codec, b) for b in full]
        if codec == "adpcm":
            run = plain_adpcm(full)
            pcm = [v for at in range(0, len(run), 384) for v in [run[at - 1] if at else 0] + run[at : at + 384]]
        pcm = plain_resample(pcm, 2, 1)
        raw = np.array(pcm, "<i2").tobytes()
        assert written[k] == raw
        power, crossings = sum(v * v for v in pcm) // len(pcm), sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))
        assert got[k].feature == f"{codec};rate=16000;samples={len(pcm)};peak={max(map(abs, pcm))};power={power};crossings={crossings};pcm_crc32={zlib.crc32(raw)}"
        assert (got[k].payload_sha256, got[k].n_bytes) == (hashlib.sha256(full).hexdigest(), len((t or "").encode()))
    assert codecs == {"mulaw", "alaw", "adpcm"}


def test_pipeline(spark):
    """Stages in turn on the smallest tables: copies and toxic documents go, and the packed rows are those of the mix."""
    import corpus_pipeline as p
    from corvane.llm.common import put, table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    for name, stage in p.STAGES[:-1]:
        before, docs = docs, put(stage(spark, docs, sf), "test")
        assert docs.columns == before.columns and docs.count()
        if name == "exact_dedup":
            texts = [r.text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for r in docs.collect()]
            assert len(texts) == len(set(texts)) == len({r.text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for r in before.collect()})
    packed = p.STAGES[-1][1](spark, docs, sf)
    assert Counter(r.doc_id for r in packed.filter("piece = 0").collect()) == Counter(r.doc_id for r in docs.collect())


def test_scoring_lets_encoders_go(spark):
    """A worker that has packed keeps its encoder, but not while it scores: the stages share an executor's memory."""
    import pandas as pd
    import public_tokenizers

    from corvane.llm import encode

    docs = spark.createDataFrame([(k, f"word{k % 5} and more") for k in range(20)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(20)], "doc_id bigint, toxic int")
    score = toxicity.scorer(toxicity.fit(docs, labels), spark).func
    encode.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    told = score(iter([pd.Series(["word0 and more"])]))
    assert len(next(told)) == 1 and not encode._encoders
