"""Mixing, line dedup and exact dedup on odd rows, against plain Python."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.llm import exact_dedup, line_dedup, mixing

SCHEMA = "doc_id bigint, text string, source string, Norm string, digest string, _id int, size int"
ROWS = [
    (1, "Hello World", "a", "x", "d", 1, 1), (2, "hello world", "a", "x", "d", 1, 1), (3, "HELLO WORLDÉ", "b", None, None, None, None), (4, "hello worldé", None, "x", "d", 1, 1),
    (5, None, "b", "x", "d", 1, 1), (6, "", "b", "x", "d", 1, 1), (None, "", "a", "x", "d", 1, 1), (7, "w " * 5000, "c", "x", "d", 1, 1), (7, "w " * 5000, "c", "x", "d", 1, 1), (None, None, None, None, None, None, None),
]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("digest_bytes", [32, 0])
def test_exact_dedup_and_collisions(spark, docs, tmp_path, digest_bytes):
    """digest_bytes 0: all texts collide, and only the byte check tells them apart."""
    docs.repartition(3).write.parquet(path := str(tmp_path / "docs.parquet"))
    got = exact_dedup.classes(spark, path, digest_bytes).collect()
    groups = {}
    for i, text, *_ in ROWS:
        groups.setdefault(lowered(text), []).append(i)
    assert len(got) == len(ROWS)
    assert sum(r.kept for r in got) == len(groups)
    for r in got:
        own = next(v for t, v in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(own) and r.keep_id == max((i for i in own if i is not None), default=None)


def test_exact_dedup_in_batches(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    for k in range(3):
        spark.createDataFrame([(k, "same"), (10 + k, f"own {k}")], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(path)
    state = exact_dedup.dedup_state(spark, path, batch_bytes=1)
    assert sorted((r.keep.id, r.n) for r in state.collect()) == [(2, 3), (10, 1), (11, 1), (12, 1)]


def test_keep_distinct_keeps_columns(docs):
    kept = exact_dedup.keep_distinct(docs)
    assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes)
    assert Counter(lowered(r.text) for r in kept.collect()) == Counter({lowered(t): 1 for _, t, *_ in ROWS})


def test_empty_tables(spark, docs, tmp_path):
    none = docs.limit(0)
    none.write.parquet(path := str(tmp_path / "none.parquet"))
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert exact_dedup.classes(spark, path).count() == 0
    assert mixing.mix(none, labels).count() == 0 and mixing.mixed_rows(none, labels).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0


def test_mix_meets_targets(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (4, None)], "doc_id bigint, quality int")
    got = mixing.mix(docs, labels).collect()
    assert len(got) == len(ROWS)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(r.source_size == sizes[r.source] for r in got)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for source, t in target.items():
        assert t <= 2 * sizes[source] + 1e-9 and taken[source] == int(t + 1e-9)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5), labels).collect()))


def test_mixed_rows_are_whole_and_near(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 7 + 1), f"s{k % 3}", k) for k in range(600)], "doc_id bigint, text string, source string, TAKEN int")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = mixing.mixed_rows(docs, labels)
    assert rows.columns == docs.columns
    words = Counter()
    for r in rows.collect():
        words[r.source] += len(r.text.split())
    for r in mixing.mix(docs, labels).select("source", "target").distinct().collect():
        assert abs(words[r.source] - r.target) <= 7


def test_hard_quality_comes_first(spark):
    docs = spark.createDataFrame([(k, "w", "s" if k < 2000 else "t") for k in range(4000)], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(4000)], "doc_id bigint, quality int")
    got = mixing.mix(docs, labels, weights=(1,), share=0.5)
    share = got.filter("taken > 0").select(F.avg((F.col("doc_id") % 2).cast("double"))).first()[0]
    assert share > 0.6


def brute_lines(rows, span=3):
    order = sorted((k for k in range(len(rows))), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = {}, {}
    for k in order:
        lines, gone = (rows[k][1] or "").split("\n"), set()
        for i in range(len(lines) - span + 1):
            window = tuple(lines[i : i + span])
            if window == ("",) * span:
                continue
            if seen.setdefault(window, (k, i)) != (k, i):
                gone.update(range(i, i + span))
        out[k] = None if rows[k][1] is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_dedup_of_repeated_rows(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\na\nb\nc"), (3, "p\n\n\n\nq"), (3, "p\n\n\n\nq"), (3, "p\n\n\n\nq"), (4, "m\nn"), (4, "m\nn"), (5, None), (5, None), (None, "u\nv\nw"), (None, "u\nv\nw")]
    got = Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect())
    want = brute_lines(rows)
    assert got == Counter((i, want[k]) for k, (i, _) in enumerate(rows))


def test_line_dedup(spark):
    rows = [
        (1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\ny"), (3, "a\nb\nc\na\nb\nc\nz"), (4, "a\nb"), (5, None), (6, ""), (7, "\n\n\n\n\n"), (8, "\n\n\n\n\n"), (9, "b\nc\nd\ne\nnew"),
        (None, "q\nr\ns\nt"), (10, "q\nr\ns\nt"), (11, "\n".join(f"l{i % 50}" for i in range(20000))),
    ]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, _h int")).collect()}
    want = brute_lines(rows)
    for k, (i, text) in enumerate(rows):
        assert got[i].text == want[k]
        assert got[i].n_lines == (0 if text is None else text.count("\n") + 1)
        assert got[i].n_removed == got[i].n_lines - (0 if want[k] is None else want[k].count("\n") + 1) or want[k] == ""
